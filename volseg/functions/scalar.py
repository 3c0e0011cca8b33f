"""Small column expressions used throughout; all are built-in functions, none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_decode(c: Column) -> Column:
    """Percent codes decoded; a plus sign stays one."""
    return F.url_decode(F.regexp_replace(c, r"\+", "%2B"))


def canonical_path(c: Column) -> Column:
    """A path without repeated slashes and single-dot parts, percent codes decoded."""
    return F.regexp_replace(F.regexp_replace(percent_decode(c), r"/(\./)+", "/"), r"/{2,}", "/")
