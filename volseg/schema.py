"""States of a nucleus record and the bound of ids."""

from __future__ import annotations

#: States of a nucleus record.
NONE, PROPER, CONFLICT = 0, 1, 2
#: Ids are non-negative 64-bit integers below this bound; unsigned ids beyond it are refused at the source.
ID_LIMIT = 1 << 63
