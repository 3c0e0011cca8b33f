import random

import pytest
from pyspark.sql import functions as F

from volseg.operators import ordered as O
from volseg.storage import Scratch


@pytest.mark.parametrize("held,batch", [(O.HELD_ROWS, 10_000), (7, 5), (2, 1)])
def test_starts_and_totals(spark, monkeypatch, held, batch):
    monkeypatch.setattr(O, "HELD_ROWS", held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        r = random.Random(batch)
        rows = [(r.choice(["hot", "hot", "hot", None, "a", "b", *"cdefghij"]), i, r.randint(0, 5)) for i in range(600)]
        df = spark.createDataFrame(rows, "g string, v int, w bigint").repartition(3)
        got = {(x.g, x.v): (x.w, x.start, x.total) for x in O.running_totals(df, ["g"], ["v"], "w", Scratch(spark, "t")).collect()}
        want, sums = {}, {}
        for g, v, w in rows:
            want[g, v] = (w, sums.get(g, 0))
            sums[g] = sums.get(g, 0) + w
        assert got == {k: (w, s, sums[k[0]]) for k, (w, s) in want.items()}
        alone = O.running_totals(df, [], ["v"], "w", Scratch(spark, "t")).agg(F.max("start"), F.max("total"), F.count(F.lit(1))).first()
        assert tuple(alone) == (sum(x[2] for x in rows) - rows[-1][2], sum(x[2] for x in rows), 600)
        assert O.running_totals(df.limit(0), ["g"], ["v"], "w", Scratch(spark, "t")).collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
