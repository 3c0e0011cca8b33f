from pyspark.sql import functions as F

from volseg.operators import grid

#: 1026 chunks on z: the bits of the last two run into those of y.
CHUNK, EXTENT = (16, 16, 8), (32, 32, 8208)


def test_packed_bits_beyond_the_limit(spark):
    c = [F.col(k) for k in ("mip", "cx", "cy", "cz")]
    rows = grid.chunks(spark, EXTENT, CHUNK).select(*c, grid.packed(c[0] + 1, *c[1:]).alias("p")).collect()
    assert all(r.p == (r.mip + 1) << 56 | r.cx << 46 | r.cy << 36 | r.cz << 26 for r in rows)
    assert max(r.cz for r in rows) == 1025


def test_slices_of_chunks_whose_packed_ids_repeat(spark):
    c = [F.col(k) for k in ("cx", "cy", "cz")]
    low = grid.chunks(spark, EXTENT, CHUNK).where("mip = 0").select("mip", *c, grid.packed(F.lit(1), *c).alias("ac"))
    assert low.select("ac").distinct().count() < low.count()
    top = grid.levels(EXTENT, CHUNK)
    up = grid.ancestors(low, top).join(low, ["mip", "cx", "cy", "cz"]).where("amip = 2")
    slices = up.select(F.col("amip").alias("mip"), F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.col("az").alias("cz"), *[x.alias(f"o{k}") for x, k in zip(c, "xyz")], (F.col("ac") + 3).alias("old"), (F.col("ac") + 200).alias("new"))
    got = sorted((r.cx, r.cy, r.cz, r.old) for r in grid.gather_slices(slices, low, top).collect())
    assert got == sorted((r.cx, r.cy, r.cz, r.ac + 3) for r in low.collect())
    # ids that fit tell the chunks apart without that, and are what may be handed out
    near = low.where("cz < 1024")
    fits = grid.gather_slices(slices.where("oz < 1024").drop("ox", "oy", "oz"), near, top)
    assert fits.count() == near.count() == near.select(grid.chunk_id(F.lit(1), *c).alias("ac")).distinct().count()
