import numpy as np
import pytest
from pyspark.sql import functions as F

from volseg.operators import features, nucleus
from volseg.storage import Scratch

BOX = "sid bigint, anchor bigint, x0 bigint, y0 bigint, z0 bigint, x1 bigint, y1 bigint, z1 bigint"


def volume(spark, wall=0.1):
    """A bar of 12 x 4 x 4 voxels with a core at either end and a weak wall at x = 7; a stranger lies beside it."""
    rows = []
    for x in range(12):
        for y in range(6):
            for z in range(4):
                sid = 5 if y < 4 else 9
                nuc = (1 if x < 2 else 2 if x >= 10 else 0) if y < 2 and z < 2 else 0
                a = wall if x in (6, 7) else 0.9
                rows.append((x, y, z, a, a, a, sid, nuc))
    return spark.createDataFrame(rows, "x int, y int, z int, ax double, ay double, az double, sid bigint, nuc bigint")


def units(spark, v):
    groups = spark.createDataFrame([(5, 1, 1, 2, 1), (5, 2, 1, 2, 1)], "sid bigint, nuc bigint, anchor bigint, members bigint, groups bigint")
    boxes = nucleus.parent_boxes(v, nucleus.unit_boxes(groups, nucleus.geometry(v), (0, 4, 4), (12, 6, 4)), 2, (12, 6, 4))
    return groups, boxes


@pytest.mark.parametrize("factor", [1, 2])
def test_flood_and_overlay(spark, factor):
    v = volume(spark)
    groups, boxes = units(spark, v)
    assert [tuple(r) for r in boxes.collect()] == [(5, 1, 0, 12, 0, 4, 0, 4)] or boxes.count() == 1
    territories = Scratch(spark, "t").save(nucleus.flood_units(v, nucleus.checked_units(boxes, groups), groups, factor, (4, 4, 4)))
    cells = territories.collect()
    assert len(cells) == (12 * 4 * 4) // factor**3 and {c.territory for c in cells} == {1, 2}
    # the wall is reached last, from both sides
    assert all(c.territory == (1 if c.px * factor < 6 else 2) for c in cells if c.px * factor not in (6, 7))
    out = nucleus.overlay(v.select("x", "y", "z", "sid", "nuc"), territories, factor).collect()
    minted = {1: nucleus.mint_id(1), 2: nucleus.mint_id(2)}
    assert all((r.sid, r.nuc) == (9, 0) if r.y >= 4 else r.sid == minted[r.nuc] for r in out)
    ledger = {(r.owner, r.minted) for r in nucleus.ledger(territories).collect()}
    assert ledger == set(minted.items())


def test_a_nucleus_without_a_block_is_an_error(spark):
    v = volume(spark).withColumn("nuc", F.when((F.col("nuc") == 2) & (F.col("x") % 2 == 0), 0).otherwise(F.col("nuc")))
    groups, boxes = units(spark, v)
    assert nucleus.flood_units(v, boxes, groups, 1, (4, 4, 4)).count() > 0
    with pytest.raises(Exception, match="no block of its own"):
        nucleus.flood_units(v, boxes, groups, 2, (4, 4, 4)).collect()


def test_units_are_checked(spark):
    groups = spark.createDataFrame([(5, 1, 1, 2, 2), (5, 2, 1, 2, 2)], "sid bigint, nuc bigint, anchor bigint, members bigint, groups bigint")
    apart = spark.createDataFrame([(5, 1, 0, 0, 0, 4, 4, 4), (5, 3, 4, 0, 0, 8, 4, 4), (6, 1, 0, 0, 0, 9, 9, 9)], BOX)
    assert nucleus.checked_units(apart, groups).count() == 3  # boxes of different segments may overlap
    with pytest.raises(ValueError, match="overlap"):
        nucleus.checked_units(apart.withColumn("x0", F.lit(0).cast("bigint")), groups)
    with pytest.raises(ValueError, match="namespace"):
        nucleus.checked_units(apart, groups.withColumn("sid", F.lit(1 << 57)))
    assert nucleus.clashes(apart.limit(0)).count() == 0 and nucleus.id_faults(groups.limit(0)).count() == 0


def test_territory_ids_are_minted_from_parent_and_anchor(spark):
    import hashlib

    want = (1 << 60) + int.from_bytes(hashlib.sha256(b"nucleus-territory:5:7").digest()[:7], "big")
    assert spark.range(1).select(nucleus.mint_territory(F.lit(5), F.lit(7))).first()[0] == want


def test_features_of_others(spark):
    features.register_feature("widest", lambda: [(F.max("x") - F.min("x") + 1).alias("width")])
    got = features.features(volume(spark), "size", "widest").collect()
    assert {(r.sid, r.size, r.width) for r in got} == {(5, 192, 12), (9, 96, 12)}


def test_closing():
    from volseg.operators import kernels as K

    mask = np.zeros((7, 7, 1), dtype=bool)
    mask[1, 3] = mask[5, 3] = mask[3, 1] = mask[3, 5] = True
    assert not K.closed(mask, K.element("x", 1))[3, 3] and K.closed(mask, K.element("x", 2))[3, 3] and K.closed(mask, K.element("diamond", 2))[3, 3]
    diagonal = np.zeros((7, 7, 1), dtype=bool)
    diagonal[2, 2] = diagonal[4, 4] = True
    assert K.closed(diagonal, K.element("d", 1))[3, 3] and not K.closed(diagonal, K.element("a", 1))[3, 3]
    aff = np.full((3, 1, 1, 5), 0.9)
    aff[2, 0, 0, [0, 2]] = 0.2
    out = K.close_affinities(aff, (0, 0, 1), (0.5, 0.5, 0.5), 0.5)
    assert out[2, 0, 0].tolist() == [0.2, 0.45, 0.2, 0.9, 0.9] and (out[:2] == 0.9).all()
