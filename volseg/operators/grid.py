"""The chunk octree as relations: ids, boxes, flags, parents, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that one chunk may hand out.
IDS_PER_CHUNK = 1 << 26
#: Chunk coordinates are packed with ten bits each.
COORD_LIMIT = 1024


def packed(layer: Column, x: Column, y: Column, z: Column) -> Column:
    """``layer<<56 | x<<46 | y<<36 | z<<26`` as it stands: from 1024 on the bits of a coordinate run into those of the one
    before, and several chunks have the same value. Where ids are handed out, :func:`chunk_id` refuses that."""
    bits = F.shiftleft(layer.cast("bigint"), 56)
    for c, by in ((x, 46), (y, 36), (z, 26)):
        bits = bits.bitwiseOR(F.shiftleft(c.cast("bigint"), by))
    return bits


def chunk_id(layer: Column, x: Column, y: Column, z: Column) -> Column:
    """:func:`packed`, which no two chunks share; a coordinate of 1024 or more is an error."""
    fits = (F.greatest(x, y, z) < COORD_LIMIT) & (F.least(x, y, z) >= 0)
    return F.when(fits, packed(layer, x, y, z)).otherwise(F.raise_error(F.lit("chunk coordinate out of range")).cast("bigint"))


def owner(sid: Column) -> Column:
    """The chunk that handed out an id."""
    return sid - sid % F.lit(IDS_PER_CHUNK)


def owner_coords(sid: Column) -> list[Column]:
    """Layer and chunk coordinates of an id."""
    layer = F.shiftright(sid, 56)
    return [layer.alias("layer"), *[F.shiftright(sid, b).bitwiseAND(F.lit(COORD_LIMIT - 1).cast("bigint")).alias(a) for b, a in ((46, "cx"), (36, "cy"), (26, "cz"))]]


def tag(*parts: Column) -> Column:
    """``mip_x_y_z``."""
    return F.concat_ws("_", *[p.cast("string") for p in parts])


def split_tag(col: Column) -> list[Column]:
    """mip, x, y, z of a tag; null where the tag has another form."""
    parts = F.split(col, "_")
    well_formed = col.rlike(r"^\d+_\d+_\d+_\d+$")
    return [F.when(well_formed, parts[i]).cast("int").alias(a) for i, a in enumerate(("mip", "cx", "cy", "cz"))]


def levels(extent: tuple[int, int, int], chunk: tuple[int, int, int]) -> int:
    """The mip at which one chunk covers the volume."""
    return max(0, *(max(0, -(-e // c) - 1).bit_length() for e, c in zip(extent, chunk)))


def chunks(spark: SparkSession, extent: tuple[int, int, int], chunk: tuple[int, int, int]) -> DataFrame:
    """Every chunk of every mip: ``mip, cx, cy, cz``, its box (stop exclusive) and ``edge_*``, 1 where the volume ends."""
    top = levels(extent, chunk)
    df = spark.range(top + 1).select(F.col("id").cast("int").alias("mip"))
    for c, e, size in zip("xyz", extent, chunk):
        last = F.floor(F.lit(-(-e // size) - 1) / F.pow(F.lit(2), F.col("mip"))).cast("int")
        df = df.withColumn(f"c{c}", F.explode(F.sequence(F.lit(0), last)))
    scale = F.expr("shiftleft(1, mip)")
    out = [F.col(c) for c in ("mip", "cx", "cy", "cz")]
    for c, e, size in zip("xyz", extent, chunk):
        lo = F.col(f"c{c}") * scale * size
        hi = F.least((F.col(f"c{c}") + 1) * scale * size, F.lit(e))
        out += [lo.alias(f"{c}0"), hi.alias(f"{c}1"), (lo == 0).cast("int").alias(f"edge_{c}0"), (hi == e).cast("int").alias(f"edge_{c}1")]
    return df.select(*out)


def parent(df: DataFrame) -> DataFrame:
    """Adds the parent's ``pmip, px, py, pz``."""
    half = [F.floor(F.col(f"c{c}") / 2).cast("int").alias(f"p{c}") for c in "xyz"]
    return df.select("*", (F.col("mip") + 1).alias("pmip"), *half)


def ancestors(df: DataFrame, top: int) -> DataFrame:
    """``mip, cx, cy, cz`` with every ancestor ``amip, ax, ay, az`` from the chunk itself up to ``top``."""
    up = df.select("mip", "cx", "cy", "cz", F.explode(F.sequence("mip", F.lit(top))).alias("amip"))
    return up.select("*", *[F.floor(F.col(f"c{c}") / F.pow(F.lit(2), F.col("amip") - F.col("mip"))).cast("int").alias(f"a{c}") for c in "xyz"])


def children(df: DataFrame, grid: DataFrame) -> DataFrame:
    """``mip, cx, cy, cz`` with the chunks one mip below that they consist of, ``kx, ky, kz``."""
    below = parent(grid.select("mip", "cx", "cy", "cz")).select(F.col("pmip").alias("mip"), F.col("px").alias("cx"), F.col("py").alias("cy"), F.col("pz").alias("cz"), F.col("cx").alias("kx"), F.col("cy").alias("ky"), F.col("cz").alias("kz"))
    return df.select("mip", "cx", "cy", "cz").join(below, ["mip", "cx", "cy", "cz"])


def _steps(values: tuple[int, ...]) -> Column:
    """The steps to neighbours as an array of structs."""
    return F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dz")) for a in values for b in values for c in values])


def neighbours(df: DataFrame) -> DataFrame:
    """The up to 27 chunks around and including each one, ``nx, ny, nz``, within the volume."""
    near = df.select("mip", "cx", "cy", "cz", *[f"edge_{c}{i}" for c in "xyz" for i in (0, 1)], F.explode(_steps((-1, 0, 1))).alias("d"))
    for c in "xyz":
        step = F.col(f"d.d{c}")
        near = near.where(~((step == -1) & (F.col(f"edge_{c}0") == 1)) & ~((step == 1) & (F.col(f"edge_{c}1") == 1)))
    return near.select("mip", "cx", "cy", "cz", *[(F.col(f"c{c}") + F.col(f"d.d{c}")).alias(f"n{c}") for c in "xyz"])


def siblings(df: DataFrame) -> DataFrame:
    """The chunk and its forward neighbours over faces, edges and the vertex that are not the volume's end."""
    near = df.select("mip", "cx", "cy", "cz", *[f"edge_{c}1" for c in "xyz"], F.explode(_steps((0, 1))).alias("d"))
    for c in "xyz":
        near = near.where((F.col(f"d.d{c}") == 0) | (F.col(f"edge_{c}1") == 0))
    return near.select("mip", "cx", "cy", "cz", *[(F.col(f"c{c}") + F.col(f"d.d{c}")).alias(f"n{c}") for c in "xyz"])


def face_keys(df: DataFrame) -> DataFrame:
    """``face`` 0..5 (low x, y, z, then high) of each chunk; ``open`` unless the volume ends there, and whether the
    parent no longer has the face (``vanishes``), because it lies between two of its children."""
    faces = F.explode(F.array(*[F.struct(F.lit(k).alias("face"), F.col(f"edge_{'xyz'[k % 3]}{k // 3}").alias("edge"), F.col(f"c{'xyz'[k % 3]}").alias("c")) for k in range(6)])).alias("f")
    rows = df.select("mip", "cx", "cy", "cz", faces)
    inner = F.when(F.col("f.face") < 3, F.col("f.c") % 2 == 1).otherwise(F.col("f.c") % 2 == 0)
    return rows.select("mip", "cx", "cy", "cz", F.col("f.face").alias("face"), (F.col("f.edge") == 0).alias("open"), (inner & (F.col("f.edge") == 0)).alias("vanishes"))


def descendants(df: DataFrame, grid: DataFrame, target: int | None = None) -> DataFrame:
    """``mip, cx, cy, cz`` with every chunk below, ``dmip, dx, dy, dz``, of all mips or of ``target``."""
    below = ancestors(grid, int(grid.agg(F.max("mip")).first()[0] or 0)).where("amip > mip")
    below = below.select(F.col("amip").alias("mip"), F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.col("az").alias("cz"), F.col("mip").alias("dmip"), F.col("cx").alias("dx"), F.col("cy").alias("dy"), F.col("cz").alias("dz"))
    if target is not None:
        below = below.where(F.col("dmip") == target)
    return df.select("mip", "cx", "cy", "cz").join(below, ["mip", "cx", "cy", "cz"])


def branch(df: DataFrame, grid: DataFrame, top: int) -> DataFrame:
    """``mip, cx, cy, cz`` with its whole branch, ``bmip, bx, by, bz``: ancestors, the chunk itself, descendants."""
    up = ancestors(df, top).select("mip", "cx", "cy", "cz", F.col("amip").alias("bmip"), F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("az").alias("bz"))
    down = descendants(df, grid).select("mip", "cx", "cy", "cz", F.col("dmip").alias("bmip"), F.col("dx").alias("bx"), F.col("dy").alias("by"), F.col("dz").alias("bz"))
    return up.unionByName(down)


def files_of(df: DataFrame, prefix: str, suffix: str = ".data") -> DataFrame:
    """``file``: the name of each chunk's file, ``prefix_mip_x_y_z`` and the suffix."""
    parts = [F.col(c) for c in ("mip", "cx", "cy", "cz")]
    return df.select("mip", "cx", "cy", "cz", F.concat(F.lit(f"{prefix}_"), tag(*parts), F.lit(suffix)).alias("file"))


def face_cells(spark: SparkSession) -> DataFrame:
    """``face, kind, dx, dy, dz`` for each face 0..5: ``sub``, the four children that lie at the face by their place in
    the parent, and ``super``, the nine chunks beyond it by their distance."""
    def cells(kind: str, low: int, high: int, values: tuple[int, ...]) -> DataFrame:
        free = F.array(*[F.lit(v) for v in values])
        rows = spark.range(6).select(F.col("id").cast("int").alias("face"), F.lit(kind).alias("kind"))
        for i, c in enumerate("xyz"):
            fixed = F.array(F.when(F.col("face") < 3, low).otherwise(high))
            rows = rows.withColumn(f"d{c}", F.explode(F.when(F.col("face") % 3 == i, fixed).otherwise(free)))
        return rows

    return cells("sub", 0, 1, (0, 1)).unionByName(cells("super", -1, 1, (-1, 0, 1)))


def vanished_faces(children: DataFrame) -> DataFrame:
    """``mip, cx, cy, cz, kx, ky, kz, face``: faces of the children that the parent no longer has, as they lie between two
    of them; ``children`` as of :func:`children`. A child at the low side of its parent loses its high face."""
    rows = children
    faces = F.array(*[F.when(F.col(f"k{c}") % 2 == 0, F.lit(i + 3)).otherwise(F.lit(i)) for i, c in enumerate("xyz")])
    return rows.select("mip", "cx", "cy", "cz", "kx", "ky", "kz", F.explode(faces).alias("face"))


def lift(rows: DataFrame) -> DataFrame:
    """Rows of chunks (``mip, cx, cy, cz, ...``) as rows of their parents: what the files of the children hold together."""
    half = {f"c{c}": F.floor(F.col(f"c{c}") / 2).cast("int") for c in "xyz"}
    return rows.select(*[half[c].alias(c) if c in half else (F.col(c) + 1).alias(c) if c == "mip" else F.col(c) for c in rows.columns])


def gather(rows: DataFrame, near: DataFrame) -> DataFrame:
    """For each chunk of ``near`` (``mip, cx, cy, cz, nx, ny, nz``, as of :func:`siblings` or :func:`neighbours`) the rows
    (``mip, cx, cy, cz, ...``) of the chunks named beside it."""
    here = rows.select("mip", *[F.col(f"c{c}").alias(f"n{c}") for c in "xyz"], *[c for c in rows.columns if c not in ("mip", "cx", "cy", "cz")])
    return near.select("mip", "cx", "cy", "cz", "nx", "ny", "nz").join(here, ["mip", "nx", "ny", "nz"])


def gather_slices(slices: DataFrame, chunks: DataFrame, top: int) -> DataFrame:
    """For each chunk what its ancestors, itself included, hold for it: ``mip, cx, cy, cz, old, new``.

    ``slices``: ``mip, cx, cy, cz, old, new`` of the levels at which a remap was settled; a row is for the chunk that
    handed out its old id. Where ids are too short to tell the chunks apart (see :func:`packed`), the slices name that
    chunk themselves, by ``ox, oy, oz``; ``chunks`` need no ``ac`` then.
    """
    place = [F.col("mip").alias("amip"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("cz").alias("az")]
    if "ox" in slices.columns:
        held = slices.select(*place, F.col("ox").alias("cx"), F.col("oy").alias("cy"), F.col("oz").alias("cz"), "old", "new")
        return ancestors(chunks, top).join(held, ["amip", "ax", "ay", "az", "cx", "cy", "cz"]).select("mip", "cx", "cy", "cz", "old", "new")
    up = ancestors(chunks, top).join(chunks.select("mip", "cx", "cy", "cz", "ac"), ["mip", "cx", "cy", "cz"])
    held = slices.select(*place, owner(F.col("old")).alias("ac"), "old", "new")
    return up.join(held, ["amip", "ax", "ay", "az", "ac"]).select("mip", "cx", "cy", "cz", "old", "new")
