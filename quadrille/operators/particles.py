"""Cells as rows: values, numbering, coordinates, tree set, aggregates over the tree, look-ups and neighbours.

A structure is a DataFrame level, z, x, y; properties are further columns.
Containment is always an equi-join: the point's ancestors at every level are
exploded (a few rows each) and joined on the key, never a range condition.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.keys import CELL, KEY, clamp_steps, clamp_weight_by_level, extent, inside, level_size, noise
from quadrille.operators import blocks, dense
from quadrille.plans.meta import AXES, GridMeta

#: Faces in the order +y, -y, +x, -x, +z, -z.
FACES = {"+y": ("y", 1), "-y": ("y", -1), "+x": ("x", 1), "-x": ("x", -1), "+z": ("z", 1), "-z": ("z", -1)}


# --- values ---------------------------------------------------------------


def sample(leaves: DataFrame, grid: DataFrame, meta: GridMeta, how: str = "mean", edge: int | None = None) -> DataFrame:
    """leaves with v: the pyramid of the grid at each leaf, made in tiles of an edge that is a power of two."""
    return leaves.join(blocks.pyramid(grid, meta, how, edge=edge), CELL)


def sample_labels(leaves: DataFrame, labels: DataFrame, meta: GridMeta, boundaries: bool = True, dilation: int = 0, retain: bool = False) -> DataFrame:
    """Labels by maximum; with boundaries, cells of the dilated label boundary are 0, or 2 beside 1 inside where labels are not retained."""
    out = sample(leaves, labels, meta, "max")
    if not boundaries:
        return out
    edge = sample(leaves, dense.dilate(dense.boundary(labels), dilation), meta, "max").withColumnRenamed("v", "b")
    both = out.join(edge, CELL)
    if retain:
        return both.select(*CELL, F.when(F.col("b") != 0, 0).otherwise(F.col("v")).cast("long").alias("v"))
    return both.select(*CELL, F.when(F.col("b") != 0, 2).when(F.col("v") != 0, 1).otherwise(0).cast("long").alias("v"))


def with_levels(cells: DataFrame) -> DataFrame:
    return cells.withColumn("v", F.col("level"))


def map_cells(cells: DataFrame, f: Callable[[Column], Column], level: int = 0, column: str = "v") -> DataFrame:
    """f over a property, of one level or (0) of all."""
    new = f(F.col(column))
    return cells.withColumn(column, new if not level else F.when(F.col("level") == level, new).otherwise(F.col(column)))


def zip_cells(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column], level: int = 0) -> DataFrame:
    """f over the values of two tables of the same structure."""
    both = a.join(b.select(*CELL, F.col("v").alias("__w")), CELL)
    new = f(F.col("v"), F.col("__w"))
    return both.withColumn("v", new if not level else F.when(F.col("level") == level, new).otherwise(F.col("v"))).drop("__w")


def rows_as_arrays(cells: DataFrame) -> DataFrame:
    """Nested layout: level, z, x, the row's y and values in order of y."""
    packed = F.array_sort(F.collect_list(F.struct("y", "v")))
    return cells.groupBy("level", "z", "x").agg(packed.alias("row")).select("level", "z", "x", F.col("row.y").alias("y"), F.col("row.v").alias("v"))


# --- numbering and coordinates --------------------------------------------


def numbered(cells: DataFrame, name: str = "pid") -> DataFrame:
    """A number from 0 in the order level, z, x, y.  Counts of (level, z) slices are summed up; rows are ranked inside a slice."""
    slices = cells.groupBy("level", "z").agg(F.count("*").alias("n"))
    base = slices.select("level", "z", F.coalesce(F.sum("n").over(Window.orderBy("level", "z").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("level", "z").orderBy("x", "y")) - 1
    return cells.join(base, ["level", "z"]).withColumn(name, (F.col("base") + rank).cast("long")).drop("base")


def row_scan(cells: DataFrame, level: int, z: int, x: int) -> DataFrame:
    return cells.where((F.col("level") == level) & (F.col("z") == z) & (F.col("x") == x))


def level_ranges(cells: DataFrame) -> DataFrame:
    """level, number of cells, first number and one past the last."""
    n = cells.groupBy("level").agg(F.count("*").alias("n"))
    w = Window.orderBy("level")
    return n.select("level", "n", (F.sum("n").over(w) - F.col("n")).alias("begin"), F.sum("n").over(w).alias("end"))


def linear_access(cells: DataFrame) -> DataFrame:
    """Compressed rows: level, z, x, sorted y, and the number of cells up to the row's end."""
    rows = cells.groupBy("level", "z", "x").agg(F.sort_array(F.collect_list("y")).alias("y"))
    slices = rows.groupBy("level", "z").agg(F.sum(F.size("y")).alias("n"))
    base = slices.select("level", "z", F.coalesce(F.sum("n").over(Window.orderBy("level", "z").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    end = F.sum(F.size("y")).over(Window.partitionBy("level", "z").orderBy("x"))
    return rows.join(base, ["level", "z"]).select("level", "z", "x", "y", (F.col("base") + end).cast("long").alias("row_end"))


def random_access(cells: DataFrame) -> DataFrame:
    """Runs of consecutive y: level, z, x, y_begin, y_end."""
    w = Window.partitionBy("level", "z", "x").orderBy("y")
    island = F.col("y") - F.row_number().over(w)
    return cells.withColumn("__i", island).groupBy("level", "z", "x", "__i").agg(F.min("y").alias("y_begin"), F.max("y").alias("y_end")).drop("__i")


def from_runs(runs: DataFrame) -> DataFrame:
    return runs.select("level", "z", "x", F.explode(F.sequence("y_begin", "y_end")).alias("y"))


def coordinates(cells: DataFrame, meta: GridMeta) -> DataFrame:
    """Centres and nearest pixels of the cells, and their size."""
    s = level_size(meta)
    out = cells.withColumn("size", s)
    for a in AXES:
        centre = (F.col(a) + 0.5) * s
        out = out.withColumn(f"{a}_global", centre).withColumn(f"{a}_pixel", F.floor(centre).cast("int"))
    return out


def computational_ratio(cells: DataFrame, meta: GridMeta) -> DataFrame:
    return cells.agg((F.lit(float(meta.pixels)) / F.count("*")).alias("ratio"))


# --- tree ------------------------------------------------------------------


def ancestors(cells: DataFrame, columns: list[str] = ()) -> DataFrame:
    """Every proper ancestor of every cell, level 0 on, with chosen columns of the cell."""
    d = F.explode(F.sequence(F.lit(1), F.col("level"))).alias("d")
    up = cells.where("level > 0").select(*CELL, *columns, d)
    return up.select((F.col("level") - F.col("d")).alias("level"), *[F.call_function("shiftright", F.col(a), F.col("d")).alias(a) for a in KEY], *columns, "d")


def tree(cells: DataFrame) -> DataFrame:
    """The interior cells: distinct ancestors."""
    return ancestors(cells).select(*CELL).distinct()


def fold_tree(cells: DataFrame, how: str | Callable[[str], Column]) -> DataFrame:
    """tree with v folded over all leaves below: one aggregation.  how: max, min, sum, or any aggregate whose order does not matter."""
    f = how if callable(how) else {"max": F.max, "min": F.min, "sum": F.sum}[how]
    return ancestors(cells, ["v"]).groupBy(*CELL).agg(f("v").alias("v"))


def sampled(cells: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """About this share of the cells, without replacement: chosen by key and seed, so the same on every run and partitioning."""
    return cells.where(F.expr(noise(seed)) < fraction)


def tree_mean(cells: DataFrame, meta: GridMeta, l_min: int = 0) -> DataFrame:
    """tree with v the mean of the children, each child weighing alike whatever lies below it.

    The weights of the steps multiply along the path, so a leaf enters each
    ancestor once with the product and one aggregation gives every level."""
    up = cells.select(*CELL, F.col("v").cast("double").alias("v"), F.explode(F.sequence(F.lit(1), F.col("level"))).alias("d"))
    weight = F.expr(f"pow(2D, {clamp_steps(meta, 'level')} - 3 * d)")
    up = up.select((F.col("level") - F.col("d")).alias("level"), *[F.call_function("shiftright", F.col(a), F.col("d")).alias(a) for a in KEY], (F.col("v") * weight).alias("v"))
    return up.where(F.col("level") >= l_min).groupBy(*CELL).agg(F.sum("v").alias("v"))


def tree_mean_stepwise(cells: DataFrame, meta: GridMeta) -> DataFrame:
    """tree_mean one level at a time, as its check."""
    out, below = [], None
    for level in range(meta.l_max, 0, -1):
        here = cells.where(F.col("level") == level).select(*CELL, F.col("v").cast("double").alias("v"))
        if below is not None:
            here = here.unionByName(below)
        below = here.withColumn("w", clamp_weight_by_level(meta)).groupBy(*[F.shiftright(a, 1).alias(a) for a in KEY]).agg((F.sum(F.col("v") * F.col("w")) / 8).alias("v")).select(F.lit(level - 1).alias("level"), *KEY, "v")
        out.append(below)
    return reduce(DataFrame.unionByName, out)


def push_down(tree_values: DataFrame, meta: GridMeta, num_levels: int) -> DataFrame:
    """The lowest num_levels levels of the tree take the value of their ancestor at the level above these."""
    start = max(0, meta.l_max - 1 - num_levels)
    d = F.greatest(F.col("level") - start, F.lit(0))
    mine = tree_values.select(*CELL, F.least(F.col("level"), F.lit(start)).alias("al"), *[F.call_function("shiftright", F.col(a), d).alias(f"a{a}") for a in KEY])
    above = tree_values.select(F.col("level").alias("al"), *[F.col(a).alias(f"a{a}") for a in KEY], "v")
    return mine.join(above, ["al", "az", "ax", "ay"]).select(*CELL, "v")


def push_to_leaves(leaves: DataFrame, tree_values: DataFrame) -> DataFrame:
    """Leaves with the value of their parent."""
    up = tree_values.select((F.col("level") + 1).alias("level"), *[F.col(a).alias(f"p{a}") for a in KEY], "v")
    mine = leaves.select(*CELL, *[F.shiftright(a, 1).alias(f"p{a}") for a in KEY])
    return mine.join(up, ["level", "pz", "px", "py"]).select(*CELL, "v")


# --- look-ups and neighbours ------------------------------------------------


def find_cells(wanted: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows of wanted (level, z, x, y) that are cells, with their columns."""
    return wanted.join(cells, CELL)


def locate(points: DataFrame, cells: DataFrame, meta: GridMeta) -> DataFrame:
    """points (id, pz, px, py in pixels, any number type) with the cell that holds each; points outside are left out."""
    fine = points.select("id", *[F.floor(f"p{a}").cast("int").alias(a) for a in KEY])
    fine = fine.where(reduce(lambda p, q: p & q, [(F.col(a) >= 0) & (F.col(a) < meta.size[a]) for a in KEY]))
    d = F.explode(F.sequence(F.lit(0), F.lit(meta.l_max - meta.l_min)))
    cand = fine.withColumn("d", d).select("id", (F.lit(meta.l_max) - F.col("d")).alias("level"), *[F.call_function("shiftright", F.col(a), F.col("d")).alias(a) for a in KEY])
    return cand.join(cells, CELL)


def faces(cells: DataFrame, meta: GridMeta, directions: list[str] | None = None) -> DataFrame:
    """One row for each cell, face and candidate key (nz, nx, ny at the cell's level) inside the grid."""
    offs = F.array(*[F.struct(F.lit(f).alias("face"), *[F.lit(s if a == b else 0).alias(f"o{b}") for b in KEY]) for f, (a, s) in FACES.items() if directions is None or f in directions])
    out = cells.withColumn("o", F.explode(offs)).select(*cells.columns, F.col("o.face").alias("face"), *[(F.col(a) + F.col(f"o.o{a}")).alias(f"n{a}") for a in KEY])
    return out.where(reduce(lambda p, q: p & q, [(F.col(f"n{a}") >= 0) & (F.col(f"n{a}") < extent(meta, a)) for a in KEY]))


def neighbours(cells: DataFrame, meta: GridMeta, directions: list[str] | None = None) -> DataFrame:
    """level, z, x, y, face and the key nl, nz, nx, ny of every neighbour: same level, parent, or up to four children.

    All three kinds are candidates of one equi-join; a leaf set is 2:1
    balanced and covers each place once, so no candidate hides another."""
    f = faces(cells.select(*CELL), meta, directions)
    same = f.select(*CELL, "face", F.col("level").alias("nl"), "nz", "nx", "ny")
    parent = f.select(*CELL, "face", (F.col("level") - 1).alias("nl"), *[F.shiftright(f"n{a}", 1).alias(f"n{a}") for a in KEY])
    kids = f.where(F.col("level") < meta.l_max)
    for a in AXES:
        lo, hi = F.col(f"n{a}") * 2, F.col(f"n{a}") * 2 + 1
        facing = F.when(F.col("face") == f"+{a}", F.array(lo)).when(F.col("face") == f"-{a}", F.array(F.least(hi, extent(meta, a, F.col("level") + 1) - 1))).otherwise(F.array(lo, hi))
        kids = kids.withColumn(f"n{a}", F.explode(facing if meta.size[a] > 1 else F.array(F.lit(0))))
    kids = kids.select(*CELL, "face", (F.col("level") + 1).alias("nl"), "nz", "nx", "ny")
    cand = same.unionByName(parent).unionByName(kids)
    keys = cells.select(F.col("level").alias("nl"), *[F.col(a).alias(f"n{a}") for a in KEY])
    return cand.join(keys, ["nl", "nz", "nx", "ny"])


def same_level_neighbours(cells: DataFrame, meta: GridMeta) -> DataFrame:
    f = faces(cells.select(*CELL), meta)
    keys = cells.select("level", *[F.col(a).alias(f"n{a}") for a in KEY])
    return f.join(keys, ["level", "nz", "nx", "ny"]).select(*CELL, "face", "nz", "nx", "ny")


def neighbour_means(cells: DataFrame, meta: GridMeta, axis: str, same_level: bool = False) -> DataFrame:
    """cells with plus and minus: the mean value of the neighbours over each face of the axis, the cell's own where there are none."""
    dirs = [f"+{axis}", f"-{axis}"]
    near = same_level_neighbours(cells, meta).where(F.col("face").isin(dirs)).withColumn("nl", F.col("level")) if same_level else neighbours(cells, meta, dirs)
    values = cells.select(F.col("level").alias("nl"), *[F.col(a).alias(f"n{a}") for a in KEY], F.col("v").alias("nv"))
    got = near.join(values, ["nl", "nz", "nx", "ny"]).groupBy(*CELL).agg(F.avg(F.when(F.col("face") == dirs[0], F.col("nv"))).alias("p"), F.avg(F.when(F.col("face") == dirs[1], F.col("nv"))).alias("m"))
    return cells.select(*CELL, "v").join(got, CELL, "left").select(*CELL, "v", F.coalesce("p", "v").alias("plus"), F.coalesce("m", "v").alias("minus"))


def face_filter(cells: DataFrame, meta: GridMeta, taps: tuple[float, float, float], axis: str, same_level: bool = False) -> DataFrame:
    """taps[1] * own + taps[2] * mean over + + taps[0] * mean over -."""
    if meta.size[axis] == 1:
        return cells.select(*CELL, F.col("v").cast("double").alias("v")) if same_level else cells.select(*CELL, (F.col("v") * sum(taps)).alias("v"))
    m = neighbour_means(cells, meta, axis, same_level)
    return m.select(*CELL, (taps[1] * F.col("v") + taps[2] * F.col("plus") + taps[0] * F.col("minus")).alias("v"))


def separable_face_filter(cells: DataFrame, meta: GridMeta, taps: tuple[float, float, float], repeats: int = 1, same_level: bool = False, settle: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """face_filter over y, x, z, repeated.  A pass reads its input several times, so settle should write and cut each."""
    for _ in range(repeats):
        for axis in ("y", "x", "z"):
            if not same_level or meta.size[axis] > 1:
                cells = settle(face_filter(cells, meta, taps, axis, same_level))
    return cells


def tile(cells: DataFrame, meta: GridMeta, by: dict[str, int]) -> tuple[DataFrame, GridMeta]:
    """Copies of a structure side by side: power-of-two extents, equal on the tiled axes."""
    for a, k in by.items():
        if k > 1 and meta.size[a] != 1 << meta.l_max or k & (k - 1):
            raise ValueError("tiling needs axes of the full power-of-two length and power-of-two counts")
    size = {a: meta.size[a] * by.get(a, 1) for a in AXES}
    big = GridMeta(size["y"], size["x"], size["z"])
    out = cells.withColumn("level", F.col("level") + (big.l_max - meta.l_max))
    for a, k in by.items():
        if k > 1:
            per = F.call_function("shiftright", F.lit(meta.size[a]), F.lit(big.l_max) - F.col("level"))
            out = out.withColumn(a, F.explode(F.array(*[(F.col(a) + i * per).cast("int") for i in range(k)])))
    return out, big


def inside_grid(cells: DataFrame, meta: GridMeta) -> DataFrame:
    return cells.where(inside(meta))
