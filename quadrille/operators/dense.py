"""Operators on dense grids (z, x, y, v).

Separable windows run as one window per axis, partitioned by the lines of that
axis; a stencil runs on tiles with a halo.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.keys import KEY, clamp_steps, clamp_weight
from quadrille.operators import blocks
from quadrille.plans.meta import AXES, GridMeta

V = "v"


def lines(axis: str):
    return Window.partitionBy(*[a for a in AXES if a != axis]).orderBy(axis)


def downsample(grid: DataFrame, meta: GridMeta, how: str = "mean", finish: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Half the extents (rounded up).  how: mean, sum, max, min over the eight clamped children."""
    v = F.col(V)
    if how in ("mean", "sum"):
        v = F.sum(v * clamp_weight(meta.size))
        v = v / 8 if how == "mean" else v
    else:
        v = {"max": F.max, "min": F.min}[how](v)
    return grid.groupBy(*[F.shiftright(a, 1).alias(a) for a in KEY]).agg(finish(v).alias(V))


def pyramid(grid: DataFrame, meta: GridMeta, how: str = "mean", l_min: int = 1, l_max: int | None = None) -> DataFrame:
    """Levels l_max (the grid) to l_min in one table with a level column.

    Every pixel enters each of its ancestors once, with the product of the
    clamping weights of the steps: one scan and one aggregation for all levels."""
    top = l_max or meta.l_max
    up = grid.select(*KEY, V).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(top - l_min))))
    v, d = F.col(V), F.col("d")
    if how in ("mean", "sum"):
        times = F.expr(f"shiftleft(1L, {clamp_steps(meta, str(meta.l_max))})")
        up = up.withColumn(V, v * times)
    up = up.select((F.lit(top) - d).alias("level"), *[F.call_function("shiftright", F.col(a), d).alias(a) for a in KEY], V)
    agg = {"mean": F.sum(V), "sum": F.sum(V), "max": F.max(V), "min": F.min(V)}[how].alias(V)
    out = up.groupBy("level", *KEY).agg(agg)
    return out.withColumn(V, F.col(V) / F.pow(F.lit(8.0), F.lit(top) - F.col("level"))) if how == "mean" else out


def upsample(grid: DataFrame, fine: GridMeta) -> DataFrame:
    """Nearest doubling, clipped to the extents of the finer grid."""
    out = grid
    for a in AXES:
        if fine.size[a] > 1:
            out = out.withColumn(a, F.explode(F.array(F.col(a) * 2, F.col(a) * 2 + 1))).where(F.col(a) < fine.size[a])
    return out


def pad(grid: DataFrame, meta: GridMeta, by: dict[str, int]) -> tuple[DataFrame, GridMeta]:
    """Mirror padding without repeating the edge; at most n - 1 on an axis."""
    out, size = grid, dict(meta.size)
    for a, p in by.items():
        n = meta.size[a]
        p = min(p, n - 1)
        if p <= 0:
            continue
        c = F.col(a)
        copies = F.array(c + p, F.when((c >= 1) & (c <= p), p - c), F.when((c <= n - 2) & (c >= n - 1 - p), 2 * (n - 1) - c + p))
        out = out.withColumn(a, F.explode(copies)).where(F.col(a).isNotNull())
        size[a] = n + 2 * p
    return out, GridMeta(size["y"], size["x"], size["z"])


def crop(grid: DataFrame, begin: dict[str, int], end: dict[str, int]) -> DataFrame:
    """Cells of [begin, end) moved to the origin."""
    keep = reduce(lambda p, q: p & q, [(F.col(a) >= begin[a]) & (F.col(a) < end[a]) for a in begin])
    return grid.where(keep).select(*[(F.col(a) - begin[a]).alias(a) if a in begin else F.col(a) for a in KEY], V)


def unpad(grid: DataFrame, inner: GridMeta, by: dict[str, int]) -> DataFrame:
    begin = {a: min(p, inner.size[a] - 1) for a, p in by.items()}
    return crop(grid, begin, {a: begin[a] + inner.size[a] for a in begin})


def map_values(grid: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return grid.withColumn(V, f(F.col(V)))


def fill(grid: DataFrame, value) -> DataFrame:
    return grid.withColumn(V, F.lit(value).cast(grid.schema[V].dataType))


def normalise(grid: DataFrame) -> DataFrame:
    """Divide by the sum; integer grids and sums within 1e-6 of zero stay."""
    if grid.schema[V].dataType.simpleString() not in ("float", "double"):
        return grid
    total = grid.agg(F.sum(V).alias("__s"))
    return grid.join(F.broadcast(total), how="inner").withColumn(V, F.when(F.abs("__s") > 1e-6, F.col(V) / F.col("__s")).otherwise(F.col(V))).drop("__s")


def min_max(grid: DataFrame) -> DataFrame:
    return grid.agg(F.min(V).alias("lo"), F.max(V).alias("hi"))


def min_nz(a: Column, b: Column) -> Column:
    """The smaller; b where a is zero."""
    return F.when(a == 0, b).otherwise(F.least(a, b))


def box_mean(grid: DataFrame, axis: str, r: int) -> DataFrame:
    """Mean over [k - r, k + r] clipped to the line."""
    return grid.withColumn(V, F.avg(V).over(lines(axis).rangeBetween(-r, r)))


def window_mean(grid: DataFrame, radius: dict[str, int]) -> DataFrame:
    """Mean over a clipped box: sums and counts, one axis after another."""
    out = grid.withColumn("__n", F.lit(1).cast("long")).withColumn(V, F.col(V).cast("double"))
    for a, r in radius.items():
        if r:
            w = lines(a).rangeBetween(-r, r)
            out = out.select(*KEY, F.sum(V).over(w).alias(V), F.sum("__n").over(w).alias("__n"))
    return out.select(*KEY, (F.col(V) / F.col("__n")).alias(V))


def neighbour_max(grid: DataFrame, meta: GridMeta) -> DataFrame:
    """Largest value of the clipped neighbourhood of one cell on every axis."""
    for a in meta.active:
        grid = grid.withColumn(V, F.max(V).over(lines(a).rangeBetween(-1, 1)))
    return grid


def clamped_sums(grid: DataFrame, meta: GridMeta, columns: dict[str, Column]) -> DataFrame:
    """For each cell the sums of columns over its 27 neighbours with clamped indices."""
    out = grid.select(*KEY, V, *[c.alias(n) for n, c in columns.items()])
    for a in AXES:
        w = lines(a)
        sums = [(F.coalesce(F.lag(n).over(w), F.col(n)) + F.col(n) + F.coalesce(F.lead(n).over(w), F.col(n))).alias(n) for n in columns]
        out = out.select(*KEY, V, *sums)
    return out


def smooth(grid: DataFrame, meta: GridMeta) -> DataFrame:
    """Mean of 27 neighbours, indices clamped."""
    return clamped_sums(grid, meta, {"s": F.col(V)}).select(*KEY, (F.col("s") / 27).alias(V))


def smooth_positive(grid: DataFrame, meta: GridMeta) -> DataFrame:
    """Mean of the positive ones among 27 clamped neighbours, 0 without any."""
    pos = F.col(V) > 0
    s = clamped_sums(grid, meta, {"s": F.when(pos, F.col(V)).otherwise(0), "n": F.when(pos, 1).otherwise(0)})
    return s.select(*KEY, F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0).alias(V))


def erode(grid: DataFrame, meta: GridMeta) -> DataFrame:
    """Zero the positive cells outside the core that touch it; the core has 27 positive neighbours."""
    core = clamped_sums(grid, meta, {"n": F.when(F.col(V) > 0, 1).otherwise(0)}).select(*KEY, V, (F.col("n") == 27).cast("int").alias("core"))
    touch = core
    for a in AXES:
        w = lines(a)
        c = "t" if "t" in touch.columns else "core"
        touch = touch.withColumn("t", F.coalesce(F.lag(c).over(w), F.col(c)) + F.col(c) + F.coalesce(F.lead(c).over(w), F.col(c)))
    return touch.select(*KEY, F.when((F.col(V) > 0) & (F.col("core") == 0) & (F.col("t") > 0), F.lit(0).cast(grid.schema[V].dataType)).otherwise(F.col(V)).alias(V))


def fill_holes_by_lines(grid: DataFrame, seed: float = 1000.0) -> DataFrame:
    """Zero cells take the mean of `seed` and the nearest positive values before and after on each axis."""
    pos = F.when(F.col(V) > 0, F.col(V).cast("double"))
    found = []
    for a in AXES:
        w = lines(a)
        found += [F.last(pos, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first(pos, True).over(w.rowsBetween(1, Window.unboundedFollowing))]
    total = reduce(lambda p, q: p + q, [F.coalesce(f, F.lit(0.0)) for f in found], F.lit(float(seed)))
    n = reduce(lambda p, q: p + q, [F.when(f.isNotNull(), 1).otherwise(0) for f in found], F.lit(1))
    return grid.select(*KEY, F.when(F.col(V) > 0, F.col(V).cast("double")).otherwise(total / n).alias(V))


def fill_holes_by_tree(grid: DataFrame, meta: GridMeta, l_min: int = 1) -> DataFrame:
    """Max-pyramid of smoothed levels up, mean into empty roots, then down into zero cells with smoothing."""
    top = meta.l_max
    sizes = {l: meta.at(l) for l in range(l_min - 1 if l_min > 0 else 0, top + 1)}
    at = {top: map_values(grid, lambda c: c.cast("double"))}
    for l in range(top, l_min - 1, -1):
        at[l] = smooth_positive(at[l], sizes[l])
        at[l - 1] = downsample(at[l], sizes[l], "max")
    root = at[l_min - 1]
    mean = root.where(F.col(V) > 0).agg(F.avg(V).alias("m"))
    at[l_min - 1] = root.join(F.broadcast(mean), how="inner").select(*KEY, F.when(F.col(V) == 0, F.col("m")).otherwise(F.col(V)).alias(V))
    for l in range(l_min, top + 1):
        above = upsample(at[l - 1], sizes[l]).withColumnRenamed(V, "u")
        filled = at[l].join(above, KEY).select(*KEY, F.when(F.col(V) == 0, F.col("u")).otherwise(F.col(V)).alias(V))
        at[l] = smooth_positive(filled, sizes[l])
    return at[top]


def gradient(grid: DataFrame, delta: dict[str, float] | None = None) -> DataFrame:
    """dz, dx, dy: mean of the one-sided differences that exist; null on a line of one cell."""
    out = []
    for a in AXES:
        w, d = lines(a), (delta or {}).get(a, 1.0)
        before, after = (F.col(V) - F.lag(V).over(w)) / d, (F.lead(V).over(w) - F.col(V)) / d
        out.append(F.coalesce((before + after) / 2, before, after).alias(f"d{a}"))
    return grid.select(*KEY, *out)


def _faces() -> list[Column]:
    """Values of the six neighbours in the order -y, +y, -x, +x, -z, +z."""
    return [f(V).over(lines(a)) for a in ("y", "x", "z") for f in (F.lag, F.lead)]


def boundary(grid: DataFrame) -> DataFrame:
    """A label where some face neighbour has another, else 0."""
    differs = reduce(lambda p, q: p | q, [F.coalesce(n != F.col(V), F.lit(False)) for n in _faces()])
    return grid.select(*KEY, F.when(differs, F.col(V)).otherwise(F.lit(0).cast(grid.schema[V].dataType)).alias(V))


def dilate(grid: DataFrame, times: int = 1) -> DataFrame:
    """Zero cells take the first non-zero face neighbour."""
    for _ in range(times):
        zero = F.lit(0).cast(grid.schema[V].dataType)
        grid = grid.select(*KEY, F.when(F.col(V) != 0, F.col(V)).otherwise(F.coalesce(*[F.nullif(n, zero) for n in _faces()], zero)).alias(V))
    return grid


def convolve(grid: DataFrame, meta: GridMeta, stencil: list[tuple[int, int, int, float]], reflect: bool = False) -> DataFrame:
    """Sum of w * v(c + o) over the stencil rows (oz, ox, oy, w); zeros outside, or mirrored once at the edge.  Nulls add nothing."""
    reach = {a: max(abs(r[i]) for r in stencil) for i, a in enumerate(KEY)}

    def work(v: np.ndarray, lo: dict[str, int], start: dict[str, int], stop: dict[str, int]) -> pd.DataFrame:
        at, there = [], np.ones((1, 1, 1), bool)
        for i, a in enumerate(KEY):
            n, c = meta.size[a], np.arange(start[a] - reach[a], stop[a] + reach[a])
            c = np.where(c < 0, -c, np.where(c > n - 1, 2 * (n - 1) - c, c)) if reflect else c
            there = there & ((c >= 0) & (c < n)).reshape([-1 if j == i else 1 for j in range(3)])
            at.append(np.clip(c - lo[a], 0, v.shape[i] - 1))
        wide = np.where(there, np.nan_to_num(v[np.ix_(*at)].astype(float)), 0.0)
        shape = [stop[a] - start[a] for a in KEY]
        out = np.zeros(shape)
        for *o, w in stencil:
            out += w * wide[tuple(slice(reach[a] + d, reach[a] + d + m) for a, d, m in zip(KEY, o, shape))]
        return blocks.rows_of_array({V: out}, start)

    return blocks.tiles(grid, meta, reach, work, "z int, x int, y int, v double")


def richardson_lucy(grid: DataFrame, meta: GridMeta, psf: list[tuple[int, int, int, float]], iterations: int, settle: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Iterative deconvolution of a dense grid from ones, zeros outside; a blur of zero gives null."""
    flipped = [(-z, -x, -y, w) for z, x, y, w in psf]
    est = grid.select(*KEY, F.lit(1.0).alias(V))
    for _ in range(iterations):
        blur = convolve(est, meta, flipped).withColumnRenamed(V, "b")
        ratio = grid.join(blur, KEY).select(*KEY, F.try_divide(F.col(V).cast("double"), F.col("b")).alias(V))
        step = convolve(ratio, meta, psf).withColumnRenamed(V, "e")
        est = settle(est.join(step, KEY).select(*KEY, (F.col(V) * F.col("e")).alias(V)))
    return est
