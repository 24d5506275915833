"""From a dense grid to adaptive cells.

The cells are solved at half resolution.  V_l is the required level, clipped
and max-downsampled; N_l its maximum over the direct neighbourhood.  A cell is
typed where N_l <= l, and is part of the solution where its parent is not
typed, so the whole scheme is one pass over blocks with a halo of one cell and
one anti-join, all levels in one plan and no mutable state.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.keys import CELL, KEY, inside
from quadrille.operators import blocks, dense
from quadrille.plans.grids import densify
from quadrille.plans.meta import AXES, GridMeta

SEED, BOUNDARY, FILLER = 1, 2, 3
Settle = Callable[[DataFrame], DataFrame]

# Window radii by blur width over pixel width, and the scale factors for 1, 2 and 3 active axes.
RADIUS_1 = (1, 1, 1, 2, 2, 3)
RADIUS_2 = (2, 3, 4, 4, 5, 6)
RESCALE = {
    3: (12.8214, 26.1256, 40.2795, 23.3692, 36.2061, 27.0385),
    2: (13.2421, 28.7069, 52.0385, 24.4272, 34.9565, 21.1891),
    1: (13.9040, 31.2843, 57.4037, 30.3767, 45.9930, 29.0890),
}
NO_SIGNAL = 60000.0


@dataclass(frozen=True)
class Parameters:
    rel_error: float = 0.1
    grad_th: float = 0.0
    sigma_th: float = 0.0
    sigma_th_max: float = 0.0
    intensity_th: float = 0.0
    smoothing: float = 0.0
    dx: float = 1.0
    dy: float = 1.0
    dz: float = 1.0
    psf: float = 1.0
    constant_scale: bool = False
    reflect: bool = False
    neighbourhood: bool = True
    auto: bool = False


def check(meta: GridMeta, grid: DataFrame) -> int:
    """Cells of a grid that is dense: each key once, as many as its extents say; others raise.  Tiles make the same check by themselves."""
    r = grid.agg(F.count("*").alias("n"), *[F.min(a).alias(f"lo{a}") for a in AXES], *[F.max(a).alias(f"hi{a}") for a in AXES]).first()
    if r["n"] != meta.pixels or any(r[f"lo{a}"] != 0 or r[f"hi{a}"] != meta.size[a] - 1 for a in AXES):
        raise ValueError(f"the grid has {r['n']} of {meta.pixels} cells, or others")
    return r["n"]


def spline_offset(grid: DataFrame, smoothing: float) -> float:
    """Centre of an integer grid's values, within 100 of zero; 0 without smoothing."""
    if smoothing <= 0:
        return 0.0
    r = grid.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    return float(min(max(-(r["lo"] + r["hi"]) / 2, -100), 100))


def spline_coefficients(smoothing: float, tolerance: float = 1e-4) -> tuple[float, float, float, int]:
    """Of the recursive smoothing spline: two feedback terms, the gain, and the length of its impulse response."""
    xi = 1 - 96 * smoothing + 24 * smoothing * math.sqrt(3 + 144 * smoothing)
    rho = (24 * smoothing - 1 - math.sqrt(xi)) / (24 * smoothing) * math.sqrt((48 * smoothing + 24 * smoothing * math.sqrt(3 + 144 * smoothing)) / xi)
    omega = math.atan(math.sqrt((144 * smoothing - 1) / xi))
    b1, b2 = 2 * rho * math.cos(omega), -rho * rho
    gain = (1 - 2 * rho * math.cos(omega) + rho * rho) ** 2 if smoothing else 1.0
    size = max(4, math.ceil(abs(math.log(tolerance) / math.log(rho)))) if 0 < rho < 1 else 4
    return b1, b2, math.sqrt(gain), size


def smooth_spline(grid: DataFrame, meta: GridMeta, smoothing: float, tolerance: float = 1e-4, integer: bool = False, span: int | None = None) -> DataFrame:
    """Causal and anticausal second-order recursion along each line, mirrored ends.

    A recursion along a line has no SQL form: runs of many lines are arrays,
    stepped through together.  A long line is cut into runs with a halo four
    times the impulse response, beyond which a start is forgotten to within
    tolerance ** 4.  Axes of two or fewer cells stay.  With integer, values are
    rounded after each axis and an overflow of 16 bits raises."""
    if smoothing <= 0:
        return grid
    b1, b2, gain, size = spline_coefficients(smoothing, tolerance)
    h = np.zeros(size)
    for k in range(size):
        h[k] = gain * (k == 0) + (b1 * h[k - 1] if k > 0 else 0) + (b2 * h[k - 2] if k > 1 else 0)
    out = grid.select(*KEY, F.col("v").cast("double").alias("v"))
    for axis in ("y", "x", "z"):
        if meta.size[axis] > 2:
            out = blocks.lines(out, meta, axis, 4 * size, ["v"], _recursion(meta.size[axis], h, gain, b1, b2, integer), "z int, x int, y int, v double", span)
    return out


def _recursion(n: int, h: np.ndarray, gain: float, b1: float, b2: float, integer: bool) -> Callable[[dict, int], dict]:
    turn, at = max(1, 2 * (n - 1)), np.arange(len(h))
    mirror = lambda i: np.abs((i + n - 1) % turn - (n - 1))

    def starts(v: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = v.shape[1]
        return v[:, np.clip(first, 0, m - 1)] @ h, v[:, np.clip(second, 0, m - 1)] @ h

    def run(x: dict[str, np.ndarray], lo: int) -> dict[str, np.ndarray]:
        v = x["v"]
        m = v.shape[1]
        f, g = np.empty_like(v), np.empty_like(v)
        f[:, 0], f[:, 1] = starts(v, mirror(at) - lo, mirror(1 - at) - lo)
        for k in range(2, m):
            f[:, k] = gain * v[:, k] + b1 * f[:, k - 1] + b2 * f[:, k - 2]
        end = lo + m
        g[:, -1], g[:, -2] = starts(f, mirror(end - 1 + at) - lo, mirror(end - 2 + at) - lo)
        for k in range(m - 3, -1, -1):
            g[:, k] = gain * f[:, k] + b1 * g[:, k + 1] + b2 * g[:, k + 2]
        if integer:
            g = np.round(g)
            if g.max(initial=0) > 65535 or g.min(initial=0) < -32768:
                raise OverflowError("smoothed values leave the range of the grid's type")
        return {"v": g}

    return run


def inverse_spline(grid: DataFrame, meta: GridMeta) -> DataFrame:
    """[1, 4, 1] / 6 along each axis of more than two cells, mirrored ends."""
    for a in ("y", "x", "z"):
        if meta.size[a] > 2:
            w = dense.lines(a)
            before, after = F.lag("v").over(w), F.lead("v").over(w)
            grid = grid.select(*KEY, ((F.coalesce(before, after) + 4 * F.col("v") + F.coalesce(after, before)) / 6).alias("v"))
    return grid


def _magnitude(h: dict[str, float] | None) -> Column:
    squares = []
    for a in AXES:
        w, d = dense.lines(a), (h or {}).get(a, 1.0)
        diff = (F.coalesce(F.lead("v").over(w), F.col("v")) - F.coalesce(F.lag("v").over(w), F.col("v"))) / (2 * d)
        squares.append(diff * diff)
    return F.sqrt(reduce(lambda p, q: p + q, squares))


def gradient_magnitude_half(grid: DataFrame, meta: GridMeta, h: dict[str, float] | None = None) -> DataFrame:
    """Central differences with repeated borders, their magnitude, and its maximum over 2x2x2 cells."""
    return dense.downsample(grid.select(*KEY, _magnitude(h).alias("v")), meta, "max")


def windows(meta: GridMeta, psf_over_pixel: float) -> tuple[dict[str, int], dict[str, int], float]:
    """Radii of both means on the active axes, and the scale factor."""
    i = min(max(round(psf_over_pixel) - 1, 0), 5)
    most = max(RADIUS_1[i], RADIUS_2[i])
    active = [a for a in AXES if meta.size[a] > most]
    return dict.fromkeys(active, RADIUS_1[i]), dict.fromkeys(active, RADIUS_2[i]), RESCALE[max(1, len(active))][i]


def local_scale(half: DataFrame, meta: GridMeta, p: Parameters = Parameters()) -> DataFrame:
    """Mean, absolute difference from the input, mean, factor; or mean minus minimum everywhere."""
    first, second, factor = windows(meta, p.psf / p.dx)
    if p.constant_scale or not first:
        level = half.agg((F.avg("v") - F.min("v")).alias("s"))
        return half.join(F.broadcast(level), how="inner").select(*KEY, F.col("s").alias("v"))
    by = {a: max(first[a], second[a]) for a in first}
    grid, size = dense.pad(half, meta, by) if p.reflect else (half, meta)
    smooth = grid.withColumn("i", F.col("v"))
    for a in ("y", "x", "z"):
        if a in first:
            smooth = dense.box_mean(smooth, a, first[a])
    smooth = smooth.select(*KEY, F.abs(F.col("v") - F.col("i")).alias("v"))
    for a in ("y", "x", "z"):
        if a in second:
            smooth = dense.box_mean(smooth, a, second[a])
    smooth = smooth.withColumn("v", F.col("v") * factor)
    return dense.unpad(smooth, meta, by) if p.reflect else smooth


def mask_gradient(grad: DataFrame, mask: DataFrame, meta: GridMeta) -> DataFrame:
    """Zero where the mask, max-downsampled from full resolution, is zero."""
    m = dense.downsample(mask, meta, "max").withColumnRenamed("v", "m")
    return grad.join(m, KEY).select(*KEY, F.when(F.col("m") == 0, 0.0).otherwise(F.col("v")).alias("v"))


def threshold_gradient(grad: DataFrame, intensity: DataFrame, threshold: float) -> DataFrame:
    """Zero where the intensity is at most the threshold."""
    i = intensity.withColumnRenamed("v", "i")
    return grad.join(i, KEY).select(*KEY, F.when(F.col("i") <= threshold, 0.0).otherwise(F.col("v")).alias("v"))


def apply_parameters(fields: DataFrame, p: Parameters) -> DataFrame:
    """fields: key, grad, scale.  Low scales are floored or marked as without signal, low gradients go."""
    scale = F.when(F.col("scale") < p.sigma_th, F.when(F.col("scale") < p.sigma_th_max, NO_SIGNAL).otherwise(p.sigma_th)).otherwise(F.col("scale"))
    grad = F.when(F.col("grad") < p.grad_th, 0.0).otherwise(F.col("grad"))
    return fields.select(*KEY, grad.alias("grad"), scale.alias("scale"))


#: Bins of the histogram that a threshold is found on; integer grids of a smaller range have a bin for each value.
BINS = 65536


def threshold_li(grid: DataFrame, column: str = "v", integer: bool = False, tolerance: float | None = None, rounds: int = 200) -> float:
    """Minimum cross entropy threshold.

    Two passes over the data: the range, and a histogram of equal bins with
    the sum of each, which bounds what reaches the driver; the iteration runs
    on the bins.  Raises where it doesn't settle within the rounds."""
    r = grid.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).first()
    if r["lo"] is None or r["lo"] == r["hi"]:
        return float(r["lo"] or 0.0)
    width = 1.0 if integer and r["hi"] - r["lo"] < BINS else (r["hi"] - r["lo"]) / BINS
    above = F.col(column) - F.lit(r["lo"])
    rows = grid.groupBy(F.least(F.floor(above / width), F.lit(BINS - 1)).alias("b")).agg(F.count("*").alias("n"), F.sum(above).alias("s")).toPandas().sort_values("b")
    b, n, s = rows["b"].to_numpy(), rows["n"].to_numpy(float), rows["s"].to_numpy(float)
    tol = tolerance or (0.5 if integer else min(0.01, (r["hi"] - r["lo"]) * 1e-4))
    t = s.sum() / n.sum()
    for _ in range(rounds):
        fore = b > math.floor(t / width)
        if fore.all() or not fore.any() or s[~fore].sum() <= 0:
            return float(t + r["lo"])
        f, back = s[fore].sum() / n[fore].sum(), s[~fore].sum() / n[~fore].sum()
        new = (f - back) / (math.log(f) - math.log(back))
        if abs(new - t) <= tol:
            return float(new + r["lo"])
        t = new
    raise RuntimeError(f"the threshold did not settle within {rounds} rounds")


def auto_parameters(fields: DataFrame, intensity: DataFrame, p: Parameters) -> Parameters:
    """Thresholds of gradient and scale from the foreground (intensity above its threshold)."""
    fore = fields.join(intensity.withColumnRenamed("v", "i"), KEY).where(F.col("i") > p.intensity_th)
    return Parameters(**{**p.__dict__, "grad_th": threshold_li(fore, "grad"), "sigma_th": threshold_li(fore, "scale"), "auto": False})


def levels(fields: DataFrame, meta: GridMeta, p: Parameters) -> DataFrame:
    """Required level floor(log2(grad / scale * finest size / rel_error)), 0 below one; exact by bit length."""
    c = float(2**meta.l_max) * min(p.dx, p.dy, p.dz) / p.rel_error
    e = F.when(F.col("scale") > 0, F.col("grad") / F.col("scale") * c).otherwise(F.when(F.col("grad") > 0, F.lit(2.0**32 - 1)).otherwise(0.0))
    return fields.select(*KEY, (F.length(F.bin(F.least(e, F.lit(2.0**32 - 1)).cast("long"))) - 1).alias("v"))


def level_pyramid(required: DataFrame, meta: GridMeta) -> DataFrame:
    """level, key, v: the clipped required level of half resolution and its maxima at coarser levels."""
    top = max(1, meta.l_max - 1)
    clipped = required.select(*KEY, F.least(F.greatest(F.col("v"), F.lit(meta.l_min)), F.lit(top)).cast("int").alias("v"))
    return blocks.pyramid(clipped, meta.half(), "max", meta.l_min, top).select(*CELL, "v")


def fill_seeds(pyr: DataFrame, meta: GridMeta) -> DataFrame:
    """Cells whose own level this is: at the top also finer ones, at the bottom also coarser ones."""
    top, v, l = max(1, meta.l_max - 1), F.col("v"), F.col("level")
    seed = F.when(l == top, v >= l).when(l == meta.l_min, v <= l).otherwise(v == l)
    return pyr.withColumn("type", F.when(seed, SEED).otherwise(0))


def solve(required: DataFrame, meta: GridMeta, settle: Settle = lambda df: df) -> DataFrame:
    """level, z, x, y, type of the optimal valid cell set at half resolution."""
    top = max(1, meta.l_max - 1)
    pyr = level_pyramid(required, meta)
    near = blocks.neighbourhood_max(pyr, meta)
    l = F.col("level")
    typed = near.where(F.col("n") <= l).select(*CELL, F.when(F.col("v") == l, SEED).when(F.col("n") == l, BOUNDARY).otherwise(FILLER).alias("type"))
    typed = settle(typed)
    parents = typed.where(l < top).select((l + 1).alias("level"), *[F.col(a).alias(f"p{a}") for a in KEY])
    child = typed.select("*", *[F.shiftright(a, 1).alias(f"p{a}") for a in KEY])
    return child.join(parents, ["level", "pz", "px", "py"], "left_anti").select(*CELL, "type")


def solve_sparse(required: DataFrame, meta: GridMeta, settle: Settle = lambda df: df) -> DataFrame:
    """solve() for required levels of which only those above zero are there."""
    return solve(densify(required.select(*KEY, F.col("v").cast("int").alias("v")), meta.half()), meta, settle)


def cells_to_leaves(solved: DataFrame, meta: GridMeta, neighbourhood: bool = True) -> DataFrame:
    """level, z, x, y of the leaves at full resolution: split types give their children, the others stay."""
    split = F.col("type") <= (SEED if neighbourhood else BOUNDARY)
    keep = solved.where(~split).select(*CELL)
    kids = solved.where(split).withColumn("level", F.col("level") + 1)
    for a in AXES:
        if meta.size[a] > 1:
            kids = kids.withColumn(a, F.explode(F.array(F.col(a) * 2, F.col(a) * 2 + 1)))
    return keep.unionByName(kids.where(inside(meta)).select(*CELL))


def leaves(required: DataFrame, meta: GridMeta, neighbourhood: bool = True, settle: Settle = lambda df: df) -> DataFrame:
    if meta.l_max <= 2:
        return all_pixels(required.sparkSession, meta)
    return cells_to_leaves(settle(solve(required, meta, settle)), meta, neighbourhood)


def all_pixels(spark, meta: GridMeta) -> DataFrame:
    """The rule for tiny grids: every pixel is a leaf."""
    from quadrille.plans.grids import cells

    return cells(spark, meta).select(F.lit(meta.l_max).alias("level"), *KEY)


def tiled_fields(grid: DataFrame, meta: GridMeta, p: Parameters, edge: int | None = None) -> DataFrame:
    """key, grad, half, scale at half resolution from tiles with ghosts: one shuffle for the gradient, the mean and the windows of the scale.

    scale is null where it is one number for the whole grid."""
    first, second, factor = windows(meta.half(), p.psf / p.dx)
    whole = p.constant_scale or not first
    reach = {a: 0 if whole else first.get(a, 0) + second.get(a, 0) for a in AXES}
    ghost = {a: 2 * reach[a] + 2 if meta.size[a] > 1 else 0 for a in AXES}
    steps = {"y": p.dy, "x": p.dx, "z": p.dz}

    def mean(v: np.ndarray, axis: int, r: int) -> np.ndarray:
        """Over [k - r, k + r] clipped to the line; cells whose window leaves the tile are not used."""
        m = v.shape[axis]
        total = np.concatenate([np.zeros_like(np.take(v, [0], axis)), np.cumsum(v, axis)], axis)
        high, low = np.minimum(np.arange(m) + r, m - 1) + 1, np.maximum(np.arange(m) - r, 0)
        count = (high - low).reshape([-1 if i == axis else 1 for i in range(3)])
        return (np.take(total, high, axis) - np.take(total, low, axis)) / count

    def work(v, lo, start, stop):
        v, square = v.astype(float), 0.0
        for i, a in enumerate(AXES):
            m = v.shape[i]
            d = (np.take(v, [*range(1, m), m - 1], i) - np.take(v, [0, *range(m - 1)], i)) / (2 * steps[a])
            square = square + d * d
        grad, half = blocks.halved(np.sqrt(square), "max"), blocks.halved(v, "sum") / 8
        origin = {a: lo[a] // 2 for a in AXES}
        out = {"grad": grad, "half": half}
        if not whole:
            s = half
            for radii, absolute in ((first, True), (second, False)):
                for a in ("y", "x", "z"):
                    if a in radii:
                        s = mean(s, AXES.index(a), radii[a])
                s = np.abs(s - half) if absolute else s
            out["scale"] = s * factor
        cut = tuple(slice(start[a] // 2 - origin[a], -(-stop[a] // 2) - origin[a]) for a in AXES)
        rows = blocks.rows_of_array({n: x[cut] for n, x in out.items()}, {a: start[a] // 2 for a in AXES})
        return rows if not whole else rows.assign(scale=np.nan)

    return blocks.tiles(grid, meta, ghost, work, "z int, x int, y int, grad double, half double, scale double", edge)


def fields(grid: DataFrame, meta: GridMeta, p: Parameters, settle: Settle = lambda df: df, edge: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Gradient and scale at half resolution (key, grad, scale), and the mean-downsampled intensity.

    Tiles with ghosts do all of it in one shuffle; smoothing and mirrored windows reach further and take passes of their own."""
    steps = {"y": p.dy, "x": p.dx, "z": p.dz}
    work = grid.withColumn("v", F.col("v").cast("double"))
    if p.smoothing > 0:
        work = settle(smooth_spline(work, meta, p.smoothing))
        grad = gradient_magnitude_half(work, meta, steps).withColumnRenamed("v", "grad")
        both = settle(grad.join(dense.downsample(inverse_spline(work, meta), meta, "mean").withColumnRenamed("v", "half"), KEY))
        own = False
    else:
        both = settle(tiled_fields(work, meta, p, edge))
        own = not (p.constant_scale or p.reflect or not windows(meta.half(), p.psf / p.dx)[0])
    half = both.select(*KEY, F.col("half").alias("v"))
    if p.intensity_th:
        both = both.withColumn("grad", F.when(F.col("half") <= p.intensity_th, 0.0).otherwise(F.col("grad")))
    if own:
        return both.select(*KEY, "grad", "scale"), half
    scale = local_scale(half, meta.half(), p)
    return both.select(*KEY, "grad").join(scale.withColumnRenamed("v", "scale"), KEY), half


def convert(grid: DataFrame, meta: GridMeta, p: Parameters = Parameters(), settle: Settle = lambda df: df, edge: int | None = None) -> DataFrame:
    """Leaves of the adaptive representation of a dense grid.  edge: of the tiles, in pixels, even.

    settle writes and cuts what several later steps read: the half-resolution
    fields and the typed cells, an eighth of the grid or less."""
    if meta.l_max <= 2:
        return all_pixels(grid.sparkSession, meta)
    both, half = fields(grid, meta, p, settle, edge)
    if p.auto:
        p = auto_parameters(both, half, p)
    return leaves(levels(apply_parameters(both, p), meta, p), meta, p.neighbourhood, settle)


def convert_custom(grad: DataFrame, scale: DataFrame, meta: GridMeta, p: Parameters = Parameters()) -> DataFrame:
    """Leaves from a user's gradient and scale at half resolution."""
    both = grad.withColumnRenamed("v", "grad").join(scale.withColumnRenamed("v", "scale"), KEY)
    return leaves(levels(apply_parameters(both, p), meta, p), meta, p.neighbourhood)


def solve_stepwise(required: np.ndarray, l_min: int, top: int) -> dict[int, np.ndarray]:
    """The level-by-level form of the scheme on small arrays (z, x, y), as a check of solve(): types by level."""

    def shrink(a: np.ndarray) -> np.ndarray:
        for axis in range(3):
            n = a.shape[axis]
            a = np.maximum(np.take(a, range(0, n, 2), axis), np.take(a, [min(i + 1, n - 1) for i in range(0, n, 2)], axis))
        return a

    def spread(a: np.ndarray) -> np.ndarray:
        for axis in range(3):
            n = a.shape[axis]
            a = a | np.take(a, [max(i - 1, 0) for i in range(n)], axis) | np.take(a, [min(i + 1, n - 1) for i in range(n)], axis)
        return a

    value = {top: np.clip(required, l_min, top)}
    for l in range(top - 1, l_min - 1, -1):
        value[l] = shrink(value[l + 1])
    types: dict[int, np.ndarray] = {}
    covered: dict[int, np.ndarray] = {}
    for l in range(top, l_min - 1, -1):
        seed = value[l] == l
        finer = value[l] > l
        near = spread(seed) & ~seed & ~finer
        blocked = spread(finer)
        t = np.where(seed & ~blocked, SEED, np.where(near & ~blocked, BOUNDARY, 0))
        t = np.where((t == 0) & ~blocked & ~seed & ~finer, FILLER, t)
        types[l] = t
    for l in range(top, l_min, -1):
        up = np.ix_(*[[i // 2 for i in range(n)] for n in types[l].shape])
        covered[l] = types[l - 1][up] > 0
    return {l: np.where(covered[l], 0, t) if l > l_min else t for l, t in types.items()}
