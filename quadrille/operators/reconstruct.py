"""From cells back to pixels, and projections of cells onto image planes."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.keys import CELL, KEY, level_size, noise
from quadrille.operators import blocks, dense, particles
from quadrille.plans.meta import AXES, GridMeta


@dataclass(frozen=True)
class Patch:
    """A box [begin, end) in pixels of the wanted resolution; a negative end means the whole axis.  delta > 0 refines, < 0 coarsens."""

    begin: tuple[int, int, int] = (0, 0, 0)
    end: tuple[int, int, int] = (-1, -1, -1)
    delta: int = 0

    def bounds(self, meta: GridMeta) -> dict[str, tuple[int, int]]:
        out = {}
        for i, a in enumerate(AXES):
            n = meta.size[a] if self.delta == 0 else (meta.n(meta.l_max + self.delta, a) if self.delta < 0 else meta.size[a] << self.delta if meta.size[a] > 1 else 1)
            out[a] = max(0, self.begin[i]), n if self.end[i] < 0 else min(self.end[i], n)
        return out


def spread(cells: DataFrame, size: Column, bounds: dict[str, tuple[int, int]], meta: GridMeta, column: str = "v") -> DataFrame:
    """Every pixel of every cell, `size` pixels wide, inside bounds: a narrow step."""
    out = cells.select(*KEY, column, size.cast("int").alias("__s"))
    for a in AXES:
        lo, hi = bounds[a]
        if meta.size[a] == 1:
            out = out.withColumn(a, F.lit(0))
            continue
        first, last = F.greatest(F.col(a) * F.col("__s"), F.lit(lo)), F.least((F.col(a) + 1) * F.col("__s"), F.lit(hi)) - 1
        out = out.where((F.col(a) * F.col("__s") < hi) & ((F.col(a) + 1) * F.col("__s") > lo)).withColumn(a, F.explode(F.sequence(first, last)))
    return out.select(*KEY, column)


def constant(cells: DataFrame, meta: GridMeta, patch: Patch = Patch(), tree_values: DataFrame | None = None, column: str = "v") -> DataFrame:
    """Each pixel with its cell's value.  Coarser than the finest level, interior cells give their means at the capped level."""
    bounds = patch.bounds(meta)
    if patch.delta >= 0:
        return spread(cells, level_size(meta) * (1 << patch.delta), bounds, meta, column)
    cap = max(meta.l_min, meta.l_max + patch.delta)
    inner = particles.tree_mean(cells, meta) if tree_values is None else tree_values
    rows = cells.where(F.col("level") <= cap).select(*CELL, F.col(column).cast("double").alias(column))
    rows = rows.unionByName(inner.where(F.col("level") == cap).select(*CELL, F.col("v").cast("double").alias(column)))
    return spread(rows, F.call_function("shiftleft", F.lit(1), F.lit(cap) - F.col("level")), bounds, meta, column)


def levels(cells: DataFrame, meta: GridMeta, patch: Patch = Patch()) -> DataFrame:
    """Each pixel with its cell's level, at most the capped one."""
    marked = cells.withColumn("v", F.col("level"))
    if patch.delta >= 0:
        return constant(marked, meta, patch)
    cap = max(meta.l_min, meta.l_max + patch.delta)
    inner = particles.tree(cells).where(F.col("level") == cap).withColumn("v", F.lit(cap))
    rows = marked.where(F.col("level") <= cap).select(*CELL, "v").unionByName(inner)
    return spread(rows, F.call_function("shiftleft", F.lit(1), F.lit(cap) - F.col("level")), patch.bounds(meta), meta)


def variable_mean(pixels: DataFrame, meta: GridMeta, axis: str, scale: float, cap: int) -> DataFrame:
    """pixels: key, v, level.  Mean over [k - r, k + r] cut at the ends, r from the level.

    A difference of prefix sums on runs of lines with a halo of the largest
    radius.  Near the start of a line, from its second pixel on, the first
    pixel is left out of a cut window."""
    n = meta.size[axis]
    cap = min(cap, n // 2 - 1)
    if n == 1 or cap < 1:
        return pixels

    def work(x: dict[str, np.ndarray], lo: int) -> dict[str, np.ndarray]:
        v, level = x["v"].astype(float), x["level"]
        r = np.minimum(np.floor(2.0 ** (meta.l_max - level) / scale), cap).astype(np.int64)
        k = np.arange(v.shape[1])[None] + lo
        sums = np.concatenate([np.zeros((len(v), 1)), np.cumsum(v, axis=1)], 1)
        high = np.minimum(k + r, n - 1)
        low = np.where(k > r, k - r - 1, np.where(k > 0, 0, -1))
        # Sums start at the run's own first cell; cells of the halo whose window lies beyond it are not used.
        at = lambda i: np.take_along_axis(sums, np.clip(i + 1 - lo, 0, sums.shape[1] - 1), 1)
        mean = np.where(r == 0, v, (at(high) - at(low)) / np.maximum(high - low, 1))
        return {"v": mean, "level": level}

    return blocks.lines(pixels, meta, axis, cap + 1, ["v", "level"], work, "z int, x int, y int, v double, level int")


def smooth(cells: DataFrame, meta: GridMeta, patch: Patch = Patch(), scale: float = 2.0, cap: int | None = None) -> DataFrame:
    """Constant reconstruction, then a mean on each axis as wide as the cells; radii end at 20, for a patch at 10."""
    cap = cap if cap is not None else (20 if patch == Patch() else 10)
    both = cells.withColumn("v", F.struct(F.col("v").cast("double").alias("v"), F.col("level").alias("level")))
    out = spread(both, level_size(meta), Patch().bounds(meta), meta).select(*KEY, F.col("v.v").alias("v"), F.col("v.level").alias("level"))
    for a in ("y", "x", "z"):
        out = variable_mean(out, meta, a, scale, cap)
    b = patch.bounds(meta)
    keep = reduce(lambda p, q: p & q, [(F.col(a) >= b[a][0]) & (F.col(a) < b[a][1]) for a in AXES])
    return out.where(keep).select(*KEY, "v")


def interpolated(cells: DataFrame, meta: GridMeta, smooth_levels: bool = True, delta: int = 0) -> DataFrame:
    """From coarse to fine: nearest doubling of what stands above, cells and interior means written over it, then a mean of 27."""
    inner = particles.tree_mean(cells, meta)
    top, img = meta.l_max + min(0, delta), None
    for level in range(meta.l_min, top + 1):
        own = cells.where(F.col("level") == level).select(*KEY, F.col("v").cast("double").alias("v")).unionByName(inner.where(F.col("level") == level).select(*KEY, "v"))
        size = meta.at(level)
        if img is None:
            img = own
        else:
            base = dense.upsample(img, size).withColumnRenamed("v", "u")
            img = base.join(own, KEY, "left").select(*KEY, F.coalesce("v", "u").alias("v"))
        if smooth_levels:
            img = dense.smooth(img, size)
    return img


# --- projection ------------------------------------------------------------------


@dataclass(frozen=True)
class Camera:
    """Look-at camera with a perspective of 60 degrees, near plane 0.5, far plane 70."""

    radius: float
    theta: float
    origin: tuple[float, float, float]
    target: tuple[float, float, float]
    phi: float = 0.0
    phi_s: float = 0.0
    width: int = 64
    height: int = 64

    def matrix(self) -> np.ndarray:
        """World to clip coordinates (x, y, z)."""
        o, t = np.array(self.origin), np.array(self.target)
        eye = o + self.radius * np.array([math.sin(self.phi), math.sin(self.theta) * math.cos(self.phi_s), math.cos(self.theta) * math.cos(self.phi_s)])
        unit = lambda v: v / np.linalg.norm(v)
        f = unit(t - eye)
        up = np.cross(f, [1.0, 0.0, 0.0])
        s = unit(np.cross(f, up))
        u = np.cross(s, f)
        view = np.eye(4)
        view[0, :3], view[1, :3], view[2, :3] = s, u, -f
        view[:3, 3] = -np.array([s @ eye, u @ eye, -(f @ eye)])
        g, near, far = 1 / math.tan(math.radians(60) / 2), 0.5, 70.0
        proj = np.zeros((4, 4))
        proj[0, 0], proj[1, 1] = g / (self.width / self.height), g
        proj[2, 2], proj[2, 3], proj[3, 2] = -(far + near) / (far - near), -2 * far * near / (far - near), -1
        return proj @ view


def project(camera: Camera, px: Column, py: Column, pz: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Row and column of a point on an image of the given size."""
    m = camera.matrix()
    clip = [m[i, 0] * px + m[i, 1] * py + m[i, 2] * pz + F.lit(float(m[i, 3])) for i in (0, 1, 3)]
    sx, sy = (clip[0] / clip[2] - 1) / 2 * width, (clip[1] / clip[2] - 1) / 2 * height
    return F.round(-sy).cast("int"), F.round(-sx).cast("int")


def raycast(cells: DataFrame, meta: GridMeta, camera: Camera, how: str = "max", jitter: float = 0.0, seed: int = 0, scale: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """row, col, v: one view of sweep()."""
    return sweep(cells, meta, [camera], how, jitter, seed, scale).drop("view")


def sweep(cells: DataFrame, meta: GridMeta, cameras: list[Camera], how: str = "max", jitter: float = 0.0, seed: int = 0, scale: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """view, row, col, v: for each camera leaf centres on an image per level, reduced, spread to full size, reduced again.

    The cells are read once for all views.  The jitter of a centre follows from
    the cell and the seed, not from where the row lies."""
    s = level_size(meta).cast("double")
    shift = lambda i: (F.expr(noise(seed + i)) - 0.5) * jitter if jitter else F.lit(0.0)
    at = cells.select("level", F.col("v").cast("double").alias("v"), s.alias("s"), *[((F.col(a) + 0.5 + shift(i)) * s * scale[i]).alias(f"p{a}") for i, a in enumerate(KEY)])
    seen_by = []
    for i, c in enumerate(cameras):
        width, height = F.ceil(F.lit(c.width) / F.col("s")), F.ceil(F.lit(c.height) / F.col("s"))
        row, col = project(c, F.col("px"), F.col("py"), F.col("pz"), width, height)
        seen_by.append(F.struct(F.lit(i).alias("view"), row.alias("row"), col.alias("col"), width.alias("w"), height.alias("h"), F.lit(c.width).alias("wide"), F.lit(c.height).alias("high")))
    agg = {"max": F.max, "min": F.min, "sum": F.sum}[how]
    seen = at.select("level", "v", F.col("s").cast("int").alias("s"), F.explode(F.array(*seen_by)).alias("o")).select("level", "v", "s", "o.*")
    seen = seen.where("row > 0 and col > 0 and row < h and col < w").groupBy("view", "level", "row", "col", "s", "wide", "high").agg(agg("v").alias("v"))
    seen = seen.where((F.col("level") == meta.l_max) | (F.col("v") > 0))
    for c, n in (("row", "high"), ("col", "wide")):
        seen = seen.withColumn(c, F.explode(F.sequence(F.col(c) * F.col("s"), F.least((F.col(c) + 1) * F.col("s"), F.col(n)) - 1)))
    return seen.groupBy("view", "row", "col").agg(agg("v").alias("v"))


def raycast_patch(cells: DataFrame, meta: GridMeta, camera: Camera, patch: Patch, how: str = "max") -> DataFrame:
    """raycast of the cells that touch the patch; coarser than the finest level with interior means."""
    if patch.delta < 0:
        cap = max(meta.l_min, meta.l_max + patch.delta)
        cells = cells.where(F.col("level") <= cap).select(*CELL, F.col("v").cast("double").alias("v")).unionByName(particles.tree_mean(cells, meta).where(F.col("level") == cap))
    s, k = level_size(meta), 1 << -min(0, patch.delta)
    b = patch.bounds(meta)
    touch = reduce(lambda p, q: p & q, [(F.col(a) * s < b[a][1] * k) & ((F.col(a) + 1) * s > b[a][0] * k) for a in AXES])
    return raycast(cells.where(touch), meta, camera, how)


def raycast_pixels(grid: DataFrame, meta: GridMeta, camera: Camera) -> DataFrame:
    """Maximum over the pixels of a dense grid."""
    return raycast(grid.withColumn("level", F.lit(meta.l_max)), meta, camera, "max")
