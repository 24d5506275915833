"""Stencils, level-adaptive filters and the numerics built on them.

A filter at a cell of level l sees an isotropic neighbourhood at l: cells of
l itself, coarser cells spread out, and means of finer ones.  As a plan: cells
and means go to blocks of each level's image with a halo as wide as the
stencil, one shuffle of about a row for each of them, and the stencil runs on
arrays inside the block; no row stands for a (cell, place) pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.keys import CELL
from quadrille.operators import blocks, particles
from quadrille.plans.meta import AXES, GridMeta

Stencil = np.ndarray  # (z, x, y), odd extents


# --- kernels -----------------------------------------------------------------


def gaussian(sigma: dict[str, float] | float, size: dict[str, int] | int, normalise: bool = True) -> Stencil:
    parts = []
    for a in AXES:
        n, s = (size[a] if isinstance(size, dict) else size), (sigma[a] if isinstance(sigma, dict) else sigma)
        x = np.arange(n) - n // 2
        parts.append(np.exp(-x * x / (2 * s * s)) / (s * math.sqrt(2 * math.pi)) if n > 1 else np.ones(1))
    k = parts[0][:, None, None] * parts[1][None, :, None] * parts[2][None, None, :]
    return k / k.sum() if normalise else k


def mean_kernel(size: dict[str, int] | int) -> Stencil:
    shape = [size[a] if isinstance(size, dict) else size for a in AXES]
    return np.full(shape, 1.0 / np.prod(shape))


def difference(axis: str, delta: float = 1.0) -> Stencil:
    shape = [3 if a == axis else 1 for a in AXES]
    return (np.array([-1.0, 0.0, 1.0]) / (2 * delta)).reshape(shape)


def sobel(axis: str, delta: float = 1.0, axes: tuple[str, ...] = AXES) -> Stencil:
    """Central difference on one axis, [1, 2, 1] / 4 on the other given ones."""
    k = np.ones((1, 1, 1))
    for i, a in enumerate(AXES):
        if a in axes:
            line = np.array([-1.0, 0.0, 1.0]) / (2 * delta) if a == axis else np.array([0.25, 0.5, 0.25])
            k = k * line.reshape([3 if j == i else 1 for j in range(3)])
    return k


def downsample_kernel(k: Stencil, delta: int, normalise: bool = False) -> Stencil:
    """Box overlap of the kernel's cells, each as wide as a coarse cell, with coarse cells of width 2**delta."""
    step = 1 << delta
    mats, active = [], 0
    for n in k.shape:
        if n == 1:
            mats.append(np.full((1, 1), float(step)))
            continue
        active += 1
        m = max(2 * (((n - 1) // 2 + step - 1) // step) + 1, 3)
        off = (m // 2) * step - n // 2
        start = np.maximum(np.arange(m)[:, None] * step, off + np.arange(n)[None, :])
        end = np.minimum(np.arange(m)[:, None] * step + step, off + np.arange(n)[None, :] + step)
        mats.append(np.maximum(end - start, 0).astype(float))
    # A singleton axis overlaps over the whole step and is not divided away.
    out = np.einsum("az,bx,cy,zxy->abc", *mats, k) / step**active
    return out / out.sum() if normalise else out


def downsampled_kernels(k: Stencil, meta: GridMeta, normalise: bool = False) -> list[Stencil]:
    """One kernel for each level from l_max down to l_min + 1; l_min uses the last."""
    first = k / k.sum() if normalise and abs(k.sum()) > 1e-6 else k
    return [first, *[downsample_kernel(k, d, normalise) for d in range(1, max(1, meta.l_max - meta.l_min))]]


def rescaled_kernels(k: Stencil, meta: GridMeta) -> list[Stencil]:
    return [k / 2**d for d in range(max(1, meta.l_max - meta.l_min))]


def rows_of(k: Stencil) -> list[tuple[int, int, int, float]]:
    hz, hx, hy = (n // 2 for n in k.shape)
    return [(z - hz, x - hx, y - hy, float(k[z, x, y])) for z in range(k.shape[0]) for x in range(k.shape[1]) for y in range(k.shape[2])]


def stencil_table(spark, kernels: list[Stencil], meta: GridMeta) -> DataFrame:
    """level, oz, ox, oy, w: a few hundred rows, broadcast."""
    rows = [(l, *r) for l in range(meta.l_min, meta.l_max + 1) for r in rows_of(kernels[min(len(kernels) - 1, meta.l_max - l)])]
    return spark.createDataFrame(rows, "level int, oz int, ox int, oy int, w double")


# --- filters -----------------------------------------------------------------


def _inner(cells: DataFrame, meta: GridMeta, tree_values: DataFrame | None) -> DataFrame:
    return particles.tree_mean(cells, meta) if tree_values is None else tree_values


def convolve(cells: DataFrame, meta: GridMeta, kernels: list[Stencil] | Stencil, reflect: bool = False, tree_values: DataFrame | None = None) -> DataFrame:
    """Level-adaptive convolution with a kernel for each level (the last for all coarser ones).  Places outside are mirrored, or left out."""
    kernels = kernels if isinstance(kernels, list) else [kernels]
    return blocks.patches(cells, meta, kernels, reflect, _inner(cells, meta, tree_values), lambda l, p, there, w, e: {"v": blocks.weighted(p, there, w)}, "v double")


def convolve_downsampled(cells: DataFrame, meta: GridMeta, kernel: Stencil, reflect: bool = False, normalise: bool = False) -> DataFrame:
    return convolve(cells, meta, downsampled_kernels(kernel, meta, normalise), reflect)


def convolve_separable(cells: DataFrame, meta: GridMeta, lines: dict[str, list[Stencil]], reflect: bool = False, settle: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """One pass for y, x, z; means of finer cells are taken anew in each pass, so this is not the dense convolution."""
    for a in ("y", "x", "z"):
        if a in lines and meta.size[a] > 1:
            cells = settle(convolve(cells, meta, lines[a], reflect))
    return cells


def generic_filter(cells: DataFrame, meta: GridMeta, size: dict[str, int], f: Callable[[Column], Column], reflect: bool = True, tree_values: DataFrame | None = None) -> DataFrame:
    """f over the sorted array of a patch's values; the patch has as many places at every level."""

    def values(l, p, there, w, e):
        p = np.sort(np.where(there, p, np.inf), axis=1)
        return {"v": [x[:n] for x, n in zip(p, there.sum(1))]}

    patch = blocks.patches(cells, meta, [mean_kernel(size)], reflect, _inner(cells, meta, tree_values), values, "v array<double>")
    return patch.select(*CELL, f(F.col("v")).alias("v"))


def _ordered(cells: DataFrame, meta: GridMeta, size: dict[str, int], pick: Callable, inner: DataFrame) -> DataFrame:
    return blocks.patches(cells, meta, [mean_kernel(size)], True, inner, lambda l, p, there, w, e: {"v": pick(p, there)}, "v double")


def median_filter(cells: DataFrame, meta: GridMeta, size: dict[str, int]) -> DataFrame:
    """The upper median of the patch."""

    def upper(p, there):
        p = np.sort(np.where(there, p, np.inf), axis=1)
        return np.take_along_axis(p, (there.sum(1) // 2)[:, None], 1)[:, 0]

    return _ordered(cells, meta, size, upper, particles.tree_mean(cells, meta))


def min_filter(cells: DataFrame, meta: GridMeta, size: dict[str, int]) -> DataFrame:
    return _ordered(cells, meta, size, lambda p, there: np.where(there, p, np.inf).min(1), particles.fold_tree(cells, "min"))


def max_filter(cells: DataFrame, meta: GridMeta, size: dict[str, int]) -> DataFrame:
    return _ordered(cells, meta, size, lambda p, there: np.where(there, p, -np.inf).max(1), particles.fold_tree(cells, "max"))


# --- numerics ------------------------------------------------------------------


def gradient_cfd(cells: DataFrame, meta: GridMeta, axis: str, delta: float = 1.0) -> DataFrame:
    return convolve(cells, meta, rescaled_kernels(difference(axis, delta), meta), reflect=True)


def gradient_sobel(cells: DataFrame, meta: GridMeta, axis: str, delta: float = 1.0) -> DataFrame:
    if meta.dimensions < 2 or (meta.dimensions == 2 and axis == "z"):
        return gradient_cfd(cells, meta, axis, delta)
    axes = AXES if meta.dimensions == 3 else ("x", "y")
    return convolve(cells, meta, rescaled_kernels(sobel(axis, delta, axes), meta), reflect=True)


def gradient_magnitude(cells: DataFrame, meta: GridMeta, how: str = "cfd", deltas: dict[str, float] | None = None) -> DataFrame:
    """Root of the squares over the active axes; all kernels share one pass."""
    make = {a: (difference(a, (deltas or {}).get(a, 1.0)) if how == "cfd" or meta.dimensions < 2 else sobel(a, (deltas or {}).get(a, 1.0), AXES if meta.dimensions == 3 else ("x", "y"))) for a in meta.active or ["y"]}
    parts = directional(cells, meta, make)
    return parts.select(*CELL, F.sqrt(sum((F.col(f"g{a}") * F.col(f"g{a}") for a in make), F.lit(0.0))).alias("v"))


def directional(cells: DataFrame, meta: GridMeta, kernels: dict[str, Stencil]) -> DataFrame:
    """level, z, x, y and g<axis> for several kernels, from one pass over the union of their places; divided by the size of the cell."""
    places: dict[tuple[int, int, int], dict[str, float]] = {}
    for a, k in kernels.items():
        for z, x, y, w in rows_of(k):
            if w:
                places.setdefault((z, x, y), {})[a] = w
    half = [max(abs(p[i]) for p in places) for i in range(3)]
    shape = [2 * h + 1 for h in half]
    of = {a: np.zeros(shape) for a in kernels}
    for p, ws in places.items():
        for a, w in ws.items():
            of[a][tuple(c + h for c, h in zip(p, half))] = w
    deepest = max(0, meta.l_max - meta.l_min - 1)

    def sums(l, p, there, w, e):
        scale = float(1 << min(meta.l_max - l, deepest))
        out = {}
        for a, k in of.items():
            k = k.ravel()
            used = np.flatnonzero(k)
            out[f"g{a}"] = blocks.weighted(p[:, used], there[:, used], k[used]) / scale
        return out

    return blocks.patches(cells, meta, [np.ones(shape)], True, particles.tree_mean(cells, meta), sums, ", ".join(f"g{a} double" for a in kernels))


def local_std(cells: DataFrame, meta: GridMeta, size: dict[str, int]) -> DataFrame:
    """Root of the mean of squares minus the square of the mean; finer cells enter as their mean, squared."""

    def std(l, p, there, w, e):
        m, q = blocks.weighted(p, there, w), blocks.weighted(p * p, there, w)
        return {"v": np.sqrt(np.maximum(q - m * m, 0.0))}

    return blocks.patches(cells, meta, downsampled_kernels(mean_kernel(size), meta, True), True, particles.tree_mean(cells, meta), std, "v double")


def adaptive_extreme(cells: DataFrame, meta: GridMeta, how: str, tree_smooth: int = 3, level_delta: int = 4, smooth: int = 3, settle: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Local minimum or maximum: fold over the tree, smooth there, push down, smooth the leaves."""
    inner = particles.fold_tree(cells, how).select(*CELL, F.col("v").cast("double").alias("v"))
    deepest = max(0, meta.l_max - 1 - level_delta)
    coarse = particles.separable_face_filter(inner.where(F.col("level") <= deepest), meta, (0.25, 0.5, 0.25), tree_smooth, True, settle)
    inner = coarse.unionByName(inner.where(F.col("level") > deepest))
    leaves = settle(particles.push_to_leaves(cells, particles.push_down(settle(inner), meta, level_delta)))
    return particles.separable_face_filter(leaves, meta, (0.25, 0.5, 0.25), smooth, False, settle)


def div_norm_grad(cells: DataFrame, meta: GridMeta, deltas: dict[str, float] | None = None, settle: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Divergence of the gradient, which is normalised where it is longer than 1e-6."""
    axes = meta.active or ["y"]
    g = directional(cells, meta, {a: difference(a, (deltas or {}).get(a, 1.0)) for a in axes})
    mag = F.sqrt(sum((F.col(f"g{a}") * F.col(f"g{a}") for a in axes), F.lit(0.0)))
    g = settle(g.withColumn("m", mag).select(*CELL, *[F.when(F.col("m") > 1e-6, F.col(f"g{a}") / F.col("m")).otherwise(F.col(f"g{a}")).alias(f"g{a}") for a in axes]))
    out = None
    for a in axes:
        part = gradient_cfd(g.select(*CELL, F.col(f"g{a}").alias("v")), meta, a, (deltas or {}).get(a, 1.0))
        out = part if out is None else particles.zip_cells(out, part, lambda p, q: p + q)
    return out


def richardson_lucy(cells: DataFrame, meta: GridMeta, psf: Stencil, iterations: int, tv: float = 0.0, downsample: bool = True, normalise: bool = True, start: DataFrame | None = None, settle: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Iterative deconvolution from ones; with tv, divided by 1 - tv * div_norm_grad.  settle cuts the lineage of each estimate.

    A blur of zero gives a null ratio, which stays null."""
    make = lambda k: downsampled_kernels(k, meta, normalise) if downsample else [k / k.sum() if normalise else k]
    fwd, back = make(psf), make(psf[::-1, ::-1, ::-1])
    est = cells.select(*CELL, F.lit(1.0).alias("v")) if start is None else start
    for _ in range(iterations):
        blur = convolve(est, meta, back)
        ratio = particles.zip_cells(cells, blur, lambda a, b: F.try_divide(a.cast("double"), b)).select(*CELL, "v")
        new = particles.zip_cells(est, convolve(ratio, meta, fwd), lambda a, b: a * b)
        if tv:
            new = particles.zip_cells(new, div_norm_grad(est, meta, settle=settle), lambda a, b: F.try_divide(a, 1 - tv * b))
        est = settle(new.select(*CELL, "v"))
    return est
