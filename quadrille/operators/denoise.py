"""Per-level linear denoising kernels: normal equations as sums of partial Gram matrices, solved on the driver.

For each level a kernel predicts a cell from the places around it (the centre
left out of the regression).  A block of cells multiplies its patches with
themselves once; the partial matrices are summed by row, and only one for each
level, set by the kernel size, reaches the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.keys import CELL, noise
from quadrille.operators import blocks, filters, particles
from quadrille.plans.meta import AXES, GridMeta


def half_widths(meta: GridMeta, fine: int = 4, coarse: int = 1) -> dict[int, dict[str, int]]:
    return {l: {a: 0 if meta.size[a] == 1 else (fine if l == meta.l_max else coarse) for a in AXES} for l in range(meta.l_min, meta.l_max + 1)}


def _kernels(meta: GridMeta, shapes: dict[int, list[int]]) -> list[np.ndarray]:
    return [np.ones(shapes[l]) for l in range(meta.l_max, meta.l_min - 1, -1)]


def train(cells: DataFrame, meta: GridMeta, truth: DataFrame | None = None, fine: int = 4, coarse: int = 1, fraction: float = 1.0, seed: int = 0, ridge: float = 1e-6, centre: float = 0.0) -> dict[int, np.ndarray]:
    """level -> kernel, over whole patches.  truth: cells with the values to predict, by default the cells' own.

    fraction: share of the cells that are learned from, chosen by their key and
    the seed.  A level without cells, or a kernel that is not finite or sums to
    nothing, gives the identity."""
    target = F.col("v") if truth is None else F.col("__t")
    rows = cells.select(*CELL, "v") if truth is None else cells.select(*CELL, "v").join(truth.select(*CELL, F.col("v").alias("__t")), CELL, "left")
    if fraction < 1:
        # As particles.sampled(): the other cells stay places of patches.
        target = F.when(F.expr(noise(seed)) < fraction, target)
    shapes = {l: [2 * half[a] + 1 for a in AXES] for l, half in half_widths(meta, fine, coarse).items()}

    def products(l, p, there, w, e):
        whole = there.all(1) & ~np.isnan(e)
        x = np.column_stack([p[whole], e[whole]])
        g = x.T @ x
        return pd.DataFrame({"level": np.full(len(g), l, np.int32), "i": np.arange(len(g), dtype=np.int32), "s": list(g)})

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"level": frame["level"].iloc[:1], "i": frame["i"].iloc[:1], "s": [np.sum(np.stack([*frame["s"]]), axis=0)]})

    schema = "level int, i int, s array<double>"
    part = blocks.patches(rows, meta, _kernels(meta, shapes), True, particles.tree_mean(cells, meta), products, schema, by_cell=False, extra=target)
    found = part.groupBy("level", "i").applyInPandas(total, schema).toPandas().sort_values(["level", "i"])
    out = {}
    for level, shape in shapes.items():
        n, mid = int(np.prod(shape)), int(np.prod(shape)) // 2
        identity = np.zeros(n)
        identity[mid] = 1.0
        kernel, mine = identity, found[found["level"] == level]
        if len(mine) and n > 1:
            g = np.stack([*mine["s"]])
            keep = [k for k in range(n) if k != mid]
            a = g[np.ix_(keep, keep)]
            w = np.linalg.solve(a + ridge * max(1.0, float(np.trace(a)) / len(keep)) * np.eye(len(keep)), g[keep, n])
            kernel = np.zeros(n)
            kernel[keep] = (1 - centre) * w
            kernel[mid] = centre
            if not np.isfinite(kernel).all() or abs(kernel.sum()) < 1e-6:
                kernel = identity
        out[level] = kernel.reshape(shape)
    return out


def apply(cells: DataFrame, meta: GridMeta, kernels: dict[int, np.ndarray]) -> DataFrame:
    """Convolve each level with its kernel, mirrored at the ends."""
    return filters.convolve(cells, meta, [kernels[l] for l in range(meta.l_max, meta.l_min - 1, -1)], True)


def save(spark: SparkSession, kernels: dict[int, np.ndarray], path: str) -> None:
    rows = [(l, [int(n) for n in k.shape], [float(x) for x in k.ravel()]) for l, k in kernels.items()]
    spark.createDataFrame(rows, "level int, shape array<int>, w array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> dict[int, np.ndarray]:
    return {r["level"]: np.array(r["w"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}
