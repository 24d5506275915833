"""Blocks with a halo: one shuffle, then arrays.

Rows go to every block whose halo they lie in, by expressions on their keys; a
block is one Arrow group of bounded size and works on numpy arrays.  Three
shapes: boxes of a dense grid (tiles), runs of lines along one axis, and boxes
of one level's image with the coarser cells and interior means that show in it.
Sizes follow the number of dimensions, so a group has a million cells or so
whatever the grid's extents.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.keys import CELL, KEY, extent
from quadrille.plans.meta import AXES, GridMeta

#: Edge of a tile in pixels by dimensions, even; cells of a group of lines; values of patches held at once.
TILE = {0: 2, 1: 1 << 20, 2: 1024, 3: 96}
LINE, LINES = 65536, 1 << 20
#: Cells of a block of one level's image, and values of patches in one frame.
CELLS, VALUES = 1 << 18, 1 << 23
PATCHES = 1 << 22


def _spread(df: DataFrame, meta: GridMeta, first: dict[str, Column], last: dict[str, Column], edge: int, names: list[str]) -> DataFrame:
    """A row for each block between those of the first and last cell that want it."""
    for a in AXES:
        if meta.size[a] == 1:
            df = df.withColumn(f"b{a}", F.lit(0))
            continue
        lo, hi = F.floor(F.greatest(first[a], F.lit(0)) / edge), F.floor(last[a] / edge)
        df = df.withColumn(f"b{a}", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))))
    return df.select(*names, *[f"b{a}" for a in AXES])


# --- tiles of a dense grid --------------------------------------------------------------


def tiles(grid: DataFrame, meta: GridMeta, ghost: dict[str, int], work: Callable, schema: str, edge: int | None = None) -> DataFrame:
    """work(array (z, x, y) of v with ghosts, origin, inner start and stop by axis) -> frame, for each tile of a dense grid.

    A tile's array is cut at the ends of the grid; a missing cell raises."""
    edge = edge or TILE[meta.dimensions]
    ends = {a: F.least(F.col(a) + ghost.get(a, 0), F.lit(meta.size[a] - 1)) for a in AXES}
    rows = _spread(grid.select(*KEY, "v"), meta, {a: F.col(a) - ghost.get(a, 0) for a in AXES}, ends, edge, [*KEY, "v"])

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        start = {a: int(b) * edge if meta.size[a] > 1 else 0 for a, b in zip(AXES, key)}
        stop = {a: min(start[a] + edge, meta.size[a]) for a in AXES}
        lo = {a: max(0, start[a] - ghost.get(a, 0)) for a in AXES}
        shape = [min(meta.size[a], stop[a] + ghost.get(a, 0)) - lo[a] for a in AXES]
        if len(frame) != math.prod(shape):
            raise ValueError(f"a tile has {len(frame)} of {math.prod(shape)} cells: the grid is not dense")
        v = np.empty(shape, frame["v"].dtype)
        v[tuple(frame[a].to_numpy() - lo[a] for a in AXES)] = frame["v"].to_numpy()
        return work(v, lo, start, stop)

    return rows.groupBy(*[f"b{a}" for a in AXES]).applyInPandas(run, schema)


def rows_of_array(v: dict[str, np.ndarray], origin: dict[str, int]) -> pd.DataFrame:
    """z, x, y and the named values of arrays of one shape."""
    shape = next(iter(v.values())).shape
    at = np.indices(shape, dtype=np.int32)
    return pd.DataFrame({**{a: at[i].ravel() + np.int32(origin[a]) for i, a in enumerate(AXES)}, **{n: x.ravel() for n, x in v.items()}})


def halved(v: np.ndarray, how: str) -> np.ndarray:
    """Every axis halved; the last cell of an odd axis stands for two.  how: sum, max, min."""
    f = {"sum": np.add, "max": np.maximum, "min": np.minimum}[how]
    for axis in range(3):
        n = v.shape[axis]
        if n % 2:
            v = np.concatenate([v, np.take(v, [n - 1], axis)], axis)
        v = f(np.take(v, range(0, v.shape[axis], 2), axis), np.take(v, range(1, v.shape[axis], 2), axis))
    return v


def pyramid(grid: DataFrame, meta: GridMeta, how: str = "mean", l_min: int = 1, top: int | None = None, edge: int | None = None) -> DataFrame:
    """level, key, v for the levels `top` (the grid) to l_min: each tile gives the levels inside it, and the roots of the tiles, a small grid, those above."""
    from quadrille.operators import dense

    top = top or meta.l_max
    edge = edge or 1 << {0: 1, 1: 20, 2: 10, 3: 6}[meta.dimensions]
    inner = min(edge.bit_length() - 1, top - l_min)
    kind = grid.schema["v"].dataType.simpleString()
    kind = "double" if how == "mean" else "bigint" if how == "sum" and kind not in ("double", "float") else kind

    def work(v, lo, start, stop):
        out, v = [], v.astype(float) if how == "mean" else v
        for d in range(inner + 1):
            if d:
                v = halved(v, "sum") / 8 if how == "mean" else halved(v, how)
            part = rows_of_array({"v": v}, {a: start[a] >> d for a in AXES})
            part.insert(0, "level", np.int32(top - d))
            out.append(part)
        return pd.concat(out)

    near = tiles(grid, meta, {}, work, f"level int, z int, x int, y int, v {kind}", edge)
    if top - inner == l_min:
        return near
    root = meta
    for _ in range(inner):
        root = root.half()
    above = dense.pyramid(near.where(F.col("level") == top - inner).select(*KEY, "v"), root, how, l_min, top - inner)
    return near.unionByName(above.where(F.col("level") < top - inner).select(*CELL, F.col("v").cast(kind).alias("v")))


def neighbourhood_max(pyramid_: DataFrame, meta: GridMeta, name: str = "n") -> DataFrame:
    """pyramid_ (level, key, v; the finest level has the extents of meta's half) with the largest v of the direct neighbourhood at the same level."""
    half, edge = meta.half(), 1 << max(1, int(math.log2(CELLS)) // max(1, meta.dimensions))
    size = {a: extent(meta, a) for a in AXES}
    ends = {a: F.least(F.col(a) + 1, size[a] - 1) for a in AXES}
    kind = pyramid_.schema["v"].dataType.simpleString()
    rows = _spread(pyramid_.select(*CELL, "v"), half, {a: F.col(a) - 1 for a in AXES}, ends, edge, [*CELL, "v"])

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        at = [frame[a].to_numpy() for a in AXES]
        lo = [int(x.min()) for x in at]
        v = np.full([int(x.max()) - l + 3 for x, l in zip(at, lo)], np.iinfo(np.int64).min, np.int64)
        v[tuple(x - l + 1 for x, l in zip(at, lo))] = frame["v"].to_numpy()
        for axis in range(3):
            n = v.shape[axis]
            v = np.maximum(np.maximum(np.take(v, [0, *range(n - 1)], axis), v), np.take(v, [*range(1, n), n - 1], axis))
        own = np.ones(len(frame), bool)
        for i, a in enumerate(AXES):
            own &= at[i] // edge == int(key[i + 1])
        out = frame.loc[own, [*CELL, "v"]]
        out[name] = v[tuple(x[own] - l + 1 for x, l in zip(at, lo))]
        return out

    return rows.groupBy("level", *[f"b{a}" for a in AXES]).applyInPandas(run, f"level int, z int, x int, y int, v {kind}, {name} {kind}")


# --- lines of a dense grid ----------------------------------------------------------------


def lines(grid: DataFrame, meta: GridMeta, axis: str, halo: int, columns: list[str], work: Callable, schema: str, span: int | None = None) -> DataFrame:
    """work({column: array (lines, cells)}, first cell, halves of the axis' length cut) -> {column: array of that shape}, for groups of lines in runs of `span` cells with a halo."""
    n, others, span = meta.size[axis], [a for a in AXES if a != axis], span or LINE
    many = max(1, LINES // min(n, span + 2 * halo))
    number = F.col(others[0]).cast("long") * meta.size[others[1]] + F.col(others[1])
    first, last = F.floor(F.greatest(F.col(axis) - halo, F.lit(0)) / span), F.floor(F.least(F.col(axis) + halo, F.lit(n - 1)) / span)
    rows = grid.select(*KEY, *columns, F.floor(number / many).alias("g")).withColumn("b", F.explode(F.sequence(first.cast("int"), last.cast("int"))))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([*others, axis])
        start = int(key[1]) * span
        stop, lo, hi = min(start + span, n), max(0, start - halo), min(n, start + span + halo)
        if len(frame) % (hi - lo):
            raise ValueError("the grid is not dense")
        out = work({c: frame[c].to_numpy().reshape(-1, hi - lo) for c in columns}, lo)
        keep = np.s_[:, start - lo : stop - lo]
        at = {a: frame[a].to_numpy().reshape(-1, hi - lo)[keep].ravel() for a in AXES}
        return pd.DataFrame({**at, **{c: x[keep].ravel() for c, x in out.items()}})

    return rows.groupBy("g", "b").applyInPandas(run, schema)


# --- patches around cells -------------------------------------------------------------------


def offsets(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (n, 3) about the centre and weights of a stencil."""
    at = np.indices(k.shape).reshape(3, -1).T - np.array(k.shape) // 2
    return at, k.ravel().astype(float)


def patches(cells: DataFrame, meta: GridMeta, kernels: list[np.ndarray], reflect: bool, inner: DataFrame, reduce: Callable, schema: str, by_cell: bool = True, extra: Column | None = None) -> DataFrame:
    """reduce(level, values (cells, places), there (cells, places), weights, extra) for the patches of all cells.

    A place of a patch at level l shows a cell of l, a coarser one spread out,
    or the mean of finer ones (inner: level, key, v); places outside are
    mirrored once, or are not there.  kernels: one for each level from l_max
    down, the last for all others.  reduce gives a dict of columns behind the
    key, or with by_cell=False a frame of its own.  Nulls count as not there."""
    stencil = {l: offsets(kernels[min(len(kernels) - 1, meta.l_max - l)]) for l in range(meta.l_min, meta.l_max + 1)}
    reach = {a: max(int(np.abs(s[0][:, i]).max(initial=0)) for s in stencil.values()) for i, a in enumerate(AXES)}
    wide, places = max(reach.values()), max(len(s[1]) for s in stencil.values())
    deep = max(1, math.ceil(math.log2(wide + 2) - 1)) if wide else 0
    dims = max(1, meta.dimensions)
    # Cells of a block by its edge; smaller where patches are large and one frame holds them.
    edge = 1 << max(1, int(math.log2(min(CELLS, max(4096, VALUES // places)) if by_cell else CELLS)) // dims)
    n = lambda a, l: extent(meta, a, l)
    e = (F.lit(None) if extra is None else extra).cast("double").alias("e")
    leaf = cells.select(*CELL, F.col("v").cast("double").alias("v"), e).withColumn("d", F.explode(F.sequence(F.lit(0), F.least(F.lit(deep), F.lit(meta.l_max) - F.col("level")))))
    rows = leaf.select((F.col("level") + F.col("d")).alias("l"), "d", *KEY, "v", "e", F.lit(0).alias("t"))
    mean = inner.where(F.col("level") >= meta.l_min).select(F.col("level").alias("l"), F.lit(0).alias("d"), *KEY, F.col("v").cast("double").alias("v"), F.lit(None).cast("double").alias("e"), F.lit(1).alias("t"))
    rows = rows.unionByName(mean)
    step = F.call_function("shiftleft", F.lit(1), F.col("d"))
    first = {a: F.col(a) * step - reach[a] for a in AXES}
    last = {a: F.least((F.col(a) + 1) * step - 1 + reach[a], n(a, F.col("l")) - 1) for a in AXES}
    spread = _spread(rows, meta, first, last, edge, ["l", "d", *KEY, "v", "e", "t"])
    names = [c.split()[0].strip("`") for c in schema.split(", ")]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        l = int(key[0])
        size = {a: meta.n(l, a) for a in AXES}
        start = {a: int(key[i + 1]) * edge if size[a] > 1 else 0 for i, a in enumerate(AXES)}
        d, t = frame["d"].to_numpy(), frame["t"].to_numpy()
        at = {a: frame[a].to_numpy().astype(np.int64) for a in AXES}
        own = (d == 0) & (t == 0)
        for a in AXES:
            own &= (at[a] >= start[a]) & (at[a] < start[a] + edge)
        if not own.any():
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ([*CELL, *names] if by_cell else names)})
        lo = {a: max(0, start[a] - reach[a]) for a in AXES}
        hi = {a: min(size[a], start[a] + edge + reach[a]) for a in AXES}
        img, have = np.full([hi[a] - lo[a] for a in AXES], np.nan), np.zeros([hi[a] - lo[a] for a in AXES], bool)
        values = frame["v"].to_numpy()
        for far, mean_ in [*((k, 0) for k in range(deep, -1, -1)), (0, 1)]:
            pick = np.flatnonzero((d == far) & (t == mean_))
            if not len(pick):
                continue
            grow = [np.arange(1 << far) if meta.size[a] > 1 else np.zeros(1, np.int64) for a in AXES]
            where = []
            for i, a in enumerate(AXES):
                base = (at[a][pick] << far) - lo[a] if meta.size[a] > 1 else at[a][pick]
                shape = [-1 if j == i else 1 for j in range(3)]
                where.append(np.broadcast_to(base.reshape(-1, 1, 1, 1) + grow[i].reshape(1, *shape), (len(pick), *map(len, grow))).ravel())
            v = np.repeat(values[pick], math.prod(map(len, grow)))
            inside = np.all([(w >= 0) & (w < img.shape[i]) for i, w in enumerate(where)], axis=0)
            where = tuple(w[inside] for w in where)
            img[where], have[where] = v[inside], True
        have &= ~np.isnan(img)
        off, w = stencil[l]
        mine, out = np.flatnonzero(own), []
        for a0 in range(0, len(mine), max(1, PATCHES // len(w))):
            pick = mine[a0 : a0 + max(1, PATCHES // len(w))]
            index, there = [], np.ones((len(pick), len(w)), bool)
            for i, a in enumerate(AXES):
                c = at[a][pick][:, None] + off[None, :, i]
                if reflect:
                    c = np.where(c < 0, -c, np.where(c > size[a] - 1, 2 * (size[a] - 1) - c, c))
                there &= (c >= 0) & (c < size[a])
                index.append(np.clip(c - lo[a], 0, img.shape[i] - 1))
            p = img[tuple(index)]
            there &= have[tuple(index)]
            got = reduce(l, p, there, w, frame["e"].to_numpy()[pick])
            if by_cell:
                got = pd.DataFrame({"level": np.full(len(pick), l, np.int32), **{a: at[a][pick].astype(np.int32) for a in AXES}, **got})
            out.append(got)
        return pd.concat(out)

    return spread.groupBy("l", *[f"b{a}" for a in AXES]).applyInPandas(run, f"level int, z int, x int, y int, {schema}" if by_cell else schema)


def weighted(p: np.ndarray, there: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum of the weighted values that are there; not a number where none is."""
    total = np.where(there, p, 0.0) @ w if there.all() else (np.where(there, p, 0.0) * w).sum(1)
    return np.where(there.any(1), total, np.nan)
