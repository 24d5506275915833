"""Blocks of a few cells give what one block gives, and what numpy gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quadrille.operators import blocks, convert, denoise, dense, filters, particles, reconstruct
from quadrille.plans.grids import cells as keys
from quadrille.plans.meta import GridMeta


def table(spark, a):
    i = np.indices(a.shape).reshape(3, -1)
    return spark.createDataFrame(pd.DataFrame({"z": i[0].astype("int32"), "x": i[1].astype("int32"), "y": i[2].astype("int32"), "v": a.ravel()})).selectExpr("cast(z as int) z", "cast(x as int) x", "cast(y as int) y", "v")


def array(df, shape):
    out, p = np.full(shape, np.nan), df.toPandas()
    assert len(p) == out.size
    out[p.z, p.x, p.y] = p.v
    return out


def values(df):
    return df.toPandas().sort_values(["level", "z", "x", "y"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def grid():
    r = np.random.default_rng(7)
    a = r.integers(0, 40, (9, 21, 30)).astype(float)
    a[:, :9, :12] = 5
    a[5:, 12:, :] = 11
    return a


@pytest.fixture(scope="module")
def cells(spark, grid):
    meta = GridMeta(30, 21, 9)
    g = table(spark, grid)
    return particles.sample(convert.convert(g, meta, convert.Parameters(rel_error=2.0, grad_th=4.0, constant_scale=True)), g, meta).cache(), meta


def test_patches_over_block_borders(cells, monkeypatch):
    c, meta = cells
    k = filters.gaussian(1.0, {"z": 3, "x": 3, "y": 5})
    make = {
        "mirrored": lambda: filters.convolve(c, meta, k, True),
        "cut": lambda: filters.convolve(c, meta, filters.downsampled_kernels(k, meta, True), False),
        "median": lambda: filters.median_filter(c, meta, {"z": 3, "x": 1, "y": 5}),
        "least": lambda: filters.min_filter(c, meta, {"z": 1, "x": 3, "y": 3}),
        "gradient": lambda: filters.gradient_magnitude(c, meta, "sobel"),
        "spread": lambda: filters.local_std(c, meta, {"z": 3, "x": 3, "y": 3}),
    }
    whole = {n: values(f()) for n, f in make.items()}
    kernels = denoise.train(c, meta, fine=1)
    assert all(len(w) == c.count() and w.v.notna().all() for w in whole.values())
    monkeypatch.setattr(blocks, "CELLS", 64)
    for n, f in make.items():
        got = values(f())
        assert got[["level", "z", "x", "y"]].equals(whole[n][["level", "z", "x", "y"]]) and np.allclose(got.v, whole[n].v, atol=1e-6), n
    small = denoise.train(c, meta, fine=1)
    assert all(np.allclose(kernels[l], small[l], atol=1e-6) for l in kernels)


def test_solution_over_block_borders(spark, grid, monkeypatch):
    meta = GridMeta(30, 21, 9)
    make = lambda: values(convert.convert(table(spark, grid), meta, convert.Parameters(rel_error=2.0, grad_th=4.0)).withColumn("v", F.lit(1)))
    whole = make()
    monkeypatch.setattr(blocks, "CELLS", 64)
    monkeypatch.setitem(blocks.TILE, 3, 8)
    assert make().equals(whole)


def test_lines_in_runs(spark, grid, monkeypatch):
    meta = GridMeta(30, 21, 9)
    g = table(spark, grid)
    spline = array(convert.smooth_spline(g, meta, 0.3), grid.shape)
    c = particles.sample(convert.convert(g, meta, convert.Parameters(rel_error=2.0, grad_th=4.0, constant_scale=True)), g, meta)
    smooth = array(reconstruct.smooth(c, meta, cap=3), grid.shape)
    monkeypatch.setattr(blocks, "LINE", 7)
    monkeypatch.setattr(blocks, "LINES", 40)
    assert np.allclose(array(convert.smooth_spline(g, meta, 0.3), grid.shape), spline, rtol=1e-9)
    assert np.allclose(array(reconstruct.smooth(c, meta, cap=3), grid.shape), smooth)


@pytest.mark.parametrize("how", ["mean", "max", "sum"])
def test_pyramid_by_tiles(spark, grid, how):
    meta, g = GridMeta(30, 21, 9), table(spark, grid)
    want = values(dense.pyramid(g, meta, how))
    for edge in (2, 8, 64):
        got = values(blocks.pyramid(g, meta, how, edge=edge))
        assert got[["level", "z", "x", "y"]].equals(want[["level", "z", "x", "y"]]) and np.allclose(got.v.astype(float), want.v.astype(float))


@pytest.mark.parametrize("reflect", [False, True])
def test_dense_stencil(spark, grid, reflect, monkeypatch):
    monkeypatch.setitem(blocks.TILE, 3, 8)
    k = [(0, -1, 2, 0.5), (2, 0, 0, 0.25), (0, 0, 0, 1.0), (-1, 1, -1, -2.0)]
    got = array(dense.convolve(table(spark, grid), GridMeta(30, 21, 9), k, reflect), grid.shape)
    wide = np.pad(grid, 2, "reflect") if reflect else np.pad(grid, 2)
    want = sum(w * wide[2 + z : 11 + z, 2 + x : 23 + x, 2 + y : 32 + y] for z, x, y, w in k)
    assert np.allclose(got, want)


def test_missing_cells_raise(spark, grid):
    meta = GridMeta(30, 21, 9)
    g = table(spark, grid).where("not (z = 3 and x = 4 and y = 5)")
    with pytest.raises(Exception, match="not dense"):
        convert.convert(g, meta).count()
    with pytest.raises(ValueError):
        convert.check(meta, g)
    assert convert.check(meta, table(spark, grid)) == meta.pixels
    with pytest.raises(Exception, match="outside"):
        from quadrille.plans.grids import densify

        densify(keys(spark, meta).selectExpr("z", "x", "y + 30 as y", "1 as v"), meta).count()
