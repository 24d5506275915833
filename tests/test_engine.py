"""Golden values, properties against numpy, and SQL parity of a cross-section of the queries."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quadrille.operators import compress, convert, dense, denoise, filters, particles, reconstruct, timeseries
from quadrille.plans.grids import cells
from quadrille.plans.meta import AXES, GridMeta

SF = "/root/testdata/sf0.001"


def table(spark, a: np.ndarray):
    """A grid from an array (z, x, y)."""
    i = np.indices(a.shape).reshape(3, -1)
    return spark.createDataFrame(pd.DataFrame({"z": i[0].astype("int32"), "x": i[1].astype("int32"), "y": i[2].astype("int32"), "v": a.ravel()})).selectExpr("cast(z as int) z", "cast(x as int) x", "cast(y as int) y", "v")


def array(df, shape, column="v"):
    out = np.full(shape, np.nan)
    p = df.toPandas()
    out[p.z, p.x, p.y] = p[column]
    return out


def numbered(ny, nx, nz, f=lambda i: i + 1):
    return f(np.arange(ny * nx * nz).reshape(nz, nx, ny))


def test_geometry():
    m = GridMeta(101, 30, 1)
    assert (m.l_max, m.n(7, "y"), m.n(6, "y"), m.n(1, "y"), m.n(3, "z"), m.dimensions) == (7, 101, 51, 2, 1, 2)
    assert GridMeta(1).l_max == 1 and GridMeta(64).l_max == 6 and GridMeta(65).l_max == 7


def test_downsample_goldens(spark):
    a = array(dense.downsample(table(spark, numbered(5, 6, 4)), GridMeta(5, 6, 4), "max"), (2, 3, 3))
    assert a.ravel()[:10].tolist() == [37, 39, 40, 47, 49, 50, 57, 59, 60, 97]
    a = array(dense.downsample(table(spark, numbered(5, 6, 3, lambda i: 90 - i)), GridMeta(5, 6, 3), "max"), (2, 3, 3))
    assert a.ravel().tolist() == [90, 88, 86, 80, 78, 76, 70, 68, 66, 30, 28, 26, 20, 18, 16, 10, 8, 6]
    assert dense.downsample(table(spark, numbered(2, 2, 2, lambda i: 8 - i)), GridMeta(2, 2, 2)).first()["v"] == 4.5
    top = dense.pyramid(table(spark, numbered(4, 4, 4).astype(float)), GridMeta(4, 4, 4), l_min=1, l_max=3).where("level = 1")
    assert [r["v"] for r in top.collect()] == [32.5]


@pytest.mark.parametrize("r,want", [(0, [3, 6, 9, 12, 15, 18, 21, 24]), (2, [6, 7.5, 9, 12, 15, 18, 19.5, 21])])
def test_box_mean_goldens(spark, r, want):
    a = dense.box_mean(table(spark, 3 * numbered(8, 1, 1)), "y", r)
    assert array(a, (1, 1, 8)).ravel().tolist() == want


def test_gradient_goldens(spark):
    a = np.zeros((1, 6, 6))
    a[0, 0, 0], a[0, 0, 5], a[0, 5, 0], a[0, 5, 5] = 2, 4, 6, 8
    g = array(convert.gradient_magnitude_half(table(spark, a), GridMeta(6, 6)), (1, 3, 3))[0]
    assert np.allclose(g, [[1.41, 0, 2.82], [0, 0, 0], [4.24, 0, 5.65]], atol=0.05)
    b = np.zeros((1, 6, 6))
    b[0, 1, 1] = 2
    assert np.allclose(array(convert.gradient_magnitude_half(table(spark, b), GridMeta(6, 6)), (1, 3, 3))[0], [[1, 1, 0], [1, 0, 0], [0, 0, 0]], atol=0.01)


def test_pad_and_unpad(spark):
    a = np.arange(12).reshape(1, 3, 4)
    out, m = dense.pad(table(spark, a), GridMeta(4, 3), {"x": 2, "y": 3, "z": 1})
    assert np.array_equal(array(out, (1, 7, 10)), np.pad(a, ((0, 0), (2, 2), (3, 3)), "reflect")) and (m.ny, m.nx) == (10, 7)
    assert np.array_equal(array(dense.unpad(out, GridMeta(4, 3), {"x": 2, "y": 3}), (1, 3, 4)), a)


@pytest.mark.parametrize("shape", [(1, 1, 23), (1, 13, 20), (6, 9, 11)])
def test_solution_matches_numpy_and_covers_once(spark, shape):
    meta = GridMeta(shape[2], shape[1], shape[0])
    half = meta.half()
    r = np.random.default_rng(sum(shape))
    req = r.integers(0, meta.l_max + 1, (half.nz, half.nx, half.ny))
    req[r.random(req.shape) < 0.8] = 0
    sol = convert.solve(table(spark, req), meta).toPandas()
    want = convert.solve_stepwise(req, 1, max(1, meta.l_max - 1))
    for level, types in want.items():
        got = np.zeros_like(types)
        s = sol[sol.level == level]
        got[s.z, s.x, s.y] = s.type
        assert np.array_equal(got, types)
    leaves = convert.leaves(table(spark, req), meta).withColumn("v", F.lit(1))
    seen = reconstruct.constant(leaves, meta)
    assert seen.count() == meta.pixels == seen.select("z", "x", "y").distinct().count()


def test_reconstruction_keeps_the_error_bound(spark):
    r = np.random.default_rng(5)
    a = np.zeros((1, 32, 32))
    a[0, 8:20, 10:25] = 1000 + r.normal(0, 1, (12, 15))
    a += 100
    meta, p = GridMeta(32, 32), convert.Parameters(rel_error=0.2, constant_scale=True)
    c = particles.sample(convert.convert(table(spark, a), meta, p), table(spark, a), meta)
    scale = array(dense.downsample(table(spark, a), meta), (1, 16, 16))
    assert np.abs(array(reconstruct.constant(c, meta), a.shape) - a).max() / (scale.mean() - scale.min()) <= p.rel_error
    assert c.count() < meta.pixels


@pytest.fixture(scope="module")
def small(spark):
    r = np.random.default_rng(1)
    a = r.integers(0, 50, (1, 13, 21)).astype(float)
    a[0, :6, :9] = 7
    meta = GridMeta(21, 13)
    c = particles.sample(convert.convert(table(spark, a), meta, convert.Parameters(rel_error=3.0, grad_th=5.0, constant_scale=True)), table(spark, a), meta).cache()
    return c, meta


def test_flat_tree_mean_equals_steps(small):
    c, meta = small
    a = particles.tree_mean(c, meta).toPandas().sort_values(["level", "z", "x", "y"]).v.to_numpy()
    b = particles.tree_mean_stepwise(c, meta).toPandas().sort_values(["level", "z", "x", "y"]).v.to_numpy()
    assert np.allclose(a, b)


def test_every_pixel_is_located(spark, small):
    c, meta = small
    pts = cells(spark, meta).selectExpr("z * 1000 + x * 50 + y as id", "z + 0.5 as pz", "x + 0.5 as px", "y + 0.5 as py")
    assert particles.locate(pts, c, meta).count() == meta.pixels
    out = spark.createDataFrame([(1, 0.0, -1.0, 2.0), (2, 0.0, 3.0, 99.0)], "id int, pz double, px double, py double")
    assert particles.locate(out, c, meta).count() == 0


def test_convolution_of_a_constant_is_the_constant(small):
    c, meta = small
    out = filters.convolve(c.withColumn("v", F.lit(3.0)), meta, filters.gaussian(1.0, {"z": 1, "x": 5, "y": 5}), True)
    assert np.allclose(out.toPandas().v, 3.0) and out.count() == c.count()


def test_kernels():
    g = filters.gaussian(1.0, 3)
    assert np.isclose(g.sum(), 1) and g.shape == (3, 3, 3)
    assert np.isclose(filters.downsample_kernel(g, 1, True).sum(), 1) and filters.downsample_kernel(np.ones((1, 7, 7)), 1).shape == (1, 5, 5)
    assert filters.difference("y").ravel().tolist() == [-0.5, 0, 0.5]


def test_patch_is_a_crop_of_the_whole(small):
    c, meta = small
    whole = array(reconstruct.constant(c, meta), (1, 13, 21))
    part = reconstruct.constant(c, meta, reconstruct.Patch((0, 2, 3), (1, 9, 17))).toPandas()
    assert len(part) == 7 * 14 and np.array_equal(part.v, whole[part.z, part.x, part.y])


def test_lossy_codec_is_near(spark, small):
    c, meta = small
    both = c.select("level", "z", "x", "y", F.col("v").alias("a")).join(compress.decompress(compress.compress(c)), ["level", "z", "x", "y"]).where("a > 1").toPandas()
    assert (np.abs(both.a - both.v) <= 0.25 * (np.sqrt(both.a) * 2 + 4)).all()


def test_store_round_trip(spark, small, tmp_path):
    from quadrille.sources.storage import READ, WRITE, CellStore

    c, meta = small
    w = CellStore(spark, f"file://{tmp_path}/s", WRITE)
    w.write_cells(c, meta, tree=True)
    w.write_property("p", c)
    assert w.append_cells(c, meta) == 1
    r = CellStore(spark, f"file://{tmp_path}/s", READ)
    assert r.read_meta() == meta and r.number_of_time_steps() == 2 and r.channels() == ["t"] and r.properties() == ["p"] and r.size_mb() > 0
    assert r.read_cells().exceptAll(c.select("level", "z", "x", "y")).count() == 0 and r.read_property("p").count() == c.count()
    assert r.read_cells(tree=True).count() == particles.tree(c).count()
    r.read_delta = 1
    assert r.read_property("p").count() == c.where(F.col("level") < meta.l_max).count()
    with pytest.raises(PermissionError):
        r.write_property("q", c)
    with pytest.raises(TypeError):
        r.read_property("p", kind="int")
    with pytest.raises(ValueError):
        w.write_property("p", c.limit(2))


def test_time_series(small):
    c, _ = small
    a, b = c.where("y % 3 > 0"), c.where("x % 2 = 0").withColumn("v", F.col("v") + (F.col("y") % 2))
    back = timeseries.replay(a, timeseries.delta(a, b).withColumn("t", F.lit(4)), 4)
    assert back.exceptAll(b.select(*back.columns)).count() == 0 and back.count() == b.count()
    assert timeseries.replay(a, timeseries.delta(a, b).withColumn("t", F.lit(4)), 3).count() == a.count()


def test_denoise_keeps_a_constant_and_round_trips(spark, small, tmp_path):
    c, meta = small
    k = denoise.train(c, meta, fine=1, coarse=1)
    denoise.save(spark, k, f"file://{tmp_path}/k")
    again = denoise.load(spark, f"file://{tmp_path}/k")
    assert all(np.array_equal(k[l], again[l]) for l in k)
    assert denoise.apply(c, meta, k).count() == c.count()


def test_spline(spark):
    a = np.full((1, 5, 9), 12.0)
    out = array(convert.smooth_spline(table(spark, a), GridMeta(9, 5), 2.0), a.shape)
    assert np.allclose(out, out[0, 0, 0], rtol=1e-3)
    with pytest.raises(Exception, match="range"):
        convert.smooth_spline(table(spark, a * 1e6), GridMeta(9, 5), 2.0, integer=True).collect()


def test_streaming_grid(spark, tmp_path):
    from quadrille.streaming import gridding

    src = spark.read.parquet(f"{SF}/events.parquet")
    src.repartition(2).write.parquet(f"{tmp_path}/in")
    q = gridding.write_cells(gridding.windowed_cells(gridding.event_stream(spark, f"{tmp_path}/in"), late="5 days"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    # A window is closed once the watermark has passed it; closed ones hold what a batch over all events holds.
    hours = src.groupBy(F.date_trunc("hour", "ts").alias("start")).agg(F.count("*").alias("v"))
    want = {r["start"]: r["v"] for r in hours.collect()}
    rows = got.collect()
    assert set(got.columns) == {"start", "x", "y", "v"} and rows
    for r in rows:
        assert want[r["start"]] == r["v"] and (r["x"], r["y"]) == (r["start"].hour, r["start"].day - 1)


PARITY = ["r013_grid_line", "r026_downsample_odd", "r029_mirror_pad", "r032_window_mean", "r034_smooth_positive", "r035_erode", "r037_fill_holes_by_lines", "r038_gradient", "r039_boundary", "r040_dilate", "r041_convolve_pixels",
          "r050_local_scale", "r066_leaves_g2", "r044_convert_and_sample", "r079_locate", "r080_neighbours", "r088_tree_mean_odd", "r092_push_down", "r094_convolve_reflect", "r100_median", "r105_face_filter", "r117_constant_coarse", "r119_smooth", "r132_lossy_round_trip", "t013_time_delta"]


@pytest.mark.parametrize("name", PARITY)
def test_sql_parity(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "events", "customer"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    a, b = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    order = sorted(a.columns)
    assert order == sorted(b.columns)
    a, b = (x[order].sort_values(order).reset_index(drop=True).astype(str) for x in (a.astype(b.dtypes.to_dict()), b))
    pd.testing.assert_frame_equal(a, b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert AXES == ("z", "x", "y")
