"""Registered queries, named after the inventory rows they cover, with SQL for another engine beside each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.keys import CELL, FACTORS, KEY, PRIME
from quadrille.operators import compress, convert, dense, denoise, filters, particles, reconstruct, timeseries
from quadrille.plans import grids
from quadrille.plans import numerics as num
from quadrille.plans import oracle as o
from quadrille.plans.grids import G1, G2, G3
from quadrille.plans.meta import AXES, GridMeta

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K, C = o.K, o.C

P3 = convert.Parameters(rel_error=1.0, grad_th=80.0, constant_scale=True)
P2 = convert.Parameters(rel_error=1.0, grad_th=1.5, constant_scale=True)
P1 = convert.Parameters(rel_error=8.0, grad_th=0.0, constant_scale=True)
CASES = {"g3": (grids.volume, G3, P3), "g2": (grids.image, G2, P2), "g1": (grids.line, G1, P1)}


def query(name: str, sql: str | Callable[[o.Sql], str] | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            q = o.Sql()
            ORACLES[name] = q.text(sql(q)) if callable(sql) else sql
        return f

    return keep


def r6(c: str = "v") -> str:
    return f"round({c}, 6) AS {c}"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    for n in names or ("v",):
        df = df.withColumn(n, F.round(F.col(n).cast("double"), 6))
    return df


def leaf(spark, d, which: str) -> tuple[DataFrame, DataFrame, GridMeta]:
    """Grid, leaves and geometry of a case."""
    load, meta, p = CASES[which]
    g = load(spark, d)
    return g, convert.convert(g, meta, p, _settle(spark)), meta


def cell(spark, d, which: str, how: str = "mean") -> tuple[DataFrame, GridMeta]:
    g, leaves, meta = leaf(spark, d, which)
    return particles.sample(leaves, g, meta, how), meta


def _settle(s):
    """Cut the lineage in the shared folder that the session names; set one only where there is none."""
    import tempfile

    if not (s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getCheckpointDir()):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quadrille-"))
    return lambda df: df.checkpoint()


def kept(s, d, which: str) -> tuple[DataFrame, GridMeta]:
    """cell(), settled: filters read their input several times."""
    c, meta = cell(s, d, which)
    return _settle(s)(c.select(*CELL, "v")), meta


def s_leaf(q: o.Sql, which: str) -> str:
    _, meta, p = CASES[which]
    return o.leaves(q, which, meta, p.rel_error, p.grad_th)


def s_cell(q: o.Sql, which: str, how: str = "mean") -> str:
    return o.sampled(q, s_leaf(q, which), o.grid(q, which), CASES[which][1], how)


# --- images ------------------------------------------------------------------------

query("r003_slice_scan", lambda q: f"SELECT * FROM {o.grid(q, 'g3')} WHERE z BETWEEN 4 AND 9")(lambda s, d: grids.volume(s, d).where(F.col("z").between(4, 9)))
query("r013_grid_volume", lambda q: f"SELECT * FROM {o.grid(q, 'g3')}")(lambda s, d: grids.volume(s, d))
query("r013_grid_image", lambda q: f"SELECT * FROM {o.grid(q, 'g2')}")(lambda s, d: grids.image(s, d))
query("r013_grid_line", lambda q: f"SELECT * FROM {o.grid(q, 'g1')}")(lambda s, d: grids.line(s, d))

for _how in ("mean", "max", "min", "sum"):
    query(f"r026_downsample_{_how}", lambda q, h=_how: f"SELECT * FROM {o.half(q, o.grid(q, 'g3'), G3, h, 'h')}")(lambda s, d, h=_how: dense.downsample(grids.volume(s, d), G3, h))
query("r026_downsample_odd", lambda q: f"SELECT * FROM {o.half(q, o.grid(q, 'g1'), G1, 'mean', 'h')}")(lambda s, d: dense.downsample(grids.line(s, d), G1, "mean"))
query("r027_pyramid", lambda q: f"SELECT CAST(level AS INTEGER) AS level, {K}, CAST(v AS DOUBLE) AS v FROM {o.pyramid(q, o.grid(q, 'g2'), G2)}")(lambda s, d: dense.pyramid(grids.image(s, d), G2).withColumn("v", F.col("v").cast("double")))
query("r028_upsample", lambda q: f"SELECT rz.z, rx.x, ry.y, h.v FROM {o._axes(G2)} JOIN {o.half(q, o.grid(q, 'g2'), G2, 'max', 'h')} h ON h.z = rz.z // 2 AND h.x = rx.x // 2 AND h.y = ry.y // 2")(
    lambda s, d: dense.upsample(dense.downsample(grids.image(s, d), G2, "max"), G2)
)


def _s_pad(q, by=3):
    g, m = o.grid(q, "g2"), GridMeta(G2.ny + 2 * by, G2.nx + 2 * by)
    src = {a: f"CASE WHEN r{a}.{a} - {by} < 0 THEN {by} - r{a}.{a} WHEN r{a}.{a} - {by} > {G2.size[a] - 1} THEN 2 * {G2.size[a] - 1} - (r{a}.{a} - {by}) ELSE r{a}.{a} - {by} END" for a in "xy"}
    return f"SELECT rz.z, rx.x, ry.y, g.v FROM {o._axes(m)} JOIN {g} g ON g.z = rz.z AND g.x = {src['x']} AND g.y = {src['y']}"


query("r029_mirror_pad", _s_pad)(lambda s, d: dense.pad(grids.image(s, d), G2, {"x": 3, "y": 3, "z": 3})[0])
query("r030_crop", lambda q: f"SELECT z, CAST(x - 2 AS INTEGER) AS x, CAST(y - 5 AS INTEGER) AS y, v FROM {o.grid(q, 'g2')} WHERE x BETWEEN 2 AND 20 AND y BETWEEN 5 AND 24")(
    lambda s, d: dense.crop(grids.image(s, d), {"x": 2, "y": 5}, {"x": 21, "y": 25})
)
query("r031_normalise", lambda q: f"SELECT {K}, round(CAST(v AS DOUBLE) / (SELECT sum(v) FROM {o.grid(q, 'g2')}), 9) AS v FROM g2")(
    lambda s, d: dense.normalise(grids.image(s, d).withColumn("v", F.col("v").cast("double"))).withColumn("v", F.round("v", 9))
)
query("r031_unary_map", lambda q: f"SELECT {K}, v * v + 1 AS v FROM {o.grid(q, 'g2')}")(lambda s, d: dense.map_values(grids.image(s, d), lambda v: v * v + 1))
query(
    "r032_window_mean",
    lambda q: f"SELECT a.z, a.x, a.y, round(avg(b.v), 6) AS v FROM {o.grid(q, 'g2')} a JOIN g2 b ON b.x BETWEEN a.x - 2 AND a.x + 2 AND b.y BETWEEN a.y - 1 AND a.y + 1 GROUP BY 1, 2, 3",
)(lambda s, d: rounded(dense.window_mean(grids.image(s, d), {"y": 1, "x": 2})))


def _s_clamped(q, which, meta, expr):
    g = o.grid(q, which)
    offs = " CROSS JOIN ".join(f"(VALUES (-1), (0), (1)) o{a}(d{a})" for a in AXES)
    on = " AND ".join(f"b.{a} = least(greatest(a.{a} + d{a}, 0), {meta.size[a] - 1})" for a in AXES)
    return f"SELECT a.z, a.x, a.y, {expr} FROM {g} a CROSS JOIN {offs} JOIN {g} b ON {on} GROUP BY a.z, a.x, a.y"


query("r034_smooth", lambda q: _s_clamped(q, "g2", G2, "round(sum(b.v) / 27.0, 6) AS v"))(lambda s, d: rounded(dense.smooth(grids.image(s, d), G2)))
query("r034_smooth_positive", lambda q: _s_clamped(q, "lab", G2, "round(CASE WHEN count(*) FILTER (b.v > 0) > 0 THEN CAST(sum(b.v) FILTER (b.v > 0) AS DOUBLE) / count(*) FILTER (b.v > 0) ELSE 0.0 END, 6) AS v"))(
    lambda s, d: rounded(dense.smooth_positive(grids.labels(s, d), G2))
)


def _s_erode(q):
    core = q.add("core", _s_clamped(q, "lab", G2, "any_value(a.v) AS v, CAST(count(*) FILTER (b.v > 0) = 27 AS INTEGER) AS core"))
    return f"SELECT a.z, a.x, a.y, CASE WHEN any_value(a.v) > 0 AND any_value(a.core) = 0 AND max(b.core) > 0 THEN 0 ELSE any_value(a.v) END AS v FROM {core} a JOIN {core} b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 GROUP BY 1, 2, 3"


query("r035_erode", _s_erode)(lambda s, d: dense.erode(grids.labels(s, d), G2))
query("r036_fill_holes_by_tree", lambda q: f"SELECT {K}, {r6()} FROM {num.fill_holes_by_tree(q, o.grid(q, 'lab'), G2)}")(lambda s, d: rounded(dense.fill_holes_by_tree(grids.labels(s, d), G2)))


def _s_fill(q):
    g, sums, n = o.grid(q, "lab"), ["1000.0"], ["1"]
    for a in AXES:
        part = f"PARTITION BY {', '.join(b for b in AXES if b != a)} ORDER BY {a}"
        for f in (f"last_value(nullif(v, 0) IGNORE NULLS) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", f"first_value(nullif(v, 0) IGNORE NULLS) OVER ({part} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"):
            sums.append(f"coalesce({f}, 0)")
            n.append(f"CASE WHEN {f} IS NULL THEN 0 ELSE 1 END")
    return f"SELECT {K}, round(CASE WHEN v > 0 THEN CAST(v AS DOUBLE) ELSE CAST({' + '.join(sums)} AS DOUBLE) / ({' + '.join(n)}) END, 6) AS v FROM {g}"


query("r037_fill_holes_by_lines", _s_fill)(lambda s, d: rounded(dense.fill_holes_by_lines(grids.labels(s, d))))


def _s_gradient(q):
    g, out = o.grid(q, "g2"), []
    for a in AXES:
        b, f = f"(v - {o.lag(a)})", f"({o.lag(a, f='lead')} - v)"
        out.append(f"CASE WHEN {b} IS NULL THEN CAST({f} AS DOUBLE) WHEN {f} IS NULL THEN {b} ELSE ({b} + {f}) / 2.0 END AS d{a}")
    return f"SELECT {K}, {', '.join(out)} FROM {g}"


query("r038_gradient", _s_gradient)(lambda s, d: dense.gradient(grids.image(s, d)))


def _faces_sql(v="v"):
    return [o.lag(a, v, f) for a in ("y", "x", "z") for f in ("lag", "lead")]


query("r039_boundary", lambda q: f"SELECT {K}, CASE WHEN {' OR '.join(f'coalesce({f} <> v, false)' for f in _faces_sql())} THEN v ELSE 0 END AS v FROM {o.grid(q, 'lab')}")(lambda s, d: dense.boundary(grids.labels(s, d)))
query("r040_dilate", lambda q: f"SELECT {K}, CASE WHEN v <> 0 THEN v ELSE coalesce({', '.join(f'nullif({f}, 0)' for f in _faces_sql())}, 0) END AS v FROM {o.grid(q, 'lab')}")(lambda s, d: dense.dilate(grids.labels(s, d)))

_KERNEL = [(0, a, b, w) for (a, b, w) in ((-1, -1, 0.0625), (-1, 0, 0.125), (-1, 1, 0.0625), (0, -1, 0.125), (0, 0, 0.25), (0, 1, 0.125), (1, -1, 0.0625), (1, 0, 0.125), (1, 1, 0.0625))]
query(
    "r041_convolve_pixels",
    lambda q: f"SELECT a.z, a.x, a.y, sum(s.w * b.v) AS v FROM {o.grid(q, 'g2')} a CROSS JOIN (VALUES {', '.join(f'({x}, {y}, CAST({w!r} AS DOUBLE))' for _, x, y, w in _KERNEL)}) s(ox, oy, w) JOIN g2 b ON b.x = a.x + s.ox AND b.y = a.y + s.oy GROUP BY 1, 2, 3",
)(lambda s, d: dense.convolve(grids.image(s, d), G2, _KERNEL))
query("r042_min_nonzero", lambda q: f"SELECT {K}, CASE WHEN v = 0 THEN 7 ELSE least(v, 7) END AS v FROM {o.grid(q, 'g2')}")(lambda s, d: dense.map_values(grids.image(s, d), lambda v: dense.min_nz(v, F.lit(7).cast("long"))))
query("r043_min_max", lambda q: f"SELECT min(v) AS lo, max(v) AS hi FROM {o.grid(q, 'g3')}")(lambda s, d: dense.min_max(grids.volume(s, d)))


# --- conversion --------------------------------------------------------------------

def _s_inverse(q):
    prev = o.grid(q, "g2")
    for a in ("y", "x"):
        b, f = o.lag(a), o.lag(a, f="lead")
        prev = q.add(f"inv_{a}", f"SELECT {K}, (coalesce({b}, {f}) + 4 * v + coalesce({f}, {b})) / 6.0 AS v FROM {prev}")
    return prev


query("r048_inverse_spline", lambda q: f"SELECT {K}, {r6()} FROM {_s_inverse(q)}")(lambda s, d: rounded(convert.inverse_spline(grids.image(s, d), G2)))
query("r046_spline_offset", lambda q: f"SELECT CAST(least(greatest(-(min(v) + max(v)) / 2.0, -100), 100) AS DOUBLE) AS o FROM {o.grid(q, 'g2')}")(lambda s, d: s.createDataFrame([(convert.spline_offset(grids.image(s, d), 1.0),)], "o double"))
query("r047_smoothing_spline", lambda q: f"SELECT {K}, {r6()} FROM {num.spline(q, o.grid(q, 'g2'), G2, *convert.spline_coefficients(2.0))}")(lambda s, d: rounded(convert.smooth_spline(grids.image(s, d), G2, 2.0)))
query("r049_gradient_magnitude_half", lambda q: f"SELECT {K}, {r6()} FROM {o.gradient_half(q, o.grid(q, 'g3'), G3, 'gh')}")(lambda s, d: rounded(convert.gradient_magnitude_half(grids.volume(s, d), G3)))


def _s_scale(q):
    first, second, factor = convert.windows(G2.half(), 1.0)
    prev = o.half(q, o.grid(q, "g2"), G2, "mean", "half")
    prev = q.add("s0", f"SELECT {K}, v, v AS i FROM {prev}")
    for a in ("y", "x"):
        prev = q.add(f"m1{a}", f"SELECT {K}, {o.around(a, first[a], 'avg')} AS v, i FROM {prev}")
    prev = q.add("dif", f"SELECT {K}, abs(v - i) AS v FROM {prev}")
    for a in ("y", "x"):
        prev = q.add(f"m2{a}", f"SELECT {K}, {o.around(a, second[a], 'avg')} AS v FROM {prev}")
    return f"SELECT {K}, round(v * {factor}, 6) AS v FROM {prev}"


query("r050_local_scale", _s_scale)(lambda s, d: rounded(convert.local_scale(dense.downsample(grids.image(s, d), G2), G2.half())))
query("r051_box_mean", lambda q: f"SELECT a.z, a.x, a.y, round(avg(b.v), 6) AS v FROM {o.grid(q, 'g1')} a JOIN g1 b ON b.y BETWEEN a.y - 3 AND a.y + 3 GROUP BY 1, 2, 3")(lambda s, d: rounded(dense.box_mean(grids.line(s, d), "y", 3)))
query("r052_windows", "SELECT CAST(i AS INTEGER) AS psf, CAST(a AS INTEGER) AS r1, CAST(b AS INTEGER) AS r2, CAST(f AS DOUBLE) AS factor FROM (VALUES (1, 1, 2, 12.8214), (2, 1, 3, 26.1256), (3, 1, 4, 40.2795), (4, 2, 4, 23.3692), (5, 2, 5, 36.2061), (6, 3, 6, 27.0385)) t(i, a, b, f)")(
    lambda s, d: s.createDataFrame([(i, w[0]["y"], w[1]["y"], w[2]) for i in range(1, 7) for w in [convert.windows(GridMeta(64, 64, 16), float(i))]], "psf int, r1 int, r2 int, factor double")
)
query("r054_constant_scale", lambda q: f"SELECT avg(v) - min(v) AS v FROM {o.half(q, o.grid(q, 'g3'), G3, 'mean', 'h')}")(
    lambda s, d: convert.local_scale(dense.downsample(grids.volume(s, d), G3), G3.half(), P3).groupBy("v").count().select("v")
)
query(
    "r055_mask_gradient",
    lambda q: f"SELECT g.z, g.x, g.y, round(CASE WHEN m.v = 0 THEN 0.0 ELSE g.v END, 6) AS v FROM {o.gradient_half(q, o.grid(q, 'g2'), G2, 'gr')} g JOIN {o.half(q, o.grid(q, 'lab'), G2, 'max', 'mask')} m ON m.z = g.z AND m.x = g.x AND m.y = g.y",
)(lambda s, d: rounded(convert.mask_gradient(convert.gradient_magnitude_half(grids.image(s, d), G2), grids.labels(s, d), G2)))
query(
    "r056_threshold_gradient",
    lambda q: f"SELECT g.z, g.x, g.y, round(CASE WHEN m.v <= 10 THEN 0.0 ELSE g.v END, 6) AS v FROM {o.gradient_half(q, o.grid(q, 'g2'), G2, 'gr')} g JOIN {o.half(q, o.grid(q, 'g2'), G2, 'mean', 'im')} m ON m.z = g.z AND m.x = g.x AND m.y = g.y",
)(lambda s, d: rounded(convert.threshold_gradient(convert.gradient_magnitude_half(grids.image(s, d), G2), dense.downsample(grids.image(s, d), G2), 10.0)))


def _fields2(s, d):
    g = grids.image(s, d)
    a = convert.gradient_magnitude_half(g, G2).withColumnRenamed("v", "grad")
    return a.join(dense.downsample(g, G2).withColumnRenamed("v", "scale"), KEY)


query(
    "r057_apply_parameters",
    lambda q: f"SELECT g.z, g.x, g.y, round(CASE WHEN g.v < 2 THEN 0.0 ELSE g.v END, 6) AS grad, round(CASE WHEN m.v < 12 THEN CASE WHEN m.v < 6 THEN 60000.0 ELSE 12.0 END ELSE m.v END, 6) AS scale FROM {o.gradient_half(q, o.grid(q, 'g2'), G2, 'gr')} g JOIN {o.half(q, o.grid(q, 'g2'), G2, 'mean', 'im')} m ON m.z = g.z AND m.x = g.x AND m.y = g.y",
)(lambda s, d: rounded(convert.apply_parameters(_fields2(s, d), convert.Parameters(grad_th=2.0, sigma_th=12.0, sigma_th_max=6.0)), "grad", "scale"))
def _s_auto(q):
    g, i = o.gradient_half(q, o.grid(q, "g2"), G2, "gr"), o.half(q, o.grid(q, "g2"), G2, "mean", "im")
    q.add("fo", f"SELECT g.v AS grad, i.v AS scale FROM {g} g JOIN {i} i ON i.z = g.z AND i.x = g.x AND i.y = g.y WHERE i.v > 1.0")
    a, b = (num.threshold_li(q, "fo", c, False, convert.BINS, f"li_{c}") for c in ("grad", "scale"))
    return f"SELECT round({a}, 4) AS grad_th, round({b}, 4) AS sigma_th"


query("r058_auto_parameters", _s_auto)(lambda s, d: _auto(s, d))


def _auto(s, d):
    p = convert.auto_parameters(_fields2(s, d), dense.downsample(grids.image(s, d), G2), convert.Parameters(intensity_th=1.0))
    return s.createDataFrame([(round(p.grad_th, 4), round(p.sigma_th, 4))], "grad_th double, sigma_th double")


query("r059_threshold_li", lambda q: f"SELECT round({num.threshold_li(q, o.grid(q, 'g3'), 'v', True, convert.BINS, 'li')}, 4) AS t")(lambda s, d: s.createDataFrame([(round(convert.threshold_li(grids.volume(s, d), integer=True), 4),)], "t double"))


def _req(s, d, which):
    load, meta, p = CASES[which]
    both, _ = convert.fields(load(s, d), meta, p)
    return convert.levels(convert.apply_parameters(both, p), meta, p), meta


def _s_req(q, which):
    _, meta, p = CASES[which]
    return o.required(q, o.grid(q, which), meta, p.rel_error, p.grad_th)


for _w in ("g3", "g2", "g1"):
    query(f"r060_levels_{_w}", lambda q, w=_w: f"SELECT * FROM {_s_req(q, w)}")(lambda s, d, w=_w: _req(s, d, w)[0])
    query(f"r063_solve_{_w}", lambda q, w=_w: f"SELECT CAST(level AS INTEGER) AS level, {K}, type FROM {o.solve(q, _s_req(q, w), CASES[w][1])}")(lambda s, d, w=_w: convert.solve(*_req(s, d, w)))
    query(f"r066_leaves_{_w}", lambda q, w=_w: f"SELECT * FROM {s_leaf(q, w)}")(lambda s, d, w=_w: leaf(s, d, w)[1])
query("r061_level_pyramid", lambda q: f"SELECT CAST(level AS INTEGER) AS level, {K}, v FROM {o.level_pyramid(q, _s_req(q, 'g2'), G2)}")(lambda s, d: convert.level_pyramid(*_req(s, d, "g2")).select(*CELL, "v"))
query("r062_seeds", lambda q: f"SELECT CAST(level AS INTEGER) AS level, {K}, CASE WHEN (level = 4 AND v >= 4) OR (level = 1 AND v <= 1) OR (level IN (2, 3) AND v = level) THEN 1 ELSE 0 END AS type FROM {o.level_pyramid(q, _s_req(q, 'g2'), G2)}")(
    lambda s, d: convert.fill_seeds(convert.level_pyramid(*_req(s, d, "g2")), G2).select(*CELL, "type")
)
query("r066_leaves_without_neighbourhood", lambda q: f"SELECT * FROM {o.to_leaves(q, o.solve(q, _s_req(q, 'g2'), G2), G2, 'type <= 2')}")(lambda s, d: convert.leaves(*_req(s, d, "g2"), neighbourhood=False))
query("r067_tiny_grid", "SELECT CAST(2 AS INTEGER) AS level, CAST(0 AS INTEGER) AS z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM (SELECT unnest(range(3)) AS x) CROSS JOIN (SELECT unnest(range(4)) AS y)")(
    lambda s, d: convert.convert(grids.cells(s, GridMeta(4, 3)).withColumn("v", F.lit(1)), GridMeta(4, 3))
)


def _s_custom(q):
    g, i = o.gradient_half(q, o.grid(q, "g2"), G2, "cg"), o.half(q, o.grid(q, "g2"), G2, "max", "ci")
    e = f"CASE WHEN i.v > 0 THEN g.v / i.v * {32.0 / 2.0!r} WHEN g.v > 0 THEN 4294967295.0 ELSE 0.0 END"
    q.add("creq", f"SELECT g.z, g.x, g.y, CAST(length(bin(CAST(floor({e}) AS BIGINT))) - 1 AS INTEGER) AS v FROM {g} g JOIN {i} i ON g.z = i.z AND g.x = i.x AND g.y = i.y")
    return f"SELECT * FROM {o.to_leaves(q, o.solve(q, 'creq', G2), G2)}"


query("r068_custom_fields", _s_custom)(lambda s, d: convert.convert_custom(convert.gradient_magnitude_half(grids.image(s, d), G2), dense.downsample(grids.image(s, d), G2, "max"), G2, convert.Parameters(rel_error=2.0)))


# --- structure ---------------------------------------------------------------------


def _flagship(s, d):
    c, _ = cell(s, d, "g3")
    return c.groupBy("level").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


query("r044_convert_and_sample", lambda q: f"SELECT level, count(*) AS n, sum(v) AS total FROM {s_cell(q, 'g3')} GROUP BY level")(_flagship)

query("r018_linear_access", lambda q: f"SELECT level, z, x, list(y ORDER BY y) AS y, CAST(sum(count(*)) OVER (ORDER BY level, z, x) AS BIGINT) AS row_end FROM {s_leaf(q, 'g2')} GROUP BY level, z, x")(lambda s, d: particles.linear_access(leaf(s, d, "g2")[1]))


def _s_runs(q):
    q.add("isl", f"SELECT {C}, y - row_number() OVER (PARTITION BY level, z, x ORDER BY y) AS i FROM {s_leaf(q, 'g2')}")
    return "SELECT level, z, x, min(y) AS y_begin, max(y) AS y_end FROM isl GROUP BY level, z, x, i"


query("r019_random_access", _s_runs)(lambda s, d: particles.random_access(leaf(s, d, "g2")[1]))
query("r072_tree", lambda q: f"SELECT * FROM {o.tree(q, s_leaf(q, 'g3'))}")(lambda s, d: particles.tree(leaf(s, d, "g3")[1]))
query("r073_numbered", lambda q: f"SELECT {C}, CAST(row_number() OVER (ORDER BY level, z, x, y) - 1 AS BIGINT) AS pid FROM {s_leaf(q, 'g3')}")(lambda s, d: particles.numbered(leaf(s, d, "g3")[1]))
query("r074_row_scan", lambda q: f"SELECT * FROM {s_leaf(q, 'g3')} WHERE level = 5 AND z = 2 AND x = 3")(lambda s, d: particles.row_scan(leaf(s, d, "g3")[1], 5, 2, 3))
query("r075_level_ranges", lambda q: f'SELECT level, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY level) - count(*) AS BIGINT) AS "begin", CAST(sum(count(*)) OVER (ORDER BY level) AS BIGINT) AS "end" FROM {s_leaf(q, "g3")} GROUP BY level')(
    lambda s, d: particles.level_ranges(leaf(s, d, "g3")[1])
)


def _s_coords(q):
    cols = []
    for a in AXES:
        cols += [f"({a} + 0.5) * (1 << (5 - level)) AS {a}_global", f"CAST(floor(({a} + 0.5) * (1 << (5 - level))) AS INTEGER) AS {a}_pixel"]
    return f"SELECT {C}, CAST(1 << (5 - level) AS INTEGER) AS size, {', '.join(c.replace('+ 0.5)', '+ CAST(0.5 AS DOUBLE))') for c in cols)} FROM {s_leaf(q, 'g2')}"


query("r076_coordinates", _s_coords)(lambda s, d: particles.coordinates(leaf(s, d, "g2")[1], G2))
query("r077_ratio", lambda q: f"SELECT 65536.0::DOUBLE / count(*) AS ratio FROM {s_leaf(q, 'g3')}")(lambda s, d: particles.computational_ratio(leaf(s, d, "g3")[1], G3))
query("r078_find_cells", lambda q: f"SELECT * FROM {s_leaf(q, 'g2')} WHERE x % 2 = 0 AND level = 4")(
    lambda s, d: particles.find_cells(grids.cells(s, G2.at(4)).where("x % 2 = 0").select(F.lit(4).alias("level"), *KEY), leaf(s, d, "g2")[1])
)


def _points(s, d):
    t = grids.read(s, d, "customer")
    return t.select(F.col("c_custkey").alias("id"), F.lit(0.0).alias("pz"), (F.col("c_nationkey") + 0.5).alias("px"), (F.col("c_custkey") % 33).cast("double").alias("py"))


query(
    "r079_locate",
    lambda q: f"SELECT c_custkey AS id, {', '.join(f'l.{a}' for a in ('level', *AXES))} FROM customer JOIN {s_leaf(q, 'g2')} l ON c_nationkey >= l.x * (1 << (5 - l.level)) AND c_nationkey < (l.x + 1) * (1 << (5 - l.level)) AND c_custkey % 33 >= l.y * (1 << (5 - l.level)) AND c_custkey % 33 < (l.y + 1) * (1 << (5 - l.level)) WHERE c_nationkey < 24 AND c_custkey % 33 < {G2.ny}",
)(lambda s, d: particles.locate(_points(s, d), leaf(s, d, "g2")[1], G2).select("id", *CELL))


def _s_neigh(q, lf, meta, name="nb"):
    """Two leaves touch over a face where their pixel boxes do."""
    size = f"(1 << ({meta.l_max} - {{t}}.level))"
    sa, sb = size.format(t="a"), size.format(t="b")
    parts = []
    for face, (ax, sign) in particles.FACES.items():
        if meta.size[ax] == 1:
            continue
        touch = f"b.{ax} * {sb} = (a.{ax} + 1) * {sa}" if sign > 0 else f"(b.{ax} + 1) * {sb} = a.{ax} * {sa}"
        over = " AND ".join(f"b.{c} * {sb} < (a.{c} + 1) * {sa} AND (b.{c} + 1) * {sb} > a.{c} * {sa}" for c in AXES if c != ax and meta.size[c] > 1) or "true"
        parts.append(f"SELECT a.level, a.z, a.x, a.y, '{face}' AS face, b.level AS nl, b.z AS nz, b.x AS nx, b.y AS ny FROM {lf} a JOIN {lf} b ON {touch} AND {over} AND abs(a.level - b.level) <= 1")
    return q.add(name, " UNION ALL ".join(parts))


query("r080_neighbours", lambda q: f"SELECT * FROM {_s_neigh(q, s_leaf(q, 'g2'), G2)}")(lambda s, d: particles.neighbours(kept(s, d, "g2")[0], G2).select(*CELL, "face", "nl", "nz", "nx", "ny"))
query("r081_number_of_neighbours", lambda q: f"SELECT {C}, face, count(*) AS n FROM {_s_neigh(q, s_leaf(q, 'g2'), G2)} GROUP BY {C}, face")(lambda s, d: particles.neighbours(kept(s, d, "g2")[0], G2).groupBy(*CELL, "face").agg(F.count("*").alias("n")))
query("r082_same_level_neighbours", lambda q: f"SELECT {C}, face, nz, nx, ny FROM {_s_neigh(q, s_leaf(q, 'g2'), G2)} WHERE nl = level")(lambda s, d: particles.same_level_neighbours(kept(s, d, "g2")[0], G2))


def _s_tree_neigh(q, name="tn"):
    t = o.tree(q, s_leaf(q, "g2"))
    parts = [f"SELECT a.level, a.z, a.x, a.y, '{f}' AS face, b.z AS nz, b.x AS nx, b.y AS ny FROM {t} a JOIN {t} b ON a.level = b.level AND " + " AND ".join(f"b.{c} = a.{c} + {sg if c == ax else 0}" for c in AXES) for f, (ax, sg) in particles.FACES.items()]
    return q.add(name, " UNION ALL ".join(parts))


query("r083_tree_neighbours", lambda q: f"SELECT * FROM {_s_tree_neigh(q)}")(lambda s, d: particles.same_level_neighbours(particles.tree(leaf(s, d, "g2")[1]), G2))
query("r086_tile", lambda q: f"SELECT level, z, CAST(x + i * (64 >> (6 - level)) AS INTEGER) AS x, y FROM (SELECT CAST(level + 1 - 1 AS INTEGER) AS level, z, x, y FROM {s_leaf(q, 'g3')}) CROSS JOIN (VALUES (0), (1)) t(i)")(lambda s, d: _tiled(s, d))


def _tiled(s, d):
    # Two copies along x; the doubled grid has one more level, so levels are given relative to the old ones.
    out, big = particles.tile(leaf(s, d, "g3")[1], G3, {"x": 2})
    return out.withColumn("level", F.col("level") - (big.l_max - G3.l_max))


# --- values --------------------------------------------------------------------------

for _how in ("mean", "max"):
    query(f"r087_sample_{_how}", lambda q, h=_how: f"SELECT {C}, CAST(v AS DOUBLE) AS v FROM {s_cell(q, 'g3', h)}")(lambda s, d, h=_how: cell(s, d, "g3", h)[0].withColumn("v", F.col("v").cast("double")))


def _s_labels(q):
    lf, lab = s_leaf(q, "g2"), o.grid(q, "lab")
    b = q.add("bd", f"SELECT {K}, CASE WHEN {' OR '.join(f'coalesce({f} <> v, false)' for f in _faces_sql())} THEN v ELSE 0 END AS v FROM {lab}")
    b = q.add("bd1", f"SELECT {K}, CASE WHEN v <> 0 THEN v ELSE coalesce({', '.join(f'nullif({f}, 0)' for f in _faces_sql())}, 0) END AS v FROM {b}")
    x, y = o.sampled(q, lf, lab, G2, "max", "lc"), o.sampled(q, lf, b, G2, "max", "bc")
    return f"SELECT l.level, l.z, l.x, l.y, CAST(CASE WHEN b.v <> 0 THEN 2 WHEN l.v <> 0 THEN 1 ELSE 0 END AS BIGINT) AS v FROM {x} l JOIN {y} b ON l.level = b.level AND l.z = b.z AND l.x = b.x AND l.y = b.y"


query("r087b_sample_labels", _s_labels)(lambda s, d: particles.sample_labels(leaf(s, d, "g2")[1], grids.labels(s, d), G2, True, 1))
query("r087c_levels", lambda q: f"SELECT {C}, level AS v FROM {s_leaf(q, 'g2')}")(lambda s, d: particles.with_levels(leaf(s, d, "g2")[1]))
query("r087d_map_level", lambda q: f"SELECT {C}, CASE WHEN level = 4 THEN v * 2 + 1 ELSE v END AS v FROM {s_cell(q, 'g2')}")(lambda s, d: particles.map_cells(cell(s, d, "g2")[0].withColumn("v", F.col("v").cast("double")), lambda v: v * 2 + 1, 4))
query("r087e_zip", lambda q: f"SELECT a.level, a.z, a.x, a.y, a.v - b.v AS v FROM {s_cell(q, 'g2')} a JOIN {o.sampled(q, s_leaf(q, 'g2'), o.grid(q, 'g2'), G2, 'max', 'mx')} b ON a.level = b.level AND a.z = b.z AND a.x = b.x AND a.y = b.y")(
    lambda s, d: particles.zip_cells(cell(s, d, "g2")[0], cell(s, d, "g2", "max")[0], lambda a, b: a - b)
)
query("r087f_level_copy", lambda q: f"SELECT {C}, v FROM {s_cell(q, 'g2')} WHERE level = 4")(lambda s, d: cell(s, d, "g2")[0].where("level = 4").select(*CELL, "v"))
query("r087g_nested_rows", lambda q: f"SELECT level, z, x, list(y ORDER BY y) AS y, list(CAST(v AS DOUBLE) ORDER BY y) AS v FROM {s_cell(q, 'g2')} GROUP BY level, z, x")(lambda s, d: particles.rows_as_arrays(cell(s, d, "g2")[0].withColumn("v", F.col("v").cast("double"))))


# --- tree ----------------------------------------------------------------------------

query("r088_tree_mean", lambda q: f"SELECT CAST(level AS INTEGER) AS level, {K}, {r6()} FROM {o.tree_mean(q, s_cell(q, 'g3'), G3)}")(lambda s, d: rounded(particles.tree_mean(*cell(s, d, "g3"))))
query("r088_tree_mean_odd", lambda q: f"SELECT CAST(level AS INTEGER) AS level, {K}, {r6()} FROM {o.tree_mean(q, s_cell(q, 'g1'), G1)}")(lambda s, d: rounded(particles.tree_mean(*cell(s, d, "g1"))))
for _n, _how in (("r089_tree_sum", "sum"), ("r090_tree_max", "max"), ("r091_tree_min", "min")):
    query(_n, lambda q, h=_how: f"SELECT {C}, CAST(v AS DOUBLE) AS v FROM {o.tree_fold(q, s_cell(q, 'g2'), h, 'tf')}")(lambda s, d, h=_how: particles.fold_tree(cell(s, d, "g2")[0].withColumn("v", F.col("v").cast("double")), h))


def _s_push(q, n=2):
    t = o.tree_fold(q, s_cell(q, "g2"), "max", "tf")
    start = max(0, G2.l_max - 1 - n)
    on = " AND ".join(f"a.{c} = (t.{c} >> greatest(t.level - {start}, 0))" for c in AXES)
    return q.add("pd", f"SELECT t.level, t.z, t.x, t.y, a.v FROM {t} t JOIN {t} a ON a.level = least(t.level, {start}) AND {on}")


query("r092_push_down", lambda q: f"SELECT {C}, CAST(v AS DOUBLE) AS v FROM {_s_push(q)}")(lambda s, d: particles.push_down(particles.fold_tree(cell(s, d, "g2")[0].withColumn("v", F.col("v").cast("double")), "max"), G2, 2))
query("r093_push_to_leaves", lambda q: f"SELECT l.level, l.z, l.x, l.y, CAST(t.v AS DOUBLE) AS v FROM {s_leaf(q, 'g2')} l JOIN {_s_push(q)} t ON t.level = l.level - 1 AND " + " AND ".join(f"t.{c} = l.{c} // 2" for c in AXES))(
    lambda s, d: _push_leaves(s, d)
)


def _push_leaves(s, d):
    c = cell(s, d, "g2")[0].withColumn("v", F.col("v").cast("double"))
    return particles.push_to_leaves(c, particles.push_down(particles.fold_tree(c, "max"), G2, 2))


# --- filters -------------------------------------------------------------------------


def s_dense(q, which, inner=None, c=None):
    c = c or s_cell(q, which)
    meta = CASES[which][1]
    return c, o.dense_levels(q, c, inner or o.tree_mean(q, c, meta), meta), meta


def s_stencil(q, kernels, meta, name="st"):
    return o.stencil(q, [(l, *r) for l in range(meta.l_min, meta.l_max + 1) for r in filters.rows_of(kernels[min(len(kernels) - 1, meta.l_max - l)])], name)


def s_conv(q, which, kernels, reflect, name="cv"):
    c, den, meta = s_dense(q, which)
    return o.convolved(q, c, den, s_stencil(q, kernels, meta, f"{name}_st"), meta, reflect, name)


_G5 = filters.gaussian(1.0, {"z": 1, "x": 5, "y": 5})
_G5L = filters.gaussian(1.0, {"z": 1, "x": 1, "y": 5})
query("r094_convolve_reflect", lambda q: f"SELECT {C}, {r6()} FROM {s_conv(q, 'g2', [_G5], True)}")(lambda s, d: rounded(filters.convolve(*kept(s, d, "g2"), _G5, True)))
query("r095_convolve_zero", lambda q: f"SELECT {C}, {r6()} FROM {s_conv(q, 'g2', [_G5], False)}")(lambda s, d: rounded(filters.convolve(*kept(s, d, "g2"), _G5, False)))
query("r096_convolve_downsampled", lambda q: f"SELECT {C}, {r6()} FROM {s_conv(q, 'g2', filters.downsampled_kernels(_G5, G2, True), True)}")(lambda s, d: rounded(filters.convolve_downsampled(*kept(s, d, "g2"), _G5, True, True)))
query("r098_convolve_line", lambda q: f"SELECT {C}, {r6()} FROM {s_conv(q, 'g1', [_G5L], True)}")(lambda s, d: rounded(filters.convolve(*kept(s, d, "g1"), _G5L, True)))
query("r137_convolve_volume", lambda q: f"SELECT {C}, {r6()} FROM {s_conv(q, 'g3', [filters.mean_kernel(3)], True)}")(lambda s, d: rounded(filters.convolve(*kept(s, d, "g3"), filters.mean_kernel(3), True)))


def _s_sep(q):
    k = filters.gaussian(1.0, {"z": 1, "x": 1, "y": 3})
    first = s_conv(q, "g2", [k], True, "c1")
    inner = o.tree_mean(q, first, G2, "tm2")
    den = o.dense_levels(q, first, inner, G2, "den2")
    return o.convolved(q, first, den, s_stencil(q, [k.transpose(0, 2, 1)], G2, "st2"), G2, True, "c2")


def _sep(s, d):
    k = filters.gaussian(1.0, {"z": 1, "x": 1, "y": 3})
    return filters.convolve_separable(*kept(s, d, "g2"), {"y": [k], "x": [k.transpose(0, 2, 1)]}, True, _settle(s))


query("r097_convolve_separable", lambda q: f"SELECT {C}, {r6()} FROM {_s_sep(q)}")(lambda s, d: rounded(_sep(s, d)))
_BOX = {"z": 1, "x": 3, "y": 5}


def s_patch(q, inner):
    c = s_cell(q, "g2")
    _, den, meta = s_dense(q, "g2", o.tree_mean(q, c, G2) if inner is None else o.tree_fold(q, c, inner, "tf"), c)
    return o.gathered(q, c, den, s_stencil(q, [filters.mean_kernel(_BOX)], meta), meta, True, "pt")


query("r099_generic_range", lambda q: f"SELECT {C}, round(max(nv) - min(nv), 6) AS v FROM {s_patch(q, None)} GROUP BY {C}")(
    lambda s, d: rounded(filters.generic_filter(*kept(s, d, "g2"), _BOX, lambda p: F.array_max(p) - F.array_min(p)))
)
query("r100_median", lambda q: f"SELECT {C}, round(list_sort(list(nv))[count(*) // 2 + 1], 6) AS v FROM {s_patch(q, None)} GROUP BY {C}")(lambda s, d: rounded(filters.median_filter(*kept(s, d, "g2"), _BOX)))
query("r101_min_filter", lambda q: f"SELECT {C}, {r6('v')} FROM (SELECT {C}, min(nv) AS v FROM {s_patch(q, 'min')} GROUP BY {C})")(lambda s, d: rounded(filters.min_filter(*kept(s, d, "g2"), _BOX)))
query("r101_max_filter", lambda q: f"SELECT {C}, {r6('v')} FROM (SELECT {C}, max(nv) AS v FROM {s_patch(q, 'max')} GROUP BY {C})")(lambda s, d: rounded(filters.max_filter(*kept(s, d, "g2"), _BOX)))
_W = "CAST(oz AS INTEGER) AS oz, CAST(ox AS INTEGER) AS ox, CAST(oy AS INTEGER) AS oy, round(CAST(w AS DOUBLE), 6) AS w"
_SIZE5 = {"z": 1, "x": 5, "y": 5}
query("r102_downsampled_stencils", lambda q: f"SELECT CAST(level AS INTEGER) AS level, {_W} FROM {num.downsampled(q, num.gaussian(_SIZE5, 1.0, 'ga', q), _SIZE5, G2, 'ds')}")(lambda s, d: rounded(filters.stencil_table(s, filters.downsampled_kernels(_G5, G2), G2), "w"))
query("r103_rescaled_stencils", f"SELECT CAST(level AS INTEGER) AS level, CAST(0 AS INTEGER) AS oz, CAST(0 AS INTEGER) AS ox, CAST(o AS INTEGER) AS oy, round(o / 2.0 / (1 << least({G2.l_max} - level, {G2.l_max - 2})), 6) AS w FROM (SELECT unnest(range(1, {G2.l_max + 1})) AS level) CROSS JOIN (VALUES (-1), (0), (1)) t(o)")(lambda s, d: rounded(filters.stencil_table(s, filters.rescaled_kernels(filters.difference("y"), G2), G2), "w"))
_TRIPLE = "(VALUES (-1), (0), (1)) z(oz) CROSS JOIN (VALUES (-1), (0), (1)) x(ox) CROSS JOIN (VALUES (-1), (0), (1)) y(oy)"
_SMOOTHING = lambda a: f"CASE o{a} WHEN 0 THEN 0.5 ELSE 0.25 END"


def _s_kernels(q):
    num.gaussian({"z": 3, "x": 3, "y": 3}, 1.0, "ga", q)
    parts = [f"SELECT 'gauss' AS name, {_W} FROM ga", f"SELECT 'mean', {_W.replace('CAST(w AS DOUBLE)', '1.0 / 27')} FROM {_TRIPLE}"]
    parts.append(f"SELECT 'sobel', {_W.replace('CAST(w AS DOUBLE)', f'oy / 2.0 * {_SMOOTHING("x")} * {_SMOOTHING("z")}')} FROM {_TRIPLE}")
    parts.append(f"SELECT 'sobel2', {_W.replace('CAST(w AS DOUBLE)', f'ox / 2.0 * {_SMOOTHING("y")}')} FROM {_TRIPLE} WHERE oz = 0")
    return " UNION ALL ".join(parts)


query("r104_kernels", _s_kernels)(lambda s, d: rounded(s.createDataFrame([(n, *r) for n, k in (("gauss", filters.gaussian(1.0, 3)), ("mean", filters.mean_kernel(3)), ("sobel", filters.sobel("y")), ("sobel2", filters.sobel("x", 1.0, ("x", "y")))) for r in filters.rows_of(k)], "name string, oz int, ox int, oy int, w double"), "w"))


def _s_face(q, axis="y", taps=(0.25, 0.5, 0.25)):
    c = s_cell(q, "g2")
    nb = _s_neigh(q, c, G2)
    q.add("fm", f"SELECT n.level, n.z, n.x, n.y, avg(c.v) FILTER (face = '+{axis}') AS p, avg(c.v) FILTER (face = '-{axis}') AS m FROM {nb} n JOIN {c} c ON c.level = n.nl AND c.z = n.nz AND c.x = n.nx AND c.y = n.ny GROUP BY 1, 2, 3, 4")
    return f"SELECT c.level, c.z, c.x, c.y, round({taps[1]} * c.v + {taps[2]} * coalesce(f.p, c.v) + {taps[0]} * coalesce(f.m, c.v), 6) AS v FROM {c} c LEFT JOIN fm f ON c.level = f.level AND c.z = f.z AND c.x = f.x AND c.y = f.y"


query("r105_face_filter", _s_face)(lambda s, d: rounded(particles.face_filter(*kept(s, d, "g2"), (0.25, 0.5, 0.25), "y")))
def _s_faces(q):
    c = s_cell(q, "g2")
    near = _s_neigh(q, c, G2)
    return num.face_pass(q, num.face_pass(q, c, near, "y", "fy"), near, "x", "fx")


query("r106_separable_face_filter", lambda q: f"SELECT {C}, {r6()} FROM {_s_faces(q)}")(lambda s, d: rounded(particles.separable_face_filter(*kept(s, d, "g2"), (0.25, 0.5, 0.25), settle=_settle(s))))


def _s_tree_face(q, axis="x", taps=(0.25, 0.5, 0.25)):
    t, n = o.tree_fold(q, s_cell(q, "g2"), "max", "tf"), _s_tree_neigh(q)
    q.add("fm", f"SELECT n.level, n.z, n.x, n.y, avg(c.v) FILTER (face = '+{axis}') AS p, avg(c.v) FILTER (face = '-{axis}') AS m FROM {n} n JOIN {t} c ON c.level = n.level AND c.z = n.nz AND c.x = n.nx AND c.y = n.ny GROUP BY 1, 2, 3, 4")
    return f"SELECT c.level, c.z, c.x, c.y, round({taps[1]} * c.v + {taps[2]} * coalesce(f.p, c.v) + {taps[0]} * coalesce(f.m, c.v), 6) AS v FROM {t} c LEFT JOIN fm f ON c.level = f.level AND c.z = f.z AND c.x = f.x AND c.y = f.y"


query("r107_tree_face_filter", _s_tree_face)(lambda s, d: rounded(particles.face_filter(particles.fold_tree(kept(s, d, "g2")[0], "max"), G2, (0.25, 0.5, 0.25), "x", True)))


# --- numerics ------------------------------------------------------------------------

for _a in ("y", "x"):
    query(f"r108_gradient_cfd_{_a}", lambda q, a=_a: f"SELECT {C}, {r6()} FROM {s_conv(q, 'g2', filters.rescaled_kernels(filters.difference(a), G2), True)}")(lambda s, d, a=_a: rounded(filters.gradient_cfd(*kept(s, d, "g2"), a)))
query("r109_gradient_sobel", lambda q: f"SELECT {C}, {r6()} FROM {s_conv(q, 'g2', filters.rescaled_kernels(filters.sobel('y', 1.0, ('x', 'y')), G2), True)}")(lambda s, d: rounded(filters.gradient_sobel(*kept(s, d, "g2"), "y")))


def _s_mag(q, how):
    parts = []
    for a in ("x", "y"):
        k = filters.difference(a) if how == "cfd" else filters.sobel(a, 1.0, ("x", "y"))
        parts.append(s_conv(q, "g2", filters.rescaled_kernels(k, G2), True, f"g{a}"))
    return f"SELECT a.level, a.z, a.x, a.y, round(sqrt(a.v * a.v + b.v * b.v), 6) AS v FROM {parts[0]} a JOIN {parts[1]} b ON a.level = b.level AND a.z = b.z AND a.x = b.x AND a.y = b.y"


for _how in ("cfd", "sobel"):
    query(f"r110_gradient_magnitude_{_how}", lambda q, h=_how: _s_mag(q, h))(lambda s, d, h=_how: rounded(filters.gradient_magnitude(*kept(s, d, "g2"), h)))


def _s_std(q):
    c, den, meta = s_dense(q, "g2")
    g = o.gathered(q, c, den, s_stencil(q, filters.downsampled_kernels(filters.mean_kernel(_BOX), G2, True), meta), meta, True, "pt")
    return f"SELECT {C}, round(sqrt(greatest(sum(w * nv * nv) - sum(w * nv) * sum(w * nv), 0.0)), 4) AS v FROM {g} GROUP BY {C}"


query("r111_local_std", _s_std)(lambda s, d: filters.local_std(*kept(s, d, "g2"), _BOX).withColumn("v", F.round("v", 4)))


for _how in ("min", "max"):
    query(f"r112_adaptive_{_how}", lambda q, h=_how: f"SELECT {C}, {r6()} FROM {num.adaptive_extreme(q, s_cell(q, 'g2'), _s_neigh(q, s_cell(q, 'g2'), G2), h, G2, 2)}")(lambda s, d, h=_how: rounded(filters.adaptive_extreme(*kept(s, d, "g2"), h, 1, 2, 1, _settle(s))))
_PSF = filters.gaussian(1.0, {"z": 1, "x": 3, "y": 3})
query("r113_richardson_lucy", lambda q: f"SELECT {C}, {r6()} FROM {num.richardson_lucy(q, s_cell(q, 'g2'), _PSF, G2, 2)}")(lambda s, d: rounded(filters.richardson_lucy(*kept(s, d, "g2"), filters.gaussian(1.0, {"z": 1, "x": 3, "y": 3}), 2, settle=_settle(s))))
query("r114_richardson_lucy_tv", lambda q: f"SELECT {C}, {r6()} FROM {num.richardson_lucy(q, s_cell(q, 'g2'), _PSF, G2, 2, 0.01)}")(lambda s, d: rounded(filters.richardson_lucy(*kept(s, d, "g2"), _PSF, 2, tv=0.01, settle=_settle(s))))
query("r115_div_norm_grad", lambda q: f"SELECT {C}, {r6()} FROM {num.div_norm_grad(q, s_cell(q, 'g2'), G2, 'dng')}")(lambda s, d: rounded(filters.div_norm_grad(*kept(s, d, "g2"), settle=_settle(s))))


# --- reconstruction -------------------------------------------------------------------

query("r116_constant", lambda q: f"SELECT {K}, CAST(v AS DOUBLE) AS v FROM {o.pixels(q, s_cell(q, 'g3'), G3)}")(lambda s, d: reconstruct.constant(*cell(s, d, "g3")).withColumn("v", F.col("v").cast("double")))
_PATCH = reconstruct.Patch((2, 9, 11), (13, 40, 50))
query("r117_constant_patch", lambda q: f"SELECT {K}, CAST(v AS DOUBLE) AS v FROM {o.pixels(q, s_cell(q, 'g3'), G3)} WHERE z >= 2 AND z < 13 AND x >= 9 AND x < 40 AND y >= 11 AND y < 50")(
    lambda s, d: reconstruct.constant(*cell(s, d, "g3"), _PATCH).withColumn("v", F.col("v").cast("double"))
)


def _s_coarse(q):
    c, den, _ = s_dense(q, "g2")
    return f"SELECT {K}, {r6()} FROM {den} WHERE l = 3"


query("r117_constant_coarse", _s_coarse)(lambda s, d: rounded(reconstruct.constant(*kept(s, d, "g2"), reconstruct.Patch(delta=-2))))
query("r117_constant_fine", lambda q: f"SELECT z, CAST(2 * x + i AS INTEGER) AS x, CAST(2 * y + j AS INTEGER) AS y, CAST(v AS DOUBLE) AS v FROM {o.pixels(q, s_cell(q, 'g2'), G2)} CROSS JOIN (VALUES (0), (1)) a(i) CROSS JOIN (VALUES (0), (1)) b(j)")(
    lambda s, d: reconstruct.constant(*cell(s, d, "g2"), reconstruct.Patch(delta=1)).withColumn("v", F.col("v").cast("double"))
)
query("r118_level_image", lambda q: f"SELECT {K}, level AS v FROM {o.pixels(q, s_cell(q, 'g2'), G2)}")(lambda s, d: reconstruct.levels(*cell(s, d, "g2")))


def _s_smooth(q, scale=2.0, cap=20):
    prev = q.add("sm", f"SELECT {K}, CAST(v AS DOUBLE) AS v, level FROM {o.pixels(q, s_cell(q, 'g2'), G2)}")
    for a in ("y", "x"):
        n = G2.size[a]
        c = min(cap, n // 2 - 1)
        r = f"least(CAST(floor(pow(2.0, 5 - a.level) / {scale}) AS INTEGER), {c})"
        lo = f"CASE WHEN a.{a} = 0 THEN 0 WHEN a.{a} <= {r} THEN 1 ELSE a.{a} - {r} END"
        others = " AND ".join(f"b.{x} = a.{x}" for x in AXES if x != a)
        prev = q.add(f"sm{a}", f"SELECT a.z, a.x, a.y, CASE WHEN any_value({r}) = 0 THEN any_value(a.v) ELSE avg(b.v) END AS v, any_value(a.level) AS level FROM {prev} a JOIN {prev} b ON {others} AND (b.{a} BETWEEN {lo} AND a.{a} + {r} OR b.{a} = a.{a}) AND b.{a} BETWEEN {lo} AND a.{a} + {r} GROUP BY 1, 2, 3")
    return f"SELECT {K}, {r6()} FROM {prev}"


query("r119_smooth", _s_smooth)(lambda s, d: rounded(reconstruct.smooth(*kept(s, d, "g2"))))
query("r121_interpolated", lambda q: f"SELECT {K}, {r6()} FROM {num.interpolated(q, s_cell(q, 'g2'), G2)}")(lambda s, d: rounded(reconstruct.interpolated(*kept(s, d, "g2"))))

_CAM = reconstruct.Camera(radius=60.0, theta=0.4, origin=(32.0, 32.0, 8.0), target=(32.0, 32.0, 8.0))
query("r123_raycast")(lambda s, d: rounded(reconstruct.raycast(*cell(s, d, "g3"), _CAM)))
query("r124_raycast_patch")(lambda s, d: rounded(reconstruct.raycast_patch(*kept(s, d, "g3"), _CAM, reconstruct.Patch((0, 0, 0), (4, 20, 20), -1))))
query("r125_raycast_pixels")(lambda s, d: rounded(reconstruct.raycast_pixels(grids.volume(s, d), G3, _CAM)))
query("r127_raycast_jitter")(lambda s, d: rounded(reconstruct.raycast(*cell(s, d, "g3"), _CAM, jitter=0.5, seed=3)))


# --- compression ------------------------------------------------------------------------

_VST = "(2 * sqrt(greatest(CAST(v AS DOUBLE) - 1.0, 0.0) / 2.0 + 1.6 * 1.6) - 2 * 1.6) / 0.5"
_CODEC = compress.Codec()
query("r129_stabilise", lambda q: f"SELECT {C}, round({_VST}, 6) AS v FROM {s_cell(q, 'g2')}")(lambda s, d: rounded(cell(s, d, "g2")[0].withColumn("v", compress.stabilise(F.col("v").cast("double"), _CODEC)).select(*CELL, "v")))
query("r131_symbols", lambda q: f"SELECT {C}, CAST(2 * round({_VST}) AS BIGINT) AS v FROM {s_cell(q, 'g2')}")(lambda s, d: compress.compress(cell(s, d, "g2")[0]).select(*CELL, "v"))


def _s_lossy(q):
    dd = f"(0.5 * round({_VST}) + 3.2)"
    return f"SELECT {C}, round(CASE WHEN {dd} >= 3.2 THEN ({dd} * {dd} / 4 - 2.56) * 2.0 + 1.0 ELSE 1.0 END, 4) AS v FROM {s_cell(q, 'g2')}"


query("r132_lossy_round_trip", _s_lossy)(lambda s, d: compress.decompress(compress.compress(cell(s, d, "g2")[0])).withColumn("v", F.round("v", 4)).select(*CELL, "v"))


# --- denoising, time, storage ------------------------------------------------------------


def _denoise(s, d):
    c, meta = kept(s, d, "g2")
    return denoise.apply(c, meta, denoise.train(c, meta, ridge=RIDGE))


#: Strong enough that few cells and many places give one answer to four digits on any engine.
RIDGE = 1e-3


def _s_trained(q):
    """The kernels of the default half widths: 9 x 9 places at the finest level, 3 x 3 at the others."""
    c, den, meta = s_dense(q, "g2")
    sizes = {l: {a: 1 if n == 1 else 9 if l == meta.l_max else 3 for a, n in meta.size.items()} for l in range(meta.l_min, meta.l_max + 1)}
    rows = [(l, p // (s["x"] * s["y"]) - s["z"] // 2, p // s["y"] % s["x"] - s["x"] // 2, p % s["y"] - s["y"] // 2, float(p)) for l, s in sizes.items() for p in range(s["z"] * s["x"] * s["y"])]
    g = o.gathered(q, c, den, o.stencil(q, rows, "tst"), meta, True, "tg")
    return num.trained(q, g, c, sizes, RIDGE, meta), c, den, meta


def _s_denoised(q):
    k, c, den, meta = _s_trained(q)
    return o.convolved(q, c, den, k, meta, True, "dn")


query("r135_denoise", lambda q: f"SELECT {C}, round(v, 4) AS v FROM {_s_denoised(q)}")(lambda s, d: _denoise(s, d).withColumn("v", F.round("v", 4)))


def _two(s, d):
    a = kept(s, d, "g2")[0].select(*CELL, F.col("v").cast("double").alias("v"))
    b = particles.sample(convert.convert(grids.image(s, d), G2, convert.Parameters(rel_error=0.5, grad_th=1.5, constant_scale=True)), grids.image(s, d), G2, "max").select(*CELL, F.col("v").cast("double").alias("v"))
    return a, b


def _s_two(q):
    a = s_cell(q, "g2")
    req = o.required(q, o.grid(q, "g2"), G2, 0.5, 1.5, "rq2")
    b = o.sampled(q, o.to_leaves(q, o.solve(q, req, G2, "sl2"), G2, name="lf2"), "g2", G2, "max", "cb")
    on = " AND ".join(f"a.{c} = b.{c}" for c in ("level", *AXES))
    return q.add("dl", f"SELECT coalesce(a.level, b.level) AS level, coalesce(a.z, b.z) AS z, coalesce(a.x, b.x) AS x, coalesce(a.y, b.y) AS y, CASE WHEN a.v IS NULL THEN 'add' WHEN b.v IS NULL THEN 'remove' WHEN abs(a.v - b.v) > 0 THEN 'update' END AS op, CAST(b.v AS DOUBLE) AS v FROM {a} a FULL JOIN {b} b ON {on}")


query("t013_time_delta", lambda q: f"SELECT * FROM {_s_two(q)} WHERE op IS NOT NULL")(lambda s, d: timeseries.delta(*_two(s, d)))


def _replayed(s, d):
    a, b = _two(s, d)
    return timeseries.replay(a, timeseries.delta(a, b).withColumn("t", F.lit(1)), 1)


query("t013_time_replay", lambda q: (_s_two(q), f"SELECT {C}, CAST(v AS DOUBLE) AS v FROM cb")[1])(_replayed)


def _stored(s, d):
    import uuid

    from quadrille.sources.storage import READ, READWRITE, CellStore

    _settle(s)
    root = s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getCheckpointDir()
    c, meta = cell(s, d, "g3")
    path = f"{root}/store-{uuid.uuid4().hex}"
    w = CellStore(s, path, READWRITE)
    w.write_cells(c, meta)
    w.write_property("mean", c.withColumn("v", F.col("v").cast("double")))
    r = CellStore(s, path, READ)
    r.read_delta = 1
    return r.read_property("mean", kind="double")


query("r012_partial_read", lambda q: f"SELECT {C}, CAST(v AS DOUBLE) AS v FROM {s_cell(q, 'g3')} WHERE level <= 5")(_stored)


def _root(s) -> str:
    _settle(s)
    root = s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getCheckpointDir()
    return root if ":" in root.split("/")[0] else f"file://{root}"


def _tiff(s, d):
    import uuid

    from quadrille.sources import tiff

    path = f"{_root(s)}/tiff-{uuid.uuid4().hex}"
    tiff.save(grids.volume(s, d), G3, path, "float32", 4)
    return tiff.read(s, path)


query("r002_tiff_scan", lambda q: f"SELECT {K}, CAST(v AS DOUBLE) AS v FROM {o.grid(q, 'g3')}")(_tiff)
query("r003_tiff_slices", lambda q: f"SELECT {K}, CAST(v AS DOUBLE) AS v FROM {o.grid(q, 'g3')} WHERE z >= 6 AND z < 9")(lambda s, d: _tiff(s, d).where("z >= 6 and z < 9"))


def _store(s, d, which="g3", codec="zstd"):
    import uuid

    from quadrille.sources.storage import READ, READWRITE, CellStore

    c, meta = kept(s, d, which)
    path = f"{_root(s)}/store-{uuid.uuid4().hex}"
    w = CellStore(s, path, READWRITE, codec)
    w.write_cells(c, meta, tree=True)
    w.append_cells(c.where("z < 8"), meta)
    w.write_property("mean", c.withColumn("v", F.col("v").cast("double")))
    w.write_property("lossy", c.withColumn("v", F.col("v").cast("double")), codec=compress.Codec())
    return CellStore(s, path, READ, codec)


query("r006_store_cells", lambda q: f"SELECT * FROM {s_leaf(q, 'g3')}")(lambda s, d: _store(s, d).read_cells())
query("r007_store_append", lambda q: f"SELECT * FROM {s_leaf(q, 'g3')} WHERE z < 8")(lambda s, d: _store(s, d).read_cells(1))
query("r009_store_tree", lambda q: f"SELECT * FROM {o.tree(q, s_leaf(q, 'g3'))}")(lambda s, d: _store(s, d).read_cells(tree=True))
query("r010_store_property", lambda q: f"SELECT {C}, CAST(v AS DOUBLE) AS v FROM {s_cell(q, 'g3')}")(lambda s, d: _store(s, d).read_property("mean"))
def _catalogue(s, d):
    """What the store says about itself, a row for each time step: channel, properties, extents and number of cells."""
    r = _store(s, d)
    rows = [(t, c, ",".join(r.properties()), r.read_meta(t, c).nz, r.read_meta(t, c).nx, r.read_meta(t, c).ny, r.read_cells(t, c).count()) for c in r.channels() for t in range(r.number_of_time_steps(c))]
    return s.createDataFrame(rows, "t int, channel string, properties string, nz int, nx int, ny int, cells long")


query(
    "r013_catalogue",
    lambda q: "SELECT CAST(t AS INTEGER) AS t, 't' AS channel, 'lossy,mean' AS properties, " + ", ".join(f"(SELECT CAST(max({a}) + 1 AS INTEGER) FROM {o.grid(q, 'g3')}) AS n{a}" for a in AXES) + f", (SELECT count(*) FROM {s_leaf(q, 'g3')} WHERE t = 0 OR z < 8) AS cells FROM (VALUES (0), (1)) s(t)",
)(_catalogue)
query("r016_lazy_slice", lambda q: f"SELECT {C}, CAST(v AS DOUBLE) AS v FROM {s_cell(q, 'g3')} WHERE level = 5 AND z BETWEEN 2 AND 3")(lambda s, d: _store(s, d).scan("mean", 5, (2, 3)))
query("r122_reconstruct_from_store", lambda q: f"SELECT {K}, CAST(v AS DOUBLE) AS v FROM {o.pixels(q, s_cell(q, 'g3'), G3)} WHERE z >= 2 AND z < 13 AND x >= 9 AND x < 40 AND y >= 11 AND y < 50")(lambda s, d: reconstruct.constant(_store(s, d).read_property("mean"), G3, _PATCH))


def _two_phase(s, d):
    both, _ = convert.fields(grids.image(s, d), G2, P2)
    both = _settle(s)(both)
    return convert.leaves(convert.levels(convert.apply_parameters(both, P2), G2, P2), G2)


query("r069_two_phase", lambda q: f"SELECT * FROM {s_leaf(q, 'g2')}")(_two_phase)
query("r130_restore", lambda q: f"SELECT {C}, round(CASE WHEN 0.5 * {_VST} + 3.2 >= 3.2 THEN ((0.5 * {_VST} + 3.2) * (0.5 * {_VST} + 3.2) / 4 - 2.56) * 2.0 + 1.0 ELSE 1.0 END, 4) AS v FROM {s_cell(q, 'g2')}")(
    lambda s, d: cell(s, d, "g2")[0].select(*CELL, F.round(compress.restore(compress.stabilise(F.col("v").cast("double"), _CODEC), _CODEC), 4).alias("v"))
)
query("r133_train_denoise", lambda q: f"SELECT CAST(level AS INTEGER) AS level, CAST(oz AS INTEGER) AS oz, CAST(ox AS INTEGER) AS ox, CAST(oy AS INTEGER) AS oy, round(w, 4) AS w FROM {_s_trained(q)[0]}")(lambda s, d: _kernels(s, d))


def _kernels(s, d):
    c, meta = kept(s, d, "g2")
    k = denoise.train(c, meta, ridge=RIDGE)
    return s.createDataFrame([(l, *r[:3], round(r[3], 4)) for l, a in k.items() for r in filters.rows_of(a)], "level int, oz int, ox int, oy int, w double")


def _s_mag3(q):
    p = [s_conv(q, "g3", filters.rescaled_kernels(filters.difference(a), G3), True, f"g{a}") for a in AXES]
    on = lambda b: " AND ".join(f"a.{c} = {b}.{c}" for c in ("level", *AXES))
    return f"SELECT a.level, a.z, a.x, a.y, round(sqrt(a.v * a.v + b.v * b.v + c.v * c.v), 6) AS v FROM {p[0]} a JOIN {p[1]} b ON {on('b')} JOIN {p[2]} c ON {on('c')}"


query("r139_gradient_magnitude_volume", _s_mag3)(lambda s, d: rounded(filters.gradient_magnitude(*kept(s, d, "g3"))))
def _s_pixel_rl(q, iterations=2):
    g = o.grid(q, "g2")
    place = lambda sign: " CROSS JOIN (VALUES " + ", ".join(f"({sign * x}, {sign * y}, CAST({w!r} AS DOUBLE))" for _, x, y, w in _KERNEL) + ") s(ox, oy, w)"
    est = q.add("e0", f"SELECT {K}, 1.0::DOUBLE AS v FROM {g}")
    for i in range(iterations):
        q.add(f"b{i}", f"SELECT a.z, a.x, a.y, sum(s.w * b.v) AS v FROM {est} a {place(-1)} JOIN {est} b ON b.x = a.x - s.ox AND b.y = a.y - s.oy GROUP BY 1, 2, 3")
        q.add(f"r{i}", f"SELECT a.z, a.x, a.y, a.v / nullif(b.v, 0) AS v FROM {g} a JOIN b{i} b ON {num.GRID}")
        q.add(f"s{i}", f"SELECT a.z, a.x, a.y, sum(s.w * b.v) AS v FROM {g} a {place(1)} JOIN r{i} b ON b.x = a.x - s.ox AND b.y = a.y - s.oy GROUP BY 1, 2, 3")
        est = q.add(f"e{i + 1}", f"SELECT a.z, a.x, a.y, a.v * b.v AS v FROM {est} a JOIN s{i} b ON {num.GRID}")
    return est


query("r140_richardson_lucy_pixels", lambda q: f"SELECT {K}, {r6()} FROM {_s_pixel_rl(q)}")(lambda s, d: rounded(dense.richardson_lucy(grids.image(s, d), G2, _KERNEL, 2, _settle(s))))


def _s_noise(seed: int) -> str:
    """The jitter's mix of a cell's key."""
    at = " + ".join(f"CAST({c} + 1 AS BIGINT) * {f}" for c, f in FACTORS.items())
    for _ in range(2):
        at = f"(({at} + {(seed + 1) * 1000003}) % {PRIME})"
        at = f"({at} * {at} % {PRIME} + {at})"
    return f"({at} % {PRIME} / CAST({PRIME} AS DOUBLE))"


def _s_cast(q, rows, how="max", jitter=0.0, seed=0, camera=None, name=""):
    """rows: level, z, x, y, v on the geometry of the volume."""
    m = (camera or _CAM).matrix()
    size = "CAST(1 << (6 - level) AS DOUBLE)"
    p = {a: f"({a} + CAST(0.5 AS DOUBLE) + " + (f"({_s_noise(seed + i)} - CAST(0.5 AS DOUBLE)) * CAST({jitter} AS DOUBLE)" if jitter else "CAST(0.0 AS DOUBLE)") + f") * {size}" for i, a in enumerate(AXES)}
    clip = [f"({float(m[i, 0])!r} * px + {float(m[i, 1])!r} * py + {float(m[i, 2])!r} * pz + {float(m[i, 3])!r})" for i in (0, 1, 3)]
    n = "ceil(64.0 / sz)"
    q.add(f"pts{name}", f"SELECT level, v, {size} AS sz, {p['z']} AS pz, {p['x']} AS px, {p['y']} AS py FROM {rows}")
    q.add(f"img{name}", f"SELECT level, CAST(v AS DOUBLE) AS v, CAST(sz AS INTEGER) AS sz, {n} AS n, CAST(round(-(({clip[1]} / {clip[2]} - 1) / 2 * {n})) AS INTEGER) AS r, CAST(round(-(({clip[0]} / {clip[2]} - 1) / 2 * {n})) AS INTEGER) AS c FROM pts{name}")
    q.add(f"red{name}", f"SELECT level, sz, r, c, {how}(v) AS v FROM img{name} WHERE r > 0 AND c > 0 AND r < n AND c < n GROUP BY ALL")
    q.add(f"spr{name}", f"SELECT r, unnest(range(c * sz, least((c + 1) * sz, 64))) AS c, v FROM (SELECT unnest(range(r * sz, least((r + 1) * sz, 64))) AS r, c, sz, v FROM red{name} WHERE level = 6 OR v > 0)")
    return f'SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, round({how}(v), 6) AS v FROM spr{name} GROUP BY r, c'


def _s_touched(q):
    """Cells at most one level short of the finest that touch the patch's box, [0, 8) x [0, 40) x [0, 40) in pixels."""
    c, cap, end = s_cell(q, "g3"), G3.l_max - 1, {"z": 8, "x": 40, "y": 40}
    touch = " AND ".join(f"{a} * (1 << ({G3.l_max} - level)) < {n} AND (({a} + 1) * (1 << ({G3.l_max} - level))) > 0" for a, n in end.items())
    return q.add("tp", f"SELECT {C}, v FROM (SELECT {C}, CAST(v AS DOUBLE) AS v FROM {c} WHERE level <= {cap} UNION ALL SELECT {C}, v FROM {o.tree_mean(q, c, G3)} WHERE level = {cap}) WHERE {touch}")


for _n, _f in (("r123_raycast", lambda q: _s_cast(q, s_cell(q, "g3"))), ("r124_raycast_patch", lambda q: _s_cast(q, _s_touched(q))), ("r127_raycast_jitter", lambda q: _s_cast(q, s_cell(q, "g3"), jitter=0.5, seed=3)), ("r125_raycast_pixels", lambda q: _s_cast(q, q.add("px6", f"SELECT 6 AS level, {K}, v FROM {o.grid(q, 'g3')}")))):
    _q = o.Sql()
    ORACLES[_n] = _q.text(_f(_q))


def _projected(s, d):
    t = grids.read(s, d, "supplier")
    r, c = reconstruct.project(_CAM, F.col("s_suppkey") % 64 + 0.5, F.col("s_nationkey") + 0.5, F.lit(3.5), F.lit(64), F.lit(64))
    return t.select("s_suppkey", r.alias("row"), c.alias("col"))


def _s_projected():
    m = [[float(v) for v in row] for row in _CAM.matrix()]
    clip = [f"({m[i][0]!r} * (s_suppkey % 64 + CAST(0.5 AS DOUBLE)) + {m[i][1]!r} * (s_nationkey + CAST(0.5 AS DOUBLE)) + {m[i][2]!r} * CAST(3.5 AS DOUBLE) + {m[i][3]!r})" for i in (0, 1, 3)]
    at = lambda k: f"CAST(round(-(({clip[k]} / {clip[2]} - 1) / 2 * 64)) AS INTEGER)"
    return f'SELECT s_suppkey, {at(1)} AS "row", {at(0)} AS col FROM supplier'


query("r126_project_points", _s_projected())(_projected)


# --- more rows of the inventory ----------------------------------------------------------


def _tiff_info(s, d):
    from quadrille.sources import tiff

    path = f"{_root(s)}/info-{__import__('uuid').uuid4().hex}"
    tiff.save(grids.volume(s, d), G3, path, "float32", 4)
    meta, kind = tiff.info(path)
    return s.createDataFrame([(meta.nz, meta.nx, meta.ny, kind)], "nz int, nx int, ny int, kind string")


query("r001_tiff_info", lambda q: "SELECT " + ", ".join(f"CAST(max({a}) + 1 AS INTEGER) AS n{a}" for a in AXES) + f", 'float32' AS kind FROM {o.grid(q, 'g3')}")(_tiff_info)


def _modes(s, d):
    """The same store opened for reading refuses to be written; opened for writing it starts empty."""
    from quadrille.sources.storage import WRITE, CellStore

    r = _store(s, d, "g2")
    before = r.number_of_time_steps()
    try:
        r.write_property("mean", r.read_property("mean"))
        refused = False
    except PermissionError:
        refused = True
    return s.createDataFrame([(before, refused, CellStore(s, r.root, WRITE).number_of_time_steps())], "before int, refused boolean, after int")


query("r005_store_modes", "SELECT CAST(2 AS INTEGER) AS before, true AS refused, CAST(0 AS INTEGER) AS after")(_modes)
query("r010_store_lossy", lambda q: _s_lossy(q))(lambda s, d: _store(s, d, "g2").read_property("lossy", codec=compress.Codec()).withColumn("v", F.round("v", 4)))


def _sizes(s, d):
    """Codecs keep the values; their sizes differ."""
    rows, size = None, {}
    for codec in ("zstd", "gzip", "uncompressed"):
        r = _store(s, d, "g3", codec)
        size[codec] = r.size_mb()
        part = r.read_property("mean").groupBy("level").agg(F.count("*").alias("n"), F.sum("v").alias("total")).withColumn("codec", F.lit(codec))
        rows = part if rows is None else rows.unionByName(part)
    return rows.withColumn("smaller", F.lit(0 < size["zstd"] < size["uncompressed"]))


query("r015_codecs", lambda q: f"SELECT level, count(*) AS n, CAST(sum(v) AS DOUBLE) AS total, codec, true AS smaller FROM {s_cell(q, 'g3')} CROSS JOIN (VALUES ('zstd'), ('gzip'), ('uncompressed')) c(codec) GROUP BY level, codec")(_sizes)


def _sliced(s, d):
    from quadrille.sources.storage import READWRITE, CellStore

    r = CellStore(s, _store(s, d).root, READWRITE)
    new = r.scan("mean", 5, (2, 3)).select(*KEY, (F.col("v") + 1000).alias("v"))
    r.write_slice("mean", new, 5)
    return r.scan("mean", 5)


query("r016_write_slice", lambda q: f"SELECT {C}, CAST(v AS DOUBLE) + CASE WHEN z BETWEEN 2 AND 3 THEN 1000 ELSE 0 END AS v FROM {s_cell(q, 'g3')} WHERE level = 5")(_sliced)
query(
    "r017_row_ranges",
    lambda q: f'SELECT z, x, n, CAST(sum(n) OVER (ORDER BY z, x) - n AS BIGINT) AS "begin", CAST(sum(n) OVER (ORDER BY z, x) AS BIGINT) AS "stop" FROM (SELECT z, x, count(*) AS n FROM {s_leaf(q, "g3")} WHERE level = 5 GROUP BY z, x)',
)(lambda s, d: _store(s, d).row_ranges(5))
query("r017_lazy_row", lambda q: f"SELECT {C}, CAST(v AS DOUBLE) AS v FROM {s_cell(q, 'g3')} WHERE level = 5 AND z = 2 AND x BETWEEN 3 AND 4")(lambda s, d: (lambda r: r.scan("mean", 5, (2, 2), 3).unionByName(r.scan("mean", 5, (2, 2), 4)))(_store(s, d)))


def _imaged(s, d):
    from quadrille.sources.storage import READWRITE, CellStore

    w = CellStore(s, f"{_root(s)}/image-{__import__('uuid').uuid4().hex}", READWRITE)
    w.write_image("volume", grids.volume(s, d), 4)
    return w.read_image("volume", (3, 9), 4)


query("r021_image_store", lambda q: f"SELECT * FROM {o.grid(q, 'g3')} WHERE z BETWEEN 3 AND 9")(_imaged)
query("r033_smooth_stencils", f"SELECT CAST(level AS INTEGER) AS level, {_W.replace('CAST(w AS DOUBLE)', '1.0 / 27')} FROM {_TRIPLE} CROSS JOIN (SELECT unnest(range(1, {G3.l_max + 1})) AS level)")(lambda s, d: rounded(filters.stencil_table(s, [filters.mean_kernel(3)] * 2, G3), "w"))
query("r045_check", lambda q: f"SELECT count(*) AS cells FROM {o.grid(q, 'g3')}")(lambda s, d: s.createDataFrame([(convert.check(G3, grids.volume(s, d)),)], "cells long"))
query("r064_solve_sparse", lambda q: f"SELECT CAST(level AS INTEGER) AS level, {K}, type FROM {o.solve(q, _s_req(q, 'g2'), G2)}")(lambda s, d: convert.solve_sparse(_req(s, d, "g2")[0].where("v > 0"), G2))
# Tiles of a few cells, so that ghosts and the scheme over all tiles matter.
query("r070_tiled_conversion", lambda q: f"SELECT * FROM {s_leaf(q, 'g3')}")(lambda s, d: convert.convert(grids.volume(s, d), G3, P3, _settle(s), 16))
query("r071_tiles_into_one_scheme", lambda q: f"SELECT {K}, round(v * {convert.windows(G2.half(), 1.0)[2]} / {convert.windows(G2.half(), 1.0)[2]}, 6) AS scale FROM ({_s_scale(q)})")(
    lambda s, d: rounded(convert.tiled_fields(grids.image(s, d), G2, convert.Parameters(), 8), "scale").select(*KEY, "scale")
)
query("r087a_sample_tiled", lambda q: f"SELECT {C}, CAST(v AS DOUBLE) AS v FROM {s_cell(q, 'g3')}")(lambda s, d: (lambda g, l, m: particles.sample(l, g, m, "mean", 4))(*leaf(s, d, "g3")).select(*CELL, "v"))
query("r073_from_runs", lambda q: f"SELECT * FROM {s_leaf(q, 'g2')}")(lambda s, d: particles.from_runs(particles.random_access(leaf(s, d, "g2")[1])).select(*CELL))
query("r073_linear_from_runs", lambda q: f"SELECT level, z, x, list(y ORDER BY y) AS y, CAST(sum(count(*)) OVER (ORDER BY level, z, x) AS BIGINT) AS row_end FROM {s_leaf(q, 'g2')} GROUP BY level, z, x")(lambda s, d: particles.linear_access(particles.from_runs(particles.random_access(leaf(s, d, "g2")[1]))))
query("r084_find_tree_cells", lambda q: f"SELECT * FROM {o.tree(q, s_leaf(q, 'g2'))} WHERE level = 3 AND x % 2 = 0")(
    lambda s, d: particles.find_cells(grids.cells(s, G2.at(3)).where("x % 2 = 0").select(F.lit(3).alias("level"), *KEY), particles.tree(leaf(s, d, "g2")[1]))
)
query("r089_tree_any", lambda q: f"SELECT {C}, v FROM {o.tree_fold(q, q.add('whole', f'SELECT {C}, CAST(floor(v) AS BIGINT) AS v FROM {s_cell(q, 'g2')}'), 'bit_xor', 'tf')}")(lambda s, d: particles.fold_tree(cell(s, d, "g2")[0].withColumn("v", F.floor("v")), F.bit_xor))
query("r118_level_patch", lambda q: f"SELECT {K}, level AS v FROM {o.pixels(q, s_cell(q, 'g3'), G3)} WHERE z >= 2 AND z < 13 AND x >= 9 AND x < 40 AND y >= 11 AND y < 50")(lambda s, d: reconstruct.levels(*cell(s, d, "g3"), _PATCH))
query("r122_lazy_level", lambda q: f"SELECT {K}, level AS v FROM {o.pixels(q, s_cell(q, 'g3'), G3)} WHERE z >= 2 AND z < 13 AND x >= 9 AND x < 40 AND y >= 11 AND y < 50")(lambda s, d: reconstruct.levels(_store(s, d).read_cells(), G3, _PATCH))
query("r122_lazy_smooth", lambda q: _s_smooth(q, cap=10))(lambda s, d: rounded(reconstruct.smooth(_store(s, d, "g2").read_property("mean"), G2, cap=10)))
_SWEEP = [reconstruct.Camera(radius=60.0, theta=t, origin=(32.0, 32.0, 8.0), target=(32.0, 32.0, 8.0)) for t in (0.0, 0.4, 1.1, 2.5)]


def _s_sweep(q):
    rows, parts = s_cell(q, "g3"), []
    for i, c in enumerate(_SWEEP):
        parts.append(f"SELECT CAST({i} AS INTEGER) AS view, * FROM ({_s_cast(q, rows, camera=c, name=f'w{i}')})")
    return " UNION ALL ".join(parts)


query("r123_raycast_sweep", _s_sweep)(lambda s, d: rounded(reconstruct.sweep(*cell(s, d, "g3"), _SWEEP)))
query("r136_sample_cells", lambda q: f"SELECT * FROM {s_leaf(q, 'g3')} WHERE {_s_noise(5)} < 0.25")(lambda s, d: particles.sampled(leaf(s, d, "g3")[1], 0.25, 5))


def _s_transfer(q):
    """Values of the first structure at the cells of the second."""
    _s_two(q)
    a, b = s_cell(q, "g2"), "cb"
    up = " AND ".join(f"a.{c} = (b.{c} >> (b.level - a.level))" for c in AXES)
    down = " AND ".join(f"b.{c} = (a.{c} >> (a.level - b.level))" for c in AXES)
    q.add("tu", f"SELECT b.level, b.z, b.x, b.y, max_by(CAST(a.v AS DOUBLE), a.level) AS v FROM {b} b JOIN {a} a ON a.level <= b.level AND {up} GROUP BY 1, 2, 3, 4")
    q.add("td", f"SELECT b.level, b.z, b.x, b.y, avg(CAST(a.v AS DOUBLE)) AS v FROM {b} b JOIN {a} a ON a.level > b.level AND {down} GROUP BY 1, 2, 3, 4")
    return f"SELECT {C}, {r6()} FROM (SELECT * FROM tu UNION ALL SELECT * FROM td WHERE NOT EXISTS (SELECT 1 FROM tu WHERE {' AND '.join(f'tu.{c} = td.{c}' for c in ('level', *AXES))}))"


query("t013_transfer", _s_transfer)(lambda s, d: (lambda a, b: rounded(timeseries.transfer(a, b, G2.l_max)))(*_two(s, d)))
query("t013_latest", lambda q: (_s_two(q), f"SELECT {C}, CAST(coalesce(b.v, a.v) AS DOUBLE) AS v, CAST(CASE WHEN b.v IS NULL THEN 0 ELSE 1 END AS INTEGER) AS t FROM {s_cell(q, 'g2')} a FULL JOIN cb b USING ({C})")[1])(
    lambda s, d: (lambda a, b: timeseries.latest(a.withColumn("t", F.lit(0)).unionByName(b.withColumn("t", F.lit(1)))))(*_two(s, d))
)
