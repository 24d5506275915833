"""SQL text of the iterative and chained numerics for another engine: recursions as recursive tables, iterations unrolled."""

from __future__ import annotations

from quadrille.operators import filters
from quadrille.plans import oracle as o
from quadrille.plans.meta import AXES, GridMeta

K, C = o.K, o.C
ON = " AND ".join(f"a.{c} = b.{c}" for c in ("level", *AXES))
GRID = " AND ".join(f"a.{c} = b.{c}" for c in AXES)


# --- dense grids ------------------------------------------------------------------------


def clamped(q: o.Sql, src: str, meta: GridMeta, expr: str, name: str) -> str:
    """An aggregate of the 27 clamped neighbours b of each cell a."""
    offs = " CROSS JOIN ".join(f"(VALUES (-1), (0), (1)) o{a}(d{a})" for a in AXES)
    on = " AND ".join(f"b.{a} = least(greatest(a.{a} + d{a}, 0), {meta.size[a] - 1})" for a in AXES)
    return q.add(name, f"SELECT a.z, a.x, a.y, {expr} AS v FROM {src} a CROSS JOIN {offs} JOIN {src} b ON {on} GROUP BY a.z, a.x, a.y")


def smooth_positive(q: o.Sql, src: str, meta: GridMeta, name: str) -> str:
    return clamped(q, src, meta, "CASE WHEN count(*) FILTER (b.v > 0) > 0 THEN CAST(sum(b.v) FILTER (b.v > 0) AS DOUBLE) / count(*) FILTER (b.v > 0) ELSE 0.0 END", name)


def upsampled(fine: GridMeta, src: str) -> str:
    on = " AND ".join(f"h.{a} = r{a}.{a}{' // 2' if fine.size[a] > 1 else ''}" for a in AXES)
    return f"SELECT rz.z, rx.x, ry.y, h.v FROM {o._axes(fine)} JOIN {src} h ON {on}"


def fill_holes_by_tree(q: o.Sql, src: str, meta: GridMeta) -> str:
    size = {l: meta.at(l) for l in range(meta.l_max + 1)}
    at = {meta.l_max: src}
    for l in range(meta.l_max, 0, -1):
        at[l] = smooth_positive(q, at[l], size[l], f"up_{l}")
        at[l - 1] = o.half(q, at[l], size[l], "max", f"dn_{l - 1}")
    at[0] = q.add("root", f"SELECT {K}, CASE WHEN v = 0 THEN (SELECT avg(v) FROM {at[0]} WHERE v > 0) ELSE v END AS v FROM {at[0]}")
    for l in range(1, meta.l_max + 1):
        q.add(f"ab_{l}", upsampled(size[l], at[l - 1]))
        q.add(f"fi_{l}", f"SELECT {K.replace('z', 'a.z').replace('x', 'a.x').replace('y', 'a.y')}, CASE WHEN a.v = 0 THEN b.v ELSE a.v END AS v FROM {at[l]} a JOIN ab_{l} b ON {GRID}")
        at[l] = smooth_positive(q, f"fi_{l}", size[l], f"at_{l}")
    return at[meta.l_max]


def spline(q: o.Sql, src: str, meta: GridMeta, b1: float, b2: float, gain: float, size: int) -> str:
    """Causal and anticausal recursion along the long axes, mirrored ends."""
    h = [gain]
    for k in range(1, size):
        h.append(b1 * h[k - 1] + (b2 * h[k - 2] if k > 1 else 0.0))
    q.add("imp", f"SELECT * FROM (VALUES {', '.join(f'({k}, CAST({x!r} AS DOUBLE))' for k, x in enumerate(h))}) t(k, h)")
    at = src
    for axis in ("y", "x", "z"):
        n = meta.size[axis]
        if n <= 2:
            continue
        line = [a for a in AXES if a != axis]
        lines, same = ", ".join(f"s.{a}" for a in line), " AND ".join(f"s.{a} = r.{a}" for a in line)
        mirror = lambda i: f"abs((({i}) + {n - 1} + {2 * (n - 1) * 64}) % {2 * (n - 1)} - {n - 1})"
        start = lambda of, i, name: q.add(name, f"SELECT {lines}, sum(k.h * s.v) AS v FROM {of} s JOIN imp k ON s.{axis} = {mirror(i)} GROUP BY {lines}")
        start(at, "k.k", f"f0{axis}")
        start(at, "1 - k.k", f"f1{axis}")
        both = lambda a, b: " AND ".join(f"a.{c} = b.{c}" for c in line)
        cols = ", ".join(f"a.{c}" for c in line)
        q.recursive(
            f"fw{axis}",
            f"SELECT {cols}, CAST(1 AS BIGINT) AS i, b.v AS f, a.v AS p FROM f0{axis} a JOIN f1{axis} b ON {both('a', 'b')} UNION ALL SELECT {lines.replace('s.', 'r.')}, r.i + 1, {gain!r} * s.v + {b1!r} * r.f + {b2!r} * r.p, r.f FROM fw{axis} r JOIN {at} s ON {same} AND s.{axis} = r.i + 1",
        )
        q.add(f"fs{axis}", f"SELECT {', '.join(line)}, CAST(i AS INTEGER) AS {axis}, f AS v FROM fw{axis} UNION ALL SELECT {', '.join(line)}, CAST(0 AS INTEGER) AS {axis}, v FROM f0{axis}")
        start(f"fs{axis}", f"{n - 1} + k.k", f"g0{axis}")
        start(f"fs{axis}", f"{n - 2} + k.k", f"g1{axis}")
        q.recursive(
            f"bw{axis}",
            f"SELECT {cols}, CAST({n - 2} AS BIGINT) AS i, b.v AS f, a.v AS p FROM g0{axis} a JOIN g1{axis} b ON {both('a', 'b')} UNION ALL SELECT {lines.replace('s.', 'r.')}, r.i - 1, {gain!r} * s.v + {b1!r} * r.f + {b2!r} * r.p, r.f FROM bw{axis} r JOIN fs{axis} s ON {same} AND s.{axis} = r.i - 1",
        )
        at = q.add(f"sp{axis}", f"SELECT {', '.join(line)}, CAST(i AS INTEGER) AS {axis}, f AS v FROM bw{axis} UNION ALL SELECT {', '.join(line)}, CAST({n - 1} AS INTEGER) AS {axis}, v FROM g0{axis}")
    return at


def threshold_li(q: o.Sql, src: str, column: str, integer: bool, bins: int, name: str) -> str:
    """A table t of one row: the minimum cross entropy threshold over `bins` equal bins."""
    q.add(f"{name}_r", f"SELECT CAST(min({column}) AS DOUBLE) AS lo, CAST(max({column}) AS DOUBLE) AS hi FROM {src}")
    width = f"CASE WHEN {str(integer).lower()} AND hi - lo < {bins} THEN 1.0::DOUBLE ELSE (hi - lo) / {bins} END"
    q.add(f"{name}_h", f"SELECT CAST(least(floor(({column} - lo) / ({width})), {bins - 1}) AS BIGINT) AS b, count(*) AS n, sum({column} - lo) AS s FROM {src}, {name}_r GROUP BY 1")
    tol = "0.5" if integer else "least(0.01, (hi - lo) * 1e-4)"
    fore, back = f"h.b > floor(t / ({width}))", f"h.b <= floor(t / ({width}))"
    mean = lambda w: f"(SELECT sum(h.s) / sum(h.n) FROM {name}_h h WHERE {w})"
    q.recursive(
        name,
        f"SELECT 0 AS i, (SELECT sum(s) / sum(n) FROM {name}_h) AS t, false AS done UNION ALL SELECT i + 1, coalesce(new, t), coalesce(abs(new - t) <= tol, true) FROM "
        f"(SELECT i, t, tol, CASE WHEN f IS NOT NULL AND b > 0 THEN (f - b) / (ln(f) - ln(b)) END AS new FROM (SELECT i, t, {tol} AS tol, {mean(fore)} AS f, {mean(back)} AS b FROM {name}, {name}_r WHERE NOT done AND i < 200))",
    )
    return f"(SELECT max_by(t, i) + (SELECT lo FROM {name}_r) FROM {name})"


# --- kernels ------------------------------------------------------------------------------


def gaussian(size: dict[str, int], sigma: float, name: str, q: o.Sql) -> str:
    """oz, ox, oy, w of a normalised gaussian."""
    axes = " CROSS JOIN ".join(f"(SELECT CAST(unnest(range({-(size[a] // 2)}, {size[a] // 2 + 1})) AS INTEGER) AS o{a}) r{a}" for a in AXES)
    w = " * ".join(f"exp(-o{a} * o{a} / (2.0 * {sigma * sigma}))" for a in AXES if size[a] > 1)
    return q.add(name, f"SELECT oz, ox, oy, w / sum(w) OVER () AS w FROM (SELECT oz, ox, oy, {w} AS w FROM {axes})")


def downsampled(q: o.Sql, kernel: str, size: dict[str, int], meta: GridMeta, name: str) -> str:
    """level, oz, ox, oy, w: overlaps of cells as wide as a coarse cell, laid at fine places, with coarse cells."""
    parts = []
    for l in range(meta.l_min, meta.l_max + 1):
        d = min(meta.l_max - l, max(1, meta.l_max - meta.l_min) - 1)
        if d == 0:
            parts.append(f"SELECT {l} AS level, oz, ox, oy, w FROM {kernel}")
            continue
        step, froms, ws, keys, scale = 1 << d, [], [], [], 1.0
        for a in AXES:
            n = size[a]
            if n == 1:
                scale *= step
                keys.append(f"0 AS o{a}")
                continue
            scale /= step
            half = max(1, -(-(n // 2) // step))
            froms.append(f"(SELECT CAST(unnest(range({-half}, {half + 1})) AS INTEGER) AS c{a}) r{a}")
            # Coarse cell c covers [c s, c s + s), the fine place o covers [o, o + s): both about one origin.
            ws.append(f"greatest(least(c{a} * {step} + {step}, k.o{a} + {step}) - greatest(c{a} * {step}, k.o{a}), 0)")
            keys.append(f"c{a} AS o{a}")
        group = ", ".join(f"c{a}" for a in AXES if size[a] > 1)
        parts.append(f"SELECT {l} AS level, {', '.join(keys)}, sum({' * '.join(ws)} * k.w) * {scale!r} AS w FROM {kernel} k CROSS JOIN {' CROSS JOIN '.join(froms)} GROUP BY {group}")
    return q.add(name, " UNION ALL ".join(parts))


# --- cells ---------------------------------------------------------------------------------


def face_pass(q: o.Sql, cells: str, near: str, axis: str, name: str, taps=(0.25, 0.5, 0.25)) -> str:
    """near: level, z, x, y, face, nl, nz, nx, ny."""
    mean = lambda s: f"avg(c.v) FILTER (face = '{s}{axis}')"
    q.add(f"{name}_m", f"SELECT n.level, n.z, n.x, n.y, {mean('+')} AS p, {mean('-')} AS m FROM {near} n JOIN {cells} c ON c.level = n.nl AND c.z = n.nz AND c.x = n.nx AND c.y = n.ny GROUP BY 1, 2, 3, 4")
    on = " AND ".join(f"c.{a} = f.{a}" for a in ("level", *AXES))
    return q.add(name, f"SELECT c.level, c.z, c.x, c.y, {taps[1]} * c.v + {taps[2]} * coalesce(f.p, c.v) + {taps[0]} * coalesce(f.m, c.v) AS v FROM {cells} c LEFT JOIN {name}_m f ON {on}")


def convolved(q: o.Sql, cells: str, kernels: list, meta: GridMeta, reflect: bool, name: str) -> str:
    """Level-adaptive convolution of any cells (with v)."""
    inner = o.tree_mean(q, cells, meta, f"{name}_tm")
    den = o.dense_levels(q, cells, inner, meta, f"{name}_den")
    rows = [(l, *r) for l in range(meta.l_min, meta.l_max + 1) for r in filters.rows_of(kernels[min(len(kernels) - 1, meta.l_max - l)])]
    return o.convolved(q, cells, den, o.stencil(q, rows, f"{name}_st"), meta, reflect, name)


def div_norm_grad(q: o.Sql, cells: str, meta: GridMeta, name: str) -> str:
    axes = [a for a in AXES if meta.size[a] > 1]
    g = {a: convolved(q, cells, filters.rescaled_kernels(filters.difference(a), meta), meta, True, f"{name}_g{a}") for a in axes}
    first = axes[0]
    joins = " ".join(f"JOIN {g[a]} g{a} ON " + " AND ".join(f"g{first}.{c} = g{a}.{c}" for c in ("level", *AXES)) for a in axes[1:])
    length = "sqrt(" + " + ".join(f"g{a}.v * g{a}.v" for a in axes) + ")"
    parts = []
    for a in axes:
        n = q.add(f"{name}_n{a}", f"SELECT g{first}.level, g{first}.z, g{first}.x, g{first}.y, CASE WHEN {length} > 1e-6 THEN g{a}.v / {length} ELSE g{a}.v END AS v FROM {g[first]} g{first} {joins}")
        parts.append(convolved(q, n, filters.rescaled_kernels(filters.difference(a), meta), meta, True, f"{name}_d{a}"))
    return q.add(name, f"SELECT {C}, sum(v) AS v FROM ({' UNION ALL '.join(f'SELECT {C}, v FROM {p}' for p in parts)}) GROUP BY {C}")


def richardson_lucy(q: o.Sql, cells: str, psf, meta: GridMeta, iterations: int, tv: float = 0.0) -> str:
    fwd, back = filters.downsampled_kernels(psf, meta, True), filters.downsampled_kernels(psf[::-1, ::-1, ::-1], meta, True)
    est = q.add("est0", f"SELECT {C}, 1.0::DOUBLE AS v FROM {cells}")
    for i in range(iterations):
        blur = convolved(q, est, back, meta, False, f"bl{i}")
        ratio = q.add(f"ra{i}", f"SELECT a.level, a.z, a.x, a.y, a.v / nullif(b.v, 0) AS v FROM {cells} a JOIN {blur} b ON {ON}")
        step = convolved(q, ratio, fwd, meta, False, f"st{i}")
        new = q.add(f"ne{i}", f"SELECT a.level, a.z, a.x, a.y, a.v * b.v AS v FROM {est} a JOIN {step} b ON {ON}")
        if tv:
            d = div_norm_grad(q, est, meta, f"dv{i}")
            new = q.add(f"nt{i}", f"SELECT a.level, a.z, a.x, a.y, a.v / nullif(1 - {tv} * b.v, 0) AS v FROM {new} a JOIN {d} b ON {ON}")
        est = new
    return est


def adaptive_extreme(q: o.Sql, cells: str, leaf_near: str, how: str, meta: GridMeta, delta: int) -> str:
    """Fold, smooth the coarse tree once, push down, smooth the leaves once."""
    deepest = max(0, meta.l_max - 1 - delta)
    tree = o.tree_fold(q, cells, how, "ae_t")
    coarse = q.add("ae_c", f"SELECT {C}, CAST(v AS DOUBLE) AS v FROM {tree} WHERE level <= {deepest}")
    near = []
    for a in ("y", "x", "z"):
        for sign in (1, -1):
            on = " AND ".join(f"b.{c} = a.{c} + {sign if c == a else 0}" for c in AXES)
            near.append(f"SELECT a.level, a.z, a.x, a.y, '{'+' if sign > 0 else '-'}{a}' AS face, b.level AS nl, b.z AS nz, b.x AS nx, b.y AS ny FROM {coarse} a JOIN {coarse} b ON a.level = b.level AND {on}")
    q.add("ae_n", " UNION ALL ".join(near))
    for a in ("y", "x", "z"):
        if meta.size[a] > 1:
            coarse = face_pass(q, coarse, "ae_n", a, f"ae_c{a}")
    all_ = q.add("ae_a", f"SELECT {C}, v FROM {coarse} UNION ALL SELECT {C}, CAST(v AS DOUBLE) AS v FROM {tree} WHERE level > {deepest}")
    up = " AND ".join(f"a.{c} = (t.{c} >> greatest(t.level - {deepest}, 0))" for c in AXES)
    q.add("ae_p", f"SELECT t.level, t.z, t.x, t.y, a.v FROM {all_} t JOIN {all_} a ON a.level = least(t.level, {deepest}) AND {up}")
    at = q.add("ae_l", f"SELECT l.level, l.z, l.x, l.y, t.v FROM {cells} l JOIN ae_p t ON t.level = l.level - 1 AND " + " AND ".join(f"t.{c} = l.{c} // 2" for c in AXES))
    for a in ("y", "x", "z"):
        if meta.size[a] > 1:
            at = face_pass(q, at, leaf_near, a, f"ae_l{a}")
    return at


def interpolated(q: o.Sql, cells: str, meta: GridMeta) -> str:
    inner, img = o.tree_mean(q, cells, meta), None
    for l in range(meta.l_min, meta.l_max + 1):
        own = q.add(f"ow_{l}", f"SELECT {K}, CAST(v AS DOUBLE) AS v FROM {cells} WHERE level = {l} UNION ALL SELECT {K}, v FROM {inner} WHERE level = {l}")
        size = meta.at(l)
        if img is not None:
            own = q.add(f"ou_{l}", f"SELECT a.z, a.x, a.y, coalesce(b.v, a.v) AS v FROM ({upsampled(size, img)}) a LEFT JOIN ow_{l} b ON {GRID}")
        img = clamped(q, own, size, "sum(b.v) / 27", f"is_{l}")
    return img


def trained(q: o.Sql, gathered: str, cells: str, sizes: dict[int, dict[str, int]], ridge: float, meta: GridMeta) -> str:
    """level, oz, ox, oy, w: least squares over whole patches by Gauss-Jordan elimination of the normal equations.

    gathered: level, z, x, y, w (number of the place), nv; sizes: places on each axis by level.  The centre is left out."""
    places = []
    for l, size in sizes.items():
        n = [size[a] for a in AXES]
        mid, total = (n[0] * n[1] * n[2]) // 2, n[0] * n[1] * n[2]
        for p in range(total):
            oz, ox, oy = p // (n[1] * n[2]) - n[0] // 2, p // n[2] % n[1] - n[1] // 2, p % n[2] - n[2] // 2
            places.append(f"({l}, {p}, {-1 if p == mid else p - (p > mid)}, {total - 1}, {oz}, {ox}, {oy})")
    q.add("pl", f"SELECT * FROM (VALUES {', '.join(places)}) t(level, p, i, m, oz, ox, oy)")
    q.add("va", f"SELECT g.level, g.z, g.x, g.y, pl.i, pl.m, g.nv AS v FROM {gathered} g JOIN pl ON pl.level = g.level AND pl.p = g.w WHERE pl.i >= 0 UNION ALL SELECT c.level, c.z, c.x, c.y, s.m, s.m, CAST(c.v AS DOUBLE) FROM {cells} c JOIN (SELECT DISTINCT level, m FROM pl) s ON s.level = c.level")
    q.add("gr", f"SELECT a.level, a.i, b.i AS j, any_value(a.m) AS m, sum(a.v * b.v) AS v FROM va a JOIN va b ON {ON} WHERE a.i < a.m GROUP BY a.level, a.i, b.i")
    q.add("tr", "SELECT level, sum(v) / any_value(m) AS t FROM gr WHERE i = j GROUP BY level")
    most = max(s["z"] * s["x"] * s["y"] for s in sizes.values()) - 1
    pivot = lambda what, by: f"max(CASE WHEN {what} THEN v END) OVER (PARTITION BY level, {by})"
    q.recursive(
        "gj",
        f"SELECT CAST(0 AS BIGINT) AS k, gr.level, i, j, m, v + CASE WHEN i = j THEN {ridge!r} * greatest(1.0, t) ELSE 0.0 END AS v FROM gr JOIN tr ON tr.level = gr.level UNION ALL "
        f"SELECT k + 1, level, i, j, m, CASE WHEN k >= m THEN v WHEN i = k THEN v / pp ELSE v - pf * pr / pp END FROM (SELECT *, {pivot('i = k', 'j')} AS pr, {pivot('j = k', 'i')} AS pf, max(CASE WHEN i = k AND j = k THEN v END) OVER (PARTITION BY level) AS pp FROM gj WHERE k < {most})",
    )
    q.add("so", f"SELECT level, i, v FROM gj WHERE k = {most} AND j = m")
    q.add("ok", "SELECT level FROM so GROUP BY level HAVING abs(sum(v)) >= 1e-6 AND bool_and(isfinite(v))")
    return q.add("ker", "SELECT pl.level, oz, ox, oy, CASE WHEN ok.level IS NULL THEN CASE WHEN pl.i < 0 THEN 1.0 ELSE 0.0 END WHEN pl.i < 0 THEN 0.0 ELSE so.v END AS w FROM pl LEFT JOIN ok ON ok.level = pl.level LEFT JOIN so ON so.level = pl.level AND so.i = pl.i")
