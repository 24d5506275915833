"""SQL text of the same computations for another engine, written from the definitions rather than from the Spark plans.

Chains of common table expressions: grids from the tables, clamped gathers for
downsampling, one dense image per level for the filters."""

from __future__ import annotations

from quadrille.plans.grids import G1, G2, G3
from quadrille.plans.meta import AXES, GridMeta

K = "z, x, y"
C = "level, z, x, y"


class Sql:
    """A growing WITH list; each step gives its name."""

    def __init__(self):
        self.parts: list[tuple[str, str]] = []
        self.own: set[str] = set()

    def add(self, name: str, body: str) -> str:
        if name not in dict(self.parts):
            self.parts.append((name, body))
        return name

    def recursive(self, name: str, body: str) -> str:
        """A step that names itself."""
        self.own.add(name)
        return self.add(name, body)

    def text(self, final: str) -> str:
        steps = ",\n".join(f"{n} AS ({b})" if n in self.own else f"{n} AS MATERIALIZED ({b})" for n, b in self.parts)
        return f"WITH {'RECURSIVE ' if self.own else ''}{steps}\n{final}"


def _axes(meta: GridMeta, names: str = "zxy") -> str:
    return " CROSS JOIN ".join(f"(SELECT CAST(unnest(range({meta.size[a]})) AS INTEGER) AS {a}) r{a}" for a in names)


def grid(q: Sql, which: str) -> str:
    """g3, g2, g1 or lab."""
    meta = {"g3": G3, "g2": G2, "g1": G1}.get(which)
    if which == "lab":
        src = grid(q, "g2")
        return q.add("lab", f"SELECT {K}, CAST(CASE WHEN x < 12 AND y < 15 THEN v % 3 ELSE (x // 6 + y // 10) % 3 END AS BIGINT) AS v FROM {src}")
    rows = {
        "g3": "SELECT l_orderkey % 16 AS z, l_suppkey % 64 AS x, l_partkey % 64 AS y, sum(CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY 1, 2, 3",
        "g2": "SELECT 0 AS z, hour(ts) AS x, day(ts) - 1 AS y, count(*) AS v FROM events GROUP BY 1, 2, 3",
        "g1": "SELECT 0 AS z, 0 AS x, user_id % 101 AS y, sum(CAST(floor(value) AS BIGINT)) AS v FROM events GROUP BY 1, 2, 3",
    }[which]
    return q.add(which, f"SELECT rz.z, rx.x, ry.y, CAST(coalesce(s.v, 0) AS BIGINT) AS v FROM {_axes(meta)} LEFT JOIN ({rows}) s ON s.z = rz.z AND s.x = rx.x AND s.y = ry.y")


def half(q: Sql, src: str, meta: GridMeta, how: str, name: str) -> str:
    """Eight clamped children of each coarse cell, gathered."""
    agg = {"mean": "sum(s.v) / 8.0", "sum": "CAST(sum(s.v) AS BIGINT)", "max": "max(s.v)", "min": "min(s.v)"}[how]
    offs = " CROSS JOIN ".join(f"(VALUES (0), (1)) o{a}(d{a})" for a in AXES)
    on = " AND ".join(f"s.{a} = least(2 * r{a}.{a} + d{a}, {meta.size[a] - 1})" for a in AXES)
    return q.add(name, f"SELECT rz.z, rx.x, ry.y, {agg} AS v FROM {_axes(meta.half())} CROSS JOIN {offs} JOIN {src} s ON {on} GROUP BY 1, 2, 3")


def lag(a: str, v: str = "v", f: str = "lag") -> str:
    return f"{f}({v}) OVER (PARTITION BY {', '.join(b for b in AXES if b != a)} ORDER BY {a})"


def around(a: str, r: int, agg: str, v: str = "v", more: str = "") -> str:
    return f"{agg}({v}) OVER (PARTITION BY {more}{', '.join(b for b in AXES if b != a)} ORDER BY {a} RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING)"


def gradient_half(q: Sql, src: str, meta: GridMeta, name: str) -> str:
    d = [f"((coalesce({lag(a, f='lead')}, v) - coalesce({lag(a)}, v)) / 2.0)" for a in AXES]
    q.add(f"{name}_full", f"SELECT {K}, sqrt({' + '.join(f'{x} * {x}' for x in d)}) AS v FROM {src}")
    return half(q, f"{name}_full", meta, "max", name)


def required(q: Sql, src: str, meta: GridMeta, rel_error: float, grad_th: float, name: str = "req") -> str:
    """Levels with a constant scale."""
    g, i = gradient_half(q, src, meta, f"{name}_grad"), half(q, src, meta, "mean", f"{name}_half")
    c = float(2**meta.l_max) / rel_error
    q.add(f"{name}_e", f"SELECT g.z, g.x, g.y, CASE WHEN g.v < {grad_th} THEN 0.0 ELSE g.v END AS g, (SELECT avg(v) - min(v) FROM {i}) AS s FROM {g} g")
    e = f"CASE WHEN s > 0 THEN g / s * {c!r} WHEN g > 0 THEN 4294967295.0 ELSE 0.0 END"
    return q.add(name, f"SELECT {K}, CAST(length(bin(CAST(floor(least({e}, 4294967295.0)) AS BIGINT))) - 1 AS INTEGER) AS v FROM {name}_e")


def level_pyramid(q: Sql, req: str, meta: GridMeta, name: str = "lp") -> str:
    top, size = max(1, meta.l_max - 1), meta.half()
    at = q.add(f"{name}_{top}", f"SELECT {K}, CAST(least(greatest(v, {meta.l_min}), {top}) AS INTEGER) AS v FROM {req}")
    parts = [f"SELECT {top} AS level, {K}, v FROM {at}"]
    for l in range(top - 1, meta.l_min - 1, -1):
        at, size = half(q, at, size, "max", f"{name}_{l}"), size.half()
        parts.append(f"SELECT {l} AS level, {K}, v FROM {at}")
    return q.add(name, " UNION ALL ".join(parts))


def solve(q: Sql, req: str, meta: GridMeta, name: str = "sol") -> str:
    at = level_pyramid(q, req, meta, f"{name}_lp")
    near = [f"b.{a} BETWEEN a.{a} - 1 AND a.{a} + 1" for a in meta.half().active]
    q.add(f"{name}_n", f"SELECT a.level, a.z, a.x, a.y, any_value(a.v) AS v, max(b.v) AS n FROM {at} a JOIN {at} b ON a.level = b.level AND {' AND '.join(near or ['a.y = b.y'])} GROUP BY 1, 2, 3, 4" if meta.pixels < 5000 else _near_windows(q, at, meta, name))
    q.add(f"{name}_t", f"SELECT {C}, CASE WHEN v = level THEN 1 WHEN n = level THEN 2 ELSE 3 END AS type FROM {name}_n WHERE n <= level")
    return q.add(name, f"SELECT t.* FROM {name}_t t WHERE NOT EXISTS (SELECT 1 FROM {name}_t p WHERE p.level = t.level - 1 AND p.z = t.z // 2 AND p.x = t.x // 2 AND p.y = t.y // 2)")


def _near_windows(q: Sql, at: str, meta: GridMeta, name: str) -> str:
    prev, col = at, "v"
    for a in meta.half().active:
        prev = q.add(f"{name}_w{a}", f"SELECT {C}, v, {around(a, 1, 'max', col, 'level, ')} AS n FROM {prev}")
        col = "n"
    return f"SELECT {C}, v, n FROM {prev}"


def extent(meta: GridMeta, a: str, level: str = "level") -> str:
    return "CASE " + level + " " + " ".join(f"WHEN {l} THEN {meta.n(l, a)}" for l in range(meta.l_max + 1)) + " END"


def to_leaves(q: Sql, sol: str, meta: GridMeta, split: str = "type <= 1", name: str = "leaf") -> str:
    kids = " CROSS JOIN ".join(f"(VALUES {'(0), (1)' if meta.size[a] > 1 else '(0)'}) o{a}(d{a})" for a in AXES)
    keys = ", ".join(f"CAST({'2 * ' if meta.size[a] > 1 else ''}{a} + d{a} AS INTEGER) AS {a}" for a in AXES)
    q.add(f"{name}_kids", f"SELECT CAST(level + 1 AS INTEGER) AS level, {keys} FROM {sol} CROSS JOIN {kids} WHERE {split}")
    ok = " AND ".join(f"{a} < {extent(meta, a)}" for a in AXES)
    return q.add(name, f"SELECT CAST(level AS INTEGER) AS level, {K} FROM {sol} WHERE NOT ({split}) UNION ALL SELECT {C} FROM {name}_kids WHERE {ok}")


def leaves(q: Sql, which: str, meta: GridMeta, rel_error: float, grad_th: float) -> str:
    return to_leaves(q, solve(q, required(q, grid(q, which), meta, rel_error, grad_th), meta), meta)


def pyramid(q: Sql, src: str, meta: GridMeta, how: str = "mean", name: str = "pyr", l_min: int = 1) -> str:
    at, size, parts = src, meta, [f"SELECT {meta.l_max} AS level, {K}, v FROM {src}"]
    for l in range(meta.l_max - 1, l_min - 1, -1):
        at, size = half(q, at, size, how, f"{name}_{l}"), size.half()
        parts.append(f"SELECT {l} AS level, {K}, v FROM {at}")
    return q.add(name, " UNION ALL ".join(parts))


def sampled(q: Sql, leaf: str, src: str, meta: GridMeta, how: str = "mean", name: str = "cell") -> str:
    p = pyramid(q, src, meta, how, f"{name}_pyr")
    return q.add(name, f"SELECT l.level, l.z, l.x, l.y, p.v FROM {leaf} l JOIN {p} p ON p.level = l.level AND p.z = l.z AND p.x = l.x AND p.y = l.y")


def tree(q: Sql, leaf: str, name: str = "tree") -> str:
    return q.add(name, f"SELECT DISTINCT CAST(level - d AS INTEGER) AS level, CAST(z >> d AS INTEGER) AS z, CAST(x >> d AS INTEGER) AS x, CAST(y >> d AS INTEGER) AS y FROM (SELECT {C}, CAST(unnest(range(1, level + 1)) AS INTEGER) AS d FROM {leaf})")


def tree_fold(q: Sql, cell: str, agg: str, name: str) -> str:
    return q.add(name, f"SELECT CAST(level - d AS INTEGER) AS level, CAST(z >> d AS INTEGER) AS z, CAST(x >> d AS INTEGER) AS x, CAST(y >> d AS INTEGER) AS y, {agg}(v) AS v FROM (SELECT {C}, v, CAST(unnest(range(1, level + 1)) AS INTEGER) AS d FROM {cell}) GROUP BY 1, 2, 3, 4")


def tree_mean(q: Sql, cell: str, meta: GridMeta, name: str = "tm") -> str:
    """Level by level; a child at the odd end of an axis counts twice."""
    prev, parts = None, []
    for l in range(meta.l_max, 0, -1):
        src = f"SELECT {K}, CAST(v AS DOUBLE) AS v FROM {cell} WHERE level = {l}" + (f" UNION ALL SELECT {K}, v FROM {prev}" if prev else "")
        w = " * ".join(f"(CASE WHEN {meta.n(l, a) % 2} = 1 AND {a} = {meta.n(l, a) - 1} THEN 2 ELSE 1 END)" for a in AXES)
        prev = q.add(f"{name}_{l - 1}", f"SELECT CAST(z // 2 AS INTEGER) AS z, CAST(x // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y, sum(v * {w}) / 8.0 AS v FROM ({src}) GROUP BY 1, 2, 3")
        parts.append(f"SELECT {l - 1} AS level, {K}, v FROM {prev}")
    return q.add(name, " UNION ALL ".join(parts))


def dense_levels(q: Sql, cell: str, inner: str, meta: GridMeta, name: str = "den") -> str:
    """For each level l its image: cells of l and coarser spread out, interior values at l."""
    parts = [f"SELECT level AS l, {K}, CAST(v AS DOUBLE) AS v FROM {inner} WHERE level >= 1"]
    for k in range(meta.l_min, meta.l_max + 1):
        for l in range(k, meta.l_max + 1):
            s = 1 << (l - k)
            rng = [f"range({a} * {s}, least({a} * {s} + {s}, {meta.n(l, a)}))" if meta.size[a] > 1 else "range(1)" for a in AXES]
            parts.append(f"SELECT {l} AS l, CAST(z AS INTEGER) AS z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, v FROM (SELECT z, x, unnest({rng[2].replace('y *', 'y0 *') if meta.size['y'] > 1 else rng[2]}) AS y, v FROM (SELECT z, unnest({rng[1].replace('x *', 'x0 *') if meta.size['x'] > 1 else rng[1]}) AS x, y0, v FROM (SELECT unnest({rng[0]}) AS z, x AS x0, y AS y0, CAST(v AS DOUBLE) AS v FROM {cell} WHERE level = {k})))")
    return q.add(name, " UNION ALL ".join(parts))


def stencil(q: Sql, rows: list[tuple], name: str) -> str:
    """rows: level, oz, ox, oy, w."""
    return q.add(name, f"SELECT * FROM (VALUES {', '.join(f'({l}, {a}, {b}, {c}, CAST({w!r} AS DOUBLE))' for l, a, b, c, w in rows)}) t(level, oz, ox, oy, w)")


def gathered(q: Sql, cell: str, den: str, st: str, meta: GridMeta, reflect: bool, name: str) -> str:
    def at(a: str) -> str:
        p, n = f"(c.{a} + s.o{a})", f"({extent(meta, a, 'c.level')})"
        return f"CASE WHEN {p} < 0 THEN -{p} WHEN {p} > {n} - 1 THEN 2 * ({n} - 1) - {p} ELSE {p} END" if reflect else p

    on = " AND ".join(f"d.{a} = {at(a)}" for a in AXES)
    return q.add(name, f"SELECT c.level, c.z, c.x, c.y, s.w, d.v AS nv FROM {cell} c JOIN {st} s ON s.level = c.level JOIN {den} d ON d.l = c.level AND {on}")


def convolved(q: Sql, cell: str, den: str, st: str, meta: GridMeta, reflect: bool, name: str) -> str:
    g = gathered(q, cell, den, st, meta, reflect, f"{name}_g")
    return q.add(name, f"SELECT {C}, sum(w * nv) AS v FROM {g} GROUP BY {C}")


def pixels(q: Sql, cell: str, meta: GridMeta, name: str = "pix") -> str:
    """Each finest pixel with its cell, found from the pixel's side."""
    on = " AND ".join(f"c.{a} = r{a}.{a} >> ({meta.l_max} - c.level)" for a in AXES)
    parts = []
    for l in range(meta.l_min, meta.l_max + 1):
        s = meta.l_max - l
        on = " AND ".join(f"c.{a} = (r{a}.{a} >> {s})" for a in AXES)
        parts.append(f"SELECT rz.z, rx.x, ry.y, c.level, c.v FROM {_axes(meta)} JOIN {cell} c ON c.level = {l} AND {on}")
    return q.add(name, " UNION ALL ".join(parts))
