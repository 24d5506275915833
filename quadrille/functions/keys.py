"""Column expressions over cell keys (level, z, x, y)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.plans.meta import AXES, GridMeta

KEY = ["z", "x", "y"]
CELL = ["level", "z", "x", "y"]


def extent(meta: GridMeta, axis: str, level: Column | str = "level") -> Column:
    """Cells on an axis at the row's level: a literal map over the few levels."""
    pairs = [x for l in range(meta.l_max + 1) for x in (F.lit(l), F.lit(meta.n(l, axis)))]
    return F.create_map(*pairs)[F.col(level) if isinstance(level, str) else level]


def level_size(meta: GridMeta, level: Column | str = "level") -> Column:
    c = F.col(level) if isinstance(level, str) else level
    return F.call_function("shiftleft", F.lit(1), F.lit(meta.l_max) - c).cast("int")


def clamp_weight(sizes: dict[str, int]) -> Column:
    """How often a cell counts in its parent: twice on an axis of odd length at its end, so every parent has eight."""
    parts = [F.when(F.col(a) == n - 1, 2).otherwise(1) for a, n in sizes.items() if n % 2]
    return reduce(lambda p, q: p * q, parts, F.lit(1))


def clamp_weight_by_level(meta: GridMeta) -> Column:
    """clamp_weight for rows that carry their level."""
    parts = [F.when((extent(meta, a) % 2 == 1) & (F.col(a) == extent(meta, a) - 1), 2).otherwise(1) for a in AXES]
    return reduce(lambda p, q: p * q, parts)


def inside(meta: GridMeta, level: Column | str = "level") -> Column:
    return reduce(lambda p, q: p & q, [(F.col(a) >= 0) & (F.col(a) < extent(meta, a, level)) for a in AXES])


def extent_sql(meta: GridMeta, axis: str, level: str) -> str:
    pairs = ", ".join(f"{l}, {meta.n(l, axis)}" for l in range(meta.l_max + 1))
    return f"coalesce(try_element_at(map({pairs}), {level}), 0)"


def clamp_steps(meta: GridMeta, level: str, d: str = "d") -> str:
    """SQL for how many of the d steps up from a cell of a level, over all axes, leave the clamped end of an odd axis.

    The cell then counts 2**steps times in its ancestor, and weights 2**steps / 8**d add up to one."""
    return " + ".join(
        f"if({d} > {k} and {level} - {k} > 0 and {extent_sql(meta, a, f'{level} - {k}')} % 2 = 1 and shiftright({a}, {k}) = {extent_sql(meta, a, f'{level} - {k}')} - 1, 1, 0)" for a in AXES for k in range(meta.l_max + 1)
    )


#: A prime whose square fits a long, and odd factors of the key's parts.
PRIME, FACTORS = 2147483647, {"level": 73856093, "z": 19349663, "x": 83492791, "y": 49979687}


def noise(seed: int) -> str:
    """SQL for a number in [0, 1) from a cell's key: a mix modulo a prime, squared twice."""
    at = " + ".join(f"cast({c} + 1 as bigint) * {f}" for c, f in FACTORS.items())
    for _ in range(2):
        at = f"(({at} + {(seed + 1) * 1000003}) % {PRIME})"
        at = f"({at} * {at} % {PRIME} + {at})"
    return f"({at} % {PRIME} / cast({PRIME} as double))"
