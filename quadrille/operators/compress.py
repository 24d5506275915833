"""Lossy value compression as projections: variance stabilisation, rounding, zigzag symbols."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Codec:
    """kind 0 leaves values alone.  cnv is the whole-number quotient 65636 div 30000."""

    kind: int = 1
    e: float = 1.6
    background: float = 1.0
    q: float = 0.5
    cnv: float = 2.0


def stabilise(v: Column, c: Codec) -> Column:
    return (2 * F.sqrt(F.greatest(v - c.background, F.lit(0.0)) / c.cnv + c.e * c.e) - 2 * c.e) / c.q


def restore(s: Column, c: Codec) -> Column:
    d = c.q * s + 2 * c.e
    return F.when(d >= 2 * c.e, (d * d / 4 - c.e * c.e) * c.cnv + c.background).otherwise(F.lit(c.background))


def to_symbol(v: Column) -> Column:
    """Zigzag of the rounded value: 0, -1, 1, -2, ... become 0, 1, 2, 3, ..."""
    r = F.round(v).cast("long")
    return F.when(r >= 0, 2 * r).otherwise(-2 * r - 1)


def from_symbol(s: Column) -> Column:
    return F.when(s % 2 == 0, F.shiftright(s, 1)).otherwise(-F.shiftright(s + 1, 1))


def compress(cells: DataFrame, c: Codec = Codec()) -> DataFrame:
    return cells if c.kind != 1 else cells.withColumn("v", to_symbol(stabilise(F.col("v").cast("double"), c)))


def decompress(cells: DataFrame, c: Codec = Codec()) -> DataFrame:
    return cells if c.kind != 1 else cells.withColumn("v", restore(from_symbol(F.col("v")).cast("double"), c))
