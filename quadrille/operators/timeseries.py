"""Time points as key frames and deltas: what is added, removed and updated between two structures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.keys import CELL, KEY

ADD, REMOVE, UPDATE = "add", "remove", "update"


def delta(before: DataFrame, after: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """level, z, x, y, op, v that turn before into after; values within the tolerance stay."""
    both = before.select(*CELL, F.col("v").alias("b")).join(after.select(*CELL, F.col("v").alias("a")), CELL, "full")
    op = F.when(F.col("b").isNull(), ADD).when(F.col("a").isNull(), REMOVE).when(F.abs(F.col("a") - F.col("b")) > tolerance, UPDATE)
    return both.select(*CELL, op.alias("op"), F.col("a").alias("v")).where(F.col("op").isNotNull())


def replay(key_frame: DataFrame, deltas: DataFrame, t: int) -> DataFrame:
    """The structure at time t: the last word on each key among the key frame and the deltas (with column t) up to t."""
    start = key_frame.select(*CELL, F.lit(-1).alias("t"), F.lit(ADD).alias("op"), "v")
    words = start.unionByName(deltas.where(F.col("t") <= t).select(*CELL, F.col("t").cast("int").alias("t"), "op", "v"))
    last = words.groupBy(*CELL).agg(F.max_by(F.struct("op", "v"), "t").alias("w"))
    return last.where(F.col("w.op") != REMOVE).select(*CELL, F.col("w.v").alias("v"))


def transfer(source: DataFrame, target: DataFrame, l_max: int) -> DataFrame:
    """Values of source at the cells of target: the same key, else the nearest ancestor, else the mean of what lies below."""
    d = F.explode(F.sequence(F.lit(0), F.col("level") - 1))
    up = target.select(*CELL).withColumn("d", d).select(*CELL, "d", (F.col("level") - F.col("d")).alias("sl"), *[F.call_function("shiftright", F.col(a), F.col("d")).alias(f"s{a}") for a in KEY])
    src = source.select(F.col("level").alias("sl"), *[F.col(a).alias(f"s{a}") for a in KEY], F.col("v").cast("double").alias("v"))
    above = up.join(src, ["sl", "sz", "sx", "sy"]).select(*CELL, "d", "v").groupBy(*CELL).agg(F.min_by("v", "d").alias("v"))
    down = source.select(*CELL, F.col("v").cast("double").alias("v")).withColumn("d", F.explode(F.sequence(F.lit(1), F.col("level"))))
    below = down.select((F.col("level") - F.col("d")).alias("level"), *[F.call_function("shiftright", F.col(a), F.col("d")).alias(a) for a in KEY], "v").join(target.select(*CELL), CELL).groupBy(*CELL).agg(F.avg("v").alias("v"))
    return above.unionByName(below.join(above, CELL, "left_anti"))


def latest(frames: DataFrame) -> DataFrame:
    """The last time point of each key, as rows with t."""
    w = Window.partitionBy(*CELL).orderBy(F.desc("t"))
    return frames.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
