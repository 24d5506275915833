"""Dense grids from fact and event tables.

A grid is a DataFrame z INT, x INT, y INT, v.  Missing cells are zeros, so the
full set of keys is generated by a range (distributed, no cross join) and the
aggregated table is joined to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.plans.meta import GridMeta

G3, G2, G1 = GridMeta(64, 64, 16), GridMeta(31, 24, 1), GridMeta(101, 1, 1)


def cells(spark: SparkSession, meta: GridMeta) -> DataFrame:
    """Every key of a grid."""
    plane = meta.nx * meta.ny
    i = F.col("id")
    return spark.range(meta.pixels).select(
        (i / plane).cast("int").alias("z") if meta.nz > 1 else F.lit(0).alias("z"),
        F.floor((i % plane) / meta.ny).cast("int").alias("x"),
        (i % meta.ny).cast("int").alias("y"),
    )


def densify(values: DataFrame, meta: GridMeta, column: str = "v", missing=0) -> DataFrame:
    """values (z, x, y, column) with every key of the grid; missing cells hold `missing`.  A key outside the grid raises."""
    kind = values.schema[column].dataType
    outside = " or ".join(f"{a} < 0 or {a} >= {meta.size[a]}" for a in ("z", "x", "y"))
    values = values.withColumn("z", F.expr(f"if({outside}, raise_error('a key lies outside the grid'), z)"))
    full = cells(values.sparkSession, meta).join(values.select("z", "x", "y", column), ["z", "x", "y"], "left")
    return full.withColumn(column, F.coalesce(F.col(column), F.lit(missing).cast(kind)))


def rasterise(rows: DataFrame, meta: GridMeta, z: Column, x: Column, y: Column, v: Column) -> DataFrame:
    """Aggregate v (an aggregate expression) by key and densify."""
    found = rows.groupBy(z.cast("int").alias("z"), x.cast("int").alias("x"), y.cast("int").alias("y")).agg(v.alias("v"))
    return densify(found, meta)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def volume(spark: SparkSession, sf_dir: str, meta: GridMeta = G3) -> DataFrame:
    """Quantities of order lines by part, supplier and order, on a geometry of any size."""
    t = read(spark, sf_dir, "lineitem")
    return rasterise(t, meta, F.col("l_orderkey") % meta.nz, F.col("l_suppkey") % meta.nx, F.col("l_partkey") % meta.ny, F.sum(F.col("l_quantity").cast("long")))


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2: events by hour and day of the month."""
    t = read(spark, sf_dir, "events")
    return rasterise(t, G2, F.lit(0), F.hour("ts"), F.dayofmonth("ts") - 1, F.count("*"))


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: event values by user."""
    t = read(spark, sf_dir, "events")
    return rasterise(t, G1, F.lit(0), F.lit(0), F.col("user_id") % 101, F.sum(F.floor("value").cast("long")))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes 0 to 2 over G2: the hour's events, by thirds of 36, of a quarter of the image."""
    return image(spark, sf_dir).withColumn("v", F.when((F.col("x") < 12) & (F.col("y") < 15), F.col("v") % 3).otherwise((F.floor(F.col("x") / 6) + F.floor(F.col("y") / 10)) % 3).cast("long"))
