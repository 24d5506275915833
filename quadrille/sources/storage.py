"""Structures, properties and images as partitioned Parquet.

<root>/cells/channel=../t=../level=..    structure and properties in separate tables
<root>/parts/name=../channel=../t=../level=..
<root>/meta                              one JSON row for each channel and time point

Levels are partitions, so a partial read prunes files; rows are sorted by z and
x inside files, so slices and rows are pruned by Parquet statistics.  The
codec is zstd unless told otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions.keys import CELL, KEY
from quadrille.operators import compress, particles
from quadrille.plans.meta import GridMeta

READ, WRITE, READWRITE = "read", "write", "readwrite"


class CellStore:
    def __init__(self, spark: SparkSession, root: str, mode: str = READ, codec: str = "zstd"):
        self.spark, self.root, self.mode, self.codec, self.read_delta = spark, root.rstrip("/"), mode, codec, 0
        if mode == WRITE:
            self._delete(self.root)

    def _path(self, p: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(p)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _delete(self, p: str) -> None:
        path, fs = self._path(p)
        fs.delete(path, True)

    def _exists(self, p: str) -> bool:
        path, fs = self._path(p)
        return fs.exists(path)

    def _writable(self) -> None:
        if self.mode == READ:
            raise PermissionError("the store is open for reading")

    def _save(self, df: DataFrame, table: str, by: list[str]) -> None:
        # Existing partitions of the same key are replaced, all others stay.
        rows = df.repartition(*[c for c in by if c in df.columns], "z").sortWithinPartitions("z", "x", "y")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", self.codec).partitionBy(*by).parquet(f"{self.root}/{table}")

    # --- structure ---

    def write_cells(self, cells: DataFrame, meta: GridMeta, t: int = 0, channel: str = "t", tree: bool = False) -> None:
        self._writable()
        rows = cells.select(*CELL).withColumn("channel", F.lit(channel)).withColumn("t", F.lit(t))
        self._save(rows, "cells", ["channel", "t", "level"])
        if tree:
            self._save(particles.tree(cells).withColumn("channel", F.lit(channel)).withColumn("t", F.lit(t)), "tree", ["channel", "t", "level"])
        m = self.spark.createDataFrame([(channel, t, meta.ny, meta.nx, meta.nz)], "channel string, t int, ny int, nx int, nz int")
        m.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("channel", "t").json(f"{self.root}/meta")

    def append_cells(self, cells: DataFrame, meta: GridMeta, channel: str = "t", tree: bool = False) -> int:
        t = self.number_of_time_steps(channel)
        self.write_cells(cells, meta, t, channel, tree)
        return t

    def read_meta(self, t: int = 0, channel: str = "t") -> GridMeta:
        r = self.spark.read.schema("ny int, nx int, nz int, channel string, t int").json(f"{self.root}/meta").where((F.col("channel") == channel) & (F.col("t") == t)).first()
        if r is None:
            raise FileNotFoundError(f"no channel {channel!r} at {t}")
        return GridMeta(r["ny"], r["nx"], r["nz"])

    def _read(self, table: str, schema: str, t: int, channel: str) -> DataFrame:
        df = self.spark.read.schema(f"{schema}, channel string, t int, level int").parquet(f"{self.root}/{table}").where((F.col("channel") == channel) & (F.col("t") == t))
        if self.read_delta:
            df = df.where(F.col("level") <= self.read_meta(t, channel).l_max - self.read_delta)
        return df

    def read_cells(self, t: int = 0, channel: str = "t", tree: bool = False) -> DataFrame:
        return self._read("tree" if tree else "cells", "z int, x int, y int", t, channel).select(*CELL)

    # --- properties ---

    def write_property(self, name: str, cells: DataFrame, t: int = 0, channel: str = "t", codec: compress.Codec | None = None) -> None:
        """cells with v.  An existing property is replaced only by one of the same type and number of rows."""
        self._writable()
        rows = (compress.compress(cells, codec) if codec else cells).select(*CELL, "v")
        if self._exists(f"{self.root}/parts/name={name}/channel={channel}/t={t}"):
            old = self.read_property(name, t, channel)
            if old.schema["v"].dataType != rows.schema["v"].dataType or old.count() != rows.count():
                raise ValueError(f"{name!r} exists with another type or size")
        self._save(rows.withColumn("channel", F.lit(channel)).withColumn("t", F.lit(t)), f"parts/name={name}", ["channel", "t", "level"])

    def property_type(self, name: str):
        return self.spark.read.parquet(f"{self.root}/parts/name={name}").schema["v"].dataType

    def read_property(self, name: str, t: int = 0, channel: str = "t", kind: str | None = None, codec: compress.Codec | None = None) -> DataFrame:
        found = self.property_type(name).simpleString()
        if kind and kind != found:
            raise TypeError(f"{name!r} holds {found}, not {kind}")
        rows = self._read(f"parts/name={name}", f"z int, x int, y int, v {found}", t, channel).select(*CELL, "v")
        return compress.decompress(rows, codec) if codec else rows

    def scan(self, name: str, level: int, z: tuple[int, int] | None = None, x: int | None = None, t: int = 0, channel: str = "t") -> DataFrame:
        """A range, slice or row of a property without reading the rest."""
        rows = self.read_property(name, t, channel).where(F.col("level") == level)
        if z is not None:
            rows = rows.where(F.col("z").between(*z))
        return rows if x is None else rows.where(F.col("x") == x)

    def write_slice(self, name: str, rows: DataFrame, level: int, t: int = 0, channel: str = "t") -> None:
        """Replace slices (level, z) of a stored property by rows (z, x, y, v); its other slices stay."""
        self._writable()
        old = self.read_property(name, t, channel).where(F.col("level") == level)
        keep = old.join(rows.select("z").distinct(), "z", "left_anti").select(*CELL, "v")
        new = rows.select(F.lit(level).alias("level"), *KEY, F.col("v").cast(self.property_type(name)).alias("v"))
        # What is read is written over, so it is settled first.
        all_ = keep.unionByName(new).withColumn("channel", F.lit(channel)).withColumn("t", F.lit(t)).checkpoint()
        self._save(all_, f"parts/name={name}", ["channel", "t", "level"])

    def row_ranges(self, level: int, t: int = 0, channel: str = "t") -> DataFrame:
        """z, x, n, begin, stop: the cells of each stored row of a level, numbered from the level's first."""
        n = self.read_cells(t, channel).where(F.col("level") == level).groupBy("z", "x").agg(F.count("*").alias("n"))
        slices = n.groupBy("z").agg(F.sum("n").alias("m"))
        base = slices.select("z", F.coalesce(F.sum("m").over(Window.orderBy("z").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        stop = F.col("base") + F.sum("n").over(Window.partitionBy("z").orderBy("x"))
        return n.join(base, "z").select("z", "x", "n", (stop - F.col("n")).alias("begin"), stop.alias("stop"))

    # --- images ---

    def write_image(self, name: str, grid: DataFrame, block: int = 16) -> None:
        self._writable()
        rows = grid.withColumn("zb", F.floor(F.col("z") / block).cast("int"))
        rows.repartition("zb").sortWithinPartitions("z", "x", "y").write.mode("overwrite").option("compression", self.codec).partitionBy("zb").parquet(f"{self.root}/image={name}")

    def read_image(self, name: str, z: tuple[int, int] | None = None, block: int = 16) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/image={name}")
        if z is not None:
            df = df.where(F.col("z").between(*z) & F.col("zb").between(z[0] // block, z[1] // block))
        return df.select(*KEY, "v")

    # --- catalogue ---

    def _listed(self) -> DataFrame:
        return self.spark.read.schema("ny int, channel string, t int").json(f"{self.root}/meta").select("channel", "t").distinct()

    def number_of_time_steps(self, channel: str = "t") -> int:
        if not self._exists(f"{self.root}/meta"):
            return 0
        return self._listed().where(F.col("channel") == channel).count()

    def channels(self) -> list[str]:
        return sorted(r["channel"] for r in self._listed().select("channel").distinct().collect())

    def properties(self) -> list[str]:
        path, fs = self._path(f"{self.root}/parts")
        return sorted(s.getPath().getName().removeprefix("name=") for s in fs.listStatus(path)) if fs.exists(path) else []

    def size_mb(self) -> float:
        path, fs = self._path(self.root)
        return fs.getContentSummary(path).getLength() / 1e6
