"""Shared folder, tables and small helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def configure(spark: SparkSession) -> SparkSession:
    """Hold Arrow batches of the session to a few MB: rows of long texts fill the default ones with tens of MB on either side.

    Called by the registered queries and the pipeline, which own their session; operators leave settings alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark


def trim() -> None:
    """Give freed memory back: a Python worker lives on through later stages with what its allocators hold."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(f):
    """A function over batches that trims the worker when its task ends."""

    @functools.wraps(f)
    def run(frames):
        try:
            yield from f(frames)
        finally:
            trim()

    return run


def lean_groups(f):
    """A function over groups, of one frame or of two, that trims the worker after each."""

    def one(frame):
        try:
            return f(frame)
        finally:
            trim()

    def two(left, right):
        try:
            return f(left, right)
        finally:
            trim()

    # Spark reads the number of arguments off the signature; those with defaults are bound already.
    return one if f.__code__.co_argcount - len(f.__defaults__ or ()) == 1 else two


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where it is unset, a local master (tests) gets one made and set; a cluster has no folder to fall back on, so it raises."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quadrille-")
        spark.sparkContext.setCheckpointDir(root)
    return root if "://" in root or root.startswith("file:") else ("file://" + root if root.startswith("/") else root)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a settled table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def files_of(uri: str):
    """File system and path of a URI, for tasks that read or write plain files of the shared folder."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def put(uri: str, raw: bytes) -> None:
    """Write a file whole: attempts write under a name of their own and move it, so a reader never meets a torn file."""
    fs, path = files_of(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(raw)
    fs.move(part, path)


def take(uri: str) -> bytes:
    fs, path = files_of(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def kind_of(df: DataFrame, column: str) -> str:
    """A column's type as text."""
    return df.schema[column].dataType.simpleString()


def crc_mod(column: str, n: int):
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))



def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name
