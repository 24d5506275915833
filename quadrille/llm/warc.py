"""WARC as a Spark data source: write archives, plan file partitions, push down header predicates.

Reading plans partitions over the files that the archive's manifests list.  In
a file every record's headers are parsed first; comparisons, IN and null tests
on the columns that headers hold, and prefixes of the url, are decided on
them, and the block of an unwanted record is passed over by its length without
decoding.  With option payload=false no block is decoded.  Payloads lie
deflated in an HTTP message, so the WARC headers stay readable in place.

A writing task makes files of its own name; the driver's commit lists those of
the successful attempts in a manifest of its own, so files of lost attempts
are never read, appending adds to what is there, and overwriting drops the
manifests that it replaces.

Defined results: null html is an empty payload; very long html is one record;
a null page_id or url leaves its header out and reads back as null; control
characters, percent signs and outer blanks of a url are percent-escaped in the
header and read back as they were; of rows that repeat the smallest page_id of
a payload one is the response and the others revisit it; rows that repeat a
page_id otherwise are records each, with record ids of their own; other
columns, whatever their names, are ignored; page_id is a whole number (other
ids raise); an empty table gives an archive without files.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

from quadrille.llm.common import files_of, scratch, settle

ROLL, PART = 64 << 20, 64 << 20
LEAST = 100
MANIFEST = "_MANIFEST-"
SCHEMA = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = {"record_type": "warc-type", "page_id": "x-page-id", "url": "warc-target-uri", "payload_digest": "warc-payload-digest", "payload_bytes": "x-payload-length", "refers_to": "x-refers-to-page-id"}
NUMBERS = {"page_id", "payload_bytes", "refers_to"}
#: Predicates that headers decide.
TESTS = {
    EqualTo: lambda v, x: v is not None and v == x, In: lambda v, x: v is not None and v in x, IsNull: lambda v, x: v is None, IsNotNull: lambda v, x: v is not None,
    GreaterThan: lambda v, x: v is not None and v > x, GreaterThanOrEqual: lambda v, x: v is not None and v >= x, LessThan: lambda v, x: v is not None and v < x, LessThanOrEqual: lambda v, x: v is not None and v <= x,
    StringStartsWith: lambda v, x: v is not None and v.startswith(x),
}


def record_id(page_id, digest: str, copy: int = 1) -> str:
    """Of the copy-th record of a page with a payload."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}:{digest}:{copy}')}>"


def _safe(value: str) -> str:
    """A header value on one line that unquote() gives back: control characters, percent signs and outer blanks are escaped."""
    inner = value.strip(" ")
    lead = len(value) - len(value.lstrip(" "))
    blank = "%20"
    body = "".join("".join(f"%{b:02X}" for b in c.encode()) if ord(c) < 32 or 127 <= ord(c) < 160 or c in "%\u2028\u2029" else c for c in inner)
    return blank * lead + body + blank * (len(value) - lead - len(inner))


def serialise(page_id, url, digest: str, n: int, payload: bytes | None, refers_to, copy: int = 1) -> bytes:
    """One record; payload None for a revisit."""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest, copy)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_safe(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n}"]
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    else:
        body = zlib.compress(payload, 3)
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Encoding: deflate\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "replace") + block + b"\r\n\r\n"


def decode(block: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    return zlib.decompress(body) if b"content-encoding: deflate" in head.lower() else body


def records(stream, wanted, payload: bool) -> Iterator[tuple[dict, bytes | None]]:
    """(headers, payload) of the records whose headers pass `wanted`; other blocks are skipped unread."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        if not wanted(head):
            stream.seek(size, io.SEEK_CUR)
        elif payload and head["warc-type"] == "response":
            yield head, decode(stream.read(size))
        else:
            stream.seek(size, io.SEEK_CUR)
            yield head, None


def _value(head: dict, column: str):
    v = head.get(FIELDS[column])
    if v is None:
        return None
    return int(v) if column in NUMBERS else v.removeprefix("sha256:") if column == "payload_digest" else unquote(v, errors="replace") if column == "url" else v


@dataclass
class Files(InputPartition):
    paths: list


@dataclass
class Written(WriterCommitMessage):
    files: list = field(default_factory=list)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.allowed = path, payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in FIELDS:
                self.allowed.append((f.attribute[0], type(f), {*f.value} if isinstance(f, In) else getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = files_of(self.path)
        listed = [x for m in manifests(fs, root) for x in json.loads(m)]
        out, size = [], PART
        for x in sorted(listed, key=lambda x: (-x["bytes"], x["name"])):
            if size + x["bytes"] > PART:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(x["name"])
            size += x["bytes"]
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, root = files_of(self.path)
        allowed = self.allowed
        wanted = lambda head: all(TESTS[test](_value(head, c), x) for c, test, x in allowed)
        for name in partition.paths:
            with fs.open_input_file(f"{root}/{name}") as raw, io.BufferedReader(raw, 1 << 20) as stream:
                for head, payload in records(stream, wanted, self.payload):
                    yield (*(_value(head, c) for c in ("page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to")), payload)


def manifests(fs, root: str) -> Iterator[bytes]:
    from pyarrow.fs import FileSelector

    for f in sorted(fs.get_file_info(FileSelector(root)), key=lambda f: f.base_name):
        if f.base_name.startswith(MANIFEST):
            with fs.open_input_stream(f.path) as stream:
                yield stream.read()


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator) -> WriterCommitMessage:
        fs, root = files_of(self.path)
        fs.create_dir(root, recursive=True)
        done, out, name, size = [], None, "", 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name, size = f"part-{uuid.uuid4().hex}.warc", 0
                    out = fs.open_output_stream(f"{root}/{name}")
                refers, payload = row["refers_to"], row["payload"]
                raw = serialise(row["page_id"], row["url"], row["payload_digest"], row["payload_bytes"], None if refers is not None else bytes(payload or b""), refers, row.get("copy") or 1)
                out.write(raw)
                size += len(raw)
                if size >= ROLL:
                    out.close()
                    done.append({"name": name, "bytes": size})
                    out = None
        if out is not None:
            out.close()
            done.append({"name": name, "bytes": size})
        return Written(done)

    def commit(self, messages: list) -> None:
        from pyarrow.fs import FileSelector

        fs, root = files_of(self.path)
        fs.create_dir(root, recursive=True)
        old = [f.path for f in fs.get_file_info(FileSelector(root)) if f.base_name.startswith(MANIFEST)] if self.overwrite else []
        # A file counts once it has its name, so a reader meets all of a commit or nothing.
        name = uuid.uuid4().hex
        with fs.open_output_stream(f"{root}/.{name}") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())
        fs.move(f"{root}/.{name}", f"{root}/{MANIFEST}{name}")
        for path in old:
            fs.delete_file(path)

    def abort(self, messages: list) -> None:
        fs, root = files_of(self.path)
        for m in messages:
            for x in m.files if m else []:
                fs.delete_file(f"{root}/{x['name']}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def planned(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows to write: of equal payloads of at least `least` bytes one row of the smallest page_id is stored, the others refer to it.  copy numbers the rows of a page with one payload."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.length("payload").cast("long"))
    keys = rows.where(F.col("payload_bytes") >= least).select("page_id", "payload_digest")
    # Settled, so that the rows of a hot digest on the other side of the join can be split.
    first = settle(keys.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"), "first-pages")
    again = keys.join(first, "payload_digest").groupBy("page_id", "payload_digest").agg(F.min("refers_to").alias("refers_to"))
    # The join has the rows of a page and payload together; numbering them needs no further exchange.
    copy = F.row_number().over(Window.partitionBy("page_id", "payload_digest").orderBy("page_id"))
    rows = rows.join(again, ["page_id", "payload_digest"], "left").withColumn("copy", copy)
    stored = F.col("refers_to").isNull() | ((F.col("page_id") == F.col("refers_to")) & (F.col("copy") == 1))
    rows = rows.withColumn("refers_to", F.when(~stored, F.col("refers_to")))
    return rows.select("page_id", "url", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), "payload_digest", "payload_bytes", "refers_to", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "copy")


def write(rows: DataFrame, path: str, mode: str = "append") -> None:
    register(rows.sparkSession)
    rows.write.format("warc").mode(mode).save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives and read them again: responses with their payload, whose digest and length are computed anew, and revisits from their headers alone."""
    spark, path = pages.sparkSession, scratch(pages.sparkSession, "warc")
    write(planned(pages), path)
    same = ("record_type", "refers_to")
    responses = read(spark, path).where("record_type = 'response'").select("page_id", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), *same)
    revisits = read(spark, path, payload=False).where("record_type = 'revisit'").select("page_id", "payload_bytes", "payload_digest", *same)
    return responses.unionByName(revisits)
