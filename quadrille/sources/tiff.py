"""Grayscale TIFF images as a Spark data source, and a sink of slabs.

    spark.dataSource.register(TiffSource)
    spark.read.format("tiff").load("file:///images/stack.tif")      -> z, x, y, v

Single-sample images of uint8, uint16 or float32, one page for each z, plain or
compressed (deflate, packbits, LZW; horizontal differences undone), in files of
either layout (offsets of 32 or of 64 bits).  A row of the file is a line along y, and the rows follow x.  A path
is a file or a folder of files; a file's first z is taken from its
description ("z=16") or follows the files before it by name.  Partitions are
page ranges that carry the places of their strips, so tasks parse no
directories; predicates on z skip pages before they are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from quadrille.plans.meta import GridMeta

PAGES = 8
# Fixed values of the format: tags, and the sizes and codes of the field types used.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, OFFSETS, SAMPLES, ROWS, COUNTS, FORMAT = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 339
PREDICTOR = 317
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 13: "I", 16: "Q", 18: "Q"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Bytes from which a file takes offsets of 64 bits.
LARGE = 1 << 32
KINDS = {("uint8"): (8, 1), ("uint16"): (16, 1), ("float32"): (32, 3)}


@dataclass(frozen=True)
class Page:
    width: int
    height: int
    kind: str
    strips: tuple
    order: str
    description: str = ""
    compression: int = PLAIN
    predictor: int = 1
    rows: int = 0


def _files(uri: str):
    from pyarrow.fs import FileSelector, FileSystem, FileType

    fs, root = FileSystem.from_uri(uri)
    if fs.get_file_info(root).type == FileType.Directory:
        return fs, sorted(f.path for f in fs.get_file_info(FileSelector(root)) if f.path.lower().endswith((".tif", ".tiff")))
    return fs, [root]


def pages(f) -> list[Page]:
    """The directory of an open file; other than grayscale images of the known types and compressions raise."""
    f.seek(0)
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(order + "H", head[2:4])[0] if order and len(head) >= 8 else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    # Widths of a number of entries, of an entry's count, and of an offset.
    many, wide = ("Q", "Q") if magic == 43 else ("H", "I")
    inline, entry = struct.calcsize(wide), struct.calcsize(f"{order}HH{wide}{wide}")
    at, out, met = struct.unpack(order + wide, head[8:16] if magic == 43 else head[4:8])[0], [], set()
    while at and at not in met:
        met.add(at)
        f.seek(at)
        n = struct.unpack(order + many, f.read(struct.calcsize(many)))[0]
        raw, tags = f.read(entry * n + inline), {}
        for i in range(n):
            tag, kind, count = struct.unpack(f"{order}HH{wide}", raw[entry * i : entry * (i + 1) - inline])
            if kind not in FIELD:
                continue
            form = f"{count}{FIELD[kind]}"
            size, value = struct.calcsize(order + form), raw[entry * (i + 1) - inline : entry * (i + 1)]
            if size > inline:
                f.seek(struct.unpack(order + wide, value)[0])
                value = f.read(size)
            tags[tag] = struct.unpack(order + form, value[:size])
        at = struct.unpack(order + wide, raw[entry * n :])[0]
        bits, form = tags.get(BITS, (1,))[0], tags.get(FORMAT, (1,))[0]
        kind = next((k for k, v in KINDS.items() if v == (bits, form)), None)
        packed, predictor = tags.get(COMPRESSION, (PLAIN,))[0], tags.get(PREDICTOR, (1,))[0]
        if tags.get(SAMPLES, (1,))[0] != 1 or kind is None or packed not in (PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS) or predictor not in (1, 2) or predictor == 2 and kind == "float32":
            raise ValueError("only grayscale images of uint8, uint16 and float32 can be read, plain or packed by deflate, LZW or packbits")
        note = tags.get(DESCRIPTION, (b"",))[0].rstrip(b"\0").decode("latin-1")
        out.append(Page(tags[WIDTH][0], tags[HEIGHT][0], kind, tuple(zip(tags[OFFSETS], tags[COUNTS])), order, note, packed, predictor, tags.get(ROWS, (tags[HEIGHT][0],))[0]))
    return out


def unpackbits(raw: bytes) -> bytes:
    """Runs: a length byte below 128 and so many more bytes as they are, above 128 the next byte repeated."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += raw[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def unlzw(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; 256 clears the table, 257 ends."""
    out, table, width, last, held, bits = bytearray(), [], 9, b"", 0, 0
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        # A code that is not there yet is the last string and its own first byte.
        now = table[code] if code < len(table) else last + last[:1]
        out += now
        if last:
            table.append(last + now[:1])
        last = now
        # One entry ahead of what the table holds, as the format has it.
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def listing(uri: str) -> list[tuple[str, int, list[Page]]]:
    """path, first z and pages of every file; the directories are read side by side."""
    fs, paths = _files(uri)

    def of(path: str) -> list[Page]:
        with fs.open_input_file(path) as f:
            return pages(f)

    with ThreadPoolExecutor(16) as pool:
        all_ = [*pool.map(of, paths)]
    out, z = [], 0
    for p, found in zip(paths, all_):
        note = found[0].description if found else ""
        z = int(note[2:]) if note.startswith("z=") and note[2:].isdigit() else z
        out.append((p, z, found))
        z += len(found)
    if len({(q.width, q.height, q.kind) for _, _, l in out for q in l}) > 1:
        raise ValueError("pages differ in size or type")
    return out


def info(uri: str) -> tuple[GridMeta, str]:
    """Extents and value type: the file's width is y, its height x, its pages z."""
    found = listing(uri)
    if not any(l for _, _, l in found):
        raise ValueError("no image")
    page = next(l for _, _, l in found if l)[0]
    return GridMeta(page.width, page.height, max(z + len(l) for _, z, l in found)), page.kind


def array(f, page: Page) -> np.ndarray:
    """(x, y) values of a page."""
    raw, unpack = [], {LZW: unlzw, PACKBITS: unpackbits, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress}.get(page.compression, bytes)
    for at, n in page.strips:
        f.seek(at)
        raw.append(unpack(f.read(n)))
    out = np.frombuffer(b"".join(raw), np.dtype(page.kind).newbyteorder(page.order)).reshape(page.height, page.width)
    return np.cumsum(out, axis=1, dtype=page.kind) if page.predictor == 2 else out


@dataclass
class Pages(InputPartition):
    path: str
    pages: list
    z: list


class TiffReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.low, self.high = path, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            at = getattr(f, "attribute", None)
            if at == ("z",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                lo = {EqualTo: f.value, GreaterThan: f.value + 1, GreaterThanOrEqual: f.value}.get(type(f))
                hi = {EqualTo: f.value, LessThan: f.value - 1, LessThanOrEqual: f.value}.get(type(f))
                self.low = lo if self.low is None else self.low if lo is None else max(lo, self.low)
                self.high = hi if self.high is None else self.high if hi is None else min(hi, self.high)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out = []
        for path, z, found in listing(self.path):
            want = [k for k in range(z, z + len(found)) if (self.low is None or k >= self.low) and (self.high is None or k <= self.high)]
            out += [Pages(path, [found[k - z] for k in want[i : i + PAGES]], want[i : i + PAGES]) for i in range(0, len(want), PAGES)]
        return out or [Pages("", [], [])]

    def read(self, part: Pages) -> Iterator:
        import pyarrow as pa

        if not part.z:
            return
        fs, _ = _files(self.path)
        with fs.open_input_file(part.path) as f:
            for z, page in zip(part.z, part.pages):
                a = array(f, page)
                x, y = np.indices(a.shape, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(a.size, z, np.int32)), pa.array(x.ravel()), pa.array(y.ravel()), pa.array(a.ravel().astype(np.float64))], names=["z", "x", "y", "v"])


class TiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return "z int, x int, y int, v double"

    def reader(self, schema) -> DataSourceReader:
        return TiffReader(self.options["path"])


def encode(stack: np.ndarray, first: int = 0, compression: str = "none", large: bool | None = None) -> bytes:
    """A file of the pages (z, x, y) of a uint8, uint16 or float32 array.  compression: none or deflate; large: offsets of 64 bits, by default where the pages need them."""
    bits, form = KINDS[stack.dtype.name]
    code = {"none": PLAIN, "deflate": DEFLATE}[compression]
    large = stack.nbytes > LARGE * 0.9 if large is None else large
    many, wide = ("Q", "Q") if large else ("H", "I")
    long, inline = (16, 8) if large else (4, 4)
    note = f"z={first}\0".encode()
    out = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if large else struct.pack("<2sHI", b"II", 42, 8))
    for i, a in enumerate(stack):
        raw = a.astype(a.dtype.newbyteorder("<")).tobytes()
        raw = zlib.compress(raw, 6) if code == DEFLATE else raw
        n, at = 11, len(out)
        body = at + struct.calcsize("<" + many) + (4 + 2 * inline) * n + inline
        text = body
        data = text + len(note) + len(note) % 2
        after = data + len(raw) + len(raw) % 2
        entries = [(WIDTH, 4, 1, a.shape[1]), (HEIGHT, 4, 1, a.shape[0]), (BITS, 3, 1, bits), (COMPRESSION, 3, 1, code), (PHOTOMETRIC, 3, 1, 1), (DESCRIPTION, 2, len(note), text), (OFFSETS, long, 1, data), (SAMPLES, 3, 1, 1), (ROWS, 4, 1, a.shape[0]), (COUNTS, long, 1, len(raw)), (FORMAT, 3, 1, form)]
        out += struct.pack("<" + many, n)
        for tag, kind, count, value in entries:
            out += struct.pack(f"<HH{wide}", tag, kind, count) + (note.ljust(inline, b"\0")[:inline] if tag == DESCRIPTION and count <= inline else struct.pack(f"<{wide}", value))
        out += struct.pack(f"<{wide}", 0 if i == len(stack) - 1 else after)
        out += note + b"\0" * (len(note) % 2) + raw + b"\0" * (len(raw) % 2)
    return bytes(out)


def save(grid: DataFrame, meta: GridMeta, uri: str, kind: str = "uint16", slab: int = 16, compression: str = "none") -> int:
    """Write a dense grid as one file for each slab of z; values are rounded, and values beyond the type raise.  Gives the number of files."""
    limit = None if kind == "float32" else np.iinfo(kind)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(uri)
        fs.create_dir(root, recursive=True)
        first = int(frame["slab"].iloc[0]) * slab
        a = np.zeros((int(frame["z"].max()) - first + 1, meta.nx, meta.ny))
        a[frame["z"] - first, frame["x"], frame["y"]] = frame["v"]
        if limit and (np.round(a).min() < limit.min or np.round(a).max() > limit.max):
            raise OverflowError(f"values leave the range of {kind}")
        name = f"{root}/slab-{first:06d}.tif"
        with fs.open_output_stream(name) as f:
            f.write(encode((np.round(a) if limit else a).astype(kind), first, compression))
        return pd.DataFrame({"file": [name]})

    keyed = grid.select("z", "x", "y", F.col("v").cast("double").alias("v")).withColumn("slab", F.floor(F.col("z") / slab))
    return keyed.groupBy("slab").applyInPandas(run, "file string").count()


def register(spark) -> None:
    spark.dataSource.register(TiffSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark, uri: str) -> DataFrame:
    register(spark)
    return spark.read.format("tiff").load(uri)
