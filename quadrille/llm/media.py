"""Interleaved document sequences with content-addressed media.

HTML is parsed into ordered segments: runs of text, and references to media
with their captions.  Payloads lie in a media table under the digest of their
stored form, once for each task that met them; a join on the digest resolves
the references while position and caption stay with the reference.  What is
derived from a payload is computed once for each distinct digest and settled
before the join, so a payload that a third of the references share is read
once for each task that met it and never crosses the network; the settled side
leaves the references of a hot digest free to be split.

Stored form: an 8-bit RGB PNG 64 samples wide, the payload's bytes row by row.

Defined results: null html gives no segments; a null text is an empty payload,
padded to one row; a very long text is one tall image; references whose digest
is not in the table stay with null payload columns; equal texts share one
stored form, and repeated rows give repeated segments; rows with a null id are
kept; other columns, whatever their names, are ignored; empty tables give
empty results.
"""

from __future__ import annotations

import hashlib
import html as entities
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import lean, settle

ROW, WIDE = 192, 64
MEDIA = {"img", "video", "audio", "source", "embed"}
SILENT = {"script", "style", "template", "noscript"}
BLOCKS = {"p", "div", "li", "ul", "ol", "br", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "td", "article", "section", "figure", "figcaption", "header", "footer", "nav", "body", "title", "blockquote", "pre"}


class _Segments(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.text: list[str] = []
        self.silent = 0
        self.caption: list[str] | None = None
        self.figure: list[int] = []

    def flush(self) -> None:
        words = " ".join("".join(self.text).split())
        self.text = []
        if words:
            self.out.append({"kind": "text", "text": words, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        if tag in BLOCKS or tag in MEDIA:
            self.flush()
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        elif tag in MEDIA and (src := dict(attrs).get("src")):
            self.figure.append(len(self.out))
            self.out.append({"kind": "media", "text": None, "ref": src, "caption": dict(attrs).get("alt")})

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        if tag == "figcaption" and self.caption is not None:
            words = " ".join("".join(self.caption).split())
            for i in self.figure:
                self.out[i]["caption"] = words or self.out[i]["caption"]
            self.caption = None
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def segments(html: str | None) -> list[dict]:
    """Ordered kind, text, ref, caption of a page."""
    parser = _Segments()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.out


def sequences(pages: DataFrame, id_column: str, html_column: str = "html") -> DataFrame:
    """id, position, kind, text, ref, caption."""
    kind = pages.schema[id_column].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, n, s["kind"], s["text"], s["ref"], s["caption"]) for i, h in zip(frame["id"], frame["html"]) for n, s in enumerate(segments(h))]
            yield pd.DataFrame(rows, columns=["id", "position", "kind", "text", "ref", "caption"])

    return pages.select(F.col(id_column).alias("id"), F.col(html_column).alias("html")).mapInPandas(lean(run), f"id {kind}, position int, kind string, text string, ref string, caption string")


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def pad(raw: bytes) -> bytes:
    return raw + b" " * ((-len(raw)) % ROW or (0 if raw else ROW))


def encode_png(raw: bytes) -> bytes:
    """The padded bytes as samples; the unpadded length is kept in a text chunk."""
    rows = np.frombuffer(pad(raw), np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDE, len(rows), 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % len(raw)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(png: bytes) -> tuple[bytes, int]:
    """Payload and unpadded length; raises on damage."""
    if png[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, n, high = 8, [], None, 0
    while at < len(png):
        size, name = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + size]
        if zlib.crc32(name + body) != struct.unpack(">I", png[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG")
        if name == b"IHDR":
            high = struct.unpack(">II", body[:8])[1]
        elif name == b"tEXt":
            n = int(body.split(b"\0", 1)[1])
        elif name == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(high, ROW + 1)
    if lines[:, 0].any():
        raise ValueError("a row is filtered")
    return lines[:, 1:].tobytes(), n


def features(payload: bytes) -> str:
    """Mean, deviation and the shares of sixteen equal ranges of the samples."""
    count = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n, x = count.sum(), np.arange(256)
    mean = (count * x).sum() / n
    dev = np.sqrt((count * (x - mean) ** 2).sum() / n)
    return f"mean={mean:.6f};std={dev:.6f};hist=" + ",".join(f"{v / n:.6f}" for v in count.reshape(16, 16).sum(1))


def with_payload(docs: DataFrame) -> DataFrame:
    """doc_id, html that refers to the text's stored form, and the media row (digest, media) where the task has it for the first time lately."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[str] = set()
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"]):
                raw = (text if isinstance(text, str) else "").encode("utf-8", "replace")
                media = encode_png(raw)
                digest = hashlib.sha256(media).hexdigest()
                page = f'<article><h1>Document</h1><figure><img src="sha256:{digest}" alt="stored text"><figcaption>{entities.escape(f"text of {len(raw)} bytes")}</figcaption></figure></article>'
                rows.append((doc, page, digest, None if digest in met else media))
                if len(met) > 200_000:
                    met.clear()
                met.add(digest)
            yield pd.DataFrame(rows, columns=["doc_id", "html", "digest", "media"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(lean(run), f"doc_id {kind}, html string, digest string, media binary")


def described(media: DataFrame) -> DataFrame:
    """One row for each digest of a media table (digest, media), computed from the bytes read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for digest, png in zip(frame["digest"], frame["media"]):
                payload, n = decode_png(bytes(png))
                rows.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest(), features(payload)))
            yield pd.DataFrame(rows, columns=["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.where("media is not null").select("digest", "media").mapInPandas(lean(run), schema).dropDuplicates(["digest"])


def resolve(segs: DataFrame, media: DataFrame) -> DataFrame:
    """Segments with the columns of described(media) at the references."""
    keyed = segs.withColumn("digest", F.when(F.col("ref").startswith("sha256:"), F.substring("ref", 8, 64)))
    return keyed.join(settle(described(media), "described"), "digest", "left")


def document_media(docs: DataFrame) -> DataFrame:
    """Every document's text stored as a medium, referred to from a page, and resolved again from the stored bytes."""
    stored = settle(with_payload(docs), "media")
    found = resolve(sequences(stored, "doc_id"), stored).where("kind = 'media'")
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
