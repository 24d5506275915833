"""Line hashing with sentences as the smallest unit.

Every line is cut at sentence ends into units; a unit is normalised (case
folded, white space collapsed) and hashed to 128 bits.  Digests are grouped over the whole
corpus and the occurrence ranked first by (doc_id, position) stays.  A later
occurrence goes if the run of repeated units around it, possibly over several
lines, has at least min_words words; so whole lines, paragraphs and passages
inside a line go alike, while short sentences that agree by chance stay.
With whole_lines a line that an earlier place has as a line goes at any length.

Occurrences are hashed once, settled, and met by the repeated digests in a
join whose hot side adaptive execution may split.

Defined results: a null text stays null with no spans; empty texts stay; very
long texts are cut whole; rows that repeat a doc_id are ranked by their text
digest, and of rows equal in both one is the first and every unit of the
others is a repeat; ids keep their type, strings included; rows with a null
doc_id are returned untouched; an empty table gives an empty result; other
columns pass through apply(), and columns with the names of results are
replaced.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import fresh, kind_of, lean, settle

MIN_WORDS = 8
_UNIT = re.compile(r"[^\n]*?[.!?…][\"'”’)\]]*(?=\s|$)|[^\n]+", re.M)


def units(text: str | None) -> list[tuple[int, int]]:
    """Spans of the units: sentences within lines, white space around them left out."""
    out = []
    for m in _UNIT.finditer(text or ""):
        s = m.group()
        body = s.strip()
        if body:
            a = m.start() + len(s) - len(s.lstrip())
            out.append((a, a + len(body)))
    return out


def normal(unit: str) -> bytes:
    return " ".join(unit.casefold().split()).encode("utf-8", "replace")


def digests(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Two signed longs for each unit."""
    raw = b"".join([xxhash.xxh3_128_digest(normal(text[a:b])) for a, b in spans])
    return np.frombuffer(raw, ">i8").reshape(-1, 2).astype(np.int64)


def short_lines(text: str, spans: list[tuple[int, int]], min_words: int) -> list[tuple[int, int]]:
    """Ranges of the units of the lines under min_words words; a longer line that repeats is a run of units that goes by itself."""
    out, at = [], 0
    for i in range(1, len(spans) + 1):
        if i == len(spans) or text.find("\n", spans[i - 1][1], spans[i][0]) >= 0:
            if len(text[spans[at][0] : spans[i - 1][1]].split(None, min_words)) < min_words:
                out.append((at, i))
            at = i
    return out


def line_digests(text: str, spans: list[tuple[int, int]], lines: list[tuple[int, int]]) -> np.ndarray:
    """Two signed longs for each line, apart from those of units: no unit has a line break."""
    raw = b"".join([xxhash.xxh3_128_digest(b"\n" + normal(text[spans[a][0] : spans[b - 1][1]])) for a, b in lines])
    return np.frombuffer(raw, ">i8").reshape(-1, 2).astype(np.int64)


def occurrences(docs: DataFrame, lines_under: int = 0) -> DataFrame:
    """doc_id, row (digest of the text), pos, h1, h2 of every unit; a unit's first place in a text only.

    Also of every line under so many words; their pos is -1 for the first of short_lines(), -2 for the next."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, rows, pos, hs = [], [], [], []
            for doc, row, text in zip(frame["doc_id"], frame["row"], frame["text"]):
                spans = units(text)
                if spans:
                    lines = short_lines(text, spans, lines_under) if lines_under else []
                    for h, by_line in ((digests(text, spans), False), (line_digests(text, spans, lines), True)):
                        _, at = np.unique(h, axis=0, return_index=True) if len(h) > 1 else (None, np.arange(len(h)))
                        ids.append(np.full(len(at), doc, object if isinstance(doc, str) else None))
                        rows.append(np.full(len(at), row, np.int64))
                        pos.append((-1 - at if by_line else at).astype(np.int32))
                        hs.append(h[at])
            if ids:
                h = np.concatenate(hs)
                yield pd.DataFrame({"doc_id": np.concatenate(ids), "row": np.concatenate(rows), "pos": np.concatenate(pos), "h1": h[:, 0], "h2": h[:, 1]})

    return docs.mapInPandas(lean(run), f"doc_id {kind_of(docs, 'doc_id')}, row long, pos int, h1 long, h2 long")


def cut(text: str | None, later: np.ndarray, min_words: int, whole_lines: bool = False, again: bool = False) -> tuple[str | None, list[tuple[int, int]], int]:
    """Text without the runs of repeated units, their spans in the original, the number of units.

    later: positions (by first place in the text) of units, and of lines as in
    occurrences(), that an earlier document has.  again: an equal row is ranked
    before, so all of them are."""
    spans = units(text)
    if not spans:
        return text, [], 0
    if again:
        later = np.concatenate([np.arange(len(spans)), -1 - np.arange(len(short_lines(text, spans, min_words)) if whole_lines else 0)])
    h = [x.tobytes() for x in digests(text, spans)]
    gone, seen, flags = {h[i] for i in later if i >= 0}, set(), []
    for x in h:
        flags.append(x in gone or x in seen)
        seen.add(x)
    lined = [False] * len(spans)
    if whole_lines:
        lines = short_lines(text, spans, min_words)
        hl = [x.tobytes() for x in line_digests(text, spans, lines)]
        gone, seen = {hl[-1 - i] for i in later if i < 0}, set()
        for x, (a, b) in zip(hl, lines):
            if x in gone or x in seen:
                lined[a:b] = [True] * (b - a)
            seen.add(x)
    out, run, words = [], [], 0
    for (a, b), flag, line in [*zip(spans, flags, lined), ((0, 0), False, False)]:
        if flag or line:
            run.append((a, b, line))
            words += len(text[a:b].split())
        elif run:
            if words >= min_words:
                out.append((run[0][0], run[-1][1]))
            else:
                for by_line, part in itertools.groupby(run, lambda x: x[2]):
                    part = list(part)
                    if by_line:
                        out.append((part[0][0], part[-1][1]))
            run, words = [], 0
    if not out:
        return text, [], len(spans)
    kept, at = [], 0
    for a, b in out:
        while b < len(text) and text[b] in " \t":
            b += 1
        left = text[at:a]
        if (not left or left.endswith("\n")) and text[b : b + 1] == "\n":
            b += 1
        kept.append(left)
        at = b
    kept.append(text[at:])
    return "".join(kept), out, len(spans)


def apply(docs: DataFrame, min_words: int = MIN_WORDS, names: tuple[str, str] = ("n_units", "spans"), whole_lines: bool = True) -> DataFrame:
    """docs with text cut (whole_lines: also of repeated lines under min_words words), and the number of units and the removed spans (start, stop in the original text) added or replaced under `names`."""
    row, doc_, row_, later_, again_ = (fresh(docs, x) for x in ("__row", "__doc", "__r", "__later", "__again"))
    keyed = docs.withColumn(row, F.xxhash64("text"))
    ids = keyed.where("doc_id is not null and text is not null").select("doc_id", F.col(row).alias("row"), "text")
    occ = settle(occurrences(ids, min_words if whole_lines else 0), "occurrences")
    # Repeated digests alone are met; as a settled table they leave the other side of the join free to be split.
    first = settle(occ.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "row", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", F.col("first.doc_id").alias("fd"), F.col("first.row").alias("fr")), "repeated")
    later = occ.join(first, ["h1", "h2"]).where("doc_id <> fd or row <> fr").groupBy("doc_id", "row").agg(F.collect_set("pos").alias(later_)).select(F.col("doc_id").alias(doc_), F.col("row").alias(row_), later_)
    base = [c for c in docs.columns if c not in names]
    joined = keyed.join(later, (F.col("doc_id") == F.col(doc_)) & (F.col(row) == F.col(row_)), "left")
    # The join has the rows of a key together already; equal rows behind the first are repeats as a whole.
    place_in = F.row_number().over(Window.partitionBy("doc_id", row).orderBy(row))
    joined = joined.withColumn(again_, (place_in > 1) & F.col("doc_id").isNotNull()).select(*base, later_, again_)
    place = base.index("text")
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.select(*base).schema), f"`{names[0]}` int", f"`{names[1]}` array<struct<start:int,stop:int>>"])

    def run(frames):
        import pyarrow as pa

        for batch in frames:
            texts, n, spans = [], [], []
            for text, places, again in zip(batch.column(place).to_pylist(), batch.column(len(base)).to_pylist(), batch.column(len(base) + 1).to_pylist()):
                t, s, k = cut(text, np.array(places or [], np.int64), min_words, whole_lines, again)
                texts.append(t)
                n.append(k)
                spans.append([{"start": a, "stop": b} for a, b in s])
            cols = [batch.column(i) for i in range(len(base))]
            cols[place] = pa.array(texts, pa.string())
            cols += [pa.array(n, pa.int32()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]
            yield pa.RecordBatch.from_arrays(cols, names=[*base, *names])

    return joined.mapInArrow(lean(run), schema)
