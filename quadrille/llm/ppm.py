"""Prediction by partial matching over bytes, learned from the whole corpus.

The model is a byte-context trie of depth `order`: for each context its next
symbols with their counts in the training documents.  A symbol n times in a
context of t gets (n - 1/2) / t, the escape to the next shorter context d / 2t
(d: distinct symbols); symbols that the longer context holds are excluded
below it, and what no context holds is spread evenly over the symbols left.
The symbols are the 256 bytes and one end; A-Z are lower-cased first.  Below
full length and above the short contexts a symbol counts once for each
distinct longer context (update exclusion).

Layout: documents are dealt into blocks.  A block sends each bucket of
order-3 contexts its distinct grams (one packed array), a bucket merges the
counts of all blocks, grows its part of the trie, and answers every gram of
every block with its log probability; the block then adds up its documents.
Counts of contexts shorter than the bucket key are at most 257**3 numbers and
are broadcast once.  The unigram word baseline takes the same road by word.
Blocks meet in a tree of fan-in FAN: a node merges the distinct grams of its
children in one bucket and sends its own on, and the answers come back the
same way.  So a context that every block has reaches a task FAN times at the
most, however many blocks there are, and no table of the whole corpus sits in
one process.  Buckets are wide while few blocks have met and divide as more do,
so a group holds about two blocks' worth at every level and the number of
groups, rows and partitions of a level is in proportion to that of the blocks.

Defined results: a null text counts as empty (one end symbol, one end token);
a very long text is scored whole, in a block of its own size if need be;
without training documents every symbol has probability 1/257; repeated rows
are scored and counted each (rows equal in id and text share a block); rows
with a null id fall in block and fold of the empty id; ids keep their type;
other columns, whatever their names, are ignored; an empty table gives an
empty result.  The log probability of a symbol crosses the network in single
precision (7 digits); sums are in double precision.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import lean, lean_groups

ORDER, LOW = 5, 2
END, PAD, SYMBOLS = 256, 257, 257
BITS = 9
BLOCK_BYTES, CHUNK_BYTES = 9_000_000, 2_000_000
FAN = 32
ALPHA = 0.1
U = np.uint64


def mask(k: int) -> np.uint64:
    return U((1 << (BITS * k)) - 1)


def lay(texts: list[bytes], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each after `pad` pads and before an end; where each text's own symbols start."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(size + pad + 1) - (size + 1)
    out = np.full(int((size + pad + 1).sum()), PAD, np.uint16)
    own = np.zeros(len(out), bool)
    out[start + size] = END
    step = np.zeros(len(out) + 1, np.int8)
    step[start] += 1
    np.add.at(step, start + size, -1)
    own = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    out[own] = np.frombuffer(b"".join(texts), np.uint8)
    return out, start


def grams(symbols: np.ndarray, order: int) -> np.ndarray:
    """At each place, its symbol in the low bits and the `order` symbols before it above; pads first."""
    s = symbols.astype(np.uint64)
    g = s.copy()
    for k in range(1, order + 1):
        g[k:] |= s[:-k] << U(BITS * k)
    return g


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of wanted keys, 0 for those that are not there."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def grouped(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys and the sums of values over each."""
    if not len(keys):
        return keys, *(v[:0] for v in values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], *(np.add.reduceat(v[order], at) for v in values)


class Trie:
    """Counts of contexts of every length to `order`, as sorted arrays."""

    def __init__(self, top: tuple[np.ndarray, np.ndarray], order: int, low: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.order, self.count = order, dict(low)
        self.count[order] = top
        for k in range(order - 1, -1, -1):
            if k not in self.count:
                g = self.count[k + 1][0]
                self.count[k] = grouped(g & mask(k + 1), np.ones(len(g), np.int64))
        self.context = {}
        for k, (g, n) in self.count.items():
            below = lookup(*self.count[k - 1], g & mask(k)) if k else np.zeros(len(g), np.int64)
            self.context[k] = grouped(g >> U(BITS), n, np.ones(len(g), np.int64), below)

    def log10(self, wanted: np.ndarray) -> np.ndarray:
        """Of the grams (contexts of full length, symbol in the low bits)."""
        out = np.zeros(len(wanted))
        todo = np.arange(len(wanted))
        less = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)  # counts, symbols excluded by longer contexts
        with np.errstate(divide="ignore", invalid="ignore"):
            for k in range(self.order, -1, -1):
                g = wanted[todo] & mask(k + 1)
                n = lookup(*self.count[k], g)
                c, total, kinds, below = self.context[k]
                ctx = g >> U(BITS)
                t, d, e = (lookup(c, v, ctx) for v in (total, kinds, below))
                free, left = t - less[0], d - less[1]
                hit, open_ = n > 0, free > 0
                out[todo] += np.where(hit, np.log10((n - 0.5) / free), np.where(open_, np.log10(0.5 * left / free), 0.0))
                known = t > 0
                less = np.where(known, e, less[0] * 0), np.where(known, d, less[1] * 0)
                todo, less = todo[~hit], (less[0][~hit], less[1][~hit])
            out[todo] -= np.log10(SYMBOLS - less[1])
        return out


def _bytes(text) -> bytes:
    return (text or "").encode("utf-8", "replace").lower() if isinstance(text, str) else b""


def survey(docs: DataFrame, order: int) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], dict]:
    """Counts of the short contexts, and the totals of the corpus: at most 257**3 + 4 numbers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, totals = [], 0, np.zeros(4, np.int64)
        for frame in frames:
            texts, train = [_bytes(t) for t in frame["text"]], frame["train"].to_numpy(bool)
            totals += [sum(map(len, texts)), len(texts), sum(len(t.split()) + 1 for t, x in zip(texts, train) if x), train.sum()]
            own = [t for t, x in zip(texts, train) if x]
            if own:
                s, start = lay(own, LOW)
                g = grams(s, LOW)[s != PAD]
                codes, uniq = pd.factorize(g)
                held.append((uniq, np.bincount(codes, minlength=len(uniq))))
                n += len(uniq)
                if n > 2_000_000:
                    held = [grouped(*map(np.concatenate, zip(*held)))]
                    n = len(held[0][0])
        g, c = grouped(*map(np.concatenate, zip(*held))) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        yield pd.DataFrame({"g": np.concatenate([g.astype(np.int64), -1 - np.arange(4)]), "n": np.concatenate([c.astype(np.int64), totals])})

    rows = docs.select("text", "train").mapInPandas(lean(run), "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toPandas()
    g, n = rows["g"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    tot = dict(zip(("bytes", "docs", "tokens", "train_docs"), (int(n[g == -1 - i].sum()) for i in range(4))))
    keep = np.argsort(g[g >= 0])
    low = {LOW: (g[g >= 0][keep].astype(np.uint64), n[g >= 0][keep])}
    for k in range(LOW - 1, -1, -1):
        low[k] = grouped(low[k + 1][0] & mask(k + 1), low[k + 1][1])
    return low, tot


def _chunks(texts: list[bytes]) -> list[list[bytes]]:
    size = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))) // CHUNK_BYTES
    at = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
    return [texts[a:b] for a, b in zip(at, at[1:]) if b > a]


def bucket_of(contexts: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of grams, by the three symbols before the last."""
    return (((contexts >> U(BITS)) & mask(3)) * U(0x9E3779B97F4A7C15) >> U(40)) % U(buckets)


def by_bucket(bucket: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
    """The order by bucket, then by distinct key, or place where there are no keys."""
    if keys is None:
        return np.argsort(bucket, kind="stable")
    order = np.argsort(keys)
    return order[np.argsort(bucket[order].astype(np.uint32), kind="stable")]


def block_grams(texts: list[bytes], train: np.ndarray, order: int, buckets: int):
    """A block's distinct grams by (bucket, gram): grams, counts, buckets; and for each chunk of its texts the places in these of its symbols and the start of each text."""
    parts, at = [], 0
    for own in _chunks(texts):
        s, _ = lay(own, order)
        codes, uniq = pd.factorize(grams(s, order)[s != PAD])
        size = np.fromiter(map(len, own), np.int64, len(own)) + 1
        n = np.bincount(codes, weights=np.repeat(train[at : at + len(own)], size), minlength=len(uniq)).astype(np.int64)
        parts.append((codes.astype(np.int32), uniq, n, np.cumsum(size) - size))
        at += len(own)
    codes, uniq = pd.factorize(np.concatenate([p[1] for p in parts]))
    n = np.bincount(codes, weights=np.concatenate([p[2] for p in parts]), minlength=len(uniq)).astype(np.int64)
    bucket = bucket_of(uniq, buckets)
    by = by_bucket(bucket, uniq)
    place = np.empty(len(by), np.int32)
    place[by] = np.arange(len(by))
    places = np.split(place[codes], np.cumsum([len(p[1]) for p in parts])[:-1])
    return uniq[by], n[by], bucket[by].astype(np.int64), [(p[0], here, p[3]) for p, here in zip(parts, places)]


def block_words(texts: list[bytes], train: np.ndarray, buckets: int):
    """A block's distinct words by (bucket, word): words, counts, buckets; and the place in these of every word, text by text, and the texts' numbers of words."""
    words, size = [], []
    for t in texts:
        w = t.split()
        size.append(len(w))
        words += w
    coded = pa.array(words, pa.large_binary()).dictionary_encode()
    codes, uniq = coded.indices.to_numpy(), coded.dictionary
    n = np.bincount(codes, weights=np.repeat(train, size), minlength=len(uniq)).astype(np.int64)
    sorted_ = pc.sort_indices(uniq.cast(pa.large_binary())).to_numpy().astype(np.int64)
    uniq = uniq.to_pylist()
    bucket = np.fromiter(map(zlib.crc32, uniq), np.int64, len(uniq)) % buckets
    by = sorted_[np.argsort(bucket[sorted_], kind="stable")]
    place = np.empty(len(by), np.int32)
    place[by] = np.arange(len(by))
    return [uniq[i] for i in by.tolist()], n[by], bucket[by], place[codes], np.array(size, np.int64)


def _runs(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
    return [(int(bucket[a]), a, b) for a, b in zip(at.tolist(), at[1:].tolist())]


def vocabulary(rows: DataFrame, buckets: int) -> int:
    """Distinct words: each task sends its own once for about CHUNK_BYTES of text, a bucket counts those that it gets."""

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pack(held: set[bytes]) -> pd.DataFrame:
            parts: dict[int, list[bytes]] = {}
            for w in held:
                parts.setdefault(zlib.crc32(w) % buckets, []).append(w)
            return pd.DataFrame({"bucket": [*parts], "keys": [b" ".join(x) for x in parts.values()]})

        held: set[bytes] = set()
        for frame in frames:
            for t in frame["text"]:
                held.update(_bytes(t).split())
                if len(held) > 500_000:
                    yield pack(held)
                    held = set()
        if held:
            yield pack(held)

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(pa.concat_arrays([pa.array(x.split(b" "), pa.large_binary()) for x in frame["keys"]]).dictionary_encode().dictionary)]})

    sent = rows.select("text").mapInPandas(lean(send), "bucket int, keys binary")
    return sent.groupBy("bucket").applyInPandas(count, "n long").agg(F.sum("n")).first()[0] or 0


def merged(kind: int, keys: list[bytes], counts: list[bytes], width: type, buckets: int) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray | list[bytes], np.ndarray]:
    """Of the children of a node: for each of their keys the place among the node's own, where the children begin, the node's counts, its keys and their buckets, in whose order they are."""
    n = [np.frombuffer(x, width) for x in counts]
    cut, n = np.cumsum([len(c) for c in n])[:-1].tolist(), np.concatenate(n).astype(np.int64)
    if kind == 0:
        codes, uniq = pd.factorize(np.concatenate([np.frombuffer(x, np.uint64) for x in keys]))
        bucket = bucket_of(uniq, buckets).astype(np.int64)
        by = by_bucket(bucket, uniq)
        uniq = uniq[by]
    else:
        coded = pa.concat_arrays([pa.array(x.split(b" "), pa.large_binary()) for x in keys]).dictionary_encode()
        uniq, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        bucket = np.fromiter(map(zlib.crc32, uniq), np.int64, len(uniq)) % buckets
        by = by_bucket(bucket)
        uniq = [uniq[i] for i in by.tolist()]
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    codes = rank[codes]
    return codes, cut, np.bincount(codes, weights=n, minlength=len(uniq)).astype(np.int64), uniq, bucket[by]


def tree(blocks: int, buckets: int, fan: int) -> list[tuple[int, int, int]]:
    """The levels between the blocks and the last buckets: nodes, buckets that one of the level covers, partitions.

    What fan**l blocks send is cut into half as many buckets (all of them, once there are no more), by powers of two, so
    that those of one level lie inside those of the level before."""
    levels, nodes = [], blocks
    while nodes > fan:
        nodes = -(-nodes // fan)
        wanted = max(1, fan ** (len(levels) + 1) // 2)
        cover = 1 << max(0, (buckets // wanted).bit_length() - 1)
        levels.append((nodes, cover, min(100_000, max(8, min(blocks, -(-buckets // cover) * nodes)))))
    return levels


def score(docs: DataFrame, train, order: int = ORDER, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.  train: boolean Column, true where a row is learned from."""
    if not 3 <= order <= 6:
        raise ValueError("order is 3 to 6")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), train.alias("train"))
    low, tot = survey(rows, order)
    blocks = max(1, math.ceil(tot["bytes"] / block_bytes))
    buckets = max(8, math.ceil(tot["bytes"] / (2 * block_bytes)))
    distinct = vocabulary(rows.where("train"), buckets) + (1 if tot["train_docs"] else 0)
    whole, ends = math.log10(tot["tokens"] + ALPHA * (distinct + 1)), tot["train_docs"]
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    short = docs.sparkSession.sparkContext.broadcast(low)

    levels = tree(blocks, buckets, fan)
    covers = [*(cover for _, cover, _ in levels), 1]

    def ask(frame: pd.DataFrame) -> pd.DataFrame:
        texts, own = [_bytes(t) for t in frame["text"]], frame["train"].to_numpy(bool)
        block = int(frame["block"].iloc[0])
        g, n, b, _ = block_grams(texts, own, order, buckets)
        out = [(0, x, block, g[a:z].tobytes(), n[a:z].astype(np.int32).tobytes()) for x, a, z in _runs(b // covers[0])]
        w, n, b, _, _ = block_words(texts, own, buckets)
        out += [(1, x, block, b" ".join(w[a:z]), n[a:z].astype(np.int32).tobytes()) for x, a, z in _runs(b // covers[0])]
        return pd.DataFrame(out, columns=["kind", "bucket", "child", "keys", "counts"])

    def answer(frame: pd.DataFrame, width: type) -> pd.DataFrame:
        kind = int(frame["kind"].iloc[0])
        codes, cut, total, uniq, _ = merged(kind, [*frame["keys"]], [*frame["counts"]], width, buckets)
        if kind == 0:
            have = total > 0
            found = Trie((uniq[have], total[have]), order, short.value).log10(uniq)[codes].astype(np.float32)
        else:
            found = total[codes]
        return pd.DataFrame({"kind": frame["kind"], "bucket": frame["bucket"], "child": frame["child"], "found": [x.tobytes() for x in np.split(found, cut)]})

    def merge(frame: pd.DataFrame, width: type, cover: int) -> pd.DataFrame:
        frame = frame.sort_values("child")
        kind, node = (int(frame[c].iloc[0]) for c in ("kind", "node"))
        _, _, total, uniq, b = merged(kind, [*frame["keys"]], [*frame["counts"]], width, buckets)
        return pd.DataFrame([(kind, x, node, uniq[a:z].tobytes() if kind == 0 else b" ".join(uniq[a:z]), total[a:z].tobytes()) for x, a, z in _runs(b // cover)], columns=["kind", "bucket", "child", "keys", "counts"])

    def split(frame: pd.DataFrame, found: pd.DataFrame, width: type) -> pd.DataFrame:
        frame = frame.sort_values("child")
        kind = int(frame["kind"].iloc[0])
        codes, cut, _, _, _ = merged(kind, [*frame["keys"]], [*frame["counts"]], width, buckets)
        own = np.frombuffer(b"".join(found.sort_values("part")["found"]), np.int64 if kind else np.float32)[codes]
        return pd.DataFrame({"kind": frame["kind"], "bucket": frame["bucket"], "child": frame["child"], "found": [x.tobytes() for x in np.split(own, cut)]})

    sent, found_schema = "kind int, bucket int, child int, keys binary, counts binary", "kind int, bucket int, child int, found binary"
    children = dealt.groupBy("block").applyInPandas(lean_groups(ask), sent)
    met, width = [], np.int32
    for (_, cover, parts), below in zip(levels, covers[1:]):
        placed = children.withColumn("node", F.floor(F.col("child") / fan).cast("int")).repartition(parts, "kind", "bucket", "node")
        met.append((placed, width, parts, cover // below))
        children = placed.groupBy("kind", "bucket", "node").applyInPandas(lean_groups(lambda frame, w=width, c=below: merge(frame, w, c)), sent)
        width = np.int64
    answers = children.repartition(buckets, "kind", "bucket").groupBy("kind", "bucket").applyInPandas(lean_groups(lambda frame, w=width: answer(frame, w)), found_schema)
    on = ["kind", "bucket", "node"]
    for placed, width, parts, each in reversed(met):
        known = answers.select("kind", F.floor(F.col("bucket") / each).cast("int").alias("bucket"), F.col("child").alias("node"), F.col("bucket").alias("part"), "found").repartition(parts, *on)
        answers = placed.groupBy(*on).cogroup(known.groupBy(*on)).applyInPandas(lean_groups(lambda frame, found, w=width: split(frame, found, w)), found_schema)
    answers = answers.withColumnRenamed("child", "block").repartition(blocks, "block")

    def add(frame: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        texts, own = [_bytes(t) for t in frame["text"]], frame["train"].to_numpy(bool)
        found = found.sort_values(["kind", "bucket"])
        logp = np.frombuffer(b"".join(found["found"][found["kind"] == 0]), np.float32).astype(np.float64)
        _, _, _, chunks = block_grams(texts, own, order, buckets)
        scores = np.concatenate([np.add.reduceat(logp[here][codes], start) for codes, here, start in chunks])
        c = np.frombuffer(b"".join(found["found"][found["kind"] == 1]), np.int64)
        _, _, _, places, size = block_words(texts, own, buckets)
        size = size + 1
        at = np.cumsum(size) - size
        count = np.full(int(size.sum()), ends, np.int64)
        word = np.ones(len(count), bool)
        word[at + size - 1] = False
        if len(places):
            count[word] = c[places]
        base = np.add.reduceat(np.log10(count + ALPHA), at) - size * whole
        return pd.DataFrame({"doc_id": frame["doc_id"], "held_out": ~own, "n_tokens": size, "n_known": np.add.reduceat((count > 0).astype(np.int64), at), "train_tokens": tot["tokens"], "base_score": base, "score": scores})

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(lean_groups(add), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
