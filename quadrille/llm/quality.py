"""Byte-level convolutional quality classifier in numpy.

A document's UTF-8 bytes are embedded and convolved with learned filters; the
rectified responses are max-pooled over chunks of 512 bytes that overlap by
half and cover the whole document.  Each chunk's pooled responses go through
a small layer; its outputs, by maximum and by mean over the chunks, give one
probability.  The network is fitted on the driver by Adam with hand-written
gradients on at most `rows` labelled documents of each class, every chunk of
each; scoring reads every byte.

Defined results: a null or empty text is scored as one chunk of zero bytes; a
very long text is read whole, in learning and in scoring; repeated rows score
alike, and of rows that repeat a labelled id one text is learned from; labels
or ids that are null are not used; with labels of one class only the score is
that class's share; a table without rows gives an empty result; other columns
pass through score(), and a column with the name of the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import lean

HALF, WIDTH, STRIDE = 256, 8, 2
TAIL = WIDTH - STRIDE
EMBED, FILTERS, HIDDEN = 8, 32, 16
ROWS, BATCH = 1800, 32
#: Parts of a batch whose gradients are computed side by side and added in order.
THREADS = 4
TAPS = WIDTH // STRIDE


def halves(text) -> np.ndarray:
    """laid() of a text, null for empty."""
    return laid((text if isinstance(text, str) else "").encode("utf-8", "replace"))


def laid(raw: bytes) -> np.ndarray:
    """(n, HALF + TAIL) bytes: each half chunk with the bytes that its last windows reach into; n is 2 or more."""
    n = max(2, -(-len(raw) // HALF))
    flat = np.zeros(n * HALF + TAIL, np.uint8)
    flat[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.as_strided(flat, (n, HALF + TAIL), (HALF, 1))


class Net:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda scale, *shape: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "emb": f(0.5, 256, EMBED), "k": f((WIDTH * EMBED) ** -0.5, WIDTH * EMBED, FILTERS), "kb": np.zeros(FILTERS, np.float32),
            "w1": f(FILTERS**-0.5, FILTERS, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "w2": f((2 * HIDDEN) ** -0.5, 2 * HIDDEN), "b2": np.zeros(1, np.float32),
        }
        self.shift = 0.0

    def responses(self, rows: np.ndarray) -> np.ndarray:
        """Filter responses (rows, places, FILTERS) before rectifying."""
        pairs = self.p["emb"][rows].reshape(len(rows), -1, STRIDE * EMBED)
        taps = self.p["k"].reshape(TAPS, STRIDE * EMBED, FILTERS).transpose(1, 0, 2).reshape(STRIDE * EMBED, TAPS * FILTERS)
        y = (pairs.reshape(-1, STRIDE * EMBED) @ taps).reshape(len(rows), -1, TAPS, FILTERS)
        n = y.shape[1] - TAPS + 1
        out = y[:, :n, 0] + self.p["kb"]
        for t in range(1, TAPS):
            out += y[:, t : t + n, t]
        return out

    def pooled(self, rows: np.ndarray, step: int = 64) -> np.ndarray:
        return np.concatenate([np.maximum(self.responses(rows[a : a + step]).max(1), 0) for a in range(0, len(rows), step)])

    def logits(self, chunks: np.ndarray, size: np.ndarray, keep: bool = False):
        """From pooled chunks (n, FILTERS) of documents of `size` chunks each."""
        h = np.tanh(chunks @ self.p["w1"] + self.p["b1"])
        at = np.cumsum(size) - size
        both = np.concatenate([np.maximum.reduceat(h, at), np.add.reduceat(h, at) / size[:, None]], 1)
        z = both @ self.p["w2"] + self.p["b2"][0]
        return (z, h, both, at) if keep else z

    def probability(self, texts) -> np.ndarray:
        out = []
        for part in _sliced(texts):
            rows = [halves(t) for t in part]
            size = np.fromiter(map(len, rows), np.int64, len(rows))
            p = self.pooled(np.concatenate(rows))
            inside = np.ones(len(p), bool)
            inside[np.cumsum(size) - 1] = False
            chunks = np.maximum(p[:-1], p[1:])[inside[:-1]]
            out.append(1 / (1 + np.exp(-np.clip(self.logits(chunks, size - 1).astype(np.float64) + self.shift, -40, 40))))
        return np.concatenate(out) if out else np.zeros(0)

    def tops(self, rows: np.ndarray, step: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Of each half chunk and filter, the largest response and its place."""
        top, place = np.empty((len(rows), FILTERS), np.result_type(self.p["k"])), np.empty((len(rows), FILTERS), np.int64)
        for a in range(0, len(rows), step):
            r = self.responses(rows[a : a + step])
            p = r.argmax(1)
            place[a : a + step], top[a : a + step] = p, np.take_along_axis(r, p[:, None], 1)[:, 0]
        return top, place

    def gradients(self, docs: list[np.ndarray], y: np.ndarray, of: int | None = None) -> dict:
        """docs: the half chunks of each document; of: documents in the batch that these are part of."""
        p = self.p
        rows = np.concatenate(docs)
        halves_of = np.fromiter(map(len, docs), np.int64, len(docs))
        size, last = halves_of - 1, np.cumsum(halves_of) - 1
        inside = np.ones(len(rows), bool)
        inside[last] = False
        first_half = np.flatnonzero(inside)  # of each chunk; the second is the next row
        top, place = self.tops(rows)
        # A chunk's pool is the larger of its halves'; the gradient goes to the place in that half.
        second = top[first_half + 1] > top[first_half]
        source = first_half[:, None] + second
        columns = np.arange(FILTERS)[None]
        pool = np.maximum(top[source, columns], 0)
        z, h, both, at = self.logits(pool, size, True)
        dz = (1 / (1 + np.exp(-z)) - y).astype(np.float32) / (of or len(y))
        g = {"w2": dz @ both, "b2": dz.sum(keepdims=True)}
        dboth = dz[:, None] * p["w2"]
        doc = np.repeat(np.arange(len(size)), size)
        first = h == both[doc, :HIDDEN]
        dh = first * dboth[doc, :HIDDEN] + (dboth[:, HIDDEN:] / size[:, None])[doc]
        da = (dh * (1 - h * h)).astype(np.float32)
        g["w1"], g["b1"] = pool.T @ da, da.sum(0)
        dtop = (da @ p["w1"].T) * (pool > 0)
        g["kb"], g["k"] = dtop.sum(0), np.zeros_like(p["k"])
        emb = np.zeros((256, EMBED))
        for a in range(0, len(dtop), 256):
            d, src = dtop[a : a + 256], source[a : a + 256]
            seen = rows[src[:, :, None], STRIDE * place[src, columns][:, :, None] + np.arange(WIDTH)]
            g["k"] += np.einsum("nfk,nf->kf", p["emb"][seen].reshape(len(d), FILTERS, -1), d)
            dx = (d[:, :, None] * p["k"].T[None]).reshape(-1, EMBED)
            emb += np.stack([np.bincount(seen.ravel(), weights=dx[:, e], minlength=256) for e in range(EMBED)], 1)
        g["emb"] = emb.astype(p["emb"].dtype)
        return g

    def fit(self, docs: list[bytes], y: np.ndarray, steps: int = 700, rate: float = 0.02, seed: int = 7) -> Net:
        """docs: UTF-8 texts.  A batch is laid out in half chunks when its turn comes, so the texts are held once."""
        r = np.random.default_rng(seed)
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        order: list[int] = []
        with ThreadPoolExecutor(THREADS) as pool:
            for step in range(1, steps + 1):
                if len(order) < BATCH:
                    order += r.permutation(len(docs)).tolist()
                pick, order = order[:BATCH], order[BATCH:]
                parts = [pick[i::THREADS] for i in range(THREADS) if pick[i::THREADS]]
                found = [*pool.map(lambda part, n=len(pick): self.gradients([laid(docs[i]) for i in part], y[part], n), parts)]
                lr = rate * (1 - step / (steps + 1))
                for k, v in self.p.items():
                    g = sum(x[k] for x in found)
                    a, b = m[k]
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    v -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return self


class Share:
    """What is left of a classifier when the labels have one class or none."""

    def __init__(self, share: float):
        self.share = share

    def probability(self, texts) -> np.ndarray:
        return np.full(len(texts), self.share)


def _sliced(texts, most: int = 2_000_000) -> Iterator[list]:
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t) if isinstance(t, str) else 0
        if n >= most:
            yield part
            part, n = [], 0
    if part:
        yield part


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", rows: int = ROWS):
    """Fit on labels (doc_id, column of 0 and 1) joined to docs.  At most 2 * rows documents, whole, reach the driver."""
    usable = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(column).cast("int").alias("y"))
    total = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return Share(float(next(iter(total), 0.5)))
    pick = None
    for y in (0, 1):
        some = usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        pick = some if pick is None else pick.union(some)
    # One text for each label, however often its id is repeated in docs; the bound on rows holds for what is broadcast, too.
    found = docs.select("doc_id", "text").join(F.broadcast(pick.distinct()), "doc_id").groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).toPandas()
    found = found.sort_values(["doc_id", "y"])
    y = found["y"].to_numpy(np.float32)
    if len({*y}) < 2:
        return Share(total[1] / (total[0] + total[1]))
    net = Net().fit([t.encode("utf-8", "replace") for t in found["text"]], y)
    # The sample holds the classes in other shares than the labels.
    net.shift = float(np.log(total[1] / y.sum()) - np.log(total[0] / (1 - y).sum()))
    return net


def score(docs: DataFrame, net, name: str = "score") -> DataFrame:
    """docs with `name` (probability of label 1) added or replaced."""
    base = [c for c in docs.columns if c != name]
    place = base.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            s = net.probability(batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(base))), pa.array(s, pa.float64())], names=[*base, name])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.select(*base).schema), f"`{name}` double"])
    return docs.select(*base).mapInArrow(lean(run), schema)
