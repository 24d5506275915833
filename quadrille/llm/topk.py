"""Exact top-k inner products over norm-sorted tiles.

Vectors are scaled and floored to integers and dealt into tiles by descending
length; tiles and blocks of queries are written once to the shared folder and
read by path.  Every block first meets the tile of the longest vectors, which
gives its queries a threshold.  Then a task takes a block and a stripe of the
other tiles in descending order, keeps its thresholds rising, and stops for
good once |q| times the longest vector left is below all of them, so no query
is sent to tiles that cannot matter.  Within a block, sums over the first
coordinates after an SVD rotation plus the Cauchy-Schwarz bound of the rest
leave few candidates, and only these get the exact integer product.

Defined results: rows with a null id, a null vector or a null or non-finite
component take no part; shorter vectors count as filled up with zeros; ties go
to the smaller id; every row with the query's id is the query's own; repeated
rows stay candidates each, a repeated query is asked once; components whose
scaled value leaves the range of double are held at its ends, and products
beyond the range of long at those of long; vec_id is a whole number (other ids
raise); other columns, whatever their names, are ignored; empty tables give an
empty result.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import put, scratch, settle, take

K, SCALE = 10, 1024
#: Most vectors of a tile and queries of a block, and bytes that either may have.
TILE, QUERIES, BYTES = 32768, 8192, 32 << 20
BLOCK, FIT = 1024, 8192
HEAD = 16
LARGEST = np.finfo(np.float64).max


def lengths(v: np.ndarray) -> np.ndarray:
    """Euclidean length of each row; scaled, so squares of large components don't overflow."""
    most = np.abs(v).max(axis=1, initial=0.0)
    safe = np.where(most > 0, most, 1.0)
    with np.errstate(over="ignore"):
        return most * np.sqrt(((v / safe[:, None]) ** 2).sum(1))


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """id, v (array of whole doubles), norm of the usable rows."""
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            with np.errstate(over="ignore"):
                v = [np.clip(np.floor(scale * np.asarray(x, np.float64)), -LARGEST, LARGEST) for x in frame["embedding"]]
            yield pd.DataFrame({"id": frame["vec_id"], "v": v, "norm": [float(lengths(x[None])[0]) for x in v]})

    return vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInPandas(run, "id long, v array<double>, norm double")


def _matrix(rows, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def rotation(some: np.ndarray) -> np.ndarray:
    """Orthogonal, by the singular vectors of a sample; the sample is scaled first, so large components don't overflow."""
    most = np.abs(some).max(initial=0.0)
    unit = some / most if most > 0 else some
    return np.linalg.svd(unit.T @ unit)[0]


def exact(q: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer products of the pairs (q[i], v[j])."""
    with np.errstate(over="ignore"):
        most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if most < 2**53:
        if len(i) * 8 > len(q) * len(v):
            return (q @ v.T)[i, j].astype(np.int64)
        return np.concatenate([np.einsum("nd,nd->n", q[i[a : a + 65536]], v[j[a : a + 65536]]) for a in range(0, len(i), 65536)] or [np.zeros(0)]).astype(np.int64)
    whole = [[int(x) for x in row] for row in q], [[int(x) for x in row] for row in v]
    return np.array([min(max(sum(a * b for a, b in zip(whole[0][x], whole[1][y])), -(2**63)), 2**63 - 1) for x, y in zip(i.tolist(), j.tolist())], np.int64)


def scan(q: np.ndarray, qid: np.ndarray, least: np.ndarray, v: np.ndarray, vid: np.ndarray, turn: np.ndarray, k: int, head: int = HEAD):
    """Best k of v for each q among those that may reach `least` (-inf: all): query places, ids, scores."""
    norm = lengths(v)
    order = np.lexsort((vid, -norm))
    v, vid, norm = v[order], vid[order], norm[order]
    qn, least = lengths(q), least.copy()
    h = min(head, q.shape[1])
    with np.errstate(over="ignore", invalid="ignore"):
        tq, tv = q @ turn, v @ turn
        rq, rv = lengths(tq[:, h:]), lengths(tv[:, h:])
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
    for at in range(0, len(v), BLOCK):
        to = min(len(v), at + BLOCK)
        # Where a bound leaves the range of double (infinite or not a number), it bounds nothing and the pair is computed.
        with np.errstate(over="ignore", invalid="ignore"):
            slack = 1 + 1e-9 * qn * norm[at]
            live = np.flatnonzero(~(qn * norm[at] + slack < least))
            if not len(live):
                break
            bound = tq[live, :h] @ tv[at:to, :h].T + np.outer(rq[live], rv[at:to])
            i, j = np.nonzero(~(bound + slack[live, None] < least[live, None]) & (qid[live, None] != vid[None, at:to]))
        s = exact(q[live], v[at:to], i, j)
        rows, first = np.unique(i, return_index=True)
        for r, a, b in zip(live[rows].tolist(), first.tolist(), [*first[1:].tolist(), len(i)]):
            ids, scores = np.append(best[r][0], vid[at:to][j[a:b]]), np.append(best[r][1], s[a:b])
            if len(ids) > k:
                top = np.lexsort((ids, -scores.astype(object) if len(scores) and scores.min() == -(2**63) else -scores))[:k]
                ids, scores = ids[top], scores[top]
            best[r] = ids, scores
            if len(ids) == k:
                least[r] = max(least[r], float(scores.min()))
    place = np.repeat(np.arange(len(q)), [len(b[0]) for b in best])
    return place, np.concatenate([b[0] for b in best] or [np.zeros(0, np.int64)]), np.concatenate([b[1] for b in best] or [np.zeros(0, np.int64)])


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _read(uri: str, *names: str) -> list[np.ndarray]:
    with np.load(io.BytesIO(take(uri))) as x:
        return [x[n] for n in names]


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, tile: int = TILE, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score.  is_query: over the column id."""
    spark = vectors.sparkSession
    rows = settle(integers(vectors, scale), "vectors")
    stats = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.count(F.when(is_query, 1)).alias("q")).first()
    n, dim = stats["n"], max(1, stats["dim"] or 1)
    if not n or not stats["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    fit = max(1, BYTES // (8 * dim))
    tile, queries = min(tile, fit), min(queries, fit)
    root = scratch(spark, "top-k")
    # The rotation may be any; it is fitted on at most FIT rows.
    turn = rotation(_matrix(rows.orderBy(F.xxhash64("id"), "id").limit(FIT).select("v").toPandas()["v"], dim))
    # Bins of descending length by quantiles, with one array of cuts for all rows; a crowded bin is dealt into several tiles.
    bins = math.ceil(n / tile)
    cuts = np.array(sorted({*rows.agg(F.percentile_approx("norm", F.array(*[F.lit(i / min(bins, 10_000)) for i in range(1, min(bins, 10_000))]), 10_000)).first()[0]}) if bins > 1 else [])

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(bin=len(cuts) - np.searchsorted(cuts, frame["norm"].to_numpy(), side="right"))

    binned = rows.mapInPandas(deal, "id long, v array<double>, norm double, bin int")
    only = rows.select("norm").mapInPandas(deal, "norm double, bin int")
    parts = {r["bin"]: math.ceil(r["n"] / tile) for r in only.groupBy("bin").agg(F.count("*").alias("n")).collect()}
    order = sorted(parts)
    start = dict(zip(order, np.cumsum([0, *(parts[b] for b in order)]).tolist()))
    tiles = sum(parts.values())
    placed = binned.join(F.broadcast(spark.createDataFrame([(b, start[b], parts[b]) for b in order], "bin int, start long, parts int")), "bin")
    placed = placed.select("id", "v", (F.col("start") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("tile"))

    def store(frame: pd.DataFrame) -> pd.DataFrame:
        v, number = _matrix(frame["v"], dim), int(frame["tile"].iloc[0])
        put(f"{root}/tile-{number}", _packed(ids=frame["id"].to_numpy(np.int64), v=v))
        return pd.DataFrame({"tile": [number], "longest": [float(lengths(v).max())]})

    met = placed.repartition(tiles, "tile").groupBy("tile").applyInPandas(store, "tile long, longest double").toPandas().sort_values("tile")
    # The longest vector of a tile or of any behind it.
    names, longest = met["tile"].to_numpy(), np.maximum.accumulate(met["longest"].to_numpy()[::-1])[::-1]
    blocks = math.ceil(stats["q"] / queries)
    asked = rows.where(is_query).dropDuplicates(["id", "v"]).select("id", "v", F.xxhash64("v").alias("key"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    schema = "query_id long, key long, vec_id long, score long"

    def found(qid: np.ndarray, key: np.ndarray, place: np.ndarray, vid: np.ndarray, score: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"query_id": qid[place], "key": key[place], "vec_id": vid, "score": score})

    def begin(frame: pd.DataFrame) -> pd.DataFrame:
        """Write a block of queries with the thresholds that the longest vectors give."""
        q, qid, key = _matrix(frame["v"], dim), frame["id"].to_numpy(np.int64), frame["key"].to_numpy(np.int64)
        ids, v = _read(f"{root}/tile-{names[0]}", "ids", "v")
        place, vid, score = scan(q, qid, np.full(len(q), -np.inf), v, ids, turn, k)
        least = np.full(len(q), -np.inf)
        full = np.flatnonzero(np.bincount(place, minlength=len(q)) >= k)
        least[full] = [score[place == i].min() for i in full]
        put(f"{root}/block-{int(frame['block'].iloc[0])}", _packed(q=q, qid=qid, key=key, least=least))
        return found(qid, key, place, vid, score)

    first = settle(asked.repartition(blocks, "block").groupBy("block").applyInPandas(begin, schema), "first")
    have = sorted(r["block"] for r in asked.select("block").distinct().collect())

    stripes = min(tiles - 1, max(1, math.ceil(4 * spark.sparkContext.defaultParallelism / len(have)), math.ceil((tiles - 1) / 256)))

    def go_on(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for task in frame["id"].tolist():
                q, qid, key, least = _read(f"{root}/block-{have[task // stripes]}", "q", "qid", "key", "least")
                qn, out = lengths(q), []
                for t in range(1 + task % stripes, tiles_met, stripes):
                    with np.errstate(over="ignore", invalid="ignore"):
                        if (qn * longest[t] * (1 + 1e-9) + 1 < least).all():
                            break
                    ids, v = _read(f"{root}/tile-{names[t]}", "ids", "v")
                    out.append(scan(q, qid, least, v, ids, turn, k))
                    # The best k of the stripe so far raise its thresholds.
                    place, vid, score = (np.concatenate(x) for x in zip(*out))
                    by = np.lexsort((vid, ~score, place))
                    rank = np.arange(len(by)) - np.searchsorted(place[by], place[by])
                    by = by[rank < k]
                    out = [(place[by], vid[by], score[by])]
                    kth = rank[rank < k] == k - 1
                    least[place[by][kth]] = np.maximum(least[place[by][kth]], score[by][kth].astype(np.float64))
                for x in out:
                    yield found(qid, key, *x)

    tiles_met = len(names)
    all_ = first
    if tiles_met > 1:
        rest = spark.range(0, len(have) * stripes, 1, min(100_000, len(have) * stripes)).mapInPandas(go_on, schema)
        all_ = first.unionByName(rest)
    w = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    best = all_.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
