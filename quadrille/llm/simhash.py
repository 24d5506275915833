"""SimHash near-duplicate groups.

Fingerprints of word shingles are compared exactly, tile against tile, with
exclusive-or and bit counts.  Tiles hold fingerprints of one population count;
tile pairs whose counts differ by more than the radius are never formed, and
inside a tile pair the same bound is applied to the four 16-bit quarters.

A tile is written once to the shared folder.  A task takes one tile and a run
of its partners and reads these by path, so no fingerprint is copied into the
shuffle once for each partner.  Tiles are small against the table while the
table is small (its square root decides), so no population count fills a task.
Links leave a tile pair only as a spanning forest, so a group of thousands of
near copies gives as many edges as it has members.  Components are then found
by alternating star contractions over DataFrames, to the end.

similar() and deduplicate() compare no tiles: texts meet by keys of minima of
their shingles, and rows that a sieve of hashes clears are not shuffled.

Defined results: a null or wordless text has fingerprint 0 and links like any
other; equal fingerprints are one node, so ties and repeated rows share a
group; rows with a null id are returned too and link like others, but never
name a group that has an id (a group without any has a null name); ids keep
their type, strings included; a very long text is hashed whole, in pieces;
other columns of the input, whatever their names, are ignored by
near_duplicates() and passed on by deduplicate(); an empty table gives an
empty result.
"""

from __future__ import annotations

import io
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import discard, fresh, kind_of, lean, lean_groups, put, scratch, settle, take

SEED = 42
#: Most fingerprints of a tile; and least, below which a tile is not worth a file.
TILE, LEAST = 65536, 256
#: Partner tiles that one task row meets, as fingerprints.
RUN = 4 * TILE
CELLS = 1_000_000
#: Pairs up to which two tiles are compared without a look at the quarters.
WHOLE = 64_000_000


def fingerprint(text: str | None, words: int) -> int:
    """Unsigned 64-bit SimHash of one text; 0 without words."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) < words:
        return xxhash.xxh64_intdigest(joined, SEED)
    length = np.fromiter(map(len, tokens), np.int64, len(tokens))
    stop = np.cumsum(length + 1) - 1
    start = stop - length
    count, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    n = len(tokens) - words + 1
    for at in range(0, n, 65536):
        to = min(n, at + 65536)
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(start[at:to].tolist(), stop[at + words - 1 : to + words - 1].tolist())], np.uint64)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fp = np.array([fingerprint(t, words) for t in frame["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": frame["doc_id"].reset_index(drop=True), "fp": fp})

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(lean(run), f"doc_id {kind_of(docs, 'doc_id')}, fp long")


def _quarters(v: np.ndarray) -> np.ndarray:
    return np.bitwise_count(v.view(np.uint16).reshape(-1, 4)).astype(np.int8)


def forest(a: np.ndarray, ida: np.ndarray, b: np.ndarray, idb: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as two arrays of ids, of the links between a and b (or within a)."""
    ids = ida if same else np.concatenate([ida, idb])
    root, base = np.arange(len(ids)), 0 if same else len(ida)
    left, right = [], []
    whole = len(a) * len(b) <= WHOLE
    if whole:
        groups = [np.arange(len(a))]
    else:
        qa, qb = _quarters(a), _quarters(b)
        order = np.lexsort(qa.T)
        groups = np.split(order, np.flatnonzero(np.any(np.diff(qa[order], axis=0) != 0, axis=1)) + 1)
        qb16 = qb.astype(np.int16)
    for group in groups:
        near = np.arange(len(b)) if whole else np.flatnonzero(np.abs(qb16 - qa[group[0]]).sum(1) <= radius)
        if not len(near) or not len(group):
            continue
        other, step = b[near], max(1, CELLS // len(near))
        for at in range(0, len(group), step):
            rows = group[at : at + step]
            i, j = np.nonzero(np.bitwise_count(a[rows][:, None] ^ other[None, :]) <= radius)
            if same:
                keep = rows[i] != near[j]
                i, j = i[keep], j[keep]
            if not len(i):
                continue
            who, first = np.unique(i, return_index=True)
            for k, hits in zip(rows[who].tolist(), np.split(near[j], first[1:])):
                met = np.unique(root[hits + base])
                met = met[met != root[k]]
                if len(met):
                    all_ = np.append(met, root[k])
                    left += [k] * len(met)
                    right += met.tolist()
                    root[np.isin(root, all_)] = all_.min()
    # A root stands for its whole set, so (row, root) edges span the same sets.
    return ids[np.array(left, np.int64)], ids[np.array(right, np.int64)]


def _packed(ids: np.ndarray, fps: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, ids=ids, fps=fps)
    return out.getvalue()


def _tile(uri: str) -> tuple[np.ndarray, np.ndarray]:
    with np.load(io.BytesIO(take(uri))) as x:
        return x["ids"], x["fps"].view(np.uint64)


def tile_size(n: int, most: int = TILE) -> int:
    """Fingerprints of a tile: eight times the square root of their number, within LEAST and `most`, so that tiles and their size grow together."""
    return min(most, max(LEAST, 8 * math.isqrt(n)))


def links(nodes: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """A spanning set of links (a, b) between ids whose fingerprints differ in at most radius bits.

    nodes: id (long), fp.  Only 65 counts reach the driver."""
    spark, root = nodes.sparkSession, scratch(nodes.sparkSession, "tiles")
    pop = F.bit_count("fp").cast("int")
    counts = {r["pop"]: r["n"] for r in nodes.groupBy(pop.alias("pop")).agg(F.count("*").alias("n")).collect()}
    schema = "a long, b long"
    if not counts:
        return spark.createDataFrame([], schema)
    each = min(tile, tile_size(sum(counts.values()), tile))
    sizes = {p: -(-n // each) for p, n in counts.items()}
    parts = spark.createDataFrame([(p, n) for p, n in sizes.items()], "pop int, parts int")
    # Tiles in the order of population counts: a tile's partners are a run of numbers behind it.
    order = sorted(sizes)
    first = dict(zip(order, np.cumsum([0, *(sizes[p] for p in order)]).tolist()))
    until = {p: max(first[q] + sizes[q] for q in order if p <= q <= p + radius) for p in order}
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    cells = nodes.withColumn("pop", pop).join(F.broadcast(parts), "pop").withColumn("part", part)
    total = sum(sizes.values())

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        number = first[int(key[0])] + int(key[1])
        put(f"{root}/{number}", _packed(frame["id"].to_numpy(np.int64), frame["fp"].to_numpy(np.int64)))
        return pd.DataFrame({"tile": [number], "stop": [until[int(key[0])]]})

    # Each tile is written once; hash parts of a small count may stay empty, so the tiles that exist are what the groups say.
    tiles = settle(cells.select("pop", "part", "id", "fp").repartition(min(total, 100_000), "pop", "part").groupBy("pop", "part").applyInPandas(lean_groups(pack), "tile long, stop long"), "tile-list")
    step = max(1, RUN // each)
    runs = tiles.withColumn("start", F.explode(F.sequence(F.col("tile"), F.col("stop") - 1, F.lit(step)))).select("tile", "start", F.least(F.col("start") + step, "stop").alias("end"))
    have = np.zeros(total, bool)
    have[[r["tile"] for r in tiles.select("tile").collect()]] = True
    tasks = sum(n * max(1, (until[p] - first[p]) // step) for p, n in sizes.items()) // 16

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for mine, start, end in zip(frame["tile"].tolist(), frame["start"].tolist(), frame["end"].tolist()):
                ids, fps = _tile(f"{root}/{mine}")
                for other in range(start, end):
                    if not have[other]:
                        continue
                    same = other == mine
                    ids2, fps2 = (ids, fps) if same else _tile(f"{root}/{other}")
                    left, right = forest(fps, ids, fps2, ids2, radius, same)
                    if len(left):
                        yield pd.DataFrame({"a": left, "b": right})

    # Rows are alike in cost, so they are dealt round about, some to a task.
    return runs.repartition(min(100_000, max(4 * spark.sparkContext.defaultParallelism, tasks))).mapInPandas(lean(compare), schema)


def components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id reachable, for every id that has a link.

    Large-star and small-star steps alternate until nothing changes; every step is a settled table."""
    edges = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    last = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = settle(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("v", "m").union(low.select(F.col("u"), F.col("m"))).toDF("u", "v").where("u <> v").distinct()
        small = settle(small, "small-star")
        mark = small.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        discard(edges)
        discard(large)
        edges = small
        if mark == last:
            break
        last = mark
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, tile: int = TILE) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links of at most radius bits)."""
    return linked(settle(fingerprints(docs, words), "fingerprints"), radius, tile)


def linked(fps: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """fps (doc_id, fp) with component_id (smallest doc_id reachable over links of at most radius bits)."""
    nodes = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes.select(F.col("fp").alias("id"), "fp"), radius, tile))
    return _named(fps, nodes, found, "fp").select("doc_id", "fp", "component_id")


def _named(rows: DataFrame, nodes: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """rows with component_id, the smallest `least` among the nodes (key, least) of a component; rows may crowd on a node, so they meet a settled table."""
    placed = nodes.join(found, nodes[key] == found["id"], "left").select(nodes[key], "least", F.coalesce("component", nodes[key]).alias("c"))
    # Settled, so that the nodes of a large component can be split in the join.
    low = settle(placed.groupBy("c").agg(F.min("least").alias("component_id")), "least-ids")
    named = settle(placed.join(low, "c").select(key, "component_id"), "named")
    return rows.join(named, key)


def fingerprint_hex(column: str = "fp"):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


# --- similarity joins on wide fingerprints -----------------------------------

WIDE = 8
#: Keys of a text, each of ROWS minima of its shingles: texts at a similarity of 0.8 share none once in 20 million pairs.
BANDS, ROWS = 32, 4
#: Nodes of a key that one side of a block pair holds.
BUCKET = 4096
#: Places of a sieve; 64 of them are one row of a broadcast.
PLACES = 1 << 23
#: Standard errors that a candidate may lie above the bits expected at the similarity.
MARGIN = 3.5
#: Texts of a candidate group that one side of a block pair holds.
BLOCK = 512


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles of words; a shorter text is one shingle, one without words has none."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    length = np.fromiter(map(len, tokens), np.int64, len(tokens))
    stop = np.cumsum(length + 1) - 1
    start = stop - length
    stop = stop[words - 1 :] if len(tokens) >= words else stop[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(start.tolist(), stop.tolist())], np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_DRAWN = _mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FLIP, _ODD = (_DRAWN >> np.uint64(32)).astype(np.uint32).reshape(2, -1) | np.array([[0], [1]], np.uint32)


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys (signed ints) of a set of shingles; two sets share each with the ROWS-th power of their Jaccard similarity."""
    h, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(h), 512):
        least = np.minimum(least, ((h[at : at + 512, None] ^ _FLIP) * _ODD).min(0))
    key = np.zeros(BANDS, np.uint64)
    for x in least.reshape(BANDS, ROWS).T:
        key = _mix(key + x)
    return (key >> np.uint64(32)).astype(np.uint32).view(np.int32)


def wide_of(hashes: np.ndarray) -> bytes:
    """SimHash of WIDE 64-bit words of a set of shingles; the first takes the hashes as they are, the others mix them anew."""
    if not len(hashes):
        return bytes(8 * WIDE)
    count = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(hashes), 8192):
        h = hashes[at : at + 8192]
        all_ = np.empty((len(h), WIDE), np.uint64)
        for k in range(WIDE):
            x = h + np.uint64((k * 0x9E3779B97F4A7C15) % 2**64) if k else h
            all_[:, k] = _mix(x) if k else x
        count += np.unpackbits(all_.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(count * 2 > len(hashes), bitorder="little").tobytes()


def wide_fingerprint(text: str | None, words: int) -> bytes:
    return wide_of(shingles(text, words))


def wide_radius(similarity: float) -> int:
    """Differing bits up to which two shingle sets are candidates for this Jaccard similarity: the number expected and MARGIN standard errors."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * WIDE
    return round(bits * share + MARGIN * math.sqrt(bits * share * (1 - share)))


def confirmed(ids: np.ndarray, sets: list[np.ndarray], split: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs whose sets have at least this Jaccard similarity: of rows before split with rows from split on, or among all rows where split is 0.

    Candidates are met in the order of their distance; a pair that the forest joins already is not computed."""
    wide = np.frombuffer(b"".join(map(wide_of, sets)), np.uint64).reshape(-1, WIDE)
    size, root, radius = np.array([len(x) for x in sets], np.int64), np.arange(len(ids)), wide_radius(similarity)
    left, right = [], []
    for k in range(split or len(ids)):
        at = split or k + 1
        far = np.bitwise_count(wide[at:] ^ wide[k]).sum(1, dtype=np.int64)
        small, large = np.minimum(size[at:], size[k]), np.maximum(size[at:], size[k])
        near = np.flatnonzero((far <= radius) & (small >= similarity * large))
        for j in (near[np.argsort(far[near], kind="stable")] + at).tolist():
            if root[j] == root[k]:
                continue
            both = len(np.intersect1d(sets[k], sets[j], assume_unique=True))
            if both >= similarity * (size[k] + size[j] - both):
                left.append(k)
                right.append(j)
                a, b = root[k], root[j]
                root[root == max(a, b)] = min(a, b)
    return ids[np.array(left, np.int64)], ids[np.array(right, np.int64)]


def sieved(df: DataFrame, column: str, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of df whose column (long) may be among the keys, and some that are not; with left_anti the rest, which surely is not.

    The keys are bits of a map of PLACES, broadcast whatever their number; so what the keys don't concern needs no shuffle."""

    def place(c):
        return F.pmod(F.xxhash64(c), F.lit(PLACES))

    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").cast("int"))
    bits = keys.select(F.floor(place(key) / 64).alias("word"), (place(key) % 64).alias("bit")).groupBy("word").agg(F.bit_or(one).alias("bits"))
    at = place(df[column])
    return df.join(F.broadcast(bits), (F.floor(at / 64) == bits["word"]) & (F.getbit(bits["bits"], at % 64) == 1), how)


def near_forest(ids: np.ndarray, wide: np.ndarray, split: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within radius over all words: of rows before split with rows from split on, or among all rows where split is 0."""
    root, left, right = np.arange(len(ids)), [], []
    for k in range(split or len(ids)):
        at = split or k + 1
        other = np.flatnonzero(root[at:] != root[k]) + at
        near = other[np.bitwise_count(wide[other] ^ wide[k]).sum(1, dtype=np.int64) <= radius]
        # One edge to each of the sets that are met.
        met, first = np.unique(root[near], return_index=True)
        if len(met):
            left += [k] * len(met)
            right += near[first].tolist()
            met = np.append(met, root[k])
            root[np.isin(root, met)] = met.min()
    return ids[np.array(left, np.int64)], ids[np.array(right, np.int64)]


def candidates(nodes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that span the pairs of nodes which share a key and differ in at most radius bits of their wide fingerprints.

    nodes: id (16 bytes), wide, bands.  Nodes that share a key are a bucket; of buckets with the same nodes one is
    looked at, and a large one is cut into blocks, each pair of which is compared by itself.  What this costs follows
    the buckets of more than one node, not the square of the table."""
    spark = nodes.sparkSession
    entries = nodes.select(F.xxhash64("id").alias("node"), F.posexplode("bands").alias("band", "v")).select((F.col("band") * F.lit(1 << 32) + F.col("v")).alias("key"), "node")
    shared = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first"), F.max("node").alias("last"), F.bit_xor(F.xxhash64("node")).alias("all")).where("n > 1")
    buckets = settle(shared.groupBy("n", "first", "last", "all").agg(F.min("key").alias("key")).select("key", "n"), "buckets")
    total = buckets.agg(F.sum("n")).first()[0]
    if not total:
        return spark.createDataFrame([], "a binary, b binary")
    parts = F.ceil(F.col("n") / BUCKET).cast("int")
    placed = sieved(entries, "key", buckets, "key").join(buckets, "key").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int"))
    met = placed.join(nodes.select(F.xxhash64("id").alias("node"), "id", "wide"), "node").select("key", "part", "id", "wide", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    pairs = met.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "id", "wide")
    on = ["key", "lo", "hi"]

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in itertools.chain(frames, [None]):
            if frame is not None:
                rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if rest is None or not len(rest):
                continue
            place = rest[on].to_numpy()
            at = [0, *(np.flatnonzero(np.any(place[1:] != place[:-1], axis=1)) + 1).tolist()]
            if frame is None:  # the last group ends with the rows
                at.append(len(rest))
            first = rest["part"].to_numpy() == rest["lo"].to_numpy()
            apart = rest["lo"].to_numpy() != rest["hi"].to_numpy()
            ids, wide = rest["id"].to_numpy(), np.frombuffer(b"".join(rest["wide"]), np.uint64).reshape(len(rest), -1)
            found = []
            for a, b in zip(at, at[1:]):
                order, split = np.arange(a, b), 0
                if apart[a]:
                    order, split = a + np.argsort(~first[a:b], kind="stable"), int(first[a:b].sum())
                    if split in (0, b - a):  # one of the two blocks is empty
                        continue
                found.append(near_forest(ids[order], wide[order], split, radius))
            rest = rest.iloc[at[-1] :].reset_index(drop=True)
            if found:
                yield pd.DataFrame({"a": np.concatenate([a for a, _ in found]), "b": np.concatenate([b for _, b in found])})

    # Sorted rows bring the groups one after another, many to a task: most buckets are of two nodes.
    number = min(100_000, max(4 * spark.sparkContext.defaultParallelism, total // 50_000))
    return pairs.repartition(number, *on).sortWithinPartitions(*on).mapInPandas(lean(compare), "a binary, b binary")


def similar_links(texts: DataFrame, groups: DataFrame, words: int, similarity: float) -> DataFrame:
    """A spanning set of links (a, b) between nodes of one group whose shingle sets have at least this Jaccard similarity.

    texts: id, text; groups: id, component.  A group is cut into blocks of
    texts, and each pair of its blocks is one task's, so no group is too large."""
    kind, long = kind_of(texts, "id"), kind_of(texts, "id") != "binary"
    parts = groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    placed = groups.join(parts, "component").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    met = texts.join(placed, "id").select("id", "text", "component", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    pairs = met.select("component", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "id", "text")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        first = (frame["part"] == frame["lo"]).to_numpy()
        order = np.argsort(~first, kind="stable")
        split = 0 if first.all() and (frame["lo"] == frame["hi"]).all() else int(first.sum())
        sets = [shingles(t, words) for t in frame["text"].iloc[order]]
        ids = frame["id"].to_numpy(np.int64) if long else np.frombuffer(b"".join(frame["id"]), "V16")
        left, right = confirmed(ids[order], sets, split, similarity)
        return pd.DataFrame({"a": left if long else left.tolist(), "b": right if long else right.tolist()})

    return pairs.groupBy("component", "lo", "hi").applyInPandas(lean_groups(compare), f"a {kind}, b {kind}")


def similar(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, row (xxhash64 of the text), component (16 bytes) and component_id (its smallest doc_id): groups linked by a Jaccard similarity of the sets of word shingles.

    Keys and wide fingerprints give candidates only: pairs that share one of
    BANDS keys are held to wide_radius(similarity) over all words.  Inside the
    groups of candidates every link is then confirmed on the shingle sets
    themselves.  Texts of one set of shingles are one node, named by a digest
    of the set."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [shingles(t, words) for t in frame["text"]]
            wide = [wide_of(h) for h in sets]
            yield pd.DataFrame({"doc_id": frame["doc_id"].reset_index(drop=True), "row": frame["row"].to_numpy(np.int64), "wide": wide, "bands": [bands_of(h) for h in sets], "content": [xxhash.xxh3_128_digest(h.tobytes()) for h in sets]})

    usable = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("row"), F.col("text").cast("string").alias("text"))
    fps = settle(usable.mapInPandas(lean(run), f"doc_id {kind_of(docs, 'doc_id')}, row long, wide binary, bands array<int>, content binary"), "wide")
    # One row stands for the texts of a node: the smallest hash, and among its ids the smallest.
    nodes = settle(fps.groupBy("content").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.first("wide").alias("wide"), F.first("bands").alias("bands")), "wide-nodes")
    groups = components(candidates(nodes.select(F.col("content").alias("id"), "wide", "bands"), wide_radius(similarity)))
    # The smallest id of a group may be missing as a node of its own group.
    groups = settle(groups.union(groups.select(F.col("component").alias("id"), "component")).distinct(), "groups")
    # The texts of the nodes of groups, one for each: fetched by the hash of the text.
    wanted = settle(nodes.join(groups.select(F.col("id").alias("content")), "content", "left_semi").select("content", F.col("row").alias("r")), "wanted")
    texts = sieved(usable.select(F.col("row").alias("r"), "text"), "r", wanted, "r").join(wanted, "r").groupBy(F.col("content").alias("id")).agg(F.first("text").alias("text"))
    found = components(similar_links(texts, groups, words, similarity))
    placed = nodes.join(found, nodes["content"] == found["id"], "left").select("content", "least", F.coalesce("component", "content").alias("component"))
    low = settle(placed.groupBy("component").agg(F.min("least").alias("component_id")), "least-ids")
    named = settle(placed.join(low, "component").select("content", "component", "component_id"), "named")
    return fps.select("doc_id", "row", "content").join(named, "content").select("doc_id", "row", "component", "component_id")


def deduplicate(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id (null ids last), among equal ids of the smallest hash of the text; of rows equal in both, one."""
    id_, row_, n_ = (fresh(docs, x) for x in ("__id", "__row", "__n"))
    group = similar(docs, words, similarity)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    rows = settle(group.groupBy("component", "doc_id", "row").agg(F.count("*").alias("n")), "group-rows")
    best = settle(rows.groupBy("component").agg(F.min(rank).alias("best"), F.sum("n").alias("size")).where("size > 1"), "best")
    members = rows.join(best, "component").select(F.col("doc_id").alias(id_), F.col("row").alias(row_), (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("row") == F.col("best.row"))).alias("stays"), "n")
    members = settle(members.groupBy(id_, row_).agg(F.min("stays").alias("stays"), F.sum("n").alias("n")), "members")
    keyed = docs.withColumn(row_, F.xxhash64(F.col("text").cast("string")))
    gone = members.where("not stays or n > 1")
    # Rows that no hash among these concerns stay where they are.
    clear = sieved(keyed, row_, gone, row_, "left_anti").select(*docs.columns)
    some = sieved(keyed, row_, gone, row_)
    on = [F.col("doc_id").eqNullSafe(F.col(id_)), some[row_] == F.col(f"m.{row_}")]
    kept = some.join(gone.alias("m"), on, "left_anti").select(*docs.columns)
    again = some.join(members.where("stays and n > 1").alias("m"), on, "left_semi")
    one = again.withColumn(n_, F.row_number().over(Window.partitionBy("doc_id", row_).orderBy(row_))).where(F.col(n_) == 1)
    return clear.unionByName(kept).unionByName(one.select(*docs.columns))
