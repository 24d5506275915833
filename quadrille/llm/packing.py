"""Packing token sequences: dominance reduction, then best fit.

The instance is the histogram of piece lengths, at most `capacity` numbers
whatever the corpus.  On it, sets that provably dominate every alternative for
a piece are fixed for good (Martello and Toth): a piece that nothing fits
beside; a pair that fills a sequence exactly; the largest partner where no two
pieces fit beside; the largest partner where at most two fit and no two
together are longer.  What is left is packed by best fit in descending order.
Equal lengths are handled in bulk: a pair that dominates goes on dominating
while both lengths last, as fewer pieces leave fewer alternatives, so each
step uses up a length and the plan has a size set by the capacity.

Pieces are numbered inside their length by (task, place in the task) with a
prefix sum over tasks, so no length, however frequent, meets in one task.

Defined results: a null or empty text gives the one-token document of the end
id; a very long text is encoded whole and cut into pieces; equal lengths are
ties, and repeated rows are packed each; a null doc_id is kept; an empty table
gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import lean, settle

CAPACITY, END_ID = 2048, 0
_TOOLS: dict = {}
#: Characters on which both tokenizer libraries are known to split alike; texts with others go to the slower one.
_PLAIN = re.compile("[^\x00-\x1b\x20-ɏ‐-‧‰-⁞₠-₿]")


def encoder(json_path: str, ranks_path: str, pattern: str):
    """text -> ids as the tokenizers library gives with the file json_path."""
    if (json_path, ranks_path) not in _TOOLS:
        import tiktoken

        with open(json_path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        exact: list = []  # loaded for the first text that needs it

        def encode(text: str) -> list[int]:
            if _PLAIN.search(text):
                if not exact:
                    from tokenizers import Tokenizer

                    exact.append(Tokenizer.from_file(json_path))
                    exact[0].no_truncation()
                    exact[0].no_padding()
                return exact[0].encode(text, add_special_tokens=False).ids
            return fast.encode(text, allowed_special="all")

        _TOOLS[json_path, ranks_path] = encode
    return _TOOLS[json_path, ranks_path]


def pieces(docs: DataFrame, tools: tuple[str, str, str], capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; task and k number the rows, place numbers those of a length within the task."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, task, k = encoder(*tools), TaskContext.get().partitionId(), 0
        used = np.zeros(capacity + 1, np.int64)
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"]):
                ids = np.array([*encode(text), end_id] if isinstance(text, str) and text else [end_id], "<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
                for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc, p, a, b - a, zlib.crc32(ids[a:b].tobytes()), task, k, int(used[b - a])))
                    used[b - a] += 1
                    k += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "k", "place"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(lean(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task long, k long, place long")


def reduce(count: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets; count is shrunk in place.  Gives (lengths of a sequence, how many such)."""
    fixed, sizes = [], sorted(x for x, n in count.items() if n)

    def take(items: tuple[int, ...], times: int) -> None:
        fixed.append((items, times))
        for x in items:
            count[x] -= times
            if not count[x]:
                sizes.pop(bisect_left(sizes, x))

    def smallest(skip: int, n: int) -> list[int]:
        """Up to n smallest pieces, one of length skip apart."""
        out = []
        for x in sizes:
            out += [x] * min(n - len(out), count[x] - (x == skip))
            if len(out) >= n:
                break
        return out

    at = capacity + 1
    while sizes:
        i = bisect_left(sizes, at) - 1
        if i < 0:
            break
        x = at = sizes[i]
        room = capacity - x
        low = smallest(x, 3)
        if not low or low[0] > room:
            take((x,), count[x])
            continue
        j = bisect_left(sizes, room + 1) - 1
        if sizes[j] == x and count[x] < 2:
            j -= 1
        k = sizes[j]
        pair = k == room or len(low) < 2 or low[0] + low[1] > room
        if not pair and (len(low) < 3 or sum(low) > room):
            best = 0
            for a in sizes:
                b = bisect_left(sizes, room - a + 1) - 1
                while b >= 0 and count[sizes[b]] - (sizes[b] == x) - (a == sizes[b]) < 1:
                    b -= 1
                if count[a] - (a == x) >= 1 and b >= 0:
                    best = max(best, a + sizes[b])
            pair = k >= best
        if pair:
            take((x, k), count[x] // 2 if k == x else min(count[x], count[k]))
            at = x + 1
        # else: x stays for best fit; go on with the next smaller length
    return fixed


def best_fit(count: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best fit in descending order, equal lengths in bulk: (lengths of a sequence, how many such)."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[tuple, int]]] = {}

    def put(room: int, items: tuple, n: int) -> None:
        if n:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((items, n))

    for x in sorted((x for x, n in count.items() if n), reverse=True):
        left = count[x]
        while left:
            i = bisect_left(rooms, x)
            if i == len(rooms):
                room, items, n = capacity, (), left
            else:
                room = rooms[i]
                items, n = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(i)
            each = room // x
            whole = min(n, left // each)
            put(room - each * x, (items, x, each), whole)
            left -= whole * each
            n -= whole
            if left and n:
                put(room - left * x, (items, x, left), 1)
                left, n = 0, n - 1
            if items:
                put(room, items, n)

    def flat(items: tuple) -> list[int]:
        out = []
        while items:
            items, x, each = items
            out = [x] * each + out
        return out

    return [(flat(items), n) for all_ in groups.values() for items, n in all_]


def plan(count: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """length -> rows of (first rank, sequence of that rank, offset): rank r of a slot lies in sequence + r - first."""
    rest = {x: n for x, n in count.items() if n}
    bins = [*reduce(rest, capacity)]
    bins += best_fit(rest, capacity)
    ranks, slots, sequence = dict.fromkeys(count, 0), {}, 0
    for items, n in bins:
        offset = 0
        for x in items:
            slots.setdefault(x, []).append((ranks[x], sequence, offset))
            ranks[x] += n
            offset += x
        sequence += n
    return {x: np.array(s, np.int64) for x, s in slots.items()}


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items (task, place, length and more columns) with sequence_id and offset added.  Lengths are 1 to capacity."""
    per_task = items.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = settle(per_task.withColumn("base", F.coalesce(before, F.lit(0))), "bases")
    slots = plan({r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    ranked = items.join(base.select("task", "length", "base").hint("merge"), ["task", "length"]).withColumn("rank", F.col("base") + F.col("place")).drop("base")
    names = [c for c in items.columns]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema), "sequence_id long, offset long"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seq, off = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            lengths, rank = frame["length"].to_numpy(), frame["rank"].to_numpy()
            order = np.argsort(lengths, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
                s = slots[int(lengths[rows[0]])]
                at = np.searchsorted(s[:, 0], rank[rows], side="right") - 1
                seq[rows] = s[at, 1] + rank[rows] - s[at, 0]
                off[rows] = s[at, 2]
            yield frame[names].assign(sequence_id=seq, offset=off)

    return ranked.select(*names, "rank").mapInPandas(lean(run), schema)


def pack_documents(docs: DataFrame, tools: tuple[str, str, str], capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    cut = settle(pieces(docs, tools, capacity, end_id), "pieces")
    return pack(cut, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
