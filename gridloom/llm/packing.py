"""Best-fit packing of documents into sequences of at most ``capacity`` tokens.

Tokenising gives one short row per piece; packing moves these rows only. Pieces are dealt into groups of bounded size and of one mix of lengths, each group is packed by
best-fit decreasing and improved by a swap-based local search; what is left underfull in all groups is dealt and packed again, in
rounds that end when they save nothing. So no task holds more than about ``group_size`` pieces, and the loss is a few bins for each group of the last round.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import blocks, materialise, text_buffer
from .tokens import coder


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each document into the fullest bin that has room. A bit for each amount of free room that some bin has
    finds that bin at once. Returns the documents' indices by bin."""
    bins: list[list[int]] = []
    free: dict[int, list[int]] = {}
    mask = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, at = capacity, len(bins)
            bins.append([])
        bins[at].append(i)
        room -= size
        free.setdefault(room, []).append(at)
        mask |= 1 << room
    return bins


class Bin:
    """Documents as (size, index), sorted."""

    def __init__(self, docs):
        self.docs = sorted(docs)
        self.fill = sum(s for s, _ in self.docs)

    def take(self, doc):
        self.docs.remove(doc)
        self.fill -= doc[0]

    def put(self, doc):
        insort(self.docs, doc)
        self.fill += doc[0]


def _exchange(a: Bin, b: Bin, room: int):
    """What a gives b and what b gives back, so that b gains most within its room: a move, one for one, or two for one. None if nothing gains."""
    best, plan = 0, None
    k = bisect_right(a.docs, (room, 1 << 62))
    if k:
        best, plan = a.docs[k - 1][0], ([a.docs[k - 1]], None)
    for back in b.docs if best < room else ():
        most = back[0] + room
        k = bisect_right(a.docs, (most, 1 << 62))
        if k and a.docs[k - 1][0] - back[0] > best:
            best, plan = a.docs[k - 1][0] - back[0], ([a.docs[k - 1]], back)
        low, high = 0, len(a.docs) - 1
        while low < high:  # the two of a whose sum is largest within most
            both = a.docs[low][0] + a.docs[high][0]
            if both > most:
                high -= 1
            else:
                if both - back[0] > best:
                    best, plan = both - back[0], ([a.docs[low], a.docs[high]], back)
                low += 1
        if best == room:
            break
    return plan


def local_search(sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Takes the emptiest bin and pours it into fuller ones by moves and exchanges that raise the sum of squared fills, until it is
    empty or none of all underfull bins gains; then the next. Ends at the least possible number of bins.

    Bins that get full leave the search. What the source can give (a document, or two for one) is marked by size; a document that stands in a bin
    with some free room can be exchanged where a mark lies above its size by no more than that room. So one pass over sizes and rooms finds every bin that gains."""
    full = [b for b in bins if sum(sizes[i] for i in b) == capacity]
    every = [Bin((sizes[i], i) for i in b) for b in bins if sum(sizes[i] for i in b) < capacity]
    least = -(-sum(sizes) // capacity)
    fill = np.array([b.fill for b in every], np.int64)
    size, at = np.array(sizes, np.int64), np.full(len(sizes), len(every))  # the last place: documents of full bins
    for k, b in enumerate(every):
        at[[i for _, i in b.docs]] = k
    mine = np.flatnonzero(at < len(every))
    work, count, emptied = set(range(len(every))), len(bins), set()

    def gaining(source: int) -> list[int]:
        own = np.unique([s for s, _ in every[source].docs])
        given = np.zeros(3 * capacity + 1, np.int32)
        given[own] = 1
        given[np.add.outer(own, own).ravel()] = 1
        given = np.cumsum(given)
        room = np.where(fill >= fill[source], capacity - fill, 0)
        room[source] = 0
        y, r = size[mine], room[at[mine]]
        hit = room >= own[0]
        hit[at[mine[given[y + r] > given[y]]]] = True
        hit[room == 0] = False
        found = np.flatnonzero(hit)
        return found[np.argsort(-fill[found], kind="stable")].tolist()

    while work and count > least:
        source = min(work, key=lambda k: (fill[k], k))
        work.discard(source)
        a, gained = every[source], True
        while gained and a.docs:
            gained = False
            for k in gaining(source):
                b = every[k]
                while a.docs and a.fill <= b.fill < capacity and (plan := _exchange(a, b, capacity - b.fill)):
                    for doc in plan[0]:
                        a.take(doc)
                        b.put(doc)
                        at[doc[1]] = k
                    if plan[1]:
                        b.take(plan[1])
                        a.put(plan[1])
                        at[plan[1][1]] = source
                    gained = True
                fill[k], fill[source] = b.fill, a.fill
                if b.fill == capacity:
                    work.discard(k)
                if not a.docs:
                    break
        if not a.docs:
            emptied.add(source)
            fill[source] = capacity  # no candidate any more
            count -= 1
    return full + [[i for _, i in b.docs] for k, b in enumerate(every) if k not in emptied]


def pack(sizes: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, fill of the bin) of each size."""
    place, offset, fill = (np.zeros(len(sizes), np.int64) for _ in range(3))
    for k, docs in enumerate(local_search(sizes, best_fit(sizes, capacity), capacity)):
        at = 0
        for i in docs:
            place[i], offset[i] = k, at
            at += sizes[i]
        fill[docs] = at
    return place, offset, fill


def token_pieces(docs: DataFrame, tokenizer: str, kind: str, end: int, capacity: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: row (unique), doc_id, piece, start, length, ids_crc32. A document is its ids and ``end``; one that is longer
    than ``capacity`` is cut into pieces of that length and a rest. Null texts are empty; null ids stay null."""
    fields = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches):
        code, row = coder(tokenizer, kind), TaskContext.get().partitionId() << 40
        for batch in blocks(batches, "text"):
            ids, offsets = code(*text_buffer(batch.column("text")), end)
            raw, rows = memoryview(ids.tobytes()), []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                for k, x in enumerate(range(a, b, capacity)):
                    y = min(b, x + capacity)
                    rows.append((row, doc, k, x - a, y - x, zlib.crc32(raw[4 * x : 4 * y])))
                    row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), fields.types)], schema=fields)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, "row long, doc_id long, piece int, start long, length long, ids_crc32 long")


def dealt(pieces: DataFrame, groups: int, seed: int, buckets: int = 1024) -> DataFrame:
    """row, length and group: pieces are numbered in the order of their lengths and dealt round, so every group gets the same mix of lengths. Numbers within a length
    are made in ``buckets`` by a hash, as one length may have a large share of all pieces; windows beyond that see counts only."""
    known = pieces.select("row", "length", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(buckets)).alias("bucket"))
    if groups == 1:
        return known.select("row", "length", F.lit(0).cast("long").alias("group"))
    counts = known.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("k"))
    lengths = counts.groupBy("length").agg(F.sum("k").alias("k"))  # a row for each length: the capacity at most
    shorter = lengths.select("length", (F.sum("k").over(Window.orderBy("length")) - F.col("k")).alias("shorter"))
    base = counts.withColumn("lower", F.sum("k").over(Window.partitionBy("length").orderBy("bucket")) - F.col("k")).join(shorter, "length")
    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row"))
    number = F.col("shorter") + F.col("lower") + F.col("nth")
    return known.withColumn("nth", nth).join(base.drop("k"), ["length", "bucket"]).select("row", "length", F.pmod(number, F.lit(groups)).alias("group"))


def pack_pieces(pieces: DataFrame, capacity: int = 4096, group_size: int = 50_000, underfull: float = 0.995) -> DataFrame:
    """Adds sequence_id and offset to materialised ``pieces`` (columns row, length, and others that pass through).

    Pieces of full length are sequences of their own. The rest is dealt into groups that have the same mix of lengths, each of about ``group_size`` pieces. The pieces of bins of
    less than ``underfull`` of the capacity are dealt and packed again, until they make one group or a round saves no bin. Empty tables stay empty; lengths must be 1 to ``capacity``.
    """

    def packer(key, rows):
        rows = rows.sort_values("row")  # the same result from the same group, whatever order it comes in
        place, offset, fill = pack(rows["length"].tolist(), capacity)
        return pd.DataFrame({"row": rows["row"], "length": rows["length"], "bin": place + (int(key[0]) << 24), "offset": offset, "fill": fill})

    schema = "row long, length long, bin long, offset long, fill long"
    short = pieces.where(F.col("length") < capacity)
    left, done, bins, nth = short.select("row", "length"), None, None, 0
    last = None
    while True:
        groups = max(1, -(-left.count() // group_size))
        nth += 1
        packed = materialise(dealt(left, groups, nth).groupBy("group").applyInPandas(packer, schema).withColumn("nth", F.lit(nth)), "packed")
        low = packed.where(F.col("fill") < underfull * capacity)
        used = packed.select("bin").distinct().count()
        if bins is not None and used >= bins:
            packed, low = last, None  # the round before was as good
        good = packed if groups == 1 or low is None else packed.where(F.col("fill") >= underfull * capacity)
        done = good if done is None else done.unionByName(good)
        if groups == 1 or low is None:
            break
        left, last, bins = low.select("row", "length"), low, low.select("bin").distinct().count()
    ids = done.select("row", (F.col("bin") * 4096 + F.col("nth")).alias("sequence_id"), "offset")
    alone = pieces.where(F.col("length") >= capacity).select("*", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return short.join(ids, "row").unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer: str, kind: str = "word", end: int = 1, capacity: int = 4096) -> DataFrame:
    """op5's rows: doc_id, piece, start, length, ids_crc32, sequence_id, offset. See ``token_pieces`` and ``pack_pieces``."""
    pieces = materialise(token_pieces(docs, tokenizer, kind, end, capacity), "pieces")
    return pack_pieces(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
