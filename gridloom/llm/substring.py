"""Removal of long repeats by recompression.

Every document's words are renamed in rounds. A round replaces pairs of adjacent symbols (left and right symbols are told apart by a bit
of their name) and then maximal runs of one symbol by new symbols. A new symbol's name is a 64-bit function of its parts' names, so names are global
without a dictionary: equal strings get equal symbols in every document and task, except near their ends, where the neighbourhood decides.
For each symbol the range of words that decides its existence is tracked. A window of ``window`` words thus knows which symbols exist
wherever the window stands; it picks one, its anchor: of the class of most bytes, that of greatest name. Equal windows pick equal anchors, so a window whose anchor
occurs in one document only repeats nowhere else. (A window in which no symbol is certain, as inside a run, picks a word.)

Spark then works on anchors. Neighbouring windows with one anchor form a context, of which a row (anchor, hash of its words, document, place) is made: about one for every five words.
1. Per anchor: least and greatest document and context. Anchors of one document are done. Others are joined to their rows.
2. An equal context in a smaller document settles all of its windows. Only where an anchor has different contexts are windows compared
   themselves, once for each distinct context.
Contexts are compared on anchor and hash, 128 bits; windows on two hashes of 64 and 32 bits of their own. Words themselves are not compared: among the 4 * 10^12 contexts of 100 TB, two that
differ agree with a chance of about 2 in 10^14; among 10^11 windows that need a comparison of their own, with one of about 6 in 10^8.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import blocks, discard, likely, materialise, ragged, release, text_buffer
from .segments import BLANKS, Prefix, hash_segments, mix, word_ranges

FAR = 1 << 20
ROUNDS = 3
#: Symbols of so many bytes are of a higher class: rarer. Those decided by more than REACH words are certain in few windows and not used.
CLASSES, REACH = (10, 18), 9


def recompress(names: np.ndarray, doc: np.ndarray, window: int, rounds: int = ROUNDS):
    """Symbols that some window of ``window`` words is certain of: (name, start, end, first and last + 1 word that decide)."""
    start = np.arange(len(names))
    end, lo, hi, name = start + 1, start.copy(), start + 1, names
    found = []
    for level in range(rounds):
        if len(name) < 2:
            break
        # pairs: a left symbol before a right one
        right = (mix(name ^ np.uint64(0x51ED270B * (level + 1))) >> np.uint64(63)).astype(bool)
        near = doc[1:] == doc[:-1]
        pair = near & ~right[:-1] & right[1:]
        at = np.flatnonzero(pair)
        after_hi = np.append(np.where(near, hi[1:], end[:-1] + FAR), end[-1] + FAR)
        before_lo = np.append(start[0] - FAR, np.where(near, lo[:-1], start[1:] - FAR))
        paired_first, paired_second = np.append(pair, False), np.append(False, pair)
        new_hi = np.where(right, hi, np.maximum(hi, after_hi))  # a left symbol stays alone because of what follows
        new_lo = np.where(right, np.minimum(lo, before_lo), lo)
        new_lo[at], new_hi[at] = np.minimum(lo[at], lo[at + 1]), np.maximum(hi[at], hi[at + 1])
        new_name, new_end = name.copy(), end.copy()
        new_name[at] = mix(name[at] * np.uint64(0x9E3779B97F4A7C15) + name[at + 1] + np.uint64(level))
        new_end[at] = end[at + 1]
        good = at[new_hi[at] - new_lo[at] <= window]
        found.append((new_name[good], start[good], new_end[good], new_lo[good], new_hi[good]))
        keep = ~paired_second
        name, start, end, lo, hi, doc = new_name[keep], start[keep], new_end[keep], new_lo[keep], new_hi[keep], doc[keep]
        # maximal runs of one symbol
        near = doc[1:] == doc[:-1]
        head = np.append(True, ~(near & (name[1:] == name[:-1])))
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(name)) - 1
        before = np.append(start[0] - FAR, np.where(near, lo[:-1], start[1:] - FAR))[first]
        after = np.append(np.where(near, hi[1:], end[:-1] + FAR), end[-1] + FAR)[last]
        count = (last - first + 1).astype(np.uint64)
        run = count > 1
        name = np.where(run, mix(name[first] ^ (count * np.uint64(0xC2B2AE3D27D4EB4F))), name[first])
        start, end, doc = start[first], end[last], doc[first]
        lo, hi = np.minimum(lo[first], before), np.maximum(hi[last], after)
        good = run & (hi - lo <= window)
        found.append((name[good], start[good], end[good], lo[good], hi[good]))
    return [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * 4


def contexts(names: np.ndarray, other: np.ndarray, size: np.ndarray, first: np.ndarray, window: int):
    """``names``, ``other``, ``size``: two hashes and the bytes of each word. (anchor, hash of the context's words, document, first window, number of windows) of each context."""
    n = len(names)
    lengths = np.diff(first)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    fits = np.zeros(n, bool)
    fits[ragged(first[:-1], np.maximum(lengths - window + 1, 0))] = True
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not fits.any():
        return none
    name, start, end, lo, hi = recompress(names, doc, min(window, REACH))
    before = np.append(0, np.cumsum(size))
    key = (np.digitize(before[end] - before[start], CLASSES).astype(np.uint64) << np.uint64(60)) | (mix(name) >> np.uint64(4)) | np.uint64(1)
    best, place = np.zeros(n, np.uint64), np.full(n, FAR * 4096, np.int64)
    spans = []
    for k in range(window - 1):  # windows that hold the whole range lo to hi start at hi - window ... lo
        at = hi - window + k
        ok = np.flatnonzero((at <= lo) & (at >= 0))
        ok = ok[fits[at[ok]]]
        spans.append((at[ok], ok))
        np.maximum.at(best, at[ok], key[ok])
    for at, ok in spans:
        mine = best[at] == key[ok]
        np.minimum.at(place, at[mine], start[ok[mine]])
    bare = np.flatnonzero(fits & (best == 0))
    if len(bare):
        best[bare], place[bare] = names[bare[:, None] + np.arange(window)].max(1) >> np.uint64(4), -1
    at = np.flatnonzero(fits)
    new = np.append(True, (at[1:] != at[:-1] + 1) | (best[at[1:]] != best[at[:-1]]) | (place[at[1:]] != place[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]]))
    s0 = at[new]
    count = np.diff(np.append(np.flatnonzero(new), len(at)))
    return mix(best[s0]), Prefix(other, 1).hash(s0, s0 + count + window - 1), doc[s0], s0, count


def words_of(column) -> tuple:
    """(bytes, first byte and end of each word, first word of each document and the end)."""
    data, offsets = text_buffer(column)
    return data, *word_ranges(data, offsets, BLANKS)


def _rows(docs: DataFrame, window: int) -> DataFrame:
    fields = pa.schema([("a", pa.int64()), ("c", pa.int64()), ("doc", pa.int64()), ("s", pa.int32()), ("k", pa.int32())])

    def run(batches):
        for batch in blocks(batches, "text"):
            data, starts, ends, first = words_of(batch.column("text"))
            if len(starts) < window:
                continue
            a, c, d, s, k = contexts(*hash_segments(data, starts, ends), ends - starts, first, window)
            ids = batch.column("doc").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(ids[d]), pa.array((s - first[d]).astype(np.int32)), pa.array(k.astype(np.int32))], schema=fields)

    return docs.mapInArrow(run, "a long, c long, doc long, s int, k int")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """Two hashes (of 64 and 32 bits) of each window of the contexts listed in ``spots`` (structs s, k)."""
    fields = pa.schema([("w1", pa.int64()), ("w2", pa.int32()), ("doc", pa.int64()), ("s", pa.int32())])

    def run(batches):
        for batch in blocks(batches, "text"):
            data, starts, ends, first = words_of(batch.column("text"))
            h1, h2 = hash_segments(data, starts, ends)
            spots = batch.column("spots")
            flat = spots.flatten()
            n = np.diff(spots.offsets.to_numpy())
            d = np.repeat(np.arange(batch.num_rows), n)
            s, k = flat.field("s").to_numpy().astype(np.int64), flat.field("k").to_numpy().astype(np.int64)
            at = ragged(s + first[d], k)
            w1, w2 = Prefix(h1, 0).hash(at, at + window), Prefix(h2, 1).hash(at, at + window)
            d = np.repeat(d, k)
            yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array((w2 >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(batch.column("doc").to_numpy()[d]), pa.array((at - first[d]).astype(np.int32))], schema=fields)

    return docs.mapInArrow(run, "w1 long, w2 int, doc long, s int")


def repeated_ranges(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc, ranges: array of structs s, k): windows s ... s+k-1 of a document that also start in a document with a smaller id.

    ``docs`` has doc (long, not null) and text. Documents without such windows have no row.
    """
    spark = docs.sparkSession
    rows = materialise(_rows(docs, window), "contexts")
    shared = materialise(
        rows.groupBy("a").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.min("c").alias("c0"), F.max("c").alias("c1"))
        .where("least < most").select("a", "least", (F.col("c0") != F.col("c1")).alias("varied")), "anchors"
    )
    release(spark)
    kept = materialise(likely(rows, "a", shared).join(shared, "a"), "shared-contexts")
    discard(rows, shared)
    plain = kept.where(~F.col("varied") & (F.col("doc") > F.col("least"))).select("doc", "s", "k")
    varied = kept.where("varied").drop("least")
    least = varied.groupBy("a", "c").agg(F.min("doc").alias("least"))
    owned = materialise(varied.join(least, ["a", "c"]).select("doc", "s", "k", (F.col("doc") > F.col("least")).alias("late")), "owned-contexts")
    copies = owned.where("late").select("doc", "s", "k")
    spots = owned.where(~F.col("late")).groupBy("doc").agg(F.collect_list(F.struct(F.col("s"), F.col("k"))).alias("spots"))
    texts = likely(docs.select("doc", "text"), "doc", owned.where(~F.col("late")).select("doc"))
    windows = materialise(_windows(texts.join(spots, "doc"), window), "windows")
    release(spark)
    first = materialise(windows.groupBy("w1", "w2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most"), "windows-least")
    release(spark)
    late = likely(windows, "w1", first).join(first, ["w1", "w2"]).where("doc > least").select("doc", "s", F.lit(1).alias("k"))
    every = plain.unionByName(copies).unionByName(late)
    ranges = materialise(every.groupBy("doc").agg(F.collect_list(F.struct("s", "k")).alias("ranges")), "repeats")
    discard(kept, owned, windows, first)
    return ranges


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text: str = "text", prefix: str = "") -> DataFrame:
    """All rows of ``docs`` with columns n_words, n_removed and kept (the words that stay, joined by one space) added, their names after ``prefix``. Columns of ``docs`` with these names are replaced;
    all others pass through.

    A word goes when a window of ``window`` words covers it whose word sequence also starts in a document with a smaller id, judged on
    the input. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null or short texts lose nothing; repeats within a document stay. A null id counts as the smallest
    integer; rows that share an id are judged alike against smaller ids, not against each other.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    named = docs.select(key.alias("doc"), F.col(text).cast("string").alias("text"))
    ranges = repeated_ranges(named, window)
    added = [f"{prefix}{c}" for c in ("n_words", "n_removed", "kept")]
    kept_fields = [f for f in docs.schema if f.name not in added]
    spans = ranges.select(F.col("doc").alias("__join_doc"), F.col("ranges").alias("__join_ranges"))
    joined = docs.select(*(F.col(f"`{f.name}`") for f in kept_fields), key.alias("__join_key")).join(spans, F.col("__join_key") == F.col("__join_doc"), "left").drop("__join_key", "__join_doc")

    def run(batches):
        for batch in blocks(batches, text):
            data, starts, ends, first = words_of(batch.column(text))
            spots = batch.column("__join_ranges")
            flat, counts = spots.flatten(), np.asarray(spots.value_lengths().fill_null(0))
            d = np.repeat(np.arange(batch.num_rows), counts)
            s, k = flat.field("s").to_numpy().astype(np.int64) + first[d], flat.field("k").to_numpy().astype(np.int64)
            # rows that repeat an id may be shorter than the one whose windows were listed
            stop = np.minimum(s + k + window - 1, first[d + 1])
            ok = s + window <= first[d + 1]
            change = np.zeros(len(starts) + 1, np.int64)
            np.add.at(change, s[ok], 1)
            np.add.at(change, stop[ok], -1)
            stays = np.cumsum(change[:-1]) == 0
            total = np.append(0, np.cumsum(stays))[first]
            at = np.flatnonzero(stays)
            lengths = (ends - starts)[at] + 1
            out = np.full(int(lengths.sum()), 32, np.uint8)
            where = np.cumsum(lengths) - lengths
            out[ragged(where, lengths - 1)] = data[ragged(starts[at], lengths - 1)]
            cut = np.append(where, len(out))[total]
            raw = out.tobytes()
            texts = [raw[a : b - 1] if b > a else b"" for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            n_words, n_kept = np.diff(first), np.diff(total)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept_fields), pa.array(n_words), pa.array(n_words - n_kept), pa.array(texts, pa.binary()).cast(pa.string())], [*(f.name for f in kept_fields), *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept_fields)
    return joined.mapInArrow(run, f"{schema}, `{added[0]}` long, `{added[1]}` long, `{added[2]}` string")


def substring_dedup(docs: DataFrame, window: int = 13) -> DataFrame:
    """op3's rows: doc_id, n_words, n_removed, kept_sha256."""
    done = remove_repeats(docs.select("doc_id", F.col("text").cast("string").alias("text")), window)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
