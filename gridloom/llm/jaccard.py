"""N-gram Jaccard join: documents whose sets of word n-grams overlap by at least a threshold, their components and numbers of links.

Sets that are equal are one set from the start, so copies cost nothing. Two kinds of relations between sets then save work.

*Lists skipped by position.* A set's prefix (the part that a similar set must share something of) is taken in one global order: n-grams of few documents
first, by the sums of ``CELLS`` counters over all sets; else n-grams that dozens of documents have by chance would chain unrelated sets together. An index list has
the sets of one prefix n-gram with their sizes and the n-gram's positions in them, ordered by position, in blocks of ``BLOCK`` rows. What two sets can share at
most follows from sizes and positions, so a whole block is skipped where its ranges of sizes and positions leave too little. A pair goes on if it shares as many
n-grams of the two prefixes as a pair of these sizes must; only such pairs are compared.

*Answers derived from a similar set.* Sets that meet in a list of more than ``LONG`` rows form a group (near copies, mostly). A group gets a reference set: the
n-grams that most of a sample of its sets have. Each set is compared with the reference once, and is known by its difference from there on: two sets of differences
D and E differ in ``|D| + |E| - 2 |D and E|`` n-grams. So the set nearest to the reference links to all whose differences are small enough without any
comparison, and the others' links follow from the n-grams that their differences have in common. The reference decides how much that costs, never the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import blocks, discard, likely, materialise, ragged, release, text_buffer
from .segments import BLANKS, LOWER, Prefix, hash_segments, mix, word_ranges

#: Lists of more sets than this are long: their sets form groups.
LONG = 32
#: Rows of a list that are skipped together.
BLOCK = 8
#: Sets of a group that are compared in one task with as many others.
TASK = 1024
#: Sets of a group that make its reference.
SAMPLE = 16
#: Cells that n-grams are counted in, by the first bits of their hashes, and parts in which the counts travel. Cells bound the broadcast (2 bytes each); the order decides cost only.
CELLS, PARTS = 1 << 23, 16
#: N-grams in cells of so many are dealt to several tasks when lists are made, by ``DEALT``.
GATHER, DEALT = 50_000, 4096
#: N-grams that are counted together in a task.
COUNTED = 2_000_000
#: Text that is held at once.
HELD = 1 << 20


def sets(column, n: int):
    """The sorted distinct hashes of each text's n-grams. Texts of fewer words are one n-gram; without words, empty."""
    data, offsets = text_buffer(column)
    data = LOWER[data]
    starts, ends, first = word_ranges(data, offsets, BLANKS)
    names = hash_segments(data, starts, ends, both=False)
    prefix = Prefix(names, 0)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        at = np.arange(a, max(b - n, a) + 1 if b > a else a)
        out.append(np.unique(prefix.hash(at, np.minimum(at + n, b))))
    return out


def digests(each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    one, two = np.zeros(len(each), np.uint64), np.zeros(len(each), np.uint64)
    for i, s in enumerate(each):
        one[i] = mix(s).sum(dtype=np.uint64) + np.uint64(len(s))
        two[i] = np.bitwise_xor.reduce(mix(s ^ np.uint64(0x9E3779B97F4A7C15))) if len(s) else 0
    return mix(one), mix(two + np.uint64(1))


def _up(a, b):
    """a / b, rounded up."""
    return -(-a // b)


def least_shared(a, b, percent: int):
    """N-grams that two sets of these sizes must share to be linked."""
    return _up(percent * (a + b), 100 + percent)


def least_in_prefixes(small, large, percent: int):
    """How many of them lie in both prefixes at least: no set has more than ``percent`` of its size, rounded up and less one, behind its prefix."""
    return least_shared(small, large, percent) - _up(percent * large, 100) + 1


def add_counts(cells: np.ndarray, ordered: np.ndarray) -> None:
    """Counts sorted n-grams in ``cells``; a count stops at 65,535."""
    at = cell_of(ordered, len(cells))
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
    at, count = at[first], np.diff(np.append(first, len(at)))
    cells[at] = np.minimum(cells[at] + count, 65_535)


def cell_of(grams: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each n-gram; ``cells`` is a power of two."""
    return (grams >> np.uint64(65 - cells.bit_length())).astype(np.int64)


def _summary(docs: DataFrame, n: int) -> DataFrame:
    """A row of each document (its set's size and digests), and rows (part, cells) of how many n-grams of a task's sets are in each cell."""
    fields = pa.schema([("row", pa.int64()), ("doc", pa.int64()), ("n", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("mark", pa.int64()), ("part", pa.int32()), ("cells", pa.binary())])
    total, parts = CELLS, PARTS

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        held, size, cells = np.zeros(COUNTED, np.uint64), 0, np.zeros(total, np.uint16)

        def counted():
            here = held[:size]
            here.sort()
            add_counts(cells, here)

        for batch in blocks(batches, "text", HELD):
            each = sets(batch.column("text"), n)
            one, two = digests(each)
            k = len(each)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + k)), batch.column("doc"), pa.array([len(s) for s in each], pa.int32()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), batch.column("mark"), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=fields)
            row += k
            for s in each:
                while len(s):
                    part, s = s[: COUNTED - size], s[COUNTED - size :]
                    held[size : size + len(part)] = part
                    size += len(part)
                    if size == COUNTED:
                        counted()
                        size = 0
        counted()
        for k, part in enumerate(np.split(cells, parts)):
            if part.any():
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(fields)[:6]), pa.array([k], pa.int32()), pa.array([pa.compress(part.tobytes(), "zstd", asbytes=True)])], schema=fields)

    return docs.mapInArrow(run, "row long, doc long, n int, d1 long, d2 long, mark long, part int, cells binary")


def _counts(parts: DataFrame) -> np.ndarray:
    """The sum of all tasks' cells. The driver gets 2 bytes for each cell at most."""
    fields, size = pa.schema([("part", pa.int32()), ("cells", pa.binary())]), CELLS // PARTS

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column("part").to_pylist(), batch.column("cells")):
                here = np.frombuffer(pa.decompress(packed.as_buffer(), size * 2, "zstd"), np.uint16)
                found[k] = np.minimum(here + found.get(k, np.zeros(size, np.int64)), 65_535)
        for k, sums in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pa.compress(sums.astype(np.uint16).tobytes(), "zstd", asbytes=True)])], schema=fields)

    cells = np.zeros((PARTS, size), np.uint16)
    for row in parts.repartition(PARTS, "part").mapInArrow(run, "part int, cells binary").toLocalIterator():
        cells[row["part"]] = np.frombuffer(pa.decompress(bytes(row["cells"]), size * 2, "zstd"), np.uint16)
    return cells.reshape(-1)


def _prefixes(docs: DataFrame, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(gram, salt, d1, d2, n, at) of each prefix: ``at`` is the n-gram's place in its set, ``salt`` deals the n-grams of very many documents."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)  # CELLS entries
    fields = pa.schema([("gram", pa.int64()), ("salt", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("n", pa.int32()), ("at", pa.int32())])

    def run(batches):
        counts = sent.value
        seen: set[int] = set()
        for batch in blocks(batches, "text", HELD):
            each = sets(batch.column("text"), n)
            one, two = digests(each)
            out = []
            for i, s in enumerate(each):
                if not len(s) or int(one[i]) in seen:
                    continue
                seen.add(int(one[i]))
                length = len(s) - _up(percent * len(s), 100) + 1
                count = counts[cell_of(s, len(counts))]
                pick = np.argsort(count, kind="stable")[:length]
                salt = np.where(count[pick] >= GATHER, int(one[i]) % DEALT + 1, 0).astype(np.int32)
                out.append((s[pick], salt, i, len(s)))
            if len(seen) > 500_000:
                seen.clear()
            if out:
                lengths = np.array([len(x[0]) for x in out])
                who, size = np.repeat([x[2] for x in out], lengths), np.array([len(each[x[2]]) for x in out], np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([x[0] for x in out]).view(np.int64)), pa.array(np.concatenate([x[1] for x in out])), pa.array(one[who].view(np.int64)), pa.array(two[who].view(np.int64)),
                    pa.array(np.repeat(size, lengths)), pa.array(ragged(np.zeros(len(out), np.int64), lengths).astype(np.int32))], schema=fields)

    return docs.mapInArrow(run, "gram long, salt int, d1 long, d2 long, n int, at int")


def list_pairs(gram: np.ndarray, row: np.ndarray, n: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of rows of one list that sizes and positions allow. Rows are ordered by list, then position. Each row meets the blocks that
    begin behind it in its list; a block goes on only where its ranges of sizes and positions can hold a partner."""
    k = len(gram)
    none = np.zeros(0, np.int64)
    if k < 2:
        return none, none
    begins = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    length = np.diff(np.append(begins, k))
    first = np.concatenate([ragged(np.zeros(len(length), np.int64), _up(length, BLOCK)) * BLOCK + np.repeat(begins, _up(length, BLOCK))])
    end = np.minimum(first + BLOCK, np.repeat(begins + length, _up(length, BLOCK)))
    low, high = np.minimum.reduceat(n, first), np.maximum.reduceat(n, first)
    near, far = at[first], at[end - 1]
    before = np.append(0, np.cumsum(_up(length, BLOCK)))[:-1]  # the first block of each list
    of = np.repeat(np.arange(len(begins)), length)
    own = before[of] + (np.arange(k) - begins[of]) // BLOCK
    last = (before + _up(length, BLOCK))[of]
    i = np.repeat(np.arange(k), last - own)
    b = ragged(own, last - own)
    partner = np.maximum(low[b], _up(percent * n[i], 100))
    most = np.minimum(at[i], far[b]) + 1 + np.minimum(n[i] - at[i] - 1, high[b] - near[b] - 1)
    ok = (100 * high[b] >= percent * n[i]) & (100 * n[i] >= percent * low[b]) & (most >= least_shared(n[i], partner, percent))
    i, b = i[ok], b[ok]
    width = end[b] - first[b]
    i, j = np.repeat(i, width), ragged(first[b], width)
    small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    most = np.minimum(at[i], at[j]) + 1 + np.minimum(n[i] - at[i], n[j] - at[j]) - 1
    ok = (j > i) & (row[i] != row[j]) & (100 * small >= percent * large) & (most >= least_shared(small, large, percent))
    return i[ok], j[ok]


def _short_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """``lists``: gram, row, n, at. Pairs (x > y, with nx and ny) that share enough of their prefixes."""
    fields = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("nx", pa.int32()), ("ny", pa.int32())])

    def run(batches):
        rest = None
        columns = ("gram", "row", "n", "at")

        def pairs(part):
            gram, row, n, at = part
            i, j = list_pairs(gram, row, n.astype(np.int64), at.astype(np.int64), percent)
            i, j = np.where(row[i] > row[j], i, j), np.where(row[i] > row[j], j, i)
            return pa.RecordBatch.from_arrays([pa.array(row[i]), pa.array(row[j]), pa.array(n[i]), pa.array(n[j])], schema=fields)

        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            if rest is not None:
                now = [np.concatenate([a, b]) for a, b in zip(rest, now)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last list may go on
            if cut:
                yield pairs([c[:cut] for c in now])
            rest = [c[cut:] for c in now]
        if rest is not None:
            yield pairs(rest)

    found = lists.repartition("gram").sortWithinPartitions("gram", "at", "row").mapInArrow(run, "x long, y long, nx int, ny int")
    small, large = F.least("nx", "ny"), F.greatest("nx", "ny")
    up = lambda a, b: F.ceil(a / F.lit(float(b)))  # noqa: E731  exact: the operands are far below 2^53 and a quotient rounds to no whole number that it isn't
    least = up(percent * (small + large), 100 + percent) - up(percent * large, 100) + 1
    return found.groupBy("x", "y", "nx", "ny").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)


def _whole(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(row, n, grams, grouped) of the sets ``wanted`` (row, doc, d1, d2, grouped), made again from the texts. A filter of fixed size keeps other documents from being moved."""
    fields = pa.schema([("row", pa.int64()), ("n", pa.int32()), ("grams", pa.list_(pa.int64())), ("grouped", pa.int32())])

    def run(batches):
        seen: set[int] = set()  # an id may occur in several equal rows
        for batch in blocks(batches, "text", HELD):
            each = sets(batch.column("text"), n)
            one, two = digests(each)
            same = (one.view(np.int64) == batch.column("d1").to_numpy()) & (two.view(np.int64) == batch.column("d2").to_numpy())
            rows, at = batch.column("row").to_numpy(), []
            for i in np.flatnonzero(same).tolist():
                if int(rows[i]) not in seen:
                    seen.add(int(rows[i]))
                    at.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(rows[at]), pa.array([len(each[i]) for i in at], pa.int32()), pa.array([each[i].view(np.int64) for i in at], pa.list_(pa.int64())), batch.column("grouped").take(pa.array(at, pa.int32()))], schema=fields)

    return likely(docs, "doc", wanted).join(wanted, "doc").select("row", "d1", "d2", "grouped", "text").mapInArrow(run, "row long, n int, grams array<bigint>, grouped int")


def compare(left: pd.DataFrame, right: pd.DataFrame, percent: int, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links (i of ``left``, j of ``right``) among sets known by their differences (``weight``, ``diff``) from one reference. Postings of what differs give the shared differences.
    Without ``every``, links that join what is joined already are left out."""
    rows, other = left["row"].to_numpy(), right["row"].to_numpy()
    weight, more, own = left["weight"].to_numpy(), right["weight"].to_numpy(), left["component"].to_numpy()
    if not len(rows) or not len(other):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.array([len(d) for d in right["diff"]])
    grams = np.concatenate(right["diff"].to_list()) if lengths.sum() else np.zeros(0, np.int64)
    order = np.argsort(grams, kind="stable")
    grams, holder = grams[order], np.repeat(np.arange(len(other)), lengths)[order]
    component, up = right["component"].to_numpy(), {}

    def root(c):
        while c in up:
            c = up[c]
        return c

    xs, ys = [], []
    for i, d in enumerate(left["diff"]):
        a, b = np.searchsorted(grams, d, "left"), np.searchsorted(grams, d, "right")
        common = np.bincount(holder[ragged(a, b - a)], minlength=len(other))
        hit = np.flatnonzero((weight[i] + more + 2 * (100 + percent) * common >= 0) & (other != rows[i]))
        if not every:
            kept = []
            for c, j in zip(*(a.tolist() for a in np.unique(component[hit], return_index=True))):
                x, y = root(int(own[i])), root(c)
                if x != y:
                    up[x] = y
                    kept.append(hit[j])
            hit = np.array(kept, np.int64)
        xs.append(np.full(len(hit), i))
        ys.append(hit)
    return np.concatenate(xs), np.concatenate(ys)


def _group_links(members: DataFrame, whole: DataFrame, percent: int, every: bool) -> DataFrame:
    """Links (u, v) inside the groups of ``members`` (row, n, group): all of them with ``every``, else enough to hold every component together."""
    order = Window.partitionBy("group").orderBy(F.xxhash64("row"))
    sample = members.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SAMPLE).select("group", "row")
    size = sample.groupBy("group").agg(F.count(F.lit(1)).alias("sampled"))
    grams = sample.join(whole.select("row", "grams"), "row").select("group", F.explode("grams").alias("gram")).groupBy("group", "gram").agg(F.count(F.lit(1)).alias("k"))
    reference = materialise(grams.join(size, "group").where(F.col("k") * 2 > F.col("sampled")).groupBy("group").agg(F.collect_list("gram").alias("reference")), "references")
    fields = pa.schema([("group", pa.int64()), ("row", pa.int64()), ("weight", pa.int64()), ("diff", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            diffs, n = [], batch.column("n").to_numpy().astype(np.int64)
            for s, r in zip(batch.column("grams"), batch.column("reference")):
                there = r.values.to_numpy(zero_copy_only=False) if r.is_valid else np.zeros(0, np.int64)
                diffs.append(np.setxor1d(s.values.to_numpy(zero_copy_only=False), there, assume_unique=True))
            size = np.array([len(d) for d in diffs], np.int64)
            # two sets are linked where their weights and 2 (100 + percent) for each shared difference add up to 0 at least
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("row"), pa.array((100 - percent) * n - (100 + percent) * size), pa.array(diffs, pa.list_(pa.int64()))], schema=fields)

    known = members.select("row", "group").join(whole, "row").join(reference, "group", "left")
    diffs = materialise(known.select("group", "row", "n", "grams", "reference").mapInArrow(run, "group long, row long, weight long, diff array<bigint>"), "differences")
    centre = diffs.groupBy("group").agg(F.max(F.struct("weight", "row")).alias("c"), F.count(F.lit(1)).alias("size")).select("group", F.col("c.row").alias("centre"), F.col("c.weight").alias("top"), "size")
    placed = diffs.join(centre, "group").withColumn("close", F.col("weight") + F.col("top") >= 0)
    star = placed.where(F.col("close") & (F.col("row") != F.col("centre"))).select(F.greatest("row", "centre").alias("u"), F.least("row", "centre").alias("v"))
    # what is left: sets that aren't close to the centre, beside all of their group
    far = placed.groupBy("group").agg(F.sum((~F.col("close") if not every else F.lit(True)).cast("long")).alias("n_left"))
    placed = placed.join(far.where("n_left > 0"), "group").withColumn("component", F.when(F.col("close"), F.col("centre")).otherwise(F.col("row")))
    parts = lambda c: F.ceil(F.col(c) / TASK).cast("int")
    own = lambda c: F.pmod(F.xxhash64("row"), parts(c)).cast("int")
    every_part = lambda c: F.explode(F.sequence(F.lit(0), parts(c) - 1))
    taken = placed if every else placed.where(~F.col("close"))
    body = ["group", "row", "weight", "diff", "component"]
    left = taken.select(*body, own("n_left").alias("i"), F.lit(0).alias("side"), every_part("size").alias("j"))
    right = placed.select(*body, every_part("n_left").alias("i"), F.lit(1).alias("side"), own("size").alias("j"))

    def block(own_rows: pd.DataFrame) -> pd.DataFrame:
        left, right = own_rows[own_rows["side"] == 0].sort_values("row"), own_rows[own_rows["side"] == 1].sort_values("row")
        i, j = compare(left, right, percent, every)
        a, b = left["row"].to_numpy()[i], right["row"].to_numpy()[j]
        return pd.DataFrame({"u": np.maximum(a, b), "v": np.minimum(a, b)})

    derived = left.unionByName(right).groupBy("group", "i", "j").applyInPandas(block, "u long, v long")
    return materialise((derived if every else star.unionByName(derived)).distinct(), "group-links")


def similar_sets(docs: DataFrame, n: int = 4, percent: int = 85, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """(summary of each row, links). ``docs``: doc (long), text, mark (long). Summary: row, doc, mark, n, d1, d2 and node, the row that stands for its set. Links: distinct pairs u > v of nodes
    whose sets have ``percent`` of their union in common: with ``every`` all of them, else enough to hold every component together."""
    raw = materialise(_summary(docs, n), "sets")
    rows = raw.where("row is not null").drop("part", "cells")
    counts = _counts(raw.where("part is not null").select("part", "cells"))
    release(docs.sparkSession)
    nodes = materialise(rows.where("n > 0").groupBy("d1", "d2").agg(F.min(F.struct("row", "doc", "n")).alias("r")).select("d1", "d2", "r.*"), "nodes")
    gathered = Window.partitionBy("gram", "salt")
    shared = (F.min("d1").over(gathered) != F.max("d1").over(gathered)) | (F.col("salt") > 0)
    several = materialise(_prefixes(docs.select("doc", "text"), n, percent, counts).withColumn("several", shared).where("several").select("gram", "d1", "d2", "at"), "shared-prefixes")
    index = materialise(several.join(nodes.select("d1", "d2", "row", "n"), ["d1", "d2"]).select("gram", "row", "n", "at").dropDuplicates(["gram", "row"]), "index")
    lists = materialise(index.groupBy("gram").agg(F.count(F.lit(1)).alias("size"), F.min("row").alias("first")).where("size > 1"), "lists")
    discard(several)
    long = index.join(lists.where(F.col("size") > LONG), "gram").where("row <> first").select(F.col("row").alias("u"), F.col("first").alias("v"))
    groups = materialise(connected_components(long), "groups")  # node, component
    pairs = _short_pairs(index.join(lists.where(F.col("size") <= LONG).select("gram"), "gram"), percent)
    of = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    # pairs inside a group are found there
    pairs = pairs.join(of("x"), "x", "left").join(of("y"), "y", "left").where("x_in is null or y_in is null or x_in <> y_in")
    pairs = materialise(pairs.select(F.col("x").alias("u"), F.col("y").alias("v")), "pairs")
    discard(index, lists)
    ends = pairs.select(F.col("u").alias("row")).unionByName(pairs.select(F.col("v").alias("row"))).withColumn("grouped", F.lit(0))
    named = ends.unionByName(groups.select(F.col("node").alias("row"), F.lit(1).alias("grouped"))).groupBy("row").agg(F.max("grouped").alias("grouped"))
    wanted = materialise(named.join(nodes.select("row", "doc", "d1", "d2"), "row"), "wanted")
    whole = materialise(_whole(docs.select("doc", "text"), wanted, n), "whole-sets", "grouped")
    left, right = (whole.select(F.col("row").alias(c), F.col("grams").alias(f"of_{c}")) for c in ("u", "v"))
    common = F.size(F.array_intersect("of_u", "of_v"))
    links = pairs.join(left, "u").join(right, "v").where(common * (100 + percent) >= percent * (F.size("of_u") + F.size("of_v"))).select("u", "v")
    links = materialise(links, "pair-links")
    members = groups.select(F.col("node").alias("row"), F.col("component").alias("group"))
    inside = _group_links(members, whole.where("grouped = 1").drop("grouped"), percent, every)
    summary = materialise(rows.join(nodes.select("d1", "d2", F.col("row").alias("node")), ["d1", "d2"], "left"), "rows-of-sets")
    discard(raw, nodes, wanted, whole, pairs)
    return summary, links.unionByName(inside)


def _placed(docs: DataFrame, n: int, percent: int, id_col: str, text: str) -> DataFrame:
    """(row, doc, mark, n, component) of each row: rows of one component agree on it. A null id counts as the smallest integer."""
    texts = F.col(text).cast("string")
    named = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("doc"), texts.alias("text"), F.xxhash64(texts, F.octet_length(texts)).alias("mark"))
    rows, links = similar_sets(named, n, percent)
    return materialise(rows.join(connected_components(links), "node", "left").select("row", "doc", "mark", "n", F.coalesce("component", "node", "row").alias("component")), "placed")


LOWEST = -(1 << 63)


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """op7's rows: doc_id, n_shingles, component_id, one for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Documents link when ``100 * intersection >= percent * union``; those without words link
    with nothing. Rows with equal sets, repeated ids included, share a component. A null id counts as the smallest integer, and stays null in the result; it gives a component no name.
    Other columns are ignored; an empty table gives an empty result.
    """
    placed = _placed(docs, n, percent, id_col, text)
    real = F.when(F.col("doc") > LOWEST, F.col("doc"))
    names = placed.groupBy("component").agg(F.min(real).alias("component_id"), F.count(F.lit(1)).alias("many")).where("many > 1").drop("many")
    return placed.join(names, "component", "left").select(real.alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", real).alias("component_id"))


def jaccard_links(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, n_links, one for each row of ``docs``: how many other rows it links with, as in ``jaccard_components``, those of equal sets among them.
    Every link is made, those inside groups too, so the work grows with the number of links."""
    named = docs.select(F.col(id_col).cast("long").alias("real"), F.monotonically_increasing_id().alias("doc"), F.col(text).cast("string").alias("text"), F.lit(0).cast("long").alias("mark"))
    named = materialise(named, "numbered")
    rows, links = similar_sets(named.select("doc", "text", "mark"), n, percent, every=True)
    copies = rows.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    ends = links.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(links.select(F.col("v").alias("node"), F.col("u").alias("other")))
    others = ends.join(copies.select(F.col("node").alias("other"), "copies"), "other").groupBy("node").agg(F.sum("copies").alias("others"))
    counts = copies.join(others, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    counted = rows.join(counts, "node", "left").select("doc", F.col("n").cast("long").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return named.select("doc", F.col("real").alias("doc_id")).join(counted, "doc").drop("doc")


def keep_one_of_each(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` of which each component keeps the one of smallest id (of several rows with that id, that of smallest text hash); other columns
    pass through. Rows are told apart by id and text, so another row that repeats an id is judged by its own text; rows that agree in both stay or go together.
    A null id is the largest here: such a row stays only where its component has no other."""
    placed = _placed(docs, n, percent, id_col, text)
    rank = F.struct((F.col("doc") == LOWEST).alias("unnamed"), "doc", "mark")
    best = placed.groupBy("component").agg(F.min(rank).alias("best"))
    gone = placed.join(best, "component").where(rank != F.col("best")).select(F.col("doc").alias("__doc"), F.col("mark").alias("__mark")).distinct()
    texts = F.col(text).cast("string")
    same = (F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)) == F.col("__doc")) & (F.xxhash64(texts, F.octet_length(texts)) == F.col("__mark"))
    return docs.join(materialise(gone, "gone"), same, "left_anti")
