"""Exact deduplication by a tree-merge of sorted digest runs, in DataFrame operations only.

Texts are read and hashed once; digests go to the shared folder. Each partition of theirs is a run: its rows are sorted by digest and neighbours of one digest become one row. Then runs
are merged in rounds, as in a binomial tree: in each round, runs whose numbers agree but for their lowest bits exchange their rows, which are merged in order of the digest,
keeping the identifier that stays and the number of copies; the last round leaves one run of all digests. The identifiers are kept in structs, for which Spark plans sorts and sorted
aggregations on both sides of each exchange: what arrives is a concatenation of sorted runs, which its sort merges. Every merge reduces before its shuffle, so a digest
that a third of all rows share moves as one row from each task. What moves is digests, never texts.

A digest is verified at every level: rows merge only if SHA-256, a second hash of other construction and the text's length all agree.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialise

KEY = ["sha", "check", "bytes"]


def fold_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; other letters stay. Null is empty. Where all bytes are ASCII, the fast built-in does the same."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the digest of each row, written down: texts are read once."""
    clean = docs.select(F.col(id_col).alias("doc_id"), fold_ascii(F.col(text)).alias("clean"))
    return materialise(clean.select("doc_id", F.unhex(F.sha2("clean", 256)).alias("sha"), F.xxhash64("clean").alias("check"), F.octet_length("clean").alias("bytes")), "digests")


def merge_runs(runs: DataFrame, levels: int, fan: int, best) -> DataFrame:
    """``runs``: run (below ``2**levels``), the digest, stays (a struct), group_size. Merges 2**fan runs into one each round until one is left."""
    while levels > 0:
        step = min(fan, levels)
        levels -= step
        runs = runs.groupBy(F.shiftright("run", step).alias("run"), *KEY).agg(best("stays").alias("stays"), F.sum("group_size").alias("group_size"))
    return runs.drop("run")


def decide(rows: DataFrame, keep: str = "largest", levels: int = 4, fan: int = 2) -> DataFrame:
    """``rows`` as from ``digests``, with keep_id, group_size and kept."""
    best = {"largest": F.max, "smallest": F.min}[keep]
    # the flag comes first: a null id stays only where its group has no other
    ranked = F.struct((F.col("doc_id").isNotNull() if keep == "largest" else F.col("doc_id").isNull()).alias("last"), F.col("doc_id").alias("id"))
    runs = rows.withColumn("run", F.pmod(F.spark_partition_id(), F.lit(1 << levels)))
    first = runs.groupBy("run", *KEY).agg(best(ranked).alias("stays"), F.count(F.lit(1)).alias("group_size"))
    merged = merge_runs(first, levels, fan, best).select(*KEY, F.col("stays.id").alias("keep_id"), "group_size")
    return rows.join(merged, KEY).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "largest", levels: int = 4, fan: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. ``keep``: "largest" or "smallest" id of each
    group stays. Rows that repeat an id count as rows of their own, and each is reported (all rows of the group with the id that stays are kept). A
    null id stays only where its whole group has none. An empty table gives an empty result; other columns are ignored.
    """
    decided = decide(digests(docs, id_col, text), keep, levels, fan)
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged. Rows are told apart by id (null is one) and text, so one that repeats an id is judged by its own text;
    rows that agree in both stay or go together."""
    gone = decide(digests(docs, id_col, text), **options).where(~F.col("kept")).select(F.col("doc_id").alias("__gone"), F.col("check").alias("__check"), F.col("bytes").alias("__bytes")).distinct()
    clean = fold_ascii(F.col(text))
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("__gone")) & (F.xxhash64(clean) == F.col("__check")) & (F.octet_length(clean) == F.col("__bytes")), "left_anti")
