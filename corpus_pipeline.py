"""From raw documents to packed sequences: each stage works on all that its predecessor kept.

Decisions are judged on each stage's own input. All stages but the last return the columns of ``documents``, unchanged unless said; further columns pass through,
whatever their names. Null texts are empty texts, null and repeated ids are allowed, and an empty table stays empty; what each stage does with them is said there.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import exact_dedup, jaccard, packing, quality, substring
from gridloom.llm.runtime import materialise


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that score below 0.3 go. The model is fitted on labelled rows of ``docs`` that aren't held out; without any, every document
    has the same score of one half and stays. Empty and null texts have the score of a text without features. Rows are judged one by one, so repeated and null ids don't matter."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = f"score_{uuid.uuid4().hex}"
    return quality.add_score(docs, model, out=name).where(F.col(name) >= 0.3).drop(name)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of texts equal but for the case of A-Z, the document with the largest id stays; empty and null texts are equal. A null id stays only where no equal text has an id. Rows
    that agree in id and text stay or go together; an id's other texts are judged on their own."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7, on sets of five-word shingles at a similarity of 0.8: of each component the document with the smallest id stays. Texts without words are near nothing and stay. A null
    id counts as the largest. Rows that agree in id and text stay or go together."""
    return jaccard.keep_one_of_each(docs, 5, 80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: words of repeats of 13 words or more go where a document with a smaller id has them too. Texts that lose words are joined by single blanks again,
    and n_chars follows; others, null and empty ones among them, are unchanged. A document that loses all of its words goes. A null id counts as the smallest; rows of one id don't take words from each other."""
    done = substring.remove_repeats(docs, prefix="__")
    less, left = F.col("__n_removed") > 0, (F.col("__n_removed") < F.col("__n_words")) | (F.col("__n_words") == 0)
    changed = done.where(left).withColumn("text", F.when(less, F.col("__kept")).otherwise(F.col("text")))
    return changed.withColumn("n_chars", F.when(less, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Every row has at least the piece of its end id; rows that repeat an id have pieces of their own."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), "word", 1, 4096)


STAGES = [("quality classifier", quality_filter), ("exact dedup", exact_dedup_stage), ("n-gram jaccard join", near_dedup_stage), ("substring dedup", substring_stage), ("best-fit packing", packing_stage)]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; each is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, "stage")
    return docs
