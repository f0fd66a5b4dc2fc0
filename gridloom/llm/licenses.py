"""License scans by a positional index of rare words, in DataFrame operations only.

Templates are short licence notices. Their words are indexed by position, each with its inverse document frequency over all
documents. A template's own words of highest IDF, the rarest of its key phrase among them, make candidate places; postings are intersected by relative
position (document position less template position), so words vote for a template only where they stand as in the template. A template counts at a
candidate place where enough of all its words agree and its mandatory key phrase stands whole. Base phrases are found separately, at every place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exact_dedup import fold_ascii
from .runtime import materialise

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: label, notice, mandatory key phrase (within the notice).
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc0", "dedicated to the public domain under creative commons zero", "creative commons zero"),
    ("unlicense", "free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute"),
    ("reserved", "all rights reserved", "all rights reserved"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission notice shall be included"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "source code must retain"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "unless required by applicable law"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "free software foundation"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gnu free documentation license"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", "cc by nc sa"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0", "cc by nc nd"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", "authors be held liable"),
    ("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("cddl-1.0", "subject to the terms of the common development and distribution license", "common development"),
    ("artistic-2.0", "licensed under the artistic license 2 0", "artistic license"),
    ("ofl-1.1", "licensed under the sil open font license version 1 1", "open font license"),
    ("eupl-1.2", "licensed under the european union public licence version 1 2", "european union public licence"),
    ("proprietary", "this software is proprietary and confidential unauthorized copying is strictly prohibited", "unauthorized copying"),
]
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of every running text; they are no licence words unless a key phrase needs them.
COMMON = {"the", "and", "of", "to", "in", "or", "a", "an", "as", "at", "be", "by", "can", "for", "from", "it", "on", "is", "any", "all", "no", "this", "will", "with", "are", "into", "use", "without", "you"}


def _index(spark) -> tuple[DataFrame, list[str]]:
    """Postings: word, template, label, position, is_key, key_words (of the template), words (indexed words of the template)."""
    rows = []
    for t, (label, notice, key) in enumerate(TEMPLATES):
        words, wanted = notice.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(wanted)] == wanted)
        kept = [(i, w, at <= i < at + len(wanted)) for i, w in enumerate(words) if w not in COMMON or at <= i < at + len(wanted)]
        rows += [(w, t, label, i, k, len(wanted), len(kept)) for i, w, k in kept]
    frame = spark.createDataFrame(rows, "word string, template int, label string, at int, is_key boolean, key_words int, words int")
    return frame, sorted({r[0] for r in rows})


def _stands(words: Column, i: Column, phrase: str) -> Column:
    return reduce(lambda a, b: a & b, (F.get(words, i + k) == w for k, w in enumerate(phrase.split())))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rare: int = 8, agree: float = 0.6) -> DataFrame:
    """op10's rows: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``rare``: words of highest IDF by which a template is looked up; ``agree``: share of all its words that it needs at one place. score: 1 with a base
    phrase, else the best verified template's share, else 0. Null or empty texts have no words and score 0. Rows that repeat an id are
    scanned as rows of their own. Other columns are ignored.
    """
    spark = docs.sparkSession
    index, vocabulary = _index(spark)
    words = F.regexp_extract_all(fold_ascii(F.col(text)), F.lit(WORDS), 0)
    rows = docs.select(F.col(id_col).alias("doc_id"), words.alias("words"))
    first = {p: p.split()[0] for p in BASE}
    places = F.filter(
        F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("word"), i.cast("int").alias("at")))), lambda x: x.isNotNull()
    )
    rows = rows.withColumn("hits", places)
    begins = lambda p: F.transform(F.filter("hits", lambda x: (x["word"] == first[p]) & _stands(F.col("words"), x["at"], p)), lambda x: x["at"])
    base = F.array(*(F.struct(F.lit(label).alias("label"), begins(p).alias("at")) for p, label in BASE.items()))
    scanned = materialise(
        rows.select("doc_id", F.size("words").cast("long").alias("n_words"), "hits", F.filter(base, lambda x: F.size(x["at"]) > 0).alias("base")).withColumn("row", F.monotonically_increasing_id()), "licence-words"
    )
    n = F.lit(float(scanned.count()))
    seen = scanned.where(F.size("hits") > 0)
    df = seen.select(F.explode(F.array_distinct(F.transform("hits", lambda x: x["word"]))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = df.select("word", F.log((n + 1) / (F.col("df") + 1)).alias("idf"))
    order = lambda *by: Window.partitionBy("template", *by).orderBy(F.col("idf").desc(), "word", "at")
    anchor = (F.row_number().over(order()) <= rare) | (F.col("is_key") & (F.row_number().over(order("is_key")) == 1))
    index = materialise(index.join(idf, "word").withColumn("anchor", anchor).drop("idf"), "licence-idf")  # at most one row for each place of a template
    each = seen.select("row", F.explode("hits").alias("hit")).select("row", "hit.word", F.col("hit.at").alias("doc_at"))
    votes = (
        each.join(F.broadcast(index), "word").withColumn("offset", F.col("doc_at") - F.col("at"))
        .groupBy("row", "template", "label", "offset", "key_words", "words")
        .agg(F.count(F.lit(1)).alias("agreeing"), F.sum(F.col("is_key").cast("int")).alias("key_found"), F.bool_or("anchor").alias("candidate"))
        .withColumn("share", F.col("agreeing") / F.col("words"))
        .where(F.col("candidate") & (F.col("key_found") == F.col("key_words")) & (F.col("share") >= agree))
        .groupBy("row").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    )
    at = F.flatten(F.transform("base", lambda x: x["at"]))
    known = F.transform("base", lambda x: x["label"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return scanned.drop("hits").join(votes, "row", "left").select(
        "doc_id", "n_words", F.size(at).cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        joined(known).alias("base_labels"), joined(F.concat(known, F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size(at) > 0, 1.0).otherwise(F.least(F.coalesce("share", F.lit(0.0)), F.lit(1.0))).alias("score"),
    )
