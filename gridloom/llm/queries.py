"""The queries of this subpackage's operators, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers

from . import bpe, exact_dedup, jaccard, licenses, media, packing, quality, substring, token_files, warc


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_media(spark, sf_dir):
    return media.media_table(_docs(spark, sf_dir))


def op2_warc(spark, sf_dir):
    return warc.read_archives(warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op3_substring_dedup(spark, sf_dir):
    return substring.substring_dedup(_docs(spark, sf_dir))


def op4_token_output(spark, sf_dir):
    shards = token_files.write_token_shards(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), "byte", 0)
    return token_files.read_token_shards(shards)


def op5_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), "word", 1, 4096)


def op6_bpe(spark, sf_dir):
    return bpe.round_trip(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(_docs(spark, sf_dir))


def op8_quality(spark, sf_dir):
    return quality.quality_scores(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(_docs(spark, sf_dir))


def op10_licenses(spark, sf_dir):
    return licenses.scan_licenses(_docs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_media, op2_warc, op3_substring_dedup, op4_token_output, op5_best_fit_packing, op6_bpe, op7_jaccard_join, op8_quality, op9_exact_dedup, op10_licenses)}

SQL = {
    "op3_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents),
v AS (SELECT doc_id, s, array_to_string(words[s:s + 12], ' ') AS run FROM w, unnest(range(1, len(words) - 11)) AS r(s)),
f AS (SELECT run, min(doc_id) AS least FROM v GROUP BY run),
g AS (SELECT doc_id, list(DISTINCT s + k) AS gone FROM v JOIN f USING (run), unnest(range(13)) AS u(k) WHERE least < doc_id GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)""",
    "op7_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS gram FROM w, unnest(range(1, greatest(len(words) - 3, least(len(words), 1)) + 1)) AS r(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
e AS (SELECT x AS u, y AS v FROM l UNION ALL SELECT y, x FROM l),
c AS (SELECT doc_id AS node, doc_id AS goal FROM documents UNION SELECT c.node, e.v FROM c JOIN e ON e.u = c.goal WHERE e.v <> c.node),
m AS (SELECT node, min(goal) AS component_id FROM c GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN m ON m.node = d.doc_id""",
    "op9_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
}
