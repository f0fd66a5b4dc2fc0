"""Queries for research pages and workbook structure, with their SQL. The tables stand for workbooks: customers are entities, parts and line items make cells, blocks and edges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .checkpoints import ensure_checkpoints
from .functions.values import BOOL, ERROR, NUMBER, TEXT, cell
from .operators import aggregates as A
from .operators import pages as P
from .operators import structure as T
from .operators.validation import reconcile
from .plans import research_map as M
from .queries import E1, EA, EB, entities, query, r, t

MOVED = f"WITH {EA}, {EB}, m AS (SELECT a.key, a.label, a.category, b.rank AS rank_from, a.rank AS rank_to, b.rank - a.rank AS delta, b.quartile::INTEGER AS quartile_from, a.quartile::INTEGER AS quartile_to FROM a JOIN b USING (key) WHERE a.rank <> b.rank)"


def _moved(spark, d, repairs=None):
    return P.movers(entities(spark, d, 1), entities(spark, d, 0), repairs)


# -- research pages --------------------------------------------------------------------------------------------------------


@query(f"WITH {E1} SELECT key, label FROM e WHERE contains(lower(label), '00') AND c_mktsegment = 'MACHINERY' AND quartile IN (1, 3) AND key IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def entity_filter(spark, d):
    keys = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"))
    return P.filter_entities(entities(spark, d), " 00 ", {"c_mktsegment": "MACHINERY", "category": None}, (1, 3), keys, ("label",)).select("key", "label")


@query(f"""WITH {E1} SELECT c_mktsegment AS "group", count(*) AS count, count(*) FILTER (WHERE quartile = 1) AS q1, round(avg(score), 2) AS score, round(avg(c_acctbal), 2) AS c_acctbal FROM e GROUP BY 1""")
def entity_subtotals(spark, d):
    return P.group_subtotals(entities(spark, d), F.col("c_mktsegment"), ["score", "c_acctbal"]).withColumns({"score": r("score", 2), "c_acctbal": r("c_acctbal", 2)})


@query(f"""WITH {E1}, v AS (SELECT list_sort(list(c_acctbal)) AS v, count(c_acctbal) AS n FROM e), q AS (SELECT i, (v[j] * (4 - g) + v[j + 1] * g) / 4 AS cut FROM (SELECT v, i, (i * (n + 1)) // 4 AS j, i * (n + 1) - 4 * ((i * (n + 1)) // 4) AS g FROM v, (SELECT unnest([1, 2, 3]) AS i))),
b AS (SELECT key, 'b' || (1 + (SELECT count(*) FROM q WHERE e.c_acctbal > cut)) AS band FROM e) SELECT band, count(*) AS n FROM b GROUP BY 1""")
def band_labels(spark, d):
    labelled = P.banded(entities(spark, d), "c_acctbal")
    return labelled.groupBy("band", "band_label").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.sum("n").alias("n"))


@query("""SELECT 'dimension' AS kind, 'c_mktsegment' AS name, count(DISTINCT c_mktsegment) AS values FROM customer UNION ALL SELECT 'dimension', 'category', count(DISTINCT n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'band', 'c_acctbal', count(*) FROM customer UNION ALL SELECT 'dimension', 'label', count(DISTINCT c_name) FROM customer HAVING count(DISTINCT c_name) <= 400""")
def group_options(spark, d):
    return P.group_options(entities(spark, d), ["c_mktsegment", "category", "label"], ["c_acctbal"])


CATEGORY_PAGE = f"""WITH {E1}, c AS (SELECT category, count(*) AS count, count(score) AS rated, count(*) FILTER (WHERE quartile = 1) AS q1, count(*) FILTER (WHERE quartile = 2) AS q2, count(*) FILTER (WHERE quartile = 3) AS q3, count(*) FILTER (WHERE quartile = 4) AS q4,
avg(score) AS value, CASE WHEN count(score) >= 2 THEN max(score) - min(score) END AS spread, count(*) FILTER (WHERE score IS NOT NULL AND quartile IS NULL) AS unranked, count(score) >= 20 AS eligible FROM e GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY value DESC NULLS LAST, category) AS place FROM c)"""


@query(f"{CATEGORY_PAGE} SELECT category, count, rated, q1, q2, q3, q4, round(value, 2) AS value, round(spread, 2) AS spread, unranked, eligible, place FROM p")
def categories_page(spark, d):
    return P.category_page(entities(spark, d), "score", 20).withColumns({"value": r("value", 2), "spread": r("spread", 2), "place": F.col("place").cast("long")})


@query(f"{CATEGORY_PAGE} SELECT count(*) AS categories, count(*) FILTER (WHERE unranked > 0) AS unranked, count(*) FILTER (WHERE eligible) AS eligible, (SELECT category FROM p WHERE eligible ORDER BY spread DESC NULLS LAST, place LIMIT 1) AS widest, (SELECT category FROM p WHERE eligible ORDER BY place LIMIT 1) AS best FROM p")
def categories_facts(spark, d):
    return P.category_facts(P.category_page(entities(spark, d), "score", 20))


@query(f"""WITH {E1}, m AS (SELECT * FROM e WHERE key = 77), c AS (SELECT e.* FROM e JOIN m ON e.category = m.category)
SELECT 'score' AS measure, (SELECT score FROM m) AS value, CASE WHEN (SELECT score FROM m) IS NOT NULL THEN 1 + count(*) FILTER (WHERE score > (SELECT score FROM m)) END AS category_rank, count(score) AS category_count, round(avg(score), 2) AS category_mean FROM c
UNION ALL SELECT 'c_acctbal', (SELECT c_acctbal FROM m), 1 + count(*) FILTER (WHERE c_acctbal < (SELECT c_acctbal FROM m)), count(c_acctbal), round(avg(c_acctbal), 2) FROM c""")
def entity_detail(spark, d):
    return P.entity_detail(entities(spark, d), 77, {"score": True, "c_acctbal": False}).withColumn("category_mean", r("category_mean", 2))


@query(f"WITH {EA}, {EB} SELECT 2 AS version, 1 AS as_of, rank, quartile::INTEGER AS quartile, score FROM a WHERE key = 77 UNION ALL SELECT 1, 0, rank, quartile::INTEGER, score FROM b WHERE key = 77")
def entity_history(spark, d):
    of = lambda period, version, as_of: entities(spark, d, period).withColumn("version", F.lit(version)).withColumn("as_of", F.lit(as_of))
    snapshots = of(0, 1, 0).unionByName(of(0, 0, 0).withColumn("rank", F.lit(-1).cast("long"))).unionByName(of(1, 2, 1))
    return P.entity_history(snapshots, 77).withColumn("quartile", F.col("quartile").cast("int"))


@query("""WITH c AS (SELECT 'B' || p_partkey || ':B' || (p_partkey + 2) AS location, p_name AS title FROM part WHERE p_size > 40), x AS (SELECT unnest(list_distinct(regexp_extract_all(location, '[A-Z]+(\\d+)', 1)))::BIGINT AS row, title FROM c)
SELECT c_custkey AS key, max(title) AS note FROM x JOIN customer ON c_custkey = row GROUP BY 1""")
def repair_attribution(spark, d):
    changes = t(spark, d, "part").select(F.lit("Funds").alias("sheet"), F.concat(F.lit("B"), "p_partkey", F.lit(":B"), F.col("p_partkey") + 2).alias("location"), F.col("p_name").alias("title"), (F.col("p_size") > 40).alias("repair"))
    return P.repaired_keys(changes, t(spark, d, "customer").select(F.lit("Funds").alias("sheet"), F.col("c_custkey").cast("int").alias("row"), F.col("c_custkey").alias("key")))


@query(f"{MOVED}, s AS (SELECT c_custkey AS key, 'row repaired' AS note FROM customer WHERE c_nationkey = 3) SELECT m.key, rank_from, rank_to, delta, quartile_from, quartile_to, CASE WHEN note IS NULL THEN 'market' ELSE 'repair' END AS cause, note FROM m LEFT JOIN s USING (key)")
def movement_causes(spark, d):
    repairs = t(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("key"), F.lit("row repaired").alias("note"))
    return _moved(spark, d, repairs).select("key", "rank_from", "rank_to", "delta", F.col("quartile_from").cast("int").alias("quartile_from"), F.col("quartile_to").cast("int").alias("quartile_to"), "cause", "note")


@query(f"{MOVED} SELECT key, delta FROM m WHERE delta > 0 ORDER BY delta DESC, key LIMIT 20")
def movement_risers(spark, d):
    return P.risers(_moved(spark, d)).select("key", "delta")


@query(f"{MOVED} SELECT key, delta FROM m WHERE delta < 0 ORDER BY delta, key LIMIT 20")
def movement_fallers(spark, d):
    return P.fallers(_moved(spark, d)).select("key", "delta")


@query(f"""WITH {E1} SELECT 'high' AS name, 'ok' AS status, count(*) FILTER (WHERE score > 100000) AS count, count(score) AS total, NULL::BIGINT AS groups FROM e
UNION ALL SELECT 'none', 'empty', 0, count(score), NULL FROM e UNION ALL SELECT 'one group', 'unavailable', count(*) FILTER (WHERE quartile = 1), count(score), 0 FROM e
UNION ALL SELECT 'lost', 'problem', NULL, NULL, NULL UNION ALL SELECT 'unrated', 'unavailable', 0, count(*), NULL FROM e WHERE score IS NULL
UNION ALL SELECT 'unrated, by balance', CASE WHEN count(*) FILTER (WHERE c_acctbal > 0) = 0 THEN 'empty' ELSE 'ok' END, count(*) FILTER (WHERE c_acctbal > 0), count(*), NULL FROM e WHERE score IS NULL""")
def insight_status(spark, d):
    e = entities(spark, d)
    unrated = e.where("score is null")
    cards = [P.insight_card(e, "high", [("score", "gt", 100000)]), P.insight_card(e, "none", [("score", "lt", -5)]), P.insight_card(e, "one group", [("quartile", "eq", 1)], by="category", least=1_000_000_000), P.insight_card(e, "lost", [("no such measure", "gt", 1)]), P.insight_card(unrated, "unrated", [("quartile", "eq", 1)]), P.insight_card(unrated, "unrated, by balance", [("c_acctbal", "gt", 0)])]
    out = cards[0]
    for c in cards[1:]:
        out = out.unionByName(c)
    return out


@query(f"""WITH {E1} SELECT row_number() OVER (ORDER BY c_acctbal DESC, key) AS place, key, category AS "group", NULL::DOUBLE AS value, 'Q' || quartile::INTEGER || ' / Q' || rank AS value_label FROM e WHERE quartile IN (1, 2) AND rank <= 4 ORDER BY c_acctbal DESC, key LIMIT 12""")
def insight_rows(spark, d):
    rows = P.insight_rows(entities(spark, d), [("quartile", "in", (1, 2)), ("rank", "lte", 4)], "c_acctbal", 12, pair=("quartile", "rank"))
    return rows.select(F.col("place").cast("long").alias("place"), "key", "group", "value", "value_label")


@query(f"WITH {E1} SELECT key FROM e WHERE quartile = 2 ORDER BY score DESC NULLS LAST, key LIMIT 200")
def insight_drill(spark, d):
    return P.drill_keys(entities(spark, d), [("quartile", "eq", 2)], "score")


@query(f"""WITH {E1}, i AS (SELECT *, CASE WHEN key % 9 <> 4 THEN (key % 50)::DOUBLE END AS age FROM e WHERE key % 7 <> 3), s AS (SELECT category, count(*) AS n, count(score) AS rated FROM i GROUP BY 1)
SELECT count(*) AS total, count(score) AS rated, count(*) FILTER (WHERE score IS NULL AND age < 20) AS young, count(*) FILTER (WHERE score IS NULL AND age >= 20) AS gap, count(*) FILTER (WHERE score IS NULL AND age IS NULL) AS unknown,
(SELECT count(*) FROM e WHERE key % 7 = 3) AS outside, (SELECT median(n)::DOUBLE FROM s) AS median_size, (SELECT max(n) FROM s) AS largest, (SELECT coalesce(sum(rated) FILTER (WHERE rated < 40), 0)::BIGINT FROM s) AS small, (count(score) - (SELECT coalesce(sum(rated) FILTER (WHERE rated < 40), 0) FROM s))::BIGINT AS ranked FROM i""")
def universe_summary(spark, d):
    return P.universe_summary(entities(spark, d), F.col("key") % 7 != 3, F.when(F.col("key") % 9 != 4, (F.col("key") % 50).cast("double")), 20, 40)


@query("""WITH v AS (SELECT o_orderkey AS version, o_orderdate AS uploaded_at, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS activated_at, o_orderkey = 100 AS active, o_orderpriority <> '5-LOW' AS has_baseline FROM orders),
c AS (SELECT * FROM v WHERE active OR has_baseline ORDER BY active DESC, uploaded_at DESC, version DESC LIMIT 1)
SELECT 'current' AS role, version FROM c UNION ALL SELECT 'previous', version FROM (SELECT v.* FROM v, c WHERE v.activated_at IS NOT NULL AND v.has_baseline AND v.version <> c.version AND v.uploaded_at < c.uploaded_at ORDER BY v.activated_at DESC, v.version DESC LIMIT 1)""")
def version_selection(spark, d):
    o = t(spark, d, "orders")
    return P.pick_versions(o.select(F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("uploaded_at"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("activated_at"), (F.col("o_orderkey") == 100).alias("active"), (F.col("o_orderpriority") != "5-LOW").alias("has_baseline")))


@query("SELECT 'c_mktsegment' AS column, c_mktsegment AS value, count(*) AS count, round(avg(c_acctbal), 2) AS mean FROM customer GROUP BY 2")
def report_summary(spark, d):
    return P.report_summary(t(spark, d, "customer"), ["c_name", "c_mktsegment"], "c_acctbal").withColumn("mean", r("mean", 2))


@query("""WITH h AS (SELECT o_custkey, round(sum(o_totalprice) FILTER (WHERE month(o_orderdate) > 6), 2) AS now, round(sum(o_totalprice) FILTER (WHERE month(o_orderdate) <= 6), 2) AS before FROM orders GROUP BY 1)
SELECT o_custkey, round(now - before, 2) AS change FROM h WHERE now <> before ORDER BY abs(now - before) DESC, o_custkey LIMIT 20""")
def report_moves(spark, d):
    o = t(spark, d, "orders")
    half = lambda m: o.where(m).groupBy("o_custkey").agg(r(F.sum("o_totalprice"), 2).alias("spend"))
    return P.largest_moves(half(F.month("o_orderdate") > 6), half(F.month("o_orderdate") <= 6), "o_custkey", "spend").select("o_custkey", r("change", 2).alias("change"))


@query(f"{MOVED}, k AS (SELECT count(*) AS total, count(score) AS rated, count(DISTINCT category) AS categories, count(*) FILTER (WHERE quartile = 1) AS first_quartile, round(avg(score), 2) AS mean_score, arg_max(key, (score, -key)) FILTER (WHERE score IS NOT NULL) AS best FROM a) SELECT k.*, (SELECT count(*) FROM m WHERE delta > 0) AS rose, (SELECT count(*) FROM m WHERE delta < 0) AS fell FROM k")
def summary_kpis(spark, d):
    return P.kpis(entities(spark, d, 1), _moved(spark, d)).withColumn("mean_score", r("mean_score", 2))


# -- structure -------------------------------------------------------------------------------------------------------------


FORMULAS = """f AS (SELECT CASE p_size % 4 WHEN 0 THEN 'SUM(Data!A1:A' || p_size || ')+sum(B2)' WHEN 1 THEN 'IF(LEFT(A1,1)="SUM(x)",VLOOKUP(A1,''My Data''!A:B,2),0)' WHEN 2 THEN 'A1*2' ELSE 'IFERROR(Rates!B' || p_size || '/SUM(A1:A3),Data!C1)' END AS formula FROM part)"""


@query(rf"""WITH {FORMULAS}, g AS (SELECT regexp_replace(formula, '"[^"]*"', '""', 'g') AS code FROM f),
n AS (SELECT 'function' AS kind, unnest(list_distinct(list_transform(regexp_extract_all(code, '([A-Za-z_][A-Za-z0-9_.]*)\(', 1), lambda x: upper(x)))) AS name FROM g
UNION ALL SELECT 'sheet', unnest(list_distinct(regexp_extract_all(replace(code, '''', ''), '(My Data|Data|Rates)!', 1))) FROM g) SELECT kind, name, count(*) AS formulas FROM n GROUP BY 1, 2""")
def formula_references(spark, d):
    size = F.col("p_size")
    text = F.when(size % 4 == 0, F.concat(F.lit("SUM(Data!A1:A"), size, F.lit(")+sum(B2)"))).when(size % 4 == 1, F.lit("IF(LEFT(A1,1)=\"SUM(x)\",VLOOKUP(A1,'My Data'!A:B,2),0)")).when(size % 4 == 2, F.lit("A1*2")).otherwise(F.concat(F.lit("IFERROR(Rates!B"), size, F.lit("/SUM(A1:A3),Data!C1)")))
    return T.reference_counts(t(spark, d, "part").select(text.alias("formula")))


@query("""WITH a AS (SELECT p_partkey * 10 AS r1, p_partkey % 3 AS kind, p_retailprice AS x, p_size::DOUBLE AS y FROM part), c AS (SELECT *, i, j FROM a, (SELECT unnest(range(3)) AS i), (SELECT unnest(range(2)) AS j))
SELECT r1 + i AS row, 1 + j AS col, CASE kind WHEN 0 THEN CASE WHEN i < 2 THEN CASE WHEN j = 0 THEN x ELSE y END END WHEN 1 THEN CASE WHEN j = 0 THEN x ELSE y END ELSE CASE i WHEN 0 THEN x WHEN 1 THEN y ELSE x + y END END AS value, CASE WHEN kind = 0 AND i = 2 THEN '#N/A' END AS error FROM c""")
def array_spill(spark, d):
    x, y = F.col("p_retailprice"), F.col("p_size").cast("double")
    kind = F.col("p_partkey") % 3
    values = F.when(kind == 0, F.array(F.array(x, y), F.array(x, y))).when(kind == 1, F.array(F.array(x, y))).otherwise(F.array(F.array(x), F.array(y), F.array(x + y)))
    anchors = t(spark, d, "part").select(F.lit("S").alias("sheet"), (F.col("p_partkey") * 10).alias("r1"), F.lit(1).alias("c1"), (F.col("p_partkey") * 10 + 2).alias("r2"), F.lit(2).alias("c2"), values.alias("values"))
    return T.spill(anchors).drop("sheet")


@query("WITH RECURSIVE e AS (SELECT p_partkey // 2 AS source, p_partkey AS target FROM part WHERE p_partkey > 1 UNION SELECT p_partkey // 3, p_partkey FROM part WHERE p_partkey >= 3), w AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT target, depth + 1 FROM w JOIN e ON source = node) SELECT node, max(depth)::INTEGER AS depth FROM w GROUP BY 1")
def graph_depths(spark, d):
    ensure_checkpoints(spark)
    k = F.col("p_partkey")
    p = t(spark, d, "part")
    edges = p.where(k > 1).select(F.floor(k / 2).alias("source"), k.alias("target")).unionByName(p.where(k >= 3).select(F.floor(k / 3).alias("source"), k.alias("target")))
    return T.depths(edges)


@query("""WITH RECURSIVE e AS (SELECT l_partkey AS source, l_orderkey AS target FROM lineitem), w AS (SELECT 32::BIGINT AS node, 0 AS depth UNION SELECT source, depth + 1 FROM w JOIN e ON target = node WHERE depth < 3) SELECT node, min(depth)::INTEGER AS depth FROM w GROUP BY 1""")
def lineage_levels(spark, d):
    ensure_checkpoints(spark)
    edges = t(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_orderkey").alias("target"))
    return T.upstream(edges, spark.createDataFrame([(32,)], "node long"), 3)


@query("SELECT a.n_name AS source_sheet, b.n_name AS target_sheet, count(*) AS edges FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN supplier ON s_suppkey = 1 + o_orderkey % (SELECT max(s_suppkey) FROM supplier) JOIN nation b ON s_nationkey = b.n_nationkey WHERE a.n_name <> b.n_name GROUP BY 1, 2")
def sheet_edges(spark, d):
    n = t(spark, d, "nation")
    c = t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("n_name").alias("sheet"))
    s = t(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("n_name").alias("sheet"))
    most = t(spark, d, "supplier").agg(F.max("s_suppkey")).first()[0]
    edges = t(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("s"), F.col("o_orderkey") % most + 1).alias("target"))
    return T.sheet_edges(edges, c.unionByName(s))


@query("""WITH c AS (SELECT event_type AS sheet, event_id // 8 AS row, event_id % 8 AS col, CASE WHEN user_id % 4 = 0 THEN 'u' || user_id END AS text FROM events),
a AS (SELECT x.*, (SELECT arg_max(y.text, y.row) FROM c y WHERE y.sheet = x.sheet AND y.col = x.col AND y.row BETWEEN x.row - 5 AND x.row - 1 AND y.text IS NOT NULL) AS over, (SELECT arg_max(y.text, y.col) FROM c y WHERE y.sheet = x.sheet AND y.row = x.row AND y.col BETWEEN x.col - 3 AND x.col - 1 AND y.text IS NOT NULL) AS beside FROM c x)
SELECT sheet, row, col, coalesce(over, beside) AS label FROM a""")
def cell_labels(spark, d):
    cells = t(spark, d, "events").select(F.col("event_type").alias("sheet"), F.floor(F.col("event_id") / 8).alias("row"), (F.col("event_id") % 8).alias("col"), F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("u"), "user_id")).alias("text"))
    return T.labels(cells).select("sheet", "row", "col", "label")


@query("""WITH c AS (SELECT 1 + o_orderkey % 1000 AS row, 1 + o_custkey % 20 AS col, count(*) AS n FROM orders GROUP BY 1, 2), m AS (SELECT s_suppkey AS name, 1 + s_suppkey * 9 AS r1, 4 + s_suppkey * 9 AS r2, 1 + s_suppkey % 10 AS c1, 6 + s_suppkey % 10 AS c2 FROM supplier)
SELECT row, col, (SELECT min(name) FROM m WHERE row BETWEEN r1 AND r2 AND col BETWEEN c1 AND c2) AS member_of FROM c""")
def range_membership(spark, d):
    cells = t(spark, d, "orders").select(F.lit("S").alias("sheet"), (F.col("o_orderkey") % 1000 + 1).alias("row"), (F.col("o_custkey") % 20 + 1).alias("col")).distinct()
    k = F.col("s_suppkey")
    ranges = t(spark, d, "supplier").select(F.lit("S").alias("sheet"), k.alias("name"), (k * 9 + 1).alias("r1"), (k * 9 + 4).alias("r2"), (k % 10 + 1).alias("c1"), (k % 10 + 6).alias("c2"))
    return T.memberships(cells, ranges).select("row", "col", "member_of")


@query("SELECT p_brand AS template, count(*) AS cells, count(*) FILTER (WHERE p_size % 7 = 0) AS errors, row_number() OVER (ORDER BY count(*) FILTER (WHERE p_size % 7 = 0) DESC, count(*) DESC, p_brand) AS place FROM part GROUP BY 1")
def run_stats(spark, d):
    values = t(spark, d, "part").select(F.col("p_brand").alias("template"), F.when(F.col("p_size") % 7 == 0, cell(ERROR, s="#DIV/0!")).otherwise(cell(NUMBER, n=F.col("p_retailprice"))).alias("c"))
    return T.error_stats(values).withColumn("place", F.col("place").cast("long"))


@query("""WITH j AS (SELECT o_orderpriority AS sheet, CASE WHEN o_orderkey % 11 = 0 THEN 'stale' WHEN o_orderkey % 7 = 0 THEN 'skipped_unsupported' WHEN o_orderkey % 5 = 0 THEN 'semantics' ELSE 'match' END AS class FROM orders)
SELECT sheet, count(*) AS formulas, count(*) FILTER (WHERE class IN ('match', 'semantics')) AS checked, count(*) FILTER (WHERE class = 'match') AS matched, count(*) FILTER (WHERE class = 'skipped_unsupported') AS skipped, count(*) FILTER (WHERE class = 'stale') AS stale,
round(count(*) FILTER (WHERE class IN ('match', 'semantics')) / count(*), 6) AS coverage, round(count(*) FILTER (WHERE class = 'match') / count(*) FILTER (WHERE class IN ('match', 'semantics')), 6) AS agreement FROM j GROUP BY 1""")
def reconcile_coverage(spark, d):
    k = F.col("o_orderkey")
    judged = t(spark, d, "orders").select(F.col("o_orderpriority").alias("sheet"), F.when(k % 11 == 0, "stale").when(k % 7 == 0, "skipped_unsupported").when(k % 5 == 0, "semantics").otherwise("match").alias("class"))
    return T.coverage(judged).withColumns({"coverage": r("coverage", 6), "agreement": r("agreement", 6)})


@query("""WITH b AS (SELECT p_partkey AS id, p_brand AS sheet, p_partkey * 3 AS r1, CASE WHEN p_partkey % 5 = 0 THEN [0, p_size - 20] ELSE [0] END AS offsets FROM part), w AS (SELECT *, coalesce(lag(offsets) OVER v, lead(offsets) OVER v) AS near FROM b WINDOW v AS (PARTITION BY sheet ORDER BY r1))
SELECT id, offsets[2] AS odd FROM w WHERE len(offsets) = 2 AND offsets[2] <> 0 AND near = [0] OR len(offsets) = 2 AND offsets[2] <> 0 AND near = [0, 0]""")
def own_row_anomalies(spark, d):
    k = F.col("p_partkey")
    blocks = t(spark, d, "part").select(k.alias("id"), F.col("p_brand").alias("sheet"), F.lit(2).alias("c1"), (k * 3).alias("r1"), (k * 3 + 1).alias("r2"), F.when(k % 5 == 0, F.array(F.lit(0), F.col("p_size") - 20)).otherwise(F.array(F.lit(0))).alias("offsets"))
    return T.own_row(blocks).select("id", F.col("odd")[0].alias("odd"))


@query("""WITH a AS (SELECT DISTINCT p_brand AS sheet, p_size AS kind FROM part WHERE p_retailprice < 1400), b AS (SELECT DISTINCT p_brand AS sheet, p_size AS kind FROM part WHERE p_retailprice >= 1200)
SELECT *, 'new' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'resolved' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def anomaly_changes(spark, d):
    p = t(spark, d, "part").select(F.col("p_brand").alias("sheet"), F.col("p_size").alias("kind"), "p_retailprice")
    return T.anomaly_changes(p.where("p_retailprice < 1400"), p.where("p_retailprice >= 1200"), ["sheet", "kind"])


@query("""WITH a AS (SELECT c_mktsegment AS sheet, c_custkey AS key FROM customer WHERE c_acctbal > 0), b AS (SELECT c_mktsegment AS sheet, c_custkey AS key FROM customer WHERE c_nationkey > 4),
x AS (SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) SELECT sheet, change, count(*) AS rows, min(key) AS first, max(key) AS last FROM x GROUP BY 1, 2""")
def rows_added_removed(spark, d):
    c = t(spark, d, "customer").select(F.col("c_mktsegment").alias("sheet"), F.col("c_custkey").alias("key"), "c_acctbal", "c_nationkey")
    return T.row_changes(c.where("c_acctbal > 0").select("sheet", "key"), c.where("c_nationkey > 4").select("sheet", "key"))


@query("""WITH a AS (SELECT p_brand AS sheet, p_type AS template, count(*) AS old_blocks FROM part WHERE p_size < 30 GROUP BY 1, 2), b AS (SELECT p_brand AS sheet, p_type AS template, count(*) AS new_blocks FROM part WHERE p_size >= 20 GROUP BY 1, 2)
SELECT sheet, template, old_blocks, new_blocks, CASE WHEN new_blocks < old_blocks THEN 'merged' ELSE 'split' END AS change FROM a JOIN b USING (sheet, template) WHERE old_blocks <> new_blocks""")
def blocks_merged_split(spark, d):
    p = t(spark, d, "part").select(F.col("p_brand").alias("sheet"), F.col("p_type").alias("template"), "p_size")
    return T.block_changes(p.where("p_size < 30"), p.where("p_size >= 20"))


@query("SELECT s_nationkey::VARCHAR AS sheet, s_suppkey AS r1, s_suppkey + 10 AS r2, s_suppkey + 10 + (s_suppkey % 3) - 1 AS new_r2, s_suppkey % 3 - 1 AS rows FROM supplier WHERE s_suppkey % 3 <> 1")
def inputs_resized(spark, d):
    k = F.col("s_suppkey")
    a = t(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("sheet"), F.lit(1).alias("c1"), k.alias("r1"), (k + 10).alias("r2"))
    return T.resized(a, a.withColumn("r2", F.col("r2") + F.col("r1") % 3 - 1)).drop("c1")


@query("""SELECT p_brand AS sheet, p_size AS r1, p_size + 1 AS r2, p_type AS new_template, count(DISTINCT p_partkey % 4) AS columns, string_agg(DISTINCT chr((65 + p_partkey % 4)::INTEGER) || p_size || ':' || chr((65 + p_partkey % 4)::INTEGER) || (p_size + 1), ', ' ORDER BY chr((65 + p_partkey % 4)::INTEGER) || p_size || ':' || chr((65 + p_partkey % 4)::INTEGER) || (p_size + 1)) AS location FROM part WHERE p_partkey % 3 <> 0 GROUP BY ALL""")
def repair_grouping(spark, d):
    p = t(spark, d, "part").select(F.col("p_brand").alias("sheet"), (F.col("p_partkey") % 4 + 1).alias("c1"), F.col("p_size").alias("r1"), (F.col("p_size") + 1).alias("r2"), F.col("p_type").alias("new_template"), (F.col("p_partkey") % 3 != 0).alias("known"))
    return T.repair_groups(p.distinct()).select("sheet", "r1", "r2", "new_template", "columns", "location")


@query("""WITH b AS (SELECT p_partkey AS id, p_brand AS sheet, p_partkey AS r1, p_partkey + p_size % 25 AS r2, (p_size % 6 + 1) AS width, p_size % 5 AS numbers FROM part)
SELECT id, CASE WHEN numbers = 0 THEN 'labels' WHEN (r2 - r1 + 1) * width <= 64 AND r2 - r1 + 1 <= 8 THEN 'parameters' ELSE 'table' END AS kind, CASE WHEN r1 < min(CASE WHEN r2 - r1 + 1 >= 20 THEN r1 END) OVER (PARTITION BY sheet) THEN 'head' WHEN min(CASE WHEN r2 - r1 + 1 >= 20 THEN r1 END) OVER (PARTITION BY sheet) IS NOT NULL THEN 'body' ELSE 'sheet' END AS section FROM b""")
def inputs_catalogue(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    return T.inputs_catalogue(t(spark, d, "part").select(k.alias("id"), F.col("p_brand").alias("sheet"), k.alias("r1"), (k + size % 25).alias("r2"), F.lit(1).alias("c1"), (size % 6 + 1).alias("c2"), (size % 5).alias("numbers"))).select("id", "kind", "section")


@query("""SELECT o_custkey AS block, count(*) AS cells, round(sum(o_totalprice), 2) AS total, round(sum(o_totalprice) - sum(CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice - 10 ELSE o_totalprice END), 2) AS change, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS changed, CASE WHEN count(*) <= 12 THEN 'metric' ELSE 'table' END AS kind FROM orders GROUP BY 1""")
def outputs_summary(spark, d):
    v = t(spark, d, "orders").select(F.col("o_custkey").alias("block"), F.col("o_orderkey").alias("row"), F.lit(1).alias("col"), F.col("o_totalprice").alias("value"))
    old = v.withColumn("value", F.when(F.col("row") % 4 == 0, F.col("value") - 10).otherwise(F.col("value")))
    return T.outputs_summary(v, old).withColumns({"total": r("total", 2), "change": r("change", 2)})


@query("""SELECT 'LOGIC' AS kind, p_brand AS sheet, p_name AS title FROM part WHERE p_size = 1 UNION ALL SELECT 'DATA', c_mktsegment, c_name FROM customer WHERE c_acctbal < -900 UNION ALL SELECT 'STRUCTURAL', n_name, 'sheet added' FROM nation""")
def changelog_view(spark, d):
    logic = t(spark, d, "part").where("p_size = 1").select(F.col("p_brand").alias("sheet"), F.col("p_name").alias("title"))
    data = t(spark, d, "customer").where("c_acctbal < -900").select(F.col("c_mktsegment").alias("sheet"), F.col("c_name").alias("title"))
    return T.changelog(("LOGIC", logic), ("DATA", data), ("STRUCTURAL", t(spark, d, "nation").select(F.col("n_name").alias("sheet"), F.lit("sheet added").alias("title"))))


# -- entity tables from cells ------------------------------------------------------------------------------------------------


def _book(spark, d):
    """Cells of three sheets: Funds has a row per customer, Perf a row per order (every other name in capitals), Averages a row per nation."""
    n = t(spark, d, "nation")
    c = t(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # nation has a row per country
    text = lambda x: cell(TEXT, s=x)
    number = lambda x: cell(NUMBER, n=x)
    sheet = lambda df, name, row, cells: df.select(F.lit(name).alias("sheet"), row.cast("int").alias("row"), F.posexplode(F.array(*cells)).alias("col", "c")).withColumn("col", F.col("col") + 1)
    k = F.col("c_custkey")
    balance = F.when(k % 7 == 0, text(F.lit("--"))).when(k % 11 == 0, cell(BOOL, n=1.0)).otherwise(number(F.col("c_acctbal")))
    funds = sheet(c, "Funds", k + 1, [text(F.concat(F.lit(" "), "c_name")), text(F.when(k % 9 != 0, F.concat(F.lit("The "), "c_name")).otherwise(" ")), text(F.col("n_name")), balance, text(F.when(k % 4 == 0, "out").otherwise("in")), number(k % 50)])
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == k)
    month = F.when(F.col("o_orderkey") % 5 == 0, text(F.lit("n/a"))).otherwise(number(F.month("o_orderdate")))
    perf = sheet(o, "Perf", F.col("o_orderkey"), [text(F.when(k % 2 == 0, F.upper("c_name")).otherwise(F.col("c_name"))), number(F.col("o_totalprice")), number(F.dayofmonth("o_orderdate")), month])
    means = sheet(n, "Averages", F.col("n_nationkey") + 1, [text(F.col("n_name")), number(F.col("n_regionkey") * 2)])
    return funds.unionByName(perf).unionByName(means)


MAP = {
    "entity": {"sheet": "Funds", "key": "A", "label": "B", "include": ["E", "in"], "universe": ["C", "CHINA"]},
    "dimensions": {"country": {"column": "C"}},
    "measures": {"balance": {"column": "D"}, "spent": {"sheet": "Perf", "key": "A", "column": "B"}, "nothing": {"sheet": "Lost", "key": "A", "column": "B"}},
    "phases": {"sheet": "Perf", "key": "A", "groups": {"up": ["C"], "down": ["D"]}},
    "stats": {"sheet": "Averages", "key": "A", "columns": ["B"]},
}

FIRST_ORDER = "p AS (SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS spent, arg_min(day(o_orderdate), o_orderkey) AS up, arg_min(CASE WHEN o_orderkey % 5 <> 0 THEN month(o_orderdate) ELSE -1 END, o_orderkey) AS down FROM orders GROUP BY 1)"


@query(f"""WITH {FIRST_ORDER} SELECT c_name AS key, CASE WHEN c_custkey % 9 <> 0 THEN 'The ' || c_name ELSE c_name END AS label, (c_custkey + 1)::INTEGER AS row, n_name = 'CHINA' AS inside, n_name AS country, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 THEN c_acctbal END AS balance, spent
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN p ON o_custkey = c_custkey WHERE c_custkey % 4 <> 0""")
def research_table(spark, d):
    cells = _book(spark, d)
    return M.entity_frame(cells, M.resolve(MAP, cells)).drop("phases")


@query(f"""WITH {FIRST_ORDER} SELECT c_name AS key, up::DOUBLE AS up, CASE WHEN down > 0 THEN down END::DOUBLE AS down FROM customer LEFT JOIN p ON o_custkey = c_custkey WHERE c_custkey % 4 <> 0""")
def research_phases(spark, d):
    cells = _book(spark, d)
    return M.entity_frame(cells, M.resolve(MAP, cells)).select("key", F.col("phases")["up:C"].alias("up"), F.col("phases")["down:D"].alias("down"))


@query('SELECT n_name AS category, (n_regionkey * 2)::DOUBLE AS "B" FROM nation')
def research_stats(spark, d):
    cells = _book(spark, d)
    return M.stat_frame(cells, M.resolve(MAP, cells))


@query("SELECT 'measures.nothing: no sheet ' || chr(39) || 'Lost' || chr(39) AS problem")
def research_map_problems(spark, d):
    found = M.resolve(MAP, _book(spark, d)).problems
    return spark.createDataFrame([(p,) for p in found], "problem string")


@query("SELECT c_custkey % 5 AS kind, count(CASE WHEN c_custkey % 5 IN (0, 4) THEN 1 END) AS numbers, count(CASE WHEN c_custkey % 5 IN (0, 1, 4) THEN 1 END) AS texts FROM customer GROUP BY 1")
def cell_values(spark, d):
    """Numbers, texts, blanks, bools, whole numbers."""
    k = F.col("c_custkey") % 5
    c = F.when(k == 0, cell(NUMBER, n=F.col("c_acctbal"))).when(k == 1, cell(TEXT, s=F.col("c_name"))).when(k == 2, cell(TEXT, s=F.lit("  "))).when(k == 3, cell(BOOL, n=1.0)).otherwise(cell(NUMBER, n=F.col("c_custkey")))
    return t(spark, d, "customer").select(k.alias("kind"), c.alias("c")).groupBy("kind").agg(F.count(M.cell_number(F.col("c"))).alias("numbers"), F.count(M.cell_text(F.col("c"))).alias("texts"))


@query("SELECT n_name AS country, count(*) AS n, round(avg(CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 THEN c_acctbal END), 2) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey BETWEEN 2 AND 120 GROUP BY 1")
def pivot_from_cells(spark, d):
    """The area of rows 3 to 121 below a header row that repeats a name."""
    head = spark.createDataFrame([("Funds", 2, c, x) for c, x in enumerate(["name", "name", "country", "balance"], 1)], "sheet string, row int, col int, x string").select("sheet", "row", "col", cell(TEXT, s=F.col("x")).alias("c"))
    cells = _book(spark, d).where("sheet = 'Funds' and row > 2").unionByName(head)
    frame = M.pivot_source(cells, "Funds!$A$2:$D$121")
    return frame.groupBy("country").agg(F.count("name").alias("n"), r(F.avg(F.col("balance").try_cast("double")), 2).alias("mean"))


@query("SELECT p_brand AS k, count(*) AS n, row_number() OVER (ORDER BY lower(p_brand)) AS place FROM part GROUP BY 1")
def pivot_key_order(spark, d):
    """Keys in the order of a pivot's rows; a row per key."""
    p = A.pivot_table(t(spark, d, "part"), ["p_brand"], [("count", "p_partkey", "n")], subtotals=False)
    return p.select(F.col("p_brand").alias("k"), "n", F.row_number().over(Window.orderBy(*A.key_order(F.col("p_brand")))).cast("long").alias("place"))


@query("""WITH v AS (SELECT o_orderpriority AS sheet, o_orderkey AS row, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS computed, o_totalprice AS stored FROM orders), m AS (SELECT sheet, row FROM v WHERE computed <> stored ORDER BY sheet, row LIMIT 2000)
SELECT sheet, row, (SELECT count(*) FROM v WHERE computed <> stored) > 2000 AS truncated FROM m""")
def mismatch_cap(spark, d):
    """The first 2,000 mismatches, and whether there are more."""
    o = t(spark, d, "orders").select(F.col("o_orderpriority").alias("sheet"), F.col("o_orderkey").cast("int").alias("row"), F.lit(1).alias("col"), "o_totalprice", "o_orderkey")
    computed = o.select("sheet", "row", "col", cell(NUMBER, n=F.col("o_totalprice") + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)).alias("c"))
    counts, worst = reconcile(computed, o.select("sheet", "row", "col", cell(NUMBER, n=F.col("o_totalprice")).alias("c")))
    total = counts.where("class not in ('match', 'stale')").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return worst.crossJoin(F.broadcast(total)).select("sheet", F.col("row").cast("long").alias("row"), (F.col("n") > 2000).alias("truncated"))  # one row
