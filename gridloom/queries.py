"""Queries over the driver's tables, one for each operator family, and the same as SQL for DuckDB.

Doubles are rounded on both sides, as sums of floats depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import ensure_checkpoints
from .functions import scalar as S
from .functions.criteria import number_mask, text_mask
from .functions.values import BOOL, EMPTY, NUMBER, TEXT, cell, compare, concat, r15, text, text_to_number
from .operators import aggregates as A
from .operators import joins as J
from .operators import research as R
from .operators import windows as W

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c, digits: int = 4):
    return F.round(c, digits)


# -- criteria and aggregates ---------------------------------------------------------------------------------------------


@query("SELECT count(*) FILTER (WHERE regexp_full_match(lower(p_name), '.*1.')) AS n, count(*) FILTER (WHERE NOT regexp_full_match(lower(p_name), '.*1.')) AS rest FROM part")
def countif_wildcard(spark, d):
    p = t(spark, d, "part")
    return p.agg(A.count_if(text_mask(F.col("p_name"), "*1?")).alias("n"), A.count_if(text_mask(F.col("p_name"), "<>*1?")).alias("rest"))


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_quantity >= 30 AND l_discount < 0.05) AS n FROM lineitem GROUP BY 1")
def countifs_multi(spark, d):
    li = t(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(A.count_if(number_mask(F.col("l_quantity"), ">=30"), number_mask(F.round("l_discount", 2), "<0.05")).alias("n"))


@query("SELECT l_linestatus, round(coalesce(sum(l_extendedprice) FILTER (WHERE lower(l_returnflag) = 'r'), 0), 2) AS total FROM lineitem GROUP BY 1")
def sumif(spark, d):
    return t(spark, d, "lineitem").groupBy("l_linestatus").agg(r(A.sum_if(F.col("l_extendedprice"), text_mask(F.col("l_returnflag"), "R")), 2).alias("total"))


@query("SELECT p_brand, round(avg(p_retailprice) FILTER (WHERE p_size > 48), 4) AS mean, count(*) FILTER (WHERE p_size > 48) AS n FROM part GROUP BY 1")
def averageif(spark, d):
    m = number_mask(F.col("p_size").cast("double"), ">48")
    return t(spark, d, "part").groupBy("p_brand").agg(r(A.average_if(F.col("p_retailprice"), m)).alias("mean"), A.count_if(m).alias("n"))


@query("SELECT l_returnflag, round(sum(l_quantity * l_discount), 4) AS total FROM lineitem GROUP BY 1")
def sumproduct(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(r(A.sum_product(F.col("l_quantity"), F.col("l_discount"))).alias("total"))


@query("""SELECT event_type, count(v) AS n, round(coalesce(sum(v), 0), 4) AS total, round(avg(v), 4) AS mean, coalesce(round(max(v), 4), 0) AS most, coalesce(round(min(v), 4), 0) AS least
FROM (SELECT event_type, CASE WHEN user_id % 5 <> 0 THEN value END AS v FROM events) GROUP BY 1""")
def agg_number_only(spark, d):
    """Cells are numbers, or the text -- for every fifth user: aggregates see numbers only."""
    e = t(spark, d, "events").select("event_type", F.when(F.col("user_id") % 5 == 0, cell(TEXT, s="--")).otherwise(cell(NUMBER, n=F.col("value"))).alias("c"))
    v = A.number_only(F.col("c"))
    return e.groupBy("event_type").agg(F.count(v).alias("n"), r(F.coalesce(F.sum(v), F.lit(0.0))).alias("total"), r(F.avg(v)).alias("mean"), F.coalesce(r(F.max(v)), F.lit(0.0)).alias("most"), F.coalesce(r(F.min(v)), F.lit(0.0)).alias("least"))


@query("SELECT n_regionkey, bool_and(c_acctbal > -900) AS every, bool_or(c_acctbal > 9990) AS some FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def and_or(spark, d):
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("n_regionkey").agg(F.bool_and(F.col("c_acctbal") > -900).alias("every"), F.bool_or(F.col("c_acctbal") > 9990).alias("some"))


# -- scalar functions ----------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'Low' WHEN p_size <= 35 THEN 'Mid' ELSE 'High' END AS band FROM part")
def if_ladder(spark, d):
    size = cell(NUMBER, n=F.col("p_size").cast("double"))
    le = lambda v: compare("<=", size, cell(NUMBER, n=float(v)))
    ladder = S.fn_if(le(10), text(F.lit("Low")), S.fn_if(le(35), text(F.lit("Mid")), text(F.lit("High"))))
    return t(spark, d, "part").select("p_partkey", ladder["s"].alias("band"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN -1 ELSE round(o_totalprice / (o_custkey % 7), 4) END AS share FROM orders")
def iferror_div(spark, d):
    from .functions.values import arithmetic

    q = arithmetic("/", cell(NUMBER, n=F.col("o_totalprice")), cell(NUMBER, n=F.col("o_custkey") % 7))
    return t(spark, d, "orders").select("o_orderkey", r(S.fn_iferror(q, cell(NUMBER, n=-1.0))["n"]).alias("share"))


@query("SELECT p_partkey, strpos(lower(p_name), '1') > 0 AS found, strpos(lower(p_name), 'part')::DOUBLE AS place FROM part")
def isnumber_search(spark, d):
    name = text(F.col("p_name"))
    place = S.fn_search(text(F.lit("PART")), name)
    return t(spark, d, "part").select("p_partkey", (S.fn_isnumber(S.fn_search(text(F.lit("1")), name))["n"] != 0).alias("found"), F.coalesce(F.when(place["k"] == NUMBER, place["n"]), F.lit(0.0)).alias("place"))


@query("SELECT p_partkey, left(p_name, 4) || '-' || p_size || '-' || CASE WHEN p_size > 25 THEN 'TRUE' ELSE 'FALSE' END AS label FROM part")
def left_concat(spark, d):
    size = cell(NUMBER, n=F.col("p_size").cast("double"))
    made = concat(S.fn_left(text(F.col("p_name")), cell(NUMBER, n=4.0)), text(F.lit("-")), size, text(F.lit("-")), compare(">", size, cell(NUMBER, n=25.0)))
    return t(spark, d, "part").select("p_partkey", made["s"].alias("label"))


@query("SELECT o_orderkey, date_diff('day', DATE '1899-12-30', o_orderdate::DATE)::DOUBLE AS serial, year(o_orderdate)::DOUBLE AS y, month(o_orderdate)::DOUBLE AS m, day(o_orderdate)::DOUBLE AS d FROM orders")
def date_parts_serial(spark, d):
    serial = S.serial_of(F.col("o_orderdate").cast("date"))
    parts = [S.fn_date_part(k, cell(NUMBER, n=serial))["n"].alias(k[0].lower()) for k in ("YEAR", "MONTH", "DAY")]
    return t(spark, d, "orders").select("o_orderkey", serial.alias("serial"), *parts)


@query("""SELECT p_partkey, (date_diff('day', DATE '1899-12-30', (make_date(2000 + p_size, 1, 1) + to_months((p_partkey % 30)::INTEGER - 6))::DATE) + (p_partkey % 70) - 1)::DOUBLE AS serial FROM part""")
def date_build(spark, d):
    n = lambda c: cell(NUMBER, n=c.cast("double"))
    made = S.fn_date(n(F.col("p_size") + 2000), n(F.col("p_partkey") % 30 - 5), n(F.col("p_partkey") % 70))
    return t(spark, d, "part").select("p_partkey", made["n"].alias("serial"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN false WHEN p_partkey % 4 = 1 THEN 0 < p_size ELSE p_partkey % 4 = 3 AND p_size < 25 END AS less,
p_partkey % 4 = 3 AND p_size = 25 AS equal FROM part""")
def typed_compare(spark, d):
    """A text, an empty cell, a bool and a number, beside a number: kinds order number < text < bool, an empty cell is 0."""
    size = F.col("p_size").cast("double")
    kind = F.col("p_partkey") % 4
    c = F.when(kind == 0, cell(TEXT, s="--")).when(kind == 1, cell(EMPTY)).when(kind == 2, cell(BOOL, n=1.0)).otherwise(cell(NUMBER, n=size))
    other = F.when(kind == 1, cell(NUMBER, n=size)).otherwise(cell(NUMBER, n=25.0))
    return t(spark, d, "part").select("p_partkey", (compare("<", c, other)["n"] != 0).alias("less"), (compare("=", c, other)["n"] != 0).alias("equal"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size / 100.0 WHEN 1 THEN p_size * 1000.0 ELSE NULL END::DOUBLE AS n FROM part")
def text_numbers(spark, d):
    """Percent signs, thousands separators, and text that is no number."""
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    raw = F.when(k == 0, F.concat(F.lit(" "), size, F.lit("% "))).when(k == 1, F.concat(size, F.lit(",000"))).otherwise(F.concat(size, F.lit(" items")))
    return t(spark, d, "part").select("p_partkey", text_to_number(raw).alias("n"))


# -- joins ---------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3")
def vlookup_exact(spark, d):
    n = t(spark, d, "nation").where("n_regionkey < 3")
    return J.vlookup(t(spark, d, "customer"), F.col("c_nationkey"), n, F.col("n_nationkey"), F.col("n_nationkey"), {"n_name": "nation"}).select("c_custkey", "nation")


@query("""WITH f AS (SELECT p_brand, arg_min(p_name, p_partkey) AS first_part FROM part GROUP BY 1) SELECT DISTINCT lower(p_brand) AS brand, first_part FROM part JOIN f USING (p_brand)""")
def vlookup_first_match(spark, d):
    p = t(spark, d, "part")
    keys = p.select(F.lower("p_brand").alias("brand")).distinct()
    return J.vlookup(keys, F.col("brand"), p, F.col("p_brand"), F.col("p_partkey"), {"p_name": "first_part"})


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' WHEN 'P' THEN 'part' END AS state FROM orders")
def hlookup(spark, d):
    header = spark.createDataFrame([("done", "open", "part")], "f string, o string, p string")
    return J.hlookup(t(spark, d, "orders"), F.col("o_orderstatus"), header, ["f", "o", "p"], "state").select("o_orderkey", "state")


@query("""WITH b AS (SELECT l_suppkey AS k, l_orderkey, l_linenumber, l_shipdate, l_quantity FROM lineitem WHERE l_linenumber = 1),
p AS (SELECT s_suppkey * 100 AS price_at, s_acctbal FROM supplier)
SELECT o_orderkey, round(s_acctbal, 2) AS balance FROM (SELECT o_orderkey, o_totalprice / 20 AS x FROM orders) o ASOF LEFT JOIN p ON o.x >= p.price_at""")
def vlookup_approx(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 20).alias("x"))
    s = t(spark, d, "supplier").select((F.col("s_suppkey") * 100).alias("price_at"), "s_acctbal")
    return J.as_of(o, "x", s, "price_at", "s_acctbal").select("o_orderkey", r("s_acctbal", 2).alias("balance"))


@query("SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'XL' WHEN p_size >= 20 THEN 'L' WHEN p_size >= 5 THEN 'M' END AS band FROM part")
def vlookup_bands(spark, d):
    return J.band_lookup(t(spark, d, "part"), F.col("p_size"), [(5, "M"), (20, "L"), (40, "XL")], "band").select("p_partkey", "band")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE lower(n_name) END AS country, n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def join_casefold_fallback(spark, d):
    n = t(spark, d, "nation")
    c = t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).otherwise(F.lower("n_name")).alias("country"))
    table = n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("at"), F.col("n_regionkey").alias("region"))
    return J.join_with_fallback(c, "country", table, "name", "at", "region").select("c_custkey", "country", "region")


@query("""WITH s AS (SELECT n_nationkey AS nation, n_name AS name FROM nation UNION ALL SELECT 99, 'nowhere'), m AS (SELECT c_nationkey AS nation, count(*) AS members FROM customer WHERE c_nationkey > 5 GROUP BY 1)
SELECT nation, name, coalesce(members, 0) AS members FROM s FULL JOIN m USING (nation)""")
def category_outer_stats(spark, d):
    s = t(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name")).unionByName(spark.createDataFrame([(99, "nowhere")], "nation int, name string"))
    return J.outer_stats(s, t(spark, d, "customer").where("c_nationkey > 5").select(F.col("c_nationkey").alias("nation")), "nation")


# -- entities: customers ranked in their nation by what they ordered in a period -----------------------------------------------


def entities(spark, d, period: int | None = None) -> DataFrame:
    """Customers with spend (null where they ordered nothing), in all or in one half of the years' orders; a nation is a category."""
    o = t(spark, d, "orders")
    if period is not None:
        o = o.where(F.month("o_orderdate") <= 6 if period == 0 else F.month("o_orderdate") > 6)
    spend = o.groupBy("o_custkey").agg(r(F.sum("o_totalprice"), 2).alias("spend"), F.count(F.lit(1)).alias("orders"))
    c = t(spark, d, "customer").join(spend, F.col("c_custkey") == F.col("o_custkey"), "left").join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # nation has a row per country
    return R.entity_table(c, "c_custkey", "c_name", "n_name", "spend", ["c_mktsegment"], ["c_acctbal"])


def entities_by_half(spark, d) -> DataFrame:
    """The same for both halves of the years (half 0 and 1), a row for each, from one scan of the orders."""
    late = F.month("o_orderdate") > 6
    spend = t(spark, d, "orders").groupBy("o_custkey").agg(r(F.sum(F.when(~late, F.col("o_totalprice"))), 2).alias("first"), r(F.sum(F.when(late, F.col("o_totalprice"))), 2).alias("second"))
    c = t(spark, d, "customer").join(spend, F.col("c_custkey") == F.col("o_custkey"), "left").join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # nation has a row per country
    each = c.withColumn("x", F.explode(F.array(F.struct(F.lit(0).alias("half"), F.col("first").alias("spend")), F.struct(F.lit(1).alias("half"), F.col("second").alias("spend"))))).select("*", "x.half", "x.spend")
    return R.entity_table(each, "c_custkey", "c_name", "n_name", "spend", ["c_mktsegment"], ["c_acctbal"], period="half")


def _entities_sql(where: str = "true", name: str = "e") -> str:
    return f"""s_{name} AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS spend FROM orders WHERE {where} GROUP BY 1),
b_{name} AS (SELECT c_custkey AS key, c_name AS label, n_name AS category, spend AS score, c_mktsegment, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN s_{name} ON o_custkey = c_custkey),
k_{name} AS (SELECT *, CASE WHEN score IS NOT NULL THEN rank() OVER (PARTITION BY category ORDER BY score DESC NULLS LAST) END AS rank, count(score) OVER (PARTITION BY category) AS ranked FROM b_{name}),
{name} AS (SELECT *, CASE WHEN ranked < 4 OR rank IS NULL THEN NULL WHEN rank <= ranked * 0.25 THEN 1 WHEN rank <= ranked * 0.5 THEN 2 WHEN rank <= ranked * 0.75 THEN 3 ELSE 4 END AS quartile FROM k_{name})"""


E1, EA, EB = _entities_sql(), _entities_sql("month(o_orderdate) > 6", "a"), _entities_sql("month(o_orderdate) <= 6", "b")
GROUPED = "count(*) AS funds, count(score) AS rated, count(*) FILTER (WHERE quartile = 1) AS q1, count(*) FILTER (WHERE quartile = 2) AS q2, count(*) FILTER (WHERE quartile = 3) AS q3, count(*) FILTER (WHERE quartile = 4) AS q4, round(avg(score), 2) AS value, round(median(rank / ranked), 4) AS median_position, round(count(*) FILTER (WHERE quartile = 1) / nullif(count(quartile), 0), 4) AS q1_share"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"value": r("value", 2), "median_position": r("median_position"), "q1_share": r("q1_share")})


@query(f"WITH {E1} SELECT key, category, rank, ranked FROM e")
def rank_in_group(spark, d):
    return entities(spark, d).select("key", "category", "rank", "ranked")


@query("""SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS above, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS below,
count(*) OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS at_least, count(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS at_most,
count(*) OVER (PARTITION BY p_brand, p_size) AS same, count(*) OVER (PARTITION BY p_brand) - count(*) OVER (PARTITION BY p_brand, p_size) AS others FROM part""")
def rank_ops(spark, d):
    p = t(spark, d, "part")
    for name, op in (("above", ">"), ("below", "<"), ("at_least", ">="), ("at_most", "<="), ("same", "="), ("others", "<>")):
        p = W.countifs_rank(p, ["p_brand"], F.col("p_size"), name, op)
    return p.select("p_partkey", "above", "below", "at_least", "at_most", "same", "others")


@query(f"WITH {E1} SELECT key, quartile::INTEGER AS quartile FROM e")
def quartile_ladder(spark, d):
    return entities(spark, d).select("key", F.col("quartile").cast("int").alias("quartile"))


@query(f"WITH {E1} SELECT key, round(rank / ranked, 6) AS position FROM e")
def position_in_group(spark, d):
    return entities(spark, d).select("key", r(F.col("rank") / F.col("ranked"), 6).alias("position"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS total FROM orders")
def running_total(spark, d):
    return W.running(t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", "x").select("o_orderkey", r("x", 2).alias("total"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS total FROM orders")
def sliding_sum(spark, d):
    return W.sliding(t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", "x", 2, 1).select("o_orderkey", r("x", 2).alias("total"))


@query("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 7) AS mean FROM orders")
def growing_avg(spark, d):
    return W.running(t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", "x", "average").select("o_orderkey", r("x", 7).alias("mean"))


@query("SELECT o_orderkey, lag(o_totalprice) OVER w AS above, lead(o_totalprice, 2) OVER w AS below FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def lag_ref(spark, d):
    o = W.offset_ref(t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", "above", -1)
    return W.offset_ref(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", "below", 2).select("o_orderkey", "above", "below")


@query("""WITH a AS (SELECT p_type, list_sort(list(p_retailprice)) AS v, count(*) AS n FROM part GROUP BY 1),
c AS (SELECT p_type, v, n, i, least(greatest(((i * (n + 1)) // 4), 1), n - 1) AS j FROM a, (SELECT unnest([1, 2, 3]) AS i))
SELECT p_type, i, round((v[j] * (4 - (i * (n + 1) - 4 * j)) + v[j + 1] * (i * (n + 1) - 4 * j)) / 4, 4) AS cut FROM c""")
def quantile_bands_exclusive(spark, d):
    b = W.band_bounds(t(spark, d, "part"), ["p_type"], "p_retailprice")
    return b.select("p_type", F.posexplode(F.array("q1", "q2", "q3")).alias("i", "cut")).select("p_type", (F.col("i") + 1).alias("i"), r("cut").alias("cut"))


@query("""WITH n AS (SELECT *, ceil(count(*) OVER (PARTITION BY p_brand) * 0.25) AS k, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part) SELECT p_partkey, p_size FROM n WHERE r <= k""")
def top_bottom_share(spark, d):
    return W.share_threshold(t(spark, d, "part"), ["p_brand"], "p_size", 0.25).select("p_partkey", "p_size")


@query(f"WITH {E1} SELECT key, category FROM e WHERE rank <= ceil(ranked * 0.1)")
def rank_share(spark, d):
    return entities(spark, d).where(R.predicate([("rank", "top", 0.1)])).select("key", "category")


@query(f"WITH {E1} SELECT key, round(score, 2) AS score FROM e WHERE c_mktsegment = 'BUILDING' AND quartile IN (1, 2) AND contains(lower(label || ' ' || key), '1')")
def scope_filter(spark, d):
    scope = R.Scope.parse('{"dims": {"c_mktsegment": "BUILDING"}, "quartiles": [2, 1], "rated": true, "text": "1"}')
    return R.apply_scope(entities(spark, d), scope).select("key", r("score", 2).alias("score"))


@query(f"""WITH {E1}, v AS (SELECT list_sort(list(c_acctbal)) AS v, count(*) AS n FROM e WHERE score IS NOT NULL),
q AS (SELECT v[(3 * (n + 1)) // 4] AS a, v[(3 * (n + 1)) // 4 + 1] AS b, 3 * (n + 1) - 4 * ((3 * (n + 1)) // 4) AS g FROM v)
SELECT key FROM e, q WHERE c_acctbal > (a * (4 - g) + b * g) / 4""")
def scope_band(spark, d):
    return R.apply_scope(entities(spark, d), R.Scope(bands={"c_acctbal": "b4"})).select("key")


@query(f"WITH {E1} SELECT key, label, rank FROM e ORDER BY rank NULLS LAST, key LIMIT 50 OFFSET 50")
def entity_page(spark, d):
    return R.page(entities(spark, d), "rank", None, 2, 50).select("key", "label", "rank")


@query("""SELECT 'c_mktsegment' AS field, c_mktsegment AS value, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS n FROM customer GROUP BY 2
UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR, (SELECT count(DISTINCT c_nationkey) FROM customer) FROM customer GROUP BY 2""")
def facets(spark, d):
    return A.facets(t(spark, d, "customer"), ["c_mktsegment", "c_nationkey", "c_name"])


@query(f"WITH {E1} SELECT category AS label, {GROUPED} FROM e GROUP BY 1")
def explore_group(spark, d):
    return _rounded(R.explore(entities(spark, d), "category"))


@query(f"""WITH {EA}, {EB}, x AS (SELECT c_mktsegment AS label, count(score) AS rated, avg(score) AS value FROM a GROUP BY 1), y AS (SELECT c_mktsegment AS label, avg(score) AS value FROM b GROUP BY 1)
SELECT label, rated, round(x.value, 2) AS value, round(x.value - y.value, 2) AS change, rated < 4 AS small FROM x LEFT JOIN y USING (label)""")
def explore_change(spark, d):
    out = R.explore_order(R.explore_over(entities_by_half(spark, d), "c_mktsegment", "half", 0, 1), "change", True, 0)
    return out.select("label", "rated", r("value", 2).alias("value"), r("change", 2).alias("change"), "small")


@query(f"WITH {E1} SELECT 'Total' AS label, {GROUPED} FROM e")
def explore_totals(spark, d):
    return _rounded(R.explore_total(entities(spark, d)))


@query(f"""WITH {E1}, s AS (SELECT *, unnest(list_distinct([c_mktsegment, category])) AS member FROM e) SELECT member AS label, {GROUPED} FROM s GROUP BY 1""")
def explore_split_person(spark, d):
    e = entities(spark, d).withColumn("people", F.concat("c_mktsegment", F.lit(", "), "category"))
    return _rounded(R.explore(e, "people", split=","))


@query(f"WITH {E1} SELECT key, score FROM e WHERE quartile = 1 AND c_acctbal > 5000 ORDER BY c_acctbal DESC NULLS LAST, key LIMIT 20")
def insight_filter(spark, d):
    return R.insight_filter(entities(spark, d), [("quartile", "top"), ("c_acctbal", "gt", "$floor")], "c_acctbal", 20, constants={"floor": 5000}).select("key", "score")


@query(f"WITH {E1} SELECT c_mktsegment AS label, count(score) AS n, (count(*) FILTER (WHERE quartile = 1))::DOUBLE AS value FROM e GROUP BY 1")
def insight_count_where(spark, d):
    return R.insight_groups(entities(spark, d), "c_mktsegment", "count_where", [("quartile", "eq", 1)])


@query(f"WITH {E1} SELECT category AS label, count(score) AS n, round(count(*) FILTER (WHERE score > 1000000) / count(score), 4) AS value FROM e GROUP BY 1 HAVING count(score) >= 10")
def insight_hit_rate(spark, d):
    return R.insight_groups(entities(spark, d), "category", "hit_rate", [("score", "gt", 1000000)], least=10).withColumn("value", r("value"))


@query(f"WITH {E1} SELECT category AS label, count(score) AS n, round(avg(c_acctbal), 4) AS value FROM e GROUP BY 1")
def insight_mean(spark, d):
    return R.insight_groups(entities(spark, d), "category", "mean", measure="c_acctbal").withColumn("value", r("value"))


@query(f"WITH {E1} SELECT category AS label, count(score) AS n, round(max(score) - min(score), 2) AS value FROM e GROUP BY 1")
def insight_dispersion(spark, d):
    return R.insight_groups(entities(spark, d), "category", "dispersion").withColumn("value", r("value", 2))


@query(f"WITH {E1} SELECT round(sum(score), 2) AS total, count(score) AS n FROM e WHERE quartile IN (1, 2)")
def insight_aggregate(spark, d):
    return entities(spark, d).where(R.predicate([("quartile", "in", (1, 2))])).agg(r(F.sum("score"), 2).alias("total"), F.count("score").alias("n"))


def _snapshots(spark, d):
    return entities(spark, d, 0).withColumn("period", F.lit(0)).unionByName(entities(spark, d, 1).withColumn("period", F.lit(1)))


@query(f"WITH {EA}, {EB} SELECT a.key, 2::BIGINT AS n FROM a JOIN b USING (key) WHERE a.quartile = 1 AND b.quartile = 1")
def held_every_period(spark, d):
    return R.held_every_period(_snapshots(spark, d))


@query(f"WITH {EA}, {EB} SELECT a.key, b.rank - a.rank AS delta, a.rank AS rank, b.rank AS rank_before FROM a JOIN b USING (key)")
def movement_movers(spark, d):
    return R.movement_over(entities_by_half(spark, d), "half", 0, 1).select("key", "delta", "rank", "rank_before")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE month(o_orderdate) > 6), b AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE month(o_orderdate) <= 6)
SELECT key, 'entry' AS change FROM a WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT key, 'exit' FROM b WHERE key NOT IN (SELECT key FROM a)""")
def entries_exits(spark, d):
    a, b = (entities(spark, d, i).where("score is not null") for i in (1, 0))
    return J.entries_and_exits(a, b, "key")


@query(f"""WITH {EA}, {EB}, m AS (SELECT a.quartile AS q, b.quartile AS p, b.rank - a.rank AS delta FROM a JOIN b USING (key))
SELECT count(*) FILTER (WHERE delta > 0) AS up, count(*) FILTER (WHERE delta < 0) AS down, round(avg(delta) FILTER (WHERE delta > 0), 4) AS mean_up, round(-avg(delta) FILTER (WHERE delta < 0), 4) AS mean_down,
count(*) FILTER (WHERE q = 1 AND p <> 1) AS into_q1, count(*) FILTER (WHERE q <> 1 AND p = 1) AS out_of_q1 FROM m""")
def movement_stats(spark, d):
    return R.movement_stats(R.movement_over(entities_by_half(spark, d), "half", 0, 1)).withColumns({"mean_up": r("mean_up"), "mean_down": r("mean_down")})


@query(f"""WITH {E1} SELECT category, count(*) AS n, count(score) AS rated, count(quartile) AS ranked, count(*) FILTER (WHERE quartile = 1) AS q1, count(*) FILTER (WHERE quartile = 4) AS q4, round(avg(score), 2) AS mean,
CASE WHEN count(score) >= 2 THEN round(max(score) - min(score), 2) END AS spread FROM e GROUP BY 1""")
def category_stats(spark, d):
    return R.category_stats(entities(spark, d)).select("category", "n", "rated", "ranked", "q1", "q4", r("mean", 2).alias("mean"), r("spread", 2).alias("spread"))


@query(f"""WITH {E1}, c AS (SELECT category, count(*) AS n, count(score) AS rated FROM e GROUP BY 1)
SELECT sum(n)::BIGINT AS total, sum(rated)::BIGINT AS rated, sum(n - rated)::BIGINT AS missing, median(n)::DOUBLE AS median_size, max(n) AS largest FROM c""")
def universe_partition(spark, d):
    return R.universe_partition(entities(spark, d)).select("total", "rated", "missing", "median_size", "largest")


# -- pivots --------------------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 4) AS mean FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1")
def pivot_flat(spark, d):
    return A.pivot_table(t(spark, d, "lineitem"), ["l_returnflag"], [("count", "l_orderkey", "n"), ("average", "l_quantity", "mean")], filters={"l_linestatus": ["O"]}, subtotals=False).select("l_returnflag", "n", r("mean").alias("mean"))


@query("""SELECT coalesce(o_orderstatus, 'Total') AS status, count(*) AS n, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, round(max(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 2) AS most
FROM orders GROUP BY ROLLUP (o_orderstatus)""")
def pivot_crosstab(spark, d):
    p = A.pivot_table(t(spark, d, "orders"), ["o_orderstatus"], [("count", "o_orderkey", "n"), ("max", "o_totalprice", "most")], "o_orderpriority")
    return p.select(F.coalesce("o_orderstatus", F.lit("Total")).alias("status"), "n", F.coalesce("1-URGENT_n", F.lit(0)).alias("urgent"), r("1-URGENT_most", 2).alias("most"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, count(*) AS n, (grouping(l_returnflag) + grouping(l_linestatus))::BIGINT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def pivot_subtotals(spark, d):
    return A.pivot_table(t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], [("sum", "l_quantity", "quantity"), ("count", "l_orderkey", "n")]).withColumn("quantity", r("quantity", 2))


@query("""SELECT s_nationkey::VARCHAR AS s_nationkey, round(sum(s_acctbal), 2) AS a, count(s_acctbal) AS b, round(avg(s_acctbal), 4) AS c, round(max(s_acctbal), 4) AS d, round(min(s_acctbal), 4) AS e, count(s_acctbal) AS f,
round(ln(abs(product(s_acctbal / 1000 + 20))), 6) AS g, round(stddev_samp(s_acctbal), 4) AS h, round(var_samp(s_acctbal), 2) AS i, round(stddev_pop(s_acctbal), 4) AS j, round(var_pop(s_acctbal), 2) AS k FROM supplier GROUP BY 1""")
def pivot_all_aggs(spark, d):
    s = t(spark, d, "supplier").withColumn("x", F.col("s_acctbal") / 1000 + 20)
    names = ["sum", "count", "average", "max", "min", "countNums", "product", "stdDev", "var", "stdDevp", "varp"]
    p = A.pivot_table(s, ["s_nationkey"], [(a, "x" if a == "product" else "s_acctbal", c) for a, c in zip(names, "abcdefghijk")], subtotals=False)
    return p.select("s_nationkey", r("a", 2).alias("a"), "b", r("c").alias("c"), r("d").alias("d"), r("e").alias("e"), "f", r(F.ln(F.abs("g")), 6).alias("g"), r("h").alias("h"), r("i", 2).alias("i"), r("j").alias("j"), r("k", 2).alias("k"))


# -- validation, differences, graph ------------------------------------------------------------------------------------------


@query("""SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'data' WHEN o_orderkey % 31 = 0 THEN 'semantics' WHEN o_orderkey % 17 = 0 THEN 'precision' ELSE 'match' END AS class, count(*) AS n FROM orders GROUP BY 1""")
def reconcile_classes(spark, d):
    from .operators.validation import classify

    k = F.col("o_orderkey")
    computed = cell(NUMBER, n=F.col("o_totalprice"))
    cached = F.when(k % 50 == 0, cell(4, s="#N/A")).when(k % 31 == 0, cell(NUMBER, n=F.col("o_totalprice") + 1)).when(k % 17 == 0, cell(NUMBER, n=F.col("o_totalprice") * (1 + 1e-11))).otherwise(computed)
    return t(spark, d, "orders").select(classify(computed, cached).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lower(p_name) AS key, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    from .operators.validation import duplicate_keys as dup

    return dup(t(spark, d, "part"), [], "p_name")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND user_id % 11 = 0")
def stale_cells(spark, d):
    from .operators.validation import stale_cells as stale

    e = t(spark, d, "events")
    cells = e.select("event_id", F.when(F.col("event_type") == "click", F.lit("A1+1")).alias("formula"), F.when(F.col("user_id") % 11 == 0, cell(EMPTY)).otherwise(cell(NUMBER, n=F.col("value"))).alias("cached"))
    return stale(cells, F.col("cached")).select("event_id")


@query("""WITH w AS (SELECT user_id, event_id, event_type, lag(event_type) OVER v AS before, lead(event_type) OVER v AS after FROM events WINDOW v AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id FROM w WHERE before = after AND event_type <> before""")
def pattern_breaks(spark, d):
    from .operators.validation import pattern_breaks as breaks

    return breaks(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id")


@query(f"""WITH a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE month(o_orderdate) <= 6 GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE month(o_orderdate) > 6 GROUP BY 1)
SELECT o_custkey, a.n AS old_value, b.n AS new_value, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (o_custkey) WHERE a.n IS DISTINCT FROM b.n""")
def diff_inputs(spark, d):
    o = t(spark, d, "orders")
    half = lambda m: o.where(m).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return J.keyed_diff(half(F.month("o_orderdate") <= 6), half(F.month("o_orderdate") > 6), ["o_custkey"], "n")


@query("""WITH a AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE month(o_orderdate) <= 6), b AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE month(o_orderdate) > 6)
SELECT *, 'removed' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'added' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'kept' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""")
def set_changes(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderstatus", F.month("o_orderdate").alias("m"))
    a, b = (o.where(x).drop("m") for x in ("m <= 6", "m > 6"))
    mark = lambda df, name: df.withColumn("change", F.lit(name))
    return mark(a.subtract(b), "removed").unionByName(mark(b.subtract(a), "added")).unionByName(mark(a.intersect(b), "kept"))


@query("""WITH o AS (SELECT c_nationkey AS g, floor(c_acctbal)::BIGINT AS lo, floor(c_acctbal)::BIGINT + 50 AS hi, c_mktsegment AS key FROM customer),
n AS (SELECT g, lo + 10 AS lo, hi + 10 AS hi, key FROM o),
p AS (SELECT g, lo AS x FROM o UNION SELECT g, hi FROM o UNION SELECT g, lo FROM n UNION SELECT g, hi FROM n), c AS (SELECT g, x AS lo, lead(x) OVER (PARTITION BY g ORDER BY x) AS hi FROM p),
a AS (SELECT c.g, c.lo, c.hi, min(o.key) AS old_key FROM c JOIN o ON o.g = c.g AND o.lo <= c.lo AND c.hi <= o.hi GROUP BY ALL), b AS (SELECT c.g, c.lo, c.hi, min(n.key) AS new_key FROM c JOIN n ON n.g = c.g AND n.lo <= c.lo AND c.hi <= n.hi GROUP BY ALL)
SELECT g, lo, hi, old_key, new_key, CASE WHEN old_key IS NULL THEN 'added' WHEN new_key IS NULL THEN 'removed' WHEN old_key = new_key THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b USING (g, lo, hi)""")
def interval_sweep(spark, d):
    """All customers: fifty units of balance by segment, before and after a rise of ten."""
    lo = F.floor("c_acctbal")
    old = t(spark, d, "customer").select(F.col("c_nationkey").alias("g"), lo.alias("lo"), (lo + 50).alias("hi"), F.col("c_mktsegment").alias("key"))
    return J.interval_sweep(old, old.withColumns({"lo": F.col("lo") + 10, "hi": F.col("hi") + 10}), ["g"], "key").select("g", "lo", "hi", "old_key", "new_key", "change")


@query("""WITH w AS (SELECT DISTINCT event_type, user_id, user_id - dense_rank() OVER (PARTITION BY event_type ORDER BY user_id) AS g FROM events) SELECT event_type, min(user_id) AS lo, max(user_id) AS hi, count(*) AS n FROM w GROUP BY event_type, g""")
def islands_rects(spark, d):
    return W.islands(t(spark, d, "events"), ["event_type"], "user_id")


@query("""WITH p AS (SELECT p_partkey AS id, p_type AS sheet, p_brand, p_size AS r1, floor(p_retailprice)::BIGINT AS c1 FROM part)
SELECT DISTINCT w.id AS source, x.id AS target FROM p w JOIN p x ON w.sheet = x.sheet AND w.r1 <= x.r1 AND x.r1 <= w.r1 + 2 AND w.c1 <= x.c1 AND x.c1 <= w.c1 + 10 WHERE w.p_brand < 'Brand#3' AND x.p_brand >= 'Brand#3'""")
def rect_overlap_edges(spark, d):
    """All parts: writers and readers by brand, in rectangles of size and price."""
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("sheet"), "p_brand", F.col("p_size").alias("r1"), F.floor("p_retailprice").alias("c1"))
    writers = p.where("p_brand < 'Brand#3'").withColumns({"r2": F.col("r1") + 2, "c2": F.col("c1") + 10})
    return J.overlap_edges(writers, p.where("p_brand >= 'Brand#3'").withColumns({"r2": F.col("r1"), "c2": F.col("c1")}))


@query("""WITH RECURSIVE n AS (SELECT 1::BIGINT AS node UNION SELECT l_partkey FROM lineitem JOIN n ON l_orderkey = node) SELECT node FROM n""")
def reachability(spark, d):
    """All line items: an order leads to its parts, and a part to the order of its number."""
    ensure_checkpoints(spark)
    e = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"))
    return J.reachable(e, spark.createDataFrame([(1,)], "node long"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def latest_per_key(spark, d):
    return J.latest_per_key(t(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 15 = 0 THEN 2.0 WHEN c_custkey % 3 = 0 THEN 1.0 ELSE c_acctbal END AS value, CASE WHEN c_custkey % 15 = 0 THEN 2 WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS layer FROM customer""")
def overlay_latest_wins(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("value"))
    return J.overlay(c, c.where("c_custkey % 3 = 0").withColumn("value", F.lit(1.0)), c.where("c_custkey % 15 = 0").withColumn("value", F.lit(2.0)), keys=["c_custkey"], values=["value"])


@query("""WITH n AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) - 1 AS i, ceil(count(*) OVER (PARTITION BY o_orderstatus) / 400) AS k FROM orders) SELECT o_orderkey, o_orderstatus FROM n WHERE i % k = 0""")
def series_downsample(spark, d):
    return W.downsample(t(spark, d, "orders"), ["o_orderstatus"], ["o_orderdate", "o_orderkey"], 400).select("o_orderkey", "o_orderstatus")


@query(f"""WITH {E1}, p AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY rank NULLS LAST, key) AS place FROM e), m AS (SELECT category, place FROM p WHERE key = 77)
SELECT p.key, p.place FROM p JOIN m USING (category) WHERE p.place <= 5 OR abs(p.place - m.place) <= 2""")
def peers_window(spark, d):
    return W.peers(entities(spark, d), ["category"], [F.col("rank").asc_nulls_last(), F.col("key")], F.col("key") == 77).select("key", F.col("place").cast("long").alias("place"))


@query(f"WITH {E1} SELECT key, rank() OVER (PARTITION BY category ORDER BY c_acctbal) AS place FROM e")
def category_rank(spark, d):
    return W.countifs_rank(entities(spark, d), ["category"], r15(F.col("c_acctbal")), "place", "<").select("key", "place")


@query("""WITH w AS (SELECT *, CASE WHEN event_type = 'purchase' THEN event_id END AS label FROM events) SELECT event_id, last_value(label IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS nearest FROM w""")
def nearest_label(spark, d):
    e = t(spark, d, "events").withColumn("label", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return W.nearest_label(e, ["user_id"], "event_id", "label", "nearest").select("event_id", "nearest")


