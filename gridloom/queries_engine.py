"""Queries for formulas, models, runs and differences: orders make a sheet of a row each, with copied formulas beside them, and SQL says what these must give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import ensure_checkpoints
from .functions.values import CELL, EMPTY, NUMBER, TEXT, cell
from .plans import diff as D
from .plans import run as R
from .plans.model import derive, function_inventory
from .queries import query, r, t

#: Letter, formula (``{r}`` its row, ``{a}`` the row above, ``{n}`` the last row) of each formula column of the sheet Orders.
COLUMNS = {
    "C": "A{r}*Rates!$B$1", "D": 'IF(C{r}>Rates!$B$2,"big",IF(C{r}>5000,"middle","small"))', "E": "SUM(A$2:A{r})", "F": 'IFERROR(VLOOKUP(B{r},Codes!$A$1:$B$4,2,FALSE),"none")',
    "G": 'COUNTIFS($D$2:$D${n},D{r},$A$2:$A${n},">"&A{r})+1', "H": "AVERAGE(A{a}:A{r})", "I": 'B{r}&"-"&D{r}',
}


def workbook(spark, d, changed_from: int | None = None, columns: str = "CDEFGHI") -> DataFrame:
    """Orders: A price (whole), B priority, formulas in ``columns``; Codes: points of three priorities; Rates: a rate, a threshold; Totals: three formulas. From row ``changed_from`` on, column C has another rate."""
    o = t(spark, d, "orders").select((F.col("o_orderkey") + 2).cast("int").alias("row"), F.round("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    n = o.agg(F.max("row")).first()[0]  # one row
    o = o.repartitionByRange(1 + n // 50_000, "row")  # a file of few row groups would make all cells in as few tasks

    def formula(text: str):
        parts = [F.lit(text)]
        for mark, value in (("{r}", F.col("row")), ("{a}", F.col("row") - 1), ("{n}", F.lit(n))):
            parts[0] = F.replace(parts[0], F.lit(mark), value.cast("string"))
        return parts[0]

    constants = [F.struct(F.lit(1).alias("col"), F.lit(None).cast("string").alias("formula"), cell(NUMBER, n=F.col("price")).alias("c")), F.struct(F.lit(2).alias("col"), F.lit(None).cast("string").alias("formula"), cell(TEXT, s=F.col("priority")).alias("c"))]
    made = []
    for k, (letter, text) in enumerate(COLUMNS.items(), 3):
        if letter not in columns:
            continue
        said = formula(text)
        if letter == "C" and changed_from:
            said = F.when(F.col("row") >= changed_from, formula("A{r}*0.5")).otherwise(said)
        made.append(F.struct(F.lit(k).alias("col"), said.alias("formula"), cell(EMPTY).alias("c")))
    sheet = o.select(F.lit("Orders").alias("sheet"), "row", F.explode(F.array(*constants, *made)).alias("x")).select("sheet", "row", "x.col", "x.formula", "x.c")
    fixed = [("Codes", i, 1, None, (TEXT, None, x)) for i, x in enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"), 1)] + [("Codes", i, 2, None, (NUMBER, float(10 * i), None)) for i in range(1, 5)]
    fixed += [("Rates", 1, 2, None, (NUMBER, 0.1, None)), ("Rates", 2, 2, None, (NUMBER, 20000.0, None))]
    fixed += [("Totals", 1, 1, f"SUM(Orders!A2:A{n})", (EMPTY, None, None)), ("Totals", 2, 1, f'COUNTIF(Orders!D2:D{n},"big")', (EMPTY, None, None)), ("Totals", 3, 1, f'SUMIF(Orders!D2:D{n},"small",Orders!A2:A{n})', (EMPTY, None, None))]
    few = spark.createDataFrame(fixed, f"sheet string, row int, col int, formula string, c {CELL}")
    return sheet.unionByName(few).withColumn("format", F.lit(None).cast("string"))


NAMES = {"Rate": "Rates!$B$1"}

ORDERS = """o AS (SELECT (o_orderkey + 2)::INTEGER AS row, round(o_totalprice) AS price, o_orderpriority AS priority FROM orders), v AS (SELECT *, price * {rate} AS tax FROM o), w AS (SELECT *, CASE WHEN tax > 20000 THEN 'big' WHEN tax > 5000 THEN 'middle' ELSE 'small' END AS size FROM v)"""
VALUES = f"""WITH {ORDERS.format(rate="0.1::DOUBLE")}
SELECT 'Orders' AS sheet, row, 3 AS col, round(tax, 4) AS n, NULL AS s FROM w UNION ALL SELECT 'Orders', row, 4, NULL, size FROM w
UNION ALL SELECT 'Totals', 1, 1, sum(price), NULL FROM w UNION ALL SELECT 'Totals', 2, 1, count(*) FILTER (WHERE size = 'big'), NULL FROM w UNION ALL SELECT 'Totals', 3, 1, coalesce(sum(price) FILTER (WHERE size = 'small'), 0), NULL FROM w"""


def _plain(values: DataFrame) -> DataFrame:
    return values.select("sheet", "row", "col", r(F.col("c.n"), 4).alias("n"), F.col("c.s").alias("s"))


@query(VALUES)
def engine_full_run(spark, d):
    """Every formula cell of two copied columns and three totals: arithmetic with a named rate, nested conditions, conditional sums."""
    ensure_checkpoints(spark)
    cells = workbook(spark, d, columns="CD").checkpoint()
    return _plain(R.run(cells, derive(cells, NAMES)))


@query(f"""WITH {ORDERS.format(rate="0.1::DOUBLE")}, x AS (SELECT *, CASE WHEN tax > 9000 THEN 'big' WHEN tax > 5000 THEN 'middle' ELSE 'small' END AS now FROM v)
SELECT 'Orders' AS sheet, row, 4 AS col, NULL::DOUBLE AS n, now AS s FROM x UNION ALL SELECT 'Totals', 2, 1, count(*) FILTER (WHERE now = 'big'), NULL FROM x UNION ALL SELECT 'Totals', 3, 1, coalesce(sum(price) FILTER (WHERE now = 'small'), 0), NULL FROM x""")
def engine_what_if(spark, d):
    """The threshold is lowered: only what it reaches is computed, over a baseline of stored values."""
    ensure_checkpoints(spark)
    cells = workbook(spark, d, columns="CD").checkpoint()
    model = derive(cells, NAMES)
    return _plain(R.run(cells, model, {"Rates!B2": 9000.0}, R.run(cells, model)))


@query("""WITH n AS (SELECT max(o_orderkey) + 2 AS n FROM orders) SELECT sheet || '!' || CASE WHEN sheet = 'Orders' THEN chr(64 + k::INTEGER) || '2:' || chr(64 + k::INTEGER) || n ELSE 'A' || k END AS area, sheet FROM n, (SELECT 'Orders' AS sheet, unnest(range(3, 10)) AS k UNION ALL SELECT 'Totals', unnest(range(1, 4)))""")
def model_blocks(spark, d):
    """Copies of one formula are one block, whatever the number of rows."""
    cells = workbook(spark, d)
    return spark.createDataFrame([(b.rect.a1(), b.rect.sheet) for b in derive(cells, NAMES).blocks], "area string, sheet string")


@query("""WITH n AS (SELECT max(o_orderkey) + 2 AS n FROM orders), e AS (SELECT unnest([('C', 'D'), ('D', 'G'), ('D', 'I'), ('D', '2'), ('D', '3')]) AS e), a AS (SELECT CASE WHEN x IN ('2', '3') THEN 'Totals!A' || x ELSE 'Orders!' || x || '2:' || x || n END AS area, x FROM n, (SELECT unnest(['C', 'D', 'G', 'I', '2', '3']) AS x))
SELECT s.area AS source, g.area AS target FROM e JOIN a s ON s.x = e[1] JOIN a g ON g.x = e[2]""")
def model_edges(spark, d):
    """Which block reads which."""
    m = derive(workbook(spark, d), NAMES)
    area = {b.id: b.rect.a1() for b in m.blocks}
    return spark.createDataFrame([(area[a], area[b]) for a, b in m.edges], "source string, target string")


@query("""WITH n AS (SELECT count(*) AS n FROM orders) SELECT f AS function, CASE WHEN k = 0 THEN n ELSE k END AS formulas FROM n, (VALUES ('IF', 0), ('IFERROR', 0), ('VLOOKUP', 0), ('COUNTIFS', 0), ('AVERAGE', 0), ('COUNTIF', 1), ('SUMIF', 1)) AS x(f, k) UNION ALL SELECT 'SUM', n + 1 FROM n""")
def model_functions(spark, d):
    return function_inventory(workbook(spark, d)).select("function", "formulas")


@query("SELECT 'Orders' AS sheet, 3 AS col, 101 AS lo, (max(o_orderkey) + 3)::INTEGER AS hi, 'changed' AS change FROM orders")
def diff_templates(spark, d):
    """From row 101 on, one column has another formula: one change, of one interval of rows."""
    old, new = (derive(workbook(spark, d, row), NAMES) for row in (None, 101))
    return D.template_changes(old, new, spark).select("sheet", "col", "lo", "hi", "change")


@query("""SELECT 'Orders' AS sheet, (o_orderkey + 2)::INTEGER AS row, 1 AS col, CASE WHEN o_orderkey % 10 = 0 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 7 = 0""")
def diff_inputs_of_cells(spark, d):
    """Every tenth price is gone, and every seventh of the others is higher by one."""
    old = workbook(spark, d)
    key, price = F.col("row") - 2, (F.col("sheet") == "Orders") & (F.col("col") == 1)
    new = old.where(~(price & (key % 10 == 0))).withColumn("c", F.when(price & (key % 7 == 0), cell(NUMBER, n=F.col("c.n") + 1)).otherwise(F.col("c")))
    return D.input_changes(old, new).select("sheet", "row", "col", "change")


@query("""WITH n AS (SELECT max(o_orderkey) + 2 AS n FROM orders) SELECT 'Totals!A1' AS cell, round(sum(round(o_totalprice)), 2) AS value, count(*) AS reads, '=SUM(Orders!A2:A' || (SELECT n FROM n) || ')' AS formula FROM orders""")
def cell_lineage(spark, d):
    """A total explained: its formula, its value computed again, and how many cells it reads."""
    ensure_checkpoints(spark)
    cells = workbook(spark, d).where("sheet in ('Totals', 'Orders') and (sheet = 'Orders' and col <= 2 or row = 1)").checkpoint()
    model = derive(cells, {})
    got = R.lineage(R.run(cells, model), cells, model, "Totals!A1")
    return spark.createDataFrame([(got["cell"], round(got["value"], 2), got["reads"][0]["cells"], got["formula"])], "cell string, value double, reads long, formula string")
