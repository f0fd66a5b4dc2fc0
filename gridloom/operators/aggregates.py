"""Conditional and ordered aggregates, group summaries, pivots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import BOOL, EMPTY, ERROR, NUMBER


def ordered_sum(order: Column, value: Column) -> Column:
    """A sum that adds one double at a time in ``order``: the same bits on any partitioning. Holds its group in memory, so it is for groups of a sheet's size."""
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x["v"])


def number_only(c: Column) -> Column:
    """The number of number cells, else null: what SUM and its kin see of a range."""
    return F.when(c["k"] == NUMBER, c["n"])


def range_summary(order: Column, c: Column) -> Column:
    """One struct with everything the range functions need of a group of cells."""
    failed = F.min_by(F.when(c["k"] == ERROR, c), F.when(c["k"] == ERROR, order))
    truthy = F.when(c["k"].isin(NUMBER, BOOL), c["n"] != 0)
    return F.struct(
        ordered_sum(order, number_only(c)).alias("sum"), F.count(number_only(c)).alias("count"), F.min(number_only(c)).alias("min"), F.max(number_only(c)).alias("max"),
        failed.alias("error"), F.count(F.when(c["k"] != EMPTY, 1)).alias("filled"), F.bool_and(truthy).alias("every"), F.bool_or(truthy).alias("some"),
    )


def summary_of_parts(at: Column, part: Column) -> Column:
    """The ``range_summary`` of a range from those of its parts, in the parts' order ``at``. Parts of fixed places make the same bits on any partitioning, and no task holds a whole range."""
    return F.struct(
        ordered_sum(at, part["sum"]).alias("sum"), F.sum(part["count"]).alias("count"), F.min(part["min"]).alias("min"), F.max(part["max"]).alias("max"),
        F.min_by(part["error"], F.when(part["error"].isNotNull(), at)).alias("error"), F.sum(part["filled"]).alias("filled"), F.bool_and(part["every"]).alias("every"), F.bool_or(part["some"]).alias("some"),
    )


def count_if(*masks: Column) -> Column:
    return F.count_if(reduce(lambda a, b: a & b, masks)).cast("long")


def sum_if(value: Column, *masks: Column) -> Column:
    return F.coalesce(F.sum(F.when(reduce(lambda a, b: a & b, masks), value)), F.lit(0.0))


def average_if(value: Column, *masks: Column) -> Column:
    """Null stands for the division by zero of no match."""
    return F.avg(F.when(reduce(lambda a, b: a & b, masks), value))


def sum_product(*values: Column) -> Column:
    """Products row by row; null counts as 0."""
    return F.sum(reduce(lambda a, b: a * b, (F.coalesce(v, F.lit(0.0)) for v in values)))


#: Pivot aggregations by name.
PIVOT = {
    "sum": F.sum, "count": F.count, "average": F.avg, "max": F.max, "min": F.min, "product": F.product, "stdDev": F.stddev_samp, "var": F.var_samp, "stdDevp": F.stddev_pop, "varp": F.var_pop,
    "countNums": lambda c: F.count(F.col(c).try_cast("double") if isinstance(c, str) else c.try_cast("double")),
}


def display(c: Column) -> Column:
    """A pivot key as text: nulls and blanks are (blank)."""
    return F.when(c.isNull() | (F.trim(c.cast("string")) == ""), F.lit("(blank)")).otherwise(c.cast("string"))


def key_order(c: Column) -> list[Column]:
    """Numbers first, then text without case, (blank) last."""
    n = c.try_cast("double")
    kind = F.when(c == "(blank)", 2).when(n.isNotNull(), 0).otherwise(1)
    return [kind.asc(), n.asc_nulls_last(), F.lower(c).asc()]


#: Keys of a cross-tab's column field, at most.
WIDEST = 1000


def pivot_table(df: DataFrame, rows: list[str], values: list[tuple[str, str, str]], column: str | None = None, filters: dict[str, list[str]] | None = None, subtotals: bool = True) -> DataFrame:
    """Groups, cross-tabs, subtotals and the grand total in one pass.

    ``values``: (aggregation, field, output name). With ``column``, each value has a column per key of it, named <key>_<name>, and <name> for the
    whole row; more than ``WIDEST`` keys are refused. ``level`` counts the row fields that are summed over: 0 is a group, len(rows) the grand total. Subtotals and totals are
    recomputed from members.
    """
    for field, chosen in (filters or {}).items():
        if chosen:
            df = df.where(display(F.col(field)).isin(*chosen))
    for r in rows:
        df = df.withColumn(r, display(F.col(r)))
    aggs = [PIVOT[a](F.col(f)).alias(n) for a, f, n in values]
    if column:
        keys = [r[0] for r in df.select(display(F.col(column)).alias("k")).distinct().orderBy(*key_order(F.col("k"))).limit(WIDEST + 1).collect()]
        if len(keys) > WIDEST:
            raise ValueError(f"{column} has more than {WIDEST} keys, too many for a column each; make it a row field")
        shown = display(F.col(column))
        aggs += [PIVOT[a](F.when(shown == k, F.col(f))).alias(f"{k}_{n}") for k in keys for a, f, n in values]
    if not subtotals:
        return df.groupBy(*rows).agg(*aggs).withColumn("level", F.lit(0).cast("long"))
    level = reduce(lambda a, b: a + b, (F.grouping(r).cast("long") for r in rows), F.lit(0).cast("long"))
    return df.rollup(*rows).agg(*aggs, level.alias("level"))


def field_kind(df: DataFrame, field: str, share: float = 0.8) -> str:
    """number where at least ``share`` of what is present is numeric."""
    r = df.agg(F.count(field).alias("n"), F.count(F.col(field).cast("string").try_cast("double")).alias("k")).first()
    return "number" if r["n"] and r["k"] >= share * r["n"] else "text"


def facets(df: DataFrame, fields: list[str], most: int = 400) -> DataFrame:
    """Distinct values of each field, sorted; fields with more than ``most`` are left out."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("x")).select("x.*").where("value is not null").distinct()
    kept = long.groupBy("field").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most)
    return long.join(F.broadcast(kept), "field").select("field", "value", "n")
