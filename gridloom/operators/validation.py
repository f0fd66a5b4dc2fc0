"""Reconciliation and structural anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import EMPTY, ERROR, NUMBER, r15


def values_equal(a: Column, b: Column) -> Column:
    """Numbers at 15 significant digits; text, bools and errors exactly."""
    numbers = (a["k"] == NUMBER) & (b["k"] == NUMBER)
    return F.when(numbers, r15(a["n"]) == r15(b["n"])).otherwise((a["k"] == b["k"]) & a["n"].eqNullSafe(b["n"]) & a["s"].eqNullSafe(b["s"]))


def classify(computed: Column, cached: Column) -> Column:
    """match; precision (1e-9 relative or 1e-12 absolute); data (an error on one side only); semantics."""
    numbers = (computed["k"] == NUMBER) & (cached["k"] == NUMBER)
    gap = F.abs(computed["n"] - cached["n"])
    near = (gap <= 1e-12) | (gap <= 1e-9 * F.greatest(F.abs(computed["n"]), F.abs(cached["n"])))
    one_error = (computed["k"] == ERROR) != (cached["k"] == ERROR)
    return F.when(values_equal(computed, cached), "match").when(numbers & near, "precision").when(one_error, "data").otherwise("semantics")


def reconcile(computed: DataFrame, cached: DataFrame, most: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(counts by sheet and class, the first ``most`` mismatches). Both have sheet, row, col and cell ``c``; formulas without a cached value are stale."""
    both = computed.select("sheet", "row", "col", F.col("c").alias("computed")).join(cached.select("sheet", "row", "col", F.col("c").alias("cached")), ["sheet", "row", "col"], "left")
    stale = F.col("cached").isNull() | (F.col("cached.k") == EMPTY)
    judged = both.withColumn("class", F.when(stale, "stale").otherwise(classify(F.col("computed"), F.col("cached"))))
    counts = judged.groupBy("sheet", "class").agg(F.count(F.lit(1)).alias("n"))
    return counts, judged.where(~F.col("class").isin("match", "stale")).orderBy("sheet", "col", "row").limit(most)


def status(counts: dict[str, int]) -> str:
    """passed, passed_with_warnings or failed, of counts by class."""
    checked = sum(v for k, v in counts.items() if k != "stale")
    hard = counts.get("data", 0) + counts.get("semantics", 0)
    if not checked or hard or counts.get("precision", 0) / checked > 0.001:
        return "failed"
    return "passed_with_warnings" if counts.get("precision") or counts.get("stale") else "passed"


def duplicate_keys(df: DataFrame, group: list[str], key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(*group, F.lower(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def stale_cells(df: DataFrame, cached: Column, formula: str = "formula") -> DataFrame:
    return df.where(F.col(formula).isNotNull() & (cached["k"] == EMPTY))


def pattern_breaks(df: DataFrame, group: list[str], order: list[str], key: str) -> DataFrame:
    """Rows whose neighbours agree with one another and not with them."""
    w = Window.partitionBy(*group).orderBy(*order)
    around = df.withColumn("__b", F.lag(key).over(w)).withColumn("__a", F.lead(key).over(w))
    return around.where((F.col("__b") == F.col("__a")) & (F.col(key) != F.col("__b"))).drop("__a", "__b")


def fragments(blocks: DataFrame, few: int = 2, many: int = 20) -> DataFrame:
    """Blocks (sheet, c1, c2, r1, r2, template) of at most ``few`` rows between two blocks of ``many`` or more of one template."""
    each = blocks.withColumn("c", F.explode(F.sequence("c1", "c2")))
    w = Window.partitionBy("sheet", "c").orderBy("r1")
    side = lambda f, n: f(F.struct(F.col("template").alias("t"), (F.col("r2") - F.col("r1") + 1).alias("rows"), F.col("r1").alias("r1"), F.col("r2").alias("r2")), n).over(w)
    near = each.withColumn("up", side(F.lag, 1)).withColumn("down", side(F.lead, 1))
    ok = (F.col("r2") - F.col("r1") < few) & (F.col("up.t") == F.col("down.t")) & (F.col("up.t") != F.col("template")) & (F.col("up.rows") >= many) & (F.col("down.rows") >= many) & (F.col("up.r2") + 1 == F.col("r1")) & (F.col("r2") + 1 == F.col("down.r1"))
    return near.where(ok).select("sheet", "c", "r1", "r2", "template", F.col("up.t").alias("around")).distinct()
