"""Ranks, ladders, bands, running and sliding aggregates, islands, peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def countifs_rank(df: DataFrame, group: list[str], value: Column, name: str = "rank", op: str = ">") -> DataFrame:
    """The count of rows in the group whose value stands in relation ``op`` to mine (plus 1 for > and <, as a rank). Null values are text
    such as "--": they have none and aren't counted. Sorted windows replace the self join, which is quadratic in the group."""
    v = F.when(value.isNotNull(), value)
    some = Window.partitionBy(*group, v.isNull())
    up, down = some.orderBy(v.asc()), some.orderBy(v.desc())
    total = F.count(v).over(some)
    below, above = F.rank().over(up) - 1, F.rank().over(down) - 1
    made = {">": above + 1, "<": below + 1, ">=": total - below, "<=": total - above, "=": total - below - above, "<>": below + above}[op]
    return df.withColumn(name, F.when(value.isNotNull(), made.cast("long")))


def quartile_ladder(rank: Column, n: Column, least: int = 4) -> Column:
    """1 to 4 by rank <= n/4, n/2, 3n/4; null where fewer than ``least`` are ranked."""
    return F.when((n < least) | rank.isNull(), None).when(rank <= n * 0.25, 1).when(rank <= n * 0.5, 2).when(rank <= n * 0.75, 3).otherwise(4)


def exclusive_quantiles(values: Column, parts: int = 4) -> Column:
    """The cut points of a sorted array's n-quantiles, by the exclusive method, as an array; null for fewer than two values."""
    n = F.size(values)
    j = lambda i: F.least(F.greatest(F.floor(i * (n + 1) / parts).cast("int"), F.lit(1)), n - 1)
    cut = lambda i: (F.element_at(values, j(i)) * (parts - (i * (n + 1) - parts * j(i))) + F.element_at(values, j(i) + 1) * (i * (n + 1) - parts * j(i))) / parts
    return F.when(n >= 2, F.array(*(cut(F.lit(i)) for i in range(1, parts))))


def band_bounds(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """q1, q2, q3 of each group's non-null values. Sorting happens in each group's array; for groups of a category's size."""
    q = df.where(F.col(value).isNotNull()).groupBy(*group).agg(exclusive_quantiles(F.array_sort(F.collect_list(value))).alias("q"))
    return q.select(*group, *(F.col("q")[i].alias(f"q{i + 1}") for i in range(3)))


def band(value: Column, q1: Column, q2: Column, q3: Column) -> Column:
    return F.when(value <= q1, "b1").when(value <= q2, "b2").when(value <= q3, "b3").when(value.isNotNull(), "b4")


def share_threshold(df: DataFrame, group: list[str], value: str, fraction: float, top: bool = True, least: int = 4) -> DataFrame:
    """Rows in the top (or bottom) share of their group by a value threshold: the k-th value, k = max(1, ceil(n * fraction)). Ties at the threshold are all in; groups of fewer than ``least`` have none."""
    w = Window.partitionBy(*group).orderBy(F.col(value).desc() if top else F.col(value).asc())
    rated = df.where(F.col(value).isNotNull())
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    k = F.greatest(F.lit(1), F.ceil(n * fraction - 1e-9)).cast("int")
    return rated.withColumn("__n", n).withColumn("__k", k).withColumn("__r", F.rank().over(w)).where(F.col("__n") >= least).where(F.col("__r") <= F.col("__k")).drop("__n", "__k", "__r")


def running(df: DataFrame, group: list[str], order: list[str], value: str, name: str, kind: str = "sum") -> DataFrame:
    """Growing range: from the group's first row to this one."""
    fn = {"sum": F.sum, "average": F.avg, "count": F.count, "max": F.max, "min": F.min}[kind]
    return df.withColumn(name, fn(value).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def sliding(df: DataFrame, group: list[str], order: list[str], value: str, name: str, before: int, after: int, kind: str = "sum") -> DataFrame:
    """Fixed-size window around each row; outside the group there is nothing."""
    fn = {"sum": F.sum, "average": F.avg, "count": F.count, "max": F.max, "min": F.min}[kind]
    return df.withColumn(name, fn(value).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(-before, after)))


def offset_ref(df: DataFrame, group: list[str], order: list[str], value: str, name: str, offset: int) -> DataFrame:
    """The value ``offset`` rows away (negative: above)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.lag(value, -offset).over(w) if offset < 0 else F.lead(value, offset).over(w))


def islands(df: DataFrame, group: list[str], at: str) -> DataFrame:
    """Maximal runs of consecutive integers of each group: lo, hi, n."""
    w = Window.partitionBy(*group).orderBy(at)
    return df.select(*group, at).distinct().withColumn("__g", F.col(at) - F.row_number().over(w)).groupBy(*group, "__g").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count(F.lit(1)).alias("n")).drop("__g")


def column_runs(cells: DataFrame, group: list[str]) -> DataFrame:
    """Runs (group, col, lo, hi) of rows of cells (row, col), none longer than 64: rows are bits of a number for each 64 rows of a column, so that what is shuffled and sorted after this is a 64th
    of the cells, in parts of any size. A cell that is there twice counts once."""
    word = F.bit_or(F.expr("shiftleft(1L, cast(row & 63 as int))")).alias("__bits")
    words = cells.groupBy(*group, "col", F.shiftright("row", 6).alias("__at")).agg(word)
    places = lambda bits: F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(bits, i) == 1)
    bits = F.col("__bits")
    first, last = bits.bitwiseAND(F.bitwise_not(F.shiftleft(bits, 1))), bits.bitwiseAND(F.bitwise_not(F.shiftrightunsigned(bits, 1)))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.lit(63).alias("b")))
    runs = F.when(bits == -1, whole).otherwise(F.zip_with(places(first), places(last), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    base = F.col("__at") * 64
    return words.select(*group, "col", "__at", F.explode(runs).alias("__r")).select(*group, "col", (base + F.col("__r.a")).alias("lo"), (base + F.col("__r.b")).alias("hi"))


def run_rectangles(runs: DataFrame, group: list[str]) -> DataFrame:
    """Rectangles (r1, r2, c1, c2) of runs (col, lo, hi), which may touch and overlap."""
    w = Window.partitionBy(*group, "col").orderBy("lo")
    apart = F.when(F.col("lo") <= F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, 0).otherwise(1)
    joined = runs.select(*group, "col", "lo", "hi").withColumn("__n", apart).withColumn("__g", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = joined.groupBy(*group, "col", "__g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("__g")
    w = Window.partitionBy(*group, "lo", "hi").orderBy("col")
    side = whole.withColumn("__g", F.col("col") - F.row_number().over(w)).groupBy(*group, "lo", "hi", "__g").agg(F.min("col").alias("c1"), F.max("col").alias("c2"))
    return side.select(*group, F.col("lo").alias("r1"), F.col("hi").alias("r2"), "c1", "c2")


def rectangles(cells: DataFrame, group: list[str]) -> DataFrame:
    """Rectangles (r1, r2, c1, c2) of cells (row, col): columns' runs with the same rows beside one another are one rectangle."""
    return run_rectangles(column_runs(cells, group), group)


def nearest_label(df: DataFrame, group: list[str], order: str, text: str, name: str, most: int = 5) -> DataFrame:
    """The nearest non-null text in the ``most`` rows above."""
    return df.withColumn(name, F.last(text, ignorenulls=True).over(Window.partitionBy(*group).orderBy(order).rowsBetween(-most, -1)))


def peers(df: DataFrame, group: list[str], order: list[Column], me: Column, first: int = 5, around: int = 2) -> DataFrame:
    """The group's first rows and those around the row that is ``me``."""
    w = Window.partitionBy(*group).orderBy(*order)
    placed = df.withColumn("place", F.row_number().over(w)).withColumn("__me", F.max(F.when(me, F.row_number().over(w))).over(Window.partitionBy(*group)))
    return placed.where((F.col("__me").isNotNull()) & ((F.col("place") <= first) | (F.abs(F.col("place") - F.col("__me")) <= around))).drop("__me")


def downsample(df: DataFrame, group: list[str], order: list[str], most: int = 400) -> DataFrame:
    """Every k-th row of each series, k = ceil(n / most)."""
    w = Window.partitionBy(*group)
    numbered = df.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__k", F.ceil(F.count(F.lit(1)).over(w) / most))
    return numbered.where(F.col("__i") % F.col("__k") == 0).drop("__i", "__k")
