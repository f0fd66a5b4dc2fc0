"""Workbook structure as DataFrames: references, spills, graph depths, labels, memberships, catalogues, anomalies and structural differences.

Cells have sheet, row, col and what is named; blocks have id, sheet, r1, r2, c1, c2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CALL = r"([A-Za-z_][A-Za-z0-9_.]*)\("
_SHEET = r"(?:'((?:[^']|'')+)'|([A-Za-z_][A-Za-z0-9_.]*))!"


def _outside_texts(formula: Column) -> Column:
    return F.regexp_replace(formula, r'"(?:[^"]|"")*"', '""')


def reference_counts(cells: DataFrame, formula: str = "formula") -> DataFrame:
    """(kind, name, formulas): in how many formulas each function is called and each sheet named; words in texts don't count."""
    code = _outside_texts(F.col(formula))
    calls = F.transform(F.regexp_extract_all(code, F.lit(_CALL), 1), lambda x: F.upper(x))
    sheets = F.zip_with(F.regexp_extract_all(code, F.lit(_SHEET), 1), F.regexp_extract_all(code, F.lit(_SHEET), 2), lambda a, b: F.when(a != "", F.replace(a, F.lit("''"), F.lit("'"))).otherwise(b))
    named = lambda kind, x: F.transform(F.array_distinct(x), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    found = cells.where(F.col(formula).isNotNull()).select(F.explode(F.concat(named("function", calls), named("sheet", sheets))).alias("f")).select("f.*")
    return found.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("formulas"))


def spill(anchors: DataFrame, values: str = "values") -> DataFrame:
    """Cells (sheet, row, col, value, error) of array formulas. ``anchors``: sheet, r1, c1, r2, c2 and an array of rows of numbers. A one-row or one-column array is repeated over the
    rectangle; else places beyond the array are #N/A; what doesn't fit the rectangle is dropped."""
    v = F.col(values)
    tall, wide = F.size(v), F.size(F.get(v, F.lit(0)))
    cells = anchors.withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("r2") - F.col("r1")))).withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("c2") - F.col("c1"))))
    i, j = F.when(tall == 1, 0).otherwise(F.col("__i")), F.when(wide == 1, 0).otherwise(F.col("__j"))
    inside = (i < tall) & (j < wide)
    return cells.select("sheet", (F.col("r1") + F.col("__i")).alias("row"), (F.col("c1") + F.col("__j")).alias("col"), F.when(inside, F.get(F.get(v, i), j)).alias("value"), F.when(~inside, "#N/A").alias("error"))


def depths(edges: DataFrame, most: int = 10_000) -> DataFrame:
    """(node, depth): the longest path to each node of an acyclic graph (source, target), sources of nothing else at 0. Rounds move a frontier of nodes whose depth rose; each is
    checkpointed, and joins by a shuffle: a broadcast would pass through the driver in every round. A graph with a cycle fails after ``most`` rounds, or as soon as there are more rounds than nodes."""
    edges = edges.select("source", "target").where("source <> target").distinct().checkpoint()
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    best = nodes.select("node", F.lit(0).alias("depth"), F.lit(-1).alias("__was")).checkpoint()
    limit = min(most, best.count())
    for _ in range(limit + 1):
        front = best.where(F.col("depth") > F.col("__was")).select(F.col("node").alias("source"), "depth")
        if front.isEmpty():
            return best.select("node", "depth")
        further = edges.join(front.hint("merge"), "source").select(F.col("target").alias("node"), (F.col("depth") + 1).alias("depth"), F.lit(None).cast("int").alias("__was"))
        kept = best.select("node", "depth", F.col("depth").alias("__was"))
        best = kept.unionByName(further).groupBy("node").agg(F.max("depth").alias("depth"), F.max("__was").alias("__was")).checkpoint()
    raise ValueError("the graph has a cycle, or paths that are too long")


def upstream(edges: DataFrame, start: DataFrame, depth: int = 6) -> DataFrame:
    """(node, depth): what ``start`` (node) reads, level by level up to ``depth``; a node is listed at its least depth."""
    seen = start.select("node").distinct().withColumn("depth", F.lit(0)).checkpoint()
    front = seen
    for k in range(1, depth + 1):
        front = edges.join(front.select("node"), F.col("target") == F.col("node")).select(F.col("source").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(k)).checkpoint()
        if front.isEmpty():
            break
        seen = seen.unionByName(front).checkpoint()
    return seen


def sheet_edges(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(source_sheet, target_sheet, edges) between different sheets."""
    at = lambda c: blocks.select(F.col("id").alias(c), F.col("sheet").alias(f"{c}_sheet"))
    return edges.join(at("source"), "source").join(at("target"), "target").where("source_sheet <> target_sheet").groupBy("source_sheet", "target_sheet").agg(F.count(F.lit(1)).alias("edges"))


def labels(cells: DataFrame, text: str = "text", above: int = 5, left: int = 3) -> DataFrame:
    """Adds label: the nearest text in the ``above`` rows over a cell, else in the ``left`` columns beside it. Cells are sparse: distance is by row and column, not by cells."""
    near = lambda w, at, most: F.last(F.when(F.col(text).isNotNull(), F.struct(F.col(at).alias("at"), F.col(text).alias("t"))), ignorenulls=True).over(w.rangeBetween(-most, -1))["t"]
    over = near(Window.partitionBy("sheet", "col").orderBy("row"), "row", above)
    beside = near(Window.partitionBy("sheet", "row").orderBy("col"), "col", left)
    return cells.withColumn("label", F.coalesce(over, beside))


def memberships(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Cells with the name of the range (sheet, name, r1, r2, c1, c2) that they lie in, null for none; of several the first by name. Ranges are listed by row, so this is an equi-join."""
    rows = ranges.select("sheet", F.explode(F.sequence("r1", "r2")).alias("row"), "name", "c1", "c2")
    hit = cells.select("sheet", "row", "col").join(rows, ["sheet", "row"]).where(F.col("col").between(F.col("c1"), F.col("c2"))).groupBy("sheet", "row", "col").agg(F.min("name").alias("member_of"))
    return cells.join(hit, ["sheet", "row", "col"], "left")


def error_stats(values: DataFrame) -> DataFrame:
    """(template, cells, errors, place): templates by their error cells, then size: what to look at first. ``values``: template and cell ``c``."""
    counted = values.groupBy("template").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("c.k") == 4).alias("errors"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.col("errors").desc(), F.col("cells").desc(), "template")))  # a row per template


def coverage(judged: DataFrame) -> DataFrame:
    """Per sheet: formulas, checked (neither stale nor skipped), matched, and their shares. ``judged``: sheet and class, of which ``skipped_unsupported`` and ``stale`` are no checks."""
    checked = ~F.col("class").isin("stale", "skipped_unsupported")
    counted = judged.groupBy("sheet").agg(F.count(F.lit(1)).alias("formulas"), F.count_if(checked).alias("checked"), F.count_if(F.col("class") == "match").alias("matched"), F.count_if(F.col("class") == "skipped_unsupported").alias("skipped"), F.count_if(F.col("class") == "stale").alias("stale"))
    return counted.withColumn("coverage", F.col("checked") / F.col("formulas")).withColumn("agreement", F.when(F.col("checked") > 0, F.col("matched") / F.col("checked")))


def own_row(blocks: DataFrame) -> DataFrame:
    """Odd blocks beside a regular neighbour that uses its own row only: id and the row offsets that the neighbour doesn't use. ``blocks``: id, sheet, c1, r1, r2, offsets (array of relative rows)."""
    w = Window.partitionBy("sheet", "c1").orderBy("r1")
    beside = blocks.withColumn("__near", F.coalesce(F.lag("offsets").over(w), F.lead("offsets").over(w)))
    odd = F.array_sort(F.array_except("offsets", "__near"))
    own = F.forall("__near", lambda x: x == 0) & (F.size("__near") > 0)
    return beside.withColumn("odd", odd).where(own & (F.size("odd") > 0)).select("id", "odd")


def anomaly_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Anomalies by ``keys`` that are new or resolved."""
    a, b = old.select(*keys).distinct(), new.select(*keys).distinct()
    return b.join(a, keys, "left_anti").withColumn("change", F.lit("new")).unionByName(a.join(b, keys, "left_anti").withColumn("change", F.lit("resolved")))


def row_changes(old: DataFrame, new: DataFrame, sheet: str = "sheet", key: str = "key") -> DataFrame:
    """(sheet, change, rows, first, last): rows added and removed by their keys, whatever row they stand in."""
    came = new.join(old, [sheet, key], "left_anti").withColumn("change", F.lit("added"))
    went = old.join(new, [sheet, key], "left_anti").withColumn("change", F.lit("removed"))
    return came.unionByName(went).groupBy(sheet, "change").agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"))


def block_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(template, old_blocks, new_blocks, change): templates on both sides whose blocks were merged or split. Both have sheet and template."""
    count = lambda d, n: d.groupBy("sheet", "template").agg(F.count(F.lit(1)).alias(n))
    both = count(old, "old_blocks").join(count(new, "new_blocks"), ["sheet", "template"]).where("old_blocks <> new_blocks")
    return both.withColumn("change", F.when(F.col("new_blocks") < F.col("old_blocks"), "merged").otherwise("split"))


def resized(old: DataFrame, new: DataFrame) -> DataFrame:
    """Input rectangles (sheet, c1, r1, r2) with another end than before."""
    b = new.select("sheet", "c1", "r1", F.col("r2").alias("new_r2"))
    return old.select("sheet", "c1", "r1", "r2").join(b, ["sheet", "c1", "r1"]).where("r2 <> new_r2").withColumn("rows", F.col("new_r2") - F.col("r2"))


def repair_groups(changes: DataFrame) -> DataFrame:
    """Changes (sheet, c1, r1, r2, new_template, known: whether the new template stood in the old version already) of one row span that took over a known template: one repair each."""
    taken = changes.where("known").groupBy("sheet", "r1", "r2", "new_template")
    return taken.agg(F.count(F.lit(1)).alias("columns"), F.array_sort(F.collect_set("c1")).alias("at")).withColumn("location", F.array_join(F.transform("at", lambda c: F.concat(F.char(c + 64), F.col("r1"), F.lit(":"), F.char(c + 64), F.col("r2"))), ", ")).drop("at")


def inputs_catalogue(blocks: DataFrame, cells: int = 64, rows: int = 8, tall: int = 20) -> DataFrame:
    """Adds kind to input blocks (sheet, r1, r2, c1, c2, numbers): parameters (few cells in few rows), labels (no number), or table; and section: whether it begins above its sheet's body, the first
    row of a block of ``tall`` rows."""
    height, n = F.col("r2") - F.col("r1") + 1, (F.col("r2") - F.col("r1") + 1) * (F.col("c2") - F.col("c1") + 1)
    kind = F.when(F.col("numbers") == 0, "labels").when((n <= cells) & (height <= rows), "parameters").otherwise("table")
    body = F.min(F.when(height >= tall, F.col("r1"))).over(Window.partitionBy("sheet"))
    return blocks.withColumn("kind", kind).withColumn("section", F.when(F.col("r1") < body, "head").when(body.isNotNull(), "body").otherwise("sheet"))


def outputs_summary(values: DataFrame, before: DataFrame, few: int = 12) -> DataFrame:
    """Per output block: cells, kind (metric for at most ``few`` cells, else table), sum, its change against ``before``, and how many cells changed. Both have block, row, col, value."""
    old = before.select("block", "row", "col", F.col("value").alias("old"))
    both = values.join(old, ["block", "row", "col"], "left")
    made = both.groupBy("block").agg(F.count(F.lit(1)).alias("cells"), F.sum("value").alias("total"), (F.sum("value") - F.sum("old")).alias("change"), F.count_if(~F.col("value").eqNullSafe(F.col("old"))).alias("changed"))
    return made.withColumn("kind", F.when(F.col("cells") <= few, "metric").otherwise("table"))


def changelog(*parts: tuple[str, DataFrame]) -> DataFrame:
    """(kind, sheet, title) of logic, data and structural changes, in that order of kinds."""
    frames = [d.select(F.lit(kind).alias("kind"), F.col("sheet").cast("string").alias("sheet"), F.col("title").cast("string").alias("title")) for kind, d in parts]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
