"""Lookups and joins: first match, as-of, casefold fallback, outer statistics, entries and exits, overlays, interval alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_match(table: DataFrame, key: Column, order: Column, columns: list[str]) -> DataFrame:
    """One row per key: the row that comes first. Keys are compared without case."""
    return table.groupBy(F.lower(key.cast("string")).alias("__key")).agg(*(F.min_by(F.struct(F.col(c)), order)[c].alias(c) for c in columns))


def vlookup(df: DataFrame, key: Column, table: DataFrame, table_key: Column, order: Column, columns: dict[str, str]) -> DataFrame:
    """Exact lookup: adds the columns of the first matching row (old name: new name), null where nothing matches.
    The first-match table has a row for each key, so the join never multiplies rows; Spark broadcasts it only if it is small."""
    first = first_match(table, table_key, order, list(columns)).withColumnsRenamed(columns)
    return df.withColumn("__key", F.lower(key.cast("string"))).join(first, "__key", "left").drop("__key")


def hlookup(df: DataFrame, key: Column, header_row: DataFrame, columns: list[str], row: str = "value") -> DataFrame:
    """Lookup in the first row of a table: columns become rows, then an exact lookup. ``header_row``: one row of values by column name."""
    pairs = header_row.select(F.explode(F.array(*(F.struct(F.lit(i).alias("at"), F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)))).alias("x")).select("x.*")
    return vlookup(df, key, pairs, F.col("name"), F.col("at"), {"value": row})


#: Ranges of keys of an as-of lookup without groups.
RANGES = 64


def _range_of(key: Column, bounds: list[float]) -> Column:
    """How many of the sorted ``bounds`` a key reaches, by halving; 0 for null."""
    if not bounds:
        return F.lit(0)
    half = len(bounds) // 2
    return F.when(key >= bounds[half], _range_of(key, bounds[half + 1:]) + (half + 1)).otherwise(_range_of(key, bounds[:half]))


def as_of(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, group: list[str] = ()) -> DataFrame:
    """The value of the last table row whose key is at most ``key``: union, then the last non-null value in key order. One shuffle, no
    range join, linear in both sides. Without ``group``, ``RANGES`` ranges of keys with about the same number of rows are the groups: each begins with the last value before it."""
    names = df.columns
    left = df.withColumn("__k", F.col(key).cast("double")).withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(table.schema[value].dataType))
    right = table.select(*group, F.col(table_key).cast("double").alias("__k"), F.lit(0).alias("__side"), F.col(value).alias("__v")).where("__k is not null")
    by = list(group)
    if not by:
        keys = left.select("__k").unionByName(right.select("__k")).where("__k is not null and not isnan(__k)")
        cuts = keys.agg(F.percentile_approx("__k", [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0]  # one row
        bounds = sorted(set(cuts or ()))
        by = ["__range"]
        left, right = (d.withColumn("__range", _range_of(F.col("__k"), bounds)) for d in (left, right))
        last = right.where("__v is not null").groupBy("__range").agg(F.max_by(F.struct("__v"), "__k").alias("last"))  # a row for each range
        begin = last.select(F.explode(F.sequence(F.col("__range") + 1, F.lit(len(bounds) + 1))).alias("to"), "__range", "last").where(F.col("to") <= len(bounds))
        begin = begin.groupBy(F.col("to").alias("__range")).agg(F.max_by("last", "__range")["__v"].alias("__v"))
        right = right.unionByName(begin.select(F.lit(float("-inf")).alias("__k"), F.lit(-1).alias("__side"), "__v", "__range"))
    w = Window.partitionBy(*by).orderBy("__k", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right, allowMissingColumns=True).withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__side = 1").select(*names, value)


def band_lookup(df: DataFrame, key: Column, bands: list[tuple[float, object]], name: str) -> DataFrame:
    """As-of lookup in a short sorted list of (least, value), as an expression."""
    pick = reduce(lambda e, b: F.when(key >= b[0], F.lit(b[1])).otherwise(e), sorted(bands, key=lambda b: b[0]), F.lit(None))
    return df.withColumn(name, pick)


def join_with_fallback(df: DataFrame, key: str, table: DataFrame, table_key: str, order: str, column: str) -> DataFrame:
    """Exact key first, then without case; the first occurrence of each counts."""
    exact = table.groupBy(F.col(table_key).alias(key)).agg(F.min_by(column, order).alias("__exact"))
    loose = table.groupBy(F.lower(table_key).alias("__low")).agg(F.min_by(column, order).alias("__loose"))
    joined = df.join(exact, key, "left").withColumn("__low", F.lower(key)).join(loose, "__low", "left")
    return joined.withColumn(column, F.coalesce("__exact", "__loose")).drop("__exact", "__loose", "__low")


def outer_stats(stats: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Statistics by category beside the number of members: categories on one side only survive."""
    counts = members.groupBy(key).agg(F.count(F.lit(1)).alias("members"))
    return stats.join(counts, key, "full_outer").withColumn("members", F.coalesce("members", F.lit(0).cast("long")))


def changes(now: DataFrame, before: DataFrame, key: str, values: list[str]) -> DataFrame:
    """``now`` with the former values and deltas; ``is_new`` where there was no such key."""
    old = before.select(key, *(F.col(v).alias(f"{v}_before") for v in values), F.lit(False).alias("is_new"))
    joined = now.join(old, key, "left").withColumn("is_new", F.coalesce("is_new", F.lit(True)))
    return joined.select("*", *((F.col(v) - F.col(f"{v}_before")).alias(f"{v}_delta") for v in values))


def entries_and_exits(now: DataFrame, before: DataFrame, key: str, every: DataFrame | None = None) -> DataFrame:
    """(key, change): keys that came or went. Exits are tested against ``every`` key of now, where now itself is only a part."""
    came = now.select(key).distinct().join(before.select(key), key, "left_anti").withColumn("change", F.lit("entry"))
    went = before.select(key).distinct().join((every if every is not None else now).select(key), key, "left_anti").withColumn("change", F.lit("exit"))
    return came.unionByName(went)


def overlay(base: DataFrame, *layers: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Latest wins: each layer's rows replace those below. One shuffle for all layers."""
    stack = reduce(lambda a, b: a.unionByName(b), (d.select(*keys, *values, F.lit(i).alias("__layer")) for i, d in enumerate((base, *layers))))
    return stack.groupBy(*keys).agg(F.max_by(F.struct(*values), "__layer").alias("v"), F.max("__layer").alias("layer")).select(*keys, "v.*", "layer")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The whole latest row of each key, by a partial aggregate rather than a sort of each group."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def overlap_edges(writers: DataFrame, readers: DataFrame) -> DataFrame:
    """(source, target) where a reader's rectangle meets a writer's on one sheet. Rectangles: id, sheet, r1, r2, c1, c2.

    Each rectangle has a level by its height and one by its width, the least power of two that isn't smaller. Rectangles of two levels meet in tiles of the larger, of which none covers more
    than two in a row or column, so only those are compared that share a tile. The tile with the upper left corner of what two have in common gives the pair, once. Only pairs of ids with
    several rectangles are looked through for doubles."""
    level = lambda a, b: F.ceil(F.log2(F.abs(F.col(b) - F.col(a)) + 1.0)).cast("int")

    def side(df: DataFrame, mark: str) -> DataFrame:
        many = df.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("many"))
        cols = [F.col(c).alias(f"{mark}_{c}") for c in ("id", "sheet", "r1", "r2", "c1", "c2")]
        return df.join(many, "id").select(*cols, F.col("many").alias(f"{mark}_many"), level("r1", "r2").alias(f"{mark}_lr"), level("c1", "c2").alias(f"{mark}_lc"))

    w, r = side(writers, "w"), side(readers, "r")
    levels = lambda d, m: d.select(f"{m}_lr", f"{m}_lc").distinct()  # noqa: E731  a row for each pair of powers of two

    def tiled(d: DataFrame, m: str, other: DataFrame) -> DataFrame:
        met = d.crossJoin(F.broadcast(other)).withColumn("tr", F.greatest("w_lr", "r_lr")).withColumn("tc", F.greatest("w_lc", "r_lc"))
        tiles = lambda a, b, size: F.sequence(F.expr(f"shiftright(least({m}_{a}, {m}_{b}), {size})"), F.expr(f"shiftright(greatest({m}_{a}, {m}_{b}), {size})"))
        return met.withColumn("at_r", F.explode(tiles("r1", "r2", "tr"))).withColumn("at_c", F.explode(tiles("c1", "c2", "tc"))).drop("tr", "tc")

    a, b = tiled(w, "w", levels(r, "r")).alias("a"), tiled(r, "r", levels(w, "w")).alias("b")
    keys = ["w_lr", "w_lc", "r_lr", "r_lc", "at_r", "at_c"]
    same = reduce(lambda p, q: p & q, (F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys), F.col("w_sheet") == F.col("r_sheet"))
    meet = (F.col("w_r1") <= F.col("r_r2")) & (F.col("r_r1") <= F.col("w_r2")) & (F.col("w_c1") <= F.col("r_c2")) & (F.col("r_c1") <= F.col("w_c2"))
    corner = F.expr("shiftright(greatest(w_r1, r_r1), greatest(a.w_lr, a.r_lr)) = a.at_r") & F.expr("shiftright(greatest(w_c1, r_c1), greatest(a.w_lc, a.r_lc)) = a.at_c")
    found = a.join(b, same & meet & corner).select(F.col("w_id").alias("source"), F.col("r_id").alias("target"), (F.col("w_many") | F.col("r_many")).alias("many"))
    return found.where("not many").drop("many").unionByName(found.where("many").drop("many").distinct())


def interval_sweep(old: DataFrame, new: DataFrame, group: list[str], key: str) -> DataFrame:
    """Aligns two sets of half-open intervals (lo, hi, key) of each group: elementary intervals with the key on both sides, and added, removed, changed or same."""
    sides = old.withColumn("__side", F.lit("old")).unionByName(new.withColumn("__side", F.lit("new")))
    points = sides.select(*group, F.explode(F.array("lo", "hi")).alias("lo")).distinct()
    w = Window.partitionBy(*group).orderBy("lo")
    cuts = points.withColumn("hi", F.lead("lo").over(w)).withColumn("__at", F.row_number().over(w))
    place = lambda c, at: cuts.select(*group, F.col("lo").alias(c), F.col("__at").alias(at))
    found = cuts.where("hi is not null")
    for d, name in ((old, "old_key"), (new, "new_key")):  # an interval holds the cuts from the place of lo to that before hi
        own = d.where("lo < hi").groupBy(*group, "lo", "hi").agg(F.min(key).alias(name)).join(place("lo", "__a"), [*group, "lo"]).join(place("hi", "__b"), [*group, "hi"])
        hit = own.select(*group, name, F.explode(F.sequence("__a", F.col("__b") - 1)).alias("__at")).groupBy(*group, "__at").agg(F.min(name).alias(name))
        found = found.join(hit, [*group, "__at"], "left")
    cuts = found.drop("__at")
    kind = F.when(F.col("old_key").isNull(), "added").when(F.col("new_key").isNull(), "removed").when(F.col("old_key") == F.col("new_key"), "same").otherwise("changed")
    return cuts.where("old_key is not null or new_key is not null").withColumn("change", kind)


def keyed_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer comparison of values by key: added, removed or changed rows only."""
    a, b = old.select(*keys, F.col(value).alias("old_value"), F.lit(1).alias("__o")), new.select(*keys, F.col(value).alias("new_value"), F.lit(1).alias("__n"))
    kind = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "changed")
    return a.join(b, keys, "full_outer").withColumn("change", kind).where("change is not null").drop("__o", "__n")


def reachable(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """Nodes reachable from ``start`` (node), start included. edges: source, target. Breadth-first rounds over DataFrames until nothing is new; each is checkpointed, the
    driver sees counts only. With ``most``, an error if so many rounds don't end it."""
    seen = frontier = start.select("node").distinct().checkpoint()
    rounds = 0
    while most is None or rounds < most:
        frontier = edges.join(frontier, edges["source"] == frontier["node"]).select(F.col("target").alias("node")).distinct().join(seen, "node", "left_anti").checkpoint()
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier).checkpoint()
        rounds += 1
    raise RuntimeError(f"nodes are further from the start than {most} edges")


def jaccard_matches(left: DataFrame, right: DataFrame, group: str, item: str, least: float = 0.6) -> DataFrame:
    """Pairs of groups (a, b) whose item sets overlap by at least ``least``; for small catalogues such as sheets by their templates."""
    a, b = left.select(F.col(group).alias("a"), item).distinct(), right.select(F.col(group).alias("b"), item).distinct()
    na, nb = a.groupBy("a").agg(F.count(F.lit(1)).alias("na")), b.groupBy("b").agg(F.count(F.lit(1)).alias("nb"))
    both = a.join(b, item).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).join(na, "a").join(nb, "b")
    return both.withColumn("score", F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).where(F.col("score") >= least).select("a", "b", "score")
