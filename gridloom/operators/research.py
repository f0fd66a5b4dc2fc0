"""The declarative research layer: entity tables, scopes, exploring, insights, movement, categories, snapshots.

An entity table has a row per entity: key, label, dimensions, measures (null: not rated), and rank and quartile in a category.
"""

from __future__ import annotations

import hashlib
import json
import re
import string
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import band, band_bounds, countifs_rank, quartile_ladder


def entity_table(df: DataFrame, key: str, label: str, category: str, score: str, dims: list[str] = (), measures: list[str] = (), higher_is_better: bool = True, period: str | None = None) -> DataFrame:
    """Adds rank, ranked (in the category) and quartile to one row per entity; categories of fewer than four rated entities have no quartiles. With ``period``, a row per entity and
    period, ranked in each."""
    every = [period] if period else []
    base = df.select(*every, F.col(key).alias("key"), F.col(label).alias("label"), F.col(category).alias("category"), F.col(score).alias("score"), *[d for d in dims], *[m for m in measures if m != score])
    ranked = countifs_rank(base, [*every, "category"], F.col("score"), "rank", ">" if higher_is_better else "<")
    ranked = ranked.withColumn("ranked", F.count("score").over(Window.partitionBy(*every, "category")))
    return ranked.withColumn("quartile", quartile_ladder(F.col("rank"), F.col("ranked")))


@dataclass(frozen=True)
class Scope:
    """A global filter. ``dims``: column to accepted values; ``bands``: measure to b1 ... b4, by bounds of the whole table."""

    dims: dict = field(default_factory=dict)
    quartiles: tuple = ()
    bands: dict = field(default_factory=dict)
    rated: bool | None = None
    text: str = ""

    @classmethod
    def parse(cls, raw: str) -> "Scope":
        got = json.loads(raw or "{}")
        unknown = set(got) - {"dims", "quartiles", "bands", "rated", "text"}
        if unknown:
            raise ValueError(f"unknown scope fields: {sorted(unknown)}")
        return cls(got.get("dims", {}), tuple(got.get("quartiles", ())), got.get("bands", {}), got.get("rated"), got.get("text", ""))

    def key(self) -> str:
        """Canonical text: equal scopes, equal keys."""
        return json.dumps({"bands": self.bands, "dims": self.dims, "quartiles": sorted(self.quartiles), "rated": self.rated, "text": self.text}, sort_keys=True, separators=(",", ":"))

    def words(self) -> str:
        parts = [f"{k} is {v}" for k, v in sorted(self.dims.items())] + [f"{k} in {v}" for k, v in sorted(self.bands.items())]
        parts += [f"quartile {', '.join(map(str, sorted(self.quartiles)))}"] if self.quartiles else []
        parts += [] if self.rated is None else ["rated only" if self.rated else "unrated only"]
        return "; ".join(parts + ([f"matching “{self.text}”"] if self.text else [])) or "everything"


def apply_scope(df: DataFrame, scope: Scope, searched: list[str] = ("label", "key")) -> DataFrame:
    """Rows within a scope; bands use the bounds of the rated rows of the whole table, taken before any filter."""
    tests: list[Column] = [F.col(k) == v for k, v in scope.dims.items()]
    if scope.quartiles:
        tests.append(F.col("quartile").isin(*scope.quartiles))
    if scope.rated is not None:
        tests.append(F.col("score").isNotNull() if scope.rated else F.col("score").isNull())
    if scope.text:
        tests.append(F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in searched))).contains(scope.text.lower()))
    for measure, want in scope.bands.items():
        bounds = band_bounds(df.where("score is not null"), [], measure)
        df = df.crossJoin(F.broadcast(bounds.select(*(F.col(f"q{i}").alias(f"__{measure}{i}") for i in (1, 2, 3)))))  # one row
        tests.append(band(F.col(measure), *(F.col(f"__{measure}{i}") for i in (1, 2, 3))) == want)
    kept = df.where(reduce(lambda a, b: a & b, tests)) if tests else df
    return kept.drop(*(f"__{m}{i}" for m in scope.bands for i in (1, 2, 3)))


VALUES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "median": F.median}


def explore(df: DataFrame, by: str, measure: str = "score", how: str = "mean", split: str | None = None, period: str | None = None) -> DataFrame:
    """Groups by a dimension: funds, rated, q1..q4, value, median position (rank / ranked), share in the first quartile. ``split``: a separator that makes one entity a
    member of several groups."""
    if split:
        members = F.filter(F.transform(F.split(by, re.escape(split)), lambda x: F.trim(x)), lambda x: x != "")
        df = df.withColumn(by, F.explode(F.array_distinct(members)))
    position = F.col("rank") / F.col("ranked")
    return df.groupBy(*([period] if period else []), F.col(by).cast("string").alias("label")).agg(*_summary(measure, how, position))


def _summary(measure: str, how: str, position: Column) -> list[Column]:
    q = [F.count_if(F.col("quartile") == i).cast("long").alias(f"q{i}") for i in (1, 2, 3, 4)]
    ranked = F.count("quartile")
    return [F.count(F.lit(1)).alias("funds"), F.count("score").alias("rated"), *q, VALUES[how](measure).alias("value"), F.median(position).alias("median_position"), (F.count_if(F.col("quartile") == 1) / F.when(ranked > 0, ranked)).alias("q1_share")]


def explore_total(df: DataFrame, measure: str = "score", how: str = "mean") -> DataFrame:
    """The same over all entities: not the sum of groups, in which an entity may stand twice."""
    return df.agg(*_summary(measure, how, F.col("rank") / F.col("ranked"))).withColumn("label", F.lit("Total"))


def explore_change(now: DataFrame, before: DataFrame, least: int = 4) -> DataFrame:
    """Groups with their change of value; ``small`` where fewer than ``least`` are rated."""
    old = before.select("label", F.col("value").alias("value_before"), F.lit(False).alias("is_new"))
    joined = now.join(old, "label", "left").withColumn("is_new", F.coalesce("is_new", F.lit(True)))
    return joined.withColumn("change", F.col("value") - F.col("value_before")).withColumn("small", F.col("rated") < least)


def explore_over(df: DataFrame, by: str, period: str, before, now, measure: str = "score", how: str = "mean", least: int = 4) -> DataFrame:
    """``explore_change`` of two periods of one table with a row per entity and period: one aggregate of both, then the groups' rows side by side."""
    both = explore(df.where(F.col(period).isin(before, now)), by, measure, how, period=period)
    earlier = Window.partitionBy("label").orderBy(F.col(period) == now)
    placed = both.withColumn("value_before", F.lag("value").over(earlier)).withColumn("is_new", F.row_number().over(earlier) == 1).where(F.col(period) == now).drop(period)
    return placed.withColumn("change", F.col("value") - F.col("value_before")).withColumn("small", F.col("rated") < least)


def movement_over(df: DataFrame, period: str, before, now) -> DataFrame:
    """``movement`` between two periods of one table with a row per entity and period: a window over each entity's two rows instead of a join."""
    earlier = Window.partitionBy("key").orderBy(F.col(period) == now)
    old = lambda c: F.lag(c).over(earlier)
    placed = df.where(F.col(period).isin(before, now)).withColumns({"rank_before": old("rank"), "quartile_before": old("quartile"), "is_new": F.row_number().over(earlier) == 1})
    return placed.where(F.col(period) == now).withColumn("delta", F.col("rank_before") - F.col("rank"))


def explore_order(df: DataFrame, sort: str = "value", descending: bool = True, limit: int = 15) -> DataFrame:
    """Small groups last, nulls last within them, ties by label; ``limit`` 0 for all."""
    c = F.lower(F.col(sort)) if sort == "label" else F.col(sort)
    ordered = df.orderBy("small", c.desc_nulls_last() if descending else c.asc_nulls_last(), F.lower("label"))
    return ordered.limit(limit) if limit > 0 else ordered


def explore_facts(rows: list[dict]) -> dict:
    """Top share, best value, riser and faller among groups that aren't small; from an explored result on the driver."""
    big = [r for r in rows if not r["small"]]
    best = lambda k, sign=1: max((r for r in big if r.get(k) is not None), key=lambda r: (sign * r[k], r["label"]), default=None)
    riser, faller = best("change"), best("change", -1)
    return {"top_share": best("q1_share"), "best": best("value"), "riser": riser if riser and riser["change"] > 0 else None, "faller": faller if faller and faller["change"] < 0 else None}


def category_stats(df: DataFrame) -> DataFrame:
    """count, rated, ranked, q1..q4, mean, spread (of two or more rated) and unranked of each category."""
    q = [F.count_if(F.col("quartile") == i).cast("long").alias(f"q{i}") for i in (1, 2, 3, 4)]
    rated = F.count("score")
    return df.groupBy("category").agg(F.count(F.lit(1)).alias("n"), rated.alias("rated"), F.count("quartile").alias("ranked"), *q, F.avg("score").alias("mean"), F.when(rated >= 2, F.max("score") - F.min("score")).alias("spread"), F.count_if(F.col("score").isNotNull() & F.col("quartile").isNull()).cast("long").alias("unranked"))


def universe_partition(df: DataFrame, least: int = 4) -> DataFrame:
    """One row: rated, ranked, small (rated in a category of fewer than ``least``), missing, total, and the median and largest category sizes."""
    sizes = df.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("rated"))
    by_cat = sizes.agg(F.sum("n").alias("total"), F.sum("rated").alias("rated"), F.sum(F.when(F.col("rated") >= least, F.col("rated")).otherwise(0)).alias("ranked"), F.sum(F.when(F.col("rated") < least, F.col("rated")).otherwise(0)).alias("small"), F.median("n").alias("median_size"), F.max("n").alias("largest"))
    return by_cat.withColumn("missing", F.col("total") - F.col("rated"))


TESTS = {"eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "in": lambda c, v: c.isin(*v), "notnull": lambda c, v: c.isNotNull(), "isnull": lambda c, v: c.isNull()}


def predicate(tests: list[tuple], constants: dict | None = None) -> Column:
    """A conjunction of (column, test, target); a target "$name" is looked up in ``constants``. top and bottom on quartile and rank are shares of the category."""
    out = F.lit(True)
    for name, test, *rest in tests:
        c, v = F.col(name), rest[0] if rest else None
        if isinstance(v, str) and v.startswith("$"):
            v = (constants or {})[v[1:]]
        if test in ("top", "bottom") and name == "quartile":
            one = c == (1 if test == "top" else 4)
        elif test in ("top", "bottom") and name == "rank":
            n = F.ceil(F.col("ranked") * v - 1e-9)
            one = c <= n if test == "top" else c > F.col("ranked") - n
        else:
            one = TESTS[test](c, v)
        out = out & F.coalesce(one, F.lit(False))
    return out


def insight_filter(df: DataFrame, tests: list[tuple], sort: str, limit: int, descending: bool = True, constants: dict | None = None) -> DataFrame:
    """The best rows that pass; nulls last in both directions, ties by key."""
    c = F.col(sort)
    return df.where(predicate(tests, constants)).orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "key").limit(limit)


def insight_groups(df: DataFrame, by: str, mode: str, tests: list[tuple] = (), measure: str = "score", least: int = 1) -> DataFrame:
    """(label, n, value) by group: count_where, hit_rate (share of rated members that pass), mean, or dispersion (max - min); groups of fewer than ``least`` rated members are left out."""
    hit = predicate(list(tests)) & F.col("score").isNotNull()
    rated = F.count("score")
    value = {"count_where": F.count_if(predicate(list(tests))).cast("double"), "hit_rate": F.count_if(hit) / F.when(rated > 0, rated), "mean": F.avg(measure), "dispersion": F.max(measure) - F.min(measure)}[mode]
    return df.groupBy(F.col(by).cast("string").alias("label")).agg(rated.alias("n"), value.alias("value")).where(F.col("n") >= least)


def movement(now: DataFrame, before: DataFrame) -> DataFrame:
    """Entities with former rank and quartile; ``delta`` is positive where the rank got better."""
    old = before.select("key", F.col("rank").alias("rank_before"), F.col("quartile").alias("quartile_before"), F.lit(True).alias("known"))
    joined = now.join(old, "key", "left").withColumn("is_new", F.col("known").isNull()).drop("known")
    return joined.withColumn("delta", F.col("rank_before") - F.col("rank"))


def movement_stats(moved: DataFrame) -> DataFrame:
    up, down = F.col("delta") > 0, F.col("delta") < 0
    both = F.col("quartile").isNotNull() & F.col("quartile_before").isNotNull()
    return moved.agg(F.count_if(up).alias("up"), F.count_if(down).alias("down"), F.avg(F.when(up, F.col("delta"))).alias("mean_up"), F.avg(F.when(down, -F.col("delta"))).alias("mean_down"), F.count_if(both & (F.col("quartile") == 1) & (F.col("quartile_before") != 1)).alias("into_q1"), F.count_if(both & (F.col("quartile") != 1) & (F.col("quartile_before") == 1)).alias("out_of_q1"))


def held_every_period(snapshots: DataFrame, least: int = 2) -> DataFrame:
    """Keys in the first quartile in every period: snapshots has period, key, quartile. Needs at least ``least`` periods."""
    periods = snapshots.select("period").distinct().agg(F.count(F.lit(1)).alias("periods"))
    tally = snapshots.where("quartile = 1").groupBy("key").agg(F.count_distinct("period").alias("n"))
    return tally.crossJoin(F.broadcast(periods)).where((F.col("n") == F.col("periods")) & (F.col("periods") >= least)).select("key", "n")  # one row


def fingerprint(rows: list[tuple], as_of: float | None = None) -> str:
    """A snapshot's identity: its as-of date, else a digest of key, rank and quartile. ``rows`` is one version's small snapshot."""
    if as_of is not None:
        return f"as-of:{as_of:g}"
    return hashlib.sha1("\n".join(f"{k}|{r}|{q}" for k, r, q in sorted(rows, key=lambda x: str(x[0]))).encode()).hexdigest()


def page(df: DataFrame, sort: str, descending: bool | None = None, number: int = 1, size: int = 100, most: int = 500) -> DataFrame:
    """One page of entities. Ranks and quartiles sort upwards by default, all else downwards; nulls last in both directions."""
    down = sort not in ("rank", "quartile") if descending is None else descending
    size = min(max(1, size), most)
    c = F.col(sort)
    return df.orderBy(c.desc_nulls_last() if down else c.asc_nulls_last(), "key").offset((max(1, number) - 1) * size).limit(size)


# -- sentences: small results on the driver ----------------------------------------------------------------------------------


def _word(place: str, context: dict, numbers: dict) -> str | None:
    """What stands for one place of a template."""
    name = re.match(r"\w*", place)[0]
    value, choice = context.get(name), place[len(name) :]
    if value is None or not choice:
        return None if value is None else str(value)
    singular, _, plural = choice[1:].partition("|")
    noun = singular if numbers.get(name) == 1 else plural
    return noun if choice[0] == "?" else f"{value} {noun}"


def render(template: str, context: dict, numbers: dict | None = None) -> str | None:
    """A sentence with {x}, {n|one|many} (the number and its noun) and {n?one|many} (the noun alone). Null if anything is missing: an incomplete sentence is never shown."""
    said: list[str] = []
    for literal, place, _, _ in string.Formatter().parse(template):
        said.append(literal)
        if place is not None:
            said.append(_word(place, context, numbers or context))
    return None if None in said else "".join(said)


def narrate(sentences: list[dict], context: dict, numbers: dict | None = None) -> list[str]:
    """Each sentence: text, and optional zero or one (texts used when ``count``'s number is 0 or 1), requires and unless (names that must be, or must not be, set and not 0)."""
    numbers, out = numbers or context, []
    for s in sentences:
        if any(not numbers.get(n) for n in s.get("requires", ())) or any(numbers.get(n) for n in s.get("unless", ())):
            continue
        n = numbers.get(s.get("count"))
        said = render(s.get("zero", s["text"]) if n == 0 else s.get("one", s["text"]) if n == 1 else s["text"], context, numbers)
        if said:
            out.append(said)
    return out


