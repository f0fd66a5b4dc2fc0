"""What the research pages show, as DataFrames: filtered and grouped entities, categories, one entity's detail, movement with its causes, insight cards, options, versions.

Entity tables are those of ``research.entity_table``: key, label, category, score, rank, ranked, quartile, dimensions and measures.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .research import TESTS, predicate
from .windows import band, band_bounds

#: Dimensions with more values are no choice for grouping.
MOST_VALUES = 400
#: Keys that an insight card hands on to the list of entities.
DRILL = 200


def filter_entities(df: DataFrame, text: str | None = None, equals: dict | None = None, quartiles: tuple = (), keys: DataFrame | None = None, searched: tuple = ("label", "key")) -> DataFrame:
    """Entities that hold ``text`` (without case) in one of ``searched``, have these values and quartiles, and occur in ``keys`` (key). Nulls match nothing."""
    tests = [F.col(c) == v for c, v in (equals or {}).items() if v is not None]
    if text and text.strip():
        needle = text.strip().lower()
        tests.append(reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(needle)), F.lit(False)) for c in searched)))
    if quartiles:
        tests.append(F.col("quartile").isin(*quartiles))
    kept = df.where(reduce(lambda a, b: a & b, tests)) if tests else df
    return kept.join(keys.select("key"), "key", "left_semi") if keys is not None else kept


def group_subtotals(df: DataFrame, by: Column, measures: list[str]) -> DataFrame:
    """group, count, q1 and the mean of each measure; entities without the dimension are in the group of the dash."""
    return df.groupBy(F.coalesce(by.cast("string"), F.lit("—")).alias("group")).agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("quartile") == 1).alias("q1"), *(F.avg(m).alias(m) for m in measures))


def shown(c: Column, decimals: int = 2) -> Column:
    """A number as text with thousands separators."""
    return F.format_number(c.cast("double"), decimals)


def banded(df: DataFrame, measure: str, decimals: int = 2) -> DataFrame:
    """Adds band (b1 ... b4) and its label in words, by the bounds of all values of ``measure``; the bounds are one row."""
    bounds = band_bounds(df, [], measure).select(*(F.col(f"q{i}").alias(f"__q{i}") for i in (1, 2, 3)))
    q = [F.col(f"__q{i}") for i in (1, 2, 3)]
    code = band(F.col(measure), *q)
    words = F.when(code == "b1", F.concat(F.lit("Up to "), shown(q[0], decimals))).when(code == "b2", F.concat(shown(q[0], decimals), F.lit(" to "), shown(q[1], decimals))).when(code == "b3", F.concat(shown(q[1], decimals), F.lit(" to "), shown(q[2], decimals))).when(code == "b4", F.concat(F.lit("Above "), shown(q[2], decimals)))
    return df.crossJoin(F.broadcast(bounds)).withColumn("band", F.when(q[0].isNotNull(), code)).withColumn("band_label", F.when(q[0].isNotNull(), words)).drop("__q1", "__q2", "__q3")


def group_options(df: DataFrame, dimensions: list[str], measures: list[str]) -> DataFrame:
    """(kind, name, values): dimensions of 1 to ``MOST_VALUES`` values, and measures (as bands) that have four values at least."""
    counted = df.agg(*(F.count_distinct(d).alias(d) for d in dimensions), *(F.count(m).alias(f"__{m}") for m in measures))
    rows = [F.struct(F.lit("dimension").alias("kind"), F.lit(d).alias("name"), F.col(d).alias("values")) for d in dimensions] + [F.struct(F.lit("band").alias("kind"), F.lit(m).alias("name"), F.col(f"__{m}").alias("values")) for m in measures]
    found = counted.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return found.where(((F.col("kind") == "dimension") & F.col("values").between(1, MOST_VALUES)) | ((F.col("kind") == "band") & (F.col("values") >= 4)))


def category_page(df: DataFrame, measure: str, least: int = 4) -> DataFrame:
    """A row per category: count, rated, quartiles, value (mean), spread, unranked, eligible (``least`` rated members), and its place by value, nulls last."""
    q = [F.count_if(F.col("quartile") == i).alias(f"q{i}") for i in (1, 2, 3, 4)]
    known, rated = F.count(measure), F.count("score")
    rows = df.groupBy("category").agg(F.count(F.lit(1)).alias("count"), rated.alias("rated"), *q, F.avg(measure).alias("value"), F.when(known >= 2, F.max(measure) - F.min(measure)).alias("spread"), F.count_if(F.col("score").isNotNull() & F.col("quartile").isNull()).alias("unranked"))
    order = Window.orderBy(F.col("value").desc_nulls_last(), "category")  # a row per category
    return rows.withColumn("eligible", F.col("rated") >= least).withColumn("place", F.row_number().over(order))


def category_facts(page: DataFrame) -> DataFrame:
    """One row: categories, those with unranked members, eligible ones, the widest and the best of these."""
    ok = F.col("eligible")
    best = F.min_by("category", F.when(ok & F.col("value").isNotNull(), F.col("place")))
    return page.agg(F.count(F.lit(1)).alias("categories"), F.count_if(F.col("unranked") > 0).alias("unranked"), F.count_if(ok).alias("eligible"), F.max_by("category", F.when(ok & F.col("spread").isNotNull(), F.struct("spread", -F.col("place")))).alias("widest"), best.alias("best"))


def entity_detail(df: DataFrame, key, measures: dict[str, bool]) -> DataFrame:
    """A row per measure (name: whether more is better) of one entity: value, its rank in the category, how many have one there, and the category's mean.
    Reads the entity's category once and aggregates it; nothing but these rows is made."""
    me = df.where(F.col("key") == key).select(F.col("category").alias("__category"), *(F.col(m).cast("double").alias(f"__{m}") for m in measures)).limit(1)
    beside = df.join(F.broadcast(me), F.col("category") == F.col("__category"))  # one row
    parts = []
    for m, more in measures.items():
        v, own = F.col(m).cast("double"), F.col(f"__{m}")
        ahead = F.count_if(v > own if more else v < own)
        parts.append(F.struct(F.lit(m).alias("measure"), F.first(own).alias("value"), F.when(F.first(own).isNotNull(), ahead + 1).alias("category_rank"), F.count(v).alias("category_count"), F.avg(v).alias("category_mean")))
    return beside.groupBy("__category").agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def entity_history(snapshots: DataFrame, key) -> DataFrame:
    """The entity's rank, quartile and score in each snapshot (version, as_of), of snapshots with equal as_of the last version only, oldest first."""
    latest = Window.partitionBy("as_of").orderBy(F.col("version").desc())
    own = snapshots.where(F.col("key") == key).withColumn("__n", F.row_number().over(latest))
    return own.where("__n = 1").select("version", "as_of", "rank", "quartile", "score").orderBy("as_of")


def repaired_keys(changes: DataFrame, key_cells: DataFrame) -> DataFrame:
    """(key, note): identities in the rows that repairs name. ``changes``: sheet, location (A1 text), title, repair; ``key_cells``: sheet, row, key (of the sheet's key column)."""
    rows = changes.where("repair").select("sheet", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("location", F.lit(r"[A-Z]+\$?(\d+)"), 1), lambda x: x.cast("int")))).alias("row"), "title")
    return rows.join(key_cells, ["sheet", "row"]).groupBy("key").agg(F.max("title").alias("note"))


def movers(now: DataFrame, before: DataFrame, repairs: DataFrame | None = None) -> DataFrame:
    """Entities whose rank changed: delta (positive: better), quartiles, cause (repair or market) and the repair's note."""
    old = before.select("key", F.col("rank").alias("rank_from"), F.col("quartile").alias("quartile_from"))
    moved = now.join(old, "key").where("rank <> rank_from").withColumn("delta", F.col("rank_from") - F.col("rank"))
    moved = moved.join(repairs, "key", "left") if repairs is not None else moved.withColumn("note", F.lit(None).cast("string"))
    return moved.withColumn("cause", F.when(F.col("note").isNotNull(), "repair").otherwise("market")).select("key", "label", "category", "rank_from", F.col("rank").alias("rank_to"), "delta", "quartile_from", F.col("quartile").alias("quartile_to"), "cause", "note")


def risers(moved: DataFrame, most: int = 20) -> DataFrame:
    """The largest rises, ties by key."""
    return moved.where("delta > 0").orderBy(F.col("delta").desc(), "key").limit(most)


def fallers(moved: DataFrame, most: int = 20) -> DataFrame:
    return moved.where("delta < 0").orderBy("delta", "key").limit(most)


#: Columns that exist only where something is rated.
RATING = {"rank", "quartile", "score", "ranked"}


def needs_ratings(tests: list[tuple], sort: str | None = None) -> bool:
    """Whether a question makes no sense where nothing is rated: it tests (other than for absence) or sorts by a rank, a quartile or the score."""
    return any(name in RATING and test != "isnull" for name, test, *_ in tests) or sort in RATING


def insight_card(df: DataFrame, name: str, tests: list[tuple], by: str | None = None, sort: str | None = None, least: int = 1) -> DataFrame:
    """One row: name, status, count, total and groups. Status is problem (a column is missing), unavailable (nothing is rated, or fewer than two groups have ``least`` rated members), empty or ok."""
    missing = sorted({t[0] for t in tests if t[0] not in df.columns} | {c for c in (by, sort) if c and c not in df.columns})
    spark = df.sparkSession
    if missing:
        return spark.createDataFrame([(name, "problem", None, None, None)], "name string, status string, count long, total long, groups long")
    hit = predicate(list(tests))
    totals = df.agg(F.count_if(hit).alias("count"), F.count("score").alias("rated"), F.count(F.lit(1)).alias("every"))
    if by:
        groups = df.groupBy(by).agg(F.count("score").alias("n")).where(F.col("n") >= least).agg(F.count(F.lit(1)).alias("groups"))
        totals = totals.crossJoin(F.broadcast(groups))  # one row each
    else:
        totals = totals.withColumn("groups", F.lit(None).cast("long"))
    rated_only = F.lit(needs_ratings(tests, sort))
    status = F.when(rated_only & (F.col("rated") == 0), "unavailable").when(F.col("groups") < 2, "unavailable").when(F.col("count") == 0, "empty").otherwise("ok")
    return totals.select(F.lit(name).alias("name"), status.alias("status"), "count", F.when(F.col("rated") > 0, F.col("rated")).otherwise(F.col("every")).alias("total"), "groups")


def insight_rows(df: DataFrame, tests: list[tuple], sort: str, limit: int, pair: tuple[str, str] | None = None, show: str | None = None, decimals: int = 1) -> DataFrame:
    """The card's rows: place, key, label, group, value and its text: a pair of quartiles, or the measure shown (else the one sorted by)."""
    order = Window.orderBy(F.col(sort).desc_nulls_last(), "key")
    best = df.where(predicate(list(tests))).orderBy(F.col(sort).desc_nulls_last(), "key").limit(limit).withColumn("place", F.row_number().over(order))  # ``limit`` rows
    if pair:
        a, b = (F.col(c).cast("int") for c in pair)
        value, text = F.lit(None).cast("double"), F.when(a.isNotNull() & b.isNotNull(), F.concat(F.lit("Q"), a, F.lit(" / Q"), b)).otherwise("—")
    else:
        value = F.col(show or sort).cast("double")
        text = F.coalesce(shown(value, decimals), F.lit("—"))
    return best.select("place", "key", "label", F.col("category").alias("group"), value.alias("value"), text.alias("value_label"))


def drill_keys(df: DataFrame, tests: list[tuple], sort: str, most: int = DRILL) -> DataFrame:
    """Keys that a card hands on, best first."""
    return df.where(predicate(list(tests))).orderBy(F.col(sort).desc_nulls_last(), "key").select("key").limit(most)


WORDS = {0.1: "tenth", 0.2: "fifth", 0.25: "quarter", 0.5: "half"}
SIGNS = {"lt": "<", "lte": "≤", "gt": ">", "gte": "≥", "ne": "≠", "eq": "="}


def rule_text(tests: list[tuple], places: dict[str, tuple[str, str, str]]) -> str:
    """The tests in words, each with its heading and where it stands. ``places``: column to (heading, sheet, column letter)."""
    said = []
    for name, test, *rest in tests:
        heading, sheet, letter = places.get(name, (name, "", ""))
        target = rest[0] if rest else None
        plain = target[1:].replace("_", " ") if isinstance(target, str) and target.startswith("$") else f"{target:g}" if isinstance(target, float) else target
        if test in ("top", "bottom"):
            share = WORDS.get(target, f"{target:.0%}" if target else "quarter")
            words = f"{heading} in the {'best' if test == 'top' else 'worst'} {share}"
        elif test in ("notnull", "isnull"):
            words = f"{heading} {'has a value' if test == 'notnull' else 'is blank'}"
        elif test == "in":
            words = f"{heading} is one of {', '.join(map(str, target))}"
        elif test in TESTS:
            words = f"{heading} {SIGNS[test]} {plain}"
        else:
            raise ValueError(f"no such test: {test}")
        said.append(words + (f" ({sheet}, column {letter})" if sheet else ""))
    return " and ".join(said)


def universe_summary(df: DataFrame, inside: Column, age: Column, least_age: float, least: int = 4) -> DataFrame:
    """One row over entities that ``inside`` marks: total, rated, ranked, small (rated, category too small); of the unrated: young (of less than ``least_age``), gap (old enough, a value
    is missing) and unknown (no age); outside (not in the universe), and the median and largest category sizes."""
    flagged = df.withColumn("__in", F.coalesce(inside, F.lit(False))).withColumn("__age", age)
    of = lambda c: F.count_if(F.col("__in") & c)
    unrated = F.col("score").isNull()
    sizes = flagged.where("__in").groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("rated"))
    by_category = sizes.agg(F.median("n").alias("median_size"), F.max("n").alias("largest"), F.coalesce(F.sum(F.when(F.col("rated") < least, F.col("rated"))), F.lit(0)).alias("small"))
    totals = flagged.agg(of(F.lit(True)).alias("total"), of(~unrated).alias("rated"), of(unrated & (F.col("__age") < least_age)).alias("young"), of(unrated & (F.col("__age") >= least_age)).alias("gap"), of(unrated & F.col("__age").isNull()).alias("unknown"), F.count_if(~F.col("__in")).alias("outside"))
    return totals.crossJoin(F.broadcast(by_category)).withColumn("ranked", F.col("rated") - F.col("small"))  # one row each


def pick_versions(versions: DataFrame) -> DataFrame:
    """(role, version): current, the active version or else the newest with a baseline run, and previous, the latest other version that was activated and uploaded before it.
    ``versions``: version, uploaded_at, activated_at (null: never), active, has_baseline."""
    usable = versions.where("active or has_baseline")
    current = usable.orderBy(F.col("active").desc(), F.col("uploaded_at").desc(), F.col("version").desc()).limit(1)
    one = current.select(F.col("version").alias("__v"), F.col("uploaded_at").alias("__at"))
    earlier = versions.where("activated_at is not null and has_baseline").crossJoin(F.broadcast(one)).where((F.col("version") != F.col("__v")) & (F.col("uploaded_at") < F.col("__at")))  # one row
    previous = earlier.orderBy(F.col("activated_at").desc(), F.col("version").desc()).limit(1)
    return current.select(F.lit("current").alias("role"), "version").unionByName(previous.select(F.lit("previous").alias("role"), "version"))


def report_summary(df: DataFrame, texts: list[str], number: str) -> DataFrame:
    """Count and mean of ``number`` by the best text column: of those with 2 to 40 values and 60 % filled, the fullest, then the first given. Distinct values are counted exactly, in one pass."""
    counted = df.agg(F.count(F.lit(1)).alias("__all"), *(F.count_distinct(c).alias(f"d_{c}") for c in texts), *(F.count(c).alias(f"n_{c}") for c in texts)).first()  # one row
    fit = [c for c in texts if 2 <= counted[f"d_{c}"] <= 40 and counted[f"n_{c}"] >= 0.6 * counted["__all"]]
    if not fit:
        return df.sparkSession.createDataFrame([], "column string, value string, count long, mean double")
    best = max(fit, key=lambda c: (counted[f"n_{c}"], -texts.index(c)))
    return df.where(F.col(best).isNotNull()).groupBy(F.lit(best).alias("column"), F.col(best).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"), F.avg(number).alias("mean"))


def largest_moves(now: DataFrame, before: DataFrame, key: str, value: str, most: int = 20) -> DataFrame:
    """The ``most`` rows whose value changed most, by size of the change, ties by key."""
    both = now.select(key, F.col(value).alias("now")).join(before.select(key, F.col(value).alias("before")), key).withColumn("change", F.col("now") - F.col("before")).where("change <> 0")
    return both.orderBy(F.abs("change").desc(), key).limit(most)


def kpis(df: DataFrame, moved: DataFrame) -> DataFrame:
    """The summary page's numbers in one row: total, rated, categories, first quartile, mean score, risers, fallers, and the best entity."""
    own = df.agg(F.count(F.lit(1)).alias("total"), F.count("score").alias("rated"), F.count_distinct("category").alias("categories"), F.count_if(F.col("quartile") == 1).alias("first_quartile"), F.avg("score").alias("mean_score"), F.max_by("key", F.struct("score", -F.col("key"))).alias("best"))
    return own.crossJoin(F.broadcast(moved.agg(F.count_if(F.col("delta") > 0).alias("rose"), F.count_if(F.col("delta") < 0).alias("fell"))))  # one row each
