"""Versions from upload to activation, maps, pages' words: against known values."""

import pytest
from pyspark.sql import functions as F
from workbooks import cells_of, put, shop

from gridloom.operators import pages as P
from gridloom.operators import structure as T
from gridloom.plans import research_map as M
from gridloom.plans import run as R
from gridloom.workspace import Refused, Workspace


@pytest.fixture(scope="module")
def space(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path_factory.mktemp('checkpoints')}")
    return Workspace(spark, f"file://{tmp_path_factory.mktemp('space')}", {"large_export": 50})


def stored(spark, book, names):
    """A small book whose formula cells hold their right values, as a saved file has them."""
    from gridloom.plans.model import derive

    cells = cells_of(spark, book).coalesce(1)
    values = R.run(cells, derive(cells, names))
    return cells.join(values.select("sheet", "row", "col", F.col("c").alias("__v")), ["sheet", "row", "col"], "left").withColumn("c", F.coalesce("__v", "c")).select("sheet", "row", "col", "formula", "c", "format")


def small(day=24.0):
    book = {("Rates", 1, 2): 0.2, ("Data", 1, 1): day}
    for r in range(2, 6):
        book["Data", r, 1], book["Data", r, 2] = float(r), f"=A{r}*Rates!$B$1"
    book["Sum", 1, 1] = "=SUM(Data!B2:B5)"
    return book


def test_life_of_a_version(spark, space):
    first = space.upload(stored(spark, small(), {"Vat": "Rates!$B$1"}), {"Vat": "Rates!$B$1"}, "first")
    assert space.current() is None
    with pytest.raises(Refused, match="not validated"):
        space.activate(first)
    report = space.process(first)
    assert report["status"] == "pending_review" and report["steps"]["validate"]["status"] == "passed" and space.version(first)["status"] == "pending_review"
    space.activate(first)
    run = space.what_if(first, {"Vat": 0.5})
    assert {(r["sheet"], r["row"], r["col"]): r["c"]["n"] for r in space.values(first, run).collect()}["Sum", 1, 1] == 7.0
    deep = space.lineage(first, "Sum!A1", depth=6)
    assert deep["value"] == pytest.approx(2.8) and [b["cell"] for b in deep["below"]] == ["Data!B2", "Data!B3", "Data!B4", "Data!B5"]
    assert {(r["area"], r["depth"]) for r in space.graph(first).collect()} == {("Data!B2:B5", 0), ("Sum!A1", 1)}
    wrong = stored(spark, small(), {}).withColumn("c", F.when(F.col("sheet") == "Sum", F.struct(F.lit(1).cast("tinyint").alias("k"), F.lit(9.0).alias("n"), F.lit(None).cast("string").alias("s"))).otherwise(F.col("c")))
    second = space.upload(wrong, {"Vat": "Rates!$B$1"}, "second")
    assert space.process(second)["steps"]["validate"]["status"] == "failed"
    with pytest.raises(Refused, match="reason"):
        space.activate(second)
    assert space.current() == first
    space.activate(second, "known rounding")
    assert (space.current(), space.previous(second), space.version(first)["status"]) == (second, first, "superseded")
    loop = space.upload(cells_of(spark, {("S", 1, 1): "=B1", ("S", 1, 2): "=A1"}))
    assert space.process(loop)["failed"] == "run" and space.version(loop)["status"] == "failed"
    with pytest.raises(Refused, match="circle"):
        space.activate(loop, "please")
    with pytest.raises(Refused):
        space.version("nothing")


def test_snapshots_and_exports(spark, space):
    name = space.current()
    rows = spark.createDataFrame([("a", "A", "x", 1, 1, 2.0), ("b", "B", "x", None, None, None)], "key string, label string, category string, rank long, quartile int, score double")
    assert space.snapshot(name) is None
    space.save_snapshot(name, rows, 45000.0)
    assert space.snapshot(name).where("as_of = 45000").count() == 2
    space._put(space.version(name) | {"baseline": "another run"})
    assert space.snapshot(name) is None
    made = space.export(rows, "ranks")
    assert made["rows"] == 2 and not made["job"] and spark.read.option("header", True).csv(made["path"]).count() == 2
    assert space.export(spark.range(40).selectExpr("id", "id as b"), "large")["job"]


def test_rules_by_sheet_and_kind(spark, space):
    name = space.upload(cells_of(spark, shop(3)).coalesce(1), {"Vat": "Rates!$B$2"})
    every = space.rules(name)
    some = space.rules(name, "Ledger", "condition")
    assert some and len(some) < len(every) and {(r["sheet"], r["kind"]) for r in some} == {("Ledger", "condition")}


def test_maps(spark):
    book = {("People", r, c): v for r, row in enumerate([("id", "team", "score"), ("ann", "x", 1.0), ("bob", "y", "--"), ("cyd", None, True)], 1) for c, v in enumerate(row, 1)}
    book |= {("More", 1, 1): "ANN", ("More", 1, 2): 7.0, ("More", 2, 1): "ann", ("More", 2, 2): 8.0, ("More", 3, 1): "BOB", ("More", 3, 2): 9.0}
    cells = cells_of(spark, book)
    spec = {"entity": {"sheet": "People", "key": "A", "rows": [2, 4]}, "dimensions": {"team": {"column": "B"}}, "measures": {"score": {"column": "C"}, "more": {"sheet": "More", "key": "A", "column": "B"}, "far": {"sheet": "More", "key": "A", "column": "Z"}}}
    found = M.resolve(spec, cells)
    assert found.problems == ["measures.far: column Z lies outside of 'More' (last column B)"]
    got = {r["key"]: (r["team"], r["score"], r["more"]) for r in M.entity_frame(cells, found).collect()}
    assert got == {"ann": ("x", 1.0, 8.0), "bob": ("y", None, 9.0), "cyd": (None, None, None)}
    with pytest.raises(M.MapError, match="did you mean 'People'"):
        M.resolve({"entity": {"sheet": "Peple", "key": "A"}}, cells)
    with pytest.raises(M.MapError, match="too few"):
        M.resolve({"entity": {"sheet": "People", "key": "B"}}, cells.where("row in (1, 4) or col = 1"))
    assert M.check_map({"entity": {"sheet": "S", "key": "1"}, "measure": {}}) == ["unknown part 'measure'; did you mean 'measures'?", "entity.key: '1' is no column letter"]
    with pytest.raises(ValueError):
        M.pivot_source(cells, "Sales")


def test_rule_texts():
    places = {"quartile": ("Quartile", "Funds", "K"), "score": ("Score", "Funds", "I")}
    assert P.rule_text([("quartile", "top", 0.25), ("score", "gt", "$least_score")], places) == "Quartile in the best quarter (Funds, column K) and Score > least score (Funds, column I)"
    assert P.rule_text([("plan", "in", ["a", "b"]), ("score", "isnull"), ("score", "gte", 2.0)], {}) == "plan is one of a, b and score is blank and score ≥ 2"
    with pytest.raises(ValueError):
        P.rule_text([("score", "like", 1)], {})
    assert P.needs_ratings([("rank", "isnull")]) is False and P.needs_ratings([("size", "gt", 1)], "score")


def test_graphs_with_circles_are_refused(spark, space):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "source long, target long")
    with pytest.raises(ValueError, match="cycle"):
        T.depths(edges)
    assert T.spill(spark.createDataFrame([("S", 1, 1, 2, 3, [[1.0], [2.0]])], "sheet string, r1 int, c1 int, r2 int, c2 int, values array<array<double>>")).orderBy("row", "col").select("value").collect() == [(1.0,)] * 3 + [(2.0,)] * 3


def test_labels_beside_and_above(spark):
    cells = spark.createDataFrame([("S", 1, 2, "head"), ("S", 3, 2, None), ("S", 9, 1, "side"), ("S", 9, 2, None), ("S", 20, 9, None)], "sheet string, row int, col int, text string")
    got = {(r["row"], r["col"]): r["label"] for r in T.labels(cells).collect()}
    assert got[3, 2] == "head" and got[9, 2] == "side" and got[20, 9] is None


def test_queries_of_pages_have_sql():
    import __spark_entry__  # noqa: F401  registers all
    from gridloom import queries

    assert set(queries.SQL) == set(queries.QUERIES) and "entity_filter" in queries.QUERIES
