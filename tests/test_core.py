"""Formulas, models, runs, differences, workbooks, research: against known values."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from workbooks import RULES, cells_of, known, put, same, shop

from gridloom.functions import scalar as S
from gridloom.functions.criteria import parse_criterion
from gridloom.functions.values import general, round15
from gridloom.operators import aggregates as A
from gridloom.operators import research as R
from gridloom.operators import validation as Q
from gridloom.plans import diff as D
from gridloom.plans import formula as L
from gridloom.plans import run as RR
from gridloom.plans.evaluate import Err, Evaluator, matches
from gridloom.plans.model import derive, function_inventory, rules, scope_closure


def values_of(df):
    return {(r["sheet"], r["row"], r["col"]): RR.to_python(*r["c"]) for r in df.collect()}


NAMES = {"Vat": "Rates!$B$2"}


@pytest.fixture(scope="module")
def book(spark):
    cells = cells_of(spark, shop()).coalesce(2).cache()
    return cells, derive(cells, NAMES)


@pytest.fixture(scope="module")
def baseline(book):
    return RR.run(*book)


@pytest.mark.parametrize("text", ["-2^2", "1+2*3%", "SUM(B$2:B5)", 'IF(A1>"x",VLOOKUP(A1,Lookup!$A$1:$B$4,2,FALSE),"n/a")', "'My ''Sheet'!A1&\"q\"\"t\"", "{1,2;3,4}", "SUM(A:A)", "1-(2-3)", "Table1[x]+1", "FOO(,1)", "2^-1", "(1+2)*3"])
def test_formula_text_round_trips(text):
    tree = L.parse(text, 5, 2, "S")
    assert L.parse(L.render(tree, (5, 2)), 5, 2, "S") == tree


@pytest.mark.parametrize("text", ["1+", "SUM(1", '"open', "1 2", ")"])
def test_bad_formulas_are_refused(text):
    with pytest.raises(L.FormulaError):
        L.parse(text)


def test_copies_share_a_template():
    assert L.render(L.parse("A1+$B$1", 1, 3)) == L.render(L.parse("A9+$B$1", 9, 3)) != L.render(L.parse("A8+$B$1", 9, 3))
    assert L.fast_key('A1&"A1"', 1, 3) == L.fast_key('A7&"A1"', 7, 3).replace("A7", "A1")


def test_numbers_and_criteria():
    assert [general(x) for x in (1.0, 0.1, 1e15, 1e-7, 123456789012345678.0, -2.5)] == ["1", "0.1", "1E+15", "1E-07", "1.23456789012346E+17", "-2.5"]
    assert round15(0.1 + 0.2) == 0.3
    c = parse_criterion
    assert matches("Alpha", c("a*")) and not matches("beta", c("a*")) and matches("a*b", c("a~*b")) and not matches("axb", c("a~*b"))
    assert matches(None, c("<>x")) and matches(5.0, c(">4")) and not matches("5", c(">4")) and matches(True, c("TRUE")) and not matches(1.0, c(True)) and matches(Err("#N/A"), c("#N/A"))


def test_rules_one_cell_at_a_time():
    book, names, done = shop(), {"vat": L.parse("Rates!$B$2")}, {}
    used = {s: (max(r for t, r, _ in book if t == s), max(c for t, _, c in book if t == s)) for s in {k[0] for k in book}}

    def get(sheet, row, col):
        v = book.get((sheet, row, col))
        if isinstance(v, str) and v.startswith("="):
            if (sheet, row, col) not in done:
                done[sheet, row, col] = Evaluator(get, sheet, names, used).cell(L.parse(v[1:], row, col, sheet), row, col)
            return done[sheet, row, col]
        return v

    assert {text: get("Rules", i, 3) for i, (text, want) in enumerate(RULES.items(), 1) if not same(get("Rules", i, 3), want)} == {}


def test_model(book):
    cells, m = book
    s = m.summary()
    assert s["cycles"] == 0 and not s["unsupported"] and not m.cycles
    assert m.block_at("Ledger", 10, 3).recursion == "top_to_bottom" and m.block_at("Ledger", 10, 4).recursion == "none"
    assert m.roles["Codes"] == "reference" and m.roles["Totals"] == "output"
    assert any(k == "condition" and "small" in words for k, words in rules(m.block_at("Ledger", 5, 4)))
    place = {b: i for i, b in enumerate(m.order)}
    assert all(place[a] < place[b] for a, b in m.edges)
    assert {r["function"]: r["formulas"] for r in function_inventory(cells).collect()}["VLOOKUP"] == 26
    assert scope_closure(cells, ["Totals"]) == {"Totals", "Ledger", "Rates", "Codes"}


def test_full_run(baseline):
    got = values_of(baseline)
    assert {k: (got.get(k), v) for k, v in known().items() if not same(got.get(k), v)} == {}


def test_compiled_blocks_equal_single_cells(spark):
    """Every block as a job of its own, by joins, aggregates and windows."""
    part = {k: v for k, v in shop(20).items() if k[0] in ("Rates", "Codes") or k[0] == "Totals" and k[1] == 1 or k[0] == "Ledger" and k[2] not in (6, 7)}
    cells = cells_of(spark, part).coalesce(2)
    m = derive(cells)
    got, want = values_of(RR.run(cells, m, small=0)), known(20)
    assert {k: (v, want[k]) for k, v in got.items() if not same(v, want[k])} == {} and len(got) == 121


@pytest.mark.parametrize("text,want", [
    ("SUMIF(A1:A5,\">1\",B1:B5)", 90.0), ("COUNTIF(A1:A5,A2)", 2.0), ("SUMPRODUCT(A1:A5,B1:B5)", 170.0), ("VLOOKUP(2.5,A1:B5,2,TRUE)", 40.0), ("VLOOKUP(9,A1:B5,2,FALSE)", Err("#N/A")),
    ("HLOOKUP(1,A1:B5,2,FALSE)", 2.0), ("AND(A1:A5)", True), ("AVERAGEIF(A1:A5,\"<0\")", Err("#DIV/0!")), ("MAX(A1:A5,7)", 7.0), ("SUM(C1:C5)", 0.0), ("VLOOKUP(1,A1:B5,3,FALSE)", Err("#REF!")), ("LEFT(\"abc\",-1)", Err("#VALUE!")), ("1/0", Err("#DIV/0!")),
])
def test_compiled_functions(spark, text, want):
    data = {("S", i, 1): v for i, v in enumerate((1.0, 2.0, 2.0, 3.0, "x"), 1)} | {("S", i, 2): 10.0 * i for i in range(1, 6)}
    data["S", 3, 2] = 40.0
    data["S", 4, 2] = 30.0
    data["S", 1, 4] = "=" + text
    cells = cells_of(spark, data).coalesce(1)
    m = derive(cells)
    got = values_of(RR.block_values(cells.where("formula is null").select("sheet", "row", "col", "c"), m.blocks[0], m))["S", 1, 4]
    used = {"S": (5, 4)}
    alone = Evaluator(lambda s, r, c: data.get((s, r, c)), "S", {}, used).cell(L.parse(text, 1, 4, "S"), 1, 4)
    assert same(got, alone) and (text.startswith(("SUMIF", "SUMPRODUCT", "VLOOKUP(2.5")) or same(got, want))


def test_what_if(book, baseline):
    cells, m = book
    hit = RR.affected(m, [("Rates", 3, 2)])
    assert {m.blocks[i].rect.a1() for i in hit} == {"Ledger!G2:G25"}
    got = values_of(RR.run(cells, m, {"Rates!B3": 20.0}, baseline))
    assert got == {("Ledger", r, 7): shop()["Ledger", r, 2] < 20 for r in range(2, 26)} and set(got.values()) == {True, False}
    place = ("Rules", list(RULES).index("=Vat*50") + 1, 3)
    named = values_of(RR.run(cells, m, {"Vat": 0.5}, baseline))
    assert named == {place: 25.0}
    assert values_of(RR.full_values(baseline, RR.run(cells, m, {"Vat": 0.5}, baseline)))[place] == 25.0
    for bad in ("Ledger!C5", "Nowhere!A1", "nothing"):
        with pytest.raises(RR.RunRefused):
            RR.parse_override(bad, m)


def test_cycles_and_unknown_functions(spark):
    loop = cells_of(spark, {("S", 1, 1): "=B1+1", ("S", 1, 2): "=A1+1", ("S", 1, 3): 5.0, ("S", 2, 1): "=C1*2"})
    m = derive(loop)
    assert m.cycles and "S!A1" in m.describe_cycles()[0]
    with pytest.raises(RR.RunRefused, match="circular"):
        RR.run(loop, m)
    odd = cells_of(spark, {("S", 1, 1): "=XLOOKUP(1,B1:B2,C1:C2)"})
    with pytest.raises(RR.RunRefused, match="XLOOKUP"):
        RR.run(odd, derive(odd))


def test_lineage(book, baseline):
    cells, m = book
    got = RR.lineage(baseline, cells, m, "Ledger!D3")  # 79
    assert got["formula"].startswith("=IF(B3<30") and got["value"] == got["stored"] == "large"
    assert [d[3] for d in got["decisions"]] == [False, False]
    assert "Ledger!E2:E25" in RR.dependents(m, "Ledger!D3")


def test_differences(spark, book):
    cells, m = book
    changed = shop(small=33)
    put(changed, "Rates!B3", 51.0)
    new = cells_of(spark, changed).coalesce(2)
    report = D.compare(cells, new, m, derive(new, {"Vat": "Rates!$B$3"}))
    assert report["data"] == {"changed": 1} and report["structure"]["names"]["vat"] == ("Rates!$B$2", "Rates!$B$3")
    assert any(x["sheet"] == "Ledger" and x["column"] == "D" and "30 became 33" in x["words"] and x["rows"] == (2, 25) for x in report["logic"])
    assert report["rules_added"] and report["headline"].endswith("1 input change")


def test_workbook_files(spark, tmp_path):
    from gridloom.sources import store, xlsx

    rows = [(1, 1, "Month", None, None), (1, 2, 46053.0, "d mmm yyyy", None), (2, 1, 0.1 + 0.2, "0.00%", None), (2, 2, True, None, None), (2, 3, "#N/A", None, None), (2, 4, 3.0, None, "1+2"), (3, 1, 'a<b&"c"', None, None)]
    path = str(tmp_path / "book.xlsx")
    xlsx.write_workbook(path, {"Data": rows, "x" * 40: [(1, 1, 1.0, None, None)], "X" * 40: [(1, 1, 2.0, None, None)]}, {"version": "v1"})
    info = xlsx.inspect(path)
    assert [s["name"] for s in info["sheets"]] == ["About", "Data", "x" * 31, "X" * 29 + "~2"] and not info["warnings"]
    cells = xlsx.read_workbook(spark, path)
    got = values_of(cells.where("sheet = 'Data'"))
    assert got["Data", 2, 1] == 0.1 + 0.2 and got["Data", 2, 2] is True and got["Data", 2, 3] == "#N/A" and isinstance(got["Data", 2, 3], Err) and got["Data", 3, 1] == 'a<b&"c"'
    assert cells.where("formula is not null").select("formula").first()[0] == "1+2"
    with pytest.raises(xlsx.UnreadableWorkbook):
        xlsx.inspect(str(tmp_path / "old.xls"))
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    with pytest.raises(xlsx.UnreadableWorkbook):
        xlsx.inspect(str(tmp_path / "bad.xlsx"))
    root = f"file://{tmp_path}/store"
    store.save_cells(cells, root, "v1")
    back = store.load_cells(spark, root, "v1", ["Data"])
    assert values_of(back) == got
    text = store.window_csv(store.grid_window(back, "Data", 1, 1), bom=False)
    assert text.splitlines()[0] == "Month,2026-01-31,," and text.splitlines()[1] == "0.30000000000000004,TRUE,#N/A,3"
    values = back.where("formula is not null").select("sheet", "row", "col", "c")
    store.save_run(values, root, "r1")
    assert store.load_run(spark, root, ["r1"]).count() == 1
    assert store.sheet_values(back, values).where("stale").count() == 0
    page = store.html_report("T", [("A", ["x"], [[1.5], ["<"]])], [1, 2, 3], {"run": "r1"})
    assert "&lt;" in page and "<svg" in page


def test_validation(spark, book, baseline):
    cells, _ = book
    computed = baseline
    bump = F.when((F.col("sheet") == "Ledger") & (F.col("row") == 21) & (F.col("col") == 3), F.struct(F.lit(1).cast("tinyint").alias("k"), (F.col("c.n") + 1).alias("n"), F.col("c.s").alias("s"))).otherwise(F.col("c"))
    cached = computed.withColumn("c", bump)
    counts, bad = Q.reconcile(computed, cached)
    assert {(r["sheet"], r["class"]): r["n"] for r in counts.collect()}["Ledger", "semantics"] == 1 and bad.count() == 1
    assert Q.status({"match": 10}) == "passed" and Q.status({"match": 10, "semantics": 1}) == "failed" and Q.status({"match": 5000, "precision": 1}) == "passed_with_warnings" and Q.status({}) == "failed"
    blocks = spark.createDataFrame([("S", 2, 2, 2, 29, "a"), ("S", 2, 2, 30, 30, "b"), ("S", 2, 2, 31, 60, "a")], "sheet string, c1 int, c2 int, r1 int, r2 int, template string")
    assert [r["r1"] for r in Q.fragments(blocks).collect()] == [30]


def test_pivot(spark):
    data = [("Birch", "tall", "north", 30.0), ("Birch mirror", "tall", "south", 14.0), ("Cedar", "tall", "north", 22.0), ("Daisy", "low", "north", 3.0), ("Daisy mirror", "low", "south", 5.0), ("Fern", "low", "north", 1.0), ("Gorse", "middle", "north", 9.0), ("Hazel", "middle", "south", 8.0)]
    df = spark.createDataFrame(data, "plant string, height string, side string, age double")
    p = A.pivot_table(df, ["height"], [("average", "age", "mean"), ("count", "plant", "n")], filters={"side": ["north"]})
    got = {(r["height"], r["level"]): (r["mean"], r["n"]) for r in p.collect()}
    assert got == {("tall", 0): (26, 2), ("low", 0): (2, 2), ("middle", 0): (9, 1), (None, 1): (13, 5)}
    x = {r["height"]: r for r in A.pivot_table(df, ["height"], [("max", "age", "m"), ("countNums", "age", "n")], "side", subtotals=False).collect()}
    assert (x["middle"]["north_m"], x["middle"]["north_n"], x["middle"]["south_m"], x["middle"]["m"], x["middle"]["n"]) == (9, 1, 8, 9, 2)
    assert A.field_kind(df, "age") == "number" and A.field_kind(df, "plant") == "text"


def test_words():
    assert R.render("{n|fund|funds} of {total}", {"n": 1, "total": 3}) == "1 fund of 3" and R.render("{x}", {}) is None and R.render("{n?is|are}", {"n": 2}) == "are"
    said = R.narrate([{"text": "{n} rose", "zero": "none rose", "count": "n"}, {"text": "x", "requires": ["y"]}, {"text": "z", "unless": ["n"]}], {"n": 0})
    assert said == ["none rose", "z"]
    assert S.show(1234567.891, indian=True) == "12,34,567.89" and S.show(0.1234, "percent", 1) == "12.3%" and S.show(46053, "date") == "31 Jan 2026" and S.show(None) == "–"
    assert S.format_kind("0.00%") == "percent" and S.format_kind("d mmm yyyy") == "date" and S.format_kind("General") == "general" and S.format_kind("#,##0") == "integer"
    assert S.find_days("from 31 Jan 2026 to 28 Feb 2026") == [46053.0, 46081.0] and S.parse_day("2026-01-31") == 46053.0 and S.parse_day("soon") is None
    s = R.Scope.parse('{"quartiles": [2, 1], "text": "q"}')
    assert R.Scope.parse(s.key()).key() == s.key() and "quartile 1, 2" in s.words()
    with pytest.raises(ValueError):
        R.Scope.parse('{"what": 1}')
    assert R.fingerprint([("a", 1, 1), ("b", 2, 2)]) == R.fingerprint([("b", 2, 2), ("a", 1, 1)]) and R.fingerprint([], 5) == "as-of:5"


def test_streaming(spark, tmp_path):
    from gridloom.streaming import distinct_snapshots

    spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:10:00"), (3, "b", "2024-01-01 00:20:00")], "id int, print string, ts string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int, print string, ts string").parquet(f"{tmp_path}/in")
    q = distinct_snapshots(stream, ["print"], "ts").writeStream.format("memory").queryName("snaps").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("snaps").count() == 2


def test_queries_equal_sql(spark):
    """A part of the catalogue on the smallest tables; each name has both forms."""
    from gridloom import queries as core

    assert set(core.SQL) == set(core.QUERIES)
    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for f in os.listdir(d):
        con.sql(f"create view {f[:-8]} as select * from '{d}/{f}'")
    for name in ("countif_wildcard", "vlookup_approx", "rank_ops", "explore_group", "pivot_subtotals", "interval_sweep", "set_changes", "top_bottom_share"):
        got = core.QUERIES[name](spark, d)
        cols = sorted(got.columns)
        key = lambda rows: sorted(tuple("" if v is None else round(v, 4) if isinstance(v, float) else v for v in r) for r in rows)
        show = lambda rows: [tuple(map(str, r)) for r in key([[x if x is None or isinstance(x, (int, float)) else str(x) for x in r] for r in rows])]
        want = con.sql(f"select {', '.join(cols)} from ({core.SQL[name]})").fetchall()
        assert sorted(show(map(list, got.select(*cols).collect()))) == sorted(show(map(list, want))), name


def test_graph_queries_see_whole_tables(spark):
    """The operators over all customers, parts and line items, beside SQL and brute force."""
    from gridloom import queries as core

    con, d = duckdb.connect(), "/root/testdata/sf0.01"
    for table in ("customer", "part", "lineitem"):
        con.sql(f"create view {table} as select * from '{d}/{table}.parquet'")
    for name in ("interval_sweep", "rect_overlap_edges", "reachability"):
        got = core.QUERIES[name](spark, d)
        want = con.sql(f"select {', '.join(got.columns)} from ({core.SQL[name]})").fetchall()
        assert len(want) > 500 and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_interval_sweep_brute(spark):
    """Nested, equal, empty, reversed and null intervals."""
    from gridloom.operators import joins as J

    rng = random.Random(3)
    make = lambda n: [(rng.choice(["a", "b", None]), rng.choice([None, *range(12)]), rng.randint(0, 12), rng.choice("xyz")) for _ in range(n)]
    old, new = make(40), make(40)
    want = set()
    for g in "ab":
        cuts = sorted({x for side in (old, new) for r in side if r[0] == g for x in r[1:3] if x is not None})
        for lo, hi in zip(cuts, cuts[1:]):
            a, b = (min((r[3] for r in side if r[0] == g and r[1] is not None and r[1] <= lo and hi <= r[2]), default=None) for side in (old, new))
            if a or b:
                want.add((g, lo, hi, a, b, "added" if not a else "removed" if not b else "same" if a == b else "changed"))
    frame = lambda rows: spark.createDataFrame(rows, "g string, lo long, hi long, key string")
    assert {tuple(r) for r in J.interval_sweep(frame(old), frame(new), ["g"], "key").collect()} == want


def test_crosstab_refuses_what_it_cannot_show(spark):
    df = spark.range(1001).selectExpr("'g' as g", "id as k", "1 as v")
    with pytest.raises(ValueError, match="more than 1000 keys"):
        A.pivot_table(df, ["g"], [("sum", "v", "v")], "k")
    assert len(A.pivot_table(df.where("k < 3"), ["g"], [("sum", "v", "v")], "k", subtotals=False).columns) == 6


def test_rounds_never_end_silently(spark):
    from gridloom.operators import joins as J
    from gridloom.checkpoints import ensure_checkpoints

    ensure_checkpoints(spark)
    chain = spark.range(9).selectExpr("id as source", "id + 1 as target")
    start = spark.createDataFrame([(0,)], "node long")
    with pytest.raises(RuntimeError):
        J.reachable(chain, start, most=3)
    assert J.reachable(chain, start).count() == 10


def test_overlaps_brute(spark):
    """Rectangles of all sizes, reversed, negative and null ones, ids with several; the join has tiles in its keys."""
    from gridloom.operators import joins as J

    rng = random.Random(5)

    def make(n):
        rows = []
        for _ in range(n):
            r, c = rng.randint(-40, 200), rng.randint(1, 60)
            rows.append((rng.randint(1, n * 2 // 3), rng.choice(["s", "t", None]), rng.choice([r, r, r, None]), r + rng.choice([0, 0, 1, 5, 150, -3]), c, c + rng.choice([0, 2, 40])))
        return rows

    w, x = make(120), make(120)
    want = {(a[0], b[0]) for a in w for b in x if None not in (*a, *b) and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3] and a[4] <= b[5] and b[4] <= a[5]}
    frame = lambda rows: spark.createDataFrame(rows, "id long, sheet string, r1 int, r2 int, c1 int, c2 int").coalesce(1)
    found = J.overlap_edges(frame(w), frame(x))
    assert "at_r" in found._jdf.queryExecution().optimizedPlan().toString()
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40


def test_as_of_in_ranges(spark):
    """No task sees all keys; values reach over ranges that have none of their own, and nulls, infinities and ties are as before."""
    from gridloom.operators import joins as J

    rng = random.Random(7)
    left = [(i, rng.choice([None, float("-inf"), float("inf"), -5.0, 3.0, *[rng.uniform(0, 100) for _ in range(20)]])) for i in range(600)]
    table = {float(k): rng.choice([None, rng.random()]) for k in (2, 3, 50, 51, 97)}
    want = {i: None if x is None else next((table[k] for k in sorted(table, reverse=True) if k <= x and table[k] is not None), None) for i, x in left}
    found = J.as_of(spark.createDataFrame(left, "i int, x double").coalesce(2), "x", spark.createDataFrame(list(table.items()), "k double, v double").coalesce(1), "k", "v")
    assert {r["i"]: r["v"] for r in found.collect()} == want
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()


def test_depths_send_nothing(spark):
    """Longest paths beside brute force; no round broadcasts a table, which would pass through the driver."""
    from gridloom.checkpoints import ensure_checkpoints
    from gridloom.operators import structure as T
    from pyspark.sql import DataFrame

    ensure_checkpoints(spark)
    pairs, plans = [(k // 2, k) for k in range(2, 40)] + [(k // 3, k) for k in range(3, 40)] + [(5, 5)], []
    want = dict.fromkeys({x for p in pairs for x in p}, 0)
    for k in range(1, 40):
        want[k] = max([want[s] + 1 for s, t in pairs if t == k and s < k], default=0)
    edges = spark.createDataFrame(pairs, "source long, target long").coalesce(1)
    kind, plain = type(edges), type(edges).checkpoint
    try:
        kind.checkpoint = lambda d, *a: (plain(d, *a), plans.append(d._jdf.queryExecution().executedPlan().toString()))[0]
        got = T.depths(edges)
    finally:
        kind.checkpoint = plain
    assert {r["node"]: r["depth"] for r in got.collect()} == want and len(plans) > 3 and not any("Broadcast" in p for p in plans)

def test_template_key_and_runs(spark):
    """Copies share a key, names that end like references, numbers and table columns don't; runs cross the bounds of 64 rows, and a hole parts them."""
    from gridloom.operators.windows import rectangles
    from gridloom.plans.model import template_key

    rows = [('A1&"A1"&$B$2&S!aa3', 1, 3), ('A7&"A1"&$B$2&S!AA9', 7, 3), ("Rate12+1E5", 1, 1), ("Rate13+1E6", 2, 1), ("T[Col2]", 1, 1), ("T[Col3]", 2, 1), (None, 1, 1), ("A1&'it''s'!B$4&LOG10(2)", 1, 2), ("B1&'it''s'!C$4&LOG10(2)", 1, 3)]
    keys = [r[0] for r in spark.createDataFrame(rows, "f string, r int, c int").coalesce(1).select(template_key(F.col("f"), F.col("r"), F.col("c"))).collect()]
    assert keys[0] == keys[1] and keys[2] != keys[3] and keys[4] != keys[5] and keys[6] is None and keys[7] == keys[8]
    cells = [(r, c) for c in (3, 4) for r in range(2, 200) if r != 130] + [(63, 9), (64, 9), (64, 9)]
    found = rectangles(spark.createDataFrame([("g", *x) for x in cells], "g string, row int, col int"), ["g"]).collect()
    assert {tuple(r) for r in found} == {("g", 2, 129, 3, 4), ("g", 131, 199, 3, 4), ("g", 63, 64, 9, 9)}


def test_model_sorts_no_cells(spark):
    """Windows see runs of cells, and a file of one part becomes several."""
    from gridloom import queries_engine as E

    plan = E.workbook(spark, "/root/testdata/sf0.1")
    assert plan.where("sheet = 'Orders'").select(F.spark_partition_id().alias("p")).distinct().count() == 4
    assert [b.rect.a1() for b in derive(plan, E.NAMES).blocks] == [f"Orders!{c}2:{c}150001" for c in "CDEFGHI"] + ["Totals!A1", "Totals!A2", "Totals!A3"]

def test_wide_ranges_are_no_python_lists(spark, monkeypatch):
    """Totals over more cells than a Python process may hold: Spark's aggregates in parts give the values, and lineage counts what it reads without fetching it."""
    from gridloom.plans import compiler as C

    monkeypatch.setattr(RR, "WIDE", 20)
    monkeypatch.setattr(C, "PART", 16)
    alone = RR.in_order
    def few(state, blocks, model):
        assert sum(RR.reads_of(b, model) for b in blocks) <= 20
        return alone(state, blocks, model)
    monkeypatch.setattr(RR, "in_order", few)
    data = {("S", i, 1): float(i) for i in range(1, 101)} | {("S", i, 2): "x" if i % 3 else "y" for i in range(1, 101)}
    data |= {("T", 1, 1): "=SUM(S!A1:A100)", ("T", 2, 1): '=COUNTIF(S!B1:B100,"x")', ("T", 3, 1): '=SUMIF(S!B1:B100,"y",S!A1:A100)', ("T", 4, 1): "=SUMPRODUCT(S!A1:A100,S!A1:A100)", ("T", 5, 1): '=IF(MAX(S!A1:A100)>T!A2,"more","less")'}
    cells = cells_of(spark, data).coalesce(2)
    m = derive(cells)
    values = RR.run(cells, m).cache()
    assert values_of(values) == {("T", 1, 1): 5050.0, ("T", 2, 1): 67.0, ("T", 3, 1): 1683.0, ("T", 4, 1): 338350.0, ("T", 5, 1): "more"}
    got = RR.lineage(values, cells, m, "T!A5")
    assert got["value"] == got["stored"] == "more" and got["decisions"][0][3] is True and [(r["reference"], r["cells"], len(r["values"])) for r in got["reads"]] == [("S!A1:A100", 100, 8), ("A2", 1, 1)]


def test_copy_key_and_fetched_rows(spark):
    """Copies in a column have one copy key exactly where they have one template key; formulas are made once for all rows, and a second time for templates' first rows only."""
    from pyspark.sql import functions as F

    from gridloom.functions.values import EMPTY, cell
    from gridloom.plans.model import copy_key, derive, template_key

    texts = ["A{r}+1", "A{r}+2", "a{r}+1", "A$2+A{r}", "A2+A{r}", "$A{r}*'It''s A{r}'!$B${r}", 'IF(A{r}="A{r}","say ""A{r}""",B{a})', "SUM(A$2:A{r})", "ABC{r}.x+Sheet{r}!A{a}", "1E{r}+A{r}", "LOG10(A{r})", "Rate{r}*T[A{r}]", "A000{r}", "A12345678901234567"]
    rows = [(t.replace("{r}", str(r)).replace("{a}", str(r - 1)), r, 5) for t in texts for r in (2, 3, 12, 100)] + [(None, 2, 5)]
    got = spark.createDataFrame(rows, "f string, r int, c int").select(copy_key(F.col("f"), F.col("r")).alias("a"), template_key(F.col("f"), F.col("r"), F.col("c")).alias("b")).collect()
    pairs = {(str(x["a"]), str(x["b"])) for x in got}
    assert {a for a, b in pairs if b == "None"} == {"None"} and len({a for a, _ in pairs}) == len(pairs)
    made = spark.sparkContext.accumulator(0)

    def formula(row):
        made.add(1)
        return f"A{row}*2" if row < 1000 else f"A{row}*3"

    rows = spark.range(1, 2001).select(F.col("id").cast("int").alias("row"))
    cells = rows.select(F.lit("S").alias("sheet"), "row", F.lit(2).alias("col"), F.udf(formula, "string")("row").alias("formula"), cell(EMPTY).alias("c"), F.lit(None).cast("string").alias("format"))
    assert [b.rect.a1() for b in derive(cells).blocks] == ["S!B1:B999", "S!B1000:B2000"]
    assert made.value <= 2010
