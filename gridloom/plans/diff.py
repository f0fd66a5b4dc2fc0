"""What changed between two versions of a workbook: logic, inputs, structure, and what it reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import interval_sweep, jaccard_matches, keyed_diff
from . import formula as L
from .model import Model, rules


def sheet_renames(old: Model, new: Model, spark, least: float = 0.6) -> dict[str, str]:
    """Old to new names of sheets that share most templates: best matches first, each sheet once."""
    gone, came = set(old.used) - set(new.used), set(new.used) - set(old.used)
    rows = lambda m, sheets: [(b.rect.sheet, b.key) for b in m.blocks if b.rect.sheet in sheets]
    a, b = rows(old, gone), rows(new, came)
    if not a or not b:
        return {}
    frame = lambda r: spark.createDataFrame(r, "sheet string, key string")
    found = jaccard_matches(frame(a), frame(b), "sheet", "key", least).orderBy(F.desc("score"), "a", "b").collect()  # pairs of sheets
    out: dict[str, str] = {}
    for r in found:
        if r["a"] not in out and r["b"] not in out.values():
            out[r["a"]] = r["b"]
    return out


def template_changes(old: Model, new: Model, spark) -> DataFrame:
    """(sheet, col, lo, hi, old_key, new_key, change) of row intervals of each column whose template isn't the same."""

    def intervals(m: Model) -> DataFrame:
        rows = [(b.rect.sheet, c, b.rect.r1, b.rect.r2 + 1, b.key) for b in m.blocks for c in range(b.rect.c1, b.rect.c2 + 1)]
        return spark.createDataFrame(rows, "sheet string, col int, lo int, hi int, key string")

    return interval_sweep(intervals(old), intervals(new), ["sheet", "col"], "key").where("change <> 'same'")


def input_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Constants by address: added, removed, changed."""
    shown = lambda d: d.where("formula is null").select("sheet", "row", "col", F.to_json("c").alias("v"))
    return keyed_diff(shown(old), shown(new), ["sheet", "row", "col"], "v")


def describe(a, b) -> str:
    """How one tree differs from another, at the first place where they part."""
    if type(a) is not type(b):
        return f"{L.render(a)} became {L.render(b)}"
    if isinstance(a, L.Call) and a.name == b.name and len(a.args) == len(b.args):
        return next((describe(x, y) for x, y in zip(a.args, b.args) if x != y), "no change")
    if isinstance(a, L.Binary) and a.op == b.op:
        return describe(a.a, b.a) if a.a != b.a else describe(a.b, b.b)
    if isinstance(a, L.Number) and isinstance(b, L.Number):
        return f"constant {a.value:g} became {b.value:g}"
    return f"{L.render(a)} became {L.render(b)}"


def compare(old_cells: DataFrame, new_cells: DataFrame, old: Model, new: Model) -> dict:
    """The report: LOGIC (with words and reached outputs), DATA counts, STRUCTURAL changes, rules and names, and a headline."""
    spark = old_cells.sparkSession
    trees = {b.key: b.tree for m in (old, new) for b in m.blocks}
    logic = []
    known = {b.key for b in old.blocks}
    for r in template_changes(old, new, spark).orderBy("sheet", "col", "lo").collect():  # intervals of blocks
        words = describe(trees[r["old_key"]], trees[r["new_key"]]) if r["change"] == "changed" else r["new_key"] or r["old_key"]
        repair = r["change"] == "changed" and r["new_key"] in known and r["hi"] - r["lo"] <= 2
        block = new.block_at(r["sheet"], r["lo"], r["col"])
        reached = {b.rect.a1() for b in new.blocks if block and b.id in new.descendants({block.id}) and b.kind == "output"}
        logic.append({"sheet": r["sheet"], "column": L.column_letters(r["col"]), "rows": (r["lo"], r["hi"] - 1), "change": "repair" if repair else r["change"], "words": words, "outputs": sorted(reached)})
    data = {r["change"]: r["n"] for r in input_changes(old_cells, new_cells).groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
    said = lambda m: {(b.rect.sheet, *r) for b in m.blocks for r in rules(b)}
    names = {k: (old.names.get(k), new.names.get(k)) for k in old.names.keys() | new.names.keys() if old.names.get(k) != new.names.get(k)}
    structure = {
        "sheets_added": sorted(set(new.used) - set(old.used)), "sheets_removed": sorted(set(old.used) - set(new.used)), "renamed": sheet_renames(old, new, spark),
        "rows": {s: new.used[s][0] - old.used[s][0] for s in old.used.keys() & new.used.keys() if new.used[s][0] != old.used[s][0]},
        "roles": {s: (old.roles[s], new.roles[s]) for s in old.roles.keys() & new.roles.keys() if old.roles[s] != new.roles[s]},
        "names": {k: tuple(L.render(x, (1, 1)) if x else None for x in v) for k, v in names.items()},
    }
    changed = sum(x["change"] in ("changed", "repair") for x in logic)
    headline = f"{changed} formula change{'s' * (changed != 1)}, {sum(data.values())} input change{'s' * (sum(data.values()) != 1)}" if logic or data else "no changes"
    return {"headline": headline, "logic": logic, "data": data, "structure": structure, "rules_added": sorted(said(new) - said(old)), "rules_removed": sorted(said(old) - said(new))}
