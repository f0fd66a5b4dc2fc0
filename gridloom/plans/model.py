"""From cells to a model: templates (one per copied formula), blocks (rectangles of a template), their graph, roles, rules and inputs.

Cells are a DataFrame (sheet, row, col, formula, c, format). Keys, islands and overlaps are computed in Spark; what reaches the driver is
one row per template, block and edge: some hundreds for a workbook of a million cells. One pass over the cells makes runs of copies in a column,
of which the rest is derived; a second one fetches the first formula of each of these and reads only their rows, where they are few.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import overlap_edges
from ..operators.windows import column_runs, run_rectangles
from . import formula as L

_TEXT, _SHEET, _START, _END = r'"[^"]*+(?:""[^"]*+)*+"', r"(?:'[^']*+(?:''[^']*+)*+'|[A-Za-z_\\][\w.\\]*+)!", r"(?<![\w.\\\[\x{80}-\x{10FFFF}])", r"(?![\w(.\x{80}-\x{10FFFF}])"
#: Texts in quotes, and cell references that stand alone: not the end of a name, a number such as 1E5 or a table's column.
_KEY = rf"{_TEXT}|{_START}(?:{_SHEET})?\$?[A-Za-z]{{1,3}}\$?[0-9]+{_END}"
#: The same, of which only rows that move with the cell are taken, beside what stands before them.
_ROWS = rf"({_TEXT})|{_START}((?:{_SHEET})?\$?[A-Za-z]{{1,3}})([0-9]{{1,18}}+){_END}"
#: Templates' first rows that are named in a filter when formulas are fetched.
NAMED_ROWS = 1000
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def template_key(formula: Column, row: Column, col: Column) -> Column:
    """What copies of one formula share, without parsing, as an array: the formula with a mark at each reference and text, then these, cell references made relative. Null for null."""

    words = F.regexp_extract_all(formula, F.lit(_KEY), F.lit(0))
    words = F.transform(words, lambda w: F.struct(w.alias("w"), F.substring_index(w, "!", -1).alias("ref")))  # each step binds what the next names several times
    words = F.transform(words, lambda x: F.struct(x["w"].alias("w"), x["ref"].alias("ref"), F.translate(x["ref"], _LETTERS[26:] + "$0123456789", _LETTERS[:26]).alias("letters"), F.translate(x["ref"], "$" + _LETTERS, "").try_cast("long").alias("n")))
    at = lambda x, k: F.ascii(F.substring(x["letters"], k, 1)) - 64
    number = lambda x: F.when(F.length(x["letters"]) == 1, at(x, 1)).when(F.length(x["letters"]) == 2, at(x, 1) * 26 + at(x, 2)).otherwise(at(x, 1) * 676 + at(x, 2) * 26 + at(x, 3))
    place = lambda fixed, n, home: F.when(fixed, n.cast("string")).otherwise(F.concat(F.lit("["), (n - home).cast("string"), F.lit("]")))
    sheet = lambda x: F.substring(x["w"], F.lit(1), F.length(x["w"]) - F.length(x["ref"]))
    said = lambda x: F.concat(sheet(x), F.lit("R"), place(F.locate("$", x["ref"], 2) > 0, x["n"], row), F.lit("C"), place(F.startswith(x["ref"], F.lit("$")), number(x), col))
    relative = lambda x: F.when(F.startswith(x["w"], F.lit('"')), x["w"]).otherwise(F.coalesce(said(x), x["w"]))
    return F.concat(F.array(F.regexp_replace(formula, _KEY, "\x01")), F.transform(words, relative))


def copy_key(formula: Column, row: Column) -> Column:
    """What copies of one formula in one column share: a struct of the formula with a mark for each row that moves, and these rows made relative. Equal keys of a column have equal
    ``template_key``s, which cost several times as much. Null for null."""
    rows = F.regexp_extract_all(formula, F.lit(_ROWS), F.lit(3))
    rows = F.transform(rows, lambda n: F.when(n != "", n.cast("long") - row))  # a text in quotes has none; casts that fail are slow
    return F.when(formula.isNotNull(), F.struct(F.regexp_replace(formula, _ROWS, "$1$2\x01").alias("text"), rows.alias("rows")))


@dataclass(frozen=True)
class Rect:
    sheet: str
    r1: int
    r2: int
    c1: int
    c2: int

    def meets(self, o: "Rect") -> bool:
        return self.sheet == o.sheet and self.r1 <= o.r2 and o.r1 <= self.r2 and self.c1 <= o.c2 and o.c1 <= self.c2

    def holds(self, sheet: str, row: int, col: int) -> bool:
        return self.sheet == sheet and self.r1 <= row <= self.r2 and self.c1 <= col <= self.c2

    def a1(self) -> str:
        a = f"{L.column_letters(self.c1)}{self.r1}"
        b = f"{L.column_letters(self.c2)}{self.r2}"
        return f"{self.sheet}!{a}" + ("" if a == b else f":{b}")


@dataclass
class Block:
    id: int
    rect: Rect
    key: str  # canonical text of the template
    tree: object
    sample: str
    recursion: str = "none"
    kind: str = "calculation"


@dataclass
class Model:
    blocks: list[Block]
    edges: set[tuple[int, int]]
    order: list[int]
    cycles: list[list[int]]
    names: dict
    used: dict[str, tuple[int, int]]
    inputs: list[Rect] = field(default_factory=list)
    roles: dict[str, str] = field(default_factory=dict)

    @property
    def templates(self) -> dict[str, list[Block]]:
        out: dict[str, list[Block]] = {}
        for b in self.blocks:
            out.setdefault(b.key, []).append(b)
        return out

    def block_at(self, sheet: str, row: int, col: int) -> Block | None:
        return next((b for b in self.blocks if b.rect.holds(sheet, row, col)), None)

    def descendants(self, start: set[int]) -> set[int]:
        seen, queue = set(start), list(start)
        while queue:
            at = queue.pop()
            for a, b in self.edges:
                if a == at and b not in seen:
                    seen.add(b)
                    queue.append(b)
        return seen

    def unsupported(self) -> set[str]:
        return set().union(*(L.called(b.tree) for b in self.blocks)) - L.SUPPORTED if self.blocks else set()

    def describe_cycles(self) -> list[str]:
        by = {b.id: b for b in self.blocks}
        return [" -> ".join(by[i].rect.a1() for i in [*c, c[0]]) for c in self.cycles]

    def summary(self) -> dict:
        return {"templates": len(self.templates), "blocks": len(self.blocks), "cells": sum((b.rect.r2 - b.rect.r1 + 1) * (b.rect.c2 - b.rect.c1 + 1) for b in self.blocks), "edges": len(self.edges), "cycles": len(self.cycles), "unsupported": sorted(self.unsupported())}


def resolve_names(tree, names: dict):
    """Defined names (lower case to tree) put in place; unknown names stay and evaluate to #NAME?."""
    if isinstance(tree, L.Name):
        return names.get(tree.name.lower(), tree)
    if isinstance(tree, L.Unary):
        return L.Unary(tree.op, resolve_names(tree.x, names))
    if isinstance(tree, L.Binary):
        return L.Binary(tree.op, resolve_names(tree.a, names), resolve_names(tree.b, names))
    if isinstance(tree, L.Call):
        return L.Call(tree.name, tuple(resolve_names(a, names) for a in tree.args))
    return tree


def footprint(ref, rect: Rect, used: dict[str, tuple[int, int]]) -> Rect | None:
    """The union of what a reference reads over a block, clipped to the used range of its sheet."""
    sheet = ref.sheet or rect.sheet
    rows, cols = used.get(sheet, (0, 0))
    ends = (ref.row, ref.row, ref.col, ref.col) if isinstance(ref, L.Cell) else (ref.top, ref.bottom, ref.left, ref.right)
    span = lambda a, lo, hi: (a.at(lo), a.at(hi))
    r = [x for a in ends[:2] if a for x in span(a, rect.r1, rect.r2)] or [1, rows]
    c = [x for a in ends[2:] if a for x in span(a, rect.c1, rect.c2)] or [1, cols]
    out = Rect(sheet, max(1, min(r)), min(rows, max(r)), max(1, min(c)), min(cols, max(c)))
    return out if out.r1 <= out.r2 and out.c1 <= out.c2 else None


def recursion(tree, rect: Rect) -> str:
    """How a block reads itself: none, top_to_bottom, left_to_right, row_major, or cycle."""
    kinds = set()
    for ref in L.references(tree):
        got = footprint(ref, rect, {ref.sheet or rect.sheet: (L.MAX_ROW, L.MAX_COL)})
        if got is None or not got.meets(rect):
            continue
        bottom, right = (ref.row, ref.col) if isinstance(ref, L.Cell) else (ref.bottom, ref.right)
        above = bottom is not None and (bottom.n < 0 if not bottom.fixed else bottom.n < rect.r1)
        level = bottom is not None and not bottom.fixed and bottom.n == 0
        before = right is not None and (right.n < 0 if not right.fixed else right.n < rect.c1)
        same_column = right is not None and not right.fixed and right.n == 0
        if above and same_column:
            kinds.add("top_to_bottom")
        elif level and before:
            kinds.add("left_to_right")
        elif above:
            kinds.add("row_major")
        else:
            return "cycle"
    return "none" if not kinds else kinds.pop() if len(kinds) == 1 else "row_major"


def topological(nodes: list[int], edges: set[tuple[int, int]]) -> tuple[list[int], list[list[int]]]:
    """(an order in which sources come first, smallest ids first; groups of nodes that depend on one another)."""
    import heapq

    after: dict[int, list[int]] = {n: [] for n in nodes}
    waiting = dict.fromkeys(nodes, 0)
    for a, b in edges:
        if a != b:
            after[a].append(b)
            waiting[b] += 1
    ready, order = [n for n in nodes if not waiting[n]], []
    heapq.heapify(ready)
    while ready:
        n = heapq.heappop(ready)
        order.append(n)
        for b in after[n]:
            waiting[b] -= 1
            if not waiting[b]:
                heapq.heappush(ready, b)
    left = set(nodes) - set(order)

    def reach(n: int) -> set[int]:
        seen, queue = set(), [n]
        while queue:
            for b in after[queue.pop()]:
                if b in left and b not in seen:
                    seen.add(b)
                    queue.append(b)
        return seen

    to, cycles = {n: reach(n) for n in left}, []
    while rest := [n for n in sorted(left) if n in to[n]]:
        group = sorted(m for m in left if m in to[rest[0]] and rest[0] in to[m])
        cycles.append(group)
        left -= set(group)
    return order, cycles


def _formulas_of(cells: DataFrame, homes: DataFrame) -> DataFrame:
    """``homes`` (sheet, key, col, row) with the formulas that are there. Where the rows are few, cells of others aren't made."""
    rows = [r["row"] for r in homes.select("row").distinct().limit(NAMED_ROWS + 1).collect()]
    near = cells.where(F.col("row").isin(*rows)) if len(rows) <= NAMED_ROWS else cells
    found = near.where("formula is not null").select("sheet", "row", "col", "formula").join(homes, ["sheet", "row", "col"])
    # keys are compared with what has been found, not in the join, where each cell would need one
    found = found.groupBy("sheet", "row", "col", "key").agg(F.collect_set("formula").alias("__all")).select("sheet", "row", "col", "key", F.explode("__all").alias("formula"))
    return found.where(copy_key(F.col("formula"), F.col("row")) == F.col("key"))


def derive(cells: DataFrame, names: dict[str, str] | None = None, scope: list[str] | None = None, roles: dict[str, str] | None = None) -> Model:
    """The model of a workbook. ``names``: defined name to an absolute reference; ``scope``: sheets to take; ``roles``: overrides."""
    spark = cells.sparkSession
    if scope is not None:
        cells = cells.where(F.col("sheet").isin(*scope))
    trees = {k.lower(): L.parse(v) for k, v in (names or {}).items()}
    runs = column_runs(cells.select("sheet", "row", "col", copy_key(F.col("formula"), F.col("row")).alias("key")), ["sheet", "key"]).persist()  # a row for at most 64 cells; constants have no key
    used = {r["sheet"]: (r["r"], r["c"]) for r in runs.groupBy("sheet").agg(F.max("hi").alias("r"), F.max("col").alias("c")).collect()}
    formulas = runs.where("key is not null")
    homes = _formulas_of(cells, formulas.groupBy("sheet", "key", "col").agg(F.min("lo").alias("row"))).withColumn("template", template_key(F.col("formula"), F.col("row"), F.col("col"))).persist()
    groups = homes.groupBy("sheet", "template").agg(F.min(F.struct("row", "col", "formula")).alias("first")).select("sheet", "template", "first.*").collect()  # one row for each template
    canonical, parsed = [], {}
    for g in sorted(groups, key=lambda g: (g["sheet"], g["row"], g["col"], g["formula"])):
        tree = L.parse(g["formula"], g["row"], g["col"], g["sheet"])
        text = L.render(tree)
        parsed.setdefault((g["sheet"], text), (tree, "=" + g["formula"].removeprefix("=")))
        canonical.append((g["sheet"], g["template"], text))
    if not canonical:
        runs.unpersist()
        homes.unpersist()
        return Model([], set(), [], [], trees, used)
    texts = spark.createDataFrame(canonical, "sheet string, template array<string>, text string")
    of = homes.select("sheet", "key", "col", "template").distinct().join(F.broadcast(texts), ["sheet", "template"]).select("sheet", "key", "col", "text")  # one row for each template and column
    merged = formulas.join(of, ["sheet", "key", "col"])
    rects = run_rectangles(merged.select("sheet", "text", "col", "lo", "hi"), ["sheet", "text"]).orderBy("sheet", "c1", "r1").collect()
    homes.unpersist()
    blocks = []
    for i, r in enumerate(rects):
        tree, sample = parsed[r["sheet"], r["text"]]
        rect = Rect(r["sheet"], r["r1"], r["r2"], r["c1"], r["c2"])
        whole = resolve_names(tree, trees)
        blocks.append(Block(i, rect, r["text"], whole, sample, recursion(whole, rect)))
    reads = [(b.id, f) for b in blocks for ref in L.references(b.tree) if (f := footprint(ref, b.rect, used))]
    as_frame = lambda rows: spark.createDataFrame([(i, x.sheet, x.r1, x.r2, x.c1, x.c2) for i, x in rows], "id int, sheet string, r1 int, r2 int, c1 int, c2 int")
    edges = {(r["source"], r["target"]) for r in overlap_edges(as_frame([(b.id, b.rect) for b in blocks]), as_frame(reads)).collect()} if reads else set()
    order, cycles = topological([b.id for b in blocks], edges)
    cycles += [[b.id] for b in blocks if b.recursion == "cycle"]
    model = Model(blocks, {(a, b) for a, b in edges if a != b}, order, cycles, trees, used)
    if reads:
        spots = as_frame(reads).select("sheet", "r1", "r2", "c1", "c2").distinct()
        constants = runs.where("key is null").select(F.col("sheet").alias("s"), "col", "lo", "hi")
        meets = (F.col("s") == F.col("sheet")) & (F.col("lo") <= F.col("r2")) & (F.col("r1") <= F.col("hi")) & F.col("col").between(F.col("c1"), F.col("c2"))
        hit = constants.join(F.broadcast(spots), meets).select("sheet", "col", F.greatest("lo", "r1").alias("lo"), F.least("hi", "r2").alias("hi"))
        model.inputs = [Rect(r["sheet"], r["r1"], r["r2"], r["c1"], r["c2"]) for r in run_rectangles(hit, ["sheet"]).orderBy("sheet", "c1", "r1").collect()]
    read = {a for a, _ in model.edges}
    for sheet in used:
        own = [b for b in blocks if b.rect.sheet == sheet]
        looked = any(r.sheet == sheet for _, r in reads)
        model.roles[sheet] = (roles or {}).get(sheet) or (("reference" if looked else "input") if not own else "output" if not any(b.id in read for b in own) else "calculation")
    for b in blocks:
        b.kind = "output" if b.id not in read or model.roles[b.rect.sheet] == "output" else "calculation"
    runs.unpersist()
    return model


def rules(block: Block) -> list[tuple[str, str]]:
    """(kind, words) of a template: condition bands, thresholds, lookups, error fallbacks; in this order of weight."""
    home, out = (block.rect.r1, block.rect.c1), []
    say = lambda t: L.render(t, home)

    def ladder(t) -> list[str]:
        if isinstance(t, L.Call) and t.name == "IF" and len(t.args) > 1:
            return [f"{say(t.args[1])} when {say(t.args[0])}", *(ladder(t.args[2]) if len(t.args) > 2 else [])]
        return [f"otherwise {say(t)}"]

    inner = set()
    for n in L.walk(block.tree):
        if isinstance(n, L.Call) and n.name == "IF" and id(n) not in inner:
            at = n
            while len(at.args) > 2 and isinstance(at.args[2], L.Call) and at.args[2].name == "IF":
                at = at.args[2]
                inner.add(id(at))
            out.append(("condition", "; ".join(ladder(n))))
        elif isinstance(n, L.Binary) and n.op in ("<", "<=", ">", ">=") and isinstance(n.b, L.Number):
            out.append(("threshold", f"{say(n.a)} {n.op} {n.b.value:g}"))
        elif isinstance(n, L.Call) and n.name in ("VLOOKUP", "HLOOKUP"):
            out.append(("lookup", f"{say(n.args[0])} in {say(n.args[1])}, place {say(n.args[2])}"))
        elif isinstance(n, L.Call) and n.name == "IFERROR":
            out.append(("error_fallback", f"{say(n.args[1])} where {say(n.args[0])} fails"))
    weight = ["condition", "threshold", "lookup", "error_fallback"]
    return sorted(dict.fromkeys(out), key=lambda r: weight.index(r[0]))


def function_inventory(cells: DataFrame) -> DataFrame:
    """(function, formulas): how many formulas use each function."""
    bare = F.regexp_replace("formula", '"[^"]*"', "")
    names = F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(r"([A-Za-z_][A-Za-z0-9_.]*)\("), 1), lambda x: F.regexp_replace(F.upper(x), "^_XLFN\\.", "")))
    return cells.where("formula is not null").select(F.explode(names).alias("function")).groupBy("function").agg(F.count(F.lit(1)).alias("formulas"))


def scope_closure(cells: DataFrame, start: list[str]) -> set[str]:
    """Sheets that formulas of ``start`` read, directly or not."""
    m = cells.where("formula is not null").select("sheet", F.explode(F.regexp_extract_all("formula", F.lit(r"(?:'((?:[^']|'')+)'|([A-Za-z_][A-Za-z0-9_.]*))!"), 0)).alias("ref")).distinct()
    reads: dict[str, set[str]] = {}
    for r in m.collect():  # one row for each pair of sheets
        reads.setdefault(r["sheet"], set()).add(r["ref"][:-1].strip("'").replace("''", "'"))
    seen, queue = set(start), list(start)
    while queue:
        for s in reads.get(queue.pop(), ()):
            if s not in seen:
                seen.add(s)
                queue.append(s)
    return seen
