"""Entity tables from workbooks: a declared map says which sheet and columns hold identities, dimensions, measures, phases and statistics; cells are turned into wide frames and joined by key.

A map is a dictionary (JSON)::

    {"entity": {"sheet": "Funds", "key": "A", "label": "B", "rows": [2, 900], "include": ["C", "yes"], "universe": ["D", "in"]},
     "dimensions": {"category": {"column": "E"}},
     "measures": {"score": {"column": "F"}, "year": {"sheet": "Perf", "key": "A", "column": "B"}},
     "phases": {"sheet": "Perf", "key": "A", "groups": {"bull": ["C", "D"]}},
     "stats": {"sheet": "Averages", "key": "A", "columns": ["B"]}}
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from difflib import get_close_matches

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import ERROR, NUMBER, TEXT
from .formula import column_letters, column_number

#: Share of the identity column's rows that must hold text.
IDENTITY = 0.8
_PARTS = {"entity", "dimensions", "measures", "phases", "stats"}


def cell_number(c: Column) -> Column:
    """A cell as a number: bools, texts, errors and what isn't finite are null."""
    n = c["n"]
    return F.when((c["k"] == NUMBER) & ~F.isnan(n) & (F.abs(n) != float("inf")), n)


def cell_text(c: Column) -> Column:
    """A cell as trimmed text, blank is null; whole numbers have no decimals; bools and errors are null."""
    n = c["n"]
    number = F.when((n == F.floor(n)) & (F.abs(n) < 1e15), F.floor(n).cast("string")).otherwise(n.cast("string"))
    return F.when(c["k"] == TEXT, F.nullif(F.trim(c["s"]), F.lit(""))).when(c["k"] == NUMBER, number)


@dataclass(frozen=True)
class Source:
    """A column of a sheet, and the column of that sheet which holds identities (none on the entity's own sheet)."""

    sheet: str
    column: int
    key: int | None = None


@dataclass
class Resolved:
    """A map checked against a version's sheets; ``problems`` name what was left out."""

    sheet: str
    key: int
    label: int | None
    rows: tuple[int, int]
    include: tuple[int, str] | None
    universe: tuple[int, str] | None
    dimensions: dict[str, Source] = field(default_factory=dict)
    measures: dict[str, Source] = field(default_factory=dict)
    phases: dict[str, Source] = field(default_factory=dict)
    stats: dict[str, Source] = field(default_factory=dict)
    problems: list[str] = field(default_factory=list)


class MapError(ValueError):
    """The map's entity can't be found in this version."""


def check_map(raw: dict) -> list[str]:
    """What is wrong with a map whatever the workbook."""
    said = [f"unknown part '{k}'" + _hint(k, _PARTS) for k in raw if k not in _PARTS]
    for part in ("sheet", "key"):
        if not raw.get("entity", {}).get(part):
            said.append(f"entity.{part} is missing")
    places = [(f"entity.{k}", raw.get("entity", {}).get(k)) for k in ("key", "label")]
    places += [(f"{part}.{name}.column", spec.get("column")) for part in ("dimensions", "measures") for name, spec in raw.get(part, {}).items()]
    for where, letter in places:
        if letter is not None and not re.fullmatch(r"[A-Za-z]{1,3}", str(letter)):
            said.append(f"{where}: '{letter}' is no column letter")
    both = raw.get("dimensions", {}).keys() & raw.get("measures", {}).keys()
    return said + [f"'{k}' is a dimension and a measure" for k in sorted(both)]


def _hint(name: str, known) -> str:
    near = get_close_matches(name, sorted(known), n=1)
    return f"; did you mean '{near[0]}'?" if near else ""


def resolve(raw: dict, cells: DataFrame) -> Resolved:
    """Checks a map against ``cells`` (sheet, row, col, c). Raises ``MapError`` where the entity itself doesn't resolve; other columns that don't are problems and left out. The driver
    gets a row per sheet and the count of one column."""
    if said := check_map(raw):
        raise MapError("; ".join(said))
    used = {r["sheet"]: (r["r1"], r["r2"], r["c2"]) for r in cells.groupBy("sheet").agg(F.min("row").alias("r1"), F.max("row").alias("r2"), F.max("col").alias("c2")).collect()}
    problems: list[str] = []

    def place(where: str, sheet: str, letter: str) -> int | None:
        if sheet not in used:
            problems.append(f"{where}: no sheet '{sheet}'" + _hint(sheet, used))
        elif column_number(letter) > used[sheet][2]:
            problems.append(f"{where}: column {letter.upper()} lies outside of '{sheet}' (last column {column_letters(used[sheet][2])})")
        else:
            return column_number(letter)
        return None

    entity = raw["entity"]
    sheet = entity["sheet"]
    key = place("entity.key", sheet, entity["key"])
    if key is None:
        raise MapError(problems[0])
    rows = tuple(entity.get("rows") or used[sheet][:2])
    if not used[sheet][0] <= rows[0] <= rows[1] <= used[sheet][1]:
        raise MapError(f"entity.rows: {list(rows)} lies outside of '{sheet}'")
    texts = cells.where((F.col("sheet") == sheet) & (F.col("col") == key) & F.col("row").between(*rows)).agg(F.count(cell_text(F.col("c"))).alias("n")).first()["n"]
    span = rows[1] - rows[0] + 1
    if texts < IDENTITY * span:
        raise MapError(f"entity.key: column {entity['key']} has text in {texts} of {span} rows, too few for identities")
    test = lambda name: (place(f"entity.{name}", sheet, entity[name][0]), entity[name][1]) if entity.get(name) else None
    include, universe = test("include"), test("universe")
    label = place("entity.label", sheet, entity["label"]) if entity.get("label") else None
    out = Resolved(sheet, key, label, rows, include if include and include[0] else None, universe if universe and universe[0] else None, problems=problems)

    def source(where: str, spec: dict, letter: str) -> Source | None:
        at = spec.get("sheet") or sheet
        column = place(where, at, letter)
        own = place(f"{where}.key", at, spec["key"]) if column and spec.get("key") else key
        return Source(at, column, None if at == sheet else own) if column and own else None

    for part, into in (("dimensions", out.dimensions), ("measures", out.measures)):
        for name, spec in raw.get(part, {}).items():
            if found := source(f"{part}.{name}", spec, spec["column"]):
                into[name] = found
    for group, letters in raw.get("phases", {}).get("groups", {}).items():
        for letter in letters:
            if found := source(f"phases.{group}", raw["phases"], letter):
                out.phases[f"{group}:{letter.upper()}"] = found
    for letter in raw.get("stats", {}).get("columns", ()):
        if found := source("stats", raw["stats"], letter):
            out.stats[letter.upper()] = found
    return out


def sheet_frame(cells: DataFrame, sheet: str, columns: dict[str, int], rows: tuple[int, int] | None = None) -> DataFrame:
    """row and a cell for each of ``columns`` (name: column number): one partial aggregate over the cells of these columns only."""
    kept = cells.where((F.col("sheet") == sheet) & F.col("col").isin(*columns.values()))
    if rows:
        kept = kept.where(F.col("row").between(*rows))
    return kept.groupBy("row").agg(*(F.max(F.when(F.col("col") == c, F.col("c"))).alias(name) for name, c in columns.items()))


def _joined(base: DataFrame, cells: DataFrame, sources: dict[str, Source]) -> DataFrame:
    """Adds the cells of ``sources`` from other sheets: by identity, exactly, else without case; the first row of each counts."""
    by_place: dict[tuple[str, int], dict[str, int]] = {}
    for name, s in sources.items():
        by_place.setdefault((s.sheet, s.key), {})[name] = s.column
    for (sheet, key), columns in by_place.items():
        frame = sheet_frame(cells, sheet, {"__key": key, **columns}).withColumn("__key", cell_text(F.col("__key"))).where("__key is not null")
        first = lambda by, name: frame.groupBy(by.alias(name)).agg(F.min_by(F.struct(*columns), "row").alias(f"{name}_cells"))
        base = base.join(first(F.col("__key"), "__exact"), F.col("key") == F.col("__exact"), "left").join(first(F.lower("__key"), "__loose"), F.lower("key") == F.col("__loose"), "left")
        found = F.coalesce("__exact_cells", "__loose_cells")
        base = base.select("*", *(found[c].alias(c) for c in columns)).drop("__exact", "__loose", "__exact_cells", "__loose_cells")
    return base


def entity_frame(cells: DataFrame, m: Resolved) -> DataFrame:
    """A row per entity: key, label, row, inside, the dimensions as text, the measures as numbers, and phases, a map of numbers. ``cells`` hold the values that count (computed over stored)."""
    own = {f"__d_{k}": s.column for k, s in m.dimensions.items() if s.key is None} | {f"__m_{k}": s.column for k, s in m.measures.items() if s.key is None} | {f"__p_{k}": s.column for k, s in m.phases.items() if s.key is None}
    columns = {"__key": m.key, **own}
    for name, at in (("__label", m.label), ("__include", m.include and m.include[0]), ("__universe", m.universe and m.universe[0])):
        if at:
            columns[name] = at
    base = sheet_frame(cells, m.sheet, columns, m.rows).withColumn("key", cell_text(F.col("__key"))).where("key is not null")
    if m.include:
        base = base.where(cell_text(F.col("__include")) == str(m.include[1]).strip())
    elsewhere = {f"__d_{k}": s for k, s in m.dimensions.items() if s.key} | {f"__m_{k}": s for k, s in m.measures.items() if s.key} | {f"__p_{k}": s for k, s in m.phases.items() if s.key}
    base = _joined(base, cells, elsewhere)
    inside = F.coalesce(cell_text(F.col("__universe")) == str(m.universe[1]).strip(), F.lit(False)) if m.universe else F.lit(True)
    label = F.coalesce(cell_text(F.col("__label")), F.col("key")) if m.label else F.col("key")
    phases = F.create_map(*(x for k in m.phases for x in (F.lit(k), cell_number(F.col(f"__p_{k}"))))) if m.phases else F.lit(None).cast("map<string,double>")
    return base.select("key", label.alias("label"), "row", inside.alias("inside"), *(cell_text(F.col(f"__d_{k}")).alias(k) for k in m.dimensions), *(cell_number(F.col(f"__m_{k}")).alias(k) for k in m.measures), phases.alias("phases"))


def stat_frame(cells: DataFrame, m: Resolved) -> DataFrame:
    """A row per key of the statistics sheet with its numbers; the first row of a key counts."""
    sheet, key = next((s.sheet, s.key or m.key) for s in m.stats.values())
    frame = sheet_frame(cells, sheet, {"__key": key, **{k: s.column for k, s in m.stats.items()}}).withColumn("category", cell_text(F.col("__key"))).where("category is not null")
    return frame.groupBy("category").agg(*(F.min_by(cell_number(F.col(k)), "row").alias(k) for k in m.stats))


def pivot_source(cells: DataFrame, area: str) -> DataFrame:
    """The area ``Sheet!A1:D90`` as a frame: its first row has the names (empty: the column's letter; repeated ones get a number), texts and numbers below, errors are null. Named areas are refused."""
    found = re.fullmatch(r"(?:'((?:[^']|'')+)'|([^'!]+))!\$?([A-Z]{1,3})\$?(\d+):\$?([A-Z]{1,3})\$?(\d+)", area)
    if not found:
        raise ValueError(f"{area} is no area of cells")
    sheet = (found[1] or found[2]).replace("''", "'")
    c1, r1, c2, r2 = column_number(found[3]), int(found[4]), column_number(found[5]), int(found[6])
    head = {r["col"]: r["t"] for r in cells.where((F.col("sheet") == sheet) & (F.col("row") == r1) & F.col("col").between(c1, c2)).select("col", cell_text(F.col("c")).alias("t")).collect()}  # one row of a sheet
    names: dict[str, int] = {}
    for c in range(c1, c2 + 1):
        name, k = head.get(c) or column_letters(c), 2
        while name in names:
            name, k = f"{head.get(c) or column_letters(c)} {k}", k + 1
        names[name] = c
    wide = sheet_frame(cells, sheet, {f"__{c}": c for c in names.values()}, (r1 + 1, r2))
    return wide.select("row", *(F.when(F.col(f"__{c}.k") != ERROR, F.coalesce(cell_text(F.col(f"__{c}")), F.when(F.col(f"__{c}.k") == 3, F.when(F.col(f"__{c}.n") != 0, "TRUE").otherwise("FALSE")))).alias(n) for n, c in names.items()))
