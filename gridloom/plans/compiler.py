"""Blocks to DataFrames: a template over its rectangle becomes joins, aggregates and windows over the state of the workbook.

``state`` is (sheet, row, col, c). A reference to a neighbour is an equi-join on shifted coordinates; a fixed cell or range is one row; growing and sliding
ranges are window frames; criteria are evaluated once for each distinct criterion; COUNTIFS that ranks within groups is a sorted window; lookups
join a table of first matches, or take the last key not above. Shapes without a form here (recurrences, moving tables) raise ``NotCompiled``, and the
run evaluates them in order, in one Python task that holds the cells they read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import values as V
from ..functions.criteria import criterion_mask, parse_criterion
from ..operators.aggregates import range_summary, summary_of_parts
from . import formula as L
from .model import Block, Model, Rect, footprint


class NotCompiled(Exception):
    """The shape has no DataFrame form."""


AGGREGATES = {"SUM", "COUNT", "MAX", "MIN", "AVERAGE"}
#: Ranges of more places are summed up in parts of about so many places, each in order, and the parts in order.
PART = 65_536


def summed(table: DataFrame, rect: Rect, i: str, j: str, c: Column, name: str, hits: Column | None = None, by: list[str] = ()) -> DataFrame:
    """A row (for each ``by``) with the ``range_summary`` of cells ``c`` at rows ``i`` and columns ``j`` as ``name``.of, and how many ``hits`` there are."""
    here = F.struct((F.lit(0) if hits is None else F.count_if(hits)).cast("long").alias("hits"), range_summary(F.struct(i, j), c).alias("of")).alias(name)
    high, wide = rect.r2 - rect.r1 + 1, rect.c2 - rect.c1 + 1
    if high * wide <= PART:
        return table.groupBy(*by).agg(here)
    parts = table.groupBy(*by, F.floor(F.col(i) / max(PART // wide, 1)).alias("__at")).agg(here)
    p = F.col(name)
    return parts.groupBy(*by).agg(F.struct(F.coalesce(F.sum(p["hits"]), F.lit(0)).alias("hits"), summary_of_parts(F.col("__at"), p["of"]).alias("of")).alias(name))


class Compiler:
    def __init__(self, state: DataFrame, block: Block, model: Model):
        self.state, self.block, self.model = state, block, model
        r = block.rect
        spark = state.sparkSession
        rows, cols = spark.range(r.r1, r.r2 + 1).select(F.col("id").cast("int").alias("row")), spark.range(r.c1, r.c2 + 1).select(F.col("id").cast("int").alias("col"))
        self.frame = rows.crossJoin(F.broadcast(cols))  # a block's own cells
        self.n = 0

    def compile(self) -> DataFrame:
        """(sheet, row, col, c) of the block."""
        out = self.value(self.block.tree)
        return self.frame.select(F.lit(self.block.rect.sheet).alias("sheet"), "row", "col", out.cast(V.CELL).alias("c"))

    def name(self) -> str:
        self.n += 1
        return f"v{self.n}"

    def part(self, rect: Rect) -> DataFrame:
        return self.state.where((F.col("sheet") == rect.sheet) & F.col("row").between(rect.r1, rect.r2) & F.col("col").between(rect.c1, rect.c2))

    def one(self, df: DataFrame) -> None:
        self.frame = self.frame.crossJoin(F.broadcast(df))  # df has exactly one row

    @staticmethod
    def at(axis: L.Axis, home: str) -> Column:
        return F.lit(axis.n) if axis.fixed else F.col(home) + axis.n

    # -- nodes ---------------------------------------------------------------------------------------------------------

    def hold(self, value: Column) -> Column:
        """A result as a column of the frame: what stands above names it several times, and expressions would double at each level."""
        name = self.name()
        self.frame = self.frame.withColumn(name, value.cast(V.CELL))
        return F.col(name)

    def value(self, n) -> Column:
        if isinstance(n, (L.Number, L.Text, L.Bool)):
            return V.cell(V.TEXT, s=n.value) if isinstance(n, L.Text) else V.literal(n.value)
        if isinstance(n, L.ErrorValue):
            return V.error(n.name)
        if isinstance(n, L.Empty):
            return V.cell(V.EMPTY)
        if isinstance(n, L.Name):
            return V.error("#NAME?")
        if isinstance(n, L.Foreign):
            return V.error("#REF!")
        if isinstance(n, L.Cell):
            return self.hold(self.cell(n))
        if isinstance(n, L.Unary):
            x = self.value(n.x)
            return self.hold(V.arithmetic("-", V.literal(0.0), x) if n.op == "-" else V.to_number(x) if n.op == "+" else V.arithmetic("/", x, V.literal(100.0)))
        if isinstance(n, L.Binary):
            a, b = self.value(n.a), self.value(n.b)
            return self.hold(V.concat(a, b) if n.op == "&" else V.arithmetic(n.op, a, b) if n.op in "+-*/^" else V.compare(n.op, a, b))
        if isinstance(n, L.Call):
            return self.hold(self.call(n))
        raise NotCompiled(type(n).__name__)  # ranges and arrays as scalars

    def cell(self, ref: L.Cell) -> Column:
        name, rect = self.name(), footprint(ref, self.block.rect, self.model.used)
        row, col = self.at(ref.row, "row"), self.at(ref.col, "col")
        if rect is None:
            out = V.cell(V.EMPTY)
        elif ref.row.fixed and ref.col.fixed:
            self.one(self.part(rect).agg(F.first("c").alias(name)))
            out = F.coalesce(F.col(name), V.cell(V.EMPTY))
        else:
            source = self.part(rect).select(F.col("row").alias("__r"), F.col("col").alias("__c"), F.col("c").alias(name))
            self.frame = self.frame.withColumn("__tr", row).withColumn("__tc", col)
            self.frame = self.frame.join(source, (F.col("__tr") == F.col("__r")) & (F.col("__tc") == F.col("__c")), "left").drop("__r", "__c", "__tr", "__tc")
            out = F.coalesce(F.col(name), V.cell(V.EMPTY))
        return F.when((row < 1) | (col < 1), V.error("#REF!")).otherwise(out)

    def fixed(self, ref) -> Rect | None:
        """The rectangle of a range that is the same for every cell; None where it reads nothing."""
        axes = [a for a in (ref.top, ref.bottom, ref.left, ref.right) if a]
        r = self.block.rect
        for a, (lo, hi) in ((x, (r.r1, r.r2) if x in (ref.top, ref.bottom) else (r.c1, r.c2)) for x in axes):
            if not a.fixed and lo != hi:
                raise NotCompiled("a moving range")
        return footprint(ref, r, self.model.used)

    def summary(self, ref: L.Range) -> Column:
        """What range functions need to know of a range, as a struct."""
        name = self.name()
        try:
            rect = self.fixed(ref)
            if rect is None:
                raise NotCompiled("an empty range")
            self.one(summed(self.part(rect), rect, "row", "col", F.col("c"), name))
            return F.col(name)["of"]
        except NotCompiled:
            rect = footprint(ref, self.block.rect, self.model.used)
            if rect is None or ref.top is None or ref.left is None or ref.left != ref.right:
                raise
        # one column whose rows move: window frames over the column's cells, with a mark where each reader stands
        cells = self.part(rect).select(F.col("col").alias("__c"), F.col("row").alias("__r"), "c", F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col"))
        marks = self.frame.select(self.at(ref.left, "col").alias("__c"), F.col("row").alias("__r"), F.lit(None).cast(V.CELL).alias("c"), "row", "col")
        low = Window.unboundedPreceding if ref.top.fixed else ref.top.n
        high = Window.unboundedFollowing if ref.bottom.fixed else ref.bottom.n
        if ref.top.fixed:
            cells = cells.where(F.col("__r") >= ref.top.n)
        if ref.bottom.fixed:
            cells = cells.where(F.col("__r") <= ref.bottom.n)
        w = Window.partitionBy("__c").orderBy("__r").rangeBetween(low, high)
        number = F.when(F.col("c.k") == V.NUMBER, F.col("c.n"))
        failed = F.first(F.when(F.col("c.k") == V.ERROR, F.col("c")), ignorenulls=True)
        truth = F.when(F.col("c.k").isin(V.NUMBER, V.BOOL), F.col("c.n") != 0)
        made = F.struct(F.coalesce(F.sum(number).over(w), F.lit(0.0)).alias("sum"), F.count(number).over(w).alias("count"), F.min(number).over(w).alias("min"), F.max(number).over(w).alias("max"), failed.over(w).alias("error"), F.min(truth).over(w).alias("every"), F.max(truth).over(w).alias("some"))
        seen = cells.unionByName(marks).select("row", "col", made.alias(name)).where("row is not null")
        self.frame = self.frame.join(seen, ["row", "col"])
        return F.col(name)

    # -- functions --------------------------------------------------------------------------------------------------------

    def call(self, n: L.Call) -> Column:
        a = n.args
        if n.name in AGGREGATES:
            return self.aggregate(n.name, a)
        if n.name in ("COUNTIF", "COUNTIFS", "SUMIF", "AVERAGEIF"):
            return self.criteria(n.name, a)
        if n.name == "SUMPRODUCT":
            return self.sumproduct(a)
        if n.name in ("VLOOKUP", "HLOOKUP"):
            return self.lookup(n.name == "HLOOKUP", a)
        if n.name in ("AND", "OR"):
            return self.logic(n.name, a)
        v = [self.value(x) for x in a]
        if n.name in ("YEAR", "MONTH", "DAY"):
            return S.fn_date_part(n.name, *v)
        return {"IF": S.fn_if, "IFERROR": S.fn_iferror, "ISNUMBER": S.fn_isnumber, "SEARCH": S.fn_search, "LEFT": S.fn_left, "CONCATENATE": V.concat, "CONCAT": V.concat, "DATE": S.fn_date}[n.name](*v)

    def parts(self, args):
        """(sum, count, min, max, error) of each argument; a scalar is coerced, an empty one counts for nothing."""
        for x in args:
            if isinstance(x, L.Range):
                s = self.summary(x)
                yield s["sum"], s["count"], F.coalesce(s["min"], F.lit(0.0)), F.coalesce(s["max"], F.lit(0.0)), s["error"]
            else:
                raw = self.value(x)
                c = V.to_number(raw)
                empty = raw["k"] == V.EMPTY
                n = F.when(empty, 0.0).otherwise(c["n"])
                yield n, F.when(empty, 0).otherwise(1), n, n, F.when(c["k"] == V.ERROR, c)

    def aggregate(self, name: str, args) -> Column:
        if name == "COUNT":
            counts = [self.summary(x)["count"] if isinstance(x, L.Range) else F.when(self.value(x)["k"] == V.NUMBER, 1).otherwise(0) for x in args]
            return V.number(reduce(lambda p, q: p + q, counts).cast("double"))
        sums, counts, lows, highs, errors = zip(*self.parts(args))
        add = lambda xs: reduce(lambda p, q: p + q, xs)
        total, n = add(sums), add(counts)
        made = {
            "SUM": lambda: V.number(total), "MIN": lambda: V.number(F.least(*lows) if len(lows) > 1 else lows[0]), "MAX": lambda: V.number(F.greatest(*highs) if len(highs) > 1 else highs[0]),
            "AVERAGE": lambda: F.when(n == 0, V.error("#DIV/0!")).otherwise(V.number(total / F.when(n != 0, n))),
        }[name]()
        return F.coalesce(*errors, made)

    def logic(self, name: str, args) -> Column:
        truths, errors = [], []
        for x in args:
            if isinstance(x, L.Range):
                s = self.summary(x)
                truths.append(s["every" if name == "AND" else "some"])
                errors.append(F.when(s["error"].isNotNull(), V.error("#VALUE!")))
            else:
                b = V.to_bool(self.value(x))
                truths.append(F.when(b["k"] == V.BOOL, b["n"] != 0))
                errors.append(F.when(b["k"] == V.ERROR, b))
        neutral = F.lit(name == "AND")
        fold = reduce(lambda p, q: p & q if name == "AND" else p | q, (F.coalesce(t, neutral) for t in truths))
        none = reduce(lambda p, q: p & q, (t.isNull() for t in truths))
        return F.coalesce(*errors, F.when(none, V.error("#VALUE!")).otherwise(V.boolean(fold)))

    def rects(self, ranges: list) -> list[Rect]:
        rects = []
        for x in ranges:
            if isinstance(x, L.Cell):
                x = L.Range(x.sheet, x.row, x.col, x.row, x.col)
            if not isinstance(x, L.Range):
                raise NotCompiled("no range")
            rects.append(self.fixed(x) or Rect(x.sheet or self.block.rect.sheet, 1, 1, 1, 1))
        return rects

    def shape(self, ranges: list) -> Rect:
        """The places (i, j) from 0 that ranges side by side have."""
        rects = self.rects(ranges)
        return Rect("", 0, max(r.r2 - r.r1 for r in rects), 0, max(r.c2 - r.c1 for r in rects))

    def aligned(self, ranges: list) -> DataFrame:
        """Ranges of one shape side by side: a row for each place (i, j), its cells c0, c1 ...; places without a cell are empty."""
        rects, shape = self.rects(ranges), self.shape(ranges)
        rows, cols = shape.r2 + 1, shape.c2 + 1
        spark = self.state.sparkSession
        out = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("i"), (F.col("id") % cols).cast("int").alias("j"))
        for k, r in enumerate(rects):
            mine = self.part(r).select((F.col("row") - r.r1).alias("i"), (F.col("col") - r.c1).alias("j"), F.col("c").alias(f"c{k}"))
            out = out.join(mine, ["i", "j"], "left").withColumn(f"c{k}", F.coalesce(F.col(f"c{k}"), V.cell(V.EMPTY)))
        return out

    def criteria(self, name: str, args) -> Column:
        if name in ("SUMIF", "AVERAGEIF"):
            ranges, crits = [args[0], args[2] if len(args) > 2 else args[0]], [args[1]]
        else:
            ranges, crits = list(args[::2]), list(args[1::2])
        if len(args) == 4 and name == "COUNTIFS" and (ranked := self.rank(ranges, crits)) is not None:
            return ranked
        table = self.aligned(ranges)
        masks, moving = [], []
        for k, crit in enumerate(crits):
            if isinstance(crit, (L.Number, L.Text, L.Bool)):
                masks.append(criterion_mask(F.col(f"c{k}"), parse_criterion(crit.value)))
            else:
                key, wanted = self.name(), self.value(crit)  # may add to the frame
                self.frame = self.frame.withColumn(key, wanted)
                moving.append(key)
                masks.append(moving_mask(F.col(f"c{k}"), F.col(key)))
        hit = reduce(lambda p, q: p & q, masks)
        target = F.col("c1") if name in ("SUMIF", "AVERAGEIF") else F.col("c0")
        result, shape = self.name(), self.shape(ranges)
        made = lambda d, by: summed(d, shape, "i", "j", F.when(hit, target).otherwise(V.cell(V.EMPTY)), result, F.coalesce(hit, F.lit(False)), by)
        if moving:
            distinct = self.frame.select(*moving).distinct()
            got = made(distinct.crossJoin(table), moving)  # each distinct criterion meets the range once
            renamed = got.select(*(F.col(m).alias(f"__{m}") for m in moving), result)
            self.frame = self.frame.join(renamed, reduce(lambda p, q: p & q, (F.col(m).eqNullSafe(F.col(f"__{m}")) for m in moving)), "left").drop(*(f"__{m}" for m in moving))
        else:
            self.one(made(table, []))
        r = F.col(result)
        if name.startswith("COUNT"):
            return V.number(r["hits"].cast("double"))
        if name == "SUMIF":
            return F.coalesce(r["of"]["error"], V.number(r["of"]["sum"]))
        return F.coalesce(r["of"]["error"], F.when(r["of"]["count"] == 0, V.error("#DIV/0!")).otherwise(V.number(r["of"]["sum"] / F.when(r["of"]["count"] != 0, r["of"]["count"]))))

    def rank(self, ranges, crits) -> Column | None:
        """COUNTIFS(groups, my group, values, ">"&my value): a sorted window over the groups instead of every pair."""
        group, value = crits
        if not (isinstance(group, L.Cell) and isinstance(value, L.Binary) and value.op == "&" and isinstance(value.a, L.Text) and value.a.value in (">", "<", ">=", "<=") and isinstance(value.b, L.Cell)):
            return None
        g, v = self.name(), self.name()
        mine, own_value = self.value(group), self.value(value.b)  # may add to the frame
        self.frame = self.frame.withColumn(g, mine).withColumn(v, own_value)
        odd = (F.col(f"{g}.k") == V.TEXT) & F.col(f"{g}.s").rlike(r"^[<>=]|[*?~]") | ~F.col(f"{g}.k").isin(V.TEXT, V.NUMBER) | (F.col(f"{v}.k") != V.NUMBER)
        if not self.frame.where(odd).isEmpty():
            return None
        key = lambda c: F.struct(c["k"].alias("k"), F.lower(c["s"]).alias("s"), V.r15(c["n"]).alias("n"))
        table = self.aligned(ranges).where(F.col("c1.k") == V.NUMBER).select(key(F.col("c0")).alias("__g"), V.r15(F.col("c1.n")).alias("__v"), F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col"))
        marks = self.frame.select(key(F.col(g)).alias("__g"), V.r15(F.col(f"{v}.n")).alias("__v"), "row", "col")
        own = F.when(F.col("row").isNull(), 1)
        w = Window.partitionBy("__g")
        up = F.count(own).over(w.orderBy("__v").rangeBetween(Window.unboundedPreceding, 0))
        same, every = F.count(own).over(Window.partitionBy("__g", "__v")), F.count(own).over(w)
        result = self.name()
        n = {">": every - up, ">=": every - up + same, "<=": up, "<": up - same}[value.a.value]
        seen = table.unionByName(marks).select("row", "col", n.cast("double").alias(result)).where("row is not null")
        self.frame = self.frame.join(seen, ["row", "col"])
        return V.number(F.col(result))

    def sumproduct(self, args) -> Column:
        table, result = self.aligned(list(args)), self.name()
        cells = [F.col(f"c{k}") for k in range(len(args))]
        product = reduce(lambda p, q: p * q, (F.when(c["k"].isin(V.NUMBER, V.BOOL), c["n"]).otherwise(0.0) for c in cells))
        bad = reduce(lambda p, q: p | q, (c["k"] == V.ERROR for c in cells))
        self.one(summed(table, self.shape(list(args)), "i", "j", V.cell(V.NUMBER, n=product), result, bad))
        r = F.col(result)
        return F.when(r["hits"] > 0, V.error("#VALUE!")).otherwise(V.number(r["of"]["sum"]))

    def lookup(self, across: bool, args) -> Column:
        if len(args) < 3 or not isinstance(args[1], L.Range) or not isinstance(args[2], L.Number) or len(args) > 3 and not isinstance(args[3], (L.Bool, L.Number, L.Empty)):
            raise NotCompiled("a lookup whose table or place moves")
        near = len(args) > 3 and not isinstance(args[3], L.Empty) and bool(args[3].value)
        rect, at = self.fixed(args[1]), int(args[2].value) - 1
        ends = (args[1].left, args[1].right) if not across else (args[1].top, args[1].bottom)
        width = abs(ends[1].n - ends[0].n) + 1 if ends[0] else self.model.used.get(args[1].sheet or self.block.rect.sheet, (0, 0))[across ^ 1]
        if at < 0:
            return V.error("#VALUE!")
        if at >= width:
            return V.error("#REF!")
        key = self.value(args[0])
        if rect is None:
            return F.when(key["k"] == V.ERROR, key).otherwise(V.error("#N/A"))
        cells = self.part(rect)
        line, place = (F.col("col") - rect.c1, F.col("row") - rect.r1) if across else (F.col("row") - rect.r1, F.col("col") - rect.c1)
        flat = cells.select(line.alias("i"), place.alias("j"), "c")
        keys = flat.where("j = 0").select("i", F.col("c").alias("key"))
        table = keys.join(flat.where(F.col("j") == at).select("i", F.col("c").alias("v")), "i", "left").withColumn("v", F.coalesce("v", V.cell(V.EMPTY)))
        name, mine = self.name(), self.name()
        self.frame = self.frame.withColumn(mine, key)
        if near:
            table = table.where(F.col("key.k").isin(V.NUMBER, V.BOOL))
            both = table.select(F.col("key.n").alias("__k"), F.lit(0).alias("__side"), F.col("i").cast("long").alias("__i"), F.col("v").alias(name), F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col"))
            marks = self.frame.where(F.col(f"{mine}.k").isin(V.NUMBER, V.BOOL)).select(F.col(f"{mine}.n").alias("__k"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__i"), F.lit(None).cast(V.CELL).alias(name), "row", "col")
            w = Window.orderBy("__k", "__side").rowsBetween(Window.unboundedPreceding, 0)  # one sheet's table
            last = F.max_by(F.col(name), F.col("__i")).over(w).alias(name)
            seen = both.unionByName(marks).select("row", "col", last).where("row is not null")
            self.frame = self.frame.join(seen, ["row", "col"], "left")
        else:
            tag = lambda c: F.struct(c["k"].alias("k"), c["n"].alias("n"), F.lower(c["s"]).alias("s"))
            first = table.where(~F.col("key.k").isin(V.EMPTY, V.ERROR)).groupBy(tag(F.col("key")).alias("__t")).agg(F.min_by("v", "i").alias(name))
            self.frame = self.frame.withColumn("__m", tag(F.col(mine))).join(first, F.col("__m").eqNullSafe(F.col("__t")), "left").drop("__m", "__t")
        return F.when(F.col(f"{mine}.k") == V.ERROR, F.col(mine)).otherwise(F.coalesce(F.col(name), V.error("#N/A")))


def moving_mask(c: Column, crit: Column) -> Column:
    """A mask whose criterion is a cell."""
    op = F.regexp_extract(crit["s"], r"^(<>|<=|>=|=|<|>)?", 1)
    body = F.regexp_replace(crit["s"], r"^(<>|<=|>=|=|<|>)", "")
    n, t = V.text_to_number(body), F.lower(body)
    escaped = F.regexp_replace(body, r"([.\\+^$|(){}\[\]])", r"\\$1")
    pattern = F.concat(F.lit("(?is)^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(escaped, r"(?<!~)\*", ".*"), r"(?<!~)\?", "."), r"~([*?~])", r"\\$1"), F.lit("$"))
    low = F.lower(c["s"])

    def test(a: Column, b: Column) -> Column:
        return F.when(op == "<", a < b).when(op == "<=", a <= b).when(op == ">", a > b).when(op == ">=", a >= b).otherwise(a == b)

    same_text = (c["k"] == V.TEXT) & F.when(op.isin("", "=", "<>"), F.regexp_like(low, pattern)).otherwise(test(low, t))
    as_number = (c["k"] == V.NUMBER) & test(V.r15(c["n"]), V.r15(n))
    as_bool = (c["k"] == V.BOOL) & test(c["n"], F.when(t == "true", 1.0).otherwise(0.0))
    blank = F.when(op == "", (c["k"] == V.EMPTY) | ((c["k"] == V.TEXT) & (c["s"] == ""))).otherwise((c["k"] == V.EMPTY) & op.isin("=", "<>"))
    plain = F.when(body == "", blank).when(t.isin("true", "false"), as_bool).when(n.isNotNull(), as_number).otherwise(same_text)
    from_text = F.when(op == "<>", ~F.coalesce(plain, F.lit(False))).otherwise(plain)
    number = (c["k"] == V.NUMBER) & (V.r15(c["n"]) == V.r15(crit["n"]))
    return F.coalesce(
        F.when(crit["k"] == V.TEXT, from_text).when(crit["k"] == V.NUMBER, number).when(crit["k"] == V.BOOL, (c["k"] == V.BOOL) & (c["n"] == crit["n"]))
        .when(crit["k"] == V.EMPTY, (c["k"] == V.NUMBER) & (c["n"] == 0)).otherwise((c["k"] == V.ERROR) & (c["s"] == crit["s"])), F.lit(False)
    )
