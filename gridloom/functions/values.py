"""Cell values and their coercions as Columns.

A cell is ``struct<k: tinyint, n: double, s: string>``: k says empty, number, text, bool or error; n is the number (bools 0/1), s the
text or the error's name. Spreadsheet rules: errors are values and the leftmost wins, an empty cell takes the family of what it
meets, numbers compare at 15 significant digits, and numbers sort before text before bools.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

EMPTY, NUMBER, TEXT, BOOL, ERROR = range(5)
CELL = "struct<k:tinyint,n:double,s:string>"
#: The error names, and other spellings that map to them.
ERRORS = ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A")
ALIASES = {"#GETTING_DATA": "#N/A", "#SPILL!": "#VALUE!", "#CALC!": "#VALUE!"}


def round15(x: float) -> float:
    """A number as far as comparisons see it."""
    return float(f"{x:.15g}")


def general(x: float) -> str:
    """A number in General format."""
    if x == int(x) if abs(x) < 1e15 else False:
        return str(int(x))
    text = f"{x:.15g}"
    if "e" in text:
        mantissa, exponent = text.split("e")
        text = f"{mantissa}E{exponent[0]}{exponent[1:].lstrip('0').rjust(2, '0')}"
    return text


@F.pandas_udf(DoubleType())
def r15(x: pd.Series) -> pd.Series:
    """``round15`` of a column, null for null. Exact; for columns of integers below 10^15 it changes nothing and can be left out."""
    v = x.to_numpy(np.float64, na_value=np.nan)
    odd = np.isfinite(v) & (v != np.rint(v))
    v = v.copy()
    v[odd] = [float(f"{y:.15g}") for y in v[odd].tolist()]
    return pd.Series(v).where(~np.isnan(v), None)


@F.pandas_udf(StringType())
def general_text(x: pd.Series) -> pd.Series:
    """``general`` of a column."""
    return x.map(lambda v: None if v is None or v != v else general(v))


def cell(kind: int, n=None, s=None) -> Column:
    as_col = lambda v, t: v.cast(t) if isinstance(v, Column) else F.lit(v).cast(t)
    return F.struct(F.lit(kind).cast("tinyint").alias("k"), as_col(n, "double").alias("n"), as_col(s, "string").alias("s"))


EMPTY_CELL = lambda: cell(EMPTY)
number = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")) | c.isNull(), error("#NUM!")).otherwise(cell(NUMBER, n=c))
text = lambda c: cell(TEXT, s=c)
boolean = lambda c: cell(BOOL, n=c.cast("double"))
error = lambda name: cell(ERROR, s=name)


def literal(value) -> Column:
    """A Python value as a cell."""
    if value is None:
        return cell(EMPTY)
    if isinstance(value, bool):
        return cell(BOOL, n=float(value))
    if isinstance(value, (int, float)):
        return cell(NUMBER, n=float(value))
    return cell(ERROR, s=ALIASES.get(value, value)) if value in ERRORS or value in ALIASES else cell(TEXT, s=value)


def is_kind(c: Column, *kinds: int) -> Column:
    return c["k"].isin(*kinds)


def text_to_number(s: Column) -> Column:
    """Text as a number or null: blanks trimmed, thousands separators dropped, a trailing % divides by 100."""
    clean = F.regexp_replace(F.trim(s), ",", "")
    percent = clean.endswith("%")
    body = F.when(percent, F.regexp_replace(clean, "%$", "")).otherwise(clean)
    plain = body.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
    return F.when(plain, F.trim(body).try_cast("double") / F.when(percent, 100.0).otherwise(1.0))


def to_number(c: Column) -> Column:
    """A cell as a number cell, or an error cell."""
    parsed = text_to_number(c["s"])
    return F.when(is_kind(c, NUMBER, ERROR), c).when(c["k"] == EMPTY, cell(NUMBER, n=0.0)).when(c["k"] == BOOL, cell(NUMBER, n=c["n"])).when(parsed.isNotNull(), cell(NUMBER, n=parsed)).otherwise(error("#VALUE!"))


def to_bool(c: Column) -> Column:
    up = F.upper(F.trim(c["s"]))
    return (
        F.when(is_kind(c, BOOL, ERROR), c).when(c["k"] == NUMBER, cell(BOOL, n=(c["n"] != 0).cast("double"))).when(c["k"] == EMPTY, cell(BOOL, n=0.0))
        .when(up == "TRUE", cell(BOOL, n=1.0)).when(up == "FALSE", cell(BOOL, n=0.0)).otherwise(error("#VALUE!"))
    )


def to_text(c: Column) -> Column:
    """A cell as a text cell; errors stay."""
    shown = F.when(c["k"] == NUMBER, general_text(c["n"])).when(c["k"] == TEXT, c["s"]).when(c["k"] == BOOL, F.when(c["n"] != 0, "TRUE").otherwise("FALSE")).otherwise("")
    return F.when(c["k"] == ERROR, c).otherwise(cell(TEXT, s=shown))


def first_error(*cells: Column) -> Column:
    """The leftmost error among cells, or null."""
    return F.coalesce(*(F.when(c["k"] == ERROR, c) for c in cells))


def arithmetic(op: str, a: Column, b: Column) -> Column:
    """+ - * / ^ with coercion; division by zero and overflow are errors."""
    x, y = to_number(a), to_number(b)
    p, q = x["n"], y["n"]
    made = {"+": lambda: p + q, "-": lambda: p - q, "*": lambda: p * q, "/": lambda: p / F.when(q != 0, q), "^": lambda: F.pow(p, q)}[op]()
    out = number(made)
    if op == "/":
        out = F.when(q == 0, error("#DIV/0!")).otherwise(out)
    return F.coalesce(first_error(x, y), out)


def rank_of(c: Column) -> Column:
    """Where a kind stands in the order number, text, bool."""
    return F.when(c["k"] == TEXT, 1).when(c["k"] == BOOL, 2).otherwise(0)


def compare(op: str, a: Column, b: Column) -> Column:
    """= <> < <= > >= as a bool cell. An empty cell beside text is "", otherwise the number 0."""
    fill = lambda c, other: F.when((c["k"] == EMPTY) & (other["k"] == TEXT), cell(TEXT, s="")).when(c["k"] == EMPTY, cell(NUMBER, n=0.0)).otherwise(c)
    x, y = fill(a, b), fill(b, a)
    same = rank_of(x) == rank_of(y)
    p, q = r15(x["n"]), r15(y["n"])
    s, t = F.lower(x["s"]), F.lower(y["s"])
    is_text = rank_of(x) == 1
    equal = same & F.when(is_text, s == t).otherwise(p == q)
    less = F.when(same, F.when(is_text, s < t).otherwise(p < q)).otherwise(rank_of(x) < rank_of(y))
    result = {"=": equal, "<>": ~equal, "<": less, ">=": ~less, "<=": less | equal, ">": ~(less | equal)}[op]
    return F.coalesce(first_error(a, b), boolean(result))


def concat(*cells: Column) -> Column:
    texts = [to_text(c) for c in cells]
    return F.coalesce(first_error(*texts), text(F.concat(*(t["s"] for t in texts))))


def parse_value(raw):
    """A stored string such as a CSV field as a typed Python value: number, bool, error or text; blank is None."""
    if raw is None or raw == "":
        return None
    if raw.upper() in ("TRUE", "FALSE"):
        return raw.upper() == "TRUE"
    return float(raw) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", raw) else raw
