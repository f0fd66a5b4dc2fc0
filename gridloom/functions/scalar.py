"""Scalar functions on cells and on plain columns: IF, IFERROR, AND, OR, ISNUMBER, SEARCH, LEFT, CONCATENATE, dates, display formats."""

from __future__ import annotations

import re
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import BOOL, EMPTY, ERROR, NUMBER, TEXT, boolean, cell, concat, error, first_error, number, text, to_bool, to_number, to_text

EPOCH = date(1899, 12, 30)


def fn_if(condition: Column, then: Column | None = None, other: Column | None = None) -> Column:
    c = to_bool(condition)
    return F.when(c["k"] == ERROR, c).when(c["n"] != 0, then if then is not None else cell(BOOL, n=1.0)).otherwise(other if other is not None else cell(BOOL, n=0.0))


def fn_iferror(value: Column, fallback: Column) -> Column:
    return F.when(value["k"] == ERROR, fallback).otherwise(value)


def fn_logic(kind: str, *cells: Column) -> Column:
    """AND or OR of scalar cells; the first error wins."""
    bools = [to_bool(c) for c in cells]
    truth = [b["n"] != 0 for b in bools]
    return F.coalesce(first_error(*bools), boolean(reduce(lambda a, b: a & b if kind == "AND" else a | b, truth)))


def fn_isnumber(c: Column) -> Column:
    return boolean(c["k"] == NUMBER)


def fn_search(find: Column, within: Column, start: Column | None = None) -> Column:
    """1-based place without regard to case; a miss or a bad start is #VALUE!."""
    f, w = to_text(find), to_text(within)
    s = to_number(start) if start is not None else cell(NUMBER, n=1.0)
    at = F.call_function("locate", F.lower(f["s"]), F.lower(w["s"])) if start is None else F.when(s["n"] >= 1, F.call_function("locate", F.lower(f["s"]), F.lower(w["s"]), s["n"].cast("int"))).otherwise(0)
    return F.coalesce(first_error(f, w, s), F.when(at > 0, number(at.cast("double"))).otherwise(error("#VALUE!")))


def fn_left(c: Column, n: Column | None = None) -> Column:
    t, k = to_text(c), to_number(n) if n is not None else cell(NUMBER, n=1.0)
    return F.coalesce(first_error(t, k), F.when(k["n"] < 0, error("#VALUE!")).otherwise(text(F.left(t["s"], F.floor(k["n"]).cast("int")))))


fn_concatenate = concat


def serial_of(d: Column) -> Column:
    """A date column as a serial number."""
    return F.datediff(d, F.lit(EPOCH)).cast("double")


def date_of(serial: Column) -> Column:
    """The date of a serial number (of 61 or more)."""
    return F.date_add(F.lit(EPOCH), F.floor(serial).cast("int"))


def build_date(y: Column, m: Column, d: Column) -> Column:
    """The serial of a year, month and day (integers); years below 1900 count from 1900, months and days overflow into each other."""
    year = F.when(y < 1900, y + 1900).otherwise(y)
    first = F.add_months(F.make_date(year, F.lit(1), F.lit(1)), m - 1)
    return serial_of(F.date_add(first, d - 1))


def fn_date(y: Column, m: Column, d: Column) -> Column:
    parts = [to_number(c) for c in (y, m, d)]
    whole = [F.floor(p["n"]).cast("int") for p in parts]
    made = build_date(*whole)
    return F.coalesce(first_error(*parts), F.when((made < 0) | (whole[0] < 0) | (whole[0] > 9999), error("#NUM!")).otherwise(number(made)))


def fn_date_part(kind: str, c: Column) -> Column:
    n = to_number(c)
    part = {"YEAR": F.year, "MONTH": F.month, "DAY": F.day}[kind](date_of(n["n"]))
    return F.coalesce(first_error(n), F.when((n["n"] < 0) | (n["n"] >= 2958466), error("#NUM!")).otherwise(number(part.cast("double"))))


# -- plain Python: small results on the driver -------------------------------------------------------------------------


def group_digits(x: float, decimals: int = 0, indian: bool = False) -> str:
    """1234567.8 as 1,234,568 or 12,34,568."""
    whole, _, rest = f"{abs(x):.{decimals}f}".partition(".")
    if indian and len(whole) > 3:
        head = whole[:-3]
        whole = ",".join([*re.findall(r"\d{1,2}(?=(?:\d{2})*$)", head), whole[-3:]])
    else:
        whole = re.sub(r"(?<=\d)(?=(?:\d{3})+$)", ",", whole)
    return ("-" if x < 0 and float(f"{x:.{decimals}f}") != 0 else "") + whole + ("." + rest if rest else "")


def show(x, kind: str = "number", decimals: int = 2, indian: bool = False) -> str:
    """A value for people: number, percent, crore, date (d Mon yyyy) or text; None is a dash."""
    if x is None:
        return "–"
    if kind == "percent":
        return group_digits(x * 100, decimals) + "%"
    if kind == "crore":
        return group_digits(x / 1e5, decimals, True) + " lakh crore" if abs(x) >= 1e5 else group_digits(x, decimals, True) + " crore"
    if kind == "date":
        d = EPOCH + timedelta(days=int(x))
        return f"{d.day} {d:%b} {d.year}"
    return group_digits(x, decimals, indian) if kind == "number" else str(x)


def parse_day(value: str) -> float | None:
    """A serial from a number or one of the usual spellings of a date."""
    from datetime import datetime

    if re.fullmatch(r"\d+(\.\d+)?", value.strip()):
        return float(value)
    for form in ("%Y-%m-%d", "%d-%m-%Y", "%d/%m/%Y", "%d %b %Y", "%d %B %Y", "%d-%b-%Y"):
        try:
            return float((datetime.strptime(value.strip(), form).date() - EPOCH).days)
        except ValueError:
            continue
    return None


def find_days(value: str) -> list[float]:
    """Serials of all dates like 31 Jan 2026 in a text, in order."""
    return [x for m in re.findall(r"\b\d{1,2} [A-Za-z]{3,9} \d{4}\b", value) if (x := parse_day(m)) is not None]


def format_kind(number_format: str | None) -> str:
    """The class of a number format: percent, date, general, integer, decimal or text."""
    f = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", (number_format or "General").lower())
    if f == "@":
        return "text"
    if "%" in f:
        return "percent"
    if re.search(r"[dyhs]|mm", f) and "general" not in f:
        return "date"
    return "general" if "general" in f else "decimal" if "." in f else "integer"
