"""Criteria of COUNTIF and its kin: parsed once, applied as a boolean Column."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import BOOL, EMPTY, ERROR, ERRORS, NUMBER, TEXT, r15, round15


@dataclass(frozen=True)
class Criterion:
    op: str
    kind: int
    value: object = None  # number, lower-cased text, or error name
    pattern: str | None = None


def wildcard(body: str) -> str | None:
    """The regular expression of a pattern with * ? and ~ escapes, or None where it has none of them."""
    if not re.search(r"[*?~]", body):
        return None
    parts = re.findall(r"~[*?~]|[*?]|[^*?~]+|~", body)
    return "(?is)^" + "".join(".*" if p == "*" else "." if p == "?" else re.escape(p[1:] if len(p) == 2 and p[0] == "~" else p) for p in parts) + "$"


def parse_criterion(value) -> Criterion:
    """A criterion from a Python value: text may begin with an operator; what follows may be a number, a bool, an error, blank or a pattern."""
    if isinstance(value, bool):
        return Criterion("=", BOOL, float(value))
    if isinstance(value, (int, float)):
        return Criterion("=", NUMBER, round15(float(value)))
    if value is None:
        return Criterion("=", NUMBER, 0.0)
    op, body = re.match(r"(?s)(<>|<=|>=|=|<|>)?(.*)", value).groups()
    explicit, op = op is not None, op or "="
    if body == "":
        return Criterion(op, EMPTY, explicit)
    if body in ERRORS:
        return Criterion(op, ERROR, body)
    if body.upper() in ("TRUE", "FALSE"):
        return Criterion(op, BOOL, float(body.upper() == "TRUE"))
    if re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*%?\s*", body):
        n = body.strip()
        return Criterion(op, NUMBER, round15(float(n[:-1]) / 100 if n.endswith("%") else float(n)))
    return Criterion(op, TEXT, body.lower(), wildcard(body) if op in ("=", "<>") else None)


def _ordered(op: str, left: Column, right: Column) -> Column:
    return {"=": left == right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def criterion_mask(c: Column, crit: Criterion, rounded: bool = False) -> Column:
    """Whether cells match. Kinds are strict; <> is true for every cell that = doesn't match, empty ones included. ``rounded``: numbers already have 15 digits."""
    if crit.op == "<>":
        return ~criterion_mask(c, Criterion("=", crit.kind, crit.value, crit.pattern), rounded)
    k, n, s = c["k"], c["n"], c["s"]
    if crit.kind == EMPTY:
        blank = k == EMPTY
        return (blank if crit.value else blank | ((k == TEXT) & (s == ""))) if crit.op == "=" else F.lit(False)
    if crit.kind == NUMBER:
        return (k == NUMBER) & F.coalesce(_ordered(crit.op, n if rounded else r15(n), F.lit(crit.value)), F.lit(False))
    if crit.kind == BOOL:
        return (k == BOOL) & F.coalesce(_ordered(crit.op, n, F.lit(crit.value)), F.lit(False))
    if crit.kind == ERROR:
        return (k == ERROR) & (s == crit.value) if crit.op == "=" else F.lit(False)
    match = s.rlike(crit.pattern) if crit.pattern else _ordered(crit.op, F.lower(s), F.lit(crit.value))
    return (k == TEXT) & F.coalesce(match, F.lit(False))


def text_mask(column: Column, criterion) -> Column:
    """A mask of a plain text column (null: empty)."""
    from .values import cell

    return criterion_mask(F.when(column.isNull(), cell(EMPTY)).otherwise(cell(TEXT, s=column)), parse_criterion(criterion), True)


def number_mask(column: Column, criterion) -> Column:
    """A mask of a plain number column (null: empty) that is known to have at most 15 digits."""
    from .values import cell

    return criterion_mask(F.when(column.isNull(), cell(EMPTY)).otherwise(cell(NUMBER, n=column)), parse_criterion(criterion), True)
