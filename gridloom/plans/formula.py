"""The formula language: tokens, a parser with a stack of brackets, canonical (R1C1) and A1 text.

References are held relative to the cell that owns the formula, so copies of one formula are equal trees.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, fields, is_dataclass

from ..functions.values import ALIASES, ERRORS

MAX_ROW, MAX_COL = 1_048_576, 16_384


class FormulaError(ValueError):
    """The text is no formula that this language knows."""


@dataclass(frozen=True)
class Axis:
    """A row or column: a number, or an offset from the owner."""

    fixed: bool
    n: int

    def at(self, home: int) -> int:
        return self.n if self.fixed else home + self.n


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Bool:
    value: bool


@dataclass(frozen=True)
class ErrorValue:
    name: str


@dataclass(frozen=True)
class Empty:
    pass


@dataclass(frozen=True)
class Cell:
    sheet: str | None
    row: Axis
    col: Axis


@dataclass(frozen=True)
class Range:
    """A rectangle; whole columns have no rows, whole rows no columns."""

    sheet: str | None
    top: Axis | None
    left: Axis | None
    bottom: Axis | None
    right: Axis | None


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Foreign:
    """A structured or external reference: parsed, kept, and #REF! when evaluated."""

    text: str


@dataclass(frozen=True)
class Unary:
    op: str
    x: object


@dataclass(frozen=True)
class Binary:
    op: str
    a: object
    b: object


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Array:
    rows: tuple


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def column_number(letters: str) -> int:
    n = 0
    for ch in letters.upper():
        n = n * 26 + ord(ch) - 64
    return n


_SHEET = r"(?:'(?:[^']|'')+'|[A-Za-z_\\][\w.\\]*)!"
_TOKEN = re.compile(
    r"""(?P<space>\s+)
    |(?P<text>"(?:[^"]|"")*")
    |(?P<error>\#(?:NULL!|DIV/0!|VALUE!|REF!|NAME\?|NUM!|N/A|GETTING_DATA|SPILL!|CALC!))
    |(?P<foreign>(?:'[^']*\[[^\]]+\][^']*'|\[[^\]]+\][\w.]*)!\$?[A-Za-z]{1,3}\$?\d+(?::\$?[A-Za-z]{1,3}\$?\d+)?|[A-Za-z_]\w*\[(?:[^\[\]]|\[[^\]]*\])*\])
    |(?P<ref>(?:%s)?(?:\$?[A-Za-z]{1,3}\$?\d+:\$?[A-Za-z]{1,3}\$?\d+|\$?[A-Za-z]{1,3}:\$?[A-Za-z]{1,3}(?![\w(])|\$?\d+:\$?\d+|\$?[A-Za-z]{1,3}\$?\d+(?![\w(.])))
    |(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<call>[A-Za-z_][\w.]*\()
    |(?P<name>(?:%s)?[A-Za-z_\\][\w.\\]*)
    |(?P<op><>|<=|>=|[-+*/^&=<>%%(),;{}])"""
    % (_SHEET, _SHEET),
    re.X,
)


def tokens(formula: str) -> list[tuple[str, str]]:
    at, out = 0, []
    while at < len(formula):
        m = _TOKEN.match(formula, at)
        if not m:
            raise FormulaError(f"unexpected {formula[at:at + 12]!r} in {formula!r}")
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


_CORNER = re.compile(r"(?:(\$?)([A-Za-z]+))?(?:(\$?)(\d+))?")


def reference(token: str, row: int, col: int, own_sheet: str | None = None):
    """A reference token as Cell or Range; the own sheet's prefix is dropped. An end that names no row (or column) leaves it open."""
    prefix, _, body = token.rpartition("!")
    sheet = prefix[1:-1].replace("''", "'") if prefix.startswith("'") else prefix
    places = []
    for end in body.split(":"):
        pin_col, letters, pin_row, digits = _CORNER.fullmatch(end).groups()
        for pin, n, home in ((pin_row, digits and int(digits), row), (pin_col, letters and column_number(letters), col)):
            places.append(None if n is None else Axis(bool(pin), n if pin else n - home))
    return (Cell if len(places) == 2 else Range)(None if sheet in ("", own_sheet) else sheet, *places)


#: Binding powers: comparison, joining, sums, products, powers, signs. All but signs associate to the left.
_POWER = {"=": 1, "<>": 1, "<": 1, ">": 1, "<=": 1, ">=": 1, "&": 2, "+": 3, "-": 3, "*": 4, "/": 4, "^": 5}
_SIGN = 6


@dataclass
class _Level:
    """What stands between two brackets: the bracket (or the call's name), finished rows and arguments, and the operands and operators of the expression that is being read."""

    opener: str
    rows: list = field(default_factory=list)
    row: list = field(default_factory=list)
    operands: list = field(default_factory=list)
    operators: list = field(default_factory=list)  # (power, word)
    wanted: bool = True  # an operand comes next

    def put(self, tree) -> None:
        self.operands.append(tree)
        self.wanted = False

    def settle(self, power: int) -> None:
        """Applies the waiting operators that bind at least so tightly."""
        while self.operators and self.operators[-1][0] >= power:
            strength, word = self.operators.pop()
            last = self.operands.pop()
            self.operands.append(Unary(word, last) if strength == _SIGN else Binary(word, self.operands.pop(), last))

    def end_argument(self) -> None:
        if self.wanted:
            if self.operators or not self.opener.endswith("("):
                raise FormulaError("an operand is missing")
            self.put(Empty())
        self.settle(0)
        self.row.append(self.operands.pop())
        self.wanted = True


def _leaf(kind: str, word: str, row: int, col: int, sheet: str | None):
    if kind == "name":
        return Bool(word.upper() == "TRUE") if word.upper() in ("TRUE", "FALSE") else Name(word)
    if kind == "ref":
        return reference(word, row, col, sheet)
    made = {"number": lambda: Number(float(word)), "text": lambda: Text(word[1:-1].replace('""', '"')), "error": lambda: ErrorValue(ALIASES.get(word, word)), "foreign": lambda: Foreign(word)}
    return made[kind]()


def _close(level: _Level, word: str):
    """The tree of a finished bracket."""
    if word == ")" and level.opener not in ("", "{"):
        if level.row or not level.wanted or level.operators:
            level.end_argument()
        if level.opener != "(":
            return Call(level.opener[:-1].upper().removeprefix("_XLFN."), tuple(level.row))
        if len(level.row) == 1 and not isinstance(level.row[0], Empty):
            return level.row[0]
    elif word == "}" and level.opener == "{":
        level.end_argument()
        return Array((*level.rows, tuple(level.row)))
    raise FormulaError(f"{word!r} closes nothing")


def parse(formula: str, row: int = 1, col: int = 1, sheet: str | None = None):
    """The tree of a formula owned by the cell at (row, col): one pass with a stack of brackets, each with stacks of operands and operators."""
    levels = [_Level("")]
    try:
        for kind, word in tokens(formula.removeprefix("=")):
            now = levels[-1]
            if kind == "call" or word in ("(", "{") and kind == "op":
                if not now.wanted:
                    raise FormulaError(f"{word!r} follows an operand")
                levels.append(_Level(word))
            elif kind != "op":
                if not now.wanted:
                    raise FormulaError(f"{word!r} follows an operand")
                now.put(_leaf(kind, word, row, col, sheet))
            elif word in (")", "}"):
                tree = _close(levels.pop(), word)
                levels[-1].put(tree)
            elif word in (",", ";"):
                if now.opener in ("", "(") or word == ";" and now.opener != "{":
                    raise FormulaError(f"{word!r} outside of a list")
                now.end_argument()
                if word == ";":
                    now.rows.append(tuple(now.row))
                    now.row = []
            elif now.wanted:
                if word not in "+-":
                    raise FormulaError(f"{word!r} needs an operand before it")
                now.operators.append((_SIGN, word))
            elif word == "%":
                now.operands.append(Unary("%", now.operands.pop()))  # binds tightest
            else:
                now.settle(_POWER[word])
                now.operators.append((_POWER[word], word))
                now.wanted = True
        if len(levels) > 1:
            raise FormulaError(f"{levels[-1].opener!r} isn't closed")
        levels[0].end_argument()
    except FormulaError as e:
        raise FormulaError(f"{e} in {formula!r}") from None
    return levels[0].row[0]


def walk(tree) -> Iterator:
    """Every node, parents first."""
    yield tree
    for f in fields(tree) if is_dataclass(tree) and not isinstance(tree, Axis) else ():
        v = getattr(tree, f.name)
        for x in v if isinstance(v, tuple) else (v,):
            for y in x if isinstance(x, tuple) else (x,):
                if is_dataclass(y) and not isinstance(y, Axis):
                    yield from walk(y)


def references(tree) -> list:
    return [n for n in walk(tree) if isinstance(n, (Cell, Range))]


def called(tree) -> set[str]:
    return {n.name for n in walk(tree) if isinstance(n, Call)}


def render(tree, home: tuple[int, int] | None = None) -> str:
    """A1 text for an owner, or canonical R1C1 text without one."""

    def axis(a: Axis, is_col: bool) -> str:
        if home:
            n = a.at(home[1 if is_col else 0])
            return ("$" if a.fixed else "") + (column_letters(n) if is_col else str(n))
        return ("C" if is_col else "R") + (str(a.n) if a.fixed else f"[{a.n}]" if a.n else "")

    def place(row: Axis | None, col: Axis | None) -> str:
        parts = [axis(row, False) if row else "", axis(col, True) if col else ""]
        return "".join(reversed(parts)) if home else "".join(parts)

    def go(n, outer: int = 0) -> str:
        if isinstance(n, Number):
            return f"{n.value:.15g}"
        if isinstance(n, Text):
            return '"' + n.value.replace('"', '""') + '"'
        if isinstance(n, Bool):
            return "TRUE" if n.value else "FALSE"
        if isinstance(n, ErrorValue):
            return n.name
        if isinstance(n, Empty):
            return ""
        if isinstance(n, Name):
            return n.name
        if isinstance(n, Foreign):
            return n.text
        if isinstance(n, (Cell, Range)):
            sheet = "" if n.sheet is None else (n.sheet if re.fullmatch(r"[A-Za-z_]\w*", n.sheet) else "'" + n.sheet.replace("'", "''") + "'") + "!"
            return sheet + (place(n.row, n.col) if isinstance(n, Cell) else place(n.top, n.left) + ":" + place(n.bottom, n.right))
        if isinstance(n, Unary):
            return f"{go(n.x, 6)}%" if n.op == "%" else n.op + go(n.x, 6)
        if isinstance(n, Call):
            return f"{n.name}({','.join(go(a) for a in n.args)})"
        if isinstance(n, Array):
            return "{" + ";".join(",".join(go(x) for x in r) for r in n.rows) + "}"
        p = _POWER[n.op]
        said = f"{go(n.a, p - 1)}{n.op}{go(n.b, p)}"
        return f"({said})" if outer >= p else said

    return go(tree)


#: Registered functions; others stop a run before it begins.
SUPPORTED = frozenset("COUNTIF COUNTIFS SUMIF AVERAGEIF SUMPRODUCT SUM COUNT MAX MIN AVERAGE IF IFERROR AND OR ISNUMBER SEARCH LEFT CONCATENATE CONCAT VLOOKUP HLOOKUP YEAR MONTH DAY DATE".split())

_KEY = re.compile(r'"(?:[^"]|"")*"|(?:%s)?\$?[A-Za-z]{1,3}\$?\d+(?![\w(.])' % _SHEET)


def fast_key(formula: str, row: int, col: int) -> str:
    """A text that copies of one formula share, without parsing: cell references become relative."""

    def swap(m: re.Match) -> str:
        word = m[0]
        if word.startswith('"'):
            return word
        sheet, _, ref = word.rpartition("!")
        cd, letters, rd, digits = re.fullmatch(r"(\$?)([A-Za-z]+)(\$?)(\d+)", ref).groups()
        r = digits if rd else f"[{int(digits) - row}]"
        c = str(column_number(letters)) if cd else f"[{column_number(letters) - col}]"
        return f"{sheet}!R{r}C{c}" if sheet else f"R{r}C{c}"

    return _KEY.sub(swap, formula)
