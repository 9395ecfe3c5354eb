"""Equations in prose: finding them, a key that doesn't depend on how they are written, and whether they hold.

Texts are split and tokenised by built-in expressions; only parsing one equation (at most 200 characters) runs in Python,
on Arrow batches of arrays.
"""

from __future__ import annotations

import keyword
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from stepforge.functions.words import CALLS, LATEX, MATH_COMMON, MATH_OPERATIONS, STOP

LIMIT, EXPONENT = 200, 64
# These patterns decide what is a formula or an operand.
INLINE = r"(?s)\$\$.+?\$\$|\$.+?\$"
DISPLAY = r"(?s)\\\[.+?\\\]|\\\(.+?\\\)"
OPERAND = r"[A-Za-z0-9_.\\{}^()]"
#: A side is taken whole and never given back, so that a run without an equals sign is read once.  A caret is an operand
#: character; blanks beside it join too.
_JOIN = r"(?:\s*+[-+*/]\s*+|\s++(?=\^)|(?<=\^)\s++)"
SIDE = f"{OPERAND}++(?:{_JOIN}{OPERAND}++)*+"
BARE = rf"(?:[-+*/$%]\s*+|\^\s++)?+{SIDE}(?:\s*+=\s*+{SIDE})?+"
_TOKEN = re.compile(r"\s*(?:(?P<n>(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|(?P<w>[A-Za-z_]\w*)|(?P<o>\*\*|[-+*/^()]))", re.ASCII)


def fold_operators(c: Column) -> Column:
    """Every spelling of an operator in its ASCII form (T-04)."""
    return F.regexp_replace(F.regexp_replace(F.translate(c, "×÷·−", "*/*-"), r"\\(?:cdot|times)\b", "*"), r"\\div\b", "/")


def formulas(c: Column) -> Column:
    """The contents of delimited formulas."""
    inner = lambda x: F.when(x.rlike(r"(?s)^\$\$.+\$\$$|^\\"), F.substr(x, F.lit(3), F.length(x) - 4)).otherwise(F.substr(x, F.lit(2), F.length(x) - 2))
    return F.transform(F.concat(F.regexp_extract_all(c, F.lit(INLINE), F.lit(0)), F.regexp_extract_all(c, F.lit(DISPLAY), F.lit(0))), inner)


def unmarked(c: Column, by: str = "") -> Column:
    """A text without its formulas."""
    return F.regexp_replace(F.regexp_replace(c, INLINE, by), DISPLAY, by)


def bare_equations(c: Column) -> Column:
    """Equations in a text without formulas; one that begins after an operator, a price or a percent sign is part of another (T-05)."""
    found = F.regexp_extract_all(c, F.lit(BARE), F.lit(0))
    return F.filter(found, lambda x: x.contains("=") & ~x.rlike(r"^(?:[-+*/$%]|\^\s)"))


def equations(c: Column) -> Column:
    """All equations of a text, those of formulas first (T-05)."""
    text = fold_operators(F.coalesce(c, F.lit("")))
    return F.concat(F.filter(formulas(text), lambda x: x.contains("=")), bare_equations(unmarked(text, " ")))


def written(c: Column) -> Column:
    """A formula as a token: operators folded, commands of the markup left out, blanks collapsed."""
    plain = F.regexp_replace(fold_operators(F.trim(c)), r"\\(?:" + "|".join(LATEX) + r")\b", "")
    return F.regexp_replace(F.regexp_replace(plain, r"^\s+|\s+$", ""), r"\s+", " ")


class Refused(ValueError):
    """Not a bounded arithmetic expression."""


def tokens(s: str) -> list[tuple[str, str]]:
    """(kind, text) of an expression, refused when anything but names, numbers and operators stands in it, a name that
    isn't a function is called, a group or a power is raised, or an exponent isn't a number of at most 64 (T-06)."""
    s = s.strip()
    if not s or len(s) > LIMIT:
        raise Refused
    out, at = [], 0
    while at < len(s):
        m = _TOKEN.match(s, at)
        if m is None:
            raise Refused
        kind = m.lastgroup or ""
        if kind == "n" and len(re.split("[eE][-+]?", m[kind])[-1]) > 3 and re.search("[eE]", m[kind]):
            raise Refused  # an exponent of more than three digits
        out.append((kind, "^" if m[kind] == "**" else m[kind]))
        at = m.end()
    for i, (kind, t) in enumerate(out):
        before = out[i - 1] if i else ("", "")
        if kind == "w" and keyword.iskeyword(t) or t == "(" and before[0] == "w" and before[1] not in CALLS:
            raise Refused
        if t == "^":
            rest = out[i + 1 :]
            rest = rest[1:] if rest and rest[0][1] in "+-" else rest
            if before[1] == ")" or not rest or rest[0][0] != "n" or abs(float(rest[0][1])) > EXPONENT or rest[1:2] == [("o", "^")]:
                raise Refused
    return out


class _Reader:
    """Precedence parser; ``sum_``, ``product`` and the others build the value of each form."""

    def __init__(self, s: str) -> None:
        self.left = tokens(s)[::-1]

    def peek(self) -> tuple[str, str]:
        return self.left[-1] if self.left else ("", "")

    def whole(self):
        v = self.terms()
        if self.left:
            raise Refused
        return v

    def terms(self):
        parts = [self.factors()]
        while self.peek()[1] in ("+", "-"):
            minus = self.left.pop()[1] == "-"
            parts.append(self.negated(self.factors()) if minus else self.factors())
        return self.sum_(parts) if len(parts) > 1 else parts[0]

    def factors(self):
        parts = [self.signed()]
        while (t := self.peek()) != ("", "") and t[1] not in ("+", "-", ")"):
            if t[1] in ("*", "/"):
                self.left.pop()
                parts.append(self.inverse(self.signed()) if t[1] == "/" else self.signed())
            else:  # neighbours are multiplied
                parts.append(self.signed())
        return self.product(parts) if len(parts) > 1 else parts[0]

    def signed(self):
        minus = False
        while self.peek()[1] in ("+", "-"):
            minus ^= self.left.pop()[1] == "-"
        v = self.power()
        return self.negated(v) if minus else v

    def power(self):
        v = self.atom()
        if self.peek()[1] != "^":
            return v
        self.left.pop()
        sign = self.left.pop()[1] if self.peek()[1] in ("+", "-") else ""
        return self.raised(v, ("-" if sign == "-" else "") + self.left.pop()[1])

    def atom(self):
        if not self.left:
            raise Refused
        kind, t = self.left.pop()
        if kind == "n":
            return self.number(t)
        if kind == "w" and self.peek()[1] != "(":
            return self.name(t)
        if kind == "w":
            self.left.pop()
            return self.call(t, self.group())
        if t != "(":
            raise Refused
        return self.group()

    def group(self):
        v = self.terms()
        if self.peek()[1] != ")":
            raise Refused
        self.left.pop()
        return v


def _number(t: str) -> str:
    return str(int(t)) if t.isdigit() else "f" + str(Fraction(t))


class _Key(_Reader):
    """Values are (operator, operands) with the operands of sums and products flat and in order; nothing is computed."""

    def number(self, t):
        return ("n", (_number(t),))

    def name(self, t):
        return ("w", (t,))

    def call(self, t, v):
        return (t, (v,))

    def raised(self, v, t):
        return ("^", (v, ("n", (t,))))

    def _flat(self, op, parts):
        return (op, tuple(sorted((q for p in parts for q in (p[1] if p[0] == op else (p,))), key=shown)))

    def sum_(self, parts):
        return self._flat("+", parts)

    def product(self, parts):
        return self._flat("*", parts)

    def negated(self, v):
        return self.product([("n", ("-1",)), v])

    def inverse(self, v):
        return ("^", (v, ("n", ("-1",))))


def shown(v) -> str:
    return v[1][0] if v[0] in "nw" else f"{v[0]}({','.join(map(shown, v[1]))})"


class _Value(_Reader):
    """Values are exact rationals."""

    def number(self, t):
        return Fraction(t)

    def name(self, t):
        raise Refused

    def call(self, t, v):
        raise Refused

    def raised(self, v, t):
        n = Fraction(t)
        if n.denominator != 1:
            raise Refused
        return v ** int(n)

    def sum_(self, parts):
        return sum(parts)

    def product(self, parts):
        v = Fraction(1)
        for p in parts:
            v *= p
        return v

    def negated(self, v):
        return -v

    def inverse(self, v):
        return 1 / v


def key(equation: str) -> str | None:
    """The two sides as an unordered pair, each with the operands of sums and products in order, nothing computed; None if it
    can't be read (T-07).  3p+e=1.24, e+3p=1.24 and 1.24=3p+e have one key; 2+2=4 and 3+1=4 have two."""
    sides = (equation or "").split("=")
    try:
        return "EQN:" + "|".join(sorted(shown(_Key(s).whole()) for s in sides)) if len(sides) == 2 else None
    except (Refused, OverflowError, RecursionError):
        return None


def holds(equation: str) -> bool | None:
    """Whether closed arithmetic is right, exactly; None where a letter stands or a side can't be read.  Division by zero is wrong."""
    sides = (equation or "").split("=")
    if len(sides) != 2 or re.search("[A-Za-z]", equation):
        return None
    try:
        a, b = (_Value(s).whole() for s in sides)
    except ZeroDivisionError:
        return False
    except (Refused, OverflowError, RecursionError):
        return None
    return a == b


def all_hold(found: list[str] | None) -> bool | None:
    """True if all closed equations hold, False if one fails, None if there is none (N-08)."""
    judged = [h for e in (found if found is not None else ()) if (h := holds(e)) is not None]
    return all(judged) if judged else None


def keys(c: Column) -> Column:
    """The keys of an array of equations; null for those without."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda a: None if a is None else [key(e) for e in a])

    return run(c)


def checked(c: Column) -> Column:
    """all_hold of an array of equations."""

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([all_hold(a) for a in s], dtype=object)

    return run(c)


def _words(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[a-z]+$"))


def math_tokens(c: Column) -> Column:
    """Tokens of a mathematical text, with repeats (T-02): formulas and equations by their key, else as written (three
    characters or more); words of operations, also those inside formulas; other words of more than two letters outside."""
    text = F.coalesce(c, F.lit(""))
    rest = unmarked(text)
    long = lambda a: F.filter(F.transform(a, written), lambda x: F.length(x) >= 3)
    inside, outside = long(formulas(text)), F.filter(long(bare_equations(fold_operators(rest))), lambda x: x.contains("="))
    named = lambda a, p: F.transform(F.arrays_zip(a.alias("a"), keys(a).alias("k")), lambda x: F.concat(F.lit(p), F.coalesce(x["k"], x["a"])))
    common = set(MATH_COMMON)
    spoken = F.filter(_words(text), lambda w: w.isin([x for x in MATH_OPERATIONS if x not in common]))
    plain = F.filter(_words(rest), lambda w: (F.length(w) > 2) & ~w.isin(*MATH_OPERATIONS, *MATH_COMMON, *STOP, *LATEX))
    return F.concat(named(inside, "MATH:"), named(outside, "EQ:"), spoken, plain)


def logical_tokens(c: Column) -> Column:
    """Tokens of a logical text, with repeats (T-01): an applied predicate is one token, in lower case, with its negation;
    then words of two characters or more, joined by hyphens, that aren't stop words."""
    atom = r"(?:[¬~]\s*)?[A-Za-z][A-Za-z0-9_]*+\([^()\s]{1,30}\)"
    text = F.coalesce(c, F.lit(""))
    atoms = F.transform(F.regexp_extract_all(text, F.lit(atom), F.lit(0)), lambda x: F.concat(F.lit("LOGIC:"), F.lower(F.regexp_replace(x, r"^[¬~]\s*", "¬"))))
    runs = F.regexp_extract_all(F.lower(F.regexp_replace(text, atom, " ")), F.lit(r"[\p{L}\p{M}\p{N}_]+(?:-[\p{L}\p{M}\p{N}_]+)*+"), F.lit(0))
    return F.concat(atoms, F.filter(runs, lambda w: w.rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)*$") & (F.length(w) > 1) & ~w.isin(*STOP)))
