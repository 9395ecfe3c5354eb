"""Equality of final answers: exact rationals, sets, tuples, intervals, and expressions compared at fixed points."""

from __future__ import annotations

import ast
import hashlib
import re
from fractions import Fraction
from math import factorial, isqrt

POINTS = tuple(Fraction(n, 7) for n in (3, 11, 25))
LIMIT = 200
#: Bits of the largest number that is computed.
BITS = 20_000
UNIT = r"(?:k?m|cm|mm|k?g|mg|ml|[Ll]|s|min|h|units?|degrees?|meters?|metres?|inches|feet|dollars|hours?|minutes?|seconds?|days?|years?)"


def _plain(s: str) -> str:
    s = s.strip().strip("$").replace("\\left", "").replace("\\right", "").replace("−", "-").replace("\\cdot", "*").replace("\\times", "*")
    s = re.sub(r"(?<=[\d)}])\s*(?:\\ )?\\(?:text|mathrm)\{\s*" + UNIT + r"\s*\}(?:\^\{?\d\}?)?|\^?\{?\\circ\}?|\u00b0", "", s)
    s = re.sub(r"\\(?:text|mathrm)\{([^{}]*)\}", r"\1", s)
    s = re.sub(r"(?<=\d)\s+" + UNIT + r"$", "", s)
    s = re.sub(r"\\[,;! ]", "", s).replace("\\{", "{").replace("\\}", "}").replace("\\cup", "∪")
    s = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", s) if "(" not in s and "{" not in s and "[" not in s else s
    before = None
    while before != s:
        before, s = s, re.sub(r"\\[dt]?frac\{([^{}]*)\}\{([^{}]*)\}", r"((\1)/(\2))", s)
        s = re.sub(r"\\sqrt\{([^{}]*)\}", r"sqrt(\1)", s)
        s = re.sub(r"\\binom\{(\d+)\}\{(\d+)\}", r"(\1!/(\2!*(\1-\2)!))", s)
    return s.rstrip(".").strip()


def _split(s: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(s):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and not depth:
            out.append(s[last:i])
            last = i + 1
    return [*out, s[last:]]


def _value(node: ast.AST, point: Fraction, names: dict[str, Fraction]) -> Fraction:
    if isinstance(node, ast.Expression):
        return _value(node.body, point, names)
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
        return Fraction(str(node.value))
    if isinstance(node, ast.Name):
        return names.setdefault(node.id, point + int.from_bytes(hashlib.sha256(node.id.encode()).digest()[:3], "big"))
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and len(node.args) == 1 and node.func.id in ("sqrt", "factorial"):
        return (_root if node.func.id == "sqrt" else _factorial)(_value(node.args[0], point, names))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        v = _value(node.operand, point, names)
        return -v if isinstance(node.op, ast.USub) else v
    if isinstance(node, ast.BinOp):
        a, b = _bounded(_value(node.left, point, names)), _value(node.right, point, names)
        if isinstance(node.op, ast.Add):
            return a + b
        if isinstance(node.op, ast.Sub):
            return a - b
        if isinstance(node.op, ast.Mult):
            return a * b
        if isinstance(node.op, ast.Div):
            return a / b
        if isinstance(node.op, ast.Pow) and b.denominator == 1 and abs(b) <= 64 and not _has_power(node.left):
            return _bounded(a ** int(b))
    raise ValueError("not an arithmetic expression")


def _has_power(node: ast.AST) -> bool:
    """Whether a power stands in it: powers of powers are not computed."""
    return any(isinstance(x, ast.Pow) for x in ast.walk(node))


def _bounded(x: Fraction) -> Fraction:
    if x.numerator.bit_length() + x.denominator.bit_length() > BITS:
        raise ValueError("too large")
    return x


def _root(x: Fraction) -> Fraction:
    """The square root: exact where there is one, else to 40 binary places."""
    if x < 0:
        raise ValueError("not a real root")
    top, low = isqrt(x.numerator), isqrt(x.denominator)
    if top * top == x.numerator and low * low == x.denominator:
        return Fraction(top, low)
    return Fraction(isqrt((x.numerator << 80) // x.denominator), 1 << 40)


def _factorial(x: Fraction) -> Fraction:
    if x.denominator != 1 or not 0 <= x <= 170:
        raise ValueError("not a factorial")
    return Fraction(factorial(int(x)))


def values(s: str) -> tuple[Fraction, ...]:
    """Values of an expression at the fixed points; raises for anything else."""
    if len(s) > LIMIT:
        raise ValueError("too long")
    s = re.sub(r"(\d+|[A-Za-z]\w*|\([^()]*\))!", r"factorial(\1)", s)
    s = re.sub(r"(?<=[\d)])\s*(?=[A-Za-z(])", "*", s.replace("^", "**").replace("%", "/100"))
    tree = ast.parse(s, mode="eval")
    return tuple(_value(tree, p, {}) for p in POINTS)


def _close(a: Fraction, b: Fraction) -> bool:
    return abs(a - b) <= max(Fraction(1, 10**9), abs(b) / 10**6)


def _scalar(a: str, b: str) -> bool:
    if a.replace(" ", "").lower() == b.replace(" ", "").lower():
        return True
    try:
        return all(_close(x, y) for x, y in zip(values(a.split("=")[-1].strip()), values(b.split("=")[-1].strip()), strict=True))
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, RecursionError, MemoryError):
        return False


def _shape(s: str) -> tuple[str, list[str]]:
    if len(s) > 1 and s[0] in "([{" and s[-1] in ")]}":
        parts = _split(s[1:-1])
        if s[0] == "{" and s[-1] == "}":
            return "set", parts
        if len(parts) > 1:
            return ("tuple" if s[0] == "(" and s[-1] == ")" else f"interval{s[0]}{s[-1]}"), parts
    parts = _split(s)
    return ("set", parts) if len(parts) > 1 else ("scalar", [s])


def equal(pred: str | None, gold: str | None) -> bool:
    """Blank answers equal nothing; sets are unordered, tuples and intervals ordered, and a scalar is a set of one."""
    if not (pred or "").strip() or not (gold or "").strip():
        return False
    a, b = _plain(pred), _plain(gold)
    (ka, xs), (kb, ys) = _shape(a), _shape(b)
    if {ka, kb} == {"scalar", "set"} and len(xs) == len(ys) == 1:
        ka = kb = "set"
    if ka != kb or len(xs) != len(ys):
        return _scalar(a, b)
    if ka != "set":
        return all(_scalar(x.strip(), y.strip()) for x, y in zip(xs, ys, strict=True))
    left = [y.strip() for y in ys]
    for x in xs:
        hit = next((i for i, y in enumerate(left) if _scalar(x.strip(), y)), None)
        if hit is None:
            return False
        left.pop(hit)
    return True
