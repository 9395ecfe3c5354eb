"""LaTeX tables of paired tests; a report has one row a condition."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

#: The levels of the stars.
STARS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))


def signed(x: float | None) -> str:
    """Two places with a sign; what rounds to zero has none."""
    if x is None or math.isnan(x):
        return "---"
    return f"{x:+.2f}" if abs(x) >= 0.005 else "0.00"


def p_value(p: float | None) -> str:
    if p is None or math.isnan(p):
        return "---"
    return "<0.01" if p < 0.005 else f"{p:.2f}"


def stars(p: float | None) -> str:
    return "" if p is None or math.isnan(p) else next((s for level, s in STARS if p < level), "ns")


def latex_table(rows: Iterable[Mapping], caption: str = "", label: str = "") -> str:
    """rows have model, condition, mean_diff, ci_lo, ci_hi, p, d; a rule separates models."""
    body, before = [], None
    for r in rows:
        if before is not None and r["model"] != before:
            body.append(r"\midrule")
        name = "" if r["model"] == before else r["model"]
        numbers = [signed(r["mean_diff"]), signed(r.get("ci_lo")), signed(r.get("ci_hi")), p_value(r["p"]), signed(r["d"])]
        body.append(" & ".join([name, r["condition"], *(f"${x}$" for x in numbers), stars(r["p"])]) + r" \\")
        before = r["model"]
    head = [r"\begin{table}[ht]", r"\centering", rf"\caption{{{caption}}}", rf"\label{{{label}}}", r"\begin{tabular}{llrrrrrl}", r"\toprule", r"Model & Condition & $\Delta$ & low & high & $p$ & $d$ & \\", r"\midrule"]
    return "\n".join([*head, *body, r"\bottomrule", r"\end{tabular}", r"\end{table}"])
