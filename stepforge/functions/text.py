"""Readers of step texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The verdict tokens.
PROVED, DISPROVED = "__PROVED__", "__DISPROVED__"


# Words that say a verdict.
DENIED, HELD = "disproved|false|incorrect|refuted", "proved|proven|true|correct|holds"


def last_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The last match of a pattern, or null."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def normal_label(c: Column) -> Column:
    u = F.upper(F.trim(c))
    return F.when(u.contains("DISPROVED") | (u == "FALSE"), DISPROVED).when(u.contains("PROVED") | (u == "TRUE"), PROVED)


def verdict(c: Column) -> Column:
    """The last verdict token; else a last bold one; else what follows a conclusion mark; else what the last five lines say, a
    denial first; else the last word that says it."""
    c = F.coalesce(c, F.lit(""))
    tries = [last_match(c, r"(__(?:DIS)?PROVED__)"), last_match(c, r"(?i)\*\*\s*((?:dis)?proved|true|false)\s*\*\*"), last_match(c, r"(?i)conclusion\s*:\s*((?:dis)?proved|true|false)")]
    lines = F.filter(F.split(c, "\n"), lambda x: (F.trim(x) != "") & ~x.contains("[Step"))
    tail = F.array_join(F.slice(lines, F.greatest(F.size(lines) - 4, F.lit(1)), 5), " ")
    denied, held = (rf"(?i)\b(?:{w})\b" for w in (DENIED, HELD))
    last = last_match(c, rf"(?i)\b({DENIED}|hypothesis is not|{HELD})\b")
    said = F.when(tail.rlike(denied), DISPROVED).when(tail.rlike(held), PROVED).when(last.rlike(denied) | last.rlike("(?i) not$"), DISPROVED).when(last.isNotNull(), PROVED)
    return F.coalesce(normal_label(F.coalesce(*tries)), said)


def boxed(c: Column) -> Column:
    r"""Content of the last \boxed{...} with braces nested once."""
    return last_match(c, r"\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}")


def final_answer(c: Column) -> Column:
    """Boxed content, without thousands commas unless it is a tuple, an interval or a set; else what follows ####, else what follows 'answer is'."""
    box = F.trim(boxed(c))
    box = F.when(box.rlike(r"[(\[]|\\\{"), box).otherwise(F.regexp_replace(box, r"(?<=\d),(?=\d{3}(?!\d))", ""))
    return F.coalesce(box, F.trim(last_match(c, r"####\s*([^\n]+)")), F.trim(last_match(c, r"(?i)answer\s+is\s*:?\s*([^\n.]+)")))


def token_count(c: Column) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("long")


def step_header(c: Column) -> Column:
    return c.rlike(r"^\s*\**\s*[Ss]tep\s*\d+\s*\**\s*[:.\-]")


def setting_slug(c: Column) -> Column:
    c = F.replace(F.replace(F.replace(F.lower(c), F.lit("w/o"), F.lit("wout")), F.lit("&"), F.lit("and")), F.lit("="), F.lit(""))
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", "_"))
