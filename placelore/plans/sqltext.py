"""Small helpers that write SQL text for the checks."""

from __future__ import annotations


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lit_list(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def any_match(expr: str, patterns) -> str:
    return "(" + " or ".join(f"regexp_matches({expr}, {lit(p)})" for p in patterns) + ")"


def first_label(expr: str, table) -> str:
    return "case " + " ".join(
        f"when {any_match(expr, ps)} then {lit(k) if isinstance(k, str) else k}" for k, ps in table) + " end"
