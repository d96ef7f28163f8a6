"""Small helpers for expressions written as SQL text.

Operators build long expressions as text and hand them to Spark in one piece, which parses them
far faster than it assembles them from single Column calls.
"""

from __future__ import annotations

from collections.abc import Iterable


def literal(value: object) -> str:
    """SQL literal of a text, number, truth value or null."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def quote(name: str) -> str:
    """Back-ticked name, so that dots and blanks in it are harmless."""
    return "`" + name.replace("`", "``") + "`"


def listed(values: Iterable[object]) -> str:
    return ", ".join(literal(v) for v in values)


def one_of(expression: str, values: Iterable[object]) -> str:
    return f"({expression} IN ({listed(values)}))"


def contains_any(expression: str, parts: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({expression}, {literal(p)})" for p in parts) + ")"


def records(rows: Iterable[dict[str, str]]) -> str:
    """An array of structs, each given as expression by field name."""
    structs = (
        "named_struct(" + ", ".join(f"{literal(n)}, {e}" for n, e in row.items()) + ")"
        for row in rows
    )
    return "array(" + ", ".join(structs) + ")"


def present(expressions: Iterable[str]) -> str:
    """An array of those expressions that are not null, in order."""
    return "array_compact(array(" + ", ".join(expressions) + "))"


# Guarded arithmetic: no division errors, no NaN or infinity in results.

def share(part: str, whole: str) -> str:
    """part / whole, 0 where there is nothing to share."""
    return f"(CASE WHEN {whole} > 0 THEN double({part}) / double({whole}) ELSE 0D END)"


def rounded(number: str, places: int) -> str:
    """A number that is not negative, rounded on its binary value.

    `round` works on the shortest decimal form instead, and takes 0.00015 up to 0.0002.
    """
    return f"(floor({number} * {10 ** places}D + 0.5D) / {10 ** places}D)"


def percent(part: str, whole: str) -> str:
    return rounded(f"{share(part, whole)} * 100D", 2)


def finite(number: str) -> str:
    """The number, or null for NaN and infinity."""
    return f"(CASE WHEN abs({number}) < double('infinity') THEN {number} END)"


def plain(number: str, places: int) -> str:
    """A number as digits with fixed decimals, never in exponent form."""
    return f"string(cast(round({number}, {places}) AS decimal(38, {places})))"
