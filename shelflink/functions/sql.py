"""Building blocks for Spark SQL expression text.

Every scalar of the engine is a Python function from SQL text to SQL text
(``strip_tags("title")``), used through ``F.expr`` / ``selectExpr``.  A rule of a
few hundred nodes is then one parse in the JVM, where the same tree built node by
node from Python costs seconds of driver round trips per query.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from .regex import rx

Sql = str

_names = count()


def quote(value: str) -> Sql:
    """String literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pattern(value: str, ignore_case: bool = False, ascii: bool = False) -> Sql:
    """Regex literal; raw, so backslashes mean what the regex says.  ``ascii`` keeps
    Java's own blanks, enough (and faster) for markup."""
    regex = value if ascii else rx(value, ignore_case)
    return "r'" + regex.replace("'", r"\x27") + "'"


def let(value: Sql, body: Callable[[Sql], Sql]) -> Sql:
    """Bind ``value`` once and use it many times inside ``body``."""
    name = f"v{next(_names)}"
    return f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"


def bind(value: Sql, body: Callable[[Sql], Sql]) -> Sql:
    """``let`` for anything longer than a plain name."""
    return body(value) if value.replace(".", "_").isidentifier() else let(value, body)


def repeat(value: Sql, times: int, step: Callable[[Sql], Sql]) -> Sql:
    """Apply ``step`` to a string a fixed number of times (a bounded fixed point)."""
    name = f"v{next(_names)}"
    return f"aggregate(sequence(1, {times}), {value}, ({name}, {name}_i) -> {step(name)})"


def each(values: Sql, body: Callable[[Sql], Sql]) -> Sql:
    name = f"v{next(_names)}"
    return f"transform({values}, {name} -> {body(name)})"


def keep(values: Sql, body: Callable[[Sql], Sql]) -> Sql:
    name = f"v{next(_names)}"
    return f"filter({values}, {name} -> {body(name)})"


def keep_indexed(values: Sql, body: Callable[[Sql, Sql], Sql]) -> Sql:
    name = f"v{next(_names)}"
    return f"filter({values}, ({name}, {name}_i) -> {body(name, name + '_i')})"


def each_indexed(values: Sql, body: Callable[[Sql, Sql], Sql]) -> Sql:
    name = f"v{next(_names)}"
    return f"transform({values}, ({name}, {name}_i) -> {body(name, name + '_i')})"


def sub(value: Sql, regex: str, replacement: str = "", ignore_case: bool = False, ascii: bool = False) -> Sql:
    return f"regexp_replace({value}, {pattern(regex, ignore_case, ascii)}, {quote(replacement)})"


def has(value: Sql, regex: str, ignore_case: bool = False, ascii: bool = False) -> Sql:
    return f"coalesce(rlike({value}, {pattern(regex, ignore_case, ascii)}), false)"


def grab(value: Sql, regex: str, group: int = 1, ignore_case: bool = False, ascii: bool = False) -> Sql:
    """First match of ``group``; the empty string when there is none."""
    return f"coalesce(regexp_extract({value}, {pattern(regex, ignore_case, ascii)}, {group}), '')"


def grab_all(value: Sql, regex: str, group: int = 1, ignore_case: bool = False, ascii: bool = False) -> Sql:
    return f"regexp_extract_all({value}, {pattern(regex, ignore_case, ascii)}, {group})"


def text(value: Sql) -> Sql:
    return f"coalesce({value}, '')"


def strings(value: Sql) -> Sql:
    return f"coalesce({value}, cast(array() as array<string>))"


def array_of(values: list[str]) -> Sql:
    return "array(" + ", ".join(quote(v) for v in values) + ")"


def case(*branches: tuple[Sql, Sql], default: Sql = "null") -> Sql:
    body = " ".join(f"when {cond} then {value}" for cond, value in branches)
    return f"(case {body} else {default} end)"


def yes_no(condition: Sql, yes: str, no: str) -> Sql:
    return f"if({condition}, {quote(yes)}, {quote(no)})"


def any_of(conditions: list[Sql]) -> Sql:
    return "(" + " or ".join(f"({c})" for c in conditions) + ")"


def count_true(conditions: list[Sql]) -> Sql:
    return "(" + " + ".join(f"cast(({c}) as int)" for c in conditions) + ")"
