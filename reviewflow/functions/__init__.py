"""Identifiers, text, time and decision math as Spark SQL expressions.

The functions take and return expression text for ``selectExpr`` and ``expr``:
an expression then costs one call into the JVM, where composing it operator by
operator costs one call each.
"""

from __future__ import annotations


def double(value: float) -> str:
    """A DOUBLE literal."""
    return f"({float(value)!r}D)"


def quoted(value: str) -> str:
    """A string literal; backslashes and quotes are escaped."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(value: str, pattern: str) -> str:
    """Whether a text matches; NULL does not."""
    return f"coalesce(rlike({value}, {quoted(pattern)}), false)"


def chain(names, template: str, joiner: str) -> str:
    """The template filled with each name, joined by an operator."""
    return joiner.join(template.format(n) for n in names)
