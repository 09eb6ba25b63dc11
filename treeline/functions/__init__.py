"""Scalar functions of the query surface, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F


def normalize_space(a: F.Column) -> F.Column:
    return F.trim(F.regexp_replace(a, r"[ \t\n\r]+", " "))


def before(a: F.Column, mark: str) -> F.Column:
    """What stands before the first mark; empty if there is none."""
    return F.when(F.contains(a, F.lit(mark)), F.substring_index(a, mark, 1)).otherwise("")


def after(a: F.Column, mark: str) -> F.Column:
    return F.when(F.contains(a, F.lit(mark)), F.substring(a, F.locate(mark, a) + len(mark), F.length(a))).otherwise("")


def shortened(a: F.Column, size: int = 100) -> F.Column:
    return F.when(F.length(a) < size, a).otherwise(F.concat(F.substring(a, 1, size), F.lit("...")))


def is_identifier(a: F.Column, keywords: tuple[str, ...] = ()) -> F.Column:
    """A letter or underscore, then letters, digits and underscores, and no keyword."""
    return a.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & ~a.isin(*keywords)


def renamed(a: F.Column, old: str, new: str) -> F.Column:
    """Every whole identifier `old` becomes `new`; longer identifiers that hold it stay."""
    return F.regexp_replace(a, whole(old), re.sub(r"([\\$])", r"\\\1", new))


def whole(name: str) -> str:
    return rf"(?<![A-Za-z0-9_])\Q{name}\E(?![A-Za-z0-9_])"


def named(a: F.Column, names: dict[str, str], other: str = "unknown") -> F.Column:
    """The name of a code; what has none, null included, gets `other`."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), a), F.lit(other))


def holds_sql(a: F.Column) -> F.Column:
    """Whether a string reads like an SQL statement."""
    return F.coalesce(a.rlike(r"(?is)\bselect\b.*\bfrom\b|\binsert\s+into\b|\bupdate\b.*\bset\b|\bdelete\s+from\b"), F.lit(False))


def modifiers(tokens: F.Column, names: dict[str, str]) -> F.Column:
    """Tokens lower-cased, by their common names, joined by blanks."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(t)), F.lower(t))), " ")


def unquoted(a: F.Column) -> F.Column:
    """A literal without the quotes around it."""
    return F.regexp_replace(a, r'^"(.*)"$', "$1")


def wildcard_replaced(a: F.Column, pattern: str, replacement: str) -> F.Column:
    """prefix*suffix -> the replacement with what stood for * in place of its own *; others stay."""
    head, tail = (re.escape(x) for x in pattern.split("*", 1))
    return F.regexp_replace(a, f"(?s)^{head}(.*){tail}$", re.sub(r"([\\$])", r"\\\1", replacement).replace("*", "$1", 1))


def summary(a: F.Column, tag: str) -> F.Column:
    """The text of an element, its blanks collapsed; empty if there is none."""
    return normalize_space(F.regexp_extract(a, f"(?s)<{tag}>(.*?)</{tag}>", 1))


def as_task(a: F.Column, nothing: str = "void") -> F.Column:
    """The type that an asynchronous member returns."""
    return F.when(F.startswith(a, F.lit("Task")), a).when(a == nothing, "Task").otherwise(F.concat(F.lit("Task<"), a, F.lit(">")))


def added_after(a: F.Column, mark: str, new: str) -> F.Column:
    """`new` put in after the first mark; after the end if there is none."""
    at = F.locate(mark, a)
    return F.when(at > 0, F.concat(F.substring(a, F.lit(1), at + len(mark) - 1), F.lit(new), F.substring(a, at + len(mark), F.length(a)))).otherwise(F.concat(a, F.lit(new)))
