"""Ordered replacement rules, usable as Spark columns and as SQL of another engine.

Patterns are written in the syntax that Java and RE2 share: letters and digits as \\p{L} and \\p{N}, white space as
[\\s\\p{Z}], so that Cyrillic text and non-breaking spaces behave as they do in Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and word signs, inside and outside of a class.
S, W = r"\s\p{Z}", r"\p{L}\p{N}_"

Rules = list[tuple[str, str]]


def apply(column: Column, rules: Rules) -> Column:
    """Every rule in turn; $1 in a replacement is the first group."""
    for pattern, by in rules:
        column = F.regexp_replace(column, pattern, by)
    return column


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def apply_sql(expression: str, rules: Rules) -> str:
    """The same as an expression of DuckDB."""
    for pattern, by in rules:
        expression = f"regexp_replace({expression}, {quote(pattern)}, {quote(re.sub(r'[$]([0-9])', r'\\\1', by))}, 'g')"
    return expression


def strip(column: Column) -> Column:
    return F.regexp_replace(column, rf"^[{S}]+|[{S}]+$", "")


def strip_sql(expression: str) -> str:
    return f"regexp_replace({expression}, '^[{S}]+|[{S}]+$', '', 'g')"
