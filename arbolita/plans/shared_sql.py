"""Queries whose text both engines read: tables in braces are DataFrames here and views of that name in DuckDB."""

from __future__ import annotations

import re

from arbolita.registry import query
from arbolita.sources.tables import table


def shared(name: str, text: str, duck: dict[str, str] | None = None) -> None:
    """Register ``text``; ``duck`` maps stretches of it to what DuckDB calls them."""
    tables = sorted(set(re.findall(r"\{(\w+)\}", text)))
    other = text.format(**{t: t for t in tables})
    for a, b in (duck or {}).items():
        other = other.replace(a, b)

    @query(name, other)
    def run(spark, sf_dir, text=text, tables=tables):
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})
