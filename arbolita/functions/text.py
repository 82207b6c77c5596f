"""Extraction and coherence expressions over text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract_root(text: Column) -> Column:
    """The first <root>…</root>, else what follows <root, else null."""
    whole = F.regexp_extract(text, r"(?s)<root.*?</root>", 0)
    tail = F.when(F.contains(text, F.lit("<root")), F.substring(text, F.locate("<root", text), F.length(text)))
    return F.coalesce(F.nullif(whole, F.lit("")), tail)


def extract_root_any_case(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?is)<root.*?</root>", 0), F.lit(""))


def strip_declaration(text: Column) -> Column:
    return F.ltrim(F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"^\s*<\?xml.*?\?>", ""))


def strip_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\n", ""), r"\n?```$", ""))


def extract_code(text: Column) -> Column:
    """A python fence, else any fence, else text that looks like code, else ''."""
    python = F.regexp_extract(text, r"(?s)```python\s*\n(.*?)```", 1)
    fence = F.regexp_extract(text, r"(?s)```\w*\s*\n(.*?)```", 1)
    looks = F.when(text.rlike(r"(?m)^(from|import|def|class)\s|^\w+\s*=\s*"), text).otherwise("")
    return F.trim(F.coalesce(F.nullif(python, F.lit("")), F.nullif(fence, F.lit("")), looks))


def after_instruction(text: Column) -> Column:
    return F.trim(F.element_at(F.split(text, r"\[/INST\]"), -1))


def mission_class(text: Column, inspection: list[str], control: list[str], simulation: list[str]) -> Column:
    """Four ordered keyword classes."""
    low = F.lower(text)

    def some(words):
        found = F.lit(False)
        for w in words:
            found = found | F.contains(low, F.lit(w))
        return found

    return (
        F.when(some(simulation), "simulation").when(some(inspection) & some(control), "inspection_avec_controle").when(some(inspection), "inspection_sans_controle").otherwise("transport")
    )


def blackboard_variables(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(r"\{([^{}]+)\}"), 1)
