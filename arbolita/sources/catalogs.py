"""Catalogs, rules and reference documents from files; small, so the driver reads them."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolita.operators.catalog import Catalog, Port, Rule, Skill


def _yaml(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def load_catalog(path: str) -> Catalog:
    """A YAML catalog: families of skills with their ports, prerequisites, tags and limits.

    Unless told otherwise a skill is an Action, a port is an optional blackboard variable; a port that isn't a mapping is left out.
    """
    raw, skills = _yaml(path), []
    for family, body in (raw.get("families") or {}).items():
        for name, spec in ((body or {}).get("skills") or {}).items():
            spec = spec or {}
            ports = [
                Port(p, x.get("type", "bb_var"), x.get("required", False), None if x.get("default") is None else str(x["default"]), tuple(map(str, x["allowed"])) if x.get("allowed") else None)
                for p, x in (spec.get("ports") or {}).items() if isinstance(x, dict)
            ]
            skills.append(Skill(name, family, spec.get("bt_tag", "Action"), tuple(ports), tuple(spec.get("prerequisites") or ()), spec.get("description", "")))
    limits = raw.get("limits") or {}
    return Catalog(
        tuple(skills), tuple((s, p) for s, ps in (raw.get("prerequisites") or {}).items() for p in ps), tuple(raw.get("control_nodes") or ()), tuple(raw.get("valid_tags") or ()),
        limits.get("max_depth", 12), limits.get("max_skills", 80), limits.get("min_fallback_children", 2), str((raw.get("metadata") or {}).get("version", "?")),
    )


def load_rules(path: str) -> list[Rule]:
    """Safety rules; a rule blocks unless it says that it doesn't."""
    return [Rule(r["id"], r["name"], r["description"], r["level"], tuple(r.get("enforcement") or ()), r.get("blocking", True)) for r in _yaml(path).get("rules") or []]


def load_navigation(path: str) -> dict:
    """The second dialect's JSON catalog: ``skills`` as (id, tag, parameters (name, type, required)) and ``control`` as tag -> attributes.

    A parameter is optional where its description says so; ``ID`` and ``__shared_blackboard`` belong to the tag and are no parameters.
    """
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    skills = []
    for x in raw.get("atomic_skills") or []:
        ports = []
        for required, group in ((True, x.get("input_ports") or {}), (False, x.get("output_ports") or {})):
            for name, text in group.items():
                if name not in ("ID", "__shared_blackboard"):
                    words = str(text).lower()
                    ports.append((name, words.split()[0] if words.split() else "string", required and "optional" not in words))
        skills.append((x["id"], x.get("bt_tag", x["id"]), ports))
    return {"skills": skills, "control": {c["bt_tag"]: list(c.get("attributes") or []) for c in raw.get("control_nodes_allowed") or []}}


def required_parameters(catalog: dict) -> dict[str, set[str]]:
    return {s: {p for p, _, r in ports if r} for s, _, ports in catalog["skills"]}


def all_parameters(catalog: dict) -> dict[str, set[str]]:
    return {s: {p for p, _, _ in ports} for s, _, ports in catalog["skills"]}


def first_existing(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """JSON lines of the first path that is there; no rows (under ``schema``) where none is."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        at = hadoop(path if "://" in path else f"file://{os.path.abspath(path)}")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.read.schema(schema).json(path)
    return spark.createDataFrame([], schema)


def allowlist(trees: DataFrame) -> DataFrame:
    """``kind, name, of``: the tags, the attributes (of their tag) and the blackboard variables of reference documents; unparsable ones give nothing."""
    n = trees.where("parse_error is null").select(F.explode("nodes").alias("n"))
    tags = n.select(F.lit("tag").alias("kind"), F.col("n.tag").alias("name"), F.lit(None).cast("string").alias("of"))
    attrs = n.select(F.col("n.tag").alias("of"), F.explode("n.attrs").alias("name", "value"))
    names = attrs.select(F.lit("attr").alias("kind"), "name", "of")
    variables = attrs.select(F.lit("variable").alias("kind"), F.explode(F.regexp_extract_all("value", F.lit(r"\{([^{}]+)\}"), 1)).alias("name"), F.lit(None).cast("string").alias("of"))
    return tags.unionByName(names).unionByName(variables).distinct()
