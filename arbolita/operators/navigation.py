"""Rules of the second dialect: definitions and references, required and unknown attributes, literal types, cycles, data flow."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolita.operators.validate import FLOAT, INT, literal, unfolded

#: skill, tag, required attributes with their types
SKILLS = [
    ("Wait", [("wait_duration", "float", True)]),
    ("Spin", [("spin_dist", "float", True), ("is_recovery", "bool", False)]),
    ("BackUp", [("backup_dist", "float", True), ("backup_speed", "float", True)]),
    ("DriveOnHeading", [("dist_to_travel", "float", True), ("speed", "float", True), ("time_allowance", "float", True)]),
    ("ClearEntireCostmap", [("service_name", "string", True)]),
]
#: control tags with their attributes, and the types of those that are literals
CONTROL_ATTRS = {
    "Sequence": ("name",), "Fallback": (), "ReactiveSequence": (), "ReactiveFallback": ("name",), "RoundRobin": ("name",), "PipelineSequence": ("name",), "RateController": ("hz",),
    "DistanceController": ("distance",), "SpeedController": ("max_speed",), "KeepRunningUntilFailure": (), "Repeat": ("num_cycles",), "Inverter": (), "RecoveryNode": ("number_of_retries", "name"),
}
CONTROL = tuple(CONTROL_ATTRS)
CONTROL_TYPES = {"RateController": {"hz": "float"}, "DistanceController": {"distance": "float"}, "SpeedController": {"max_speed": "float"}, "Repeat": {"num_cycles": "int"}, "RecoveryNode": {"number_of_retries": "int"}}
STRUCTURE_ATTRS = {"root": ("main_tree_to_execute", "BTCPP_format"), "BehaviorTree": ("ID",), "SubTree": ("ID", "__shared_blackboard")}
#: which way a blackboard variable goes through a port; "in" where nothing is said
DIRECTIONS = {
    "ComputePathToPose": {"path": "out"}, "ComputePathThroughPoses": {"path": "out"}, "GoalUpdater": {"output_goal": "out"}, "TruncatePath": {"output_path": "out"},
    "RemovePassedGoals": {"output_goals": "inout"},
}
ALIASES = {
    "Wait": {"duration": "wait_duration", "seconds": "wait_duration", "sec": "wait_duration"},
    "Spin": {"angle": "spin_dist", "radians": "spin_dist", "rad": "spin_dist"},
    "BackUp": {"distance": "backup_dist", "dist": "backup_dist", "speed": "backup_speed"},
    "DriveOnHeading": {"distance": "dist_to_travel", "dist": "dist_to_travel", "speed_mps": "speed", "timeout": "time_allowance", "time": "time_allowance", "time_limit": "time_allowance"},
}


VARIABLE = r"\{([^{}]+)\}"


@dataclass(frozen=True)
class Reference:
    """What reference documents hold besides the catalog: attributes by tag, and blackboard variables."""

    attrs: dict[str, frozenset[str]] = field(default_factory=dict)
    variables: frozenset[str] = frozenset()


def reference_of(allowed: DataFrame) -> Reference:
    """The collected ``allowlist`` of reference documents (some hundreds of names)."""
    attrs: dict[str, set[str]] = {}
    variables = set()
    for r in allowed.collect():
        if r.kind == "tag":
            attrs.setdefault(r.name, set())
        elif r.kind == "attr":
            attrs.setdefault(r.of, set()).add(r.name)
        else:
            variables.add(r.name)
    return Reference({k: frozenset(v) for k, v in attrs.items()}, frozenset(variables))


ISSUE = "array<struct<level:string,code:string,detail:string,pre:int>>"


def _issue(level: str, code: str, detail: Column | None, pre: Column | None = None) -> Column:
    text = F.lit(None).cast("string") if detail is None else detail.cast("string")
    return F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), text.alias("detail"), (F.lit(None) if pre is None else pre).cast("int").alias("pre"))


def _each(names: Column, level: str, code: str) -> Column:
    return F.transform(names, lambda x: _issue(level, code, x)).cast(ISSUE)


def _when(condition: Column, *issue) -> Column:
    return F.when(condition, F.array(_issue(*issue)).cast(ISSUE)).otherwise(F.array().cast(ISSUE))


def _attr(n: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(n["attrs"], F.lit(name)), F.lit(""))


def checked(trees: DataFrame, strict_attrs: bool = True, strict_blackboard: bool = False, external: tuple[str, ...] = ("goal",), reference: Reference = Reference()) -> DataFrame:
    """The rows with ``issues`` (level, code, detail, pre): the eighteen rules as expressions over a tree's elements."""
    known = {t: frozenset(a) for t, a in {**CONTROL_ATTRS, **STRUCTURE_ATTRS}.items()} | {s: frozenset(p for p, _, _ in ps) | {"name"} for s, ps in SKILLS}
    for t, more in reference.attrs.items():
        known[t] = known.get(t, frozenset()) | more
    allowed = F.create_map(*[x for t, a in sorted(known.items()) for x in (F.lit(t), literal(sorted(a)))])
    required = F.create_map(*[x for s, ps in SKILLS for x in (F.lit(s), literal(sorted(p for p, _, r in ps if r)))])
    kinds = {s: {p: k for p, k, _ in ps} for s, ps in SKILLS} | CONTROL_TYPES
    types = F.create_map(*[x for t, ps in kinds.items() for x in (F.lit(t), F.create_map(*[y for p, k in ps.items() for y in (F.lit(p), F.lit(k))]))])
    ways = F.create_map(*[x for t, ps in DIRECTIONS.items() for x in (F.lit(t), F.create_map(*[y for p, d in ps.items() for y in (F.lit(p), F.lit(d))]))])
    nodes, root = F.col("nodes"), F.try_element_at("nodes", F.lit(1))
    ids = lambda which: F.transform(F.filter(nodes, which), lambda n: _attr(n, "ID"))
    used = F.flatten(F.transform(nodes, lambda n: F.flatten(F.transform(F.map_entries(n["attrs"]), lambda e: F.transform(
        F.regexp_extract_all(e["value"], F.lit(VARIABLE), 1), lambda v: F.struct(v.alias("name"), F.coalesce(F.try_element_at(F.try_element_at(ways, n["tag"]), e["key"]), F.lit("in")).alias("way"))
    )))))
    df = cycles(trees).withColumns({
        "__defs": F.filter(ids(lambda n: n["tag"] == "BehaviorTree"), lambda i: i != ""),
        "__refs": F.array_distinct(F.filter(ids(lambda n: n["tag"] == "SubTree"), lambda i: i != "")),
        "__main": _attr(root, "main_tree_to_execute"), "__used": used,
    })
    names = lambda way: F.transform(F.filter("__used", lambda u: u["way"].isin(way, "inout")), lambda u: u["name"])
    unproduced = F.array_sort(F.array_except(names("in"), F.concat(names("out"), literal(external))))
    novel = F.array_sort(F.array_except(F.transform("__used", lambda u: u["name"]), literal(sorted(reference.variables)))) if reference.variables else F.array().cast("array<string>")
    twice = F.array_sort(F.array_distinct(F.filter("__defs", lambda i: F.size(F.filter("__defs", lambda j: j == i)) > 1)))
    ok = lambda n: F.map_contains_key(allowed, n["tag"])
    strange = lambda n: F.array_sort(F.array_except(F.map_keys(n["attrs"]), F.try_element_at(allowed, n["tag"])))

    def mismatched(n: Column) -> Column:
        expected = F.try_element_at(types, n["tag"])

        def bad(e: Column) -> Column:
            kind, value = F.try_element_at(expected, e["key"]), e["value"]
            wrong = ((kind == "float") & ~value.rlike(FLOAT)) | ((kind == "int") & ~value.rlike(INT)) | ((kind == "bool") & ~F.lower(value).isin("true", "false", "0", "1"))
            return F.coalesce(wrong & ~value.rlike(r"(?s)^\{.*\}$"), F.lit(False))

        return F.transform(F.filter(F.map_entries(n["attrs"]), bad), lambda e: _issue("error", "attr_type_mismatch", F.concat_ws("=", e["key"], e["value"]), n["pre"])).cast(ISSUE)

    found = F.concat(
        _when(root["tag"] != "root", "error", "root_tag", root["tag"]),
        _when(F.col("__main") == "", "error", "root_main_tree", None),
        _when((F.col("__main") != "") & ~F.array_contains("__defs", F.col("__main")), "error", "missing_main_tree_def", F.col("__main")),
        F.transform(F.filter(nodes, lambda n: (n["tag"] == "BehaviorTree") & (_attr(n, "ID") == "")), lambda n: _issue("error", "bt_missing_id", None, n["pre"])).cast(ISSUE),
        _each(twice, "error", "bt_duplicate_id"),
        _each(F.array_except("__refs", "__defs"), "error", "subtree_missing_definition"),
        _each(F.col("cycles"), "error", "subtree_cycle"),
        _each(F.array_except("__defs", F.concat("__refs", F.array("__main"))), "warning", "bt_unused_definition"),
        F.transform(F.filter(nodes, lambda n: (n["tag"] == "BehaviorTree") & (n["n_children"] == 0)), lambda n: _issue("warning", "bt_empty", _attr(n, "ID"), n["pre"])).cast(ISSUE),
        F.transform(F.filter(nodes, lambda n: ~ok(n)), lambda n: _issue("error", "tag_not_allowed", n["tag"], n["pre"])).cast(ISSUE),
        F.flatten(F.transform(F.filter(nodes, ok), lambda n: F.concat(
            F.transform(F.filter(F.coalesce(F.try_element_at(required, n["tag"]), F.array().cast("array<string>")), lambda p: ~F.map_contains_key(n["attrs"], p)), lambda p: _issue("error", "missing_required_attr", F.concat_ws(".", n["tag"], p), n["pre"])).cast(ISSUE),
            F.when(F.size(strange(n)) > 0, F.array(_issue("error" if strict_attrs else "warning", "unknown_attr", F.array_join(strange(n), ","), n["pre"])).cast(ISSUE)).otherwise(F.array().cast(ISSUE)),
            mismatched(n),
        ))),
        F.transform(F.filter(nodes, lambda n: n["tag"].isin(*CONTROL) & (n["n_children"] == 0)), lambda n: _issue("error", "empty_control_node", n["tag"], n["pre"])).cast(ISSUE),
        F.transform(F.filter(nodes, lambda n: (n["tag"] == "Repeat") & ~F.map_contains_key(n["attrs"], "num_cycles")), lambda n: _issue("warning", "repeat_unbounded", None, n["pre"])).cast(ISSUE),
        _when(F.size(unproduced) > 0, "error" if strict_blackboard else "warning", "blackboard_unproduced", F.array_join(unproduced, ", ")),
        _when(F.size(novel) > 0, "warning", "blackboard_novel_vars", F.array_join(novel, ", ")),
    )
    whole = F.when(F.col("parse_error").isNotNull(), F.array(_issue("error", "xml_parse", F.col("parse_error"))).cast(ISSUE)).otherwise(found)
    return df.withColumn("issues", whole).select(*trees.columns, "issues")


def issues(trees: DataFrame, **options) -> DataFrame:
    """``tree_id, level, code, detail, pre`` of every finding; options as for ``checked``."""
    return unfolded(checked(trees, **options), F.col("issues"))


CODES = (
    "xml_parse", "root_tag", "root_main_tree", "missing_main_tree_def", "bt_missing_id", "bt_duplicate_id", "subtree_missing_definition", "subtree_cycle", "tag_not_allowed",
    "missing_required_attr", "unknown_attr", "attr_type_mismatch", "empty_control_node",
)


def checklist(trees: DataFrame, **options) -> DataFrame:
    """``tree_id, ok_<code>`` for the thirteen codes that are errors: whether the document has none of it."""
    errors = F.transform(F.filter("issues", lambda x: x["level"] == "error"), lambda x: x["code"])
    return checked(trees, **options).select("tree_id", *[(~F.array_contains(errors, c)).alias(f"ok_{c}") for c in CODES])


def cyclic(edges: dict[str, set[str]]) -> list[str]:
    """The smallest member of every strongly connected set of definitions with a cycle, by one walk."""
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    held: list[str] = []
    inside: set[str] = set()
    found = []
    for start in sorted(edges):
        work = [(start, iter(sorted(edges[start])))] if start not in number else []
        if work:
            number[start] = low[start] = len(number)
            held.append(start)
            inside.add(start)
        while work:
            at, rest = work[-1]
            for to in rest:
                if to not in edges:
                    continue
                if to not in number:
                    number[to] = low[to] = len(number)
                    held.append(to)
                    inside.add(to)
                    work.append((to, iter(sorted(edges[to]))))
                    break
                if to in inside:
                    low[at] = min(low[at], number[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[at])
                if low[at] == number[at]:
                    part = []
                    while True:
                        part.append(held.pop())
                        inside.discard(part[-1])
                        if part[-1] == at:
                            break
                    if len(part) > 1 or at in edges[at]:
                        found.append(min(part))
    return sorted(found)


def cycles(trees: DataFrame) -> DataFrame:
    """The rows with ``cycles``: of every cycle of SubTree references the smallest definition; linear in the references of a document."""
    nodes = F.col("nodes")
    defs = F.transform(F.filter(nodes, lambda n: n["tag"] == "BehaviorTree"), lambda n: F.struct(_attr(n, "ID").alias("id"), n["pre"].alias("lo"), n["post"].alias("hi")))
    refs = F.transform(F.filter(nodes, lambda n: n["tag"] == "SubTree"), lambda n: F.struct(_attr(n, "ID").alias("id"), n["pre"].alias("at")))

    def run(batches):
        for batch in batches:
            out = []
            for d, r in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()):
                edges: dict[str, set[str]] = {}
                for x in d or ():  # the last of several definitions with one ID is the one that counts
                    if x["id"]:
                        edges[x["id"]] = {y["id"] for y in r or () if x["lo"] <= y["at"] <= x["hi"] and y["id"]}
                out.append(cyclic(edges))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out, pa.list_(pa.string()))], names=[*names, "cycles"])

    names = trees.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in trees.schema)
    return trees.select(*names, defs.alias("__d"), refs.alias("__r")).mapInArrow(run, f"{schema}, cycles array<string>")
