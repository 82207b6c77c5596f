"""Documents from steps or nested JSON, degraded copies, prompts, grammars and seeded missions."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolita.operators import catalog as C
from arbolita.operators.navigation import ALIASES, SKILLS

STEPS = "array<struct<skill:string,params:map<string,string>>>"


#: what a step may name: its tag and parameters; the last two stand for a whole navigation
STEP_SKILLS = {s: (s, ps) for s, ps in SKILLS if s != "ClearEntireCostmap"} | {
    "ClearEntireCostmapLocal": ("ClearEntireCostmap", [("service_name", "string", True)]), "ClearEntireCostmapGlobal": ("ClearEntireCostmap", [("service_name", "string", True)]),
    "NavigateToPoseWithReplanningAndRecovery": ("SubTree", []), "NavigateToGoalWithReplanningAndRecovery": ("SubTree", []),
}
FAULTS = ("non_json", "skill_not_allowed", "missing_required_port", "other")


def _map(pairs: list[tuple[str, str]]) -> Column:
    """A literal map from texts to SQL."""
    return F.expr("map(" + ", ".join(f"'{k}', {v}" for k, v in pairs) + ")")


def parse_steps(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Adds ``steps`` (skill, params) and ``fault``: null, or that of the first bad step: non_json, skill_not_allowed, missing_required_port, other.

    Fences are stripped and parameter aliases get their proper name where that is absent. ``other``: not a list, an empty one, an
    element that is no object, parameters that are no object. Null is no JSON.
    """
    body = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.col(raw_col)), r"^```[A-Za-z]*\n", ""), r"\n?```$", ""))
    shape = F.schema_of_variant(F.try_parse_json(body))
    none = F.expr("cast(map() as map<string,string>)")
    table = _map([(s, "map(" + ", ".join(f"'{a}', '{b}'" for a, b in names.items()) + ")") for s, names in ALIASES.items()])
    required = _map([(s, "cast(array(" + ", ".join(f"'{p}'" for p, _, r in sorted(ps) if r) + ") as array<string>)") for s, (_, ps) in STEP_SKILLS.items()])

    def read(step: Column) -> Column:
        params = F.coalesce(F.from_json(step["params"], "map<string,string>"), none)
        alias = F.coalesce(F.try_element_at(table, step["skill"]), none)
        kept = F.map_filter(params, lambda k, _: ~F.map_contains_key(alias, k) | F.map_contains_key(params, F.try_element_at(alias, k)))
        moved = F.map_filter(params, lambda k, _: F.map_contains_key(alias, k) & ~F.map_contains_key(params, F.try_element_at(alias, k)))
        # of several aliases for one name the first counts
        entries = F.map_entries(moved)
        target = lambda e: F.try_element_at(alias, e["key"])
        once = F.filter(entries, lambda e: ~F.exists(entries, lambda o: (target(o) == target(e)) & (F.array_position(F.map_keys(moved), o["key"]) < F.array_position(F.map_keys(moved), e["key"]))))
        renamed = F.map_from_entries(F.transform(once, lambda e: F.struct(target(e), e["value"])))
        odd = step["params"].isNotNull() & ~F.startswith(F.ltrim(step["params"]), F.lit("{"))
        return F.struct(step["skill"].alias("skill"), F.map_concat(kept, renamed).alias("params"), odd.alias("odd"))

    df = df.withColumn("__shape", shape).withColumn("__raw", F.from_json(body, "array<struct<skill:string,params:string>>"))
    df = df.withColumn("__steps", F.transform(F.filter("__raw", lambda s: s.isNotNull()), read))
    allowed = lambda s: F.map_contains_key(required, F.coalesce(s["skill"], F.lit("")))
    lacks = lambda s: F.exists(F.try_element_at(required, s["skill"]), lambda p: ~F.map_contains_key(s["params"], p))
    bad = F.transform("__steps", lambda s: F.when(~allowed(s), "skill_not_allowed").when(s["odd"], "other").when(lacks(s), "missing_required_port"))
    fault = (
        F.when(F.col("__shape").isNull(), "non_json").when(~F.startswith("__shape", F.lit("ARRAY")), "other").when(F.col("__raw").isNull() | (F.size("__raw") == 0) | (F.size("__steps") < F.size("__raw")), "other")
        .otherwise(F.try_element_at(F.array_compact(bad), F.lit(1)))
    )
    steps = F.transform("__steps", lambda s: F.struct(s["skill"].alias("skill"), s["params"].alias("params")))
    return df.withColumn("steps", F.when(F.col("__shape").isNotNull(), steps)).withColumn("fault", fault).drop("__shape", "__raw", "__steps")


def fault_counters(parsed: DataFrame) -> DataFrame:
    """One row: documents, those without fault, and the four counters; a bad skill or a missing port counts as ``other`` too."""
    n = lambda *names: F.count_if(F.col("fault").isin(*names))
    return parsed.agg(
        F.count("*").alias("n"), F.count_if(F.col("fault").isNull()).alias("ok"), n("non_json").alias("non_json"), n("skill_not_allowed").alias("skill_not_allowed"), n("missing_required_port").alias("missing_required_port"),
        n("skill_not_allowed", "missing_required_port", "other").alias("other"),
    )


def steps_to_xml(steps: Column) -> Column:
    """One sequence of the steps, attributes in order of their names; a navigation becomes a SubTree whose definition is put behind, once."""
    tags = _map([(s, f"'{t}'") for s, (t, _) in STEP_SKILLS.items()])

    def attrs(m: Column) -> Column:
        sorted_ = F.array_sort(F.map_entries(m))
        clean = lambda v: F.replace(F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))
        return F.array_join(F.transform(sorted_, lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), clean(e["value"]), F.lit('"'))), "")

    whole = lambda s: F.try_element_at(tags, s["skill"]) == "SubTree"
    one = lambda s: F.when(whole(s), F.concat(F.lit('<SubTree ID="'), s["skill"], F.lit('" __shared_blackboard="true"/>'))).otherwise(
        F.concat(F.lit("<"), F.coalesce(F.try_element_at(tags, s["skill"]), s["skill"]), attrs(s["params"]), F.lit("/>"))
    )
    body = F.array_join(F.transform(steps, one), "")
    used = F.array_distinct(F.transform(F.filter(steps, whole), lambda s: s["skill"]))
    defs = F.array_join(F.transform(used, lambda n: F.concat(F.lit('<BehaviorTree ID="'), n, F.lit('"><PipelineSequence name="NavigateWithReplanning"><RateController hz="1.0"><AlwaysSuccess/></RateController></PipelineSequence></BehaviorTree>'))), "")
    return F.concat(F.lit('<root main_tree_to_execute="MainTree"><BehaviorTree ID="MainTree"><Sequence>'), body, F.lit("</Sequence></BehaviorTree>"), defs, F.lit("</root>"))


def json_to_xml(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``id, xml`` from nested JSON nodes (kind, name, attrs, children); null where the JSON isn't such a tree."""

    def build(node: dict) -> ET.Element:
        el = ET.Element(node["kind"], {str(k): str(v) for k, v in (node.get("attrs") or {}).items()})
        el.extend(build(c) for c in node.get("children") or [])
        return el

    def one(text: str | None) -> str | None:
        try:
            return ET.tostring(build(json.loads(text)), encoding="unicode")
        except (TypeError, KeyError, ValueError, AttributeError):
            return None

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(t) for t in batch.column(1).to_pylist()], pa.string())], names=["id", "xml"])

    return df.select(F.col(id_col).cast("string").alias("id"), F.col(json_col).alias("json")).mapInArrow(run, "id string, xml string")


def boundary(tokens: Column, template: Column) -> Column:
    """0-based end of the last occurrence of ``template`` in ``tokens``; null where there is none."""
    n = F.size(template)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.slice(tokens, i, n) == template)
    return F.array_max(starts) + n - 1


def grammar() -> str:
    """A context-free grammar of valid documents, from the catalog."""
    leaves = [f'"<{tag} ID=\\"{skill}\\"" attrs "/>"' for _, skill, tag, _ in C.SKILLS]
    control = [f'"<{t}>" node+ "</{t}>"' for t in C.VALID_TAGS[5:]]
    return "\n".join([
        'root ::= "<root BTCPP_format=\\"4\\">" tree+ "</root>"', 'tree ::= "<BehaviorTree ID=\\"" name "\\">" node "</BehaviorTree>"', "node ::= leaf | control",
        "leaf ::= " + " | ".join(leaves), "control ::= " + " | ".join(control), 'attrs ::= (" " name "=\\"" [^\\"<]* "\\"")*', "name ::= [A-Za-z_] [A-Za-z0-9_]*",
    ])


def missions(spark: SparkSession, n: int, seed: int, archetypes: list[tuple[str, int, str]]) -> DataFrame:
    """``id, category, mission``: n rows, each archetype (name, weight, template with {k}) by a seeded hash in proportion to its weight."""
    total, at, rows = sum(w for _, w, _ in archetypes), 0, []
    for name, weight, template in archetypes:
        rows.append((name, template, at, at + weight))
        at += weight
    dim = F.broadcast(spark.createDataFrame(rows, "category string, template string, lo int, hi int"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id"), F.lit(seed))), 1, 8), 16, 10).cast("long")
    base = spark.range(n).withColumn("h", h)
    place = F.pmod("h", F.lit(total))
    km = F.format_string("%d.%03d", F.pmod(F.floor(F.col("h") / 1000), F.lit(120)), F.pmod("h", F.lit(1000)))
    return base.join(dim, (place >= F.col("lo")) & (place < F.col("hi"))).select(F.format_string("m_%06d", "id").alias("id"), "category", F.replace("template", F.lit("{k}"), km).alias("mission"))


def regex_of_leaves() -> str:
    """A pattern that exactly the leaves of the catalog match, for pattern-constrained decoding."""
    leaf = lambda s, tag, ports: f'<{tag} ID="{s}"' + "".join(rf'(?: {p}="[^"<]*")?' for p, *_ in ports) + "/>"
    return "(?:" + "|".join(leaf(s, tag, ports) for _, s, tag, ports in C.SKILLS) + ")"


def json_schema() -> dict:
    """A JSON schema of lists of steps: each skill with its parameters, the required ones required."""
    kind = {"float": "number", "int": "integer", "bool": "boolean"}
    step = lambda s, ps: {
        "type": "object", "required": ["skill", "params"], "additionalProperties": False,
        "properties": {"skill": {"const": s}, "comment": {"type": "string"}, "params": {
            "type": "object", "additionalProperties": False, "required": [p for p, _, r in ps if r], "properties": {p: {"type": kind.get(k, "string")} for p, k, _ in ps}}},
    }
    return {"type": "array", "minItems": 1, "items": {"anyOf": [step(s, ps) for s, (_, ps) in STEP_SKILLS.items()]}}


#: name, weight, step types (null: no tree can be made, a note is written), templates
ARCHETYPES: list[tuple[str, int, list[int] | None, list[str]]] = [
    ("transport", 22, [0, 1, 2], ["Go from {a} to {b}.", "Take the machine to {b}, starting at {a}."]), ("transport_pass", 12, [0, 3], ["Pass {a} without stopping and go on to {b}."]),
    ("transport_no_wait", 10, [0, 4], ["Reach {b} and stop without waiting for an order."]), ("inspection", 16, [10, 11, 12], ["Inspect the track between {a} and {b} and check the measurements."]),
    ("inspection_pass", 12, [10, 13], ["Measure while passing from {a} to {b}, then validate."]), ("inspection_no_wait", 10, [10, 14], ["Inspect up to {b} and go on without waiting."]),
    ("simulation", 6, [0], ["Simulate the way from {a} to {b}."]), ("correction", 6, [0, 2, 12], ["Correct the defect found at {a}."]), ("unsupported", 6, None, ["Repaint the signal at {a}.", "Order spare parts for {b}."]),
]


def _hash(purpose: str, seed: int) -> Column:
    """A number from 0 to 2^32 - 1 by id, seed and purpose, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id"), F.lit(seed), F.lit(purpose))), 1, 8), 16, 10).cast("long")


def point(purpose: str, seed: int) -> Column:
    """A kilometre point with three decimals."""
    h = _hash(purpose, seed)
    return F.format_string("PK %d+%03d", F.floor(F.pmod(h, F.lit(120_000)) / 1000), F.pmod(h, F.lit(1000)))


def generated(spark: SparkSession, n: int, seed: int, archetypes=ARCHETYPES) -> DataFrame:
    """``id, category, mission, step_types, supported`` of n rows by archetype weights; those without step types are notes (``supported`` false)."""
    total, at, rows = sum(a[1] for a in archetypes), 0, []
    for name, weight, steps, templates in archetypes:
        rows.append((name, steps, templates, at, at + weight))
        at += weight
    dim = F.broadcast(spark.createDataFrame(rows, "category string, step_types array<int>, templates array<string>, lo int, hi int"))
    base = spark.range(n).withColumn("h", F.pmod(_hash("archetype", seed), F.lit(total)))
    d = base.join(dim, (F.col("h") >= F.col("lo")) & (F.col("h") < F.col("hi")))
    template = F.element_at("templates", (F.pmod(_hash("template", seed), F.size("templates")) + 1).cast("int"))
    mission = F.replace(F.replace(template, F.lit("{a}"), point("a", seed)), F.lit("{b}"), point("b", seed))
    return d.select(F.format_string("m_%06d", "id").alias("id"), "category", mission.alias("mission"), "step_types", F.col("step_types").isNotNull().alias("supported"))


def routed(missions_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The missions for which a tree can be made, and ``id, mission, category, note`` of the others."""
    note = F.lit("no skill of the catalog does this").alias("note")
    return missions_.where("supported"), missions_.where("not supported").select("id", "mission", "category", note)


def exact_counts(spark: SparkSession, counts: dict[str, int], seed: int, archetypes=ARCHETYPES, most: int | None = None) -> DataFrame:
    """``id, category, mission``: exactly so many missions of each category, shuffled by a seeded hash and cut to ``most``."""
    dim = spark.createDataFrame([(c, n, next(a[3] for a in archetypes if a[0] == c)) for c, n in counts.items() if n > 0], "category string, n int, templates array<string>")
    each = dim.select("category", "templates", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")).withColumn("id", F.concat_ws("-", "category", "k"))
    template = F.element_at("templates", (F.pmod(_hash("template", seed), F.size("templates")) + 1).cast("int"))
    mission = F.replace(F.replace(template, F.lit("{a}"), point("a", seed)), F.lit("{b}"), point("b", seed))
    rows = each.select("id", "category", mission.alias("mission")).orderBy(F.md5(F.concat_ws(":", "id", F.lit(seed))), "id")
    return rows if most is None else rows.limit(most)


def accepted(candidates: DataFrame, ok: Column, n: int, order: str = "id", most: int = 50) -> DataFrame:
    """Rejection sampling: the first n candidates, in order, that are ok; only the first n x ``most`` are looked at. Fewer where fewer are ok."""
    return candidates.orderBy(order).limit(n * most).where(ok).orderBy(order).limit(n)


def distinct_missions(candidates: DataFrame, n: int) -> DataFrame:
    """n candidates of different texts, the first of equal ones, in order of id."""
    row = F.struct(*candidates.columns)
    return candidates.groupBy("mission").agg(F.min_by(row, "id").alias("__r")).select("__r.*").orderBy("id").limit(n)


#: categories of step lists of the second dialect, as (skill, parameters with their least and greatest value)
STEP_PATTERNS = {
    "local_actions": [("Wait", {"wait_duration": (1, 20)}), ("Spin", {"spin_dist": (0, 6)}), ("BackUp", {"backup_dist": (0, 2), "backup_speed": (0, 1)})],
    "navigation": [("NavigateToPoseWithReplanningAndRecovery", {}), ("Wait", {"wait_duration": (1, 5)})],
    "recovery": [("ClearEntireCostmapLocal", {"service_name": None}), ("DriveOnHeading", {"dist_to_travel": (0, 4), "speed": (0, 1), "time_allowance": (5, 30)}), ("Spin", {"spin_dist": (0, 6)})],
}


def generated_steps(spark: SparkSession, n: int, seed: int, category: str) -> DataFrame:
    """``id, category, mission, steps_json``: n step lists of a category, values of three decimals by a seeded hash."""

    def value(purpose: str, span) -> Column:
        if span is None:
            return F.lit('"local_costmap/clear_entirely_local_costmap"')
        lo, hi = span
        return F.format_string("%.3f", F.lit(float(lo)) + F.pmod(_hash(purpose, seed), F.lit(1000 * (hi - lo) + 1)) / 1000)

    def step(k: int, skill: str, params: dict) -> Column:
        inner = [F.concat(F.lit(f'"{p}": '), value(f"{k}{p}", span)) for p, span in params.items()]
        return F.concat(F.lit(f'{{"skill": "{skill}", "params": {{'), F.array_join(F.array(*inner), ", ") if inner else F.lit(""), F.lit("}}"))

    steps = [step(k, s, p) for k, (s, p) in enumerate(STEP_PATTERNS[category])]
    text = F.concat(F.lit("Do: " + ", ".join(s for s, _ in STEP_PATTERNS[category]) + " as number "), F.col("id").cast("string"))
    return spark.range(n).select(F.format_string(f"{category}_%05d", "id").alias("id"), F.lit(category).alias("category"), text.alias("mission"), F.concat(F.lit("["), F.array_join(F.array(*steps), ", "), F.lit("]")).alias("steps_json"))
