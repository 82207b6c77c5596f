"""Structural and content metrics of trees, as expressions over their elements: one row per document, no shuffle."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolita.operators import catalog as C
from arbolita.operators import navigation as N
from arbolita.operators.nodes import CONTROL
from arbolita.operators.validate import _in, literal, ports_map

LEAVES = ("Action", "Condition")
#: what the inventory counts as control, which is more than the validator accepts
INVENTORY_CONTROL = (
    "Sequence", "ReactiveSequence", "SequenceStar", "Fallback", "ReactiveFallback", "FallbackStar", "Parallel", "ParallelAll", "Repeat", "RetryUntilSuccessful", "Inverter", "ForceSuccess",
    "ForceFailure", "Switch", "WhileDoElse",
)
LOOPS = ("Repeat", "RetryUntilSuccessful")


def _count(which) -> Column:
    return F.size(F.filter("nodes", which))


def _tag(*tags: str):
    return lambda n: n["tag"].isin(*tags)


def _mean(numbers: Column) -> Column:
    """Mean of an array of whole numbers, 0 where there is none."""
    return F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(numbers)).otherwise(F.lit(0.0))


def _capital(n: Column) -> Column:
    return n["tag"].rlike("^[A-Z]")


def structure(trees: DataFrame) -> DataFrame:
    """Depth (root 0), counts by tag, skills by the capital-letter rule and mean branching of control elements, childless ones too; all 0 where it doesn't parse."""
    children = F.transform(F.filter("nodes", _tag(*CONTROL)), lambda n: n["n_children"].cast("long"))
    return trees.select(
        "tree_id", depth().alias("max_depth"), F.size("nodes").alias("total_nodes"),
        *[_count(_tag(t)).alias(c) for c, t in (("n_behavior_trees", "BehaviorTree"), ("n_subtreeplus", "SubTreePlus"), ("n_sequence", "Sequence"), ("n_fallback", "Fallback"), ("n_reactive_fallback", "ReactiveFallback"), ("n_repeat", "Repeat"))],
        skill_count().alias("n_skills"), F.round(_mean(children), 2).alias("mean_branching_factor"),
    )


def skill_count() -> Column:
    """Skills by the capital-letter rule."""
    return _count(lambda n: _in(n["tag"], LEAVES) | (_capital(n) & ~_in(n["tag"], (*CONTROL, "BehaviorTree", "SubTreePlus"))))


def depth() -> Column:
    """The greatest depth, the root having 0; 0 without elements."""
    return F.coalesce(F.array_max(F.transform("nodes", lambda n: n["depth"])), F.lit(0))


def _leaf_like(n: Column) -> Column:
    return _in(n["tag"], LEAVES) | (_capital(n) & ~_in(n["tag"], (*LEAVES, *CONTROL, "BehaviorTree", "SubTreePlus")))


def unknown_skills(catalog: C.Catalog = C.DEFAULT) -> Column:
    """Names of skills that the catalog doesn't know, as often as they occur."""
    stray = lambda n: _leaf_like(n) & (F.coalesce(n["skill_id"], F.lit("")) != "") & ~_in(n["skill_id"], catalog.names())
    return F.transform(F.filter("nodes", stray), lambda n: n["skill_id"])


def completeness(catalog: C.Catalog = C.DEFAULT) -> Column:
    """Share of the required ports that are there; 1 where none is required, 0 where the document doesn't parse."""
    table = ports_map(catalog)
    required = lambda n: F.filter(F.try_element_at(table, n["skill_id"]), lambda p: p["required"])
    there = lambda n: F.size(F.filter(required(n), lambda p: F.map_contains_key(n["attrs"], p["port"])))
    share = F.aggregate(
        F.filter("nodes", lambda n: _in(n["skill_id"], catalog.names())), F.struct(F.lit(0).alias("have"), F.lit(0).alias("want")),
        lambda a, n: F.struct((a["have"] + there(n)).alias("have"), (a["want"] + F.size(required(n))).alias("want")), lambda a: F.when(a["want"] == 0, 1.0).otherwise(a["have"] / a["want"]),
    )
    return F.when(F.col("parse_error").isNotNull(), 0.0).otherwise(share)


def hallucination(trees: DataFrame, catalog: C.Catalog = C.DEFAULT) -> DataFrame:
    """Skills that the catalog doesn't know: their names, occurrences, and how many skills there are in all."""
    df = trees.withColumn("__unknown", unknown_skills(catalog))
    return df.select("tree_id", F.array_join(F.array_sort(F.array_distinct("__unknown")), ",").alias("hallucinated_skills"), F.size("__unknown").alias("hallucination_count"), _count(_leaf_like).alias("total_skills"))


def port_completeness(trees: DataFrame, catalog: C.Catalog = C.DEFAULT) -> DataFrame:
    return trees.select("tree_id", completeness(catalog).alias("port_completeness"))


def navigation_structure(trees: DataFrame) -> DataFrame:
    """The second dialect's counts: depth (root 1), elements, SubTree references, control (with SubTree) and atomic elements."""
    outer = ("root", "BehaviorTree", "SubTree", *N.CONTROL)
    return trees.select(
        "tree_id", F.coalesce(F.array_max(F.transform("nodes", lambda n: n["depth"])) + 1, F.lit(0)).alias("bt_depth"), F.size("nodes").alias("node_count"), _count(_tag("SubTree")).alias("subtree_count"),
        _count(_tag("SubTree", *N.CONTROL)).alias("control_node_count"), _count(lambda n: ~n["tag"].isin(*outer)).alias("atomic_node_count"),
    )


def browser(trees: DataFrame, xml: str = "xml") -> DataFrame:
    """Elements, BehaviorTrees below the root, leaves, and characters of the text; the characters are told even where it doesn't parse."""
    below = lambda n: (n["parent"] == 0) & (n["tag"] == "BehaviorTree")
    return trees.select("tree_id", F.size("nodes").alias("nodes"), _count(below).alias("subtrees"), _count(lambda n: n["n_children"] == 0).alias("leaf_nodes"), F.length(F.coalesce(xml, F.lit(""))).alias("xml_size"))


def inventory(trees: DataFrame) -> DataFrame:
    """The facts of a document: 18 that its elements tell (a file's path, size, relative path and parse state come from the source).

    Branching is the mean over control elements with children; ``ports_seen`` is skill=port,port;... in order.
    """
    root = F.try_element_at("nodes", F.lit(1))
    # elements of the BehaviorTrees below the root (of the whole document where the root is another element)
    tops = F.when(root["tag"] == "root", F.filter("nodes", lambda n: (n["parent"] == 0) & (n["tag"] == "BehaviorTree"))).otherwise(F.slice("nodes", 1, 1))
    df = trees.withColumn("__tops", F.coalesce(tops, F.array().cast(dict(trees.dtypes)["nodes"])))
    df = df.withColumn("__in", F.filter("nodes", lambda n: F.exists("__tops", lambda t: (n["pre"] >= t["pre"]) & (n["pre"] <= t["post"]))))
    inside = F.col("__in")
    of = lambda which: F.filter(inside, which)
    leaf = lambda n: _in(n["tag"], LEAVES)
    named = of(lambda n: leaf(n) & (F.coalesce(n["skill_id"], F.lit("")) != ""))
    skills = F.transform(named, lambda n: n["skill_id"])
    ports = lambda n: F.filter(F.map_keys(n["attrs"]), lambda k: ~k.isin("ID", "name"))
    refs = of(_tag("SubTree", "SubTreePlus"))
    attr = lambda n, k: F.coalesce(F.try_element_at(n["attrs"], F.lit(k)), F.lit(""))
    values = F.flatten(F.transform(named, lambda n: F.transform(ports(n), lambda k: F.try_element_at(n["attrs"], k))))
    variables = F.transform(F.filter(values, lambda v: F.startswith(v, F.lit("{")) & F.endswith(v, F.lit("}"))), lambda v: v.substr(F.lit(2), F.length(v) - 2))
    names = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    counted = lambda x: F.array_join(F.transform(F.array_sort(F.array_distinct(x)), lambda s: F.concat_ws(":", s, F.size(F.filter(x, lambda y: y == s)).cast("string"))), ",")
    seen = F.transform(F.array_sort(F.array_distinct(skills)), lambda s: F.concat(s, F.lit("="), names(F.flatten(F.transform(F.filter(named, lambda n: n["skill_id"] == s), ports)))))
    deepest = F.array_max(F.flatten(F.transform("__tops", lambda t: F.transform(F.filter("nodes", lambda n: (n["pre"] >= t["pre"]) & (n["pre"] <= t["post"])), lambda n: n["depth"] - t["depth"]))))
    controls = F.transform(of(_tag(*INVENTORY_CONTROL)), lambda n: n["tag"])
    return df.select(
        "tree_id", F.col("parse_error").isNull().alias("parse_ok"), "parse_error", F.when(root["tag"] == "root", F.try_element_at(root["attrs"], F.lit("main_tree_to_execute"))).alias("root_main_tree"),
        F.array_join(F.filter(F.transform("__tops", lambda t: attr(t, "ID")), lambda i: i != ""), ",").alias("declared_subtrees"), names(F.filter(F.transform(refs, lambda n: attr(n, "ID")), lambda i: i != "")).alias("referenced_subtrees"),
        names(skills).alias("skill_ids"), counted(skills).alias("skill_id_counts"), counted(controls).alias("control_node_counts"),
        F.size(of(_tag("Action"))).alias("n_actions"), F.size(of(_tag("Condition"))).alias("n_conditions"), F.size(of(_tag("SubTree"))).alias("n_subtrees"), F.size(of(_tag("SubTreePlus"))).alias("n_subtree_plus"),
        F.coalesce(deepest, F.lit(0)).alias("max_depth"), F.round(_mean(F.transform(of(lambda n: n["tag"].isin(*INVENTORY_CONTROL) & (n["n_children"] > 0)), lambda n: n["n_children"].cast("long"))), 2).alias("mean_branching"),
        F.exists(refs, lambda n: F.lower(attr(n, "__autoremap")) == "true").alias("has_autoremap"), F.exists(inside, _tag(*LOOPS)).alias("has_repeat_loop"), F.size("__tops").alias("n_top_level_trees"),
        F.array_join(seen, ";").alias("ports_seen"), names(variables).alias("blackboard_refs"),
    )


def inventory_summary(entries: DataFrame, catalog: C.Catalog = C.DEFAULT) -> DataFrame:
    """One row over all documents: parsed and failed, flags, depths, mean of the documents' branching, use of the catalog."""
    ok = F.col("parse_ok")
    only = lambda c: F.when(ok, F.col(c))
    per = entries.withColumn("__skills", F.when(ok & (F.col("skill_ids") != ""), F.split("skill_ids", ",")))
    used = F.flatten(F.collect_set("__skills"))  # sets of skills that differ, not documents
    facts = per.agg(
        F.count("*").alias("n_files_total"), F.count_if(ok).alias("n_files_parsed"), F.count_if(~ok).alias("n_files_failed"), F.count_if(ok & F.col("has_autoremap")).alias("n_files_with_autoremap"),
        F.count_if(ok & F.col("has_repeat_loop")).alias("n_files_with_repeat_loop"), F.coalesce(F.min(only("max_depth")), F.lit(0)).alias("depth_min"), F.coalesce(F.max(only("max_depth")), F.lit(0)).alias("depth_max"),
        F.coalesce(F.round(F.avg(only("max_depth")), 2), F.lit(0.0)).alias("depth_mean"), F.coalesce(F.round(F.avg(only("mean_branching")), 2), F.lit(0.0)).alias("branching_mean"), F.array_distinct(used).alias("__used"),
    )
    known = literal(catalog.names())
    return facts.select(
        *[c for c in facts.columns if c != "__used"], F.size("__used").alias("n_unique_skills"), F.array_join(F.array_sort(F.array_except(known, "__used")), ",").alias("skills_in_catalog_unused"),
        F.array_join(F.array_sort(F.array_except("__used", known)), ",").alias("skills_not_in_catalog"), F.round(100 * F.size(F.array_intersect("__used", known)) / max(1, len(catalog.skills)), 1).alias("catalog_coverage_pct"),
    )


FLAGS = {
    "inspect": "ManageMeasurements", "analysed": "AnalyseMeasurements", "quality_check": "MeasurementsQualityValidated", "corrective": "GenerateCorrectiveSubSequence", "signal": "SignalAndWaitForOrder",
    "decel": "Deccelerate", "pause": "Pause", "enforced": "MeasurementsEnforcedValidated",
}


def features(docs: DataFrame, id_col: str = "tree_id", xml_col: str = "xml") -> DataFrame:
    """What patterns over the text tell without parsing it: definitions, motion types, skills, eight flags, length."""
    x = F.coalesce(F.col(xml_col), F.lit(""))
    found = lambda pattern: F.regexp_extract_all(x, F.lit(pattern), 1)
    ids = found('<BehaviorTree ID="([^"]+)"')
    return docs.select(
        F.col(id_col).cast("string").alias("tree_id"), F.array_join(ids, ",").alias("subtrees"), F.size(ids).alias("n_subtrees"), F.array_join(found(r'type_to_be_checked="(\d+)"'), ",").alias("motion_types"),
        F.array_join(F.array_sort(F.array_distinct(found('ID="([A-Z][a-zA-Z]+)"'))), ",").alias("skills"), *[F.contains(x, F.lit(w)).alias(c) for c, w in FLAGS.items()], F.length(x).alias("xml_len"),
    )


def patterns(docs: DataFrame, named: dict[str, str], xml_col: str = "xml") -> DataFrame:
    """One row: whether each of the named strings occurs in any document."""
    return docs.agg(*[F.coalesce(F.bool_or(F.contains(xml_col, F.lit(w))), F.lit(False)).alias(c) for c, w in named.items()])


def xpaths(trees: DataFrame) -> DataFrame:
    """``tree_id, pre, xpath``: every step with its number among the siblings of that tag, the root without."""

    def run(batches):
        for batch in batches:
            tree, at, path = [], [], []
            for k, nodes in enumerate(batch.column(1).to_pylist()):
                made: list[str] = []
                seen: list[dict[str, int]] = []
                for n in nodes or ():
                    if n["parent"] is None:
                        made.append("/" + n["tag"])
                    else:
                        count = seen[n["parent"]]
                        count[n["tag"]] = count.get(n["tag"], 0) + 1
                        made.append(f"{made[n['parent']]}/{n['tag']}[{count[n['tag']]}]")
                    seen.append({})
                tree += [k] * len(made)
                at += range(len(made))
                path += made
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(tree, pa.int64())), pa.array(at, pa.int32()), pa.array(path, pa.string())], names=["tree_id", "pre", "xpath"])

    slim = F.transform("nodes", lambda n: F.struct(n["tag"].alias("tag"), n["parent"].alias("parent")))
    return trees.select("tree_id", slim.alias("nodes")).mapInArrow(run, "tree_id string, pre int, xpath string")


def definitions(trees: DataFrame) -> DataFrame:
    """``tree_id, id, pre, referenced``: BehaviorTrees with an ID, the last of equal ones, and whether a SubTree refers to it."""
    ids = lambda tag: F.filter("nodes", lambda n: (n["tag"] == tag) & (F.coalesce(F.try_element_at(n["attrs"], F.lit("ID")), F.lit("")) != ""))
    name = lambda n: F.element_at(n["attrs"], "ID")
    df = trees.select("tree_id", F.transform(ids("BehaviorTree"), lambda n: F.struct(name(n).alias("id"), n["pre"].alias("pre"))).alias("d"), F.transform(ids("SubTree"), name).alias("r"))
    last = F.filter("d", lambda x: ~F.exists("d", lambda y: (y["id"] == x["id"]) & (y["pre"] > x["pre"])))
    return df.select("tree_id", F.explode(last).alias("x"), "r").select("tree_id", "x.id", "x.pre", F.array_contains("r", F.col("x.id")).alias("referenced"))
