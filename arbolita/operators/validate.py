"""Five levels of rules over trees, and the fold of their issues to a verdict and a score.

The issues of a tree are an array of (level, severity, code, detail, step, pre, sub), made by expressions over its elements
without a shuffle; (level, step, pre, sub) is the order in which they are found. An error of level 1 or 2 ends the checks at its
level and sets the score to 0; a warning takes 0.1 but leaves 0.5, so that a warning found after the depth error lifts 0 to 0.5.

Level 1, the first that fails: parse, root tag, tags, skills, a stop. Level 2: a BehaviorTree below the root, empty control
elements, depth, number of skills, thin fallbacks. Level 3: prerequisites (unless there are several BehaviorTrees), LoadMission,
loop conditions in a fallback. Level 4: ports (missing, unknown, type, domain), SubTreePlus, Repeat. Level 5: a consumer of motion
parameters behind a producer in its Sequence, and the loop pattern of the execution tree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolita.operators import catalog as C

INT = r"^\s*[+-]?\d+(_\d+)*\s*$"
FLOAT = r"^\s*[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:nan|inf|infinity)\s*$"
META = ("ID", "name")
FALLBACKS = ("Fallback", "ReactiveFallback")
ISSUE = "array<struct<level:int,severity:string,code:string,detail:string,step:int,pre:int,sub:int>>"


def _text(value: str | None) -> str:
    return "null" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal(values) -> Column:
    """An array of strings as one parsed expression; built value by value it would be a call into the JVM for each."""
    return F.expr(f"cast(array({', '.join(map(_text, values))}) as array<string>)")


def _in(x: Column, values) -> Column:
    """Membership that is false, not null, for null. Of more than ten values Spark makes a hash set; scanned as an array they'd be compared one by one for each element."""
    return F.coalesce(x.isin(*values) if values else F.lit(False), F.lit(False))


def _issue(level: int, severity: str, code: str, detail: Column | None, step: int, pre: Column | int = 0, sub: Column | int = 0) -> Column:
    number = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
    text = F.lit(None).cast("string") if detail is None else detail.cast("string")
    return F.struct(
        F.lit(level).alias("level"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), text.alias("detail"), F.lit(step).alias("step"), number(pre).alias("pre"), number(sub).alias("sub")
    )


def _none() -> Column:
    return F.array().cast(ISSUE)


def _once(condition: Column, *issue) -> Column:
    return F.when(condition, F.array(_issue(*issue)).cast(ISSUE)).otherwise(_none())


def _each(nodes: Column, which: Callable[[Column], Column], level: int, code: str, detail: Callable[[Column], Column], step: int) -> Column:
    return F.transform(F.filter(nodes, which), lambda n: _issue(level, "warning", code, detail(n), step, n["pre"])).cast(ISSUE)


def ports_map(catalog: C.Catalog) -> Column:
    """skill -> its ports, as a literal."""
    allowed = lambda p: f"array({', '.join(map(_text, p.allowed))})" if p.allowed else "cast(null as array<string>)"
    port = lambda p: f"named_struct('port', {_text(p.name)}, 'kind', {_text(p.kind)}, 'required', {str(p.required).lower()}, 'default', cast({_text(p.default)} as string), 'allowed', {allowed(p)})"
    kind = "array<struct<port:string,kind:string,required:boolean,default:string,allowed:array<string>>>"
    return F.expr("map(" + ", ".join(f"{_text(s.name)}, cast(array({', '.join(map(port, s.ports))}) as {kind})" for s in catalog.skills) + ")")


def bad_literal(kind: Column, value: Column) -> Column:
    return (
        ((kind == "bb_var") & ~(F.startswith(value, F.lit("{")) & F.endswith(value, F.lit("}"))))
        | ((kind == "int_literal") & ~value.rlike(INT))
        | ((kind == "float_literal") & ~value.rlike(FLOAT))
    )


def _ports(nodes: Column, catalog: C.Catalog) -> Column:
    """Level 4 of every element that is a skill of the catalog."""
    table = ports_map(catalog)

    def of(n: Column) -> Column:
        spec, attrs = n["spec"], n["attrs"]
        given = F.filter(F.map_keys(attrs), lambda k: ~_in(k, META))
        missing = F.filter(F.transform(spec, lambda p, i: F.when(p["required"] & ~F.map_contains_key(attrs, p["port"]), _issue(4, "warning", "missing_port", p["port"], 0, n["pre"], i))), lambda x: x.isNotNull())
        unknown = F.filter(F.transform(given, lambda k, i: F.when(~F.exists(spec, lambda p: p["port"] == k), _issue(4, "warning", "unknown_port", k, 0, n["pre"], i + 1000))), lambda x: x.isNotNull())
        value = lambda p: F.try_element_at(attrs, p["port"])
        told = lambda p: F.concat_ws("=", p["port"], value(p))
        wrong = F.transform(spec, lambda p, i: F.when(bad_literal(p["kind"], value(p)), _issue(4, "warning", "port_type", told(p), 0, n["pre"], 2 * i + 2000)))
        outside = F.transform(spec, lambda p, i: F.when(p["allowed"].isNotNull() & ~F.array_contains(p["allowed"], value(p)), _issue(4, "warning", "port_domain", told(p), 0, n["pre"], 2 * i + 2001)))
        return F.concat(missing, unknown, F.filter(F.concat(wrong, outside), lambda x: x.isNotNull())).cast(ISSUE)

    # a skill's ports are looked up once an element; elements without ports and without attributes beside the ID have no findings
    looked_up = lambda n: F.struct(n["pre"].alias("pre"), n["attrs"].alias("attrs"), F.try_element_at(table, n["skill_id"]).alias("spec"))
    known = F.transform(F.filter(nodes, lambda n: _in(n["skill_id"], catalog.names())), looked_up)
    return F.flatten(F.transform(F.filter(known, lambda n: (F.size(n["spec"]) > 0) | (F.size(n["attrs"]) > 1) | ~F.map_contains_key(n["attrs"], "ID")), of))


def _subtrees(nodes: Column) -> Column:
    attr = lambda n, k: F.try_element_at(n["attrs"], F.lit(k))
    return F.flatten(F.transform(F.filter(nodes, lambda n: n["tag"] == "SubTreePlus"), lambda n: F.concat(
        _once(F.coalesce(attr(n, "ID"), F.lit("")) == "", 4, "warning", "subtree_id", None, 1, n["pre"], 0),
        _once(~F.map_contains_key(n["attrs"], "__autoremap"), 4, "warning", "subtree_autoremap", attr(n, "ID"), 1, n["pre"], 1),
    )))


def _repeats(nodes: Column) -> Column:
    return _each(nodes, lambda n: (n["tag"] == "Repeat") & ~F.map_contains_key(n["attrs"], "num_cycles"), 4, "repeat_cycles", lambda n: F.try_element_at(n["attrs"], F.lit("name")), 2)


def checked(trees: DataFrame, catalog: C.Catalog = C.DEFAULT) -> DataFrame:
    """The rows with ``issues`` in the order in which they are found."""
    known = lambda n: _in(n["skill_id"], catalog.names())
    nodes, root = F.col("nodes"), F.try_element_at("nodes", F.lit(1))
    tags = F.array_sort(F.array_distinct(F.transform(F.filter(nodes, lambda n: ~_in(n["tag"], catalog.tags) & ~known(n)), lambda n: n["tag"])))
    stray = lambda n: _in(n["tag"], ("Action", "Condition")) & (F.coalesce(n["skill_id"], F.lit("")) != "") & ~known(n)
    df = trees.withColumns({
        "__tags": tags,
        "__stray": F.array_sort(F.array_distinct(F.transform(F.filter(nodes, stray), lambda n: n["skill_id"]))),
        "__names": F.transform(F.filter(nodes, known), lambda n: n["skill_id"]),
        "__trees": F.size(F.filter(nodes, lambda n: (n["parent"] == 0) & (n["tag"] == "BehaviorTree"))),
        "__depth": F.coalesce(F.array_max(F.transform(nodes, lambda n: n["depth"])), F.lit(0)),
        "__falls": F.filter(nodes, lambda n: _in(n["tag"], FALLBACKS)),
        "__loops": F.filter(nodes, lambda n: (n["tag"] != "Action") & _in(n["skill_id"], C.LOOP_CONDITIONS)),
        "__stop": F.exists(nodes, lambda n: (n["tag"] != "Condition") & F.coalesce(n["skill_id"] == "MoveAndStop", F.lit(False))),
    })
    joined = lambda c: F.array_join(c, ", ")
    first = (
        F.when(F.col("parse_error").isNotNull(), F.array(_issue(1, "error", "xml_parse", F.col("parse_error"), 0)))
        .when(root["tag"] != "root", F.array(_issue(1, "error", "root_tag", root["tag"], 1)))
        .when(F.size("__tags") > 0, F.array(_issue(1, "error", "unknown_tag", joined("__tags"), 2)))
        .when(F.size("__stray") > 0, F.array(_issue(1, "error", "unknown_skill", joined("__stray"), 3)))
        .when(~F.col("__stop"), F.array(_issue(1, "error", "no_move_and_stop", None, 4)))
    )
    version = F.try_element_at(root["attrs"], F.lit("BTCPP_format"))
    warned = _once(F.coalesce(version, F.lit("")) != "4", 1, "warning", "btcpp_format", version, 5)
    second = F.when(F.col("__trees") == 0, F.array(_issue(2, "error", "no_behavior_tree", None, 0)).cast(ISSUE)).otherwise(F.concat(
        _each(nodes, lambda n: _in(n["tag"], catalog.control) & (n["n_children"] == 0), 2, "empty_control", lambda n: n["tag"], 1),
        _once(F.col("__depth") > catalog.max_depth, 2, "error", "too_deep", F.col("__depth"), 2),
        _once(F.size("__names") > catalog.max_skills, 2, "warning", "too_many_skills", F.size("__names"), 3),
        _each(nodes, lambda n: _in(n["tag"], FALLBACKS) & (n["n_children"] < catalog.min_fallback), 2, "thin_fallback", lambda n: n["n_children"], 4),
    ))
    at = lambda s: F.array_position("__names", F.lit(s))
    late = [
        _once((F.col("__trees") < 2) & (at(s) > 0) & ((at(p) == 0) | (at(p) > at(s))), 3, "warning", "prerequisite", F.lit(f"{s} needs {p}"), 0, 0, k)
        for k, (s, p) in enumerate(catalog.prerequisites)
    ]
    covered = lambda c: F.exists("__loops", lambda l: (l["skill_id"] == c) & F.exists("__falls", lambda f: (l["pre"] >= f["pre"]) & (l["pre"] <= f["post"])))
    present = lambda c: F.exists("__loops", lambda l: l["skill_id"] == c)
    bare = [
        _once(present(c) & ~covered(c), 3, "warning", "condition_outside_fallback", F.lit(c), 2, 0, k)
        for k, c in enumerate(sorted(C.LOOP_CONDITIONS))
    ]
    third = F.concat(*late, _once((F.size("__names") > 0) & (at("LoadMission") == 0), 3, "warning", "no_load_mission", None, 1), *bare)
    fourth = F.concat(F.array_sort(_ports(nodes, catalog), _found_before), _subtrees(nodes), _repeats(nodes))
    hungry = lambda n: (
        _in(n["skill_id"], C.CONSUMERS) & F.exists(nodes, lambda s: (s["pre"] == n["parent"]) & (s["tag"] == "Sequence"))
        & ~F.exists(nodes, lambda p: (p["parent"] == n["parent"]) & (p["pre"] < n["pre"]) & _in(p["skill_id"], C.PRODUCERS))
    )
    within = lambda t, which: F.exists(nodes, lambda n: (n["pre"] >= t["pre"]) & (n["pre"] <= t["post"]) & which(n))
    loose = lambda t: (t["tag"] == "BehaviorTree") & _in(F.try_element_at(t["attrs"], F.lit("ID")), ("execute", "execution")) & ~(
        within(t, lambda n: n["tag"] == "ReactiveFallback")
        & within(t, lambda n: (n["tag"] == "Repeat") & F.coalesce(F.try_element_at(n["attrs"], F.lit("num_cycles")) == "-1", F.lit(False)))
        & within(t, lambda n: F.coalesce(n["skill_id"] == "MissionTerminated", F.lit(False)))
    )
    fifth = F.concat(
        F.transform(F.filter(nodes, hungry), lambda n: _issue(5, "warning", "consumer_before_producer", n["skill_id"], 0, n["parent"], n["pre"])).cast(ISSUE),
        _each(nodes, loose, 5, "execution_loop", lambda n: F.try_element_at(n["attrs"], F.lit("ID")), 1),
    )
    failed = (F.col("__trees") == 0) | (F.col("__depth") > catalog.max_depth)
    found = F.coalesce(first.cast(ISSUE), F.concat(warned, second, F.when(failed, _none()).otherwise(F.concat(third, fourth, fifth))))
    return df.withColumn("issues", found).select(*trees.columns, "issues")


def _found_before(a: Column, b: Column) -> Column:
    return F.when(a["pre"] != b["pre"], a["pre"] - b["pre"]).otherwise(a["sub"] - b["sub"])


def issues(trees: DataFrame, catalog: C.Catalog = C.DEFAULT) -> DataFrame:
    """One row per finding: ``tree_id, level, severity, code, detail, step, pre, sub``."""
    return unfolded(checked(trees, catalog), F.col("issues"))


def unfolded(df: DataFrame, found: Column) -> DataFrame:
    """A row per finding. An inner ``inline`` lets Spark put a filter on the array's size below it, which finds everything once more; an outer one doesn't."""
    return df.select("tree_id", F.inline_outer(found)).where("code is not null")


def folded(found: Column) -> Column:
    """The score after all issues, from 1."""
    return F.aggregate(found, F.lit(1.0), lambda score, x: F.when(x["severity"] == "error", F.lit(0.0)).otherwise(F.greatest(F.lit(0.5), score - 0.1)))


def scored(trees: DataFrame, catalog: C.Catalog = C.DEFAULT) -> DataFrame:
    """The rows with ``issues, valid, score, n_errors, n_warnings``."""
    count = lambda s: F.size(F.filter("issues", lambda x: x["severity"] == s))
    return checked(trees, catalog).withColumns({"valid": count("error") == 0, "score": folded(F.col("issues")), "n_errors": count("error"), "n_warnings": count("warning")})


def verdicts(trees: DataFrame, catalog: C.Catalog = C.DEFAULT) -> DataFrame:
    """``tree_id, valid, score, n_errors, n_warnings`` of every tree."""
    return scored(trees, catalog).select("tree_id", "valid", "score", "n_errors", "n_warnings")


def port_issues_of(catalog: C.Catalog = C.DEFAULT) -> Column:
    """Level 4 alone of a tree, whatever the other levels would say; a document that doesn't parse has one issue."""
    found = F.concat(F.array_sort(_ports(F.col("nodes"), catalog), _found_before), _subtrees(F.col("nodes")), _repeats(F.col("nodes")))
    return F.when(F.col("parse_error").isNotNull(), F.array(_issue(4, "error", "xml_parse", F.col("parse_error"), 0)).cast(ISSUE)).otherwise(found)


def port_issues(trees: DataFrame, catalog: C.Catalog = C.DEFAULT) -> DataFrame:
    """``tree_id, code, detail, pre`` of level 4 alone."""
    return unfolded(trees, port_issues_of(catalog)).select("tree_id", "code", "detail", "pre")


def enrich(trees: DataFrame, catalog: C.Catalog = C.DEFAULT) -> DataFrame:
    """Default ports where a skill lacks them; attributes that are there stay. Running it twice changes nothing."""
    table = ports_map(catalog)

    def filled(n: Column) -> Column:
        spec = F.coalesce(F.try_element_at(table, n["skill_id"]), F.array().cast("array<struct<port:string,kind:string,required:boolean,default:string,allowed:array<string>>>"))
        absent = F.filter(spec, lambda p: p["default"].isNotNull() & ~F.map_contains_key(n["attrs"], p["port"]))
        more = F.map_from_entries(F.transform(absent, lambda p: F.struct(p["port"], p["default"])))
        return n.withField("attrs", F.map_concat(n["attrs"], more))

    return trees.withColumn("nodes", F.transform("nodes", filled))
