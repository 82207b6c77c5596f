"""Rewriting of documents for a corpus: masks, inlined subtrees, degraded copies, patches, digests."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolita.operators.nodes import FIELDS, NODE, flatten
from arbolita.operators.validate import _in


def masked(trees: DataFrame) -> DataFrame:
    """IDs of Action, Condition and SubTree references become ACTION_n, COND_n, SUB_n in order of first occurrence; ``name`` goes.

    SubTree and SubTreePlus of one ID get different numbers from one counter; definitions keep their IDs, so masked references dangle.
    """
    ident = lambda n: F.try_element_at(n["attrs"], F.lit("ID"))
    named = lambda *tags: F.filter("nodes", lambda n: _in(n["tag"], tags) & (F.coalesce(ident(n), F.lit("")) != ""))
    sub = lambda n: F.concat_ws(":", n["tag"], ident(n))
    df = trees.withColumns({
        "__a": F.array_distinct(F.transform(named("Action"), ident)), "__c": F.array_distinct(F.transform(named("Condition"), ident)), "__s": F.array_distinct(F.transform(named("SubTree", "SubTreePlus"), sub)),
    })

    def put(n: Column) -> Column:
        number = lambda c, x: F.array_position(c, x).cast("string")
        new = (
            F.when(n["tag"] == "Action", F.concat(F.lit("ACTION_"), number("__a", ident(n)))).when(n["tag"] == "Condition", F.concat(F.lit("COND_"), number("__c", ident(n))))
            .when(_in(n["tag"], ("SubTree", "SubTreePlus")), F.concat(F.lit("SUB_"), number("__s", sub(n))))
        )
        attrs = F.transform_values(F.map_filter(n["attrs"], lambda k, _: k != "name"), lambda k, v: F.when((k == "ID") & (v != ""), F.coalesce(new, v)).otherwise(v))
        return n.withField("attrs", attrs).withField("skill_id", F.when(n["skill_id"] != "", F.coalesce(new, n["skill_id"])).otherwise(n["skill_id"]))

    return df.withColumn("nodes", F.transform("nodes", put)).select(trees.columns)


#: Elements of one inlined document; shared definitions can double it at every level.
MOST_NODES = 1_000_000


def inlined(docs: DataFrame, id_col: str = "tree_id", xml_col: str = "xml") -> DataFrame:
    """``tree_id, nodes, error``: the main definition with every SubTreePlus reference replaced by what it refers to.

    A reference to a definition that is open on its own path, or to none, stays as it is. A document that would have more than
    ``MOST_NODES`` elements has no nodes and says so; so has one that doesn't parse.
    """

    def one(text: str | None) -> tuple[list[tuple], str | None]:
        rows, error = flatten(text)
        if error:
            return [], error
        attrs = [dict(r[7]) for r in rows]
        kids: list[list[int]] = [[] for _ in rows]
        for r in rows[1:]:
            kids[r[2]].append(r[0])
        defs = {attrs[r[0]].get("ID", ""): r[0] for r in rows if r[5] == "BehaviorTree"}
        main = defs.get(attrs[0].get("main_tree_to_execute", ""), next(iter(defs.values()), 0))
        out: list[list] = []
        stack: list[tuple] = [(main, None, 1, 0, frozenset([attrs[main].get("ID", "")]))]
        closing: list[int] = []
        while stack:
            at, parent, order, depth, path = stack.pop()
            if at < 0:
                out[closing.pop()][1] = len(out) - 1
                continue
            if len(out) >= MOST_NODES:
                return [], "too many elements"
            below, inside = kids[at], path
            if rows[at][5] == "SubTreePlus" and (to := attrs[at].get("ID", "")) in defs and to not in path:
                below, inside = kids[defs[to]], path | {to}
            k = len(out)
            out.append([k, k, parent, order, depth, rows[at][5], rows[at][6], rows[at][7], len(below)])
            closing.append(k)
            stack.append((-1, None, 0, 0, path))
            stack.extend((c, k, o, depth + 1, inside) for o, c in reversed(list(enumerate(below, 1))))
        return [tuple(r) for r in out], None

    types = [pa.int32()] * 5 + [pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int32()]

    def run(batches):
        for batch in batches:
            got = [one(t) for t in batch.column(1).to_pylist()]
            nodes = pa.array([[dict(zip(FIELDS, r)) for r in rows] for rows, _ in got], pa.list_(pa.struct(list(zip(FIELDS, types)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), nodes, pa.array([e for _, e in got], pa.string())], names=["tree_id", "nodes", "error"])

    return docs.select(F.col(id_col).cast("string").alias("tree_id"), F.col(xml_col).alias("xml")).mapInArrow(run, f"tree_id string, nodes array<{NODE}>, error string")


def fill(template: Column, values: Column) -> Column:
    """``{key}`` by its value in the map; keys that are not there stay as they are. No value is read again for keys."""
    keys = F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), 1)
    parts = F.split(template, r"\{\w+\}", -1)
    put = F.transform(keys, lambda k: F.coalesce(F.try_element_at(values, k), F.concat(F.lit("{"), k, F.lit("}"))))
    return F.array_join(F.flatten(F.zip_with(parts, put, lambda p, v: F.array(p, F.coalesce(v, F.lit(""))))), "")


def attribute_text(value: Column) -> Column:
    """A boolean or number as an attribute has it."""
    return F.lower(value.cast("string"))


def digest16(text: Column) -> Column:
    """The first sixteen digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def degraded(xml: Column, seed: Column) -> Column:
    """An array of (kind, xml) of copies with one fault each; kinds that change nothing are left out.

    no_stop: every MoveAndStop dropped; no_motion_params: the first Move without its parameters; no_main_tree: ``main_tree_to_execute``
    stripped; unknown_skill: one skill, chosen by the seed, renamed; cut_off: the first half, where nothing else applies.
    """
    ids = F.regexp_extract_all(xml, F.lit(r'<(?:Action|Condition) [^>]*\bID="(\w+)"'), 1)
    pick = F.try_element_at(ids, (F.pmod(F.xxhash64(seed), F.greatest(F.size(ids), F.lit(1))) + 1).cast("int"))
    made = [
        ("no_stop", F.regexp_replace(xml, r'<(?:Action [^>]*ID="MoveAndStop"|MoveAndStop\b)[^>]*/>', "")),
        ("no_motion_params", F.regexp_replace(xml, r'(?s)^(.*?<(?:Action [^>]*ID="Move"|Move\b)[^>]*?) motion_params="[^"]*"', "$1")),
        ("no_main_tree", F.regexp_replace(xml, r' main_tree_to_execute="[^"]*"', "")),
        ("unknown_skill", F.replace(xml, F.concat(F.lit('ID="'), pick, F.lit('"')), F.concat(F.lit('ID="'), pick, F.lit('XZ"')))),
    ]
    found = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("xml")) for k, x in made]), lambda p: p["xml"] != xml)
    half = F.array(F.struct(F.lit("cut_off").alias("kind"), F.substr(xml, F.lit(1), F.floor(F.length(xml) / 2).cast("int")).alias("xml")))
    return F.when(F.size(found) > 0, found).otherwise(half)


def repeat_in_execution(xml: Column, cycles: int) -> Column:
    """``num_cycles`` of the first Repeat of the execution tree set, with a comment before it that says so."""
    marked = rf'$1<!-- num_cycles set to {cycles} --><Repeat$2num_cycles="{cycles}"'
    return F.regexp_replace(xml, r'(?s)^(.*?<BehaviorTree ID="(?:execute|execution)".*?)<Repeat([^>]*?)num_cycles="[^"]*"', marked)


def close_copies(pairs: DataFrame, distance: str = "distance", depth: str = "max_depth", share: float = 0.15) -> DataFrame:
    """Cycle consistency: pairs whose tree distance is at most ``share`` of the depth; those without a distance go."""
    return pairs.where(F.col(distance) <= share * F.col(depth))
