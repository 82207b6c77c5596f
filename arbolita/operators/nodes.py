"""XML documents as trees and as a node relation, parsed once.

``bt_trees`` has one row per document with its elements in document order as an array of structs: ``pre, post`` (its last
descendant's number), ``parent, ord, depth`` (root 0), ``tag, skill_id`` (the ID of an Action or Condition, else the tag itself
where it names a skill), ``attrs, n_children``. Rules and metrics of a document are expressions over that array, so they need no
shuffle. ``bt_nodes`` has one row per element. A document that doesn't parse has no elements and its ``parse_error``: failure is
data. Declarations of document types are refused before parsing, since entities can blow up.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE = "struct<pre:int,post:int,parent:int,ord:int,depth:int,tag:string,skill_id:string,attrs:map<string,string>,n_children:int>"
FIELDS = ("pre", "post", "parent", "ord", "depth", "tag", "skill_id", "attrs", "n_children")
CONTROL = ("Sequence", "Fallback", "ReactiveFallback", "Parallel", "Repeat")
STRUCTURE = ("root", "BehaviorTree", "SubTree", "SubTreePlus")
#: documents with any of these are refused or have names that only ElementTree writes in full
UNUSUAL = ("<!DOCTYPE", "xmlns", "xml:")
PLAIN_NOT = frozenset((*CONTROL, *STRUCTURE))


def flatten(text: str | None, mode: str = "stripped") -> tuple[list[tuple], str | None]:
    """Rows (pre .. n_children) of one document, or the reason why there are none. ``raw`` mode keeps leading blanks."""
    if not text or not text.strip():
        return [], "empty"
    if mode == "stripped":
        text = text.strip().lstrip("﻿")
    if "<!DOCTYPE" in text:
        return [], "document type declarations are refused"
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        return [], str(e)
    rows: list[list] = []
    stack = [(root, None, 1, 0, False)]
    open_at: list[int] = []
    while stack:
        el, parent, order, depth, leaving = stack.pop()
        if leaving:
            rows[open_at.pop()][1] = len(rows) - 1
            continue
        at = len(rows)
        plain = el.tag not in CONTROL and el.tag not in STRUCTURE
        skill = el.get("ID") if el.tag in ("Action", "Condition") else el.tag if plain else None
        rows.append([at, at, parent, order, depth, el.tag, skill, list(el.attrib.items()), len(el)])
        open_at.append(at)
        stack.append((el, None, 0, 0, True))
        stack.extend((c, at, k, depth + 1, False) for k, c in reversed(list(enumerate(el, 1))))
    return [tuple(r) for r in rows], None


class Columns:
    """Elements of many documents as columns, filled by expat's events; documents that it refuses or that have namespaces go through ``flatten``."""

    def __init__(self, mode: str = "stripped"):
        self.mode = mode
        self.parent: list[int | None] = []
        self.post: list[int] = []
        self.order: list[int] = []
        self.depth: list[int] = []
        self.tag: list[str] = []
        self.skill: list[str | None] = []
        self.children: list[int] = []
        self.flat: list[str] = []  # name, value, name, value ...
        self.attr_ends: list[int] = [0]
        self.ends: list[int] = [0]
        self.errors: list[str | None] = []

    def add(self, text: str | None) -> None:
        base, flat = len(self.tag), len(self.flat)
        if text and not any(x in text for x in UNUSUAL) and self._parse(text, base):
            self.errors.append(None)
        else:
            for column in (self.parent, self.post, self.order, self.depth, self.tag, self.skill, self.children):
                del column[base:]
            del self.flat[flat:], self.attr_ends[base + 1 :]
            rows, error = flatten(text, self.mode)
            for _, post, parent, order, depth, tag, skill, attrs, children in rows:
                for column, x in zip((self.parent, self.post, self.order, self.depth, self.tag, self.skill, self.children), (parent, post, order, depth, tag, skill, children)):
                    column.append(x)
                for pair in attrs:
                    self.flat += pair
                self.attr_ends.append(len(self.flat) >> 1)
            self.errors.append(error)
        self.ends.append(len(self.tag))

    def _parse(self, text: str, base: int) -> bool:
        parents, posts, orders, depths, tags, skills, children = self.parent, self.post, self.order, self.depth, self.tag, self.skill, self.children
        flat, attr_ends, stack = self.flat, self.attr_ends, []

        def start(tag, attrs):
            at = len(tags)
            if stack:
                up = stack[-1]
                n = children[up] + 1
                children[up] = n
                orders.append(n)
                parents.append(up - base)
            else:
                orders.append(1)
                parents.append(None)
            depths.append(len(stack))
            stack.append(at)
            tags.append(tag)
            posts.append(0)
            children.append(0)
            if tag == "Action" or tag == "Condition":
                skills.append(attrs[1] if attrs and attrs[0] == "ID" else dict(zip(attrs[::2], attrs[1::2])).get("ID"))
            else:
                skills.append(None if tag in PLAIN_NOT else tag)
            flat.extend(attrs)
            attr_ends.append(len(flat) >> 1)

        def end(tag):
            posts[stack.pop()] = len(tags) - 1 - base

        parser = expat.ParserCreate("utf-8", "}")
        parser.ordered_attributes = True
        parser.StartElementHandler, parser.EndElementHandler = start, end
        try:
            parser.Parse(text.strip().lstrip("\ufeff") if self.mode == "stripped" else text, True)
        except (expat.ExpatError, ValueError):
            return False
        return True

    def arrays(self) -> tuple[pa.Array, pa.Array]:
        """The documents' elements and their errors, as Arrow."""
        ends = np.array(self.ends, np.int32)
        pre = np.arange(ends[-1], dtype=np.int32) - np.repeat(ends[:-1], np.diff(ends))
        number = lambda x: pa.array(x, pa.int32())
        attrs = pa.MapArray.from_arrays(number(self.attr_ends), pa.array(self.flat[::2], pa.string()), pa.array(self.flat[1::2], pa.string()))
        columns = [pa.array(pre), number(self.post), number(self.parent), number(self.order), number(self.depth), pa.array(self.tag, pa.string()), pa.array(self.skill, pa.string()), attrs, number(self.children)]
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, names=list(FIELDS))), pa.array(self.errors, pa.string())


def bt_trees(docs: DataFrame, id_col: str = "tree_id", xml_col: str = "xml", mode: str = "stripped", keep: tuple[str, ...] = ()) -> DataFrame:
    """``tree_id, nodes, parse_error`` of every document, and the columns named in ``keep`` as they came."""

    def run(batches):
        for batch in batches:
            made = Columns(mode)
            for text in batch.column(1).to_pylist():
                made.add(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.arrays(), *batch.columns[2:]], names=["tree_id", "nodes", "parse_error", *keep])

    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col(id_col).cast("string").alias("tree_id"), F.col(xml_col).alias("__xml"), *keep).mapInArrow(run, f"tree_id string, nodes array<{NODE}>, parse_error string{more}")


def bt_nodes(docs: DataFrame, id_col: str = "tree_id", xml_col: str = "xml", mode: str = "stripped") -> DataFrame:
    """One row per element; a document that doesn't parse is one row with null ``pre``."""
    trees = bt_trees(docs, id_col, xml_col, mode)
    return trees.select("tree_id", "parse_error", F.inline_outer("nodes")).select("tree_id", *FIELDS, "parse_error")


def trees_of(nodes: DataFrame) -> DataFrame:
    """Trees from the node relation: one shuffle by ``tree_id``."""
    some = F.when(F.col("pre").isNotNull(), F.struct(*FIELDS))
    # structs with maps don't compare, so the order is taken from the numbers
    per = nodes.groupBy("tree_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("pre").isNotNull(), F.struct("pre", some.alias("n"))))).alias("m"), F.max("parse_error").alias("parse_error"))
    return per.select("tree_id", F.transform(F.array_sort(F.map_keys("m")), lambda k: F.element_at("m", k)).alias("nodes"), "parse_error")


def to_xml(trees: DataFrame) -> DataFrame:
    """``tree_id, xml`` again from trees; two blanks an indent, null where a document didn't parse."""

    def one(nodes: list[dict]) -> str | None:
        made: list[ET.Element] = []
        for r in nodes or []:
            el = ET.Element(r["tag"], dict(r["attrs"] or []))
            made.append(el)
            if r["parent"] is not None:
                made[r["parent"]].append(el)
        if not made:
            return None
        ET.indent(made[0])
        return ET.tostring(made[0], encoding="unicode")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(one, batch.column(1).to_pylist())), pa.string())], names=["tree_id", "xml"])

    return trees.select("tree_id", "nodes").mapInArrow(run, "tree_id string, xml string")
