"""Facts of documents from one pass over their texts: no elements travel between Python and the JVM, only what is asked for.

The rules of ``validate``, ``metrics`` and ``navigation`` are expressions over trees, which Spark interprets element by element;
here the same rules are told straight from the text. Elements repeat much between documents, so what an element alone tells is made
once and kept by its text (``Reader``). A document that isn't made of plain tags is parsed as in ``nodes``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from functools import partial
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbolita.operators import catalog as C
from arbolita.operators import navigation as N
from arbolita.operators import validate as V
from arbolita.operators.metrics import INVENTORY_CONTROL, LEAVES, LOOPS
from arbolita.operators.nodes import CONTROL, PLAIN_NOT, flatten

LEAF, OPEN, CLOSE = 0, 1, 2
#: texts of elements that are kept, and the longest of them
KEPT, KEPT_LENGTH = 50_000, 1_000
_END_TAG = re.compile(r"/([^\s/<>]+)[ \t\r\n]*>[ \t\r\n]*")
_NAME = re.compile(r"[^\s/>]+")
#: an element that needs no parser: names and values of plain ASCII without entities
_PLAIN = re.compile(r"""([A-Za-z_][\w.-]*)((?: [A-Za-z_][\w.-]*="[ !#-%'-;=-~]*")*)(/?)>[ \t\r\n]*""", re.ASCII)
_PLAIN_ATTR = re.compile(r""" ([A-Za-z_][\w.-]*)="([^"]*)\"""", re.ASCII)


def _like_java(pattern: str, flags: int = 0):
    """Java's pattern: classes are of ASCII, and the end is before a last line end too."""
    return re.compile(pattern.replace("$", r"(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z"), re.ASCII | flags)


INT, FLOAT, VARIABLE = _like_java(V.INT), _like_java(V.FLOAT), _like_java(r"^\{.*\}$", re.DOTALL)


class Element:
    """One element: its tag, skill and attributes, and ``info``, what the caller makes of them."""

    __slots__ = ("tag", "skill", "attrs", "info")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.info = tag, attrs, None
        self.skill = attrs.get("ID") if tag in LEAVES else None if tag in PLAIN_NOT else tag


class Tree:
    """Elements in document order with parent, post (last descendant), depth and number of children of each."""

    __slots__ = ("elements", "parent", "post", "depth", "children")

    def __init__(self, elements, parent, post, depth, children):
        self.elements, self.parent, self.post, self.depth, self.children = elements, parent, post, depth, children


class Reader:
    """Texts to trees. ``info`` is asked once for each text of an element, as long as that is kept."""

    def __init__(self, info: Callable[[Element], object], mode: str = "stripped"):
        self.info, self.mode = info, mode
        self.kept: dict[str, tuple] = {}

    def read(self, text: str | None) -> tuple[Tree | None, str | None]:
        """The tree, or the reason why there is none."""
        made = self._scan(text) if text else None
        if made is not None:
            return made, None
        rows, error = flatten(text, self.mode)
        if error is not None:
            return None, error
        elements = [self._element(r[5], dict(r[7])) for r in rows]
        return Tree(elements, [r[2] for r in rows], [r[1] for r in rows], [r[4] for r in rows], [r[8] for r in rows]), None

    def _element(self, tag: str, attrs: dict[str, str]) -> Element:
        e = Element(tag, attrs)
        e.info = self.info(e)
        return e

    def _scan(self, text: str) -> Tree | None:
        """The tree of a document of plain tags and blanks, or nothing where the parser must look."""
        tokens = (text.strip().lstrip("\ufeff") if self.mode == "stripped" else text).split("<")
        if tokens[0] or len(tokens) < 2:
            return None
        del tokens[0]
        get, elements, parent, post, depth, children, inside = self.kept.get, [], [], [], [], [], []
        for token in tokens:
            known = get(token)
            if known is None:
                known = self._learn(token)
                if known is None:
                    return None
            kind, e = known
            if kind == CLOSE:
                if not inside:
                    return None
                at = inside.pop()
                if elements[at].tag != e:
                    return None
                post[at] = len(elements) - 1
                continue
            at = len(elements)
            if inside:
                up = inside[-1]
                children[up] += 1
                parent.append(up)
            elif at:
                return None
            else:
                parent.append(None)
            elements.append(e)
            depth.append(len(inside))
            post.append(at)
            children.append(0)
            if kind == OPEN:
                inside.append(at)
        return None if inside else Tree(elements, parent, post, depth, children)

    def _learn(self, token: str) -> tuple | None:
        """What follows a ``<``: an end tag or an element that expat takes by itself; nothing for all else."""
        if token.startswith("/"):
            found = _END_TAG.fullmatch(token)
            known = (CLOSE, found[1]) if found else None
        elif not token or token[0] in "!?" or "xmlns" in token or "xml:" in token:
            known = None
        elif (plain := _PLAIN.fullmatch(token)) and len(attrs := dict(given := _PLAIN_ATTR.findall(plain[2]))) == len(given):
            known = (LEAF if plain[3] else OPEN, self._element(plain[1], attrs))
        else:
            known = self._parsed(LEAF, f"<{token}")
            if known is None and (name := _NAME.match(token)):
                known = self._parsed(OPEN, f"<{token}</{name[0]}>")
        if known is not None and len(token) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[token] = known
        return known

    def _parsed(self, kind: int, text: str) -> tuple | None:
        started: list[tuple] = []
        parser = expat.ParserCreate("utf-8", "}")
        parser.StartElementHandler = lambda tag, attrs: started.append((tag, attrs))
        try:
            parser.Parse(text, True)
        except (expat.ExpatError, ValueError):
            return None
        return (kind, self._element(*started[0])) if len(started) == 1 else None


class Facts:
    """What the first dialect's rules need of an element alone."""

    __slots__ = ("bits", "known", "have", "want", "ports", "more")


UNKNOWN_TAG, STRAY, NAMED, BEHAVIOR, FALL, LOOP, STOP, EMPTY, HUNGRY, FED, LOOSE, SUBTREE, REPEAT, LEAF_LIKE, UNKNOWN, PORTS = (1 << k for k in range(16))


class Rules:
    """The five levels of ``validate`` over a catalog; ``enriched`` puts default ports in first."""

    def __init__(self, catalog: C.Catalog = C.DEFAULT, enriched: bool = False):
        self.catalog, self.enriched = catalog, enriched
        self.names, self.tags, self.control = frozenset(catalog.names()), frozenset(catalog.tags), frozenset(catalog.control)
        self.spec = {s.name: s.ports for s in catalog.skills}
        self.told = frozenset(p.name for s in catalog.skills for p in s.ports) | {"ID", "num_cycles"}
        self.made: dict[tuple, Facts] = {}

    def facts(self, e: Element) -> Facts:
        """Values of attributes that no rule looks at don't count, so elements that differ in them share their facts."""
        key = (e.tag, *[(k, v if k in self.told else None) for k, v in e.attrs.items()])
        f = self.made.get(key)
        if f is None:
            if len(self.made) >= KEPT:
                self.made.clear()
            f = self.made[key] = self._facts(e)
        if f.more:
            e.attrs = e.attrs | f.more
        return f

    def _facts(self, e: Element) -> Facts:
        f, tag, skill, attrs = Facts(), e.tag, e.skill, e.attrs
        f.more = None
        f.known = known = skill in self.names
        spec = self.spec.get(skill, ()) if known else ()
        if self.enriched and spec:
            f.more = {p.name: p.default for p in spec if p.default is not None and p.name not in attrs}
            attrs = attrs | f.more
        f.want = sum(p.required for p in spec)
        f.have = sum(p.required and p.name in attrs for p in spec)
        f.ports = self._ports(spec, attrs) if known else []
        leaf_like = tag in LEAVES or ("A" <= tag[0] <= "Z" and tag not in CONTROL and tag not in ("BehaviorTree", "SubTreePlus"))
        f.bits = (
            (UNKNOWN_TAG if not known and tag not in self.tags else 0) | (STRAY if tag in LEAVES and skill and not known else 0) | (NAMED if known else 0) | (BEHAVIOR if tag == "BehaviorTree" else 0)
            | (FALL if tag in V.FALLBACKS else 0) | (LOOP if tag != "Action" and skill in C.LOOP_CONDITIONS else 0) | (STOP if tag != "Condition" and skill == "MoveAndStop" else 0)
            | (EMPTY if tag in self.control else 0) | (HUNGRY if skill in C.CONSUMERS else 0) | (FED if skill in C.PRODUCERS else 0)
            | (LOOSE if tag == "BehaviorTree" and attrs.get("ID") in ("execute", "execution") else 0) | (SUBTREE if tag == "SubTreePlus" else 0)
            | (REPEAT if tag == "Repeat" and "num_cycles" not in attrs else 0) | (LEAF_LIKE if leaf_like else 0) | (UNKNOWN if leaf_like and skill and not known else 0) | (PORTS if f.ports else 0)
        )
        return f

    def _ports(self, spec, attrs: dict[str, str]) -> list[tuple]:
        """Level 4 of a skill's element: (code, detail, sub) in order."""
        found = [("missing_port", p.name, i) for i, p in enumerate(spec) if p.required and p.name not in attrs]
        ports = {p.name for p in spec}
        found += [("unknown_port", k, i + 1000) for i, k in enumerate(k for k in attrs if k not in V.META) if k not in ports]
        for i, p in enumerate(spec):
            value = attrs.get(p.name)
            if value is None:
                continue
            told = f"{p.name}={value}"
            if (
                (p.kind == "bb_var" and not (value.startswith("{") and value.endswith("}"))) or (p.kind == "int_literal" and not INT.search(value)) or (p.kind == "float_literal" and not FLOAT.search(value))
            ):
                found.append(("port_type", told, 2 * i + 2000))
            if p.allowed and value not in p.allowed:
                found.append(("port_domain", told, 2 * i + 2001))
        return sorted(found, key=lambda x: x[2])

    def port_findings(self, t: Tree) -> list[tuple]:
        """Level 4 of a tree: (level, severity, code, detail, step, pre, sub) in order."""
        els = t.elements
        found, others = [], 0
        for k, e in enumerate(els):
            others |= e.info.bits
            for code, detail, sub in e.info.ports:
                found.append((4, "warning", code, detail, 0, k, sub))
        if not others & (SUBTREE | REPEAT):
            return found
        for k, e in enumerate(els):
            if e.info.bits & SUBTREE:
                if not e.attrs.get("ID"):
                    found.append((4, "warning", "subtree_id", None, 1, k, 0))
                if "__autoremap" not in e.attrs:
                    found.append((4, "warning", "subtree_autoremap", e.attrs.get("ID"), 1, k, 1))
        found += [(4, "warning", "repeat_cycles", e.attrs.get("name"), 2, k, 0) for k, e in enumerate(els) if e.info.bits & REPEAT]
        return found

    def findings(self, t: Tree | None, error: str | None) -> list[tuple]:
        """All findings of a document in order, as ``validate.checked`` has them."""
        if t is None:
            return [(1, "error", "xml_parse", error, 0, 0, 0)]
        els, catalog = t.elements, self.catalog
        one = lambda code, detail, step: [(1, "error", code, detail, step, 0, 0)]
        if els[0].tag != "root":
            return one("root_tag", els[0].tag, 1)
        bits = 0
        for e in els:
            bits |= e.info.bits
        if bits & UNKNOWN_TAG:
            return one("unknown_tag", ", ".join(sorted({e.tag for e in els if e.info.bits & UNKNOWN_TAG})), 2)
        if bits & STRAY:
            return one("unknown_skill", ", ".join(sorted({e.skill for e in els if e.info.bits & STRAY})), 3)
        if not bits & STOP:
            return one("no_move_and_stop", None, 4)
        found = []
        version = els[0].attrs.get("BTCPP_format")
        if version != "4":
            found.append((1, "warning", "btcpp_format", version, 5, 0, 0))
        trees = 0
        for e, up in zip(els, t.parent):
            if up == 0 and e.info.bits & BEHAVIOR:
                trees += 1
        if not trees:
            return [*found, (2, "error", "no_behavior_tree", None, 0, 0, 0)]
        depth = max(t.depth)
        names = [e.skill for e in els if e.info.known]
        if bits & EMPTY:
            found += [(2, "warning", "empty_control", e.tag, 1, k, 0) for k, (e, n) in enumerate(zip(els, t.children)) if not n and e.info.bits & EMPTY]
        if depth > catalog.max_depth:
            found.append((2, "error", "too_deep", str(depth), 2, 0, 0))
        if len(names) > catalog.max_skills:
            found.append((2, "warning", "too_many_skills", str(len(names)), 3, 0, 0))
        if bits & FALL:
            found += [(2, "warning", "thin_fallback", str(n), 4, k, 0) for k, (e, n) in enumerate(zip(els, t.children)) if n < catalog.min_fallback and e.info.bits & FALL]
        if depth > catalog.max_depth:
            return found
        first: dict[str, int] = {}
        for k, s in enumerate(names):
            first.setdefault(s, k)
        if trees < 2:
            found += [(3, "warning", "prerequisite", f"{s} needs {p}", 0, 0, k) for k, (s, p) in enumerate(catalog.prerequisites) if s in first and first.get(p, len(names)) > first[s]]
        if names and "LoadMission" not in first:
            found.append((3, "warning", "no_load_mission", None, 1, 0, 0))
        if bits & LOOP:
            covered, under = {}, []
            for e, up in zip(els, t.parent):
                under.append(bool(e.info.bits & FALL) or (up is not None and under[up]))
                if e.info.bits & LOOP:
                    covered[e.skill] = covered.get(e.skill, False) or under[-1]
            found += [(3, "warning", "condition_outside_fallback", c, 2, 0, k) for k, c in enumerate(sorted(C.LOOP_CONDITIONS)) if covered.get(c) is False]
        if bits & (PORTS | SUBTREE | REPEAT):
            found += self.port_findings(t)
        if bits & HUNGRY:
            fed = set()
            for k, (e, up) in enumerate(zip(els, t.parent)):
                if e.info.bits & HUNGRY and up is not None and els[up].tag == "Sequence" and up not in fed:
                    found.append((5, "warning", "consumer_before_producer", e.skill, 0, up, k))
                if e.info.bits & FED:
                    fed.add(up)
        if bits & LOOSE:
            at = lambda which: [k for k, e in enumerate(els) if which(e)]
            wanted = (
                at(lambda e: e.tag == "ReactiveFallback"), at(lambda e: e.tag == "Repeat" and e.attrs.get("num_cycles") == "-1"), at(lambda e: e.skill == "MissionTerminated"),
            )
            found += [(5, "warning", "execution_loop", els[k].attrs.get("ID"), 1, k, 0) for k in at(lambda e: e.info.bits & LOOSE) if not all(_within(w, k, t.post[k]) for w in wanted)]
        return found

    def completeness(self, t: Tree | None) -> float:
        if t is None:
            return 0.0
        have = want = 0
        for e in t.elements:
            have += e.info.have
            want += e.info.want
        return have / want if want else 1.0


def _within(places: list[int], low: int, high: int) -> bool:
    k = bisect_left(places, low)
    return k < len(places) and places[k] <= high


def verdict(found: list[tuple]) -> tuple[bool, float, int, int]:
    """valid, score, errors, warnings; the score starts from 1, an error sets it to 0, a warning takes 0.1 but leaves 0.5."""
    score, errors = 1.0, 0
    for x in found:
        if x[1] == "error":
            score, errors = 0.0, errors + 1
        else:
            score = max(0.5, score - 0.1)
    return not errors, score, errors, len(found) - errors


def _count(t: Tree | None, bit: int) -> int:
    n = 0
    for e in t.elements if t is not None else ():
        if e.info.bits & bit:
            n += 1
    return n


def _lines(found: list[tuple], severity: str) -> str:
    return "\n".join(f"[L{x[0]}] {x[2]}" + ("" if x[3] is None else f": {x[3]}") for x in found if x[1] == severity)


_TYPES = {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def told(docs: DataFrame, schema: str, make: Callable[[], Callable[[str | None], tuple]], id_col: str = "tree_id", xml_col: str = "xml", keep: tuple[str, ...] = ()) -> DataFrame:
    """``tree_id``, the columns of ``schema`` and those named in ``keep``: ``make`` is called once a partition and what it returns for every text."""
    columns = [c.split() for c in schema.split(", ")]

    def run(batches):
        of = make()
        for batch in batches:
            rows = [of(text) for text in batch.column(1).to_pylist()]
            made = [pa.array(x, _TYPES[c[1]]) for x, c in zip(zip(*rows) if rows else [()] * len(columns), columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[2:]], names=["tree_id", *[c[0] for c in columns], *keep])

    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col(id_col).cast("string").alias("tree_id"), F.col(xml_col).alias("__xml"), *keep).mapInArrow(run, f"tree_id string, {schema}{more}")


def _evaluating(catalog: C.Catalog):
    rules = Rules(catalog)
    reader = Reader(rules.facts)

    def of(text):
        t, error = reader.read(text)
        return *verdict(rules.findings(t, error)), _count(t, UNKNOWN), rules.completeness(t), max(t.depth) if t else 0, _count(t, LEAF_LIKE), len(t.elements) if t else 0

    return of


def evaluated(docs: DataFrame, catalog: C.Catalog = C.DEFAULT, **columns) -> DataFrame:
    """Verdict, hallucinations, ports and structure of every document, as ``reports.evaluated`` has them of trees."""
    schema = "valid boolean, score double, n_errors int, n_warnings int, hallucination_count int, port_completeness double, max_depth int, n_skills int, total_nodes int"
    return told(docs, schema, partial(_evaluating, catalog), **columns)


def _judging(catalog: C.Catalog, enriched: bool, lines: bool):
    rules = Rules(catalog, enriched)
    reader = Reader(rules.facts)

    def of(text):
        t, error = reader.read(text)
        found = rules.findings(t, error)
        valid, score, _, warnings = verdict(found)
        return valid, score, warnings, _count(t, STRAY), t is not None, *((_lines(found, "error"), _lines(found, "warning")) if lines else ())

    return of


def judged(docs: DataFrame, catalog: C.Catalog = C.DEFAULT, enriched: bool = False, lines: bool = False, **columns) -> DataFrame:
    """``valid, score, n_warnings, n_stray`` (IDs of Action and Condition that the catalog doesn't know), ``parsed`` and, with ``lines``, the findings as lines of text."""
    schema = "valid boolean, score double, n_warnings int, n_stray int, parsed boolean" + (", errors_text string, warnings_text string" if lines else "")
    return told(docs, schema, partial(_judging, catalog, enriched, lines), **columns)


def _hallucinating(catalog: C.Catalog):
    rules = Rules(catalog)
    reader = Reader(rules.facts)

    def of(text):
        t, _ = reader.read(text)
        names = [e.skill for e in t.elements if e.info.bits & UNKNOWN] if t else []
        return ",".join(sorted(set(names))), len(names), _count(t, LEAF_LIKE)

    return of


def hallucination(docs: DataFrame, catalog: C.Catalog = C.DEFAULT, **columns) -> DataFrame:
    """As ``metrics.hallucination`` of trees."""
    return told(docs, "hallucinated_skills string, hallucination_count int, total_skills int", partial(_hallucinating, catalog), **columns)


def _completing(catalog: C.Catalog):
    rules = Rules(catalog)
    reader = Reader(rules.facts)
    return lambda text: (rules.completeness(reader.read(text)[0]),)


def port_completeness(docs: DataFrame, catalog: C.Catalog = C.DEFAULT, **columns) -> DataFrame:
    """As ``metrics.port_completeness`` of trees."""
    return told(docs, "port_completeness double", partial(_completing, catalog), **columns)


def _browsing():
    reader = Reader(lambda e: None)

    def of(text):
        t, _ = reader.read(text)
        if t is None:
            return 0, 0, 0, len(text or "")
        return len(t.elements), sum(e.tag == "BehaviorTree" and up == 0 for e, up in zip(t.elements, t.parent)), t.children.count(0), len(text)

    return of


def browser(docs: DataFrame, **columns) -> DataFrame:
    """As ``metrics.browser`` of trees."""
    return told(docs, "nodes int, subtrees int, leaf_nodes int, xml_size int", _browsing, **columns)


def _counting(names) -> str:
    return ",".join(f"{k}:{n}" for k, n in sorted(Counter(names).items()))


def _listing(names) -> str:
    return ",".join(sorted(set(names)))


def _taking_stock():
    def info(e: Element):
        ports = [k for k in e.attrs if k not in V.META] if e.tag in LEAVES and e.skill else ()
        return ports, [v[1:-1] for v in map(e.attrs.get, ports) if v.startswith("{") and v.endswith("}")]

    reader = Reader(info)

    def of(text):
        t, error = reader.read(text)
        if t is None:
            return False, error, None, "", "", "", "", "", 0, 0, 0, 0, 0, 0.0, False, False, 0, "", ""
        els, rooted = t.elements, t.elements[0].tag == "root"
        tops = [k for k, (e, up) in enumerate(zip(els, t.parent)) if up == 0 and e.tag == "BehaviorTree"] if rooted else [0]
        deepest, skills, controls, tags, refs, branches, variables = 0, [], [], Counter(), [], [], []
        ports: dict[str, set[str]] = {}
        for top in tops:
            end = t.post[top] + 1
            deepest = max(deepest, max(t.depth[top:end]) - t.depth[top])
            for k in range(top, end):
                e = els[k]
                tag = e.tag
                tags[tag] += 1
                if tag in LEAVES:
                    if e.skill:
                        skills.append(e.skill)
                        ports.setdefault(e.skill, set()).update(e.info[0])
                        variables += e.info[1]
                elif tag in INVENTORY_CONTROL:
                    controls.append(tag)
                    if t.children[k]:
                        branches.append(t.children[k])
                elif tag in ("SubTree", "SubTreePlus"):
                    refs.append(e)
        return (
            True, None, els[0].attrs.get("main_tree_to_execute") if rooted else None, ",".join(i for i in (els[k].attrs.get("ID") for k in tops) if i), _listing(i for i in (e.attrs.get("ID") for e in refs) if i),
            _listing(skills), _counting(skills), _counting(controls), tags["Action"], tags["Condition"], tags["SubTree"], tags["SubTreePlus"], deepest, sum(branches) / len(branches) if branches else 0.0,
            any(e.attrs.get("__autoremap", "").lower() == "true" for e in refs), any(tags[x] for x in LOOPS), len(tops), ";".join(f"{s}={_listing(p)}" for s, p in sorted(ports.items())), _listing(variables),
        )

    return of


def inventory(docs: DataFrame, **columns) -> DataFrame:
    """As ``metrics.inventory`` of trees."""
    schema = (
        "parse_ok boolean, parse_error string, root_main_tree string, declared_subtrees string, referenced_subtrees string, skill_ids string, skill_id_counts string, control_node_counts string, n_actions int, "
        "n_conditions int, n_subtrees int, n_subtree_plus int, max_depth int, mean_branching double, has_autoremap boolean, has_repeat_loop boolean, n_top_level_trees int, ports_seen string, blackboard_refs string"
    )
    return told(docs, schema, _taking_stock, **columns).withColumn("mean_branching", F.round("mean_branching", 2))


def _checklisting(strict_attrs: bool, reference: N.Reference):
    known = {k: set(a) for k, a in (N.CONTROL_ATTRS | N.STRUCTURE_ATTRS).items()} | {s: {p for p, _, _ in ps} | {"name"} for s, ps in N.SKILLS}
    for k, more in reference.attrs.items():
        known.setdefault(k, set()).update(more)
    required = {s: [p for p, _, r in ps if r] for s, ps in N.SKILLS}
    kinds = {s: {p: k for p, k, _ in ps} for s, ps in N.SKILLS} | N.CONTROL_TYPES

    def wrong(kind, value) -> bool:
        bad = (kind == "float" and not FLOAT.search(value)) or (kind == "int" and not INT.search(value)) or (kind == "bool" and value.lower() not in ("true", "false", "0", "1"))
        return bad and not VARIABLE.search(value)

    def info(e: Element) -> frozenset[str]:
        """The codes of an element alone."""
        if e.tag not in known:
            return frozenset(("tag_not_allowed",))
        expected = kinds.get(e.tag, {})
        return frozenset(code for code, found in (
            ("missing_required_attr", any(p not in e.attrs for p in required.get(e.tag, ()))), ("unknown_attr", strict_attrs and any(k not in known[e.tag] for k in e.attrs)),
            ("attr_type_mismatch", any(wrong(expected.get(k), v) for k, v in e.attrs.items())), ("bt_missing_id", e.tag == "BehaviorTree" and not e.attrs.get("ID")),
        ) if found)

    reader = Reader(info)

    def codes(text) -> set[str]:
        t, error = reader.read(text)
        if t is None:
            return {"xml_parse"}
        els, found = t.elements, set()
        defs, refs, places = [], [], []
        for k, e in enumerate(els):
            if e.info:
                found |= e.info
            if not t.children[k] and e.tag in N.CONTROL_ATTRS:
                found.add("empty_control_node")
            if e.tag == "BehaviorTree":
                if e.attrs.get("ID"):
                    defs.append((e.attrs["ID"], k))
            elif e.tag == "SubTree" and e.attrs.get("ID"):
                refs.append(e.attrs["ID"])
                places.append(k)
        main, ids = els[0].attrs.get("main_tree_to_execute"), {i for i, _ in defs}
        if els[0].tag != "root":
            found.add("root_tag")
        if not main:
            found.add("root_main_tree")
        elif main not in ids:
            found.add("missing_main_tree_def")
        if len(ids) < len(defs):
            found.add("bt_duplicate_id")
        if not ids.issuperset(refs):
            found.add("subtree_missing_definition")
        # the last of several definitions with one ID is the one that counts
        if refs and defs and N.cyclic({i: set(refs[bisect_left(places, k) : bisect_left(places, t.post[k] + 1)]) for i, k in defs}):
            found.add("subtree_cycle")
        return found

    def of(text):
        found = codes(text)
        return tuple(c not in found for c in N.CODES)

    return of


def checklist(docs: DataFrame, strict_attrs: bool = True, reference: N.Reference = N.Reference(), **columns) -> DataFrame:
    """As ``navigation.checklist`` of trees."""
    return told(docs, ", ".join(f"ok_{c} boolean" for c in N.CODES), partial(_checklisting, strict_attrs, reference), **columns)


def port_counts(docs: DataFrame, catalog: C.Catalog = C.DEFAULT, xml_col: str = "xml") -> DataFrame:
    """``issue, n, total, clean``: a row for each port issue of a batch of documents, and one without issue that counts all issues, the documents and those without any."""

    def run(batches):
        rules = Rules(catalog)
        reader = Reader(rules.facts)
        for batch in batches:
            issues, clean = Counter(), 0
            for text in batch.column(0).to_pylist():
                t, error = reader.read(text)
                if t is None:
                    issues[f"xml_parse {error}"] += 1
                    continue
                found = rules.port_findings(t)
                clean += not found
                for _, _, code, detail, *_ in found:
                    issues[code if detail is None else f"{code} {detail.split('=', 1)[0] if code.startswith('port_') else detail}"] += 1
            rest = [0] * len(issues)
            columns = [pa.array([None, *issues], pa.string()), pa.array([sum(issues.values()), *issues.values()], pa.int64()), pa.array([batch.num_rows, *rest], pa.int64()), pa.array([clean, *rest], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["issue", "n", "total", "clean"])

    return docs.select(xml_col).mapInArrow(run, "issue string, n long, total long, clean long")
