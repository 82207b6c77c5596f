"""Documents from lines: their text, odd lines, and one shuffle for all of it."""

import random
from functools import cache

import pyarrow as pa
import pytest

from arbolita.functions import trees
from arbolita.operators import navigation, nodes, validate
from arbolita.plans import assemble, mission_corpus, xml_queries

COLUMNS = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
LINES = [
    (1, 2, 14, 1, 6.0, 20.5, 0.09, 0.08, "N", "O"), (1, 1, 5, 1, 1.0, 10.5, 0.0, 0.0, "R", "F"), (1, 3, 13, 1, 2.0, 30.5, 0.0, 0.0, "A", "O"), (1, 4, 13, 37, 2.0, 30.5, 0.1, 0.0, "A", "O"),
    (3, 1, None, 1, 1.0, 1.0, 0.0, 0.0, "N", "O"), (3, 2, 21, None, None, 1.0, None, None, "N", "F"), (3, 3, 21, 1, 5.0, 1.0, 0.0, 0.0, None, "F"), (None, 1, 1, 1, 1.0, 1.0, 0.0, 0.0, "N", "O"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("lines"))
    spark.createDataFrame(LINES, COLUMNS).repartition(3).write.parquet(f"{at}/lineitem.parquet")
    return at


def test_mission_documents(spark, folder):
    got = {r.tree_id: r.xml for r in mission_corpus.documents(spark, folder).collect()}
    assert got == {
        1: '<root BTCPP_format="4"><BehaviorTree ID="main"><Fallback><Condition ID="CheckCurrentStepType" type_to_be_checked="0"/><Action ID="Fly" price="30"/></Fallback>'
        '<Sequence><Action ID="MoveAndStop" motion_params="x1" price="20"/></Sequence><Fallback><Action ID="LoadMission" mission_file_path="{mission_file_path}"/></Fallback></BehaviorTree></root>',
        3: '<root BTCPP_format="4"><BehaviorTree ID="main"><Sequence><Action ID="Pause"/></Sequence></BehaviorTree></root>',
    }


def test_documents_take_one_shuffle_and_no_join(spark, folder):
    for made in (mission_corpus.documents(spark, folder), xml_queries.documents(spark, folder), xml_queries.documents(spark, folder, real=True)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan


def test_parsed_columns_are_those_of_flatten():
    texts = [
        None, "", " ", "x", "<a", "<a>&odd;</a>", "<p:a/>", "<a xml:lang='x'><b/></a>", "<a xmlns='u'><b c='1'/></a>", "<!DOCTYPE a><a/>", "﻿<a/>", " <a><b/><c><d/></c></a> ", "<Action name='n' ID='q'/>", "<Action/>", "<a>t<![CDATA[<b/>]]></a>",
        "<?xml version='1.0' encoding='latin-1'?><a b='é'/>", "<a/><b/>", '<root><BehaviorTree ID="m"><Sequence><Action ID="A" x="1" y="&lt;"/><Odd/></Sequence></BehaviorTree></root>',
    ]
    for mode in ("stripped", "raw"):
        made = nodes.Columns(mode)
        for t in texts:
            made.add(t)
        trees, errors = (x.to_pylist() for x in made.arrays())
        assert [([tuple(n[f] for f in nodes.FIELDS) for n in rows], e) for rows, e in zip(trees, errors)] == [nodes.flatten(t, mode) for t in texts]


def _trees_by_recursion(a, b):
    """The edit distance by its definition over forests, which are tuples of (label, children)."""

    @cache
    def d(f, g):
        if not f and not g:
            return 0
        if not f or not g:
            return sum(1 + d(t[1], ()) for t in f) + sum(1 + d((), t[1]) for t in g)
        (x, xs), (y, ys) = f[-1], g[-1]
        return min(d(f[:-1] + xs, g) + 1, d(f, g[:-1] + ys) + 1, d(f[:-1], g[:-1]) + d(xs, ys) + (x != y))

    return d((a,), (b,))


def test_edit_distance_by_its_definition():
    r = random.Random(5)

    def grown(n):
        kids = [[] for _ in range(n)]
        for k in range(1, n):
            kids[r.randrange(max(0, k - r.choice((1, 2, 9))), k)].append(k)
        labels = [r.choice("abc") for _ in range(n)]
        made = lambda k: (labels[k], tuple(map(made, kids[k])))
        return made(0)

    text = lambda t: f"<{t[0]}>{''.join(map(text, t[1]))}</{t[0]}>"
    for _ in range(300):
        a, b = grown(r.randint(1, 9)), grown(r.randint(1, 9))
        assert trees.distance(trees.postorder(text(a)), trees.postorder(text(b))) == _trees_by_recursion(a, b)


def test_tree_distance_without_a_document(spark):
    rows = [("1", "<a><b/></a>", "<a/>"), ("2", "<a/>", None), ("3", None, "<a/>"), ("4", "<a/>", "<a"), ("5", "<a", "<a/>"), ("6", "<a xmlns='u'/>", "<a/>"), ("7", "<a/>", "<a/>")]
    got = trees.tree_distance(spark.createDataFrame(rows, "id string, a string, b string").coalesce(1), "id", "a", "b").collect()
    assert {r.id: r.distance for r in got} == {"1": 1, "2": None, "3": None, "4": None, "5": None, "6": 1, "7": 0}


def test_findings_are_made_once(spark):
    """No filter on the findings' number below the rows of findings, which would make them all twice."""
    t = nodes.bt_trees(spark.createDataFrame([("1", "<a/>")], "tree_id string, xml string"))
    for found in (validate.issues(t), validate.port_issues(t), navigation.issues(t)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Filter (size(" not in plan and "Filter ((size(" not in plan


def test_bodies_across_batches():
    """Documents that end with a batch, go over into the next or fill several, flags in their order, lines in theirs."""
    rows = [(1, "N", 1, "a"), (1, "A", 2, "b"), (1, "N", 4, "c"), (2, "R", 1, "d"), (3, "é", 1, "e"), (3, "N", 2, ""), (3, "N", 3, "g"), (3, "A", 5, "h"), (5, "N", 2, "i")]
    want = {1: "<Fallback>b</Fallback><Sequence>ac</Sequence>", 2: "<Fallback>d</Fallback>", 3: "<Fallback>h</Fallback><Sequence>g</Sequence><Fallback>e</Fallback>", 5: "<Sequence>i</Sequence>"}
    for size in range(1, 11):
        for first in range(size):
            cuts = [0, *range(first, len(rows), size), len(rows)]
            parts = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a:b])], names=list("kfsl")) for a, b in zip(cuts, cuts[1:]) if a < b]
            got = [r for b in assemble.bodies(iter(parts)) for r in b.to_pylist()]
            assert {r["tree_id"]: r["body"] for r in got} == want and len(got) == 4
    with pytest.raises(RuntimeError):
        list(assemble.bodies(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(rows[1], rows[0])], names=list("kfsl"))])))
