"""Facts told from texts are those that the expressions over trees tell, on odd documents too."""

import random
from collections import Counter

import pytest

from arbolita.operators import catalog as C
from arbolita.operators import facts, metrics, navigation, nodes, reports, reward, validate
from arbolita.plans import mission_queries

ODD = [
    None, "", " ", "x", "<a", "<a/>", "<root/>", "<root></root>", "<a>&odd;</a>", "<p:a/>", "<a xml:lang='x'><b/></a>", "<a xmlns='u'><b c='1'/></a>", "<!DOCTYPE a><a/>", "﻿<root/>", " <a><b/><c><d/></c></a> ", "<a/><b/>",
    "<a></b>", "</a>", "<a><b></a></b>", "<a>]]></a>", "<a>t<![CDATA[<b/>]]></a>", "<a><!-- <b/> --></a>", "<?xml version='1.0' encoding='latin-1'?><a b='é'/>", "<a/>x", "<a>x<b/>y</a >", "<a b='>'/>", "<a b='x' b='y'/>", "<a ><b /></a\n>",
    "<a b='&lt;&#10;'/>", "<a>\x01</a>", "<root main_tree_to_execute='m'><BehaviorTree ID='m'><SubTree ID='n'/></BehaviorTree><BehaviorTree ID='n'><SubTree ID='m'/></BehaviorTree><BehaviorTree/></root>",
    "<root BTCPP_format='4'><BehaviorTree ID='m'><BehaviorTree ID='execute'><Action ID='MoveAndStop'/></BehaviorTree></BehaviorTree></root>",
    "<root><BehaviorTree><Sequence><Condition ID='MissionTerminated'/><Action ID='Pause' duration='2.0 '/><Action ID='Pause' duration=' NaN'/><Action ID='Pause' duration='１'/><Action ID='MoveAndStop' motion_params='{}'/></Sequence></BehaviorTree></root>",
    "<root>" + "<Sequence>" * 13 + "<MoveAndStop/>" + "</Sequence>" * 13 + "</root>", "<root><BehaviorTree>" + "<Action ID='MoveAndStop'/>" * 81 + "</BehaviorTree></root>",
    "<root><BehaviorTree>" + "<Sequence>" * 13 + "<MoveAndStop/>" + "</Sequence>" * 13 + "</BehaviorTree></root>",
]


def _grown(r: random.Random) -> str:
    """A document of the tags, skills and ports that rules look at."""
    skills = [s for s in C.DEFAULT.skills if r.random() < 0.6]

    def attrs(names):
        return "".join(f' {k}="{v}"' for k, v in names.items())

    def leaf():
        s = r.choice(skills or list(C.DEFAULT.skills))
        ports = {p.name: r.choice((p.default, "x1", "{a}", "{}", "7", "1_0", "2.5e3", "nan")) for p in s.ports if r.random() < 0.8}
        ports |= {k: r.choice(("{v}", "1", "")) for k in ("name", "price") if r.random() < 0.1}
        name = "Fly" if r.random() < 0.01 else "" if r.random() < 0.01 else s.name
        kind = r.random()
        if kind < 0.04:
            return f"<{s.name}{attrs(ports)}/>"
        if kind < 0.09:
            return f"<SubTreePlus{attrs({k: v for k, v in {'ID': 'a', '__autoremap': 'TRUE'}.items() if r.random() < 0.6})}/>"
        if kind < 0.13:
            return f"<SubTree{attrs({'ID': r.choice(('main', 'execute', 'b', ''))})}/>"
        if kind < 0.15:
            return f"<Wait{attrs({k: r.choice(('1', 'x', '{w}')) for k in ('wait_duration', 'name', 'odd') if r.random() < 0.6})}/>"
        return f"<{s.tag if r.random() < 0.9 else r.choice(('Action', 'Condition'))} ID=\"{name}\"{attrs(ports)}/>"

    def control(deep):
        tag = r.choice(("Sequence", "Sequence", "Fallback", "ReactiveFallback", "Parallel", "Repeat"))
        body = "".join(control(deep - 1) if deep and r.random() < 0.3 else leaf() for _ in range(r.choice((0, 1, 2, 3, 4, 5))))
        given = {"num_cycles": r.choice(("-1", "3", "x"))} if tag == "Repeat" and r.random() < 0.7 else {"name": "n"} if r.random() < 0.1 else {}
        return f"<{tag}{attrs(given)}>{body}</{tag}>"

    def tree():
        given = {"ID": r.choice(("main", "execute", "execution", "b", ""))} if r.random() < 0.9 else {}
        stop = '<Action ID="MoveAndStop"/>' if r.random() < 0.8 else ""
        return f"<BehaviorTree{attrs(given)}>{''.join(control(3) for _ in range(r.choice((1, 1, 2, 3))))}{stop}</BehaviorTree>"

    root = "root" if r.random() < 0.97 else "BehaviorTree"
    given = {k: v for k, v in {"BTCPP_format": r.choice("34"), "main_tree_to_execute": r.choice(("main", "b"))}.items() if r.random() < 0.8}
    text = f"<{root}{attrs(given)}>{''.join(tree() for _ in range(r.choice((1, 1, 1, 2, 3))))}</{root}>"
    return text.replace("><", ">\n <") if r.random() < 0.3 else text if r.random() < 0.97 else text[:-3]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(11)
    texts = [*ODD, *(_grown(r) for _ in range(700))]
    return spark.createDataFrame(list(enumerate(texts)), "tree_id long, xml string").repartition(2).cache()


@pytest.mark.parametrize(
    ("new", "old", "keep"),
    [
        (facts.evaluated, reports.evaluated, ()), (facts.hallucination, metrics.hallucination, ()), (facts.port_completeness, metrics.port_completeness, ()), (facts.browser, metrics.browser, ("xml",)),
        (facts.inventory, metrics.inventory, ()), (facts.checklist, navigation.checklist, ()),
    ],
)
def test_same_facts_as_of_trees(docs, new, old, keep):
    got, want = new(docs), old(nodes.bt_trees(docs, keep=keep))
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("enriched", [False, True])
def test_same_findings_as_of_trees(docs, enriched):
    rules = facts.Rules(enriched=enriched)
    reader = facts.Reader(rules.facts)
    trees = nodes.bt_trees(docs)
    want = {r.tree_id: list(map(tuple, r.issues)) for r in validate.checked(validate.enrich(trees) if enriched else trees).collect()}
    got = {str(r.tree_id): rules.findings(*reader.read(r.xml)) for r in docs.collect()}
    assert got == want
    assert len({x[2] for found in want.values() for x in found}) >= (18 if enriched else 19)  # codes that the documents lead to


def test_same_trees_as_flatten():
    r = random.Random(3)
    for mode in ("stripped", "raw"):
        reader = facts.Reader(lambda e: None, mode)
        for text in [*ODD, *(_grown(r) for _ in range(100))] * 2:
            t, error = reader.read(text)
            rows, why = nodes.flatten(text, mode)
            got = [] if t is None else [(p, up, d, e.tag, e.skill, list(e.attrs.items()), n) for p, up, d, e, n in zip(t.post, t.parent, t.depth, t.elements, t.children)]
            assert (got, error) == ([(x[1], x[2], *x[4:]) for x in rows], why)


def test_kept_elements_are_bounded(monkeypatch):
    monkeypatch.setattr(facts, "KEPT", 10)
    reader = facts.Reader(lambda e: None)
    for k in range(50):
        assert reader.read(f'<root><a b="{k}"/></root>')[0].elements[1].attrs == {"b": str(k)}
        assert len(reader.kept) <= 10


def test_port_report_of_texts(spark, docs):
    rows = reports.commonest(spark, facts.port_counts(docs), top=9)
    want = reports.port_report(nodes.bt_trees(docs), top=9)
    assert rows.dtypes == want.dtypes and rows.collect() == want.collect()
    assert reports.commonest(spark, facts.port_counts(docs.limit(0))).collect() == []


@pytest.mark.parametrize("name", ["feedback", "rewards", "metrics", "statistics", "summary", "inventory", "checklist", "browser_metrics", "hallucination", "port_completeness"])
def test_no_elements_in_plans(spark, name):
    """Documents, then one pass over their texts; expressions over arrays of elements are what grew past the limit."""
    plan = getattr(mission_queries, f"mission_{name}")(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "(nodes#" not in plan


def test_port_report_makes_documents_once(spark, monkeypatch):
    made = Counter()
    original = facts.port_counts
    monkeypatch.setattr(facts, "port_counts", lambda *a, **k: made.update(["made"]) or original(*a, **k))
    mission_queries.mission_port_report(spark, "/root/testdata/sf0.001")
    assert made["made"] == 1


def test_rewards_without_documents(spark):
    rows = [("1", "Transport", None), ("2", None, "none"), ("3", "Inspection", "<root><a>"), ("4", "simulation", "a <root><BehaviorTree><Action ID=\"MoveAndStop\"/></BehaviorTree></root> b")]
    df = spark.createDataFrame(rows, "id string, mission string, completion string")
    got = {r.id: (r.reward, r.r_hallucination) for r in reward.rewards(df).collect()}
    assert got["1"] == got["2"] == (-1.0, None) and got["3"][1] == 0.0 and got["4"][1] == 1.0
    told = {r.id: (r.dense_score, r.valid, r.skills_used) for r in reward.feedback(df).collect()}
    assert told["1"] == told["2"] == told["3"] == (-1.0, False, []) and told["4"][1:] == (True, ["MoveAndStop"])
