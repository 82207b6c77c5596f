"""Masks, inlined trees, preference pairs, prompts and retry loops against hand-made cases and brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from arbolita.operators import corpus, generate, loop, nodes, pairs, prompts
from tests.test_xml import GOOD, leaf, tree


def test_masked_and_inlined(spark):
    xml = """<root main_tree_to_execute="a"><BehaviorTree ID="b"><Sequence><Action ID="X" name="n"/><SubTreePlus ID="a"/></Sequence></BehaviorTree>
    <BehaviorTree ID="a"><Sequence><Action ID="Y"/><Condition ID="X"/><SubTreePlus ID="b"/><SubTreePlus ID="gone"/><SubTree ID="b"/><Action ID="X"/></Sequence></BehaviorTree></root>"""
    docs = spark.createDataFrame([("d", xml), ("e", None), ("f", "<root><a>")], "tree_id string, xml string")
    rows = {r.tree_id: r.nodes for r in corpus.masked(nodes.bt_trees(docs)).collect()}
    assert rows["e"] == rows["f"] == []
    assert [n.attrs.get("ID") for n in rows["d"]] == [None, "b", None, "ACTION_1", "SUB_1", "a", None, "ACTION_2", "COND_1", "SUB_2", "SUB_3", "SUB_4", "ACTION_1"]
    assert not any("name" in n.attrs for n in rows["d"])
    got = {r.tree_id: r for r in corpus.inlined(docs).collect()}
    assert got["e"].error and got["f"].error and got["e"].nodes == []
    tags = [(n.tag, n.attrs.get("ID"), n.depth, n.post) for n in got["d"].nodes]
    assert tags == [
        ("BehaviorTree", "a", 0, 10), ("Sequence", None, 1, 10), ("Action", "Y", 2, 2), ("Condition", "X", 2, 3), ("SubTreePlus", "b", 2, 7), ("Sequence", None, 3, 7), ("Action", "X", 4, 6),
        ("SubTreePlus", "a", 4, 7), ("SubTreePlus", "gone", 2, 8), ("SubTree", "b", 2, 9), ("Action", "X", 2, 10),
    ]


def test_text_rewrites(spark):
    values = F.create_map(F.lit("x"), F.lit("{y}"), F.lit("y"), F.lit("1"))
    xml = '<root><BehaviorTree ID="execute"><Repeat num_cycles="-1"><a/></Repeat></BehaviorTree></root>'
    r = spark.range(1).select(
        corpus.fill(F.lit("a {x} {y} {z}"), values), corpus.fill(F.lit(""), values), corpus.digest16(F.lit("abc")), corpus.attribute_text(F.lit(True)), corpus.repeat_in_execution(F.lit(xml), 3),
    ).first()
    assert list(r) == ["a {y} 1 {z}", "", "ba7816bf8f01cfea", "true", xml.replace('<Repeat num_cycles="-1"', '<!-- num_cycles set to 3 --><Repeat num_cycles="3"')]


def brute(rows, strategy, k):
    out = []
    for m in {r[0] for r in rows} - {None}:
        own = sorted((r for r in rows if r[0] == m and r[4] is None), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        half = max(1, len(own) // 2)
        better = lambda a, b: a[2] is not None and b[2] is not None and a[2] > b[2]
        if strategy == "single":
            out += [(m, own[0][3], own[-1][3], "single")] if own and better(own[0], own[-1]) else []
            continue
        out += [(m, a[3], b[3], "multi") for a in own[:half] for b in own[half:] if better(a, b)][:k]
        if strategy == "augmented" and own:
            out += [(m, own[0][3], b[3], "augmented") for b in rows if b[0] == m and b[4] == own[0][1] and better(own[0], b)]
    return sorted(out)


@pytest.mark.parametrize("strategy", ["single", "multi", "augmented"])
def test_preferences(spark, strategy):
    rng = random.Random(5)
    rows = [(m, i, rng.choice([None, 0.1, 0.5, 0.5, 0.9]), f"{m}{i}", None) for m, n in (("a", 1), ("b", 2), ("c", 5), ("d", 9), ("h", 60)) for i in range(n)]
    rows += [("same", i, 0.5, f"s{i}", None) for i in range(4)] + [(None, 1, 0.5, "none", None)]
    rows += [(m, 100 + i, 0.2, f"{m}-bad{i}", i) for m in "cdh" for i in range(5)]
    df = spark.createDataFrame(rows, "mission string, idx long, score double, completion string, degraded_of long")
    got = sorted((r.mission, r.chosen, r.rejected, r.source) for r in pairs.preferences(df, strategy, 4).collect())
    assert got == brute(rows, strategy, 4)
    assert pairs.preferences(df.limit(0), strategy).count() == 0


def test_training_rows(spark, tmp_path):
    df = spark.createDataFrame([("1", "go", "c", "<a/>", "<b/>"), ("2", " ", "c", "<a/>", None), ("3", "go", "c", None, "<b/>")], "id string, mission string, category string, xml string, rejected string")
    assert [r.id for r in pairs.sft(df).collect()] == ["1"]
    assert [(r.id, r.chosen, r.rejected) for r in pairs.dpo(df).collect()] == [("1", "<a/>", "<b/>")]
    assert sorted((r.id, r.completion, r.label) for r in pairs.kto(df).collect()) == [("1_neg", "<b/>", False), ("1_pos", "<a/>", True)]
    for n in (1, 2, 1):
        pairs.write_pairs(pairs.dpo(df), str(tmp_path / "p"), n)
    assert spark.read.json(str(tmp_path / "p")).count() == 2


def test_prompts(spark):
    go = F.lit("go")
    history = F.array(F.struct(F.lit("<x/>").alias("xml"), F.lit(0.5).alias("score"), F.array(F.lit("bad")).alias("errors"), F.array().cast("array<string>").alias("warnings")))
    for mode in prompts.MODES:
        for form in prompts.FORMATS:
            got = spark.range(1).select(prompts.prompt(mode, go, form, examples=[("a", "b")])).first()[0]
            whole = got if form == "inst" else "".join(t.content for t in got)
            assert "Mission: go" in whole
            if form != "inst":
                assert (got[0].role == "system") == (form == "chat") and got[-1].role == "user"
                assert [t.role for t in got].count("assistant") == (mode == "few_shot")
    r = spark.range(1).select(prompts.prompt("react_base_agent", go, "chat", history=history), prompts.training_row(go, F.lit("<a/>"))).first()
    assert r[0][-1].content.startswith("Last attempt (score=0.50):\n```xml\n<x/>\n```\nErrors: bad\nWrite") and [t.role for t in r[1]] == ["system", "user", "assistant"]
    with pytest.raises(ValueError):
        prompts.prompt("other", go)


def test_generators(spark):
    assert re.fullmatch(generate.regex_of_leaves(), leaf("LoadMission").replace(" />", "/>").replace("  ", " ")) and not re.fullmatch(generate.regex_of_leaves(), '<Action ID="Fly"/>')
    counts = {"transport": 3, "inspection": 2, "simulation": 0}
    rows = generate.exact_counts(spark, counts, 1).collect()
    assert sorted(r.category for r in rows) == ["inspection"] * 2 + ["transport"] * 3 and generate.exact_counts(spark, counts, 1, most=4).count() == 4
    for kind in generate.STEP_PATTERNS:
        parsed = generate.parse_steps(generate.generated_steps(spark, 20, 3, kind), "steps_json").collect()
        assert len(parsed) == 20 and all(r.fault is None for r in parsed)
    can, cannot = generate.routed(generate.generated(spark, 500, 2))
    assert can.count() + cannot.count() == 500 and {r.category for r in cannot.collect()} == {"unsupported"}
    t = spark.createDataFrame([(k, f"m{k % 3}") for k in range(9)], "id long, mission string")
    assert [r.id for r in generate.distinct_missions(t, 2).collect()] == [0, 1] and [r.id for r in generate.accepted(t, F.col("id") % 4 == 1, 2).collect()] == [1, 5]


def test_retried(spark):
    good, bad = tree(GOOD), tree(leaf("LoadMission"))
    table = {("a", 1): good, ("b", 1): bad, ("b", 2): good, ("c", 1): bad, ("c", 2): "no", ("c", 3): bad}
    asked = []

    def made(pending, attempt):
        asked.append((attempt, sorted(r.id for r in pending.collect())))
        rows = [(i, x, 10 * attempt, 0.5) for (i, k), x in table.items() if k == attempt]
        return spark.createDataFrame(rows, "id string, xml string, tokens long, latency_s double")

    missions = spark.createDataFrame([(i, "Transport vers le depot") for i in "abcd"], "id string, mission string")
    got = {r.id: r for r in loop.retried(missions, made).collect()}
    assert asked == [(1, ["a", "b", "c", "d"]), (2, ["b", "c", "d"]), (3, ["c", "d"])]
    assert {i: (r.valid, r.iterations, r.tokens, r.latency_s) for i, r in got.items()} == {"a": (True, 1, 10, 0.5), "b": (True, 2, 30, 1.0), "c": (False, 3, 60, 1.5), "d": (False, 3, 0, 0.0)}
    assert got["a"].faults == "" and "no_move_and_stop" in got["c"].faults and got["d"].xml is None


def test_backing_off():
    waits, left = [], [2]

    def action():
        left[0] -= 1
        if left[0] >= 0:
            raise OSError("busy")
        return "done"

    assert loop.backing_off(action, 5, 30, waits.append) == "done" and waits == [30, 60]
    with pytest.raises(OSError):
        left[0] = 9
        loop.backing_off(action, 2, 1, waits.append)
