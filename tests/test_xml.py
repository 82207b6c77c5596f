import pytest

from arbolita.functions import trees
from arbolita.operators import navigation, nodes, sinks, validate
from arbolita.operators.catalog import SKILLS
from arbolita.sources import files


def leaf(skill, **ports):
    _, _, tag, spec = next(s for s in SKILLS if s[1] == skill)
    attrs = {p: d for p, _, d, _ in spec} | ports
    return f'<{tag} ID="{skill}" ' + " ".join(f'{k}="{v}"' for k, v in attrs.items() if v is not None) + "/>"


def tree(body, fmt='BTCPP_format="4"'):
    return f'<root {fmt}><BehaviorTree ID="m"><Sequence>{body}</Sequence></BehaviorTree></root>'


GOOD = leaf("LoadMission") + leaf("PassMotionParameters") + leaf("MoveAndStop")
CASES = {
    "good": (tree(GOOD), True, 1.0, []),
    "null": (None, False, 0.0, ["xml_parse"]),
    "unclosed": ("<root><a>", False, 0.0, ["xml_parse"]),
    "leading blank": (" <?xml version='1.0'?>" + tree(GOOD), True, 1.0, []),
    "doctype": ("<!DOCTYPE x>" + tree(GOOD), False, 0.0, ["xml_parse"]),
    "root": ("<top>" + GOOD + "</top>", False, 0.0, ["root_tag"]),
    "unknown tag wins": (tree(GOOD + "<Odd/><Action ID='Nope'/>"), False, 0.0, ["unknown_tag"]),
    "unknown skill": (tree(GOOD + "<Action ID='Nope'/>"), False, 0.0, ["unknown_skill"]),
    "no stop": (tree(leaf("LoadMission")), False, 0.0, ["no_move_and_stop"]),
    "format": (tree(GOOD, ""), True, 0.9, ["btcpp_format"]),
    "depth then thin": (tree(GOOD + "<Sequence>" * 12 + "<Fallback>" + leaf("Pause") + "</Fallback>" + "</Sequence>" * 12), False, 0.5, ["too_deep", "thin_fallback"]),
    "depth 12": (tree(GOOD + "<Sequence>" * 9 + leaf("Pause") + "</Sequence>" * 9), True, 1.0, []),
    "depth 13": (tree(GOOD + "<Sequence>" * 11 + leaf("Move") + "</Sequence>" * 11), False, 0.0, ["too_deep"]),
    "prerequisite": (tree(leaf("CreatePath") + GOOD + leaf("ProjectPointOnNetwork")), True, 0.9, ["prerequisite"]),
    "prerequisite of several trees": (tree(leaf("CreatePath") + GOOD).replace("</root>", '<BehaviorTree ID="n"/></root>'), True, 1.0, []),
    "tree not below root": ('<root BTCPP_format="4"><Sequence><BehaviorTree ID="m">' + GOOD + "</BehaviorTree><Fallback/></Sequence></root>", False, 0.0, ["no_behavior_tree"]),
    "format and unknown": (tree("<Odd/>" + GOOD, ""), False, 0.0, ["unknown_tag"]),
    "action of a condition's name": (tree(GOOD + '<Action ID="MissionTerminated"/>'), True, 1.0, []),
    "port of a skill without ports": (tree(GOOD + '<Action ID="ManageMeasurements" odd="1" name="x"/>'), True, 0.9, ["unknown_port"]),
    "type and domain": (tree(GOOD + leaf("CheckCurrentStepType", type_to_be_checked="1.5")), True, 0.8, ["port_type", "port_domain"]),
    "two consumers first": (tree(leaf("LoadMission") + leaf("Move") + leaf("Move") + leaf("PassMotionParameters") + leaf("MoveAndStop")), True, 0.8, ["consumer_before_producer"] * 2),
    "no producer": (tree(leaf("LoadMission") + leaf("MoveAndStop")), True, 0.9, ["consumer_before_producer"]),
    "execution without loop": (tree(GOOD).replace('ID="m"', 'ID="execute"'), True, 0.9, ["execution_loop"]),
    "execution with loop": (tree(GOOD + '<ReactiveFallback><Repeat num_cycles="-1">' + leaf("Pause") + "</Repeat>" + leaf("MissionTerminated") + "</ReactiveFallback>").replace('ID="m"', 'ID="execution"'), True, 1.0, []),
    "subtree and repeat": (tree(GOOD + "<SubTreePlus/><Repeat/>"), True, 0.6000000000000001, ["empty_control", "subtree_id", "subtree_autoremap", "repeat_cycles"]),
    "skill as tag": (tree('<LoadMission mission_file_path="{m}"/><PassMotionParameters motion_params="{p}"/><MoveAndStop motion_params="p"/>'), True, 0.9, ["port_type"]),
    "bare condition": (tree(GOOD + leaf("MissionTerminated")), True, 0.9, ["condition_outside_fallback"]),
    "covered condition": (tree(GOOD + "<Fallback>" + leaf("MissionTerminated") + leaf("Pause") + "</Fallback>"), True, 1.0, []),
    "ports": (tree(GOOD + leaf("Move", threshold_type="1.5") + leaf("Pause", duration=None, odd="1")), True, 0.6000000000000001, ["port_type", "port_domain", "missing_port", "unknown_port"]),
    "no load": (tree(leaf("PassMotionParameters") + leaf("MoveAndStop")), True, 0.9, ["no_load_mission"]),
}


def test_rules(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "tree_id string, xml string")
    parsed = nodes.bt_trees(df)
    found = {}
    for r in validate.issues(parsed).orderBy("level", "step", "pre", "sub").collect():
        found.setdefault(r.tree_id, []).append(r.code)
    assert {k: found.get(k, []) for k in CASES} == {k: v[3] for k, v in CASES.items()}
    got = {r.tree_id: (r.valid, r.score) for r in validate.verdicts(parsed).collect()}
    assert got == {k: (v[1], v[2]) for k, v in CASES.items()}


def test_enrich_twice_and_write(spark):
    df = spark.createDataFrame([("a", tree(GOOD + leaf("Pause", duration=None)))], "tree_id string, xml string")
    once = validate.enrich(nodes.bt_trees(df))
    xml = nodes.to_xml(once).first().xml
    assert 'duration="2.0"' in xml
    again = validate.enrich(nodes.bt_trees(spark.createDataFrame([("a", xml)], "tree_id string, xml string")))
    assert nodes.to_xml(again).first().xml == xml


def test_raw_mode_refuses_a_leading_blank():
    assert nodes.flatten(" <?xml version='1.0'?><root/>", "raw")[1] and not nodes.flatten(" <?xml version='1.0'?><root/>")[1]


@pytest.mark.parametrize("a, b, d", [("<r><x/><y/></r>", "<r><x/><y/></r>", 0), ("<r><x/></r>", "<r><z/></r>", 1), ("<r><x/></r>", "<r><x/><y/></r>", 1), ("<r><a><b/><c/></a></r>", "<r><b/><c/></r>", 1),
                                     ("<a/>", "<r><b/><c/></r>", 3), ("<f><d><a/><c><b/></c></d><e/></f>", "<f><c><d><a/><b/></d></c><e/></f>", 2)])
def test_edit_distance(a, b, d):
    p, q = nodes.flatten(a)[0], nodes.flatten(b)[0]
    assert trees.edit_distance(p, q) == trees.edit_distance(q, p) == d


def test_second_dialect(spark):
    bad = """<root main_tree_to_execute="a"><BehaviorTree ID="a"><Sequence><SubTree ID="b"/><SubTree ID="gone"/><Wait wait_duration="x" odd="1"/><Spin/><Sequence/><Repeat><Wait wait_duration="{t}"/></Repeat></Sequence></BehaviorTree>
    <BehaviorTree ID="b"><SubTree ID="a"/></BehaviorTree><BehaviorTree ID="c"/><BehaviorTree/><Fly/></root>"""
    n = nodes.bt_trees(spark.createDataFrame([("x", bad)], "tree_id string, xml string"))
    codes = sorted((r.code, r.detail) for r in navigation.issues(n).collect())
    assert codes == [
        ("attr_type_mismatch", "wait_duration=x"), ("blackboard_unproduced", "t"), ("bt_empty", ""), ("bt_empty", "c"), ("bt_missing_id", None), ("bt_unused_definition", "c"), ("empty_control_node", "Sequence"),
        ("missing_required_attr", "Spin.spin_dist"), ("repeat_unbounded", None), ("subtree_cycle", "a"), ("subtree_missing_definition", "gone"), ("tag_not_allowed", "Fly"), ("unknown_attr", "odd"),
    ]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"input": "go", "output": "<a/>"}\n\n{"mission": "", "prompt": "stop"}\n{"xml": "x"}\n')
    assert sorted(r.mission for r in files.read_missions(spark, str(tmp_path / "in")).collect()) == ["go", "stop"]
    (tmp_path / "src").mkdir()
    for name, text in (("b.xml", "<?xml version='1.0'?><a/>"), ("c.xml", "<a/>"), ("d.txt", "no")):
        (tmp_path / "src" / name).write_text(text)
    corpus = files.stage0_corpus(files.scan_files(spark, str(tmp_path / "src"), ["xml"]), "rail").collect()
    assert len(corpus) == 1 and corpus[0].text.endswith("-->\n<a/>")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    sinks.append_new(df, str(tmp_path / "out"), "id")
    sinks.append_new(spark.createDataFrame([(2, "b"), (3, "c")], "id long, v string"), str(tmp_path / "out"), "id")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    runs = spark.createDataFrame([("2026-01-02_exp009",), ("2026-01-02_exp010",), ("x",)], "run_id string")
    assert sinks.next_run_id(runs, "2026-01-02") == "2026-01-02_exp011" and sinks.next_run_id(runs, "2026-01-03") == "2026-01-03_exp001"
    assert files.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
