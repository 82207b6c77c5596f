from pyspark.sql import functions as F

from arbolita.operators import corpus, nodes
from arbolita.operators import generate as G


def test_steps(spark):
    raw = [
        ("ok", '```json\n[{"skill": "Wait", "params": {"seconds": 3}}, {"skill": "Spin", "params": {"rad": "1.5", "spin_dist": "2"}}]\n```'), ("text", "no"), ("dict", '{"a": 1}'),
        ("skill", '[{"skill": "Fly", "params": {}}]'), ("port", '[{"skill": "Wait", "params": {}}]'), ("empty", "[]"), ("null", None),
    ]
    got = G.parse_steps(spark.createDataFrame(raw, "id string, raw string")).withColumn("xml", G.steps_to_xml(F.col("steps")))
    by = {r.id: r for r in got.collect()}
    assert {k: r.fault for k, r in by.items()} == {"ok": None, "text": "non_json", "dict": "other", "skill": "skill_not_allowed", "port": "missing_required_port", "empty": "other", "null": "non_json"}
    assert '<Wait wait_duration="3"/><Spin rad="1.5" spin_dist="2"/>' in by["ok"].xml
    assert nodes.flatten(by["ok"].xml)[1] is None


def test_json_and_degraded(spark):
    df = spark.createDataFrame([("a", '{"kind": "root", "children": [{"kind": "Action", "attrs": {"ID": "MoveAndStop"}}]}'), ("b", "no"), ("c", None)], "id string, j string")
    got = {r.id: r.xml for r in G.json_to_xml(df, "id", "j").collect()}
    assert got == {"a": '<root><Action ID="MoveAndStop" /></root>', "b": None, "c": None}
    xml = '<root><Action ID="Move" motion_params="{p}"/><Action ID="MoveAndStop" motion_params="{p}"/></root>'
    made, cut = spark.range(1).select(corpus.degraded(F.lit(xml), F.lit("s")), corpus.degraded(F.lit("<a/>"), F.lit("s"))).first()
    got = {m.kind: m.xml for m in made}
    assert got.pop("unknown_skill") in (xml.replace('"Move"', '"MoveXZ"'), xml.replace('"MoveAndStop"', '"MoveAndStopXZ"'))
    assert got == {"no_stop": '<root><Action ID="Move" motion_params="{p}"/></root>', "no_motion_params": '<root><Action ID="Move"/><Action ID="MoveAndStop" motion_params="{p}"/></root>'}
    assert [tuple(m) for m in cut] == [("cut_off", "<a")]


def test_boundary_and_missions(spark):
    t = spark.createDataFrame([([1, 2, 3, 2, 3, 4], [2, 3]), ([1], [2, 3])], "a array<int>, b array<int>")
    assert [x[0] for x in t.select(G.boundary(F.col("a"), F.col("b"))).collect()] == [5, None]
    kinds = [("a", 3, "to km {k}"), ("b", 1, "stop")]
    one, two = (sorted(map(tuple, G.missions(spark, 400, 7, kinds).collect())) for _ in range(2))
    assert one == two and len(one) == 400 and 240 < sum(x[1] == "a" for x in one) < 360
    assert "MoveAndStop" in G.grammar()
