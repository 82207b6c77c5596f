import random

from arbolita.llm import wu_manber as W
from tests.llm.edges import edge, empty, row

BENCH = "item_id long, text string, doc_id long, n_matched long"


def test_search_against_find():
    r = random.Random(5)
    for _ in range(60):
        text = "".join(r.choices("ab ", k=r.randint(0, 3000))).encode()
        patterns = list({"".join(r.choices("ab ", k=r.randint(3, 12))).encode() for _ in range(20)})
        want = sorted((k, i) for k, p in enumerate(patterns) for i in range(len(text)) if text.startswith(p, i))
        assert sorted(W.WuManber(patterns).find(text)) == want


def brute(docs, items, n):
    out = set()
    for d, text in docs:
        w = W.normal(text or "").split()
        for i, t in items:
            v = W.normal(t or "").split()
            k = min(n, len(v))
            grams = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if v else set()
            hit = {g for g in grams if any(tuple(w[j : j + k]) == g for j in range(len(w) - k + 1))}
            if hit:
                out.add((d, i, len(hit), len(hit) / len(grams)))
    return out


def test_against_brute_force(spark):
    r = random.Random(2)
    words = [f"{a}{b}" for a in "xyzé" for b in "abc"]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 25)))) for i in range(12)] + [(90, None), (91, ""), (92, "!!")]
    docs = []
    for d in range(80):
        w = r.choices(words, k=r.randint(0, 300))
        if d % 3 == 0:
            v = items[d % 12][1].upper().split()
            w += v[: r.randint(1, len(v))]
        docs.append((d, r.choice([" ", "\n", ", ", " — "]).join(w)))
    bench = spark.createDataFrame([(i, t, 1, 1) for i, t in items], BENCH)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(x.doc_id, x.item_id, x.n_matched, x.coverage) for x in W.contaminated(df, bench).collect()}
    assert got == brute(docs, items, 8)
    kept = {x.doc_id for x in W.drop_contaminated(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {x[0] for x in got}


def test_edges(spark):
    bench = spark.createDataFrame([(1, "then the dog came in from the rain", 1, 1), (1, "then the dog came in from the rain", 1, 1), (None, None, 1, 1)], BENCH)
    got = sorted((x.doc_id, x.item_id, x.n_matched, x.coverage) for x in W.contaminated(edge(spark), bench).collect())
    assert got == [(1, 1, 1, 1.0), (6, 1, 1, 1.0), (6, 1, 1, 1.0)]
    kept = W.drop_contaminated(edge(spark, [row(9, "fine")]), bench)
    assert kept.schema == edge(spark).schema
    assert sorted((x.doc_id or 0) for x in kept.collect()) == [0, 2, 3, 4, 5, 7, 8, 9]


def test_empty(spark):
    none = spark.createDataFrame([], BENCH)
    assert W.contaminated(edge(spark), none).count() == 0
    assert W.contaminated(empty(spark), spark.createDataFrame([(1, "a b", 1, 1)], BENCH)).count() == 0
    assert W.drop_contaminated(edge(spark), none).count() == edge(spark).count()


def test_groups_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(W, "GROUP_BYTES", 40)
    bench = spark.createDataFrame([(1, "the cat sat on the mat and then the dog came in", 1, 1)], BENCH)
    got = [(x.doc_id, x.n_matched, round(x.coverage, 9)) for x in W.contaminated(edge(spark).where("doc_id = 1"), bench).collect()]
    assert got == [(1, 5, 1.0)]


def test_repeated_rows_and_null_ids_with_several_groups(spark):
    """A short item beside a long one makes two groups; each document row still gives its own row."""
    long = "the cat sat on the mat and then the dog came in"
    bench = spark.createDataFrame([(1, long, 1, 1), (1, "qq zz", 1, 1), (2, "qq zz", 1, 1)], BENCH)
    assert len(W._groups([(1, long), (1, "qq zz"), (2, "qq zz")], 8)) == 2
    docs = [(6, f"{long} qq zz"), (6, f"{long} qq zz"), (None, f"x {long}"), (None, "y qq zz"), (7, "the dog")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((x.doc_id or 0, x.item_id, x.n_matched, round(x.coverage, 9)) for x in W.contaminated(df, bench).collect())
    part = lambda k: round(k / 6, 9)
    assert got == [(0, 1, 1, part(1)), (0, 1, 5, part(5)), (0, 2, 1, 1.0), (6, 1, 6, 1.0), (6, 1, 6, 1.0), (6, 2, 1, 1.0), (6, 2, 1, 1.0)]


def test_ids_of_any_type(spark):
    words = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([("u-1", words), (None, "zero " + words), ("u-2", "x")], "doc_id string, text string")
    items = spark.createDataFrame([("i-1", words), (None, words), ("i-2", None)], "item_id string, text string")
    got = sorted((str(r.doc_id), str(r.item_id), r.n_matched) for r in W.contaminated(docs, items).collect())
    assert got == [("None", "None", 2), ("None", "i-1", 2), ("u-1", "None", 2), ("u-1", "i-1", 2)]
    assert [r.doc_id for r in W.drop_contaminated(docs, items).collect()] == ["u-2"]
