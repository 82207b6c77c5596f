import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbolita.llm import ecoc_langid as L
from tests.llm.edges import edge, empty

WORDS = {"en": "the of and to in is that for it with as was".split(), "de": "der die und das nicht ein mit für auf über".split(),
         "fr": "le la les des une est pour dans été où".split(), "es": "el los una que por con más está niño".split()}


def texts(seed, n):
    r = random.Random(seed)
    return [(i, " ".join(r.choices(WORDS[g], k=30)), g) for i in range(n) for g in [r.choice(sorted(WORDS))]]


def test_held_out_accuracy_and_filter(spark):
    df = spark.createDataFrame(texts(1, 400), "doc_id long, text string, lang string")
    model = L.train(df, per_label=80)
    held = spark.createDataFrame(texts(2, 200) + [(999, "123 !!", "en"), (998, None, "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.identify(held, model).collect()}
    assert np.mean([got[i].predicted == g for i, _, g in texts(2, 200)]) > 0.97
    assert got[999].predicted == "und" and got[999].ambiguous and got[998].loss is None
    assert {r.doc_id for r in L.keep_identified(held, model).collect()} == {i for i, r in got.items() if not r.ambiguous}


def test_decoding_against_brute_force():
    t = texts(3, 120)
    model = L.fit([x[1] for x in t], [x[2] for x in t])
    for text in [x[1] for x in texts(4, 40)]:
        f = L.features(L.letters(text))
        scores = f @ model.weight + model.bias
        losses = [sum(w * np.logaddexp(0, -float(b) * float(s)) for b, s, w in zip(code, scores, model.bit_weight)) / sum(model.bit_weight) for code in model.code]
        language, loss, gap, _ = L._decoded([text], model, 0.1)[0]
        assert language == model.labels[int(np.argmin(losses))]
        assert abs(loss - min(losses)) < 1e-3 and abs(gap - (sorted(losses)[1] - min(losses))) < 1e-3


def test_codewords_lie_apart():
    for k in (2, 3, 4, 5, 9):
        c = L.codewords(k)
        assert len({tuple(x) for x in c}) == k
        assert min((a != b).sum() for i, a in enumerate(c) for b in c[:i]) >= c.shape[1] // 4


def test_edges(spark):
    df = edge(spark)
    model = L.train(df)
    rows = L.identify(df, model).collect()
    assert len(rows) == df.count()
    assert {r.doc_id for r in rows if r.predicted == "und"} == {2, 3, 7, 8}
    kept = L.keep_identified(df, model)
    assert kept.schema == df.schema and {2, 3, 7, 8}.isdisjoint({r.doc_id for r in kept.collect()})
    assert L.identify(empty(spark), L.train(empty(spark))).count() == 0
    assert all(r.predicted == "und" for r in L.identify(df, L.train(empty(spark))).collect())


def test_mixed_foreign_and_random_texts_are_ambiguous():
    t = texts(5, 400)
    model = L.fit([x[1] for x in t], [x[2] for x in t])
    flagged = lambda ts: np.mean([x[3] for x in L._decoded(ts, model, L.LEAST_GAP)])
    r = random.Random(6)
    mixed = [" ".join([*r.choices(WORDS[a], k=15), *r.choices(WORDS[b], k=15)]) for _ in range(100) for a, b in [r.sample(sorted(WORDS), 2)]]
    junk = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(30)) for _ in range(100)]
    foreign = ["これは日本語の文章です。今日は天気がとてもいいので散歩に行きました", "Это русский текст о погоде и о том как мы гуляли в парке", "這是一個中文句子我們今天去公園散步"]
    assert flagged([x[1] for x in texts(7, 300)]) < 0.01
    assert flagged(mixed) > 0.8 and flagged(junk) > 0.9 and flagged(foreign) == 1


def test_without_labels_texts_with_letters_stay(spark):
    df = edge(spark).withColumn("lang", F.lit(None).cast("string"))
    model = L.train(df)
    got = L.identify(df, model).collect()
    assert all(r.predicted == "und" for r in got)
    assert {r.doc_id for r in got if r.ambiguous is None} == {1, 4, 5, 6, None} and all(r.ambiguous for r in got if r.doc_id in (2, 3, 7, 8))
    assert sorted(r.doc_id or 0 for r in L.keep_identified(df, model).collect()) == [0, 1, 4, 5, 6, 6]


def test_sample_is_bounded(spark):
    """Null ids, one repeated id, equal rows, many labels: at most per_label of each, and every label is there."""
    rows = [(None, f"text of number {k} here", "en") for k in range(3000)] + [(7, f"zahl {k} da", "de") for k in range(3000)] + [(8, "toujours la même", "fr")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [r.y for r in L.sample(df, 50).collect()]
    assert {y: got.count(y) for y in set(got)} == {"en": 50, "de": 50, "fr": 1}
    assert L.train(df, 50).labels == ["de", "en", "fr"]
    many = df.withColumn("lang", F.concat(F.lit("l"), F.monotonically_increasing_id()))
    with pytest.raises(ValueError):
        L.sample(many, 50)


def test_bit_weights_are_held_out():
    """A brute-force count of the bits that the fitted classifiers get right on the rows they didn't see."""
    t = texts(8, 200)
    model = L.fit([x[1] for x in t], [x[2] for x in t])
    seen: dict = {}
    right, n = np.zeros(model.code.shape[1]), 0
    for _, text, g in t:
        seen[g] = seen.get(g, 0) + 1
        if seen[g] % 5 == 0:
            score = L.features(L.letters(text)) @ model.weight + model.bias
            right += score * model.code[model.labels.index(g)] > 0
            n += 1
    assert np.allclose(model.bit_weight, np.maximum(2 * right / n - 1, 0.05), atol=1e-6)


def test_ids_of_any_type_and_ties(spark):
    df = spark.createDataFrame([("u-1", "der und die das", "de"), ("u-2", "the of and", "en"), (None, "the of and", "en")], "doc_id string, text string, lang string")
    got = L.identify(df, L.train(df)).collect()
    assert {r.doc_id: r.predicted for r in got} == {"u-1": "de", "u-2": "en", None: "en"}
    flat = L.Model(["a", "b"], L.codewords(2), np.zeros((L.BUCKETS, 1), np.float32), np.zeros(1, np.float32), np.ones(1))
    assert [x[:3] for x in L._decoded(["no sign of either"], flat, None)] == [("a", np.float32(np.log(2)), 0.0)]
