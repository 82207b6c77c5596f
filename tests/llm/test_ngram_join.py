import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from arbolita.llm import ngram_join as J
from arbolita.llm.wu_manber import normal
from tests.llm.edges import edge, empty


def brute(rows, n, t):
    sets = defaultdict(set)
    for i, text in rows:
        w = normal(text).split() if text and i is not None else []
        if w:
            k = min(n, len(w))
            sets[frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1))].add(i)
    reps = [(min(v), k) for k, v in sets.items()]
    want = {(min(v), x) for v in sets.values() for x in v if x != min(v)}
    for a in range(len(reps)):
        for b in range(a):
            (i, x), (j, y) = reps[a], reps[b]
            if Fraction(len(x & y), len(x | y)) >= t and i != j:
                want.add((min(i, j), max(i, j)))
    return want


def corpus(seed, size, length, words=40):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    passage = r.choices(vocabulary, k=12)
    rows = []
    for i in range(size):
        if rows and r.random() < 0.5:
            w = (r.choice(rows)[1] or "x").split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            if r.random() < 0.3:
                w.append(r.choice(vocabulary))
        else:
            w = r.choices(vocabulary, k=r.randint(1, length))
            if r.random() < 0.4:
                w = passage + w
        rows.append((i, " ".join(w)))
    return rows


def expected(rows, n, t):
    """(id, class, copies, links) of every id and distinct text, from all pairs of texts."""
    sets = {}
    for i, text in rows:
        if i is not None:
            w = normal(text).split() if text else []
            k = min(n, len(w))
            key = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else i
            sets.setdefault(key, set()).add(i)
    some = [k for k in sets if isinstance(k, frozenset)]
    links = {k: [o for o in some if o != k and Fraction(len(k & o), len(k | o)) >= t] for k in some}
    least = {i: i for v in sets.values() for i in v}
    changed = True
    while changed:
        changed = False
        for k, v in sets.items():
            ids = v.union(*(sets[o] for o in links.get(k, ())))
            low = min(least[i] for i in ids)
            for i in ids:
                changed |= least[i] != low
                least[i] = low
    return sorted((i, least[i], len(v) - 1, len(links.get(k, ()))) for k, v in sets.items() for i in v)


def found(df, *args):
    return sorted((r.doc_id, r.class_id, r.n_copies, r.n_links) for r in J.classes(df, *args).collect())


@pytest.mark.parametrize("seed, length, t", [(1, 12, Fraction(13, 20)), (2, 90, Fraction(13, 20)), (3, 30, Fraction(1, 2)), (4, 40, Fraction(9, 10)), (5, 4, Fraction(1, 2)), (6, 60, Fraction(3, 10))])
def test_against_brute_force(spark, seed, length, t):
    rows = corpus(seed, 150, length)
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), 3, t) == expected(rows, 3, t)


@pytest.mark.parametrize("small", [False, True])
def test_near_copies_and_repeats(spark, monkeypatch, small):
    """A thousand near copies, copies, ids with several texts and equal rows; with blocks, buckets and rounds in use too."""
    if small:
        for name, value in (("BLOCK_SETS", 150), ("TASK_PAIRS", 100), ("BLOCK_PAIRS", 200), ("BUCKET_BYTES", 20_000), ("LOCAL_EDGES", 3), ("BROADCAST_IDS", 3), ("_FLUSH", 500)):
            monkeypatch.setattr(J, name, value)
    r = random.Random(11)
    rows = corpus(7, 120, 30)
    text = [f"g{k}" for k in range(60)]
    near = 1000 if not small else 400
    for k in range(near):
        w = list(text)
        for _ in range(r.randint(1, 4)):
            w[r.randrange(60)] = f"h{r.randrange(50)}"
        rows.append((10_000 - k, " ".join(w)))
    rows += [(20_000 + k, " ".join(text)) for k in range(15)] + [(5, " ".join(text)), (3, "one text"), (3, "quite another text, of that id"), rows[40], rows[40]]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows, 3, J.THRESHOLD)


def test_shared_passage(spark):
    """Many texts that share a passage and are not similar: lists of several groups."""
    r = random.Random(13)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(i, passage + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(r.randint(0, 40)))) for i in range(200)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows, 3, J.THRESHOLD)


def test_overlaps_against_sets():
    r = random.Random(14)
    for m in (2, 3, 60, 130):
        sets = [sorted(r.sample(range(300), r.randint(0, 80))) for _ in range(m)]
        got = J._overlaps([np.array(x, np.int64) for x in sets])
        assert all(got[i, j] == len(set(sets[i]) & set(sets[j])) for i in range(m) for j in range(m) if i != j)


def test_edges(spark):
    df = edge(spark)
    assert found(df) == expected([(r.doc_id, r.text) for r in df.collect()], 3, J.THRESHOLD)
    kept = J.keep_one_of_each(df)
    assert kept.schema == df.schema
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8]


def test_ids_of_any_type(spark):
    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([("a", text), ("b", text), ("c", text + " eleven"), ("d", "alone"), (None, text)], "doc_id string, text string")
    got = {r.doc_id: r for r in J.classes(df).collect()}
    assert {i: (x.n_copies, x.n_links) for i, x in got.items()} == {"a": (1, 1), "b": (1, 1), "c": (0, 1), "d": (0, 0)}
    assert len({got[i].class_id for i in "abc"}) == 1 and got["a"].class_id in "abc" and got["d"].class_id == "d"
    kept = [r.doc_id for r in J.keep_one_of_each(df).collect()]
    assert sorted(map(str, kept)) == sorted(["None", "d", got["a"].class_id])


def test_empty(spark):
    assert J.classes(empty(spark)).count() == 0
    assert J.keep_one_of_each(empty(spark)).count() == 0


def test_boundary_follows_cost():
    assert J.boundary({10: 1000}, 1.0) <= J.boundary({10: 1000}, 500.0)
    sizes = {s: 1000 // s for s in range(1, 400)}

    def cost(x, length):
        least = lambda s: -(-13 * s // 20)
        return sum(m * math.comb(s - least(s) + 2, 2) for s, m in sizes.items() if s <= x) + sum(m * (s - least(s) + 4) * (1 + length / 2) for s, m in sizes.items() if s >= least(x + 1))

    for length in (0.0, 3.0, 40.0, 1e4):
        assert cost(J.boundary(sizes, length), length) == pytest.approx(min(cost(x, length) for x in range(4, 400)))


@pytest.mark.parametrize("local", [1_000_000, 0])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(J, "LOCAL_EDGES", local)
    pairs = [(1, 2), (2, 3), (10, 11), (12, 11), (5, 4), (20, 3), *((100 + k, 101 + k) for k in range(40)), *((500, 600 + k) for k in range(30)), (7, 7)]
    got = {r.id: r.group for r in J.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 20: 1, 10: 10, 11: 10, 12: 10, 4: 4, 5: 4, **{k: 100 for k in range(100, 141)}, **{k: 500 for k in (500, *range(600, 630))}}
    assert J.components(spark.createDataFrame([], "u long, v long")).count() == 0
