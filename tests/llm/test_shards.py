import random
from collections import defaultdict

import pytest

from arbolita.llm import shards as S
from tests.llm.edges import edge, empty


def brute(rows, k):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    low = -(1 << 63)
    order = sorted(groups, key=lambda t: min(low if i is None else i for i in groups[t]))
    size = [len(groups[t]) * len((t or "").encode()) for t in order]

    def fill(cap):
        shard, load, out = 0, 0, []
        for w in size:
            if load + w > cap:
                shard, load = shard + 1, 0
            load += w
            out.append(shard)
        return out

    cap = max(size, default=0)
    while size and fill(cap)[-1] + 1 > k:
        cap += 1
    return sorted((repr(i), s, cap) for t, s in zip(order, fill(cap)) for i in groups[t])


@pytest.mark.parametrize("most", [0, S.LOCAL_SIZES])
@pytest.mark.parametrize("seed, n, k", [(1, 60, 5), (2, 60, 1), (3, 40, 100), (4, 90, 13)])
def test_against_brute_force(spark, seed, n, k, most, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 7)
    monkeypatch.setattr(S, "LOCAL_SIZES", most)
    r = random.Random(seed)
    rows = [(i, r.choice(["same", "ü" * r.randint(0, 90), "x" * r.randint(0, 60), None])) for i in range(n)]
    got = S.assign(spark.createDataFrame(rows, "doc_id long, text string"), k).collect()
    assert sorted((repr(x.doc_id), x.shard, x.capacity) for x in got) == brute(rows, k)


def test_edges(spark):
    df = edge(spark)
    got = S.assign(df, 4).collect()
    rows = [(x.doc_id, x.text) for x in df.collect()]
    assert sorted((repr(x.doc_id), x.shard, x.capacity) for x in got) == brute(rows, 4)
    assert S.assign(empty(spark), 4).count() == 0
    none = spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id long, text string")
    assert {x.shard for x in S.assign(none, 4).collect()} == {0}


def test_windows_hold_every_cut():
    """Every cut that greedy filling makes at any capacity of the range is in a block that would be fetched; few are."""
    import numpy as np

    r = random.Random(3)
    fewest = 1.0
    for _ in range(60):
        weights = [r.randint(0, r.choice([3, 20, 90])) for _ in range(r.randint(1, 900))]
        shards, block = r.randint(1, 9), r.randint(1, 9)
        parts = [np.array(weights[k : k + block]) for k in range(0, len(weights), block)]
        ends = np.cumsum([int(p.sum()) for p in parts])
        heaviest, total = max(weights), sum(weights)
        lo = max(heaviest, -(-total // shards))
        hi = max(lo, -(-total // shards) + heaviest)
        near = set(S.near_cuts(ends, lo, hi, heaviest, shards).tolist())
        sizes = {b: np.cumsum(p) for b, p in enumerate(parts)}
        for c in range(lo, hi + 1):
            found = S.cuts(sizes, ends, c, shards)
            assert {b for b, _ in found} <= near
            at, load, want = [], 0, 0
            for b, p in enumerate(parts):
                for k, w in enumerate(p.tolist()):
                    if load + w > c:
                        at.append((b, k))
                        load = 0
                    load += w
            assert found == at[:shards]
        fewest = min(fewest, len(near) / len(parts))
    assert fewest < 0.5


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("b", "xx"), ("a", "yyy"), ("c", "xx"), (None, "z")], "doc_id string, text string")
    got = {x.doc_id: x.shard for x in S.assign(df, 3).collect()}
    assert set(got) == {"a", "b", "c", None} and got["b"] == got["c"] and got[None] == 0
