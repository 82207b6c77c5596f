import math
import random
from collections import Counter

import pytest

from arbolita.llm import license_scan as L
from tests.llm.edges import edge, empty


def brute(rows, least=L.LEAST_COSINE):
    """Own licences by comparing every block with every template; inheritance by walking up."""
    terms = {w for _, t in L.TEMPLATES for w in L.normal(t).split()}
    df = Counter(w for _, _, t in rows for w in set(L.normal(t or "").split()))
    idf = lambda w: math.log((1 + len(rows)) / (1 + df.get(w, 0))) + 1

    def vector(words):
        v = {w: n * idf(w) for w, n in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    templates = [(n, vector(L.normal(t).split())) for n, t in sorted(L.TEMPLATES)]
    own, speaks = {}, {}
    for i, path, text in rows:
        lines = [w for w in (L.normal(x).split() for x in (text or "").split("\n")) if w]
        blocks, held = list(lines), []
        for w in [*lines, []]:
            if w and 2 * sum(x in terms for x in w) >= len(w):
                held.append(w)
            else:
                if len(held) > 1:
                    blocks.append([x for h in held for x in h])
                held = []
        best = None
        for b in blocks:
            v = vector(b)
            for n, t in templates:
                c = round(sum(x * v.get(w, 0) for w, x in t.items()), 9)
                if c >= least and (best is None or c > best[1]):
                    best = n, c, len(b) / sum(map(len, lines))
        if best:
            own[i] = best
            if path and (best[2] >= 0.5 or L.LICENCE_FILE.match(path.split("/")[-1])):
                d = path.rpartition("/")[0]
                if d not in speaks or (best[1], [-ord(c) for c in best[0]]) > (speaks[d][1], [-ord(c) for c in speaks[d][0]]):
                    speaks[d] = best
    out = {}
    for i, path, _ in rows:
        d = None if path is None else path.rpartition("/")[0]
        if i in own:
            out[i] = (own[i][0], "own")
            continue
        out[i] = (None, "none")
        while d is not None:
            if d in speaks:
                out[i] = (speaks[d][0], "inherited")
                break
            d = d.rpartition("/")[0] if d else None
    return out


def test_against_brute_force(spark):
    r = random.Random(9)
    words = "ther of the ing version under river stone permission".split()
    rows = []
    for i in range(150):
        d = "/".join(r.choices("abc", k=r.randint(0, 4)))
        name, text = f"f{i}.txt", "\n".join(" ".join(r.choices(words, k=9)) for _ in range(4))
        if r.random() < 0.15:
            text = r.choice(L.TEMPLATES)[1]
            name = r.choice(["LICENSE", "COPYING.md", name])
        elif r.random() < 0.2:
            text += "\n" + r.choice(L.TEMPLATES)[1] + r.choice(["", "."])
        rows.append((i, f"{d}/{name}" if d else name, text))
    got = {x.doc_id: (x.licence, x.how) for x in L.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == brute(rows)
    assert {"own", "inherited"} <= {how for _, how in got.values()}


def test_edges(spark):
    df = edge(spark).withColumnRenamed("source", "path")
    got = L.scan(df).collect()
    assert len(got) == df.count() and {x.how for x in got} == {"none"}
    assert L.scan(empty(spark).withColumnRenamed("source", "path")).count() == 0
    rows = [(1, "LICENSE", "Released under the MIT License"), (2, "a/b/c.py", "x = 1"), (3, None, "x"), (4, "", None)]
    got = {x.doc_id: (x.licence, x.how, x.from_dir) for x in L.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "own", None), 2: ("MIT", "inherited", ""), 3: (None, "none", None), 4: ("MIT", "inherited", "")}


@pytest.mark.parametrize("known", [0, L.KNOWN_WORDS])
def test_ordinary_words_weigh_by_their_frequency(spark, monkeypatch, known):
    """A notice with words that every file has is found, at the cosine of frequencies over all words."""
    monkeypatch.setattr(L, "KNOWN_WORDS", known)
    notice = "Released under the MIT License station river house garden mountain evening"
    rows = [(k, f"d{k}/f.txt", f"station river house garden\nmountain evening w{k}") for k in range(200)]
    rows += [(500, "n/LICENSE", notice + "\n" + rows[0][2]), (501, "n/a.py", None), (502, "m/LICENSE", "Released under the MIT License q1 q2 q3 q4 q5 q6")]
    df = Counter(w for _, _, t in rows for w in set(L.normal(t or "").split()))

    def vector(text):
        v = {w: n * (math.log((1 + len(rows)) / (1 + df[w])) + 1) for w, n in Counter(L.normal(text).split()).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    a, b = vector(notice), vector("Released under the MIT License")
    want = sum(x * a.get(w, 0) for w, x in b.items())
    got = {x.doc_id: x for x in L.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert len(got) == len(rows)
    assert (got[500].licence, got[500].how) == ("MIT", "own") and got[500].cosine == pytest.approx(want, abs=1e-8)
    assert (got[501].licence, got[501].how, got[501].from_dir) == ("MIT", "inherited", "n")
    assert got[502].how == "none"


def test_templates_from_a_table_and_ids_of_any_type(spark, monkeypatch):
    files = spark.createDataFrame([("u-1", "a/LICENSE", "these are the house rules of the river"), ("u-2", "a/b.c", "int x;"), (None, None, None)], "doc_id string, path string, text string")
    templates = spark.createDataFrame([("house", "These are the house rules of the river!"), (None, "x"), ("y", None)], "licence string, text string")
    got = {x.doc_id: (x.licence, x.how) for x in L.scan(files, templates).collect()}
    assert got == {"u-1": ("house", "own"), "u-2": ("house", "inherited"), None: (None, "none")}
    monkeypatch.setattr(L, "MOST_TEMPLATES", 2)
    with pytest.raises(ValueError):
        L.scan(files, templates)


def test_every_template_is_found_as_its_own(spark):
    rows = [(k, f"d{k}/f", text) for k, (_, text) in enumerate(L.TEMPLATES)]
    got = {x.doc_id: x.licence for x in L.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {k: name for k, (name, _) in enumerate(L.TEMPLATES)}
