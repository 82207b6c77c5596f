import base64
import math
import os
import random
from collections import Counter

import pytest
import sentencepiece
import tiktoken

from arbolita.llm import fertility as Q
from tests.llm.edges import edge, empty, row

BYTE, PIECE = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken", "/opt/tokenizers/piece_bpe_32k.model"
FILES = {"byte": BYTE, "piece": PIECE}
pytestmark = pytest.mark.skipif(not os.path.exists(BYTE), reason="no vocabularies")


def encoders():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
    e = tiktoken.Encoding("own", pat_str=Q.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    return {BYTE: e.encode_ordinary, PIECE: sp.encode}


def test_measures_against_whole_texts():
    r = random.Random(6)
    texts = ["", None, "a  b\n\tc ₿é​ x  ", "\n\n x", "日本語 text", "x\0y", "if x:\n        return   y\n"]
    texts += ["".join(r.choices(" \nabXé漢1.$", k=r.randint(1, 80))) for _ in range(400)]
    for path, encode in encoders().items():
        v = Q.Vocabulary(path)
        n, f, h = Q.measured(texts, v)
        for k, t in enumerate(texts):
            ids = encode(t) if t else []
            c = Counter(ids)
            assert n[k] == len(ids) and f[k] == sum(bool(v.fallback[x]) for x in ids)
            assert h[k] == pytest.approx(-sum(x / len(ids) * math.log(x / len(ids)) for x in c.values()), abs=1e-9)


def test_bands_reject_what_stands_out(spark):
    r = random.Random(1)
    words = "the of and river mountain house garden walking slowly towards evening light".split()
    rows = [(i, " ".join(r.choices(words, k=150)), "en") for i in range(60)]
    rows += [(100, "$%&# §±≠ " * 80, "en"), (101, "x " * 200, "en"), (102, "漢字 " * 100, None)]
    got = {x.doc_id: x for x in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), FILES).collect()}
    assert all(got[i].keep for i in range(60)) and not got[100].keep and not got[101].keep
    assert got[102].band == "script Hani" and got[102].keep
    assert all(x.keep == (not x.reasons) for x in got.values())


def test_edges(spark):
    df = edge(spark, [row(9, "text in a language of its own", None)])
    rows = Q.judge(df, FILES).collect()
    assert len(rows) == df.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].byte_tokens == 0 and by[2].byte_entropy is None and by[2].keep and by[3].keep and by[9].band == "script Latn"
    assert Q.judge(empty(spark), FILES).count() == 0


def test_irregular_texts_are_cut_where_no_token_crosses():
    """Texts of rich white space: the tokens are those of the whole text, and the lexicon holds pieces, not texts."""
    v = Q.opened(FILES["byte"])
    r = random.Random(2)
    texts = ["".join(r.choices(["word", "It's", " ", "  ", "\t", "\n", "\r\n", "12", "é!", "漢字", "\0", "'ll"], k=60)) for _ in range(400)]
    whole = encoders()[BYTE]
    assert Q.measured(texts, v)[0].tolist() == [len(whole(t)) for t in texts]
    assert max(len(u) for t in texts for u in v.units(t)) < 60


def test_verdicts_against_brute_force(spark):
    """Bands and reasons from sorted lists, with ties, a small group, short texts and a null language."""
    import numpy as np

    r = random.Random(8)
    rows = []
    for i in range(160):
        lang = r.choice(["en", "en", "de", None]) if i % 40 else "xx"
        odd = r.random() < 0.1
        words = r.choices(["the", "river", "house", "walking"] if not odd else ["qzxkj", "漢字", "0x7f", "the"], k=r.choice([1, 5, 60, 150, 200]))
        rows.append((i, " ".join(words), lang))
    rows += [(500, rows[3][1], rows[3][2]), (500, rows[3][1], rows[3][2]), (501, "", "en"), (502, None, None)]
    got = Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), FILES, spread=1.0).collect()
    assert len(got) == len(rows)
    kept = 0
    for row_ in got:
        want = []
        for v in FILES:
            for m in Q.MEASURES:
                values = lambda some: sorted(x[f"{v}_{m}"] for x in some if x[f"{v}_tokens"] >= 100)
                group = values(x for x in got if x.band == row_.band)
                if len(group) < 20:
                    continue
                lo, hi = (float(np.quantile(group, q, method="inverted_cdf")) for q in (0.25, 0.75))
                wide = max(hi - lo, Q.SLACK[m])
                lo, hi = lo - wide, hi + wide
                more = (hi - lo) / 2 * 100 / max(1, row_[f"{v}_tokens"])
                if row_[f"{v}_{m}"] is not None and not lo - more <= row_[f"{v}_{m}"] <= hi + more:
                    want.append(f"{v}_{m}")
        assert row_.reasons == want and row_.keep == (not want)
        kept += row_.keep
    assert 0 < kept < len(rows)


def test_ids_of_any_type(spark):
    got = Q.judge(spark.createDataFrame([("u-1", "a", "en"), (None, None, None)], "doc_id string, text string, lang string"), FILES).collect()
    assert {x.doc_id: x.keep for x in got} == {"u-1": True, None: True}
