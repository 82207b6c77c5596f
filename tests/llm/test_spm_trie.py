import os
import random
import time

import pytest
import sentencepiece

from arbolita.llm import spm_trie as S
from arbolita.llm.words import Lexicon
from tests.llm.edges import LONG, edge, empty

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary")
TEXTS = [
    "", " ", "   ", "\n\n x", "a  b\n\tc ₿é​ x  ", "日本語 text 漢字", "x\0y", "code:\n    if x == 1:\n        return   y\n", "<s> </s> <unk> <0x41>",
    "ﬁ Ǆ é", "The quick brown fox", "hello hello helloing hel", LONG[:20000],
]


def ids(model, texts):
    out = []
    for _, flat, ends in Lexicon(model.encode_words).documents(texts, S.units):
        at = 0
        for e in ends.tolist():
            out.append(flat[at:e].tolist())
            at = e
    return out


def texts():
    r = random.Random(3)
    return TEXTS + ["".join(r.choices(" \nabXé漢1.$thero", k=r.randint(1, 90))) for _ in range(600)]


def test_bpe_ids_are_the_librarys():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    model = S.Model(MODEL)
    assert model.bpe
    assert ids(model, texts()) == sp.encode(texts())


def test_unigram_ids_are_the_librarys(tmp_path):
    """The same pieces and scores as a unigram model: Viterbi."""
    raw = open(MODEL, "rb").read()
    model_as = tmp_path / "unigram.model"
    model_as.write_bytes(_with_type(raw, 1))
    sp = sentencepiece.SentencePieceProcessor(model_file=str(model_as))
    model = S.Model(str(model_as))
    assert not model.bpe
    got, want = ids(model, texts()), sp.encode(texts())
    assert got == want
    assert ids(S.Model(MODEL, "viterbi"), texts()) == want


def test_viterbi_against_brute_force():
    """The best sum over all segmentations of short words."""
    model = S.Model(MODEL, "viterbi")

    def best(word):
        if not word:
            return 0.0
        found = [model.score[model.ids[word[:k]]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in model.ids]
        if word[0] not in model.ids:
            found.append(model.unknown + best(word[1:]))
        return max(found)

    r = random.Random(5)
    words = ["".join(r.choices("theron ", k=r.randint(1, 9))).strip() or "x" for _ in range(200)]
    for word, got in zip(words, model.encode_words(words)):
        assert sum(model.score[k] for k in got) == best(S.MARK + word.replace(" ", S.MARK))


@pytest.mark.parametrize("search", ["viterbi", "merges"])
def test_long_runs_take_linear_time(search):
    model = S.Model(MODEL, search)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    began = time.time()
    for text in ("a" + " " * 100_000 + "b", "x" * 100_000, "\n" * 100_000, "漢" * 100_000):
        got = ids(model, [text])[0]
        assert model.decode(got) == text
        if search == "merges":
            assert got == sp.encode(text)
    assert time.time() - began < 60


def test_irregular_texts_keep_the_lexicon_small(monkeypatch):
    from arbolita.llm import words

    monkeypatch.setattr(words, "MOST_CHARS", 100_000)
    model = S.Model(MODEL)
    lexicon = Lexicon(model.encode_words)
    most = 0
    r = random.Random(6)
    for _ in range(100):
        part = ["".join(r.choices("abc d\t", k=300)) for _ in range(500)]
        for _ in lexicon.documents(part, S.units):
            pass
        most = max(most, lexicon._chars)
    assert most < 300_000


def test_other_models_are_refused(tmp_path):
    raw = open(MODEL, "rb").read()
    at = tmp_path / "m.model"
    for more in (b"\x1a\x02\x20\x01", b"\x1a\x02\x18\x00", b"\x1a\x03\x12\x01x", b"\x0a\x06\x0a\x02zz\x18\x04"):  # white space removed, no prefix, a map, a user's piece
        at.write_bytes(raw + more)
        with pytest.raises(ValueError):
            S.Model(str(at))
    with pytest.raises(ValueError):
        S.Model(MODEL, "other")


def test_unknown_pieces_where_there_are_no_bytes():
    model = S.Model(MODEL)
    model.byte = {}
    got = model.encode_words(["a₿₿b"])[0]
    assert got.count(model.unknown_id) == 1


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("u-1", "a  b"), (None, None)], "doc_id string, text string")
    got = S.encode(df, MODEL)
    assert {r.doc_id: r.round_trip for r in got.collect()} == {"u-1": True, None: None}
    assert {r.doc_id: r.text for r in S.decode(got, MODEL).collect()} == {"u-1": "a  b", None: None}


def _with_type(raw: bytes, kind: int) -> bytes:
    """The model file with trainer_spec.model_type set: fields later in a message override earlier ones."""
    return raw + b"\x12\x02\x18" + bytes([kind])


def test_round_trip(spark):
    df = edge(spark)
    got = S.encode(df, MODEL)
    rows = got.collect()
    assert len(rows) == df.count()
    assert all(r.round_trip for r in rows if r.ids is not None)
    assert [r.n_tokens for r in rows if r.doc_id == 3] == [0] and [r.ids for r in rows if r.doc_id == 2] == [None]
    back = {r.doc_id: r.text for r in S.decode(got, MODEL).collect()}
    assert back == {r.doc_id: r.text for r in df.collect()}


def test_empty(spark):
    assert S.encode(empty(spark), MODEL).count() == 0


def test_forgetting_changes_nothing(monkeypatch):
    from arbolita.llm import words

    model = S.Model(MODEL)
    want = ids(model, TEXTS)
    monkeypatch.setattr(words, "MOST_WORDS", 3)
    monkeypatch.setattr(words, "_PART", 8)
    assert ids(model, TEXTS) == want
