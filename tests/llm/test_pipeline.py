import os

import pytest
import sentencepiece

import corpus_pipeline
from arbolita.llm import deobfuscate, ecoc_langid
from arbolita.llm import ngram_join as J
from arbolita.llm import wu_manber as W
from tests.llm.edges import edge, empty, row
from tests.llm.test_ngram_join import brute as similar
from tests.llm.test_wu_manber import brute as leaks

pytestmark = pytest.mark.skipif(not os.path.exists(corpus_pipeline.TOKENIZER), reason="no vocabulary")
DATA = "/root/testdata/sf0.001"


def expected(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    model = ecoc_langid.train(docs)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [r for r, x in zip(rows, ecoc_langid._decoded([t for _, t in rows], model, ecoc_langid.LEAST_GAP)) if not x[3]]
    least = {i: i for i, _ in rows if i is not None}
    pairs = similar(rows, 3, J.THRESHOLD)
    for _ in range(len(rows)):
        before = dict(least)
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    rows = [r for r in rows if r[0] is None or least[r[0]] == r[0]]
    bad = {x[0] for x in leaks(rows, items, 8)}
    rows = [(i, deobfuscate.masked(t)) for i, t in rows if i not in bad]
    sp = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.TOKENIZER)
    return sorted((repr(i), None if t is None else sp.encode(t)) for i, t in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_against_brute_force(spark):
    got = corpus_pipeline.run(spark, DATA).collect()
    assert all(r.round_trip for r in got)
    assert sorted((repr(r.doc_id), r.ids) for r in got) == expected(spark, DATA)


def test_edges(spark, tmp_path):
    words = "the of and river mountain house garden walking slowly towards evening light".split()
    more = [row(100 + k, " ".join(words[(k * j + j // 3) % 12] for j in range(40)) + f" mail a{k}@here.org") for k in range(20)]
    edge(spark, more).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, words[0] * 3)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((repr(r.doc_id), r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == expected(spark, str(tmp_path))


def test_stages_keep_the_columns(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (edge(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns
