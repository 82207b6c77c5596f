"""The queries of this subpackage and the DuckDB text of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolita.llm import deobfuscate, ecoc_langid, fertility, html_tree, license_scan, ngram_join, shards, spm_trie, url_rules, wu_manber
from arbolita.sources.tables import table


TOKENIZERS = "/opt/tokenizers"


def op1_fertility(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Fertility measures and verdict of every document, under a byte-level and a piece vocabulary."""
    files = {"byte": f"{tokenizers}/byte_bpe_multi_50k.tiktoken", "piece": f"{tokenizers}/piece_bpe_32k.model"}
    return fertility.judge(table(spark, sf_dir, "documents"), files)


def op2_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every identifier of every document, with its span in the source."""
    return deobfuscate.find(table(spark, sf_dir, "documents"))


def op3_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document: 64 shards, copies of a text together, the heaviest shard as light as can be."""
    return shards.assign(table(spark, sf_dir, "documents"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, its own or its directory's; a document's path is source/language/hundred/id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan.scan(docs.select("doc_id", path.alias("path"), "text"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of connected texts and its numbers of copies and of similar texts (three-word runs, Jaccard 0.65 or more)."""
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that decides about every page's URL."""
    return url_rules.verdicts(table(spark, sf_dir, "pages"), url_rules.default_rules(spark))


def op7_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by classifiers fitted on a bounded sample of the declared languages."""
    docs = table(spark, sf_dir, "documents")
    return ecoc_langid.identify(docs, ecoc_langid.train(docs))


def op8_sentencepiece(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """The best segmentation (Viterbi) of every document under the model's pieces and scores, and whether decoding it gives the document again."""
    return spm_trie.encode(table(spark, sf_dir, "documents"), f"{tokenizers}/piece_bpe_32k.model", search="viterbi")


def op9_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that share a run of eight words."""
    return wu_manber.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_tree.main_text(table(spark, sf_dir, "pages"))


_NORMAL = (
    r"trim(regexp_replace(lower(text), '[\x00-/:-@\[-`{-\x7f\x{80}-\x{a9}\x{ab}-\x{b4}\x{b6}-\x{b9}\x{bb}-\x{bf}"
    r"\x{2000}-\x{206f}\x{3000}-\x{303f}]+', ' ', 'g'))"
)
_GRAMS = """
    SELECT DISTINCT {key}, array_to_string(list_slice(words, i, i + least(8, len(words)) - 1), ' ') AS gram FROM (
        SELECT {key}, words, unnest(generate_series(1, greatest(len(words) - 7, 1))) AS i FROM (
            SELECT {key}, string_split({normal}, ' ') AS words FROM {table} WHERE {normal} <> ''))
"""
OP3_SQL = """
    WITH RECURSIVE g AS (
        SELECT min(doc_id) AS o, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS w, text IS NULL AS none, md5(coalesce(text, '')) AS h
        FROM documents GROUP BY ALL),
    a AS (SELECT list(w ORDER BY o) AS ws, sum(w)::BIGINT AS total, max(w) AS top FROM g),
    search(lo, hi) AS (
        SELECT greatest(top, (total + 63) // 64), greatest(top, (total + 63) // 64) + top FROM a
        UNION ALL
        SELECT CASE WHEN runs <= 64 THEN lo ELSE (lo + hi) // 2 + 1 END, CASE WHEN runs <= 64 THEN (lo + hi) // 2 ELSE hi END
        FROM (
            SELECT lo, hi, list_reduce(
                list_prepend({'load': 0::BIGINT, 'runs': 1::BIGINT}, list_transform(ws, lambda x: {'load': x, 'runs': 0::BIGINT})),
                lambda s, x: CASE WHEN s.load + x.load > (lo + hi) // 2 THEN {'load': x.load, 'runs': s.runs + 1}
                                  ELSE {'load': s.load + x.load, 'runs': s.runs} END).runs AS runs
            FROM search, a WHERE lo < hi)),
    c AS (SELECT min(hi) AS capacity FROM search WHERE lo = hi),
    n AS (SELECT row_number() OVER (ORDER BY o) AS k, * FROM g),
    fill(k, load, shard) AS (
        SELECT 1::BIGINT, w, 0 FROM n WHERE k = 1
        UNION ALL
        SELECT n.k, CASE WHEN load + w > capacity THEN w ELSE load + w END, shard + (load + w > capacity)::INT
        FROM fill JOIN n ON n.k = fill.k + 1, c)
    SELECT d.doc_id, shard::INT AS shard, capacity FROM documents d
    JOIN n ON n.h = md5(coalesce(d.text, '')) AND n.none = (d.text IS NULL) JOIN fill ON fill.k = n.k, c
"""
OP5_SQL = f"""
    WITH RECURSIVE w AS (SELECT doc_id, string_split({_NORMAL}, ' ') AS words FROM documents WHERE {_NORMAL} <> '' AND doc_id IS NOT NULL),
    g AS (
        SELECT doc_id, list_sort(list_distinct(list_transform(generate_series(1, greatest(len(words) - 2, 1)),
               lambda i: array_to_string(list_slice(words, i, i + least(3, len(words)) - 1), ' ')))) AS grams FROM w),
    m AS (SELECT DISTINCT doc_id, md5(array_to_string(grams, '|')) AS sid FROM g),
    s AS (SELECT DISTINCT md5(array_to_string(grams, '|')) AS sid, len(grams) AS n, grams FROM g),
    r AS (SELECT sid, n, unnest(grams) AS gram FROM s),
    links AS (
        SELECT a.sid AS a, b.sid AS b FROM r a JOIN r b ON a.gram = b.gram AND a.sid <> b.sid
        GROUP BY a.sid, b.sid, a.n, b.n HAVING 20 * count(*) >= 13 * (a.n + b.n - count(*))),
    edges AS (SELECT a, b FROM links UNION SELECT x.sid, y.sid FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.sid <> y.sid),
    reach(a, b) AS (SELECT sid, sid FROM s UNION SELECT reach.a, e.b FROM reach JOIN edges e ON e.a = reach.b),
    class AS (SELECT reach.a AS sid, min(m.doc_id) AS class_id FROM reach JOIN m ON m.sid = reach.b GROUP BY reach.a),
    size AS (SELECT sid, count(*) AS docs FROM m GROUP BY sid),
    n AS (SELECT a AS sid, count(*) AS n_links FROM links GROUP BY a)
    SELECT m.doc_id, class_id, docs - 1 AS n_copies, coalesce(n_links, 0) AS n_links
    FROM m JOIN class USING (sid) JOIN size USING (sid) LEFT JOIN n USING (sid)
    UNION ALL
    SELECT DISTINCT doc_id, doc_id, 0, 0 FROM documents WHERE doc_id IS NOT NULL AND NOT coalesce({_NORMAL} <> '', false)
"""
OP9_SQL = f"""
    WITH d AS ({_GRAMS.format(key="doc_id", normal=_NORMAL, table="documents")}),
         b AS ({_GRAMS.format(key="item_id", normal=_NORMAL, table="benchmark")}),
         n AS (SELECT item_id, count(*) AS total FROM b GROUP BY item_id)
    SELECT doc_id, item_id, count(*) AS n_matched, count(*) / any_value(total) AS coverage
    FROM d JOIN b USING (gram) JOIN n USING (item_id) GROUP BY doc_id, item_id
"""


_RULES = ", ".join(f"({i}, '{e}', '{a}', {p})" for i, e, a, p in url_rules.DEFAULT_RULES)
OP6_SQL = f"""
    WITH rules(rule_id, rule, rule_action, priority) AS (VALUES {_RULES}),
    rest AS (SELECT page_id, url, regexp_replace(trim(url), '^[a-zA-Z][a-zA-Z0-9+.\\-]*://', '') AS rest FROM pages),
    parts AS (
        SELECT page_id, url,
               regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''),
                              '^[.]+|[.]+$', '', 'g') AS host,
               regexp_replace(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '/+', '/', 'g') AS p,
               CASE WHEN regexp_extract(rest, '^[^?#]*([?])', 1) = '?' THEN regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1) END AS query
        FROM rest),
    lists AS (
        SELECT page_id, url, host, query, CASE WHEN p = '' THEN '/' ELSE p END AS path, string_split(host, '.') AS labels FROM parts WHERE host <> ''),
    hosts AS (
        SELECT page_id, url, path, query, array_to_string(list_slice(labels, i, len(labels)), '.') AS h
        FROM (SELECT *, unnest(generate_series(1, greatest(len(labels) - 1, 1))) AS i FROM lists)
        WHERE i = 1 OR NOT regexp_matches(host, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$')),
    found AS (
        SELECT page_id, url, h || array_to_string(list_slice(s, 1, i), '/') || '/' AS e
        FROM (SELECT *, unnest(generate_series(1, greatest(len(s) - 1, 1))) AS i FROM (SELECT *, string_split(path, '/') AS s FROM hosts))
        UNION SELECT page_id, url, h || path FROM hosts
        UNION SELECT page_id, url, h || path || '?' || query FROM hosts WHERE query IS NOT NULL),
    best AS (
        SELECT page_id, url, rule_id, rule_action, rule, row_number() OVER (PARTITION BY page_id, url ORDER BY priority DESC,
               length(split_part(rule, '/', 1)) DESC, length(rule) DESC, rule_action = 'allow' DESC, rule_id) AS k
        FROM found JOIN rules ON e = rule)
    SELECT d.page_id, d.url, rule_id::BIGINT AS rule_id, coalesce(rule_action, 'pass') AS action, rule AS expression
    FROM (SELECT DISTINCT page_id, url FROM pages) d LEFT JOIN best b ON b.page_id = d.page_id AND b.url = d.url AND k = 1
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fertility, op2_deobfuscation, op3_minimax_shards, op4_licences, op5_ngram_jaccard, op6_url_rules, op7_ecoc_language, op8_sentencepiece, op9_wu_manber, op10_html_tree)}


def oracle_sql() -> dict[str, str]:
    return {"op3_minimax_shards": OP3_SQL, "op5_ngram_jaccard": OP5_SQL, "op6_url_rules": OP6_SQL, "op9_wu_manber": OP9_SQL}
