"""Numbering, splits, pages and nearest vectors; the SQL uses global windows, Spark doesn't."""

import re

from pyspark.sql import functions as F

from arbolita.operators import order
from arbolita.plans.derived_trees import LEAVES
from arbolita.plans.tree_queries import SCORES
from arbolita.registry import query
from arbolita.sources.tables import table

_KEY = "md5(concat(CAST(doc_id AS VARCHAR(20)), ':42:split'))"
_DUCK_LEAVES = LEAVES.replace("{lineitem}", "lineitem")
_TABLES = sorted(set(re.findall(r"\{(\w+)\}", SCORES)))
_DUCK_SCORES = SCORES.format(**{t: t for t in _TABLES})


def _hashed():
    return F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":42:split")))


def _scores(spark, sf_dir):
    return spark.sql(f"WITH {SCORES} SELECT * FROM scored", **{t: table(spark, sf_dir, t) for t in _TABLES})


@query("split_exact_5pct", f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_KEY}, doc_id) AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN k <= ceil(n * 0.05) THEN 'test' ELSE 'train' END AS part FROM r")
def split_exact_5pct(spark, sf_dir):
    """A test set of exactly ceil(5 %) of the documents, in the order of a seeded hash."""
    return order.split_exact(table(spark, sf_dir, "documents").select("doc_id"), 0.05, _hashed(), "doc_id")


@query("split_exact_10pct", f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_KEY}, doc_id) AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN k <= ceil(n * 0.1) THEN 'test' ELSE 'train' END AS part FROM r")
def split_exact_10pct(spark, sf_dir):
    return order.split_exact(table(spark, sf_dir, "documents").select("doc_id"), 0.1, _hashed(), "doc_id")


@query("renumber_padded", f"SELECT doc_id, printf('test_%03d', row_number() OVER (ORDER BY {_KEY}, doc_id)) AS id FROM documents")
def renumber_padded(spark, sf_dir):
    """New ids after a seeded shuffle, padded to three digits; longer numbers stay whole."""
    rows = order.numbered(table(spark, sf_dir, "documents").select("doc_id"), _hashed(), "doc_id")
    return rows.select("doc_id", F.format_string("test_%03d", "k").alias("id"))


@query("positional_zip", "WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents), b AS (SELECT page_id, row_number() OVER (ORDER BY page_id) AS k FROM pages) SELECT a.doc_id, b.page_id FROM a JOIN b ON a.k = b.k")
def positional_zip(spark, sf_dir):
    """The n-th document beside the n-th page."""
    a = order.numbered(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return a.join(order.numbered(table(spark, sf_dir, "pages").select("page_id"), "page_id"), "k").select("doc_id", "page_id")


@query(
    "filter_search_page",
    f"""WITH {_DUCK_SCORES}, hit AS (SELECT *, row_number() OVER (ORDER BY tree_id) AS place, count(*) OVER () AS hits FROM scored WHERE contains(lower(category), 'urgent') AND round(score, 1) = 0.8)
        SELECT tree_id, category, score, place, hits FROM hit WHERE place > 10 AND place <= 20""",
)
def filter_search_page(spark, sf_dir):
    """The second page of ten of a conjunctive filter: text in any case, score to one decimal, any category."""
    category, wanted, text = "*", 0.8, "URGENT"
    hit = _scores(spark, sf_dir).where((F.lit(category) == "*") | (F.col("category") == category)).where(F.round("score", 1) == wanted).where(F.contains(F.lower("category"), F.lit(text.lower())))
    return order.page(hit.select("tree_id", "category", "score"), 2, 10, "tree_id")


@query(
    "compare_pair",
    f"""WITH {_DUCK_SCORES}, k AS (SELECT *, row_number() OVER (ORDER BY tree_id) AS place, count(*) OVER () AS total FROM scored)
        SELECT a.tree_id AS tree_a, b.tree_id AS tree_b, a.score IS NOT DISTINCT FROM b.score AS same_score, a.n_skills IS NOT DISTINCT FROM b.n_skills AS same_skills, a.n_warn IS NOT DISTINCT FROM b.n_warn AS same_warnings
        FROM k a JOIN k b ON a.place = greatest(1, least(3, a.total)) AND b.place = greatest(1, least(1000000000, b.total))""",
)
def compare_pair(spark, sf_dir):
    """The third and the last document side by side; places beyond the ends are clamped."""
    rows = _scores(spark, sf_dir).select("tree_id", "score", "n_skills", "n_warn")
    a = rows.orderBy("tree_id").limit(3).orderBy(F.desc("tree_id")).limit(1).select([F.col(c).alias(f"a_{c}") for c in rows.columns])
    b = rows.orderBy(F.desc("tree_id")).limit(1)
    same = lambda c: F.col(f"a_{c}").eqNullSafe(F.col(c))
    both = a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one")  # one row each
    return both.select(F.col("a_tree_id").alias("tree_a"), F.col("tree_id").alias("tree_b"), same("score").alias("same_score"), same("n_skills").alias("same_skills"), same("n_warn").alias("same_warnings"))


@query(
    "freq_topk_tiebreak",
    f"""WITH {_DUCK_LEAVES}, n AS (SELECT skill_id, count(*) AS n, min((tree_id, pre)) AS first FROM leaves GROUP BY skill_id)
        SELECT skill_id, n, first[1] AS first_tree, first[2] AS first_pre FROM n ORDER BY n DESC, first LIMIT 15""".replace("min((tree_id, pre)) AS first", "arg_min([tree_id, pre], tree_id * 1000000::HUGEINT + pre) AS first"),
)
def freq_topk_tiebreak(spark, sf_dir):
    """The commonest skills, ties by where they occur first."""
    leaves = spark.sql(f"WITH {LEAVES} SELECT * FROM leaves", lineitem=table(spark, sf_dir, "lineitem"))
    n = leaves.groupBy("skill_id").agg(F.count("*").alias("n"), F.min(F.struct("tree_id", "pre")).alias("first"))
    return n.orderBy(F.desc("n"), "first").limit(15).select("skill_id", "n", F.col("first.tree_id").alias("first_tree"), F.col("first.pre").alias("first_pre"))


@query(
    "embedding_top_k",
    """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 4) AS dot FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, vec_id) AS k FROM s) SELECT query_id, vec_id, k::INT AS k FROM r WHERE k <= 5""",
)
def embedding_top_k(spark, sf_dir):
    """The five nearest vectors of every vector whose id is divisible by 50, among all."""
    v = table(spark, sf_dir, "embeddings")
    return order.nearest(v, v.where("vec_id % 50 = 0"), 5)
