"""Roll-ups over the evaluation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbolita.registry import query
from arbolita.sources.tables import table


@query(
    "category_summary",
    """
    SELECT CASE WHEN length(text) < 500 THEN 'short' WHEN contains(lower(text), 'licen') THEN 'licensed' ELSE 'plain' END AS category,
           count(*) AS n, avg(quality) AS validity_rate, avg(1.0 - toxic) AS mean_score
    FROM documents JOIN labels USING (doc_id) GROUP BY 1
    """,
)
def category_summary(spark, sf_dir):
    """Keyword class of each document joined to its labels, then one row per class."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    kind = F.when(F.length("text") < 500, "short").when(F.contains(F.lower("text"), F.lit("licen")), "licensed").otherwise("plain")
    rows = d.select("doc_id", kind.alias("category")).join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("category").agg(
        F.count("*").alias("n"), F.avg("quality").alias("validity_rate"), F.avg(1.0 - F.col("toxic")).alias("mean_score")
    )
