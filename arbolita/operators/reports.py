"""Evaluation rows, the reports over them, and their files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolita.operators import catalog as C
from arbolita.operators import metrics, validate


def evaluated(trees: DataFrame, catalog: C.Catalog = C.DEFAULT) -> DataFrame:
    """Verdict, hallucinations, ports and structure of every document in one row; expressions over one parse, no shuffle."""
    return validate.scored(trees, catalog).select(
        "tree_id", "valid", "score", "n_errors", "n_warnings", F.size(metrics.unknown_skills(catalog)).alias("hallucination_count"), metrics.completeness(catalog).alias("port_completeness"),
        metrics.depth().alias("max_depth"), metrics.skill_count().alias("n_skills"), F.size("nodes").alias("total_nodes"),
    )


def summary(rows: DataFrame, places: int = 9) -> DataFrame:
    """One row: number, rates of valid, perfect and hallucinating documents, means of score, hallucinations, structure and, where they are there, distance and latency.

    Means over no row (or no distance) are null; without rows there is one row with 0 and nulls.
    """
    mean = lambda c: F.round(F.avg(c), places)
    of = lambda c: F.avg(F.col(c).cast("double"))
    out = [
        F.count("*").alias("n_samples"), mean(F.col("valid").cast("int")).alias("xml_validity_rate"), mean("score").alias("mean_score"), mean((F.col("score") == 1.0).cast("int")).alias("perfect_score_rate"),
        mean((F.col("hallucination_count") > 0).cast("int")).alias("hallucination_rate"), mean("hallucination_count").alias("mean_hallucination_count"),
    ]
    more = {"tree_edit_distance": "mean_tree_edit_distance", "latency_s": "mean_latency_s", "max_depth": "mean_depth", "n_skills": "mean_n_skills", "port_completeness": "mean_port_completeness"}
    return rows.agg(*out, *[F.round(of(c), places).alias(name) for c, name in more.items() if c in rows.columns])


def statistics(rows: DataFrame, names: list[str], places: int = 9) -> DataFrame:
    """``metric, least, mean, median (exact), most`` of the named columns."""
    value = lambda c: F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x"))
    long = rows.select(F.inline(F.array(*map(value, names))))
    return long.groupBy("metric").agg(F.min("x").alias("least"), F.round(F.avg("x"), places).alias("mean"), F.percentile("x", 0.5).alias("median"), F.max("x").alias("most"))


def histogram(rows: DataFrame, score: str = "score") -> DataFrame:
    """``score, n``: scores to one decimal, highest first."""
    return rows.groupBy(F.round(score, 1).alias("score")).agg(F.count("*").alias("n")).orderBy(F.desc("score"))


def categories(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    """``category, n`` in a fixed order, 0 where a category has no row."""
    wanted = rows.sparkSession.createDataFrame(list(enumerate(order)), "place int, category string")
    n = rows.groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))
    return F.broadcast(wanted).join(n, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"), "place").orderBy("place").drop("place")


def port_report(trees: DataFrame, top: int = 20, catalog: C.Catalog = C.DEFAULT) -> DataFrame:
    """``issue, n, place, total, clean, issues_total``: the commonest port issues, ties by name, with the counts of documents and issues.

    Documents are counted by expressions, issues by a partial aggregation; only the ``top`` rows and one row of totals meet.
    """
    found = validate.port_issues_of(catalog)
    kind = lambda x: F.concat_ws(" ", x["code"], F.when(F.startswith(x["code"], F.lit("port_")), F.substring_index(x["detail"], "=", 1)).otherwise(x["detail"]))
    per = trees.select(F.transform(found, kind).alias("issues"))
    totals = per.agg(F.count("*").alias("total"), F.count_if(F.size("issues") == 0).alias("clean"), F.coalesce(F.sum(F.size("issues")), F.lit(0)).alias("issues_total"))
    most = per.select(F.explode_outer("issues").alias("issue")).where("issue is not null").groupBy("issue").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue").limit(top)
    t = totals.first()
    rows = most.collect()
    data = [(r.issue, r.n, k, t.total, t.clean, t.issues_total) for k, r in enumerate(rows, 1)]
    return trees.sparkSession.createDataFrame(data, "issue string, n long, place int, total long, clean long, issues_total long")


def commonest(spark: SparkSession, counts: DataFrame, top: int = 20) -> DataFrame:
    """The port report from ``facts.port_counts``: one pass and one shuffle; only the ``top`` rows and the row of totals meet, which is the one without issue."""
    per = counts.groupBy("issue").agg(*[F.sum(c).alias(c) for c in ("n", "total", "clean")])
    rows = per.orderBy(F.col("issue").isNull().desc(), F.desc("n"), "issue").limit(top + 1).collect()
    data = [(r.issue, r.n, k, rows[0].total, rows[0].clean, rows[0].n) for k, r in enumerate(rows[1:], 1)]
    return spark.createDataFrame(data, "issue string, n long, place int, total long, clean long, issues_total long")


def port_report_json(trees: DataFrame, path: str, missions: Column | None = None, top: int = 20) -> None:
    """The port report as a JSON file: totals, the commonest issues, and the documents with issues beside it as JSON lines."""
    rows = port_report(trees, top).collect()
    head = {k: rows[0][k] for k in ("total", "clean", "issues_total")} if rows else {"total": trees.count(), "clean": trees.count(), "issues_total": 0}
    head |= {"issues_count": head["total"] - head["clean"], "top_issues": {r.issue: r.n for r in rows}}
    samples = validate.port_issues(trees).groupBy("tree_id").agg(F.sort_array(F.collect_list(F.concat_ws(": ", "code", "detail"))).alias("issues"))
    samples.write.mode("errorifexists").json(f"{path}/samples")
    _write_text(trees.sparkSession, f"{path}/report.json", json.dumps(head, ensure_ascii=False, indent=2))


def markdown(entries: DataFrame, title: str = "Inventory") -> str:
    """A report of a small inventory grouped by directory: entries must have ``path``; one line a document, a table a directory."""
    lines = [f"# {title}", ""]
    rows = entries.withColumn("dir", F.coalesce(F.nullif(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))).orderBy("dir", "path")
    last = None
    for r in rows.toLocalIterator():
        if r.dir != last:
            lines += ["", f"## {r.dir}", "", "| file | depth | branching | actions | conditions | subtrees |", "| --- | --- | --- | --- | --- | --- |"] if last else [f"## {r.dir}", "", "| file | depth | branching | actions | conditions | subtrees |", "| --- | --- | --- | --- | --- | --- |"]
            last = r.dir
        name = r.path.rsplit("/", 1)[-1]
        lines.append(f"| {name} | {r.max_depth} | {r.mean_branching} | {r.n_actions} | {r.n_conditions} | {r.n_subtrees + r.n_subtree_plus} |" if r.parse_ok else f"| {name} | does not parse: {r.parse_error} | | | | |")
    return "\n".join(lines) + "\n"


def _write_text(spark, path: str, text: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_run(detail: DataFrame, config: dict, root: str, day: str) -> str:
    """A run directory ``root/day_exp###`` (the number after the greatest of that day) with detail rows, a summary row and the config; never an old one."""
    spark = detail.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    numbers = [int(n.rpartition("_exp")[2]) for n in names if n.startswith(f"{day}_exp") and n.rpartition("_exp")[2].isdigit()]
    run = f"{root}/{day}_exp{max(numbers, default=0) + 1:03d}"
    detail.write.mode("errorifexists").json(f"{run}/results_detail")
    summary(spark.read.schema(detail.schema).json(f"{run}/results_detail")).write.mode("errorifexists").json(f"{run}/metrics")
    _write_text(spark, f"{run}/config.json", json.dumps(config, ensure_ascii=False, indent=2, sort_keys=True))
    return run
