"""Preference data and training rows from scored candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbolita.operators.order import numbered


def ranked(candidates: DataFrame, by: str = "mission", score: str = "score", idx: str = "idx") -> DataFrame:
    """The rows with ``rn`` (best first, ties by ``idx``, no score last) and ``n`` of their mission; rows without mission go.

    Places come from the order of all rows, so the candidates of one mission may be more than a task can hold.
    """
    rows = numbered(candidates.where(F.col(by).isNotNull()), F.col(by), F.desc(score), F.col(idx), name="__k")
    per = rows.groupBy(by).agg(F.min("__k").alias("__lo"), F.count("*").alias("n"))
    return rows.join(per, by).withColumn("rn", F.col("__k") - F.col("__lo") + 1).drop("__k", "__lo")


def preferences(candidates: DataFrame, strategy: str = "multi", k: int = 4, by: str = "mission", score: str = "score", idx: str = "idx", text: str = "completion") -> DataFrame:
    """``mission, chosen, rejected, chosen_score, rejected_score, source``; only where the chosen one scores higher.

    single: the best against the worst. multi: the first ``k`` of the better half (n // 2 of them, one at least) against the worse,
    in order of ranks. augmented: multi, and the best against each of its degraded copies (rows of ``candidates`` with ``degraded_of``
    equal to the best's ``idx``), which take no part in the ranking.
    """
    if strategy not in ("single", "multi", "augmented"):
        raise ValueError(f"strategy {strategy!r}")
    own = candidates.where("degraded_of is null") if "degraded_of" in candidates.columns else candidates
    r = ranked(own.withColumnsRenamed({by: "__m", score: "__s", idx: "__i", text: "__t"}), "__m", "__s", "__i")
    a = r.select("__m", F.col("__i").alias("__best"), F.col("__s").alias("__sa"), F.col("__t").alias("__ta"), F.col("rn").alias("__ra"), "n")
    b = r.select("__m", F.col("__s").alias("__sb"), F.col("__t").alias("__tb"), F.col("rn").alias("__rb"))
    out = [F.col("__m").alias(by), F.col("__ta").alias("chosen"), F.col("__tb").alias("rejected"), F.col("__sa").alias("chosen_score"), F.col("__sb").alias("rejected_score")]
    if strategy == "single":
        return a.where("__ra = 1").withColumn("__rb", F.col("n")).join(b, ["__m", "__rb"]).where("__sa > __sb").select(*out, F.lit("single").alias("source"))
    # pairs are sought by rank, at most k of each of the k best: those behind the first of a lower score all score lower
    half = F.greatest(F.lit(1), F.floor(F.col("n") / 2))
    last = r.groupBy("__m", F.col("__s").alias("__sa")).agg(F.max("rn").alias("__last"))
    start = F.greatest(half, F.col("__last")) + 1
    to = F.least(start + k - 1, F.col("n"))
    sought = a.where((F.col("__ra") <= k) & (F.col("__ra") <= half)).join(last, ["__m", "__sa"]).where(start <= F.col("n")).withColumn("__rb", F.explode(F.sequence(start, to)))
    place = F.row_number().over(Window.partitionBy("__m").orderBy("__ra", "__rb"))
    pairs = sought.join(b, ["__m", "__rb"]).where("__sa > __sb").withColumn("__k", place).where(F.col("__k") <= k).select(*out, F.lit("multi").alias("source"))
    if strategy == "multi" or "degraded_of" not in candidates.columns:
        return pairs
    worse = candidates.where("degraded_of is not null").select(F.col(by).alias("__m"), F.col("degraded_of").alias("__best"), F.col(score).alias("__sb"), F.col(text).alias("__tb"))
    return pairs.unionByName(a.where("__ra = 1").join(worse, ["__m", "__best"]).where("__sa > __sb").select(*out, F.lit("augmented").alias("source")))


def write_pairs(pairs: DataFrame, path: str, iteration: int) -> None:
    """The pairs of an iteration under ``iteration=<n>``; writing an iteration again replaces that one alone."""
    pairs.write.mode("overwrite").json(f"{path}/iteration={iteration}")


def sft(records: DataFrame) -> DataFrame:
    """``id, mission, category, xml`` for supervised and group-relative training; rows without mission or document go."""
    return records.where("length(trim(mission)) > 0 and length(trim(xml)) > 0").select("id", "mission", "category", "xml")


def dpo(records: DataFrame) -> DataFrame:
    """``id, mission, category, prompt, chosen, rejected`` of records with ``xml`` and ``rejected``."""
    return records.where("xml is not null and rejected is not null").select("id", "mission", "category", F.concat(F.lit("Mission: "), "mission").alias("prompt"), F.col("xml").alias("chosen"), "rejected")


def kto(records: DataFrame, seed: int = 42) -> DataFrame:
    """Two rows a record, ``_pos`` with label true and ``_neg`` with false, in an order by a seeded hash."""
    both = F.array(F.struct(F.lit("_pos").alias("s"), F.col("chosen").alias("completion"), F.lit(True).alias("label")), F.struct(F.lit("_neg").alias("s"), F.col("rejected").alias("completion"), F.lit(False).alias("label")))
    rows = dpo(records).select("id", "mission", "category", "prompt", F.inline(both)).select(F.concat("id", "s").alias("id"), "mission", "category", "prompt", "completion", "label")
    return rows.orderBy(F.md5(F.concat_ws(":", "id", F.lit(seed))), "id")
