"""Sinks: JSON lines, resumable appends, numbered runs, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows whose key isn't there yet; returns what was appended, so that a broken run can go on."""
    spark = df.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
    fresh = df.dropDuplicates([key])
    if exists:
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    fresh.write.mode("append").parquet(path)
    return fresh


def next_run_id(runs: DataFrame, day: str, id_col: str = "run_id") -> str:
    """``day_exp###`` with the number after the greatest of that day."""
    number = F.regexp_extract(id_col, rf"^{day}_exp(\d{{3,}})$", 1)
    top = runs.where(number != "").agg(F.max(number.cast("int"))).first()[0] or 0
    return f"{day}_exp{top + 1:03d}"


def history(df: DataFrame, time_col: str = "ts", keep: int | None = None) -> DataFrame:
    """Newest first; an append-only table read in order stands for a file rewritten at each event."""
    ordered = df.orderBy(F.desc(time_col))
    return ordered if keep is None else ordered.limit(keep)
