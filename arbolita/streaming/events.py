"""Event histories as Structured Streaming: windows with watermarks, sessions, late duplicates, upserts and a retry machine."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolita.session import shared_folder

SENTINEL = "9000-01-01 00:00:00"


def read_events(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """The events table as a stream; its time is a zoned timestamp, which watermarks need.

    All files come in one trigger unless told otherwise: a watermark set by one file would drop older rows of the next.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    if files_per_trigger is not None:
        source = source.option("maxFilesPerTrigger", files_per_trigger)
    stream = source.parquet(f"{sf_dir}/events*.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def closed(events: DataFrame) -> DataFrame:
    """The events and one of no user and no id, far behind all others: with it the watermark passes every open window. Drop its results."""
    spark = events.sparkSession
    at = f"{shared_folder(spark)}/arbolita/sentinel-{uuid.uuid4().hex}"
    spark.sql(f"SELECT timestamp'{SENTINEL}' AS ts").write.parquet(at)
    last = spark.readStream.schema("ts timestamp").parquet(at)
    return events.unionByName(last, allowMissingColumns=True)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, those still open at the end of the table too."""
    events = closed(events)
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(s, "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n").where(F.col("start") < F.lit(SENTINEL).cast("timestamp"))


def without_repeats(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def attempts(events: DataFrame, most: int = 3) -> DataFrame:
    """A retry machine per user: an error counts an attempt, a purchase ends the run, the ``most``-th error gives up."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tried = state.get[0] if state.exists else 0
        out = []
        for f in frames:
            for kind in f.sort_values("event_id").event_type:
                if kind == "purchase":
                    out.append((key[0], "done", tried))
                    tried = 0
                elif kind == "error":
                    tried += 1
                    if tried == most:
                        out.append((key[0], "gave_up", tried))
                        tried = 0
        state.update((tried,))
        yield pd.DataFrame(out, columns=["user_id", "outcome", "attempts"])

    grouped = events.select("user_id", "event_id", "event_type").groupBy("user_id")
    return grouped.applyInPandasWithState(step, "user_id long, outcome string, attempts int", "tried int", "append", "NoTimeout")


def finished(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its rows; sink and checkpoint are in the shared folder."""
    at = f"{shared_folder(stream.sparkSession)}/arbolita/stream-{name}-{uuid.uuid4().hex}"
    if mode == "append":
        stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/rows").awaitTermination()
    else:

        def whole(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{at}/rows")  # the newest complete result replaces the one before

        stream.writeStream.outputMode(mode).foreachBatch(whole).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")
