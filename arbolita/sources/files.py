"""Sources: JSON lines with key fall-backs, JSON arrays, trees of text files, layered configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ALIASES = {"mission": ("mission", "input", "prompt"), "xml": ("xml", "output"), "text": ("text", "xml"), "steps": ("steps_json", "steps")}


def first_of(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the named columns that is there, not null and not empty."""
    there = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped by the reader."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(path)


def read_missions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines under one name per column, whatever alias a file uses; rows without a mission go."""
    df = read_jsonl(spark, path)
    return df.withColumn("mission", first_of(df, ALIASES["mission"])).where("mission is not null")


def read_json_array(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def scan_files(spark: SparkSession, root: str, extensions: list[str], by_extension: bool = False) -> DataFrame:
    """``path, ext_rank, text`` of all files below ``root`` with these extensions; ``by_extension`` orders by extension first."""
    glob = "*.{" + ",".join(extensions) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rank = F.array_position(F.array(*[F.lit(e) for e in extensions]), F.element_at(F.split("path", r"\."), -1))
    df = found.select("path", rank.alias("ext_rank"), F.col("content").cast("string").alias("text"))
    return df.orderBy("ext_rank", "path") if by_extension else df.orderBy("path")


def stage0_corpus(files: DataFrame, domain: str, scope: str | None = None) -> DataFrame:
    """Declaration stripped, domain comment put in front, the first of equal texts kept (per ``scope`` column, or overall)."""
    from pyspark.sql import Window

    from arbolita.functions.text import strip_declaration

    body = files.withColumn("text", F.concat(F.lit(f"<!-- domain: {domain} -->\n"), strip_declaration(F.col("text"))))
    body = body.withColumn("sha256", F.sha2("text", 256))
    keys = [k for k in (scope, "sha256") if k]
    order = Window.partitionBy(*keys).orderBy("ext_rank", "path")
    return body.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def merged(*layers: dict) -> dict:
    """Later layers over earlier ones, dictionaries merged all the way down."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
