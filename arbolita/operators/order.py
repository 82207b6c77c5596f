"""Global order without one task that sees every row: numbering, exact splits, pages, and nearest vectors in blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolita.session import cut

#: Query vectors that one pass over all vectors holds (some 10 MB at 64 dimensions).
QUERY_BLOCK = 20_000


def numbered(df: DataFrame, *keys: str | Column, name: str = "k") -> DataFrame:
    """The rows with their place (from 1) in the order of ``keys``, which must decide it.

    Rows are partitioned by ranges of the keys and sorted within; the sizes of the partitions, one number each, give the offsets.
    """
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    held = cut(ordered.withColumn("__id", F.monotonically_increasing_id()), "numbered")  # ranges come from a sample, so they are drawn once
    part = F.shiftright("__id", 33)
    sizes = sorted((r.p, r.n) for r in held.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    rows, before = [], 0
    for p, n in sizes:
        rows.append((p, before))
        before += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(rows, "p long, before long"))  # a row a partition
    place = F.col("__id").bitwiseAND((1 << 33) - 1) + F.col("before") + 1
    return held.join(offsets, part == F.col("p")).withColumn(name, place).select(*df.columns, name)


def split_exact(df: DataFrame, share: float, *keys: str | Column) -> DataFrame:
    """The rows with ``part``: the first ceil(share n) in the order of ``keys`` are test, the others train."""
    rows = numbered(df, *keys, name="__k")
    most = math.ceil(rows.count() * share - 1e-9)
    return rows.withColumn("part", F.when(F.col("__k") <= most, "test").otherwise("train")).drop("__k")


def page(df: DataFrame, number: int, size: int, *keys: str | Column) -> DataFrame:
    """The rows of a page (from 1, clamped to those there are) with ``place`` and ``hits``; only the rows up to the page's end are sorted out."""
    hits = df.count()
    number = max(1, min(number, -(-hits // size)))
    first = df.orderBy(*keys).limit(number * size).collect()
    rows = [(*r, k, hits) for k, r in enumerate(first, 1) if k > (number - 1) * size]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.sparkSession.createDataFrame(rows, f"{fields}, place long, hits long")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", places: int = 4) -> DataFrame:
    """``query_id, vec_id, k``: of every query the k vectors of greatest dot product (rounded, ties by id), itself excluded; exact.

    Queries go in blocks of ``QUERY_BLOCK`` to one pass over all vectors each; a task keeps the best of each query, and these are merged.
    """
    ids = sorted(r.q for r in queries.select(F.col(id_col).alias("q")).where(F.col(id_col).isNotNull()).distinct().collect())
    q = queries.select(F.col(id_col).alias("q"), F.col(vector_col).alias("v")).where("q is not null and v is not null")
    v = vectors.select(F.col(id_col).alias("i"), F.col(vector_col).alias("v")).where("i is not null and v is not null")
    kind = vectors.schema[id_col].dataType.simpleString()
    found = None
    for lo in range(0, max(1, len(ids)), QUERY_BLOCK):
        block = ids[lo : lo + QUERY_BLOCK]
        if not block:
            break
        rows = q.where(F.col("q").between(block[0], block[-1])).collect()
        names, matrix = [r.q for r in rows], np.array([r.v for r in rows], np.float64)

        def run(batches, names=names, matrix=matrix):
            best: list[list[tuple]] = [[] for _ in names]
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    part = batch.slice(at, 2000)
                    i = part.column(0).to_pylist()
                    x = np.array(part.column(1).to_pylist(), np.float64).reshape(len(i), -1)
                    score = np.round(matrix @ x.T, places)
                    least = np.partition(score, max(0, len(i) - k - 1), axis=1)[:, max(0, len(i) - k - 1)]  # one more than k: the query itself may be among them
                    for r, c in zip(*np.nonzero(score >= least[:, None])):
                        if i[c] != names[r]:
                            best[r].append((-score[r, c], i[c]))
                for r, b in enumerate(best):
                    b.sort()
                    del b[k:]
            rows_ = [(names[r], i_, -s) for r, b in enumerate(best) for s, i_ in b]
            if rows_:
                a, b, c = zip(*rows_)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c, pa.float64())], names=["query_id", "vec_id", "dot"])

        got = v.mapInArrow(run, f"query_id {kind}, vec_id {kind}, dot double")
        found = got if found is None else found.unionByName(got)
    if found is None:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, vec_id {kind}, k int")
    # a few rows a query and task: the k best of them
    entry = F.struct((-F.col("dot")).alias("d"), F.col("vec_id").alias("i"))
    merged = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("k", "b")).select("query_id", F.col("b.i").alias("vec_id"), (F.col("k") + 1).alias("k"))
