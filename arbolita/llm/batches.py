"""Arrow batches of texts in small slices, so that a worker never holds a whole batch as Python objects."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ROWS = 500


def id_type(docs: DataFrame, id_col: str) -> str:
    """The type of the ids as Spark writes it; results carry ids of any type as they came."""
    return docs.schema[id_col].dataType.simpleString()


def trim() -> None:
    """Give freed memory back: a worker lives on for other stages' tasks."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
    trim()
