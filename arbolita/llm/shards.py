"""Minimax contiguous partition of ordered atomic groups into shards.

Groups (here the copies of a text, which must share a shard) in order of their first document are cut into at most ``shards``
runs so that the heaviest run is as light as it can be. The least feasible capacity is found by binary search between
max(heaviest group, ceil(total / shards)) and that plus the heaviest group, which greedy filling never exceeds; a capacity is
feasible if greedy filling needs at most ``shards`` runs. Cuts are then made greedily at the least capacity.

The sizes are packed in blocks, in order, and the driver sees the blocks' totals. Under capacity c the j-th cut comes after a
weight in (j (c - heaviest), j c], as every run but the last is filled to more than c - heaviest. So the whole search can only
look into the blocks about j times the range of c, for j = 1 .. shards: some thousand sizes where groups are small beside a
shard, however large the corpus. Where these windows hold at most ``LOCAL_SIZES`` sizes (8 bytes each) they are fetched and the
search is done at once. Where they hold more (one group about as heavy as a shard), a pass over all blocks tests all the
capacities that the next ``STEPS`` steps could ask for, a chunk of them per task, each jumping from cut to cut by bisection in
a block's prefix sums; a few passes settle any range. Both ways give the same capacity and cuts.

Defined results: a null text weighs 0, as an empty one does; nulls form one group and empty texts another; a document with
a null id comes before the others; ids keep their type, and those that are not whole numbers are ordered by a 64-bit hash; equal rows stay together; fewer groups than shards give one group a shard at most; groups
of weight 0 go with the group before; an empty table gives no rows; only the two named columns are read.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from arbolita.llm.batches import id_type
from arbolita.session import cut

STEPS = 6
CHUNKS = 8
BLOCK = 2000
#: Blocks at most (their totals are on the driver); with more groups than these hold blocks are larger.
MOST_BLOCKS = 500_000
LOCAL_SIZES = 4_000_000


def walk(sizes: np.ndarray, capacity: int, load: int) -> tuple[list[int], int]:
    """Go on filling greedily through a block: (where runs begin in it, load at its end)."""
    total = np.cumsum(sizes)
    before, begun = -load, []
    while True:
        at = int(np.searchsorted(total, before + capacity, "right"))
        if at == len(sizes):
            return begun, (int(total[-1]) if at else 0) - before
        begun.append(at)
        before = int(total[at - 1]) if at else 0


def _walked(blocks: DataFrame, capacities: list[int], tell_cuts: bool) -> DataFrame:
    """For each capacity the number of runs that greedy filling needs; or each run after the first: its block and place."""

    def run(batches):
        loads = dict.fromkeys(capacities, 0)
        needed: dict[int, int] = {}
        for batch in batches:
            out = []
            for c, order, digest, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                sizes = np.frombuffer(raw, np.int64)
                for cap in capacities[c::CHUNKS]:
                    begun, loads[cap] = walk(sizes, cap, loads[cap])
                    needed[cap] = needed.get(cap, 1) + len(begun)
                    out += [(cap, order, digest, at) for at in begun]
            if tell_cuts and out:
                yield _rows(out)
        if not tell_cuts and needed:
            yield _rows([(cap, n, None, None) for cap, n in needed.items()])

    def _rows(rows):
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["capacity", "a", "digest", "place"])

    chunks = min(CHUNKS, len(capacities))
    spread = blocks.select(F.explode(F.array([F.lit(c) for c in range(chunks)])).alias("chunk"), "first_order", "first_digest", "sizes")
    ordered = spread.repartition(chunks, "chunk").sortWithinPartitions("chunk", "first_order", "first_digest")
    return ordered.mapInArrow(run, "capacity long, a long, digest binary, place int")


def least_capacity(blocks: DataFrame, total: int, heaviest: int, shards: int) -> int:
    """Binary search, ``STEPS`` steps to a pass: the interior probes are those that these steps could come to."""
    lo = max(heaviest, -(-total // shards))
    hi = max(lo, -(-total // shards) + heaviest)
    while lo < hi:  # the least feasible capacity is in [lo, hi], and hi is feasible
        probes = sorted({lo + (hi - lo) * k // (1 << STEPS) for k in range(1 << STEPS)})
        runs = {r.capacity: r.a for r in _walked(blocks, probes, False).collect()}
        hi = next((p for p in probes if runs[p] <= shards), hi)
        lo = max([lo, *(p + 1 for p in probes if p < hi)])
    return lo


def near_cuts(ends: np.ndarray, lo: int, hi: int, heaviest: int, shards: int) -> np.ndarray:
    """Which blocks (by the weight up to their end) a search from ``lo`` to ``hi`` can look into."""
    j = np.arange(1, shards + 1, dtype=object)
    first = np.searchsorted(ends, np.array(j * max(0, lo - heaviest), np.float64), "left")
    last = np.searchsorted(ends, np.array(j * hi, np.float64) * (1 + 1e-9), "right")
    wanted = np.zeros(len(ends) + 1, np.int64)
    for a, b in zip(np.maximum(first - 1, 0).tolist(), last.tolist()):
        wanted[a : b + 1] = 1
    return np.flatnonzero(wanted[:-1])


def cuts(sizes: dict[int, np.ndarray], ends: np.ndarray, capacity: int, most: int) -> list[tuple[int, int]]:
    """Where greedy filling begins runs after the first, as (block, place); no more than ``most`` of them. ``sizes`` holds prefix sums."""
    found, before = [], 0
    while len(found) < most:
        b = int(np.searchsorted(ends, before + capacity, "right"))
        if b == len(ends):
            break
        start = int(ends[b - 1]) if b else 0
        at = int(np.searchsorted(sizes[b], before + capacity - start, "right"))
        before = start + (int(sizes[b][at - 1]) if at else 0)
        found.append((b, at))
    return found


def _packed(groups: DataFrame, block: int) -> DataFrame:
    """Groups in order, ``block`` to a row under the key of the first."""

    def run(batches):
        for batch in batches:
            rows = []
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                w = part.column(2).to_numpy()
                digests = part.column(1).to_pylist()
                rows.append((part.column(0)[0].as_py(), digests[0], w.tobytes(), digests, int(w.sum()), int(w.max()), len(w)))
            if rows:
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.int64(), pa.int64(), pa.int64())
                names = ["first_order", "first_digest", "sizes", "digests", "total", "heaviest", "n"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    ordered = groups.repartitionByRange("order", "digest").sortWithinPartitions("order", "digest").select("order", "digest", "weight")
    return ordered.mapInArrow(run, "first_order long, first_digest binary, sizes binary, digests array<binary>, total long, heaviest long, n long")


def assign(docs: DataFrame, shards: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, shard, capacity`` of every row; shards are numbered from 0 in order."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    whole = isinstance(docs.schema[id_col].dataType, IntegralType)
    place = F.coalesce(F.col(id_col).cast("long") if whole else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col)), F.lit(-(1 << 63)))
    d = docs.select(
        F.col(id_col).alias("doc_id"), place.alias("order"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("weight"),
        F.coalesce(F.unhex(F.md5(text_col)), F.lit(b"")).alias("digest"),
    )
    members = cut(d, "members")
    groups = members.groupBy("digest").agg(F.min("order").alias("order"), F.sum("weight").alias("weight"))
    blocks = cut(_packed(groups, max(BLOCK, -(-members.count() // MOST_BLOCKS))), "blocks")
    index = sorted((r.first_order, bytes(r.first_digest), r.total, r.heaviest, r.n) for r in blocks.select("first_order", "first_digest", "total", "heaviest", "n").collect())
    if not index:
        return docs.sparkSession.createDataFrame([], f"doc_id {id_type(docs, id_col)}, shard int, capacity long")
    ends = np.cumsum([x[2] for x in index])
    total, heaviest = int(ends[-1]), max(x[3] for x in index)
    lo = max(heaviest, -(-total // shards))
    hi = max(lo, -(-total // shards) + heaviest)
    near = near_cuts(ends, lo, hi, heaviest, shards)
    if sum(index[b][4] for b in near) <= LOCAL_SIZES:
        edge = np.flatnonzero(np.diff(near, prepend=-2) > 1)
        runs = zip(near[edge].tolist(), near[np.append(edge[1:], len(near)) - 1].tolist())
        some = reduce(lambda x, y: x | y, [F.col("first_order").between(index[a][0], index[b][0]) for a, b in runs], F.lit(False))
        number_of = {x[:2]: b for b, x in enumerate(index)}
        sizes = {number_of[r.first_order, bytes(r.first_digest)]: np.cumsum(np.frombuffer(r.sizes, np.int64)) for r in blocks.where(some).select("first_order", "first_digest", "sizes").collect()}
        while lo < hi:
            middle = (lo + hi) // 2
            if len(cuts(sizes, ends, middle, shards)) < shards:
                hi = middle
            else:
                lo = middle + 1
        capacity = lo
        starts = [(*index[b][:2], at) for b, at in cuts(sizes, ends, capacity, shards)]
    else:
        capacity = least_capacity(blocks, total, heaviest, shards)
        starts = sorted((r.a, bytes(r.digest), r.place) for r in _walked(blocks, [capacity], True).collect())

    def number(batches):
        for batch in batches:
            for order, digest, inside in zip(*(batch.column(i).to_pylist() for i in range(3))):
                at = bisect_right(starts, (order, digest, -1))
                begun = [p for o, g, p in starts[at : bisect_right(starts, (order, digest, 1 << 40))]]
                shard = at + np.searchsorted(begun, np.arange(len(inside)), "right")
                yield pa.RecordBatch.from_arrays([pa.array(inside, pa.binary()), pa.array(shard.astype(np.int32))], names=["digest", "shard"])

    numbered = blocks.select("first_order", "first_digest", "digests").mapInArrow(number, "digest binary, shard int")
    return members.join(numbered, "digest").select("doc_id", "shard", F.lit(capacity).cast("long").alias("capacity"))
