"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and test strings are brought to the same form: lower case, every run of separators (ASCII other than letters and
digits, Latin-1 signs, general and CJK punctuation) one blank. The test strings are the runs of ``n`` words of each
item, or the whole item where it has fewer words. A table gives for the block of bytes that ends a window how far the
window may move without passing a test string; at shift 0 the block's bucket holds the test strings that could begin
there, and bytes are compared directly. Thousands of windows ("lanes") over a buffer of whole documents move together,
so that the scan is vectorised although each lane is the sequential algorithm.

Defined results: a null or empty text matches nothing; an item that is null or has no words is ignored; a null id is kept
as null; ids keep their type; repeated rows give repeated results, repeated items count once per item id; empty tables give no rows; columns
beyond the two named ones are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from arbolita.llm.batches import id_type, slices

_ASCII = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_WIDE = re.compile("[\\u0080-\\u00a9\\u00ab-\\u00b4\\u00b6-\\u00b9\\u00bb-\\u00bf\\u2000-\\u206f\\u3000-\\u303f]")
#: Test strings are searched in groups of at most so many bytes; each group is one more pass over the texts.
GROUP_BYTES = 64 << 20
_BUFFER = 4 << 20


def normal(text: str) -> bytes:
    """Words between single blanks, with a blank at either end; b" " where there is none."""
    raw = text.lower().encode()
    if b"\xc2" in raw or b"\xe2" in raw or b"\xe3" in raw:
        raw = _WIDE.sub(" ", text.lower()).encode()
    return b" " + b" ".join(raw.translate(_ASCII).split()) + b" "


class WuManber:
    """Occurrences of any of ``patterns`` (distinct, not empty) in a byte buffer."""

    BITS = 20

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = min(map(len, patterns))
        self.block = min(6, self.m)
        rng = np.random.default_rng(7)
        self.factor = rng.integers(1, 2**32, self.block, dtype=np.uint64) | np.uint64(1)
        most = self.m - self.block + 1
        self.shift = np.full(1 << self.BITS, min(most, 255), np.uint8)
        self.bucket: dict[int, list[int]] = defaultdict(list)
        heads = np.frombuffer(b"".join(p[: self.m] for p in patterns), np.uint8).reshape(len(patterns), self.m)
        for end in range(self.block - 1, self.m):
            h = self._hash([heads[:, end - self.block + 1 + i] for i in range(self.block)])
            np.minimum.at(self.shift, h, min(self.m - 1 - end, 255))
        for k, x in enumerate(h.tolist()):
            self.bucket[x].append(k)

    def _hash(self, columns: list[np.ndarray]) -> np.ndarray:
        x = columns[0].astype(np.uint64) * self.factor[0]
        for c, f in zip(columns[1:], self.factor[1:]):
            x += c * f
        return (x & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - self.BITS)

    def find(self, data: bytes) -> list[tuple[int, int]]:
        """(pattern, start) of every occurrence."""
        if len(data) < self.m:
            return []
        buf = np.frombuffer(data, np.uint8)
        lanes = max(1, min(8192, len(data) // 512))
        edge = np.linspace(self.m - 1, len(data), lanes + 1).astype(np.int64)
        pos, end = edge[:-1].copy(), edge[1:]
        keep = pos < end
        pos, end = pos[keep], end[keep]
        back = np.arange(-self.block + 1, 1)
        found: list[tuple[int, int]] = []
        while len(pos):
            h = self._hash([buf[pos + b] for b in back])
            s = self.shift[h]
            zero = s == 0
            if zero.any():
                for p, x in zip(pos[zero].tolist(), h[zero].tolist()):
                    start = p - self.m + 1
                    for k in self.bucket.get(x, ()):
                        if data.startswith(self.patterns[k], start):
                            found.append((k, start))
            pos = pos + np.maximum(s, 1)
            keep = pos < end
            if not keep.all():
                pos, end = pos[keep], end[keep]
        return found


def needles(items: list[tuple[object, str | None]], n: int) -> tuple[list[bytes], list[list[int]], list[int]]:
    """Distinct test strings, the items (by position) of each, and how many distinct ones each item has."""
    owners: dict[bytes, set[int]] = defaultdict(set)
    for k, (_, text) in enumerate(items):
        words = normal(text or "").split()
        for i in range(max(1, len(words) - n + 1) if words else 0):
            owners[b" " + b" ".join(words[i : i + n]) + b" "].add(k)
    total = [0] * len(items)
    for ks in owners.values():
        for k in ks:
            total[k] += 1
    return list(owners), [sorted(x) for x in owners.values()], total


def _occurrences(texts: list[str | None], search: WuManber) -> Iterator[tuple[int, set[int]]]:
    """Position of each text with a test string, and the numbers of those strings."""

    def flush(parts, offset, at):
        hits = search.find(b"\n".join(parts))
        if hits:
            which = np.searchsorted(offset, [s for _, s in hits], "right") - 1
            by = defaultdict(set)
            for (k, _), w in zip(hits, which.tolist()):
                by[at[w]].add(k)
            yield from sorted(by.items())

    parts, offset, at, size = [], [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        x = normal(text)
        parts.append(x)
        offset.append(size)
        at.append(i)
        size += len(x) + 1
        if size > _BUFFER:
            yield from flush(parts, offset, at)
            parts, offset, at, size = [], [], [], 0
    if parts:
        yield from flush(parts, offset, at)


def _items(benchmark: DataFrame, item_col: str, item_text: str) -> list[tuple[object, str | None]]:
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).alias("t")).where(F.col("t").isNotNull())
    merged: dict[object, list[str]] = defaultdict(list)
    for r in rows.toLocalIterator():
        merged[r.i].append(r.t)
    flat = [(i, t) for i, ts in merged.items() for t in dict.fromkeys(ts)]
    return sorted((x for x in flat if x[0] is not None)) + sorted((x for x in flat if x[0] is None), key=lambda x: x[1])


def _groups(items: list[tuple[int, str | None]], n: int) -> list[tuple[list[bytes], list[list[int]]]]:
    strings, owners, _ = needles(items, n)
    order = sorted(range(len(strings)), key=lambda k: len(strings[k]))
    groups, size = [], GROUP_BYTES + 1
    for k in order:
        if size > GROUP_BYTES or len(strings[k]) >= 16 > len(groups[-1][0][0]):  # one short string would shorten every window
            groups.append(([], []))
            size = 0
        groups[-1][0].append(strings[k])
        groups[-1][1].append(owners[k])
        size += len(strings[k])
    return groups


def contaminated(
    docs: DataFrame, benchmark: DataFrame, n: int = 8, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document and item that share a run of ``n`` words.

    ``doc_id, item_id, n_matched`` (distinct runs of the item that the document holds) and ``coverage`` (their share).
    The test strings are read on the driver and travel with the task; beyond ``GROUP_BYTES`` they are searched in
    several passes, so an executor never holds more than one group's tables. Rows of equal id and text have equal results
    in every pass: passes are added up by id and digest of the text, and the sum given as often as the row came.
    """
    items = _items(benchmark, item_col, item_text)
    schema = f"doc_id {id_type(docs, id_col)}, item_id {id_type(benchmark, item_col)}, n_matched long, coverage double"
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    strings_of: dict[object, set[bytes]] = defaultdict(set)
    for i, t in items:
        strings_of[i].update(needles([(i, t)], n)[0])
    total = {i: len(s) for i, s in strings_of.items()}
    ids = [i for i, _ in items]

    parts = _groups(items, n)
    several = len(parts) > 1
    names, kinds = ["doc_id", "item_id", "n_matched", "coverage"], [item_type, pa.int64(), pa.float64()]
    if several:
        names, kinds = [*names, "digest", "part"], [*kinds, pa.binary(), pa.int32()]

    def scan(part, strings, owners):
        def run(batches):
            search = WuManber(strings)
            for batch in slices(batches):
                texts, rows, out = batch.column(1).to_pylist(), [], []
                for at, hits in _occurrences(texts, search):
                    more = (xxhash.xxh3_128_digest(texts[at].encode()), part) if several else ()
                    per: dict[object, set[int]] = defaultdict(set)
                    for k in hits:
                        for o in owners[k]:
                            per[ids[o]].add(k)
                    rows += [at] * len(per)
                    out += [(i, len(s), len(s) / total[i], *more) for i, s in per.items()]
                if out:
                    columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], names=names)

        return narrow.mapInArrow(run, schema + ", digest binary, part int" if several else schema)

    found = [scan(k, *group) for k, group in enumerate(parts)]
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    if len(found) == 1:
        return found[0]
    each = reduce(DataFrame.unionByName, found).groupBy("doc_id", "digest", "item_id", "part").agg(
        F.count("*").alias("times"), F.max("n_matched").alias("n_matched"), F.max("coverage").alias("coverage")
    )
    added = each.groupBy("doc_id", "digest", "item_id").agg(F.max("times").alias("times"), F.sum("n_matched").alias("n_matched"), F.sum("coverage").alias("coverage"))
    return added.select("doc_id", "item_id", "n_matched", "coverage", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("col")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 8, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that share no run of ``n`` words with any item; columns, names and types as they came."""
    groups = _groups(_items(benchmark, item_col, item_text), n)
    kept, where = docs, docs.columns.index(text_col)
    for strings, _ in groups:

        def run(batches, strings=strings):
            search = WuManber(strings)
            for batch in slices(batches):
                keep = np.ones(batch.num_rows, bool)
                for at, _ in _occurrences(batch.column(where).to_pylist(), search):
                    keep[at] = False
                yield batch.filter(pa.array(keep))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
