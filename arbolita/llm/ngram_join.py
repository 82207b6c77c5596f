"""N-gram Jaccard self-join by the size-aware heavy-light method.

A text is the set of its runs of ``n`` words (lower case, separators dropped; a shorter text is one run). Texts of equal sets
are one set from there on. Two sets of sizes a and b with Jaccard >= t share at least t/(1+t) (a+b) >= t max(a, b) runs.
Order the runs of every set by how many sets hold them, rare first: then the two share at least k of the first
``size - ceil(t size) + k`` runs of each. Runs that no other set holds fill most of these places and are never looked at,
so sets without a partner drop out.

- Small sets (size <= x): every subset of two of those first runs (k = 2) is a key; two small sets with a key in common are
  candidates.
- Large sets: the inverted lists of those first runs (k = 4) are scanned, and pairs seen at least four times, one of them
  large, are candidates. Small sets down to t x are in the lists too, as partners.

The boundary x is where the estimated cost, keys made plus list entries met, is least, from the histogram of sizes and the
mean length of a list. Nothing is capped: what the method cuts is cut by the bounds above.

What is wanted is the classes of connected similar texts and how many similar texts each one has, so a group of many near
copies is not written out pair by pair. In every list the neighbours by size, and each set with the first, meet first, and those that meet often are compared;
sets found connected need not meet again, and only lists that hold sets of several groups are scanned pair by pair, for
pairs between groups. Groups are then final, and every similar pair lies within one. The links are counted there: a group
is cut in blocks, and for every two blocks a task multiplies the sparse matrix of sets and runs with its transpose (equal
columns once, with their number) and counts the sets at or above ``t``.

Data moves as follows: runs to their list (packed, some 8 bytes a run), runs that two or more sets hold back to their
set, key rows of the sets that remain to their key, pairs that were met first to their neighbourhood, sets of groups to
their blocks.

Defined results: a null text or one without words is similar to nothing; a row with a null id has no part in it; equal rows
count once; an id with several texts has a row for each and connects them; ties of the threshold count as similar; an empty
table gives no rows; only two columns are read. Ids keep their type; of ids that are not whole numbers the smallest is that
of the smallest 64-bit hash. Sets are told apart by 64-bit hashes, runs by 48 bits beside their bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import IntegralType

from arbolita.llm.batches import id_type, trim
from arbolita.llm.wu_manber import normal
from arbolita.session import cut

THRESHOLD = Fraction(13, 20)
LIST_K, SUBSET_K = 4, 2
_FLUSH = 500_000
SLICES = 8
#: Bytes of text (about six a word) whose runs make a bucket.
BUCKET_BYTES = 20_000_000
#: Pairs that one verification task takes at a time, and pairs of one neighbourhood from which it is cut into blocks.
TASK_PAIRS, BLOCK_PAIRS = 20_000, 200_000
#: Sets, and runs in them, that make a block of a group whose links are counted.
BLOCK_SETS, BLOCK_RUNS = 1_000, 1_000_000
#: So many ids (8 bytes each, some 32 MB as a hash table) go to every executor.
BROADCAST_IDS = 1_000_000
#: So many edges (16 bytes each) are joined to groups by one task; more by rounds of joins.
LOCAL_EDGES = 1_000_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def runs(text: str | None, n: int, hashes: dict) -> np.ndarray:
    """The distinct hashes of the runs of ``n`` words, sorted."""
    words = normal(text).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    g = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        g *= np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(29)
        g += h[i : len(h) - k + 1 + i]
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    return np.unique(g)


def least_overlap(size: np.ndarray | int, t: Fraction = THRESHOLD):
    """ceil(t size) in whole numbers."""
    return -(-size * t.numerator // t.denominator)


def _six(values: np.ndarray) -> np.ndarray:
    """The low six bytes of each, as rows of bytes."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


_RUNS = "bucket int, kind int, a binary, b binary, c binary"


def _spread(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """Packed rows: kind 0 runs of a bucket with the sets that hold them, kind 1 sets (id, document, size)."""

    def flush(sids, docs_, sizes, sets) -> Iterator[pa.RecordBatch]:
        sid = np.array(sids, np.int64)
        g, size = np.concatenate(sets), np.array(sizes, np.int64)
        own = np.repeat(np.arange(len(sid), dtype=np.int64), size)
        bucket = (g % np.uint64(buckets)).astype(np.uint16 if buckets < 65536 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        bucket, own, key = bucket[order], own[order], _six(g[order] // np.uint64(buckets))
        rows = []
        if len(own):
            start = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (own[1:] != own[:-1])]))
            count = np.diff(np.append(start, len(own))).astype(np.uint32)
            head, run_sid = bucket[start], sid[own[start]]
            first = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(head)]):
                end = start[hi] if hi < len(start) else len(own)
                rows.append((int(head[lo]), 0, run_sid[lo:hi].tobytes(), count[lo:hi].tobytes(), key[start[lo] : end].tobytes()))
        place = sid % buckets
        d = np.array(docs_, np.int64)
        for b in np.unique(place).tolist():
            at = place == b
            rows.append((b, 1, sid[at].tobytes(), d[at].tobytes(), size[at].tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "kind", "a", "b", "c"])

    def run(batches):
        hashes = _Hashes()
        held = ([], [], [], [])
        total = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):  # one at a time: a batch of texts is large
                g = runs(text.as_py(), n, hashes)
                # a text without words is a set of its own
                sid = xxhash.xxh3_64_intdigest(g if len(g) else b"none" + doc.to_bytes(8, "little", signed=True)) - (1 << 63)
                for column, value in zip(held, (sid, doc, len(g), g)):
                    column.append(value)
                total += len(g) + 8
                if total > _FLUSH:
                    yield from flush(*held)
                    held, total = ([], [], [], []), 0
        if held[0]:
            yield from flush(*held)
        trim()

    return docs.mapInArrow(run, _RUNS)


def _joined(table: pa.Table, kind: int, dtypes) -> list[np.ndarray]:
    at = table.filter(pc.equal(table["kind"], kind))
    read = lambda raw, t: _from_six(raw) if t == "six" else np.frombuffer(raw, t)
    return [read(b"".join(at[c].to_pylist()), t) for c, t in zip("abc", dtypes)]


#: by bucket of the set; kind 0: sets, their numbers of runs, the runs (of bucket origin) and the rank of how many sets hold each; kind 1 as
#: it came; kind 2: numbers of lists and of their entries, sizes, and how many sets have each
_SHARED = "bucket int, origin int, kind int, a binary, b binary, c binary, d binary"


def _shared(buckets: int):
    """The runs of one bucket that two or more sets hold, packed for the buckets of those sets."""

    def run(table: pa.Table) -> pa.Table:
        sid, count, key = _joined(table, 0, (np.int64, np.uint32, "six"))
        bucket = table["bucket"][0].as_py()
        names, dense = np.unique(sid, return_inverse=True)
        dense = np.repeat(dense.astype(np.int32), count)
        rows, lists, kept = [], 0, []
        for part in range(SLICES):  # a slice of the runs at a time, to keep the sorting small
            at = np.flatnonzero(key % np.uint64(SLICES) == part)
            if not len(at):
                continue
            k, o = key[at], dense[at]
            order = np.lexsort((o, k))
            k, o = k[order], o[order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])
            k, o = k[new], o[new]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            df = np.diff(np.append(first, len(k)))
            lists += int((df > 1).sum())
            each = np.repeat(df, df)
            keep = each > 1
            # an eighth of a power of two is fine enough for an order, and one byte
            kept.append((k[keep], o[keep], np.minimum(8 * np.log2(each[keep]), 255).astype(np.uint8)))
        key = np.concatenate([x for x, _, _ in kept]) if kept else key[:0]
        if len(key):
            own, each = names[np.concatenate([x for _, x, _ in kept])], np.concatenate([x for _, _, x in kept])
            to = own % buckets
            order = np.lexsort((own, to))
            key, own, each, to = _six(key[order]), own[order], each[order], to[order]
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            held = np.diff(np.append(start, len(own))).astype(np.uint32)
            place = to[start]
            part = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            for lo, hi in zip(part, np.append(part[1:], len(start))):
                at = slice(start[lo], start[hi] if hi < len(start) else len(own))
                rows.append((int(place[lo]), bucket, 0, own[start[lo:hi]].tobytes(), held[lo:hi].tobytes(), key[at].tobytes(), each[at].tobytes()))
        s, d, z = _joined(table, 1, (np.int64, np.int64, np.int64))
        if len(s):
            rows.append((bucket, bucket, 1, s.tobytes(), d.tobytes(), z.tobytes(), None))
        sizes, n = np.unique(z[np.unique(s, return_index=True)[1]], return_counts=True)
        rows.append((bucket, bucket, 2, np.array([lists, len(key)], np.int64).tobytes(), sizes.tobytes(), n.astype(np.int64).tobytes(), None))
        kinds = [pa.int32()] * 3 + [pa.binary()] * 4
        out = pa.table({c: pa.array(v, k) for c, v, k in zip("bucket origin kind a b c d".split(), zip(*rows), kinds)})
        trim()
        return out

    return run


def _statistics(batches):
    """Sizes and list lengths from the rows of kind 2: size -1 stands for the number of lists, -2 for that of their entries."""
    for batch in batches:
        for a, b, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
            size = np.concatenate([[-1, -2], np.frombuffer(b, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(np.concatenate([np.frombuffer(a, np.int64), np.frombuffer(c, np.int64)]))], names=["size", "n"])


def boundary(sizes: dict[int, int], list_length: float, t: Fraction = THRESHOLD) -> int:
    """The x of least cost: keys of the sets up to x, plus list entries of those from t x on, each with half a list of partners.

    At least so large that sets beyond it must share ``LIST_K`` runs with a partner.
    """
    least = next(x for x in range(1, 10_000) if least_overlap(x + 1, t) >= LIST_K)
    s = np.array(sorted(sizes), np.int64)
    m = np.array([sizes[k] for k in s.tolist()], np.float64)
    p = (s - least_overlap(s, t) + SUBSET_K).astype(np.float64)
    subsets = np.concatenate([[0], np.cumsum(m * p * (p - 1) / 2)])
    entries = np.concatenate([[0], np.cumsum(m * (s - least_overlap(s, t) + LIST_K) * (1 + list_length / 2))])
    x = np.unique(np.append(s[s > least], least))
    cost = subsets[np.searchsorted(s, x, "right")] + entries[-1] - entries[np.searchsorted(s, least_overlap(x + 1, t))]
    return int(x[cost.argmin()])


_KEYS = "kind int, key long, sid long, size int, doc_id long, runs binary"


def _keys(x: int, t: Fraction, buckets: int):
    """Of the sets of one bucket: kind 0 list keys, kind 1 subset keys, kind 2 the set with its shared runs, kind 3 its documents (key: how many)."""
    bridge = least_overlap(x + 1, t)

    def run(table: pa.Table) -> pa.Table:
        parts = [(o, np.frombuffer(a, np.int64), np.frombuffer(b, np.uint32), _from_six(c), np.frombuffer(d, np.uint8))
                 for o, k, a, b, c, d in zip(*(table[c].to_pylist() for c in ("origin", "kind", "a", "b", "c", "d"))) if k == 0]
        cat = lambda arrays, t: np.concatenate(arrays) if arrays else np.zeros(0, t)
        rs = cat([np.repeat(x, n) for _, x, n, _, _ in parts], np.int64)
        rr = cat([(k * np.uint64(buckets) + np.uint64(o)).view(np.int64) for o, _, _, k, _ in parts], np.int64)
        df = cat([x for *_, x in parts], np.uint8)
        rows = np.lexsort((rr, df, rs))
        rs, rr = rs[rows], rr[rows]
        s, d, z = _joined(table, 1, (np.int64, np.int64, np.int64))
        at = np.lexsort((d, s))
        s, d, z = s[at], d[at], z[at]
        other = np.concatenate([[True], (s[1:] != s[:-1]) | (d[1:] != d[:-1])]) if len(s) else np.zeros(0, bool)
        s, d, z = s[other], d[other], z[other]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        members = np.diff(np.append(first, len(s)))
        rep_sid, rep_size = s[first], z[first]
        lo, hi = np.searchsorted(rs, rep_sid), np.searchsorted(rs, rep_sid, "right")
        alone = rep_size - (hi - lo)
        need = least_overlap(rep_size, t)
        p_list = np.where(rep_size >= bridge, rep_size - need + LIST_K - alone, 0)
        p_subset = np.where((rep_size <= x) & (rep_size > 1), rep_size - need + SUBSET_K - alone, 0)
        single = (need < SUBSET_K) & (hi > lo) & (t <= Fraction(1, 2))  # two such sets may share one run only
        out = {c: [] for c in ("kind", "key", "sid", "size")}
        blobs: list[tuple[int, int, bytes]] = []

        def put(kind_, keys, i):
            out["kind"].append(np.full(len(keys), kind_, np.int32))
            out["key"].append(keys)
            out["sid"].append(np.full(len(keys), rep_sid[i]))
            out["size"].append(np.full(len(keys), rep_size[i], np.int32))

        for i in np.flatnonzero((p_list >= LIST_K) | (p_subset >= SUBSET_K) | single).tolist():
            shared = rr[lo[i] : hi[i]]
            if p_list[i] >= LIST_K:
                put(0, shared[: p_list[i]], i)
            if p_subset[i] >= SUBSET_K:
                pick = np.sort(shared[: p_subset[i]]).view(np.uint64)
                a, b = np.triu_indices(len(pick), 1)
                put(1, ((pick[a] * np.uint64(0x9E3779B97F4A7C15) ^ pick[b]) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64), i)
            if single[i]:
                put(1, shared, i)
            blobs.append((rep_sid[i], rep_size[i], _packed(np.sort(shared))))
        n = sum(map(len, out["key"]))
        b = list(zip(*blobs)) or [(), (), ()]
        ints = {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()}
        k = len(s)
        made = pa.table({
            "kind": pa.array(np.concatenate([ints["kind"], np.full(len(blobs), 2), np.full(k, 3)]).astype(np.int32)),
            "key": pa.array(np.concatenate([ints["key"], np.zeros(len(blobs), np.int64), np.repeat(members, members)]).astype(np.int64)),
            "sid": pa.array(np.concatenate([ints["sid"], np.array(b[0], np.int64), s]).astype(np.int64)),
            "size": pa.array(np.concatenate([ints["size"], np.array(b[1], np.int64), z]).astype(np.int32)),
            "doc_id": pa.array(np.concatenate([np.zeros(n + len(blobs), np.int64), d]).astype(np.int64)),
            "runs": pa.array([None] * n + list(b[2]) + [None] * k, pa.binary()),
        })
        trim()
        return made

    return run


def _pair_rows(a: list[np.ndarray], b: list[np.ndarray], n: list[np.ndarray]) -> pa.RecordBatch:
    """Distinct pairs, smaller name first, with the sum of ``n``."""
    a, b = np.concatenate(a), np.concatenate(b)
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((hi, lo))
    lo, hi = lo[order], hi[order]
    first = np.flatnonzero(np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])) if len(lo) else np.zeros(0, np.int64)
    times = np.add.reduceat(np.concatenate(n)[order], first) if len(first) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(lo[first]), pa.array(hi[first]), pa.array(times.astype(np.int64))], names=["a", "b", "times"])


def _neighbours(x: int, t: Fraction):
    """Of lists in order of (kind, key, size): (a, b, times) for each set with the one before it and with the first, where sizes allow a link."""
    num, den = t.numerator, t.denominator

    def run(batches):
        before = first = None  # kind, key, sid and size of the last row, and of the first of its list
        got: list[list[np.ndarray]] = [[], [], []]
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy() for i in range(4)]
            if before is not None:
                rows = [np.concatenate([[f, p], r]) for f, p, r in zip(first, before, rows)]
            kind, key, sid, size = (r.astype(np.int64) for r in rows)
            new = np.concatenate([[True], (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])])
            head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            at = np.flatnonzero(~new)
            for other, twice in ((at - 1, np.zeros(len(at), bool)), (head[at], head[at] == at - 1)):
                ok = (size[other] * den >= size[at] * num) & (sid[other] != sid[at]) & ((kind[at] == 1) | (size[at] > x)) & ~twice
                got[0].append(sid[other[ok]])
                got[1].append(sid[at[ok]])
                got[2].append(np.where(kind[at[ok]] == 1, LIST_K, 1))
                held += int(ok.sum())
            before = [r[-1] for r in rows]
            first = [r[head[-1]] for r in rows]
            if held > _FLUSH:
                yield _pair_rows(*got)
                got, held = [[], [], []], 0
        if got[0]:
            yield _pair_rows(*got)
        trim()

    return run


def _between(x: int, t: Fraction):
    """Of lists in order of (kind, key, size): (a, b, times) for sets of different groups that meet, a subset key counting as often as a list must."""
    num, den = t.numerator, t.denominator

    def run(batches):
        held: list[list[np.ndarray]] = [[], [], []]
        total = 0

        def meet(kind, sid, size, group):
            nonlocal held, total
            m = len(sid)
            # sizes ascend: the partners of i are those behind it up to size/t, and if a list, only large ones
            last = np.searchsorted(size, size * den // num, "right")
            begin = np.arange(1, m + 1)
            if kind == 0:
                begin = np.maximum(begin, np.searchsorted(size, x, "right"))
            n = np.maximum(last - begin, 0)
            ends = np.cumsum(n)
            lo = 0
            while lo < m:  # some rows at a time
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _FLUSH, "right")))
                i = np.repeat(np.arange(lo, hi), n[lo:hi])
                j = np.arange(len(i)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi]) + np.repeat(begin[lo:hi], n[lo:hi])
                ok = group[i] != group[j]
                held[0].append(sid[i[ok]])
                held[1].append(sid[j[ok]])
                held[2].append(np.full(int(ok.sum()), LIST_K if kind else 1))
                total += int(ok.sum())
                lo = hi
                if total > _FLUSH:
                    yield _pair_rows(*held)
                    held, total = [[], [], []], 0

        pieces: list[list[np.ndarray]] = []  # of a list that goes on
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy().astype(np.int64) for i in range(5)]
            kind, key = rows[:2]
            edge = np.flatnonzero((kind[1:] != kind[:-1]) | (key[1:] != key[:-1])) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(key)]):
                if pieces and (pieces[0][0][0] != kind[lo] or pieces[0][1][0] != key[lo]):
                    whole = [np.concatenate(r) for r in zip(*pieces)]
                    yield from meet(whole[0][0], *whole[2:])
                    pieces = []
                pieces.append([r[lo:hi] for r in rows])
        if pieces:
            whole = [np.concatenate(r) for r in zip(*pieces)]
            yield from meet(whole[0][0], *whole[2:])
        if held[0]:
            yield _pair_rows(*held)
        trim()

    return run


def _packed(runs_: np.ndarray) -> bytes:
    """As many low bytes of each as the greatest needs, behind their number."""
    wide = max(1, (int(runs_.view(np.uint64).max(initial=0)).bit_length() + 7) // 8)
    return bytes([wide]) + np.ascontiguousarray(runs_.view(np.uint8).reshape(-1, 8)[:, :wide]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    wide = raw[0]
    out = np.zeros(((len(raw) - 1) // wide, 8), np.uint8)
    out[:, :wide] = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, wide)
    return out.view(np.int64).ravel()


def labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of n nodes with edges a-b the smallest node of each one's component."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        for ends in (a, b, label[a], label[b]):
            np.minimum.at(after, ends, least)
        while not np.array_equal(after, after[after]):
            after = after[after]
        if np.array_equal(after, label):
            return label
        label = after


def _verify(t: Fraction):
    def run(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        """Of the pairs at or above ``t`` a forest: (set, set it is connected with)."""
        sid, size = sets["sid"].to_numpy(), sets["size"].to_numpy()
        blob = [_unpacked(r) for r in sets["runs"].to_pylist()]
        names, dense = np.unique(np.concatenate(blob), return_inverse=True) if blob else (np.zeros(0), np.zeros(0, np.int64))
        parts = np.split(dense, np.cumsum([len(x) for x in blob])[:-1]) if blob else []
        order = np.argsort(sid)
        a = order[np.searchsorted(sid, pairs["a"].to_numpy(), sorter=order)] if len(sid) else np.zeros(0, np.int64)
        b = order[np.searchsorted(sid, pairs["b"].to_numpy(), sorter=order)] if len(sid) else np.zeros(0, np.int64)
        by = np.argsort(a, kind="stable")
        a, b = a[by], b[by]
        common = np.zeros(len(a), np.int64)
        mark = np.zeros(len(names), bool)
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else []
        for lo, hi in zip(first, np.append(first[1:], len(a)) if len(a) else []):
            mark[parts[a[lo]]] = True
            for q in range(lo, hi):
                common[q] = np.count_nonzero(mark[parts[b[q]]])
            mark[parts[a[lo]]] = False
        union = size[a].astype(np.int64) + size[b] - common
        keep = common * t.denominator >= union * t.numerator
        label = labels(a[keep], b[keep], len(sid))
        at = np.flatnonzero(label != np.arange(len(sid)))
        out = pa.table({"u": pa.array(sid[at].astype(np.int64)), "v": pa.array(sid[label[at]].astype(np.int64))})
        trim()
        return out

    return run


def _connected(pairs: DataFrame, keys: DataFrame, t: Fraction) -> DataFrame:
    """``u, v``: edges that connect what the pairs ``a, b`` at or above ``t`` connect."""
    # a set's neighbourhood is named by the smallest set that it met; most pairs of a group get one name
    named = pairs.join(pairs.groupBy("b").agg(F.min("a").alias("name")), "b")
    parts = named.groupBy("name").agg(F.ceil(F.count("*") / BLOCK_PAIRS).alias("parts")).where("parts > 1")
    tasks = max(1, -(-pairs.count() // TASK_PAIRS))
    block = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1)))
    placed = cut(named.join(parts, "name", "left").select("a", "b", F.pmod(F.xxhash64("name", block), F.lit(tasks)).alias("task")), "placed")
    ids = cut(placed.select("task", F.explode(F.array("a", "b")).alias("sid")).distinct(), "ids")
    sets = _sent(ids).join(keys.where("kind = 2").select("sid", "size", "runs"), "sid")
    return cut(sets.groupBy("task").cogroup(placed.withColumnRenamed("task", "to").groupBy("to")).applyInArrow(_verify(t), "u long, v long"), "connected")


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``id, group`` for every end of an edge (whole numbers): the smallest id that it is connected with.

    Up to ``LOCAL_EDGES`` edges are joined by one task. Beyond it, alternating large-star and small-star steps, each written
    to the shared folder, until nothing changes: a number of rounds that grows with the logarithm of the largest group.
    """

    def local(batches):
        ends = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if ends:
            a, b = (np.concatenate(x) for x in zip(*ends))
            names, dense = np.unique(np.concatenate([a, b]), return_inverse=True)
            label = labels(dense[: len(a)], dense[len(a) :], len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[label])], names=["id", "group"])

    edges = cut(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct(), "edges")
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("total")
    seen = edges.agg(F.count("*").alias("n"), total).first()
    if seen.n <= LOCAL_EDGES:
        return cut(edges.coalesce(1).mapInArrow(local, "id long, group long"), "groups")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = cut(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "large")
        small = down.join(down.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v")
        edges = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small")
        now = edges.agg(F.count("*").alias("n"), total).first()
        if now == seen:
            break
        seen = now
    # now every edge goes from a member to the smallest of its group
    return edges.select(F.col("u").alias("id"), F.col("v").alias("group")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("group")).distinct())


def _overlaps(parts: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets have in common."""
    m = len(parts)
    if m == 2:
        n = len(np.intersect1d(parts[0], parts[1], assume_unique=True))
        return np.array([[len(parts[0]), n], [n, len(parts[1])]])
    flat, own = np.concatenate(parts), np.repeat(np.arange(m, dtype=np.int32), [len(p) for p in parts])
    order = np.argsort(flat, kind="stable")
    flat, own = flat[order], own[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    df = np.diff(np.append(first, len(flat)))
    first, df = first[df > 1], df[df > 1]
    out = np.zeros((m, m), np.float32)
    if not len(first):
        return out.astype(np.int64)
    # values that the same sets hold are one column
    mixed = np.random.default_rng(5).integers(1, 1 << 63, m, dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed[own])])
    _, at, weight = np.unique(total[first + df] - total[first], return_index=True, return_counts=True)
    first, df = first[at], df[at]
    thin = df <= 6 if m > 50 else np.zeros(len(df), bool)  # columns of few sets: their pairs one by one
    for d in np.unique(df[thin]).tolist():
        which = np.flatnonzero(thin & (df == d))
        held = own[first[which][:, None] + np.arange(d)]
        i, j = np.triu_indices(d, 1)
        both = np.bincount((held[:, i].astype(np.int64) * m + held[:, j]).ravel(), np.repeat(weight[which], len(i)), m * m).reshape(m, m)
        out += (both + both.T).astype(np.float32)
    first, df, weight = first[~thin], df[~thin], weight[~thin]
    for lo in range(0, len(first), 2048):
        f, d = first[lo : lo + 2048], df[lo : lo + 2048]
        x = np.zeros((m, len(f)), np.float32)
        x[own[np.repeat(f, d) + np.arange(d.sum()) - np.repeat(np.cumsum(d) - d, d)], np.repeat(np.arange(len(f)), d)] = 1
        out += (x * weight[lo : lo + 2048].astype(np.float32)) @ x.T
    return np.rint(out).astype(np.int64)


def _linked(t: Fraction):
    """(set, links) of the sets of some groups, or of two blocks of one group."""

    def run(table: pa.Table) -> pa.Table:
        group, sid, size, block = (table[c].to_numpy() for c in ("group", "sid", "size", "block"))
        blob = table["runs"].to_pylist()
        order = np.argsort(group, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
        names, counts = [], []
        for at in np.split(order, edge[1:]):
            common = _overlaps([_unpacked(blob[k]) for k in at])
            z = size[at].astype(np.int64)
            near = common * t.denominator >= (z[:, None] + z[None] - common) * t.numerator
            np.fill_diagonal(near, False)
            if table["left"][0].as_py() != table["right"][0].as_py():  # pairs within a block are counted elsewhere
                near &= block[at][:, None] != block[at][None]
            names.append(sid[at])
            counts.append(near.sum(1))
        out = pa.table({"sid": pa.array(np.concatenate(names).astype(np.int64)), "links": pa.array(np.concatenate(counts).astype(np.int64))})
        trim()
        return out

    return run


def _links(keys: DataFrame, groups: DataFrame, t: Fraction) -> DataFrame:
    """``sid, links``: how many other sets are similar, for every set of a group."""
    sets = cut(keys.where("kind = 2").join(_sent(groups).withColumnRenamed("id", "sid"), "sid").select("group", "sid", "size", "runs"), "grouped")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("size") / BLOCK_RUNS)).cast("int")
    large = sets.groupBy("group").agg(blocks.alias("blocks")).where("blocks > 1")
    whole = sets.agg(F.count("*").alias("n"), F.sum("size").alias("runs")).first()
    tasks = max(1, -(-(whole.n or 0) // (4 * BLOCK_SETS)), -(-(whole.runs or 0) // BLOCK_RUNS))
    n = F.coalesce("blocks", F.lit(1))
    own = sets.join(large, "group", "left").withColumn("n", n).withColumn("block", F.pmod(F.xxhash64("sid"), F.col("n")).cast("int"))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    task = F.when(F.col("n") == 1, F.pmod(F.xxhash64("group"), F.lit(tasks))).otherwise(F.col("group"))
    placed = spread.select(
        (F.col("n") == 1).alias("small"), task.alias("task"), F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "group", "sid", "size", "block", "runs"
    )
    counted = placed.groupBy("small", "task", "left", "right").applyInArrow(_linked(t), "sid long, links long")
    return counted.groupBy("sid").agg(F.sum("links").alias("links"))


def _sent(ids: DataFrame) -> DataFrame:
    """To every executor where there are at most ``BROADCAST_IDS`` rows; else joins shuffle."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def _whole_number(docs: DataFrame, id_col: str) -> Column:
    """The id as a long: itself, or its hash."""
    return F.col(id_col).cast("long") if isinstance(docs.schema[id_col].dataType, IntegralType) else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))


def _grouped(docs: DataFrame, n: int, t: Fraction, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The keys with sets and documents, and ``id, group`` of the sets that are connected with another."""
    narrow = docs.select(_whole_number(docs, id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    size = narrow.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    shared = cut(_spread(narrow, n, buckets).groupBy("bucket").applyInArrow(_shared(buckets), _SHARED), "runs")
    facts = shared.where("kind = 2").select("a", "b", "c").mapInArrow(_statistics, "size long, n long").groupBy("size").agg(F.sum("n").alias("n"))
    sizes = {r["size"]: r["n"] for r in facts.collect()}
    lists, entries = sizes.pop(-1, 0), sizes.pop(-2, 0)
    x = boundary(sizes or {1: 1}, entries / max(1, lists), t)
    keys = cut(shared.where("kind < 2").groupBy("bucket").applyInArrow(_keys(x, t, buckets), _KEYS), "keys")
    lists = keys.where("kind < 2").select("kind", "key", "sid", "size")
    order = ("kind", "key", "size", "sid")
    met = lists.repartition("kind", "key").sortWithinPartitions(*order).mapInArrow(_neighbours(x, t), "a long, b long, times long")
    often = lambda pairs: pairs.groupBy("a", "b").agg(F.sum("times").alias("times")).where(F.col("times") >= LIST_K).select("a", "b")
    edges = _connected(cut(often(met), "met"), keys, t)
    # an id with several texts connects them
    several = keys.where("kind = 3").groupBy("doc_id").agg(F.min("sid").alias("v"), F.max("sid").alias("w")).where("v <> w").select("doc_id", "v")
    edges = edges.unionByName(keys.where("kind = 3").join(several, "doc_id").select(F.col("sid").alias("u"), "v").where("u <> v"))
    groups = components(edges)
    known = lists.join(_sent(groups).withColumnRenamed("id", "sid"), "sid", "left").withColumn("group", F.coalesce("group", "sid"))
    of = Window.partitionBy("kind", "key")
    mixed = known.withColumn("mixed", F.min("group").over(of) != F.max("group").over(of)).where("mixed").select("kind", "key", "sid", "size", "group")
    apart = mixed.repartition("kind", "key").sortWithinPartitions(*order).mapInArrow(_between(x, t), "a long, b long, times long")
    candidates = cut(often(apart), "candidates")
    if candidates.limit(1).count():
        more = _connected(candidates, keys, t)
        groups = components(more.unionByName(groups.select(F.col("id").alias("u"), F.col("group").alias("v"))))
    return keys, groups


def _members(keys: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``sid, doc_id, copies, least`` of documents that have a copy or a similar text, ``least`` being the class; ``sid, doc_id`` of the others."""
    m = keys.where("kind = 3").select("sid", "doc_id", (F.col("key") - 1).alias("copies")).join(_sent(groups).withColumnRenamed("id", "sid"), "sid", "left")
    some = m.where("group is not null or copies > 0").withColumn("group", F.coalesce("group", "sid"))
    least = some.groupBy("group").agg(F.min("doc_id").alias("least"))
    return some.join(least, "group").select("sid", "doc_id", "copies", "least"), m.where("group is null and copies = 0").select("sid", "doc_id")


def classes(docs: DataFrame, n: int = 3, threshold: Fraction = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, n_copies, n_links`` of every document.

    The class is the smallest id among all documents that are connected with it by similar texts; ``n_copies`` counts the other
    documents of an equal set, ``n_links`` the other sets (different texts) at or above ``threshold``.
    """
    t = Fraction(threshold)
    keys, groups = _grouped(docs, n, t, id_col, text_col)
    some, alone = _members(keys, groups)
    rows = some.join(_links(keys, groups, t), "sid", "left").select("doc_id", F.col("least").alias("class_id"), F.col("copies").alias("n_copies"), F.coalesce("links", F.lit(0)).alias("n_links"))
    zero = F.lit(0).cast("long")
    rows = rows.unionByName(alone.select("doc_id", F.col("doc_id").alias("class_id"), zero.alias("n_copies"), zero.alias("n_links")))
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        kind = id_type(docs, id_col)
        return rows.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("class_id").cast(kind).alias("class_id"), "n_copies", "n_links")
    names = docs.select(F.col(id_col).alias("name"), _whole_number(docs, id_col).alias("h")).where("h is not null").distinct()
    first = rows.join(names.withColumnRenamed("h", "doc_id"), "doc_id").withColumnRenamed("name", "own")
    second = first.join(names.withColumnRenamed("h", "class_id"), "class_id")
    return second.select(F.col("own").alias("doc_id"), F.col("name").alias("class_id"), "n_copies", "n_links")


def keep_one_of_each(docs: DataFrame, n: int = 3, threshold: Fraction = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that are connected with one of smaller id; columns, names and types as they came.

    Rows that repeat an id are kept or dropped together.
    """
    some, _ = _members(*_grouped(docs, n, Fraction(threshold), id_col, text_col))
    gone = cut(some.where("doc_id <> least").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(_sent(gone), _whole_number(docs, id_col) == F.col("__gone"), "left_anti")
