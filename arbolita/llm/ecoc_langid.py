"""Language identification with error-correcting output codes.

Each language has a codeword of bits; one binary classifier per bit reads hashed byte n-grams (2 and 3 bytes of the lower
case letters, other ASCII taken as one blank) of the whole text and predicts that bit. Decoding is loss-weighted: a
language's loss is the sum over bits of weight x log(1 + exp(-bit x score)), the weight being the bit classifier's accuracy
above chance on a held-out fifth of the sample; the codeword of least loss wins. A text is ambiguous where the runner-up is nearer than ``least_gap``, or
where the least loss is over the model's ``most_loss``: it lies far from every codeword, as mixed, foreign and random texts
do. Both bounds come from that fifth (from the whole sample where the fifth has fewer than 50 texts): a quarter of the gap that 99 of 100 of its texts reach, and the loss at which
a bit is right with probability 0.9, or twice the loss that 99 of 100 texts keep to where that is more.

Training reads a bounded sample of labelled rows: at most ``per_label`` of each label and ``MOST_ROWS`` in all, those of
smallest hash of id and text, so null and repeated ids are sampled like others and equal rows count once. Features are made on
the executors; the driver gets at most 48 kB a row. More than ``MOST_LABELS`` labels are an error. Everything else covers all rows.

Defined results: a null text, or one without letters, has language ``und``, null loss and gap, and is ambiguous; ties of
the loss go to the label first in order; rows with a null label train nothing; with one label only, that label is
predicted with a null gap and nothing is ambiguous; without any label a text with letters is ``und`` too, but ambiguous is
null and ``keep_identified`` keeps it; an empty table gives no rows; repeated rows are predicted alike; ids keep their type.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbolita.llm.batches import id_type, slices

_LETTERS = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))
BUCKETS = 1 << 13
MOST_ROWS, MOST_LABELS = 4000, 500


def letters(text: str | None) -> bytes:
    """The lower-case words as UTF-8 between single blanks; b"" where no letter occurs."""
    words = text.lower().encode().translate(_LETTERS).split() if text else []
    return b" " + b" ".join(words) + b" " if words else b""


def features(raw: bytes) -> np.ndarray:
    """Share of each bucket among the n-grams of ``raw``, times 100."""
    b = np.frombuffer(raw, np.uint8).astype(np.int32)
    two = b[:-1] * 257 + b[1:]
    n = np.bincount(two * 40503 >> 3 & BUCKETS - 1, minlength=BUCKETS)
    if len(two) > 1:
        n += np.bincount((two[:-1] * 263 + b[2:]) * 40503 >> 5 & BUCKETS - 1, minlength=BUCKETS)
    return n.astype(np.float32) * np.float32(100 / max(1, n.sum()))


def codewords(labels: int, bits: int = 15, seed: int = 3) -> np.ndarray:
    """``labels`` rows of +1 and -1: all distinct splits where they are few, else random ones that lie far apart."""
    if labels < 2:
        return np.ones((labels, 1), np.int8)
    if labels <= 5:
        rest = range(1, labels)
        splits = [s for r in range(1, labels) for s in combinations(rest, r)]
        return np.array([[1 if k not in s else -1 for s in splits] for k in range(labels)], np.int8)
    rng = np.random.default_rng(seed)
    best, apart = None, -1
    for _ in range(200):
        c = rng.choice(np.array([-1, 1], np.int8), (labels, max(bits, 2 * labels)))
        if (abs(c.sum(0)) == labels).any():
            continue
        d = min(int((a != b).sum()) for a, b in combinations(c, 2))
        if d > apart:
            best, apart = c, d
    return best


@dataclass
class Model:
    labels: list[str]
    code: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    bit_weight: np.ndarray
    least_gap: float = 0.0
    most_loss: float = float("inf")

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Loss of each label (columns) for each row of features."""
        score = x @ self.weight + self.bias
        hinge = np.logaddexp(0, -score[:, None, :] * self.code[None]) * self.bit_weight
        return hinge.sum(2) / self.bit_weight.sum()


def fit(texts: list[str], labels: list[str], steps: int = 150, rate: float = 0.5) -> Model:
    """A model from texts in memory; those without letters train nothing."""
    rows = [(r, y) for r, y in ((letters(t), y) for t, y in zip(texts, labels)) if r]
    x = np.stack([features(r) for r, _ in rows]) if rows else np.zeros((0, BUCKETS), np.float32)
    return _fit(x, [y for _, y in rows], steps, rate)


def _held_out(labels: np.ndarray) -> np.ndarray:
    """Every fifth row of each label that has ten."""
    held = np.zeros(len(labels), bool)
    for k in np.unique(labels):
        at = np.flatnonzero(labels == k)
        if len(at) >= 10:
            held[at[4::5]] = True
    return held


def _fit(x: np.ndarray, labels: list[str], steps: int = 150, rate: float = 0.5) -> Model:
    """Logistic regression for every bit at once, by full-batch gradient descent with momentum."""
    names = sorted(set(labels))
    code = codewords(len(names))
    if len(names) < 2:
        return Model(names, code, np.zeros((BUCKETS, 1), np.float32), np.ones(1, np.float32), np.ones(1))
    which = np.searchsorted(names, labels)
    held = _held_out(which)
    seen, own = x[~held], which[~held]
    y = code[own].astype(np.float32)
    share = np.bincount(own, minlength=len(names))
    each = (1 / share[own] / len(names)).astype(np.float32)[:, None]
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        g = -y / (1 + np.exp(np.clip(y * (seen @ w + b), -30, 30))) * each
        vw = 0.9 * vw - rate * (seen.T @ g + 1e-4 * w)
        vb = 0.9 * vb - rate * g.sum(0)
        w += vw
        b += vb
    test = held if held.any() else ~held
    right = ((x[test] @ w + b) * code[which[test]] > 0).mean(0)
    model = Model(names, code, w, b, np.maximum(2 * right - 1, 0.05))
    judged = x[held] if held.sum() >= 50 else x
    loss = np.sort(np.concatenate([model.losses(judged[lo : lo + 256]) for lo in range(0, len(judged), 256)]), 1)
    model.least_gap = float(np.quantile(loss[:, 1] - loss[:, 0], 0.01)) / 4
    model.most_loss = max(-math.log(0.9), 2 * float(np.quantile(loss[:, 0], 0.99)))
    return model


def sample(docs: DataFrame, per_label: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame | None:
    """``y, h, t``: of each label the ``per_label`` rows of smallest hash; None where no row has a label and a text."""
    rows = docs.select(
        F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h"), F.col(text_col).alias("t"), F.col(label_col).cast("string").alias("y")
    ).where("t is not null and y is not null")
    counted = rows.groupBy("y").agg(F.approx_count_distinct("h", 0.02).alias("n")).limit(MOST_LABELS + 1).collect()
    if len(counted) > MOST_LABELS:
        raise ValueError(f"{label_col} has more than {MOST_LABELS} labels")
    if not counted:
        return None
    most = max(2, min(per_label, MOST_ROWS // len(counted)))
    # twice the share that is wanted passes, so the ranking sees a few hundred rows of a label however many it has
    limit = F.coalesce(*[F.when(F.col("y") == r.y, F.lit(min(1.0, (2 * most + 20) / max(1, r.n)))) for r in sorted(counted)])
    some = rows.where(F.pmod("h", F.lit(1 << 30)) < limit * (1 << 30)).dropDuplicates(["y", "h"])
    k = F.row_number().over(Window.partitionBy("y").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    return some.withColumn("k", k).where(F.col("k") <= most).select("y", "h", "t")


def train(docs: DataFrame, per_label: int = 400, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """Fit on a bounded sample of labelled rows."""
    rows = sample(docs, per_label, id_col, text_col, label_col)
    if rows is None:
        return fit([], [])

    def pack(batches):
        for batch in slices(batches):
            packed = []
            for t in batch.column(2).to_pylist():
                f = features(letters(t)) if letters(t) else np.zeros(0, np.float32)
                at = np.flatnonzero(f)
                packed.append(at.astype(np.uint16).tobytes() + f[at].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["y", "h", "f"])

    some = sorted((r.y, r.h, bytes(r.f)) for r in rows.mapInArrow(pack, "y string, h long, f binary").collect() if r.f)
    x = np.zeros((len(some), BUCKETS), np.float32)
    for k, (_, _, raw) in enumerate(some):
        n = len(raw) // 6
        x[k, np.frombuffer(raw, np.uint16, n)] = np.frombuffer(raw[2 * n :], np.float32)
    return _fit(x, [y for y, _, _ in some])


def _decoded(texts: list[str | None], model: Model, least_gap: float | None) -> list[tuple]:
    """(language, loss, gap, ambiguous) of each text."""
    out: list[tuple] = [("und", None, None, True)] * len(texts)
    if not model.labels:
        return [("und", None, None, None if letters(t) else True) for t in texts]
    least_gap = model.least_gap if least_gap is None else least_gap
    for lo in range(0, len(texts), 256):
        raw = [(i, r) for i, r in ((i, letters(t)) for i, t in enumerate(texts[lo : lo + 256], lo)) if r]
        if not raw:
            continue
        loss = model.losses(np.stack([features(r) for _, r in raw]))
        best = loss.argmin(1)
        for (i, _), k, row in zip(raw, best.tolist(), loss):
            gap = float(np.partition(row, 1)[1] - row[k]) if len(row) > 1 else None
            out[i] = (model.labels[k], float(row[k]), gap, gap is not None and (gap < least_gap or float(row[k]) > model.most_loss))
    return out


#: A runner-up whose mean loss per bit is nearer than this leaves the text ambiguous; None: the model's own bound.
LEAST_GAP = None


def identify(docs: DataFrame, model: Model, least_gap: float | None = LEAST_GAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, predicted, loss, gap, ambiguous`` for every row."""

    def run(batches):
        for batch in slices(batches):
            got = list(zip(*_decoded(batch.column(1).to_pylist(), model, least_gap))) or [()] * 4
            kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(got, kinds))], names=["doc_id", "predicted", "loss", "gap", "ambiguous"]
            )

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {id_type(docs, id_col)}, predicted string, loss double, gap double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: Model, least_gap: float | None = LEAST_GAP, text_col: str = "text") -> DataFrame:
    """The rows whose language is certain; columns, names and types as they came."""
    where = docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array([not x[3] for x in _decoded(batch.column(where).to_pylist(), model, least_gap)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
