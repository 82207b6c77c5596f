"""Tree edit distance and line diffs: the two comparisons that no built-in expresses."""

from __future__ import annotations

import difflib
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbolita.operators.nodes import UNUSUAL, flatten


def _postorder(rows: list[tuple]) -> tuple[list[str], list[int], list[int]]:
    """Labels, leftmost leaf of each node and key roots, in postorder, from preorder rows."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][1], -rows[k][4]))  # by last descendant, deeper first
    place = {k: i for i, k in enumerate(order)}
    first: dict[int, int] = {}
    for k in order:
        if rows[k][8] == 0:
            first[k] = place[k]
    for k in reversed(range(len(rows))):  # a node's leftmost leaf is that of its first child, the next in preorder
        if k not in first:
            first[k] = first[k + 1]
    labels = [rows[k][6] if rows[k][5] in ("Action", "Condition") and rows[k][6] else rows[k][5] for k in order]
    left = [first[k] for k in order]
    last = {l: i for i, l in enumerate(left)}
    return labels, left, sorted(last.values())


def edit_distance(a: list[tuple], b: list[tuple]) -> int:
    """Unit-cost edit distance of two ordered labelled trees given as preorder rows."""
    return distance(_postorder(a), _postorder(b))


def distance(a: tuple[list[str], list[int], list[int]], b: tuple[list[str], list[int], list[int]]) -> int:
    """The same of two trees in postorder. Where one of two subtrees is a single node, all but one of the other's nodes are put in, and that one is
    renamed unless the label occurs; the other key roots go through the forests by plain lists."""
    (la, fa, ka), (lb, fb, kb) = a, b
    if la == lb and fa == fb:
        return 0
    # equal roots may always be matched, so two that have one child each are left out
    while la[-1] == lb[-1] and len(la) > 1 < len(lb) and fa[-2] == fb[-2] == 0:
        la, fa, ka, lb, fb, kb = la[:-1], fa[:-1], [*ka[:-1], len(la) - 2], lb[:-1], fb[:-1], [*kb[:-1], len(lb) - 2]
    nb = len(lb)
    within = [set(lb[fb[q] : q + 1]) for q in range(nb)]
    tree: list[list[int]] = [[]] * len(la)
    for p, label in enumerate(la):
        tree[p] = [q - fb[q] + (label not in within[q]) for q in range(nb)] if fa[p] == p else [0] * nb
    for p in range(len(la)):
        if fa[p] != p:
            inside, size, row = set(la[fa[p] : p + 1]), p - fa[p], tree[p]
            for q in range(nb):
                if fb[q] == q:
                    row[q] = size + (lb[q] not in inside)
    big = [j for j in kb if fb[j] != j]
    for i in ka:
        lo = fa[i]
        if lo == i:
            continue
        for j in big:
            left = fb[j]
            columns = range(left, j + 1)
            forests = [list(range(j - left + 2))]
            for p in range(lo, i + 1):
                before, back, own, label = forests[-1], forests[fa[p] - lo], tree[p], la[p]
                whole = fa[p] == lo
                last = p - lo + 1
                row = [last]
                y = 0
                for q in columns:
                    up = before[y + 1]
                    if up < last:
                        last = up
                    last += 1
                    f = fb[q]
                    if whole and f == left:
                        swap = before[y] + (label != lb[q])
                        if swap < last:
                            last = swap
                        own[q] = last
                    else:
                        swap = back[f - left] + own[q]
                        if swap < last:
                            last = swap
                    row.append(last)
                    y += 1
                forests.append(row)
    return tree[-1][-1]


def postorder(text: str | None) -> tuple[list[str], list[int], list[int]] | None:
    """Labels, leftmost leaves and key roots of a document, from expat's events; None where it doesn't parse."""
    if not text or any(x in text for x in UNUSUAL):
        rows, error = flatten(text)
        return None if error else _postorder(rows)
    labels: list[str] = []
    left: list[int] = []
    last: dict[int, int] = {}
    stack: list[tuple[str, int]] = []

    def start(tag, attrs):
        stack.append(((tag == "Action" or tag == "Condition") and attrs.get("ID") or tag, len(labels)))

    def end(tag):
        label, first = stack.pop()
        last[first] = len(labels)
        labels.append(label)
        left.append(first)

    parser = expat.ParserCreate("utf-8", "}")
    parser.StartElementHandler, parser.EndElementHandler = start, end
    try:
        parser.Parse(text.strip().lstrip("\ufeff"), True)
    except (expat.ExpatError, ValueError):
        rows, error = flatten(text)
        return None if error else _postorder(rows)
    return labels, left, sorted(last.values())


def tree_distance(pairs: DataFrame, id_col: str, a: str, b: str) -> DataFrame:
    """``id, distance``: null where a document is null or doesn't parse."""

    def run(batches):
        held, made = None, None  # the second document of a pair is often the first of the next
        for batch in batches:
            out = []
            for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                p = made if x == held else postorder(x)
                q = postorder(y)
                held, made = y, q
                out.append(None if p is None or q is None else distance(p, q))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["id", "distance"])

    return pairs.select(F.col(id_col).cast("string").alias("id"), F.col(a).alias("a"), F.col(b).alias("b")).mapInArrow(run, "id string, distance long")


def unified_diff(pairs: DataFrame, id_col: str, a: str, b: str) -> DataFrame:
    """``id, diff, added, removed``: the unified line diff, or the word that both are identical."""

    def run(batches):
        for batch in batches:
            out = []
            for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = list(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), "A", "B", lineterm=""))
                body = lines[2:]
                out.append(("\n".join(lines) or "identical", sum(s[0] == "+" for s in body if s), sum(s[0] == "-" for s in body if s)))
            text, plus, minus = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(plus, pa.int32()), pa.array(minus, pa.int32())], names=["id", "diff", "added", "removed"])

    return pairs.select(F.col(id_col).cast("string").alias("id"), F.col(a).alias("a"), F.col(b).alias("b")).mapInArrow(run, "id string, diff string, added int, removed int")
