"""SentencePiece encoding and decoding with forward scores shared along a trie of words.

The distinct marked words (a word with the mark U+2581 of the blank before it) of a batch are sorted; going through them in
that order is a depth-first walk of their trie, and the forward scores of a prefix that a word shares with its predecessor
are kept on the stack, not computed again. Back pointers give the pieces.

The forward score is the Viterbi score: the best sum of piece scores that ends here, the longer last piece first where sums are
equal. It is what a unigram model means by its scores, and ``search="viterbi"`` reads any model's pieces and scores so. A BPE
model's own ids are not such a best sum; for these (``search="merges"``, the default for BPE models) the forward value is the
one last piece under which the prefix is a valid merge result: a sequence of pieces is what BPE makes of their text exactly
if each neighbouring pair is, hence that piece is unique and extends the prefix before it. Runs of blanks, where merges tie,
are merged by a heap, the leftmost first.

Both are held against the SentencePiece library in the tests. One rule differs: the library adds up scores over the whole text
in 32-bit floats, so in a long text its rounding can make another sum seem best; here sums are within a word and exact.
Characters outside the vocabulary become byte pieces, or one unknown piece a run where the model has none. ``Model`` refuses
what it does not follow: normalisation other than identity, white space removed, no blank put at the start, pieces defined
by the user, pieces with a mark after another character.

Defined results: a null text has null ids, an empty one an empty array; equal texts have equal ids; an empty table gives no
rows; only the two named columns are read; ids keep their type; ``round_trip`` says that the decoded ids are the text, null for
a null text (false where unknown pieces lose a character).
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbolita.llm.batches import id_type, slices
from arbolita.llm.words import Lexicon, literal, plain_units

MARK = "▁"
_UNITS = re.compile(r" *\n| *[^ \n]+| +")


def fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    i = 0

    def varint():
        nonlocal i
        v = shift = 0
        while True:
            b = data[i]
            i += 1
            v |= (b & 127) << shift
            shift += 7
            if b < 128:
                return v

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            i += n
            yield key >> 3, data[i - n : i]
        else:
            i += 8 if kind == 1 else 4
            yield key >> 3, None


def model_type(raw: bytes) -> int:
    """trainer_spec.model_type of a model file: 1 unigram (the default), 2 BPE."""
    kinds = [v for k, spec in fields(raw) if k == 2 for j, v in fields(spec) if j == 3]
    return kinds[-1] if kinds else 1


def _supported(raw: bytes) -> None:
    """An error where the model does what this module does not follow."""
    rules = {2: b"", 3: 1, 4: 1, 5: 1, 6: b""}  # charsmap, dummy prefix, white space removed, white space escaped, rules
    for k, message in fields(raw):
        if k == 3:
            rules.update(fields(message))
        elif k == 1 and 4 in (v for j, v in fields(message) if j == 3):
            raise ValueError("the model has pieces defined by the user")
    if rules[2] or rules[6]:
        raise ValueError("the model normalises texts")
    if not rules[3] or rules[4] or not rules[5]:
        raise ValueError("the model removes white space, or puts no blank before a text")


class Model:
    #: Pairs of pieces whose validity is remembered.
    MOST_PAIRS = 1_000_000

    def __init__(self, path: str, search: str | None = None):
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as f:
            raw = f.read()
        _supported(raw)
        if search not in (None, "viterbi", "merges"):
            raise ValueError(f"search {search!r}")
        sp = SentencePieceProcessor(model_proto=raw)
        self.bpe = (search or ("merges" if model_type(raw) == 2 else "viterbi")) == "merges"
        self.size = sp.get_piece_size()
        self.ids: dict[str, int] = {}
        self.score: list[float] = [sp.get_score(k) for k in range(self.size)]
        self.byte: dict[int, int] = {}
        self.unknown_id = sp.unk_id()
        self.piece: list[str] = [sp.id_to_piece(k) for k in range(self.size)]
        self.raw: list[bytes] = []
        for k, p in enumerate(self.piece):
            if sp.is_byte(k):
                self.byte[int(p[3:5], 16)] = k
                self.raw.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k):
                self.raw.append(b"")
            else:
                self.ids[p] = k
                self.raw.append(p.replace(MARK, " ").encode())
                if MARK in p.lstrip(MARK):
                    raise ValueError(f"piece {p!r} crosses a word")
        self.unknown = min(self.score[k] for k in self.ids.values()) - 10
        self.back: dict = {}
        for p, k in self.ids.items():
            node = self.back
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = k
        self._pair: dict[int, bool] = {}  # left * size + right
        self._alone: dict[int, bool] = {}

    def merged(self, word: str) -> list[int]:
        """Plain BPE, the best merge first and the leftmost of equals, by a heap; an unknown character is -1 - its code point."""
        parts: list[str | None] = list(word)
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < len(parts) and (i := self.ids.get(whole := parts[left] + parts[right])) is not None:
                heapq.heappush(heap, (-self.score[i], left, right, whole))

        for k in range(len(parts) - 1):
            offer(k, k + 1)
        while heap:
            _, left, right, whole = heapq.heappop(heap)
            if parts[left] is None or parts[right] is None or parts[left] + parts[right] != whole or after[left] != right:
                continue  # one of them has been merged since
            parts[left], parts[right] = whole, None
            after[left] = after[right]
            if after[left] < len(parts):
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [self.ids.get(p, -1 - ord(p[0])) for p in parts if p is not None]

    def _valid(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two pieces side by side."""
        if right < 0:
            return True
        if (ok := self._alone.get(right)) is None:
            ok = self._alone[right] = self.merged(self.piece[right]) == [right]
        if left < 0 or not ok:
            return ok
        if (ok := self._pair.get(left * self.size + right)) is None:
            if len(self._pair) >= self.MOST_PAIRS:
                self._pair.clear()
            ok = self._pair[left * self.size + right] = self.merged(self.piece[left] + self.piece[right]) == [left, right]
        return ok

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word (keys of the lexicon), by one depth-first walk of their trie."""
        marked = [literal(w).replace(" ", MARK) for w in words]
        out: list[list[int]] = [[]] * len(words)
        last: list[int] = [-1]  # for each prefix of the word at hand its last piece
        best: list[float] = [0.0]  # and, for a unigram model, its score
        before = ""
        pair, back, bpe, score, size = self._pair, self.back, self.bpe, self.score, self.size
        for k in sorted(range(len(marked)), key=marked.__getitem__):
            word = marked[k]
            if bpe and MARK * 2 in word:  # runs of blanks have equal scores, the leftmost first
                out[k] = self._bytes(self.merged(word))
                continue
            depth, most = 0, min(len(word), len(before))
            while depth < most and word[depth] == before[depth]:
                depth += 1
            del last[depth + 1 :], best[depth + 1 :]
            for end in range(depth + 1, len(word) + 1):
                node, start, found = back, end, []
                while start and (node := node.get(word[start - 1])) is not None:
                    start -= 1
                    if "" in node:
                        found.append((start, node[""]))
                if bpe:
                    for start, piece in reversed(found):
                        left = last[start] if start else -1
                        ok = pair.get(left * size + piece) if left >= 0 else None
                        if ok or ok is None and self._valid(left, piece):
                            last.append(piece)
                            break
                    else:
                        last.append(-1 - ord(word[end - 1]))
                else:
                    top, piece = None, 0
                    for start, p in reversed(found):
                        s = best[start] + score[p]
                        if top is None or s > top:
                            top, piece = s, p
                    if not found or found[0][0] != end - 1:
                        s = best[end - 1] + self.unknown
                        if top is None or s > top:
                            top, piece = s, -1 - ord(word[end - 1])
                    last.append(piece)
                    best.append(top)
            ids, end = [], len(word)
            while end:
                ids.append(last[end])
                end -= len(self.piece[last[end]]) if last[end] >= 0 else 1
            out[k] = self._bytes(ids[::-1])
            before = word
        return out

    def _bytes(self, ids: list[int]) -> list[int]:
        if not ids or min(ids) >= 0:
            return ids
        if self.byte:
            return [j for i in ids for j in ([i] if i >= 0 else [self.byte[b] for b in chr(-1 - i).encode()])]
        return [i if i >= 0 else self.unknown_id for k, i in enumerate(ids) if i >= 0 or not k or ids[k - 1] >= 0]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode(errors="replace")
        return text[1:] if text[:1] == " " else text


def units(text: str) -> list[str]:
    """The keys of a text's marked words."""
    words = plain_units(text)
    return words if words is not None else ["\0" + u for u in _UNITS.findall(" " + text)]


_OPEN: dict[tuple[str, str | None], tuple[Model, Lexicon]] = {}


def opened(path: str, search: str | None = None) -> tuple[Model, Lexicon]:
    """The model and lexicon of this worker process."""
    if (path, search) not in _OPEN:
        model = Model(path, search)
        _OPEN[path, search] = model, Lexicon(model.encode_words)
    return _OPEN[path, search]


def encode(docs: DataFrame, model_file: str, search: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, n_tokens, round_trip`` of every row; ``model_file`` must be readable on every executor."""

    def run(batches):
        model, lexicon = opened(model_file, search)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            for first, ids, ends in lexicon.documents(texts, units):
                part = texts[first : first + len(ends)]
                starts = np.concatenate([[0], ends[:-1]])
                null = np.array([t is None for t in part])
                listed = ids.tolist()
                same = [None if t is None else model.decode(listed[a:b]) == t for t, a, b in zip(part, starts.tolist(), ends.tolist())]
                offsets = pa.array(np.append(starts, ends[-1]).astype(np.int32), mask=np.append(null, False))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(part)),
                        pa.ListArray.from_arrays(offsets, pa.array(ids)),
                        pa.array((ends - starts).astype(np.int32), mask=null),
                        pa.array(same, pa.bool_()),
                    ],
                    names=["doc_id", "ids", "n_tokens", "round_trip"],
                )

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {id_type(docs, id_col)}, ids array<int>, n_tokens int, round_trip boolean")


def decode(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of every row; null ids give a null text. An id outside the vocabulary is an error."""

    def run(batches):
        model, _ = opened(model_file)
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {id_type(encoded, id_col)}, text string")
