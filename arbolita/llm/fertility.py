"""Quality rules from tokeniser fertility.

Public vocabularies are run over the whole text and measure, per document and vocabulary, characters per token, the share
of byte-fallback tokens (tokens that are not whole characters; line ends and tabs don't count) and the entropy of the
document's token distribution over its greatest possible value. Each language (each script, where no language is given) has a
rejection band for every measure: from ``spread`` interquartile ranges below the lower quartile to as many above the
upper one, never narrower than ``SLACK`` on either side, and wider by the share ``least_tokens`` / tokens: a short text's
measures vary more. The quartiles are taken over all documents of the group with at least ``least_tokens`` tokens of that
vocabulary; a group with fewer than ``least_group`` such documents has no band (those of other languages would not suit it), and
its documents are kept.

Tokens are found per distinct word: both kinds of vocabulary cut before a blank, so a worker tokenises a word once. A text
with richer white space is cut at the vocabulary's own boundaries, which no token crosses.

Defined results: a null or empty text has 0 tokens, null measures and is kept; equal texts get equal measures; ties don't
matter; an empty table gives no rows; only the three named columns are read; ids keep their type.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbolita.llm.batches import id_type, slices
from arbolita.llm.words import Lexicon, literal, plain_units
from arbolita.session import cut

MEASURES = ("chars_per_token", "fallback_share", "entropy")
#: The pre-tokenisation of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Vocabulary:
    """A vocabulary file, by its ending: ``.tiktoken`` (ranks of byte-level BPE) or ``.model`` (SentencePiece)."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            sp = SentencePieceProcessor(model_file=path)
            self.size = sp.get_piece_size()
            self.fallback = np.array([sp.is_byte(k) and sp.id_to_piece(k) not in ("<0x0A>", "<0x09>", "<0x0D>") for k in range(self.size)])
            self._run = lambda words: sp.encode(words, num_threads=1)
            self._cut = re.compile(r" *\n| *[^ \n]+| +").findall
            self._words = self._pieces
            self._first_apart = False
        elif path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.size = max(ranks.values()) + 1
            self.fallback = np.zeros(self.size, bool)
            for token, k in ranks.items():
                try:
                    token.decode()
                except UnicodeDecodeError:
                    self.fallback[k] = True
            self._words = lambda words: [encoding.encode_ordinary(literal(w)) for w in words]
            self._cut = regex.compile(PATTERN).findall
            self._first_apart = True
        else:
            raise ValueError(f"{path}: neither .model nor .tiktoken")
        self.lexicon = Lexicon(self._words)

    def _pieces(self, words: list[str]) -> list[list[int]]:
        plain = [k for k, w in enumerate(words) if w[0] not in "\0\n"]
        out: list[list[int]] = [[]] * len(words)
        for k, ids in zip(plain, self._run([words[k] for k in plain])):
            out[k] = ids
        for k, w in enumerate(words):
            if w[0] in "\0\n":  # behind a line end, that the blank which the library sets before a text stays apart
                out[k] = self._run("\n" + literal(w))[2:]
        return out

    def units(self, text: str) -> list[str]:
        words = plain_units(text)
        if words is not None:
            if self._first_apart:  # the first word of a text has no blank before it
                words[0] = "\0" + words[0]
            return words
        return ["\0" + u for u in self._cut(text if self._first_apart else " " + text)]


_OPEN: dict[str, Vocabulary] = {}


def opened(path: str) -> Vocabulary:
    if path not in _OPEN:
        _OPEN[path] = Vocabulary(path)
    return _OPEN[path]


def measured(texts: list[str | None], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, fallback tokens, entropy in nats) of each text."""
    tokens, fallback, entropy = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for first, ids, ends in vocabulary.lexicon.documents(texts, vocabulary.units):
        n = np.diff(ends, prepend=0)
        doc = np.repeat(np.arange(len(ends)), n)
        key, count = np.unique(doc * vocabulary.size + ids, return_counts=True)
        at = slice(first, first + len(ends))
        tokens[at] = n
        fallback[at] = np.bincount(doc, vocabulary.fallback[ids], len(ends))
        own = key // vocabulary.size
        # sum of -p log p = log n - sum(c log c) / n
        entropy[at] = np.log(np.maximum(n, 1)) - np.bincount(own, count * np.log(count), len(ends)) / np.maximum(n, 1)
    return tokens, fallback, np.maximum(entropy, 0)


_SCRIPTS = [(0x0370, 0x0400, "Grek"), (0x0400, 0x0530, "Cyrl"), (0x0590, 0x0600, "Hebr"), (0x0600, 0x0780, "Arab"), (0x0900, 0x0980, "Deva"), (0x0E00, 0x0E80, "Thai"),
            (0x3040, 0x3100, "Kana"), (0x4E00, 0xA000, "Hani"), (0xAC00, 0xD7B0, "Hang")]


def script(text: str | None) -> str:
    """The script of most letters: ISO 15924 code, Zyyy where there is no letter, Zzzz for another one."""
    if not text:
        return "Zyyy"
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    counts = {"Latn": int((((c | 32) >= 97) & ((c | 32) <= 122)).sum() + ((c >= 0xC0) & (c < 0x250)).sum())}
    for lo, hi, name in _SCRIPTS:
        counts[name] = int(((c >= lo) & (c < hi)).sum())
    best = max(counts, key=counts.__getitem__)
    return best if counts[best] else "Zzzz" if any(ch.isalpha() for ch in text) else "Zyyy"


def measure(docs: DataFrame, vocabularies: dict[str, str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, band``, and for each vocabulary v ``v_tokens, v_chars_per_token, v_fallback_share, v_entropy``."""
    fields = [f"{v}_{m}" for v in vocabularies for m in ("tokens", *MEASURES)]

    def run(batches):
        opens = [opened(p) for p in vocabularies.values()]
        for batch in slices(batches):
            texts, langs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            chars = np.array([len(t or "") for t in texts], np.float64)
            columns = [batch.column(0), pa.array([g if g else "script " + script(t) for g, t in zip(langs, texts)], pa.string())]
            for v in opens:
                n, f, h = measured(texts, v)
                some = np.maximum(n, 1)
                top = np.log(np.minimum(np.maximum(n, 2), v.size))
                columns += [pa.array(n)] + [pa.array(x, mask=n == 0) for x in (chars / some, f / some, h / top)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "band", *fields])

    schema = f"doc_id {id_type(docs, id_col)}, band string, " + ", ".join(f"{x} {'long' if x.endswith('_tokens') else 'double'}" for x in fields)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return narrow.mapInArrow(run, schema)


SLACK = {"chars_per_token": 0.25, "fallback_share": 0.02, "entropy": 0.05}


#: Bands up to so many (some 200 bytes each) are broadcast; a column with more distinct languages is joined by shuffle.
BROADCAST_BANDS = 100_000


def bands(measures: DataFrame, vocabularies: dict[str, str], spread: float = 4.0, least_tokens: int = 100, least_group: int = 20) -> DataFrame:
    """For every language or script the ends of its bands; null under a vocabulary in which it has too few documents."""
    aggregates, ends = [], []
    for v in vocabularies:
        long = F.col(f"{v}_tokens") >= least_tokens
        aggregates.append(F.count_if(long).alias(f"n_{v}"))
        for m in MEASURES:
            aggregates.append(F.percentile_approx(F.when(long, F.col(f"{v}_{m}")), [0.25, 0.75], F.lit(10_000)).alias(f"q_{v}_{m}"))
            q = F.col(f"q_{v}_{m}")
            wide = F.greatest(spread * (q[1] - q[0]), F.lit(SLACK[m]))
            enough = F.col(f"n_{v}") >= least_group
            ends += [F.when(enough, q[0] - wide).alias(f"lo_{v}_{m}"), F.when(enough, q[1] + wide).alias(f"hi_{v}_{m}")]
    return measures.groupBy("band").agg(*aggregates).select("band", *ends)


def judge(
    docs: DataFrame, vocabularies: dict[str, str], spread: float = 4.0, least_tokens: int = 100, least_group: int = 20,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """Measures of every document, ``reasons`` (measures outside their band) and ``keep`` (there is none).

    The measures, a few numbers a document, are written once and read twice: for the bands and for the verdicts.
    """
    m = cut(measure(docs, vocabularies, id_col, text_col, lang_col), "fertility")
    b = cut(bands(m, vocabularies, spread, least_tokens, least_group), "bands")
    if b.limit(BROADCAST_BANDS + 1).count() <= BROADCAST_BANDS:
        b = F.broadcast(b)

    def reason(v: str, x: str):
        n, value, lo, hi = (F.col(f"{v}_tokens"), F.col(f"{v}_{x}"), F.col(f"lo_{v}_{x}"), F.col(f"hi_{v}_{x}"))
        more = (hi - lo) / 2 * least_tokens / F.greatest(n, F.lit(1))
        return F.when(~value.between(lo - more, hi + more), F.lit(f"{v}_{x}"))

    reasons = [reason(v, x) for v in vocabularies for x in MEASURES]
    joined = m.join(b, "band", "left").select(*m.columns, F.array_compact(F.array(*reasons)).alias("reasons"))
    return joined.withColumn("keep", F.size("reasons") == 0)
