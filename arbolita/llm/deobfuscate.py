"""Personal data behind disguises, found on a normalised text and mapped back to the source characters.

Three transducers rewrite the text. Each is a list of edits (source start, source end, replacement); whatever lies between
edits is copied, so the composition is a piecewise map from positions of the normalised text to those of the source:

1. characters: homoglyphs of other scripts, full-width forms and foreign digits become their ASCII twins, invisible
   characters vanish;
2. spelled digits: a run of at least seven digit words ("five oh one ...", English, German, French or Spanish) becomes digits;
3. at/dot disguises: "(at)", "[dot]", " at ... dot ...", in capitals or not, between address-like words become "@" and ".". Where
   there is no bracket or sign, only bare words, the last label must be a common top-level domain, as "at" and "dot" are words.

Identifiers are then matched on the normalised text and every span is mapped back: [start, end) counts characters (code
points) of the source. Kinds: email; phone (with "+", brackets or parted groups; ten bare digits only behind a word such as
"tel" or where they were spelled out); card (13 to 19 digits, blanks or hyphens between groups, first digit 2 to 6, with a
valid Luhn checksum); ipv4; secret (a named token, key or password with a value of 16 or more signs). Overlapping spans are
resolved in favour of the earlier, then the longer, then the kind named first here. Each kind has its own cheap test of
whether a stretch can hold it; none depends on the rest of the text.

Defined results: a null or empty text has no spans; text without identifiers is untouched; equal texts get equal spans;
an empty table gives no rows; rows with a null id are reported with that id; ids keep their type; other columns are not read
by ``find`` and come back unchanged from ``redact``, but for a length column of whole numbers.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from arbolita.llm.batches import id_type, slices

_TWINS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ⅼ": "l", "ℓ": "l", "ı": "i", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "\u00a0": " ", "\u2009": " ", "\u202f": " ",
}
_TWINS |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_TWINS |= {chr(base + d): str(d) for base in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
_TWINS |= {c: "" for c in "\u00ad\u200b\u200c\u200d\u2060\ufeff"}
_STRANGE = re.compile("[" + "".join(map(re.escape, _TWINS)) + "]")

_DIGIT = {
    w: str(d)
    for words in (
        "zero one two three four five six seven eight nine", "oh", "null eins zwei drei vier fünf sechs sieben acht neun", "null ein zwo",
        "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for d, w in enumerate(words.split())
}
_WORD = "(?:" + "|".join(sorted(_DIGIT, key=len, reverse=True)) + ")"
_SPELLED = re.compile(rf"(?i)\b{_WORD}(?:[ \-.,]{{1,3}}{_WORD}){{6,}}\b")
_EACH = re.compile(rf"(?i){_WORD}")
_SEVEN = b"\x01" * 7
_AT = r"(?:\s?[\(\[\{<]\s?(?:(?i:at)|@)\s?[\)\]\}>]\s?|\s(?i:at)\s)"
_DOT = r"(?:\s?[\(\[\{<]\s?(?:(?i:dot)|\.)\s?[\)\]\}>]\s?|\s(?i:dot)\s)"
_NAME, _HOST = r"[A-Za-z0-9_%+\-]{1,64}", r"[A-Za-z0-9\-]{1,63}"
# a bare " at " counts only with a spelled dot behind it; a bracketed one or a real "@" also with a plain dot
_DISGUISED = re.compile(
    rf"(?<![A-Za-z0-9]){_NAME}(?:(?:{_DOT}|\.){_NAME}){{0,126}}"
    rf"(?:(?:{_AT}|@){_HOST}(?:\.{_HOST}){{0,126}}{_DOT}{_HOST}(?:(?:{_DOT}|\.){_HOST}){{0,126}}"
    rf"|\s?[\(\[\{{<]\s?(?:(?i:at)|@)\s?[\)\]\}}>]\s?{_HOST}(?:\.{_HOST}){{1,126}})(?![A-Za-z0-9])"
)
_TLD = frozenset(
    "com org net edu gov mil int info biz name io ai app dev co me tv us uk ca au nz ie de at ch fr be nl lu es pt it gr pl cz sk hu ro bg "
    "se no dk fi is ee lv lt ru ua tr il in cn jp kr tw hk sg my th id ph vn br mx ar cl pe za ng ke eg eu cat xyz site online store tech".split()
)
_BRACKETED = tuple(b + g + w for b in "([{<" for g in ("", " ") for w in ("at", "@"))
_OPEN = re.compile(r"[(\[{<@]")
_INNER = re.compile(rf"(?P<at>{_AT}|@)|(?P<dot>{_DOT})")

_KINDS = ("email", "phone", "card", "ipv4", "secret")
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9_%+\-](?:[A-Za-z0-9._%+\-]{0,63})@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62})\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
_NUMBER = re.compile(r"[+(]*\d[\d ().\-]{5,}")
_IPV4 = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")
_PHONE = re.compile(r"(?<![\d+])(?:\+\d{1,3}[ .\-]?)?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)|(?<!\d)\+\d{1,3}(?:[ .\-]?\(?\d{2,4}\)?){2,4}(?!\d)")
_BARE = re.compile(r"\d{10}")
_CALL = re.compile(r"(?i)\b(?:tel|t[eé]l[eé]fon\w*|t[eé]l[eé]phone|phone|call|dial|fax|sms|mobile?|m[oó]vil|cell|handy|whatsapp|rufnummer)\b[^\w\n]{0,3}(?:\w{1,8}[^\w\n]{1,3}){0,2}$")
_CARD = re.compile(r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){2,3}(?:[ \-]\d{1,3})?|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d)")
_NAMES = ("token", "secret", "passw", "key", "akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")
_SECRET = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api[_\- ]?key|access[_\- ]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_\-]{16,})|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,})(?![A-Za-z0-9])")


class Mapped:
    """A text together with the map from its positions to those of the source."""

    __slots__ = ("text", "_at", "_source")

    def __init__(self, text: str):
        self.text, self._at, self._source = text, None, None

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans (in order, disjoint) of the current text; positions stay mapped to the original source."""
        if not edits:
            return
        parts, at, source, done, size = [], [], [], 0, 0
        for lo, hi, put in edits:
            parts += [self.text[done:lo], put]
            at += [(size, done, lo, True), (size + lo - done, lo, hi, False)]
            size += lo - done + len(put)
            done = hi
        parts.append(self.text[done:])
        at.append((size, done, len(self.text), True))
        before = self.span if self._at is not None else (lambda lo, hi: (lo, hi))
        rows = []
        for pos, lo, hi, copied in at:
            if copied and self._at is not None:  # a copied stretch keeps the finer pieces it had
                rows += [(pos + max(p, lo) - lo, s + (max(p, lo) - p if c else 0), e, c) for p, q, s, e, c in self._pieces() if p < hi and q > lo]
            elif lo < hi:
                s, e = before(lo, hi)
                rows.append((pos, s, e, copied))
        self.text = "".join(parts)
        self._source = rows
        self._at = [r[0] for r in rows]

    def _pieces(self):
        ends = [*self._at[1:], len(self.text)]
        for (p, s, e, c), q in zip(self._source, ends):
            yield p, q, s, e, c

    def span(self, lo: int, hi: int) -> tuple[int, int]:
        """The source span behind [lo, hi) of the current text; an edit that it touches counts whole."""
        if self._at is None:
            return lo, hi
        p, s, _, copied = self._source[bisect_right(self._at, lo) - 1]
        start = s + lo - p if copied else s
        p, s, e, copied = self._source[bisect_right(self._at, hi - 1) - 1]
        return start, (s + hi - p if copied else e)

    def edited(self, lo: int, hi: int) -> bool:
        """Whether an edit put signs into [lo, hi) of the current text."""
        return self._at is not None and any(p < hi and q > lo and not c for p, q, _, _, c in self._pieces())


def normalise(text: str) -> Mapped:
    m = Mapped(text)
    if not text.isascii():
        try:
            text.encode("latin-1")
            strange = "\u00a0" in text or "\u00ad" in text
        except UnicodeEncodeError:
            strange = True
        if strange:
            m.edit([(x.start(), x.end(), _TWINS[x.group()]) for x in _STRANGE.finditer(m.text)])
    low = m.text.lower()
    if _SEVEN in bytes(map(_DIGIT.__contains__, low.replace("-", " ").replace(".", " ").replace(",", " ").split())):
        m.edit([(x.start(), x.end(), "".join(_DIGIT[d.lower()] for d in _EACH.findall(x.group()))) for x in _SPELLED.finditer(m.text)])
    if "dot" in low or any(x in low for x in _BRACKETED):
        edits = []
        for x in _DISGUISED.finditer(m.text):
            if _OPEN.search(x.group()) or re.split(r"[^A-Za-z0-9\-]+", x.group())[-1].lower() in _TLD:
                edits += [(x.start() + y.start(), x.start() + y.end(), "@" if y.group("at") else ".") for y in _INNER.finditer(x.group())]
        m.edit(edits)
    return m


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def spans(text: str | None) -> list[tuple[str, int, int, str, bool]]:
    """(kind, start, end, normalised value, disguised) of each identifier, in order of the source."""
    if not text:
        return []
    m = normalise(text)
    t, found = m.text, []
    if "@" in t:
        found += [("email", x.start(), x.end()) for x in _EMAIL.finditer(t)]
    for x in _NUMBER.finditer(t):  # a longest stretch of digits and what may part them
        lo, hi = x.span()
        if t.count(".", lo, hi) >= 3:
            found += [("ipv4", *y.span()) for y in _IPV4.finditer(t, lo, hi)]
        for y in _PHONE.finditer(t, lo, hi):
            if _BARE.fullmatch(y.group()) is None or _CALL.search(t, max(0, y.start() - 40), y.start()) or m.edited(*y.span()):
                found.append(("phone", *y.span()))
        found += [("card", *y.span()) for y in _CARD.finditer(t, lo, hi) if "2" <= t[y.start()] <= "6" and luhn(re.sub(r"\D", "", y.group()))]
    low = t.lower()
    for x in _SECRET.finditer(t) if any(w in low for w in _NAMES) else ():
        k = 1 if x.group(1) else 0
        found.append(("secret", x.start(k), x.end(k)))
    out, done = [], 0
    for kind, lo, hi in sorted(set(found), key=lambda f: (f[1], -f[2], _KINDS.index(f[0]))):
        if lo >= done:
            a, b = m.span(lo, hi)
            out.append((kind, a, b, t[lo:hi], t[lo:hi] != text[a:b]))
            done = hi
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per identifier: ``doc_id, kind, start, end, value`` (normalised), ``disguised``."""
    names = ["kind", "start", "end", "value", "disguised"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]

    def run(batches):
        for batch in slices(batches):
            at, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                got = spans(text)
                at += [i] * len(got)
                out += got
            if out:
                columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=["doc_id", *names])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {id_type(docs, id_col)}, kind string, start int, end int, value string, disguised boolean")


def masked(text: str | None) -> str | None:
    """The text with every identifier replaced by its kind in angle brackets."""
    if not text:
        return text
    parts, done = [], 0
    for kind, lo, hi, *_ in spans(text):
        parts += [text[done:lo], f"<{kind}>"]
        done = hi
    return "".join([*parts, text[done:]]) if parts else text


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows with identifiers masked; ``length_col``, where there is one of whole numbers, is the new length of a text that changed."""
    where, schema = docs.columns.index(text_col), docs.schema
    whole = length_col in docs.columns and isinstance(schema[length_col].dataType, IntegralType)
    length = docs.columns.index(length_col) if whole else None

    def run(batches):
        for batch in slices(batches):
            old = batch.column(where).to_pylist()
            new = [masked(t) for t in old]
            columns = list(batch.columns)
            columns[where] = pa.array(new, batch.column(where).type)
            if length is not None:
                sizes = [n if a is b or a == b else len(b) for a, b, n in zip(old, new, columns[length].to_pylist())]
                columns[length] = pa.array(sizes, columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)
