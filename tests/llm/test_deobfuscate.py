import random
import re

import pytest

from arbolita.llm import deobfuscate as D
from tests.llm.edges import LONG, edge, empty, row

CASES = [
    ("mail john.doe at example dot com now", [("email", "john.doe at example dot com", "john.doe@example.com")]),
    ("john [at] exam-ple [dot] co.uk!", [("email", "john [at] exam-ple [dot] co.uk", "john@exam-ple.co.uk")]),
    ("john (at) example.com", [("email", "john (at) example.com", "john@example.com")]),
    ("x j\u043ehn@ex\u0430mple.com y", [("email", "j\u043ehn@ex\u0430mple.com", "john@example.com")]),
    ("a\u200b jo\u200bhn@ex\u200bample.com", [("email", "jo\u200bhn@ex\u200bample.com", "john@example.com")]),
    ("call five five five one two three four five six seven ok", [("phone", "five five five one two three four five six seven", "5551234567")]),
    ("\uff15\uff15\uff15-\uff11\uff12\uff13-\uff14\uff15\uff16\uff17", [("phone", "\uff15\uff15\uff15-\uff11\uff12\uff13-\uff14\uff15\uff16\uff17", "555-123-4567")]),
    ("+1 (377) 555-0271 tihaing", [("phone", "+1 (377) 555-0271", "+1 (377) 555-0271")]),
    ("a 4111 1111 1111 1111. b 4845168114407329", [("card", "4111 1111 1111 1111", "4111 1111 1111 1111"), ("card", "4845168114407329", "4845168114407329")]),
    ("ip 96.153.118.61.", [("ipv4", "96.153.118.61", "96.153.118.61")]),
    ('token = "cb1a9fee807a05366fcb8b6c95c7c565ede51a72" th', [("secret", "cb1a9fee807a05366fcb8b6c95c7c565ede51a72", "cb1a9fee807a05366fcb8b6c95c7c565ede51a72")]),
    ("look at the dot matrix at noon", []),
    ("In 2019 we saw 12 of 300, at 3.14 or 1.2.3.4.5", []),
    ("one of the seven, at eight or nine", []),
]


@pytest.mark.parametrize("text, want", CASES)
def test_cases(text, want):
    assert [(k, text[a:b], v) for k, a, b, v, _ in D.spans(text)] == want


def test_map_against_brute_force():
    """Three rounds of edits, and the map kept character by character."""
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choices("abcd", k=r.randint(1, 30)))
        m = D.Mapped(text)
        origin = [(k, k + 1) for k in range(len(text))]
        current = text
        for _ in range(3):
            edits, at = [], 0
            while at < len(current):
                at += r.randint(0, 5)
                n = r.randint(1, 3)
                if at + n <= len(current):
                    edits.append((at, at + n, "".join(r.choices("xyz", k=r.randint(0, 4)))))
                at += n
            new, where, done = "", [], 0
            for lo, hi, put in edits:
                new += current[done:lo] + put
                where += origin[done:lo] + [(origin[lo][0], origin[hi - 1][1])] * len(put)
                done = hi
            current, origin = new + current[done:], where + origin[done:]
            m.edit(edits)
            assert m.text == current
            for lo in range(len(current)):
                for hi in range(lo + 1, len(current) + 1):
                    assert m.span(lo, hi) == (origin[lo][0], origin[hi - 1][1])


def test_planted(spark):
    r = random.Random(4)
    rows, want = [], set()
    for i in range(200):
        words = r.choices(["the", "dot", "seven", "éclair", "mat", "on"], k=60)
        value = r.choice(["ann.b@mail3.example.com", "+1 (123) 555-0199", "4845168114407329", "10.20.30.40", "ann at mail dot example dot com"])
        at = r.randrange(60)
        words[at] = f"| {value} |"
        text = " ".join(words)
        rows.append((i, text))
        want.add((i, text.index(value), text.index(value) + len(value)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(x.doc_id, x.start, x.end) for x in D.find(df).collect()} == want
    assert all(re.search(r"\| <\w+> \|", x.text) for x in D.redact(df).collect())


def test_edges(spark):
    df = edge(spark, [row(9, LONG + " me@here.org"), row(None, "me@here.org"), row(10, "me@here.org"), row(10, "me@here.org")])
    got = sorted(((x.doc_id or 0), x.start, x.end, x.value) for x in D.find(df).collect())
    assert got == [(0, 0, 11, "me@here.org"), (9, len(LONG) + 1, len(LONG) + 12, "me@here.org"), (10, 0, 11, "me@here.org"), (10, 0, 11, "me@here.org")]
    out = D.redact(df)
    assert out.schema == df.schema
    by = {x.doc_id: x for x in out.collect()}
    assert by[10].text == "<email>" and by[10].n_chars == 7 and by[2].text is None and by[3].text == "" and by[4].text == LONG
    assert D.find(empty(spark)).count() == 0 and D.redact(empty(spark)).count() == 0


@pytest.mark.parametrize("address", ["10.0.0.1", "8.8.8.8", "127.0.0.1", "1.2.3.40"])
def test_addresses_of_few_digits(address):
    """The only digits of the text, or beside others: the same address is found and masked."""
    for text in (f"the host {address} answers", address, f"é {address}.", f"in 2019 the host {address} cost 300"):
        assert [(k, text[a:b]) for k, a, b, *_ in D.spans(text)] == [("ipv4", address)]
        assert D.masked(text) == text.replace(address, "<ipv4>")


@pytest.mark.parametrize("written", [
    "john (AT) example (DOT) com", "john [AT] example.com", "john[AT]example[DOT]com", "john {At} example <Dot> com", "john At example Dot com",
])
def test_disguises_in_capitals(written):
    assert [(k, v) for k, _, _, v, _ in D.spans(f"mail {written} now")] == [("email", "john@example.com")]
    assert D.masked(f"mail {written} now") == "mail <email> now"
    assert D.spans("Look AT the DOT matrix, [AT] noon (DOT) done") == []


@pytest.mark.parametrize("text, want", [
    ("order 1234567890", []), ("isbn 9781234567897 and 4845168114407328", []), ("tel. 1234567890", [("phone", "1234567890")]), ("call me at 1234567890", [("phone", "1234567890")]),
    ("(123) 456-7890 or 123-456-7890", [("phone", "(123) 456-7890"), ("phone", "123-456-7890")]),
    ("cinco cinco cinco uno dos tres cuatro cinco seis siete", [("phone", "5551234567")]), ("null eins fünf, null eins fünf, vier drei zwei eins", [("phone", "0150154321")]),
    ("john (at) site.photography", [("email", "john@site.photography")]), ("a (at) b.c.d.e.f.g.h.com", [("email", "a@b.c.d.e.f.g.h.com")]), ("we met at noon dot photography", []),
])
def test_what_counts(text, want):
    assert [(k, v) for k, _, _, v, _ in D.spans(text)] == want


def brute(text):
    """Addresses and cards among all stretches, by their definition; the longest at the earliest place first."""
    found, done = [], 0
    sign = lambda k: text[k] if 0 <= k < len(text) else " "
    for lo in range(len(text)):
        for hi in range(min(len(text), lo + 25), lo, -1):
            x = text[lo:hi]
            if lo < done or not (x[0].isdigit() and x[-1].isdigit()) or sign(lo - 1).isdigit() or sign(hi).isdigit():
                continue
            parts = x.split(".")
            if len(parts) == 4 and all(p.isdigit() and int(p) < 256 and (len(p) < 3 or p[0] in "12") for p in parts):
                if sign(lo - 1) != "." and not (sign(hi) == "." and sign(hi + 1).isdigit()):
                    found.append(("ipv4", lo, hi))
                    done = hi
                    break
            groups = [len(g) for g in re.split("[ -]", x)]
            shaped = len(groups) == 1 and 13 <= groups[0] <= 19 or groups in ([4, 6, 5], [4] * 3, [4] * 4) or groups[:-1] in ([4] * 3, [4] * 4) and groups[-1] < 4
            if shaped and all(c in "0123456789 -" for c in x) and x[0] in "23456":
                d = [int(c) for c in x if c.isdigit()]
                if sum(c if (len(d) - k) % 2 else sum(divmod(2 * c, 10)) for k, c in enumerate(d)) % 10 == 0:
                    found.append(("card", lo, hi))
                    done = hi
                    break
    return found


def test_numbers_against_brute_force():
    r = random.Random(9)
    some = 0
    for _ in range(400):
        words = []
        for _ in range(r.randint(1, 6)):
            n = r.choice([1, 2, 3, 4, 4, 13, 16, 19])
            word = "".join(r.choices("0123456789", k=n))
            if n >= 13 and r.random() < 0.8:  # made valid
                word = next(w for w in (head + word[1:-1] + c for head in [r.choice("3456")] for c in "0123456789") if D.luhn(w))
                word = r.choice([word, " ".join(word[k : k + 4] for k in range(0, n, 4))])
            elif r.random() < 0.5:
                word = ".".join(str(r.randint(0, 300)) for _ in range(r.randint(3, 5)))
            words.append(word)
        text = r.choice(["", "é "]) + r.choice([" | ", ", x "]).join(words) + r.choice(["", ".", " y"])
        got = [(k, a, b) for k, a, b, *_ in D.spans(text) if k != "phone"]
        want = [x for x in brute(text) if not any(k == "phone" and a < x[2] and b > x[1] for k, a, b, *_ in D.spans(text))]
        assert got == want, text
        some += len(got)
    assert some > 200


def test_other_columns_and_ids(spark):
    df = spark.createDataFrame([("u-1", "me@here.org", "many"), (None, "x", None)], "doc_id string, text string, n_chars string")
    assert [(x.doc_id, x.value) for x in D.find(df).collect()] == [("u-1", "me@here.org")]
    assert [(x.text, x.n_chars) for x in D.redact(df).collect()] == [("<email>", "many"), ("x", None)]
    twice = spark.createDataFrame([(1, "a@b.org, c@d.org")] * 2, "doc_id int, text string")
    got = D.find(twice).collect()
    assert len(got) == 4 and D.find(twice).schema["doc_id"].dataType.simpleString() == "int"
