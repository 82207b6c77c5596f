import html
import random
import re
import time

from arbolita.llm import html_tree as H
from tests.llm.edges import edge, empty

P = "This is a paragraph of the article, with commas, and quite enough words to be scored as one of some weight, as it should be."


def test_best_container_and_siblings():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style><script>var x = "<p>{P}</p>";</script></head><body>
    <nav><ul>{"".join(f"<li><a href=/{k}>link number {k}, a long one, with commas, and words</a></li>" for k in range(20))}</ul></nav>
    <div class="ad">Buy this now, it is cheap, very cheap, and good, or so we say.</div>
    <div id=main><h1>Head &amp; shoulders</h1><p>{P}<p>{P} Second.<ul><li>one<li>two</ul></div>
    <p>{P} A sibling.</p><p>short.</p><p><a href=x>{P}</a></p><footer><p>{P} Footer.</p></footer><!-- <p>{P} comment</p> --></body></html>"""
    text, score, kept = H.extract(page)
    lines = text.split("\n")
    assert lines == ["Head & shoulders", P, P + " Second.", "one", "two", P + " A sibling.", "short."]
    assert score > 5 and kept == 3


def test_link_density_discounts():
    linked = "<p>" + "".join(f"<a href=#>{P}</a>" for _ in range(6)) + "</p>"
    text, _, _ = H.extract(f"<body><div>{linked * 3}</div><div><p>{P}</p><p>{P}</p></div></body>")
    assert text == f"{P}\n{P}"


def test_ties_go_to_the_first():
    text, _, kept = H.extract(f"<section><article><p>{P} one</p></article></section><section><article><p>{P} two</p></article></section>")
    assert text.startswith(P + " one")


def test_any_input():
    for page in ["", "<", "<p", "</p></div>", "<a><b>" * 3000, "<p>" * 3000, "<table><tr><td>a<td>b<tr><td>c", "<script>", "\0<p>\0", "<!--", "&amp &#x110000; &nosuch;", "<p " + "x='" * 50]:
        text, score, kept = H.extract(page)
        assert isinstance(text, str) and score >= 0 and kept >= 0
    assert H.extract(None) == (None, 0.0, 0)
    assert H.extract("plain & simple")[0] == "plain & simple"
    assert H.extract("<ul><li>one<li>two</ul>")[0] == "one\ntwo"


def test_edges(spark):
    df = edge(spark)
    rows = {x.page_id: x for x in H.main_text(df, "doc_id", "text").collect()}
    assert rows[2].text is None and rows[3].text == "" and rows[1].text.startswith("the cat")
    assert H.main_text(df, "doc_id", "text").count() == df.count()
    assert H.main_text(empty(spark), "doc_id", "text").count() == 0


APART = ("nav", "footer", "aside", "form", "header")
BLOCKS = ("div", "section", "article", "p", "ul", "li", "h2", "blockquote", *APART)


def grown(r, depth=0):
    """A random element that HTML reads back as it is: (tag, class, children)."""
    tag = r.choice(["div", "div", "section", "article", "ul", "blockquote", "nav", "aside", "p", "p", "p", "a", "span", "h2", "script"] if depth else ["body"])
    cls = r.choice(["", "", "", "sidebar", "x ad", "story"])
    if tag in ("p", "a", "span", "h2", "script"):
        kids = [words(r) for _ in range(r.randint(0, 2))]
        if tag == "p" and r.random() < 0.5:
            kids.insert(r.randrange(len(kids) + 1), ("a", "", [words(r)]))
        return tag, cls, kids if tag != "script" else ["var x, y;"]
    kids = []
    for _ in range(r.randint(0, 5) if depth < 5 else 0):
        kids.append(words(r) if tag != "ul" and r.random() < 0.3 else ("li", "", [words(r)]) if tag == "ul" else grown(r, depth + 1))
    return tag, cls, kids


def words(r):
    return " ".join(r.choices(["one", "two,", "three", "long & strange", "word.", "the,", "end of it"], k=r.choice([1, 3, 8, 30, 60])))


def written(node):
    if isinstance(node, str):
        return html.escape(node)
    tag, cls, kids = node
    return f"<{tag}{f' class=\"{cls}\"' if cls else ''}>{''.join(map(written, kids))}</{tag}>"


def text_of(node):
    if isinstance(node, str):
        return node
    return "" if node[0] == "script" else "".join(map(text_of, node[2]))


def linked_of(node):
    return 0 if isinstance(node, str) or node[0] == "script" else len(text_of(node)) if node[0] == "a" else sum(map(linked_of, node[2]))


def lines(node):
    if isinstance(node, str):
        return node
    if node[0] == "script":
        return ""
    inside = "".join(map(lines, node[2]))
    return f"\n{inside}\n" if node[0] in BLOCKS or node[0] == "body" else inside


def brute(body):
    """The definition, each quantity from the whole subtree."""
    everything, parent = [], {}

    def walk(node, up, apart):
        apart = apart or node[0] in APART or node[0] != "body" and re.search(r"\b(ad|sidebar)\b", node[1]) is not None
        everything.append((node, apart))
        parent[id(node)] = up
        for k in node[2] if node[0] != "script" else ():
            if not isinstance(k, str):
                walk(k, node, apart)

    root = ("html", "", [body])
    walk(body, root, False)
    parent[id(root)] = None
    points = {}
    for node, apart in everything:
        text = text_of(node)
        own = sum(len(k) for k in node[2] if isinstance(k, str))
        if node[0] in ("p", "blockquote", "div") and not apart and len(text) >= 25 and (node[0] != "div" or own >= 25):
            worth = 1 + text.count(",") + min(len(text) // 100, 3)
            up = parent[id(node)]
            for share in (1, 1 / 2, 1 / 3, 1 / 4):
                if up is None:
                    break
                points[id(up)] = points.get(id(up), 0) + worth * share
                up = parent[id(up)]
    tidy = lambda nodes: "\n".join(x for x in (" ".join(y.split()) for y in "".join(map(lines, nodes)).split("\n")) if x)
    if not points:
        return tidy([body])
    density = lambda n: linked_of(n) / len(text_of(n)) if text_of(n) else 0.0
    order = [root, *(n for n, _ in everything)]
    score = {id(n): points[id(n)] * (1 - density(n)) for n in order if id(n) in points}
    best = max((n for n in order if id(n) in score), key=lambda n: (score[id(n)], -next(k for k, x in enumerate(order) if x is n)))
    apart = {id(n): a for n, a in everything}
    keep = []
    for c in parent[id(best)][2] if parent[id(best)] is not None else [best]:
        if isinstance(c, str):
            continue
        d, n = density(c), len(text_of(c))
        if c is best or not apart[id(c)] and (
            score.get(id(c), 0) >= max(10, score[id(best)] / 5) or c[0] == "p" and (n > 80 and d < 0.25 or 0 < n <= 80 and not d and re.search(r"[.!?](\s|$)", tidy([c])))
        ):
            keep.append(c)
    return tidy(keep)


def test_against_brute_force():
    r = random.Random(12)
    for _ in range(400):
        body = grown(r)
        assert H.extract(f"<html>{written(body)}</html>")[0] == brute(body), written(body)


def test_linear_in_nesting():
    """Eight times the depth takes about eight times as long, not sixty-four."""
    shapes = [
        lambda n: "<div>some text, long enough to count as one paragraph, " * n,
        lambda n: "<span>" * n + "</b>" * n, lambda n: "<ul>" + "<span>" * n + "<li>x</li>" * n, lambda n: "<p><table><td>" + "<span>" * n + "<div>x</div>" * n, lambda n: "<i>" * n + "<td>x" * n,
    ]
    for shape in shapes:
        took = []
        for n in (1000, 8000):
            page = shape(n)
            began = time.process_time()
            H.extract(page)
            took.append(time.process_time() - began)
        assert took[1] < 24 * max(took[0], 0.01), shape(1)


def test_ids_of_any_type(spark):
    got = H.main_text(spark.createDataFrame([("u-1", "<p>x"), (None, None)], "page_id string, html string")).collect()
    assert {x.page_id: x.text for x in got} == {"u-1": "x", None: None}
