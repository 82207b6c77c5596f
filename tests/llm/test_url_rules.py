import re

from arbolita.llm import url_rules as U
from tests.llm.edges import edge, empty

URLS = [
    "http://User:pw@A.B.Example.COM:80/x//y/z.html?q=1#f", "https://example.com", "example.com/x?", "http://localhost/a", "http://10.0.0.1/a/b", "", None, "   ",
    "http://.example.com./", "http://q.c.d.e.f.g.example.com/1/2/3", "http://u.example.com/x?", "http://b.example.com/x/", "ftp://c.d.e.f.g.example.com/1/2/3/4/5/6/7?a=b?c", "http://b.example.com/x/", "http://é.example.com/ü",
]
RULES = [
    (1, "example.com/", "block", 0), (2, "b.example.com/x/", "allow", 0), (3, "a.b.example.com/x/y/z.html?q=1", "block", 0), (4, "localhost/", "block", None), (5, "0.0.1/", "block", 0),
    (6, "10.0.0.1/a/", "block", 0), (7, "10.0.0.1/a/", "allow", 0), (8, "g.example.com/1/2/3/4/", "allow", -1), (9, None, "block", 0), (10, "x/", None, 0), (1, "example.com/", "block", 0),
    (11, "é.example.com/ü", "allow", 0), (12, "HTTP://Me@C.D.e.F.G.Example.COM:8080//1//2/3#x", "block", 0), (13, " f.g.example.com/1/2/3/4/5/6/7?a=b?c ", "allow", 2), (14, "  ", "block", 9), (15, "EXAMPLE.com/x?", "allow", 3),
]


def split(url):
    """Host, path and query in their one form."""
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://", "", url.strip()).split("#")[0]
    m = re.match(r"([^/?]*)([^?]*)(?:\?(.*))?$", rest)
    return re.sub(r":\d*$", "", re.sub(r"^.*@", "", m[1].lower())).strip("."), re.sub("/+", "/", m[2]) or "/", m[3]


def brute(url):
    if not url or not url.strip():
        return None, "pass"
    host, path, query = split(url)
    labels = host.split(".")
    hosts = [host] if len(labels) < 2 or re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", host) else [".".join(labels[i:]) for i in range(len(labels) - 1)]
    parts = path.split("/")
    paths = {"/".join(parts[:i]) + "/" for i in range(1, len(parts))} | {path} | ({f"{path}?{query}"} if query is not None else set())
    rules = [(i, split(e), a, p) for i, e, a, p in RULES if e and e.strip() and a]
    whole = [(i, h + q + ("" if r is None else f"?{r}"), a, p) for i, (h, q, r), a, p in rules]
    found = [(p or 0, len(e.split("/")[0]), len(e), a == "allow", -i, a) for i, e, a, p in whole if any(e == h + q for h in hosts for q in paths)]
    return (-max(found)[4], max(found)[5]) if found else (None, "pass")


def check(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "rule_id long, expression string, action string, priority int")
    got = {x.page_id: (x.rule_id, x.action) for x in U.verdicts(pages, rules).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS)}


def test_against_brute_force(spark):
    check(spark)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(U, "BROADCAST_RULES", 3)
    check(spark)


def test_edges(spark):
    rules = U.default_rules(spark)
    df = edge(spark)
    got = U.verdicts(df, rules, "doc_id", "text").collect()
    assert len(got) == df.distinct().count() and {x.action for x in got} == {"pass"}
    assert U.verdicts(empty(spark), rules, "doc_id", "text").count() == 0
    assert {x.action for x in U.verdicts(df, rules.limit(0), "doc_id", "text").collect()} == {"pass"}


def test_equal_prefixes_are_told_apart_by_their_digests(spark, monkeypatch):
    """With every expression under one short prefix, full digests decide alone."""
    real = U.F.substring
    monkeypatch.setattr(U.F, "substring", lambda c, lo, n: real(c, lo, 0))
    check(spark)


def test_join_is_on_the_prefix_alone(spark):
    pages = spark.createDataFrame([(1, "http://example.com/")], "page_id long, url string")
    plan = U.verdicts(pages, U.default_rules(spark))._jdf.queryExecution().optimizedPlan().toString()
    join = next(x for x in plan.splitlines() if "Join " in x)
    assert "e_short" in join and "digest" not in join


def test_a_url_of_many_steps(spark):
    """The steps that no rule is deep enough for cost nothing."""
    url = "http://a.b.c.d.e.example.com/" + "/".join(["step"] * 20000)
    rules = spark.createDataFrame([(1, "example.com/step/step/", "block", 0)], "rule_id long, expression string, action string, priority int")
    got = U.verdicts(spark.createDataFrame([("p", url)], "page_id string, url string"), rules).first()
    assert (got.page_id, got.rule_id, got.action) == ("p", 1, "block")
