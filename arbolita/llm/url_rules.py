"""URL filters: host-suffix and path-prefix expressions, hash-prefix join, full digests, rule precedence.

A URL becomes expressions "suffix of the host" + "prefix of the path": host suffixes of two labels or more (the whole host
where it has one label or is an IPv4 address); the path with its query, the path, and every directory prefix from "/" on.
Suffixes of as many labels as no rule's host has, and prefixes of a depth that no rule has, could meet no rule and are not
written out, so a URL of thousands of steps costs what the rules' depths cost. Rules are such expressions with an action. Both
sides carry the first four bytes of the SHA-256 of their expression; the join is on those alone, and after it the full digests
are compared. Of a URL's rules that with the highest priority decides, then the longer host, the longer path, ``allow``
before ``block``, the smaller rule id.

URLs and the rules' expressions are brought to one form first: scheme, user, port, fragment and dots around the host go, the
host is lower case, runs of slashes become one, a missing path is "/".

Defined results: a null or blank URL has no expressions and passes; a URL that no rule matches passes with null rule; rules
with a null or blank expression or a null action are ignored; repeated rules change nothing; a row that repeats (id and URL) is one
result; empty tables give no rows, an empty rule table lets all pass; only the named columns are read; ids of pages keep their type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules up to so many are sent to every executor (some 100 bytes each); more are joined by shuffling on the hash prefix.
BROADCAST_RULES = 500_000

DEFAULT_RULES = [
    (1, "spam-farm.example.org/", "block", 0),
    (2, "cheap-pills.example.com/", "block", 0),
    (8, "casino-win.example.org/", "block", 0),
    (3, "www.cheap-pills.example.com/fr/", "allow", 0),
    (4, "example.net/en/", "block", -1),
    (5, "tionsh.example.net/en/", "allow", -1),
    (6, "blog.thertion.example.org/es/978?page=2&ref=x", "block", 5),
    (7, "example.org/de/", "allow", -2),
]


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_RULES, "rule_id long, expression string, action string, priority int")


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query (null where there is none) of the URL in its one form."""
    rest = F.regexp_replace(F.trim(url), "^[a-zA-Z][a-zA-Z0-9+.\\-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), "^[.]+|[.]+$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), "/+", "/")
    path = F.when(path == "", "/").otherwise(path)
    query = F.when(F.regexp_extract(rest, "^[^?#]*([?])", 1) == "?", F.regexp_extract(rest, "^[^?#]*[?]([^#]*)", 1))
    return host, path, query


def expressions(host: Column, path: Column, query: Column, labels_of: list[int], depths: list[int]) -> Column:
    """The expressions with a host of ``labels_of`` labels and, for directories, of ``depths``; an array without repeats."""
    labels, steps = F.split(host, "[.]"), F.split(path, "/")  # "/a/b" has steps "", "a", "b": the prefixes of 1 .. 2 steps end in "/"
    n = F.size(labels)
    whole = (n < 2) | host.rlike("^[0-9]{1,3}([.][0-9]{1,3}){3}$")
    some = lambda numbers: F.array(*map(F.lit, numbers)).cast("array<int>")
    suffixes = F.transform(F.filter(some([k for k in labels_of if k > 1]), lambda k: k <= n), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    hosts = F.when(whole, F.array(host)).otherwise(suffixes)
    prefixes = F.transform(F.filter(some(depths), lambda k: k < F.size(steps)), lambda k: F.concat(F.array_join(F.slice(steps, F.lit(1), k), "/"), F.lit("/")))
    paths = F.concat(prefixes, F.array(path), F.when(query.isNotNull(), F.array(F.concat(path, F.lit("?"), query))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p)))))


def normal_rules(rules: DataFrame) -> DataFrame:
    """``rule_id, rule, rule_action, priority`` with the expressions in the form of URLs, their labels and (for directories) depth."""
    host, path, query = parts(F.col("expression"))
    r = rules.where("expression is not null and action is not null").select(
        F.col("rule_id").cast("long").alias("rule_id"), F.col("action").alias("rule_action"), F.coalesce(F.col("priority").cast("int"), F.lit(0)).alias("priority"),
        host.alias("host"), path.alias("path"), query.alias("query"),
    ).where("host <> ''")
    depth = F.when(F.col("query").isNull() & F.col("path").endswith("/"), F.size(F.split("path", "/")) - 1)
    rule = F.concat("host", "path", F.coalesce(F.concat(F.lit("?"), "query"), F.lit("")))
    return r.select("rule_id", rule.alias("rule"), "rule_action", "priority", F.size(F.split("host", "[.]")).alias("labels"), depth.alias("depth"))


def verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, url, rule_id, action, expression`` of each page: the deciding rule (its expression in the form of URLs), or ``pass``."""
    r = normal_rules(rules)
    shapes = r.agg(F.collect_set("labels").alias("labels"), F.collect_set("depth").alias("depths"), F.count("*").alias("n")).first()
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path, query = parts(F.col("url"))
    p = p.withColumns({"host": host, "path": path, "query": query})
    found = F.when(F.col("host") != "", expressions(F.col("host"), F.col("path"), F.col("query"), sorted(shapes.labels), sorted(shapes.depths)))
    short = lambda c: F.substring(c, 1, 8)  # noqa: E731  four bytes in hex
    e = p.select("page_id", "url", F.explode_outer(found).alias("e")).withColumn("digest", F.sha2("e", 256)).withColumn("e_short", short("digest"))
    r = r.select("rule_id", "rule", "rule_action", "priority", F.sha2("rule", 256).alias("rule_digest")).withColumn("short", short("rule_digest"))
    if shapes.n <= BROADCAST_RULES:
        r = F.broadcast(r)
    met = e.join(r, F.col("e_short") == F.col("short"), "left")
    rank = F.when(F.col("digest") == F.col("rule_digest"), F.struct(
        F.col("priority"), F.length(F.substring_index("rule", "/", 1)).alias("h"), F.length("rule").alias("l"), (F.col("rule_action") == "allow").alias("allow"),
        (-F.col("rule_id")).alias("id"), F.col("rule_action").alias("action"), F.col("rule").alias("expression"),
    ))
    best = met.groupBy("page_id", "url").agg(F.max(rank).alias("best"))
    return best.select("page_id", "url", (-F.col("best.id")).alias("rule_id"), F.coalesce("best.action", F.lit("pass")).alias("action"), F.col("best.expression").alias("expression"))
