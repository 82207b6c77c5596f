"""The XML operators over documents that are built from the derived trees."""

from pyspark.sql import functions as F

from arbolita.functions import trees
from arbolita.operators import nodes, validate
from arbolita.operators.catalog import SKILLS
from arbolita.plans.assemble import joined, numbered, texts
from arbolita.plans.derived_trees import NODES
from arbolita.registry import query
from arbolita.sources.tables import table


def documents(spark, sf_dir, real: bool = False):
    """``tree_id, xml``; with ``real`` the skills of the catalog stand for the numbered ones."""
    lines = numbered(table(spark, sf_dir, "lineitem"), *map(F.col, ("l_linestatus", "l_partkey", "l_extendedprice", "l_tax")))
    number = F.col("l_partkey") % 31
    name = F.get(texts([s for _, s, _, _ in SKILLS]), number.cast("int")) if real else F.concat(F.lit("S"), number.cast("string"))
    tag = F.when(F.col("l_linestatus") == "O", "<Action").otherwise("<Condition")
    leaf = F.concat(tag, F.lit(' ID="'), name, F.lit('" price="'), F.col("l_extendedprice").cast("int").cast("string"), F.when(F.col("l_tax") > 0, '" qty="1"/>').otherwise('"/>'))
    return joined(lines.select("tree_id", "flag", "seq", leaf.alias("leaf")), F.lit('<root BTCPP_format="4"><BehaviorTree ID="main">'), "</BehaviorTree></root>")


_DUCK = NODES.replace("{lineitem}", "lineitem")


@query("xml_nodes", f"WITH {_DUCK} SELECT CAST(tree_id AS VARCHAR) AS tree_id, pre::INT AS pre, post::INT AS post, parent::INT AS parent, ord::INT AS ord, depth::INT AS depth, tag, skill_id, n_children::INT AS n_children FROM nodes")
def xml_nodes(spark, sf_dir):
    return nodes.bt_nodes(documents(spark, sf_dir)).select("tree_id", "pre", "post", "parent", "ord", "depth", "tag", "skill_id", "n_children")


@query(
    "xml_structure_metrics",
    f"""WITH {_DUCK} SELECT CAST(tree_id AS VARCHAR) AS tree_id, max(depth) AS depth, count(*) AS total_nodes, count(*) FILTER (tag = 'Action') AS n_actions,
        round(sum(n_children) FILTER (tag IN ('Sequence', 'Fallback')) / count(*) FILTER (tag IN ('Sequence', 'Fallback')), 2) AS branching FROM nodes GROUP BY tree_id""",
)
def xml_structure_metrics(spark, sf_dir):
    """From the parsed documents alone: expressions over a tree's elements, nothing is shuffled again."""
    control = lambda n: n["tag"].isin(*nodes.CONTROL)
    children = F.transform(F.filter("nodes", control), lambda n: n["n_children"].cast("double"))
    branching = F.round(F.aggregate(children, F.lit(0.0), lambda a, x: a + x) / F.size(children), 2)
    return nodes.bt_trees(documents(spark, sf_dir)).select(
        "tree_id", F.array_max(F.transform("nodes", lambda n: n["depth"])).alias("depth"), F.size("nodes").cast("long").alias("total_nodes"),
        F.size(F.filter("nodes", lambda n: n["tag"] == "Action")).cast("long").alias("n_actions"), branching.alias("branching"),
    )


@query("xml_roundtrip")
def xml_roundtrip(spark, sf_dir):
    """Every document with its default ports put in, written as XML again."""
    return nodes.to_xml(validate.enrich(nodes.bt_trees(documents(spark, sf_dir, real=True))))


@query("tree_edit_distance")
def tree_edit_distance(spark, sf_dir):
    """Distance of every tree to the tree of the same customer that comes next."""
    docs = documents(spark, sf_dir)
    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    d = docs.join(own, F.col("tree_id") == F.col("o_orderkey"))
    from pyspark.sql import Window

    pairs = d.withColumn("other", F.lead("xml").over(Window.partitionBy("o_custkey").orderBy("tree_id"))).where("other is not null")
    return trees.tree_distance(pairs, "tree_id", "xml", "other")


@query("unified_diff")
def unified_diff(spark, sf_dir):
    """Line diff of every turn of a conversation to the one before."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    c = c.withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    return trees.unified_diff(c.select(F.concat_ws(":", "conv_id", "turn").alias("id"), "before", "text"), "id", "before", "text")


_NAVIGATION = f"""WITH {_DUCK} SELECT CAST(tree_id AS VARCHAR) AS tree_id, 'error' AS level, 'tag_not_allowed' AS code, tag AS detail, pre::INT AS pre FROM nodes WHERE tag IN ('Action', 'Condition')
    UNION ALL SELECT CAST(tree_id AS VARCHAR), 'error', 'root_main_tree', NULL, NULL FROM totals UNION ALL SELECT CAST(tree_id AS VARCHAR), 'warning', 'bt_unused_definition', 'main', NULL FROM totals"""


@query("navigation_issues", _NAVIGATION)
def navigation_issues(spark, sf_dir):
    """Findings of the second dialect's rules in every document."""
    from arbolita.operators import navigation

    return navigation.issues(nodes.bt_trees(documents(spark, sf_dir)))
