"""Trees derived from orders and their lines, as a node relation.

Every order with lines is a tree: root, BehaviorTree, a control node per return flag (N a Sequence, R a Fallback), and its lines as
leaves in order. ``NODES`` is the relation (tree_id, pre, post, parent, ord, depth, tag, skill_id, is_leaf and the leaf's ports) as a CTE
list that other queries are put behind.
"""

LEAVES = """
    lines AS (
        SELECT l_orderkey AS tree_id, l_returnflag AS flag, l_linestatus AS status, l_partkey, l_tax, l_discount, l_extendedprice, l_quantity,
               row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord
        FROM {lineitem}),
    controls AS (
        SELECT tree_id, flag, n_leaves, CAST(2 + coalesce(sum(n_leaves + 1) OVER (PARTITION BY tree_id ORDER BY flag
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pre,
               row_number() OVER (PARTITION BY tree_id ORDER BY flag) AS ord
        FROM (SELECT tree_id, flag, count(*) AS n_leaves FROM lines GROUP BY tree_id, flag) g),
    leaves AS (
        SELECT l.tree_id, c.pre + l.ord AS pre, c.pre AS parent, l.ord, CASE WHEN status = 'O' THEN 'Action' ELSE 'Condition' END AS tag,
               concat('S', CAST(l_partkey % 31 AS VARCHAR(10))) AS skill_id, l_partkey % 31 AS skill_no, l_tax > 0 AS has_qty, l_discount > 0.08 AS has_disc,
               l_quantity AS qty, l_extendedprice AS price, CASE WHEN l.flag = 'N' THEN 'Sequence' ELSE 'Fallback' END AS parent_tag
        FROM lines l JOIN controls c ON l.tree_id = c.tree_id AND l.flag = c.flag)"""

NODES = (
    LEAVES
    + """,
    totals AS (SELECT tree_id, count(*) AS n_controls, CAST(sum(n_leaves) AS BIGINT) AS n_leaves FROM controls GROUP BY tree_id),
    nodes AS (
        SELECT tree_id, CAST(0 AS BIGINT) AS pre, 1 + n_controls + n_leaves AS post, CAST(NULL AS BIGINT) AS parent, CAST(1 AS BIGINT) AS ord, 0 AS depth, 'root' AS tag,
               CAST(NULL AS VARCHAR(10)) AS skill_id, CAST(1 AS BIGINT) AS n_children FROM totals
        UNION ALL
        SELECT tree_id, CAST(1 AS BIGINT), 1 + n_controls + n_leaves, CAST(0 AS BIGINT), CAST(1 AS BIGINT), 1, 'BehaviorTree', NULL, n_controls FROM totals
        UNION ALL
        SELECT tree_id, pre, pre + n_leaves, CAST(1 AS BIGINT), ord, 2, CASE WHEN flag = 'N' THEN 'Sequence' ELSE 'Fallback' END, NULL, n_leaves FROM controls
        UNION ALL
        SELECT tree_id, pre, pre, parent, ord, 3, tag, skill_id, CAST(0 AS BIGINT) FROM leaves)"""
)
