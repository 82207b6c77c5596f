"""Structural metrics, rules and catalog joins over the derived trees."""

from arbolita.plans.derived_trees import LEAVES, NODES
from arbolita.plans.shared_sql import shared
from arbolita.registry import query
from arbolita.sources.tables import table

CATALOG = "catalog AS (SELECT concat('S', CAST(n AS VARCHAR(10))) AS skill_id, n FROM (SELECT DISTINCT CAST(p_partkey % 25 AS BIGINT) AS n FROM {part}) c)"

shared("tree_nodes", f"WITH {NODES} SELECT * FROM nodes")
shared(
    "tree_shape_metrics",
    f"""WITH {NODES} SELECT tree_id, max(depth) AS depth, count(*) AS total_nodes,
        count(CASE WHEN tag = 'Action' THEN 1 END) AS n_actions, count(CASE WHEN tag = 'Condition' THEN 1 END) AS n_conditions,
        count(CASE WHEN tag IN ('Sequence', 'Fallback') THEN 1 END) AS n_controls,
        round(CAST(sum(CASE WHEN tag IN ('Sequence', 'Fallback') THEN n_children END) AS DOUBLE) / count(CASE WHEN tag IN ('Sequence', 'Fallback') THEN 1 END), 2) AS branching
        FROM nodes GROUP BY tree_id""",
)
shared(
    "tree_structure_by_class",
    f"""WITH {NODES} SELECT tag, CASE WHEN tag IN ('Sequence', 'Fallback') THEN 'control' WHEN tag IN ('Action', 'Condition') THEN 'leaf'
        WHEN tag IN ('root', 'BehaviorTree') THEN 'structural' ELSE 'other' END AS class, count(*) AS n, count(DISTINCT tree_id) AS n_trees
        FROM nodes GROUP BY tag""",
)
shared(
    "skill_sequence",
    f"WITH {LEAVES} SELECT tree_id, listagg(skill_id, ',') WITHIN GROUP (ORDER BY pre) AS skills, count(*) AS n_skills FROM leaves GROUP BY tree_id",
    {"listagg(skill_id, ',') WITHIN GROUP (ORDER BY pre)": "string_agg(skill_id, ',' ORDER BY pre)"},
)
shared(
    "sibling_index_paths",
    f"""WITH {LEAVES} SELECT tree_id, pre, concat('/root/BehaviorTree/', parent_tag, '/', tag, '[', CAST(row_number() OVER (PARTITION BY tree_id, parent, tag ORDER BY ord) AS VARCHAR(10)), ']') AS xpath
        FROM leaves""",
)
shared(
    "hallucination_antijoin",
    f"""WITH {LEAVES}, {CATALOG} SELECT tree_id, count(*) AS n_hallucinated, count(DISTINCT l.skill_id) AS n_distinct, min(l.skill_id) AS first_id
        FROM leaves l LEFT ANTI JOIN catalog c ON l.skill_id = c.skill_id GROUP BY tree_id""",
    {"LEFT ANTI JOIN": "ANTI JOIN"},
)
shared(
    "valid_skill_semijoin",
    f"WITH {LEAVES}, {CATALOG} SELECT tag, count(*) AS n_valid FROM leaves l LEFT SEMI JOIN catalog c ON l.skill_id = c.skill_id GROUP BY tag",
    {"LEFT SEMI JOIN": "SEMI JOIN"},
)
shared(
    "hallucination_rate",
    f"""WITH {LEAVES}, {CATALOG} SELECT l.tree_id, count(*) AS total, count(CASE WHEN c.skill_id IS NULL THEN 1 END) AS hallucinated,
        CAST(count(CASE WHEN c.skill_id IS NULL THEN 1 END) AS DOUBLE) / count(*) AS rate
        FROM leaves l LEFT JOIN catalog c ON l.skill_id = c.skill_id GROUP BY l.tree_id""",
)
shared(
    "port_completeness",
    f"""WITH {LEAVES}, {CATALOG} SELECT l.tree_id, coalesce(CAST(sum(1 + CASE WHEN has_qty THEN 1 ELSE 0 END) AS DOUBLE) / nullif(2 * count(*), 0), 1.0) AS completeness
        FROM leaves l JOIN catalog c ON l.skill_id = c.skill_id GROUP BY l.tree_id""",
)
shared("missing_required", f"WITH {LEAVES}, {CATALOG} SELECT l.tree_id, l.pre, l.skill_id, 'qty' AS port FROM leaves l JOIN catalog c ON l.skill_id = c.skill_id WHERE NOT has_qty")
shared("unknown_attr", f"WITH {LEAVES}, {CATALOG} SELECT l.tree_id, l.pre, l.skill_id, 'disc' AS port FROM leaves l JOIN catalog c ON l.skill_id = c.skill_id WHERE has_disc")
shared(
    "port_type_and_domain",
    f"""WITH {LEAVES}, {CATALOG}, v AS (SELECT l.tree_id, l.pre, CAST(CAST(qty AS INT) AS VARCHAR(10)) AS value FROM leaves l JOIN catalog c ON l.skill_id = c.skill_id WHERE has_qty)
        SELECT tree_id, pre, value, CAST(value AS INT) % 2 = 1 AS outside_domain FROM v WHERE CAST(value AS INT) NOT IN (2, 4, 8, 16, 32)""",
)
shared(
    "prereq_order_violations",
    f"""WITH {LEAVES}, firsts AS (SELECT tree_id, skill_no, min(pre) AS pos FROM leaves GROUP BY tree_id, skill_no)
        SELECT s.tree_id, s.skill_no AS skill, s.skill_no - 1 AS prerequisite, s.pos, p.pos AS prerequisite_pos
        FROM firsts s LEFT JOIN firsts p ON p.tree_id = s.tree_id AND p.skill_no = s.skill_no - 1
        WHERE s.skill_no BETWEEN 1 AND 24 AND s.skill_no % 4 = 1 AND (p.pos IS NULL OR p.pos > s.pos)""",
)
shared(
    "producer_before_consumer",
    f"""WITH {LEAVES}, seen AS (SELECT tree_id, parent, pre, skill_no, coalesce(max(CASE WHEN skill_no % 7 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY tree_id, parent ORDER BY ord
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS produced FROM leaves WHERE parent_tag = 'Sequence')
        SELECT tree_id, parent, pre FROM seen WHERE skill_no % 7 IN (1, 2) AND produced = 0""",
)
_OWN = NODES.replace("{lineitem}", "lineitem")


def _sql(name: str, text: str, oracle: str) -> None:
    """Register ``text`` for Spark with an oracle that takes another way."""

    @query(name, oracle)
    def run(spark, sf_dir):
        return spark.sql(text, lineitem=table(spark, sf_dir, "lineitem"))


# by intervals here, by the parent there: in these trees a leaf's only control ancestor is its parent
_sql(
    "ancestor_containment",
    f"""WITH {NODES} SELECT d.tree_id, d.pre, d.skill_id, a.pre AS fallback_pre FROM nodes d JOIN nodes a
        ON d.tree_id = a.tree_id AND d.pre BETWEEN a.pre AND a.post WHERE d.tag = 'Condition' AND a.tag = 'Fallback'""",
    f"WITH {_OWN} SELECT tree_id, pre, skill_id, parent AS fallback_pre FROM leaves WHERE tag = 'Condition' AND parent_tag = 'Fallback'",
)
_sql(
    "condition_outside_fallback",
    f"""WITH {NODES}, f AS (SELECT * FROM nodes WHERE tag = 'Fallback') SELECT c.tree_id, c.pre, c.skill_id FROM nodes c LEFT ANTI JOIN f
        ON c.tree_id = f.tree_id AND c.pre BETWEEN f.pre AND f.post WHERE c.tag = 'Condition'""",
    f"WITH {_OWN} SELECT tree_id, pre, skill_id FROM leaves WHERE tag = 'Condition' AND parent_tag <> 'Fallback'",
)
shared(
    "first_failing_check",
    f"""WITH {LEAVES}, {CATALOG}, facts AS (SELECT l.tree_id, count(CASE WHEN c.skill_id IS NULL THEN 1 END) AS unknown, count(CASE WHEN skill_no = 18 THEN 1 END) AS stops
        FROM leaves l LEFT JOIN catalog c ON l.skill_id = c.skill_id GROUP BY l.tree_id)
        SELECT tree_id, CASE WHEN unknown > 0 THEN 'unknown_skill' WHEN stops = 0 THEN 'missing_stop' END AS failed FROM facts""",
)
shared(
    "structure_limits",
    f"""WITH {NODES} SELECT tree_id, max(CASE WHEN tag = 'Fallback' AND n_children < 2 THEN 1 ELSE 0 END) = 1 AS thin_fallback,
        count(CASE WHEN tag IN ('Action', 'Condition') THEN 1 END) > 10 AS many_skills, max(depth) > 12 AS too_deep FROM nodes GROUP BY tree_id""",
)
_ISSUES = f"""{LEAVES}, {CATALOG},
    issues AS (
        SELECT l.tree_id, l.pre, 4 AS level, 'missing_port' AS code FROM leaves l JOIN catalog c ON l.skill_id = c.skill_id WHERE NOT has_qty
        UNION ALL SELECT l.tree_id, l.pre, 4, 'unknown_port' FROM leaves l JOIN catalog c ON l.skill_id = c.skill_id WHERE has_disc
        UNION ALL SELECT tree_id, parent, 2, 'thin_fallback' FROM leaves WHERE parent_tag = 'Fallback' GROUP BY tree_id, parent HAVING count(*) < 2)"""
shared("issue_rows", f"WITH {_ISSUES} SELECT * FROM issues")
shared("issue_histogram", f"WITH {_ISSUES} SELECT level, code, count(*) AS n, count(DISTINCT tree_id) AS n_trees FROM issues GROUP BY level, code")
shared(
    "checklist_pivot",
    f"""WITH {_ISSUES} SELECT t.tree_id, count(CASE WHEN code = 'missing_port' THEN 1 END) = 0 AS ports_present, count(CASE WHEN code = 'unknown_port' THEN 1 END) = 0 AS ports_known,
        count(CASE WHEN code = 'thin_fallback' THEN 1 END) = 0 AS fallbacks_wide, count(code) = 0 AS ok
        FROM (SELECT DISTINCT tree_id FROM leaves) t LEFT JOIN issues i ON i.tree_id = t.tree_id GROUP BY t.tree_id""",
)
shared(
    "warn_score_fold",
    f"""WITH {_ISSUES}, w AS (SELECT t.tree_id, count(code) AS n FROM (SELECT DISTINCT tree_id FROM leaves) t LEFT JOIN issues i ON i.tree_id = t.tree_id GROUP BY t.tree_id)
        SELECT tree_id, n AS n_warnings, aggregate(CASE WHEN n > 0 THEN sequence(CAST(1 AS BIGINT), n) ELSE array() END, CAST(1.0 AS DOUBLE), (a, x) -> greatest(CAST(0.5 AS DOUBLE), a - CAST(0.1 AS DOUBLE))) AS score FROM w""",
    {
        "aggregate(CASE WHEN n > 0 THEN sequence(CAST(1 AS BIGINT), n) ELSE array() END, CAST(1.0 AS DOUBLE), (a, x) -> greatest(CAST(0.5 AS DOUBLE), a - CAST(0.1 AS DOUBLE)))":
        "list_reduce(list_transform(range(0, n + 1), lambda x: CAST(1.0 AS DOUBLE)), lambda a, x: greatest(CAST(0.5 AS DOUBLE), a - CAST(0.1 AS DOUBLE)))"
    },
)
_METRICS = f"""{_ISSUES},
    m AS (SELECT l.tree_id, count(*) AS n_skills, count(CASE WHEN c.skill_id IS NULL THEN 1 END) AS n_bad,
                 count(DISTINCT CASE WHEN c.skill_id IS NULL THEN l.skill_id END) AS n_bad_distinct, count(CASE WHEN l.tag = 'Condition' THEN 1 END) AS n_conditions
          FROM leaves l LEFT JOIN catalog c ON l.skill_id = c.skill_id GROUP BY l.tree_id),
    w AS (SELECT tree_id, count(*) AS n_warn FROM issues GROUP BY tree_id),
    t AS (SELECT m.*, coalesce(n_warn, 0) AS n_warn FROM m LEFT JOIN w ON m.tree_id = w.tree_id)"""
shared("all_metrics_row", f"WITH {_METRICS} SELECT tree_id, n_skills, n_bad, n_bad_distinct, n_conditions, n_warn, n_bad = 0 AS valid FROM t")
shared(
    "reward_weighted_clamped",
    f"""WITH {_METRICS} SELECT tree_id, greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST(0.3 AS DOUBLE) * (CASE WHEN n_bad = 0 THEN 1 ELSE -1 END)
        + CAST(0.2 AS DOUBLE) * (CASE WHEN n_bad = 0 THEN 1 ELSE 0 END) + CAST(0.2 AS DOUBLE) * greatest(CAST(0 AS DOUBLE), 1 - CAST(0.1 AS DOUBLE) * n_warn)
        + CAST(0.2 AS DOUBLE) * (CASE WHEN n_conditions > 0 THEN 1 ELSE CAST(0.5 AS DOUBLE) END) + CAST(0.1 AS DOUBLE) * greatest(CAST(0 AS DOUBLE), 1 - CAST(0.5 AS DOUBLE) * n_bad))) AS reward FROM t""",
)
shared(
    "rich_feedback",
    f"""WITH {_METRICS} SELECT tree_id, CAST(0.3 AS DOUBLE) + CAST(0.2 AS DOUBLE) * (CASE WHEN n_bad = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(-0.5 AS DOUBLE) END)
        + CAST(0.2 AS DOUBLE) * greatest(CAST(-1 AS DOUBLE), 1 - CAST(0.2 AS DOUBLE) * n_warn) + CAST(0.1 AS DOUBLE) * greatest(CAST(-1 AS DOUBLE), 1 - CAST(0.5 AS DOUBLE) * n_bad_distinct) AS dense_score,
        concat(CAST(n_bad_distinct AS VARCHAR(10)), ' unknown; ', CAST(n_warn AS VARCHAR(10)), ' warnings') AS feedback FROM t""",
)
shared(
    "global_summary",
    f"""WITH {_METRICS} SELECT count(*) AS n, avg(CASE WHEN n_bad = 0 THEN 1.0E0 ELSE 0.0E0 END) AS validity_rate, avg(CASE WHEN n_bad > 0 THEN 1.0E0 ELSE 0.0E0 END) AS hallucination_rate,
        avg(CAST(n_bad AS DOUBLE)) AS mean_hallucinated, avg(CAST(n_skills AS DOUBLE)) AS mean_skills, avg(CASE WHEN n_bad = 0 THEN CAST(n_skills AS DOUBLE) END) AS mean_skills_valid FROM t""",
)
SCORES = f"""{_METRICS}, scored AS (SELECT t.tree_id, n_skills, n_conditions, n_warn, o_orderpriority AS category, round(greatest(CAST(0.5 AS DOUBLE), 1 - CAST(0.1 AS DOUBLE) * n_warn), 1) AS score
    FROM t JOIN {{orders}} ON o_orderkey = t.tree_id)"""
shared("score_histogram", f"WITH {SCORES} SELECT score, count(*) AS n FROM scored GROUP BY score")
shared(
    "distribution_stats",
    f"""WITH {SCORES}, long AS (SELECT 'skills' AS metric, CAST(n_skills AS DOUBLE) AS v FROM scored UNION ALL SELECT 'conditions', CAST(n_conditions AS DOUBLE) FROM scored UNION ALL SELECT 'warnings', CAST(n_warn AS DOUBLE) FROM scored)
        SELECT metric, min(v) AS lowest, avg(v) AS mean, percentile(v, 0.5) AS middle, max(v) AS highest FROM long GROUP BY metric""",
    {"percentile(v, 0.5)": "quantile_cont(v, 0.5)"},
)
shared(
    "score_histogram_zero_fill",
    f"""WITH {SCORES}, dim AS (SELECT DISTINCT CAST(l_linenumber AS BIGINT) + 4 AS tenth FROM {{lineitem}}), h AS (SELECT CAST(round(score * 10) AS BIGINT) AS tenth, count(*) AS n FROM scored GROUP BY 1)
        SELECT d.tenth, coalesce(h.n, 0) AS n FROM dim d LEFT JOIN h ON h.tenth = d.tenth""",
)
shared("category_scores", f"WITH {SCORES} SELECT category, count(*) AS n, round(avg(score), 6) AS mean_score, min(score) AS worst, count(CASE WHEN score = 1 THEN 1 END) AS perfect FROM scored GROUP BY category")
shared(
    "catalog_coverage",
    f"""WITH {LEAVES}, {CATALOG}, used AS (SELECT DISTINCT skill_id FROM leaves), b AS (SELECT c.skill_id AS c, u.skill_id AS u FROM catalog c FULL JOIN used u ON c.skill_id = u.skill_id)
        SELECT count(CASE WHEN c IS NOT NULL AND u IS NOT NULL THEN 1 END) AS covered, count(CASE WHEN u IS NULL THEN 1 END) AS unused, count(CASE WHEN c IS NULL THEN 1 END) AS foreign_ids,
        round(100.0E0 * count(CASE WHEN c IS NOT NULL AND u IS NOT NULL THEN 1 END) / greatest(1, count(c)), 1) AS coverage FROM b""",
)
shared("coverage_missing", f"WITH {LEAVES}, {CATALOG} SELECT skill_id FROM leaves EXCEPT SELECT skill_id FROM catalog")
shared("coverage_intersect", f"WITH {LEAVES}, {CATALOG} SELECT skill_id FROM leaves INTERSECT SELECT skill_id FROM catalog")
shared(
    "placeholder_mask",
    f"""WITH {LEAVES}, k AS (SELECT tree_id, tag, skill_id, min(pre) AS first_pre FROM leaves GROUP BY tree_id, tag, skill_id)
        SELECT tree_id, tag, skill_id, concat(CASE WHEN tag = 'Action' THEN 'ACTION_' ELSE 'COND_' END, CAST(row_number() OVER (PARTITION BY tree_id, tag ORDER BY first_pre) AS VARCHAR(10))) AS placeholder FROM k""",
)
shared(
    "blackboard_unproduced",
    f"""WITH {LEAVES}, p AS (SELECT DISTINCT tree_id, skill_no % 7 AS var FROM leaves WHERE tag = 'Action'), c AS (SELECT DISTINCT tree_id, skill_no % 5 AS var FROM leaves WHERE tag = 'Condition')
        SELECT c.tree_id, c.var FROM c LEFT ANTI JOIN p ON c.tree_id = p.tree_id AND c.var = p.var""",
    {"LEFT ANTI JOIN": "ANTI JOIN"},
)
shared(
    "corpus_rollup",
    f"""WITH {NODES}, per AS (SELECT tree_id, max(depth) AS depth, CAST(sum(CASE WHEN tag IN ('Sequence', 'Fallback') THEN n_children END) AS DOUBLE) / count(CASE WHEN tag IN ('Sequence', 'Fallback') THEN 1 END) AS branching FROM nodes GROUP BY tree_id)
        SELECT count(*) AS parsed, min(depth) AS depth_min, max(depth) AS depth_max, round(avg(CAST(depth AS DOUBLE)), 2) AS depth_mean, round(avg(branching), 2) AS branching_mean FROM per""",
)
_CANDS = """cands AS (SELECT l_orderkey AS mission, l_extendedprice AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS idx FROM {lineitem}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY mission ORDER BY score DESC, idx) AS rn, count(*) OVER (PARTITION BY mission) AS n FROM cands)"""
shared("rank_candidates", f"WITH {_CANDS} SELECT mission, idx, score, rn, CASE WHEN rn <= greatest(1, floor(n / 2)) THEN 'top' ELSE 'bottom' END AS half FROM ranked", {"floor(n / 2)": "n // 2"})
shared(
    "pref_pairs_single",
    f"WITH {_CANDS} SELECT a.mission, a.idx AS chosen, b.idx AS rejected, a.score AS chosen_score, b.score AS rejected_score FROM ranked a JOIN ranked b ON a.mission = b.mission AND a.rn = 1 AND b.rn = b.n WHERE a.score > b.score",
)
shared(
    "pref_pairs_multi",
    f"""WITH {_CANDS}, p AS (SELECT a.mission, a.idx AS chosen, b.idx AS rejected, row_number() OVER (PARTITION BY a.mission ORDER BY a.rn, b.rn) AS k FROM ranked a JOIN ranked b
        ON a.mission = b.mission AND a.rn <= greatest(1, floor(a.n / 2)) AND b.rn > greatest(1, floor(b.n / 2)) WHERE a.score > b.score) SELECT mission, chosen, rejected, k FROM p WHERE k <= 4""",
    {"floor(a.n / 2)": "a.n // 2", "floor(b.n / 2)": "b.n // 2"},
)
shared(
    "kto_explode",
    f"""WITH {_CANDS}, p AS (SELECT a.mission, a.idx AS good, b.idx AS bad FROM ranked a JOIN ranked b ON a.mission = b.mission AND a.rn = 1 AND b.rn = b.n WHERE a.score > b.score)
        SELECT concat(CAST(mission AS VARCHAR(20)), '_pos') AS id, good AS completion, true AS label FROM p UNION ALL SELECT concat(CAST(mission AS VARCHAR(20)), '_neg'), bad, false FROM p""",
)
