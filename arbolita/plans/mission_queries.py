"""Rules, metrics, rewards and reports over the mission corpus; the SQL derives the same facts from relations, without XML."""

from pyspark.sql import functions as F

from arbolita.operators import catalog as C
from arbolita.operators import facts, metrics, navigation, reports, reward, validate
from arbolita.operators.nodes import bt_trees
from arbolita.plans.mission_corpus import BASE, documents
from arbolita.registry import query


def trees(spark, sf_dir):
    return bt_trees(documents(spark, sf_dir))


@query("mission_issues", BASE + "SELECT tree_id::VARCHAR AS tree_id, level::INT AS level, severity, code, detail, pre::INT AS pre FROM found")
def mission_issues(spark, sf_dir):
    """Every finding of the five levels."""
    return validate.issues(trees(spark, sf_dir)).drop("step", "sub")


@query("mission_verdicts", BASE + "SELECT tree_id::VARCHAR AS tree_id, valid, score, n_errors::INT AS n_errors, n_warnings::INT AS n_warnings FROM verdicts")
def mission_verdicts(spark, sf_dir):
    """Validity and score of every document."""
    return validate.verdicts(trees(spark, sf_dir))


@query("mission_port_issues", BASE + "SELECT tree_id::VARCHAR AS tree_id, code, detail, pre::INT AS pre FROM l4")
def mission_port_issues(spark, sf_dir):
    """Level 4 alone, of every document."""
    return validate.port_issues(trees(spark, sf_dir))


@query(
    "mission_structure",
    BASE + """SELECT tree_id::VARCHAR AS tree_id, max(depth)::INT AS max_depth, count(*)::INT AS total_nodes, 1 AS n_behavior_trees, 0 AS n_subtreeplus, count(*) FILTER (tag = 'Sequence')::INT AS n_sequence,
        count(*) FILTER (tag = 'Fallback')::INT AS n_fallback, 0 AS n_reactive_fallback, 0 AS n_repeat, count(skill)::INT AS n_skills,
        round(sum(n_children) FILTER (tag IN ('Sequence', 'Fallback')) / count(*) FILTER (tag IN ('Sequence', 'Fallback')), 2) AS mean_branching_factor FROM nodes GROUP BY tree_id""",
)
def mission_structure(spark, sf_dir):
    """Depth, counts and branching of every document."""
    return metrics.structure(trees(spark, sf_dir))


@query("mission_hallucination", BASE + "SELECT tree_id::VARCHAR AS tree_id, coalesce(max(skill) FILTER (skill = 'Fly'), '') AS hallucinated_skills, count(*) FILTER (skill = 'Fly')::INT AS hallucination_count, count(*)::INT AS total_skills FROM leaves GROUP BY tree_id")
def mission_hallucination(spark, sf_dir):
    """Unknown skills of every document."""
    return facts.hallucination(documents(spark, sf_dir))


_COMPLETE = """complete AS (SELECT d.tree_id, CASE WHEN count(p.port) = 0 THEN 1.0 ELSE count(a.port) / count(p.port) END AS port_completeness
        FROM docs d LEFT JOIN leaves l ON l.tree_id = d.tree_id LEFT JOIN ports p ON p.skill = l.skill LEFT JOIN attrs a ON a.tree_id = l.tree_id AND a.pre = l.pre AND a.port = p.port GROUP BY d.tree_id)"""


@query("mission_port_completeness", BASE + f", {_COMPLETE} SELECT tree_id::VARCHAR AS tree_id, port_completeness FROM complete")
def mission_port_completeness(spark, sf_dir):
    """Share of the required ports that every document has."""
    return facts.port_completeness(documents(spark, sf_dir))


@query(
    "mission_navigation_structure",
    BASE + """SELECT tree_id::VARCHAR AS tree_id, max(depth)::INT + 1 AS bt_depth, count(*)::INT AS node_count, 0 AS subtree_count, count(*) FILTER (tag IN ('Sequence', 'Fallback'))::INT AS control_node_count,
        count(*) FILTER (tag IN ('Action', 'Condition'))::INT AS atomic_node_count FROM nodes GROUP BY tree_id""",
)
def mission_navigation_structure(spark, sf_dir):
    """The second dialect's structure metrics."""
    return metrics.navigation_structure(trees(spark, sf_dir))


@query("mission_browser_metrics", BASE + "SELECT tree_id::VARCHAR AS tree_id, count(*)::INT AS nodes, 1 AS subtrees, count(skill)::INT AS leaf_nodes, any_value(length(xml))::INT AS xml_size FROM nodes JOIN docs USING (tree_id) GROUP BY tree_id")
def mission_browser_metrics(spark, sf_dir):
    """Counts and size as the browser shows them."""
    return facts.browser(documents(spark, sf_dir))


_INVENTORY = """, branch AS (SELECT tree_id, round(avg(n_leaves), 2) AS mean_branching, (SELECT string_agg(tag || ':' || n, ',' ORDER BY tag) FROM (SELECT tag, count(*) AS n FROM controls x WHERE x.tree_id = c.tree_id GROUP BY tag)) AS control_node_counts FROM controls c GROUP BY tree_id),
    per AS (SELECT tree_id, skill, count(*) AS n FROM leaves GROUP BY tree_id, skill),
    skill_list AS (SELECT tree_id, string_agg(skill, ',' ORDER BY skill) AS skill_ids, string_agg(skill || ':' || n, ',' ORDER BY skill) AS skill_id_counts FROM per GROUP BY tree_id),
    seen AS (SELECT tree_id, string_agg(skill || '=' || ports, ';' ORDER BY skill) AS ports_seen FROM (
        SELECT l.tree_id, l.skill, coalesce(string_agg(DISTINCT a.port, ',' ORDER BY a.port), '') AS ports FROM leaves l LEFT JOIN attrs a ON a.tree_id = l.tree_id AND a.pre = l.pre GROUP BY l.tree_id, l.skill) x GROUP BY tree_id),
    refs AS (SELECT d.tree_id, coalesce(string_agg(DISTINCT substr(value, 2, length(value) - 2), ',' ORDER BY substr(value, 2, length(value) - 2)), '') AS blackboard_refs
        FROM docs d LEFT JOIN attrs a ON a.tree_id = d.tree_id AND value LIKE '{%' GROUP BY d.tree_id),
    inventory AS (SELECT d.tree_id, true AS parse_ok, NULL::VARCHAR AS parse_error, NULL::VARCHAR AS root_main_tree, CASE WHEN d.tree_id % 5 = 0 THEN 'execute' ELSE 'main' END AS declared_subtrees, '' AS referenced_subtrees, skill_ids,
        skill_id_counts, control_node_counts, n_actions, n_conditions, 0 AS n_subtrees, 0 AS n_subtree_plus, 2 AS max_depth, mean_branching, false AS has_autoremap, false AS has_repeat_loop, 1 AS n_top_level_trees, ports_seen, blackboard_refs
        FROM docs d JOIN branch USING (tree_id) JOIN skill_list USING (tree_id) JOIN seen USING (tree_id) JOIN refs USING (tree_id)
        JOIN (SELECT tree_id, count(*) FILTER (tag = 'Action')::INT AS n_actions, count(*) FILTER (tag = 'Condition')::INT AS n_conditions FROM leaves GROUP BY tree_id) USING (tree_id))"""


@query("mission_inventory", BASE + _INVENTORY + " SELECT * REPLACE (tree_id::VARCHAR AS tree_id) FROM inventory")
def mission_inventory(spark, sf_dir):
    """The inventory row of every document."""
    return facts.inventory(documents(spark, sf_dir))


_KNOWN = ", ".join(f"'{s}'" for s in C.DEFAULT.names())


@query(
    "mission_inventory_summary",
    BASE + _INVENTORY + f""", used AS (SELECT DISTINCT skill FROM leaves), known AS (SELECT unnest([{_KNOWN}]) AS skill)
    SELECT count(*) AS n_files_total, count(*) AS n_files_parsed, 0 AS n_files_failed, 0 AS n_files_with_autoremap, 0 AS n_files_with_repeat_loop, min(max_depth) AS depth_min, max(max_depth) AS depth_max,
        round(avg(max_depth), 2) AS depth_mean, round(avg(mean_branching), 2) AS branching_mean, (SELECT count(*) FROM used)::INT AS n_unique_skills,
        (SELECT coalesce(string_agg(skill, ',' ORDER BY skill), '') FROM known WHERE skill NOT IN (SELECT skill FROM used)) AS skills_in_catalog_unused,
        (SELECT coalesce(string_agg(skill, ',' ORDER BY skill), '') FROM used WHERE skill NOT IN (SELECT skill FROM known)) AS skills_not_in_catalog,
        round(100 * (SELECT count(*) FROM used WHERE skill IN (SELECT skill FROM known)) / 31, 1) AS catalog_coverage_pct FROM inventory""",
)
def mission_inventory_summary(spark, sf_dir):
    """The corpus in one row."""
    return metrics.inventory_summary(facts.inventory(documents(spark, sf_dir)))


@query(
    "mission_features",
    BASE + """SELECT tree_id::VARCHAR AS tree_id, CASE WHEN tree_id % 5 = 0 THEN 'execute' ELSE 'main' END AS subtrees, 1 AS n_subtrees,
        coalesce((SELECT string_agg(value, ',' ORDER BY pre) FROM attrs a WHERE a.tree_id = d.tree_id AND port = 'type_to_be_checked' AND value <> 'x1'), '') AS motion_types,
        (SELECT string_agg(DISTINCT skill, ',' ORDER BY skill) FROM leaves l WHERE l.tree_id = d.tree_id) AS skills, """
    + ", ".join(f"(SELECT bool_or(contains(skill, '{w}')) FROM leaves l WHERE l.tree_id = d.tree_id) AS \"{c}\"" for c, w in metrics.FLAGS.items())
    + ", length(xml)::INT AS xml_len FROM docs d",
)
def mission_features(spark, sf_dir):
    """What patterns over the text tell of every document."""
    return metrics.features(documents(spark, sf_dir))


@query(
    "mission_paths",
    BASE + """, steps AS (SELECT tree_id, pre, '/root/BehaviorTree[1]/' || tag || '[' || row_number() OVER (PARTITION BY tree_id, tag ORDER BY pre) || ']' AS step FROM controls)
    SELECT tree_id::VARCHAR AS tree_id, 0 AS pre, '/root' AS xpath FROM docs UNION ALL SELECT tree_id::VARCHAR, 1, '/root/BehaviorTree[1]' FROM docs
    UNION ALL SELECT tree_id::VARCHAR, pre::INT, step FROM steps
    UNION ALL SELECT l.tree_id::VARCHAR, l.pre::INT, step || '/' || l.tag || '[' || row_number() OVER (PARTITION BY l.tree_id, l.parent, l.tag ORDER BY l.pre) || ']' FROM leaves l JOIN steps s ON s.tree_id = l.tree_id AND s.pre = l.parent""",
)
def mission_paths(spark, sf_dir):
    """The path of every element."""
    return metrics.xpaths(trees(spark, sf_dir))


_SOME = lambda words: "(" + " OR ".join(f"contains(lower(mission), '{w}')" for w in words) + ")"
_HAS = """holds AS (SELECT tree_id, bool_or(skill = 'ManageMeasurements') AS manage, bool_or(skill = 'AnalyseMeasurements') AS analysed, bool_or(skill = 'SimulationStarted') AS simulated,
        count(*) FILTER (skill = 'Fly') AS fly FROM leaves GROUP BY tree_id)"""
_REWARD = f""", {_HAS},
    kinds AS (SELECT *, CASE WHEN {_SOME(reward.SIMULATION)} THEN 'simulation' WHEN {_SOME(reward.INSPECTION)} AND {_SOME(reward.CONTROL)} THEN 'inspection_avec_controle'
        WHEN {_SOME(reward.INSPECTION)} THEN 'inspection_sans_controle' ELSE 'transport' END AS kind FROM texts JOIN holds USING (tree_id) JOIN verdicts USING (tree_id)),
    parts AS (SELECT tree_id, kind, missing,
        CASE WHEN NOT cut AND score > 0 THEN 1.0 ELSE -1.0 END AS r_parse, CASE WHEN NOT cut AND score > 0 THEN score ELSE -0.5 END AS r_structure,
        CASE WHEN cut THEN 1.0 ELSE greatest(0.0, 1.0 - 0.1 * n_warnings) END AS r_semantic,
        CASE kind WHEN 'transport' THEN CASE WHEN manage AND NOT cut THEN 0.5 ELSE 1.0 END WHEN 'simulation' THEN CASE WHEN simulated AND NOT cut THEN 1.0 ELSE 0.5 END
            WHEN 'inspection_avec_controle' THEN CASE WHEN cut OR NOT manage THEN 0.3 WHEN analysed THEN 1.0 ELSE 0.7 END ELSE CASE WHEN cut OR NOT manage THEN 0.3 WHEN analysed THEN 0.8 ELSE 1.0 END END AS r_coherence,
        CASE WHEN cut THEN 0.0 ELSE greatest(0.0, 1.0 - 0.5 * fly) END AS r_hallucination FROM kinds)
    SELECT tree_id::VARCHAR AS id, kind, {", ".join(f"CASE WHEN NOT missing THEN r_{k}::DOUBLE END AS r_{k}" for k in reward.WEIGHTS)},
        round(CASE WHEN missing THEN -1.0 ELSE greatest(-1.0, least(1.0, {" + ".join(f"{w} * r_{k}::DOUBLE" for k, w in reward.WEIGHTS.items())})) END::DOUBLE, 9) AS reward FROM parts"""


@query("mission_rewards", BASE + _REWARD)
def mission_rewards(spark, sf_dir):
    """The reward of every completion and its five parts."""
    return reward.rewards(documents(spark, sf_dir), id_col="tree_id").withColumn("reward", F.round("reward", 9))


_LINE = "'[L' || level || '] ' || code || coalesce(': ' || detail, '')"
_RICH_INSPECT, _RICH_CONTROL = _SOME(("inspection", "inspecter", "mesure", "controle")), _SOME(("verifier", "controler", "analyser", "qualite", "corriger"))
_FEEDBACK = f""", {_HAS},
    rich AS (SELECT * FROM found WHERE code <> 'missing_port'),
    told AS (
        SELECT d.tree_id, coalesce(string_agg({_LINE}, chr(10) ORDER BY level, step, pre, sub) FILTER (severity = 'error'), '') AS errors_text,
               coalesce(string_agg({_LINE}, chr(10) ORDER BY level, step, pre, sub) FILTER (severity = 'warning'), '') AS warnings_text,
               count(*) FILTER (severity = 'error') AS bad, count(*) FILTER (severity = 'warning') AS warned FROM docs d LEFT JOIN rich USING (tree_id) GROUP BY d.tree_id),
    parts AS (
        SELECT tree_id, missing OR cut AS none, bad = 0 AS valid, CASE WHEN bad > 0 THEN 0.0
               ELSE list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(warned), lambda i: 0.1::DOUBLE)), lambda a, b: greatest(0.5, a - b)) END AS score, warned, fly, errors_text, warnings_text,
               CASE WHEN NOT {_RICH_INSPECT} THEN CASE WHEN manage THEN 0.4 ELSE 1.0 END WHEN {_RICH_CONTROL} THEN CASE WHEN manage AND analysed THEN 1.0 WHEN manage THEN 0.6 ELSE 0.2 END
                    ELSE CASE WHEN manage AND NOT analysed THEN 1.0 WHEN manage THEN 0.7 ELSE 0.3 END END AS c
        FROM texts JOIN holds USING (tree_id) JOIN told USING (tree_id))
    SELECT tree_id::VARCHAR AS id, CASE WHEN none THEN 0.0 ELSE score END::DOUBLE AS raw_score, NOT none AND valid AS valid,
        round(CASE WHEN none THEN -1.0 ELSE greatest(-1.0, least(1.0, 0.3 + 0.2 * CASE WHEN valid THEN score ELSE -0.5 END + 0.2 * greatest(-1.0, 1.0 - 0.1 * warned) + 0.2 * c + 0.1 * CASE WHEN fly > 0 THEN 0.5 ELSE 1.0 END)) END::DOUBLE, 9) AS dense_score,
        CASE WHEN none THEN 'No <root> document in the completion' ELSE errors_text END AS errors_text, CASE WHEN none THEN '' ELSE warnings_text END AS warnings_text,
        CASE WHEN NOT none AND fly > 0 THEN 'Fly' ELSE '' END AS hallucinated,
        printf('Score: %.2f (valid=%s)', CASE WHEN none THEN 0.0 ELSE score END::DOUBLE, CASE WHEN valid AND NOT none THEN 'True' ELSE 'False' END)
            || CASE WHEN none THEN chr(10) || 'Errors:' || chr(10) || 'No <root> document in the completion' WHEN errors_text <> '' THEN chr(10) || 'Errors:' || chr(10) || array_to_string(string_split(errors_text, chr(10))[1:6], chr(10)) ELSE '' END
            || CASE WHEN NOT none AND warnings_text <> '' THEN chr(10) || 'Warnings:' || chr(10) || array_to_string(string_split(warnings_text, chr(10))[1:6], chr(10)) ELSE '' END
            || CASE WHEN NOT none AND fly > 0 THEN chr(10) || 'Skills outside the catalog: Fly' ELSE '' END AS prompt_text FROM parts"""


@query("mission_feedback", BASE + _FEEDBACK)
def mission_feedback(spark, sf_dir):
    """Rich feedback on every completion, with the text that a prompt gets."""
    f = reward.feedback(documents(spark, sf_dir), id_col="tree_id")
    return f.select("id", "raw_score", "valid", F.round("dense_score", 9).alias("dense_score"), "errors_text", "warnings_text", F.array_join("hallucinated", ",").alias("hallucinated"), "prompt_text")


@query(
    "mission_classes",
    BASE + f"""SELECT tree_id::VARCHAR AS tree_id, CASE WHEN {_SOME(reward.SIMULATION)} THEN 'simulation' WHEN {_SOME(reward.INSPECTION)} AND {_SOME(reward.CONTROL)} THEN 'inspection_avec_controle'
        WHEN {_SOME(reward.INSPECTION)} THEN 'inspection_sans_controle' ELSE 'transport' END AS kind,
        ['inspection_avec_controle', 'inspection_avec_controle', 'transport', 'transport', 'transport', 'inspection_sans_controle', 'transport', 'transport', 'transport'][tree_id % 9 + 1] AS negated,
        ['inspect-ctrl', 'inspect-ctrl', 'simulation', 'transport_simple', 'inspect-ctrl', 'inspect-ctrl', 'correction_anomalie', 'transport_arrêts_multiples', 'inspect+ctrl'][tree_id % 9 + 1] AS browser,
        tree_id % 9 IN (0, 1, 5) AS asks_inspection FROM texts""",
)
def mission_classes(spark, sf_dir):
    """The three classifications of every mission, and whether it asks for the inspection subtrees."""
    m = F.col("mission")
    return documents(spark, sf_dir).select(
        F.col("tree_id").cast("string").alias("tree_id"), reward.mission_class(m).alias("kind"), reward.negated_class(m).alias("negated"), reward.browser_class(m).alias("browser"),
        F.contains(reward.motion_subtrees(m), F.lit("(10)")).alias("asks_inspection"),
    )


_ROWS = f""", {_COMPLETE}, evaluated AS (SELECT v.*, h.fly, c.port_completeness, s.depth, s.n_skills, s.nodes FROM verdicts v JOIN complete c USING (tree_id)
        JOIN (SELECT tree_id, count(*) FILTER (skill = 'Fly') AS fly FROM leaves GROUP BY tree_id) h USING (tree_id)
        JOIN (SELECT tree_id, max(depth) AS depth, count(skill) AS n_skills, count(*) AS nodes FROM nodes GROUP BY tree_id) s USING (tree_id))"""


def evaluated(spark, sf_dir):
    """One row per document with verdict, hallucinations, ports and structure, from one parse."""
    return facts.evaluated(documents(spark, sf_dir))


@query(
    "mission_metrics",
    BASE + _ROWS + " SELECT tree_id::VARCHAR AS tree_id, valid, score, n_errors::INT AS n_errors, n_warnings::INT AS n_warnings, fly::INT AS hallucination_count, port_completeness, depth::INT AS max_depth, n_skills::INT AS n_skills, nodes::INT AS total_nodes FROM evaluated",
)
def mission_metrics(spark, sf_dir):
    """All metrics of a document in one row."""
    return evaluated(spark, sf_dir)


@query(
    "mission_summary",
    BASE + _ROWS + """ SELECT count(*) AS n_samples, round(avg(valid::INT), 9) AS xml_validity_rate, round(avg(score), 9) AS mean_score, round(avg((score = 1.0)::INT), 9) AS perfect_score_rate, round(avg((fly > 0)::INT), 9) AS hallucination_rate,
        round(avg(fly), 9) AS mean_hallucination_count, round(avg(depth), 9) AS mean_depth, round(avg(n_skills), 9) AS mean_n_skills, round(avg(port_completeness), 9) AS mean_port_completeness FROM evaluated""",
)
def mission_summary(spark, sf_dir):
    """The evaluation in one row."""
    return reports.summary(evaluated(spark, sf_dir))


@query(
    "mission_statistics",
    BASE + _ROWS + """, long AS (UNPIVOT (SELECT nodes::DOUBLE AS total_nodes, n_skills::DOUBLE AS n_skills, n_warnings::DOUBLE AS n_warnings, score AS score FROM evaluated) ON total_nodes, n_skills, n_warnings, score INTO NAME metric VALUE x)
        SELECT metric, min(x) AS least, round(avg(x), 9) AS mean, median(x) AS median, max(x) AS most FROM long GROUP BY metric""",
)
def mission_statistics(spark, sf_dir):
    """Least, mean, exact median and most of four metrics."""
    return reports.statistics(evaluated(spark, sf_dir), ["total_nodes", "n_skills", "n_warnings", "score"])


@query(
    "mission_port_report",
    BASE + """, texts4 AS (SELECT tree_id, code || ' ' || CASE WHEN code LIKE 'port_%' THEN split_part(detail, '=', 1) ELSE detail END AS issue FROM l4),
        n AS (SELECT count(*) AS total, count(*) FILTER (tree_id NOT IN (SELECT tree_id FROM l4)) AS clean FROM docs)
        SELECT issue, count(*) AS n, total, clean, (SELECT count(*) FROM l4) AS issues_total, row_number() OVER (ORDER BY count(*) DESC, issue)::INT AS place FROM texts4, n GROUP BY issue, total, clean QUALIFY place <= 20""",
)
def mission_port_report(spark, sf_dir):
    """The twenty commonest port issues, with clean and total documents."""
    return reports.commonest(spark, facts.port_counts(documents(spark, sf_dir)), top=20)


@query(
    "mission_checklist",
    BASE + "SELECT tree_id::VARCHAR AS tree_id, " + ", ".join(f"{'false' if c in ('root_main_tree', 'tag_not_allowed') else 'true'} AS ok_{c}" for c in navigation.CODES) + " FROM docs",
)
def mission_checklist(spark, sf_dir):
    """Thirteen yes or no answers of the second dialect's rules to every document."""
    return facts.checklist(documents(spark, sf_dir))
