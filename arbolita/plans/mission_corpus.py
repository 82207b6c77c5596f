"""A corpus of mission documents made from orders and their lines, as XML for Spark and as relations for the SQL beside it.

Every order with lines is a document: root (``BTCPP_format`` absent in every eleventh), one BehaviorTree (``execute`` in every
fifth, else ``main``), a Sequence of the lines with flag N and a Fallback of those with flag R. The first line is LoadMission, the
second MoveAndStop (but for a tenth of the orders), the others are skills of the catalog by part, a few unknown. Ports are there
or not by quantity, have their default or a wrong value by tax; a high discount adds an unknown port. The SQL never parses
anything: it states the expected facts from the relations, so it checks the parser and the rules from another side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolita.operators.catalog import PREREQUISITES, SKILLS
from arbolita.plans.assemble import joined, numbered, texts
from arbolita.sources.tables import table

MISSIONS = (
    "Inspection de la voie et controler les mesures", "Inspecter le ballast entre km 3 et km 8", "Lancer une simulation du trajet", "Transport vers le depot",
    "Transport simple, pas de mesure", "Vérifier le défaut à la volée", "Aller corriger l'anomalie", "Marche avec arrêts multiples, autorisation requise", "Attendre l'autorisation",
)

LINES = """
    raw AS (
        SELECT l_orderkey AS tree_id, l_returnflag AS flag, l_partkey, l_suppkey, CAST(floor(l_quantity) AS BIGINT) AS qty, CAST(floor(l_extendedprice) AS BIGINT) AS price, l_discount, l_tax,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq,
               row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord FROM {lineitem}),
    named AS (
        SELECT r.*, CASE WHEN seq = 1 THEN 'LoadMission' WHEN seq = 2 AND tree_id % 10 <> 3 THEN 'MoveAndStop' WHEN l_suppkey % 37 = 0 THEN 'Fly' ELSE s.skill END AS skill
        FROM raw r JOIN {skills} s ON s.k = r.l_partkey % 31),
    controls AS (
        SELECT tree_id, flag, n_leaves, CAST(2 + coalesce(sum(n_leaves + 1) OVER (PARTITION BY tree_id ORDER BY flag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pre,
               row_number() OVER (PARTITION BY tree_id ORDER BY flag) AS ord, CASE WHEN flag = 'N' THEN 'Sequence' ELSE 'Fallback' END AS tag
        FROM (SELECT tree_id, flag, count(*) AS n_leaves FROM raw GROUP BY tree_id, flag) g),
    leaves AS (
        SELECT n.tree_id, c.pre + n.ord AS pre, c.pre AS parent, c.tag AS parent_tag, n.ord, n.skill, coalesce(t.tag, 'Action') AS tag, n.qty, n.price, n.l_tax, n.l_discount > 0.08 AS extra
        FROM named n JOIN controls c ON c.tree_id = n.tree_id AND c.flag = n.flag LEFT JOIN {skills} t ON t.skill = n.skill),
    attrs AS (
        SELECT l.tree_id, l.pre, p.port, p.no, CASE WHEN l.l_tax > 0.07 THEN 'x1' ELSE p.default_value END AS value FROM leaves l JOIN {ports} p ON p.skill = l.skill WHERE (l.qty + p.no) % 5 <> 0
        UNION ALL SELECT tree_id, pre, 'price', 100, CAST(price AS VARCHAR(12)) FROM leaves WHERE extra)"""
XML = """,
    leaf_xml AS (
        SELECT l.tree_id, l.parent, l.parent_tag, l.ord, concat('<', tag, ' ID="', skill, '"', coalesce(a.text, ''), '/>') AS x
        FROM leaves l LEFT JOIN (SELECT tree_id, pre, {attr_list} AS text FROM attrs GROUP BY tree_id, pre) a ON a.tree_id = l.tree_id AND a.pre = l.pre),
    control_xml AS (SELECT tree_id, parent, concat('<', parent_tag, '>', {leaf_list}, '</', parent_tag, '>') AS x FROM leaf_xml GROUP BY tree_id, parent, parent_tag),
    docs AS (
        SELECT tree_id, concat('<root', CASE WHEN tree_id % 11 = 0 THEN '' ELSE ' BTCPP_format="4"' END, '><BehaviorTree ID="', CASE WHEN tree_id % 5 = 0 THEN 'execute' ELSE 'main' END, '">',
               {control_list}, '</BehaviorTree></root>') AS xml
        FROM control_xml GROUP BY tree_id)"""
_DUCK = {
    "{attr_list}": "string_agg(concat(' ', port, '=\"', value, '\"'), '' ORDER BY no)", "{leaf_list}": "string_agg(x, '' ORDER BY ord)", "{control_list}": "string_agg(x, '' ORDER BY parent)",
    "{lineitem}": "lineitem", "{skills}": "skills", "{ports}": "ports",
}
_SKILL_ROWS = [(k, s, t) for k, (_, s, t, _) in enumerate(SKILLS)]
_PORT_ROWS = [(s, p, no, kind, d, a) for _, s, _, ports in SKILLS for no, (p, kind, d, a) in enumerate(ports)]


def _replaced(text: str, by: dict[str, str]) -> str:
    for a, b in by.items():
        text = text.replace(a, b)
    return text


def _leaf_texts() -> list[str]:
    """The start of a leaf by skill (Fly after those of the catalog), quantity modulo 5 (5 for none) and whether its values are wrong."""
    out = []
    for name, tag, ports in [*((s, t, p) for _, s, t, p in SKILLS), ("Fly", "Action", [])]:
        for q in range(6):
            for wrong in (False, True):
                given = [(p, d) for no, (p, _, d, _) in enumerate(ports) if q < 5 and (q + no) % 5]
                out.append(f'<{tag} ID="{name}"' + "".join(f' {p}="{"x1" if wrong else d}"' for p, d in given))
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tree_id, xml, mission, completion``: the last is the document within prose; every 23rd has none, every 29th an unclosed one."""
    names = [s for _, s, _, _ in SKILLS]
    column = F.col
    lines = numbered(table(spark, sf_dir, "lineitem"), *map(column, ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")))
    part = column("l_partkey") % len(names)
    skill = (
        F.when(~part.between(0, len(names) - 1) | part.isNull(), None).when(column("seq") == 1, names.index("LoadMission")).when((column("seq") == 2) & (column("tree_id") % 10 != 3), names.index("MoveAndStop"))
        .when(column("l_suppkey") % 37 == 0, len(names)).otherwise(part)
    )
    quantity = F.coalesce(F.pmod(F.floor("l_quantity").cast("long"), F.lit(5)), F.lit(5))
    place = skill * 12 + quantity * 2 + F.coalesce(column("l_tax") > 0.07, F.lit(False)).cast("int")
    price = F.when(column("l_discount") > 0.08, F.concat(F.lit(' price="'), F.coalesce(F.floor("l_extendedprice").cast("long").cast("string"), F.lit("")), F.lit('"'))).otherwise("")
    leaf = F.concat(F.get(texts(_leaf_texts()), place.cast("int")), price, F.lit("/>"))
    head = F.concat(
        F.when(column("tree_id") % 11 == 0, "<root").otherwise('<root BTCPP_format="4"'), F.lit('><BehaviorTree ID="'), F.when(column("tree_id") % 5 == 0, "execute").otherwise("main"), F.lit('">')
    )
    df = joined(lines.select("tree_id", "flag", "seq", leaf.alias("leaf")), head, "</BehaviorTree></root>")
    mission = F.element_at(F.array(*map(F.lit, MISSIONS)), (F.col("tree_id") % len(MISSIONS) + 1).cast("int"))
    completion = F.when(F.col("tree_id") % 23 == 0, "no document").when(F.col("tree_id") % 29 == 0, "Voici: <root><a>").otherwise(F.concat(F.lit("Voici: "), "xml", F.lit(" fin")))
    return df.select("tree_id", "xml", mission.alias("mission"), completion.alias("completion"))


def _quoted(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows)


_LOOPS = "('MissionTerminated', 'MissionFullyTreated', 'MeasurementsQualityValidated', 'MeasurementsEnforcedValidated')"
#: The relations for DuckDB, and the findings that the rules must make of them.
BASE = f"""WITH skills(k, skill, tag) AS (VALUES {_values(_SKILL_ROWS)}), ports(skill, port, no, kind, default_value, allowed) AS (VALUES {_values(_PORT_ROWS)}),
    needs(skill, prerequisite, k) AS (VALUES {_values((s, p, k) for k, (s, p) in enumerate(PREREQUISITES))}),
    {_replaced(LINES + XML, _DUCK)},
    texts AS (
        SELECT tree_id, xml, ([{", ".join(map(_quoted, MISSIONS))}])[tree_id % {len(MISSIONS)} + 1] AS mission,
               tree_id % 23 = 0 AS missing, tree_id % 23 <> 0 AND tree_id % 29 = 0 AS cut FROM docs),
    nodes AS (
        SELECT tree_id, 0 AS pre, NULL::BIGINT AS parent, 0 AS depth, 'root' AS tag, NULL AS skill, 1 AS n_children FROM docs
        UNION ALL SELECT tree_id, 1, 0, 1, 'BehaviorTree', NULL, count(*) FROM controls GROUP BY tree_id
        UNION ALL SELECT tree_id, pre, 1, 2, tag, NULL, n_leaves FROM controls UNION ALL SELECT tree_id, pre, parent, 3, tag, skill, 0 FROM leaves),
    l1 AS (
        SELECT tree_id, 1 AS level, 'error' AS severity, 'unknown_skill' AS code, 'Fly' AS detail, 3 AS step, 0 AS pre, 0 AS sub FROM (SELECT DISTINCT tree_id FROM leaves WHERE skill = 'Fly')
        UNION ALL SELECT tree_id, 1, 'error', 'no_move_and_stop', NULL, 4, 0, 0 FROM docs
        WHERE tree_id NOT IN (SELECT tree_id FROM leaves WHERE skill = 'Fly' OR skill = 'MoveAndStop')),
    ok AS (SELECT tree_id FROM docs WHERE tree_id NOT IN (SELECT tree_id FROM l1)),
    first AS (SELECT tree_id, skill, min(pre) AS pos FROM leaves GROUP BY tree_id, skill),
    l4 AS (
        SELECT l.tree_id, 4 AS level, 'warning' AS severity, 'missing_port' AS code, p.port AS detail, 0 AS step, l.pre, p.no AS sub
        FROM leaves l JOIN ports p ON p.skill = l.skill LEFT JOIN attrs a ON a.tree_id = l.tree_id AND a.pre = l.pre AND a.port = p.port WHERE a.port IS NULL
        UNION ALL SELECT tree_id, 4, 'warning', 'unknown_port', 'price', 0, pre, 1500 FROM leaves WHERE extra AND skill <> 'Fly'
        UNION ALL SELECT a.tree_id, 4, 'warning', CASE t WHEN 0 THEN 'port_type' ELSE 'port_domain' END, a.port || '=' || a.value, 0, a.pre, 2000 + 2 * p.no + t
        FROM attrs a JOIN leaves l ON l.tree_id = a.tree_id AND l.pre = a.pre JOIN ports p ON p.skill = l.skill AND p.port = a.port, (VALUES (0), (1)) v(t)
        WHERE CASE WHEN t = 1 THEN p.allowed IS NOT NULL AND NOT list_contains(string_split(p.allowed, ','), a.value) WHEN p.kind = 'bb_var' THEN NOT (a.value LIKE '{{%' AND a.value LIKE '%}}')
              WHEN p.kind = 'string_literal' THEN false ELSE try_cast(a.value AS DOUBLE) IS NULL END),
    found AS (
        SELECT * FROM l1
        UNION ALL SELECT tree_id, 1, 'warning', 'btcpp_format', NULL, 5, 0, 0 FROM ok WHERE tree_id % 11 = 0
        UNION ALL SELECT tree_id, 2, 'warning', 'thin_fallback', n_leaves::VARCHAR, 4, pre, 0 FROM controls JOIN ok USING (tree_id) WHERE tag = 'Fallback' AND n_leaves < 2
        UNION ALL SELECT s.tree_id, 3, 'warning', 'prerequisite', n.skill || ' needs ' || n.prerequisite, 0, 0, n.k
        FROM first s JOIN ok USING (tree_id) JOIN needs n ON n.skill = s.skill LEFT JOIN first p ON p.tree_id = s.tree_id AND p.skill = n.prerequisite WHERE p.pos IS NULL OR p.pos > s.pos
        UNION ALL SELECT tree_id, 3, 'warning', 'condition_outside_fallback', skill, 2, 0, dense_rank() OVER (ORDER BY skill)
        FROM leaves JOIN ok USING (tree_id) WHERE skill IN {_LOOPS} GROUP BY tree_id, skill HAVING NOT bool_or(parent_tag = 'Fallback')
        UNION ALL SELECT l4.* FROM l4 JOIN ok USING (tree_id)
        UNION ALL SELECT c.tree_id, 5, 'warning', 'consumer_before_producer', c.skill, 0, c.parent, c.pre FROM leaves c JOIN ok USING (tree_id)
        WHERE c.parent_tag = 'Sequence' AND c.skill IN ('Move', 'Deccelerate', 'MoveAndStop')
          AND NOT EXISTS (SELECT 1 FROM leaves p WHERE p.tree_id = c.tree_id AND p.parent = c.parent AND p.pre < c.pre AND p.skill = 'PassMotionParameters')
        UNION ALL SELECT tree_id, 5, 'warning', 'execution_loop', 'execute', 1, 1, 0 FROM ok WHERE tree_id % 5 = 0),
    counts AS (
        SELECT d.tree_id, count(*) FILTER (severity = 'error') AS n_errors, count(*) FILTER (severity = 'warning') AS n_warnings FROM docs d LEFT JOIN found USING (tree_id) GROUP BY d.tree_id),
    verdicts AS (
        SELECT tree_id, n_errors = 0 AS valid, CASE WHEN n_errors > 0 THEN 0.0
               ELSE list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(n_warnings), lambda i: 0.1::DOUBLE)), lambda a, b: greatest(0.5, a - b)) END AS score, n_errors, n_warnings FROM counts)
"""
