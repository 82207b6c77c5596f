"""Generated missions, step lists, masks and preference pairs; the SQL states the expected rows from numbers, without the operators."""

from pyspark.sql import functions as F

from arbolita.operators import corpus, generate, pairs
from arbolita.plans.mission_corpus import BASE
from arbolita.plans.mission_queries import trees
from arbolita.registry import query
from arbolita.sources.tables import table


@query(
    "steps_faults",
    """SELECT count(*) AS n, count(*) FILTER (event_id % 7 IN (0, 6)) AS ok, count(*) FILTER (event_id % 7 = 1) AS non_json, count(*) FILTER (event_id % 7 = 3) AS skill_not_allowed,
       count(*) FILTER (event_id % 7 = 4) AS missing_required_port, count(*) FILTER (event_id % 7 IN (2, 3, 4, 5)) AS other FROM events""",
)
def steps_faults(spark, sf_dir):
    """Counters of the strict parser over step lists of seven kinds, two of them right, one of these through a fence and an alias."""
    raw = F.element_at(F.array(*map(F.lit, (
        '```json\n[{"skill": "Wait", "params": {"seconds": 3}}]\n```', "not a list", '{"skill": "Wait"}', '[{"skill": "Fly", "params": {}}]', '[{"skill": "Wait", "params": {}}]', "[]",
        '[{"skill": "Spin", "params": {"spin_dist": 2}}, {"skill": "Wait", "params": {"wait_duration": 1}}]',
    ))), (F.col("event_id") % 7 + 1).cast("int"))
    return generate.fault_counters(generate.parse_steps(table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))))


@query(
    "mission_masked",
    BASE + """SELECT tree_id::VARCHAR AS tree_id, pre::INT AS pre, CASE tag WHEN 'Action' THEN 'ACTION_' ELSE 'COND_' END || dense_rank() OVER (PARTITION BY tree_id, tag ORDER BY first_pre) AS masked
        FROM (SELECT tree_id, pre, tag, min(pre) OVER (PARTITION BY tree_id, tag, skill) AS first_pre FROM leaves)""",
)
def mission_masked(spark, sf_dir):
    """The number that every skill of every document gets in order of first occurrence."""
    nodes = corpus.masked(trees(spark, sf_dir)).select("tree_id", F.inline("nodes"))
    return nodes.where(F.col("tag").isin("Action", "Condition")).select("tree_id", "pre", F.try_element_at("attrs", F.lit("ID")).alias("masked"))


SEED = 7
_TOTAL = sum(a[1] for a in generate.ARCHETYPES)
_PLACES = [(name, sum(a[1] for a in generate.ARCHETYPES[:k]), weight, texts) for k, (name, weight, _, texts) in enumerate(generate.ARCHETYPES)]


def _number(purpose: str) -> str:
    return f"('0x' || substr(md5(id || ':{SEED}:{purpose}'), 1, 8))::BIGINT"


def _point(purpose: str) -> str:
    return f"'PK ' || ({_number(purpose)} % 120000) // 1000 || '+' || lpad((({_number(purpose)}) % 1000)::VARCHAR, 3, '0')"


@query(
    "mission_generated",
    f"""WITH kinds(category, lo, hi, texts) AS (VALUES {", ".join(f"('{c}', {lo}, {lo + w}, {texts})" for c, lo, w, texts in _PLACES)}),
    ids AS (SELECT unnest(range(n)) AS id FROM (SELECT count(*) AS n FROM orders))
    SELECT 'm_' || lpad(id::VARCHAR, greatest(6, length(id::VARCHAR))::INT, '0') AS id, category, category <> 'unsupported' AS supported,
           replace(replace(texts[({_number("template")} % len(texts) + 1)::INT], '{{a}}', {_point("a")}), '{{b}}', {_point("b")}) AS mission
    FROM ids JOIN kinds ON {_number("archetype")} % {_TOTAL} >= lo AND {_number("archetype")} % {_TOTAL} < hi""",
)
def mission_generated(spark, sf_dir):
    """A seeded mission for every order, categories in proportion to their weights."""
    return generate.generated(spark, table(spark, sf_dir, "orders").count(), SEED).drop("step_types")


@query(
    "preference_rows",
    """WITH r AS (SELECT user_id, event_id, value, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id)),
    p AS (SELECT a.user_id, a.event_id AS chosen, b.event_id AS rejected, a.value AS chosen_score, b.value AS rejected_score, row_number() OVER (PARTITION BY a.user_id ORDER BY a.rn, b.rn) AS k
          FROM r a JOIN r b ON a.user_id = b.user_id AND a.rn <= greatest(1, a.n // 2) AND b.rn > greatest(1, a.n // 2) AND a.value > b.value)
    SELECT user_id, chosen, rejected, chosen_score, rejected_score, 'multi' AS source FROM p WHERE k <= 4""",
)
def preference_rows(spark, sf_dir):
    """The first four preference pairs of every user's events."""
    return pairs.preferences(table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.col("event_id").alias("made")), by="user_id", score="value", idx="event_id", text="made")
