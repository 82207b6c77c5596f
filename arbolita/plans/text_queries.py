"""Text, sampling, set, graph and report queries over the prose, page, chat and event tables."""

from arbolita.plans.shared_sql import shared

_FOUR = "concat(lpad(CAST({0} AS VARCHAR(12)), 10, '0'), ':', '42')"
# a portable hash: 32 bits of md5
_BUCKET = "CAST(conv(substr(md5({0}), 1, 8), 16, 10) AS BIGINT)"
_DUCK_BUCKET = "CAST(('0x' || substr(md5({0}), 1, 8)) AS BIGINT)"

shared(
    "mission_class_counts",
    """SELECT CASE WHEN contains(lower(text), 'tionre') THEN 'simulation' WHEN contains(lower(text), 'ing') AND contains(lower(text), 'ther') THEN 'inspection_avec_controle'
       WHEN contains(lower(text), 'ing') THEN 'inspection_sans_controle' ELSE 'transport' END AS category, count(*) AS n FROM {documents} GROUP BY 1""",
)
shared(
    "coherence_table",
    """WITH c AS (SELECT doc_id, contains(lower(text), 'ing') AS wanted, contains(lower(text), 'ther') AS found, contains(lower(text), 'tion') AS analysed FROM {documents})
       SELECT doc_id, CASE WHEN NOT wanted THEN CASE WHEN found THEN 0.5E0 ELSE 1.0E0 END WHEN found AND analysed THEN 1.0E0 WHEN found THEN 0.7E0 ELSE 0.3E0 END AS coherence FROM c""",
)
shared(
    "hash_dedup_first_wins",
    """SELECT doc_id, source, sha FROM (SELECT doc_id, source, sha2(text, 256) AS sha, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS k FROM {documents}) d WHERE k = 1""",
    {"sha2(text, 256)": "sha256(text)"},
)
shared(
    "hash_dedup_global",
    "SELECT sha2(text, 256) AS sha, min(doc_id) AS doc_id, count(*) AS copies FROM {documents} GROUP BY sha2(text, 256)",
    {"sha2(text, 256)": "sha256(text)"},
)
shared(
    "normalise_strip_tag",
    r"SELECT page_id, sha2(concat('<!-- domain: ', split_part(split_part(url, '//', 2), '/', 1), ' -->', ltrim(regexp_replace(html, '^<!DOCTYPE[^>]*>', ''))), 256) AS sha FROM {pages}",
    {"sha2(": "sha256(", ", 256) AS sha": ") AS sha"},
)
shared(
    "html_tag_metrics",
    r"""SELECT page_id, regexp_count(html, '<p>') AS paragraphs, regexp_count(html, '<a ') AS links, regexp_count(html, '<li>') AS items, length(html) AS chars, contains(html, '<nav>') AS has_nav FROM {pages}""",
    {"regexp_count(html, '<p>')": "len(regexp_extract_all(html, '<p>'))", "regexp_count(html, '<a ')": "len(regexp_extract_all(html, '<a '))", "regexp_count(html, '<li>')": "len(regexp_extract_all(html, '<li>'))"},
)
shared(
    "root_extract_variants",
    r"""SELECT page_id, length(regexp_extract(html, '(?s)<html.*?</html>', 0)) AS first_match, length(regexp_extract(html, '(?is)<ARTICLE>.*?</ARTICLE>', 0)) AS any_case,
        CASE WHEN contains(html, '<footer') THEN length(substr(html, instr(html, '<footer'))) END AS tail, coalesce(nullif(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), ''), '-') AS heading FROM {pages}""",
)
shared("strip_fences", r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(concat('```json', chr(10), text, chr(10), '```'), '^```[a-z]*\n', ''), '\n```$', '')) AS body FROM {conversations}")
shared(
    "prompt_messages",
    """SELECT conv_id, listagg(concat('[', role, '] ', coalesce(text, '')), chr(10)) WITHIN GROUP (ORDER BY turn) AS prompt, count(*) AS turns, max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) = 1 AS has_system FROM {conversations} GROUP BY conv_id""",
    {"listagg(concat('[', role, '] ', coalesce(text, '')), chr(10)) WITHIN GROUP (ORDER BY turn)": "string_agg(concat('[', role, '] ', coalesce(text, '')), chr(10) ORDER BY turn)"},
)
shared(
    "response_boundary",
    "SELECT conv_id, max(CASE WHEN role = 'assistant' THEN turn END) AS last_answer, count(CASE WHEN role = 'user' THEN 1 END) AS questions FROM {conversations} GROUP BY conv_id",
)
shared(
    "template_fill",
    "SELECT doc_id, replace(replace(replace('From [a] to [b] via [c]', '[a]', source), '[b]', lang), '[d]', 'x') AS mission FROM {documents}",
)
shared(
    "blackboard_variables",
    r"SELECT event_id, regexp_extract(props, '\"([a-z]+)\"', 1) AS var, props LIKE '{{%}}' AS whole_value FROM {events}",
    {r'\"': '"'},
)
shared(
    "json_props_shape",
    "SELECT event_id, get_json_object(props, '$.k') AS k, get_json_object(props, '$.missing') IS NULL AS lacks_missing, try_cast(get_json_object(props, '$.k') AS INT) IS NOT NULL AS is_int FROM {events}",
    {"get_json_object": "json_extract_string"},
)
shared(
    "param_alias",
    "SELECT event_id, coalesce(get_json_object(props, '$.duration'), get_json_object(props, '$.seconds'), get_json_object(props, '$.k')) AS wait_duration FROM {events}",
    {"get_json_object": "json_extract_string"},
)
shared(
    "steps_parse_counters",
    """WITH s AS (SELECT CASE WHEN event_type = 'error' THEN 'non_json' WHEN event_type = 'purchase' THEN 'skill_not_allowed' WHEN value < 10 THEN 'missing_required_port' WHEN value > 190 THEN 'other' END AS kind FROM {events})
       SELECT count(CASE WHEN kind = 'non_json' THEN 1 END) AS non_json, count(CASE WHEN kind = 'skill_not_allowed' THEN 1 END) AS skill_not_allowed, count(CASE WHEN kind = 'missing_required_port' THEN 1 END) AS missing_required_port,
       count(CASE WHEN kind IN ('other', 'skill_not_allowed', 'missing_required_port') THEN 1 END) AS other FROM s""",
)
shared(
    "perplexity_weighted",
    """WITH n AS (SELECT lang, CAST(n_chars AS BIGINT) AS w, CAST(n_chars % 7 AS BIGINT) AS nll FROM {documents} WHERE n_chars > 1)
       SELECT lang, round(exp(CAST(sum(nll * w) AS DOUBLE) / sum(w)), 6) AS perplexity, count(*) AS n FROM n GROUP BY lang""",
)
shared("degrade_drop_last_line", r"SELECT doc_id, sha2(regexp_replace(text, '\n[^\n]*$', ''), 256) AS sha FROM {documents}", {"sha2(": "sha256(", ", 256) AS sha": ") AS sha"})
shared("rename_first_only", r"SELECT doc_id, sha2(regexp_replace(text, '^([A-Za-z]+)', concat(source, 'XZ')), 256) AS sha FROM {documents}", {"sha2(": "sha256(", ", 256) AS sha": ") AS sha"})
shared("length_stats", "SELECT source, min(n_chars) AS shortest, max(n_chars) AS longest, percentile(n_chars, 0.5) AS middle, count(*) AS n FROM {documents} GROUP BY source", {"percentile(n_chars, 0.5)": "quantile_cont(n_chars, 0.5)"})
shared(
    "seeded_sample",
    f"SELECT doc_id, h FROM (SELECT doc_id, md5({_FOUR.format('doc_id')}) AS h FROM {{documents}}) d ORDER BY h, doc_id LIMIT 200",
)
shared(
    "stratified_generation",
    "WITH w AS (SELECT n_name, n_regionkey, n_nationkey % 4 + 1 AS weight FROM {nation}) SELECT n_name, k FROM w LATERAL VIEW explode(sequence(1, weight)) t AS k",
    {"SELECT n_name, k FROM w LATERAL VIEW explode(sequence(1, weight)) t AS k": "SELECT n_name, unnest(range(1, weight + 1))::INT AS k FROM w"},
)
shared(
    "weighted_choice",
    f"""WITH w AS (SELECT n_nationkey, n_name, n_nationkey % 4 + 1 AS weight FROM {{nation}}), cum AS (SELECT n_name, sum(weight) OVER (ORDER BY n_nationkey) - weight AS lo, sum(weight) OVER (ORDER BY n_nationkey) AS hi, sum(weight) OVER () AS total FROM w),
        d AS (SELECT doc_id, {_BUCKET.format("CAST(doc_id AS VARCHAR(12))")} AS h FROM {{documents}})
        SELECT doc_id, n_name FROM d JOIN cum ON h % total >= lo AND h % total < hi""",
    {_BUCKET.format("CAST(doc_id AS VARCHAR(12))"): _DUCK_BUCKET.format("CAST(doc_id AS VARCHAR(12))")},
)
shared(
    "ratio_allocation",
    "WITH n AS (SELECT source, count(*) AS n FROM {documents} GROUP BY source) SELECT source, n, CAST(round(0.3 * n) AS BIGINT) AS a, CAST(round(0.55 * n) AS BIGINT) AS b, n - CAST(round(0.3 * n) AS BIGINT) - CAST(round(0.55 * n) AS BIGINT) AS c FROM n",
)
shared("main_first_order", "SELECT n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY CASE WHEN n_nationkey % 5 = 3 THEN 0 ELSE 1 END, n_nationkey) AS place FROM {nation}")
shared("cheapest_offer", "SELECT p_partkey, p_retailprice FROM {part} p LEFT ANTI JOIN (SELECT DISTINCT l_partkey FROM {lineitem} WHERE l_quantity > 49) x ON p.p_partkey = x.l_partkey WHERE p_size >= 20 ORDER BY p_retailprice, p_partkey LIMIT 1", {"LEFT ANTI JOIN": "ANTI JOIN"})
shared("next_run_number", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS run_date, max(event_id) + 1 AS next_id, concat(CAST(CAST(ts AS DATE) AS VARCHAR(10)), '_exp', CASE WHEN count(*) < 99 THEN lpad(CAST(count(*) + 1 AS VARCHAR(10)), 3, '0') ELSE CAST(count(*) + 1 AS VARCHAR(10)) END) AS run_id FROM {events} GROUP BY CAST(ts AS DATE)")
shared("history_display", "SELECT event_id, date_format(ts, 'HH:mm:ss') AS time, coalesce(nullif(event_type, 'view'), '-') AS label, CASE WHEN value > 50 THEN 'valid' ELSE 'invalid' END AS status FROM {events}", {"date_format(ts, 'HH:mm:ss')": "strftime(ts, '%H:%M:%S')"})
shared("union_labelled", "SELECT doc_id AS id, 'document' AS domain, length(text) AS chars FROM {documents} UNION ALL SELECT page_id, 'page', length(html) FROM {pages} UNION ALL SELECT item_id, 'benchmark', length(text) FROM {benchmark}")
shared("novel_values", "SELECT DISTINCT lang FROM {documents} EXCEPT SELECT DISTINCT substr(lower(n_name), 1, 2) FROM {nation}")
shared(
    "issue_top_k",
    "SELECT split_part(o_orderpriority, '-', 2) AS issue, count(*) AS n FROM {orders} GROUP BY 1 ORDER BY n DESC, issue LIMIT 3",
)
shared("existential_patterns", "SELECT max(CASE WHEN contains(text, 'License') THEN 1 ELSE 0 END) = 1 AS licence, max(CASE WHEN contains(text, 'token =') THEN 1 ELSE 0 END) = 1 AS secret, max(CASE WHEN contains(text, 'Motion') THEN 1 ELSE 0 END) = 1 AS motion FROM {documents}")
shared("occurrence_averages", "SELECT lang, round(avg(CAST(length(text) - length(replace(text, 'tion', '')) AS DOUBLE) / 4), 6) AS mean_occurrences, round(avg(CAST(length(text) AS DOUBLE)), 6) AS mean_length FROM {documents} GROUP BY lang")
shared("valid_only_mean", "SELECT count(*) AS n, avg(CASE WHEN quality = 1 THEN 1.0E0 - toxic END) AS mean_valid, avg(1.0E0 - toxic) AS mean_all FROM {labels}")
shared("run_matrix", "SELECT role AS mode, count(*) AS runs, count(CASE WHEN text IS NULL OR length(text) = 0 THEN 1 END) AS failures, max(length(text)) AS longest FROM {conversations} GROUP BY role")
shared("append_resume", "SELECT d.doc_id, d.source FROM {documents} d LEFT ANTI JOIN {labels} l ON d.doc_id = l.doc_id", {"LEFT ANTI JOIN": "ANTI JOIN"})
shared("dangling_refs", "SELECT p_partkey, (p_partkey * 7 + 3) % 2500 AS ref FROM {part} p LEFT ANTI JOIN (SELECT p_partkey AS k FROM {part}) d ON (p.p_partkey * 7 + 3) % 2500 = d.k", {"LEFT ANTI JOIN": "ANTI JOIN"})
shared("dead_definitions", "SELECT p_partkey FROM {part} p LEFT ANTI JOIN (SELECT (p_partkey * 7 + 3) % 2500 AS ref FROM {part}) r ON p.p_partkey = r.ref WHERE p_partkey <> 0", {"LEFT ANTI JOIN": "ANTI JOIN"})
_EDGES = "e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM {nation})"
shared(
    "reference_cycles",
    f"""WITH RECURSIVE {_EDGES}, walk(start, here, steps, least_on) AS (SELECT a, b, 1, least(a, b) FROM e UNION ALL SELECT w.start, e.b, w.steps + 1, least(w.least_on, e.b) FROM walk w JOIN e ON w.here = e.a WHERE w.here <> w.start AND w.steps < 25)
        SELECT start AS entry, steps AS length FROM walk WHERE here = start AND least_on = start""",
)
shared(
    "inline_references",
    f"""WITH RECURSIVE {_EDGES}, walk(root, here, depth, path) AS (SELECT a, b, 1, concat(',', CAST(a AS VARCHAR(4)), ',') FROM e
        UNION ALL SELECT w.root, e.b, w.depth + 1, concat(w.path, CAST(w.here AS VARCHAR(4)), ',') FROM walk w JOIN e ON w.here = e.a WHERE NOT contains(w.path, concat(',', CAST(w.here AS VARCHAR(4)), ',')) AND w.depth < 25)
        SELECT root, max(depth) AS depth, count(*) AS inlined FROM walk GROUP BY root""",
)
shared("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, max(value) AS top FROM {events} GROUP BY 1, 2")
shared(
    "event_sliding_windows",
    """WITH s AS (SELECT explode(array(date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR)) AS start, value FROM {events}) SELECT start, count(*) AS n, max(value) AS top FROM s GROUP BY start""",
    {"explode(array(date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR))": "unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR])"},
)
shared(
    "event_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM {events}),
        s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, k""",
)
shared("asof_last_value", "SELECT event_id, user_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS before, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS newest FROM {events}")
shared("availability_failover", "SELECT user_id, coalesce(max(CASE WHEN event_type = 'purchase' THEN event_id END), max(CASE WHEN event_type = 'click' THEN event_id END), -1) AS chosen FROM {events} GROUP BY user_id")
shared("config_projection", "SELECT n_name, concat(n_name, '-', coalesce(CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE CAST(n_nationkey AS VARCHAR(4)) END, r_name)) AS run_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey")
shared("catalog_summary_text", "SELECT r_name, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS members, count(*) AS n FROM {region} JOIN {nation} ON r_regionkey = n_regionkey GROUP BY r_name", {"listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name)": "string_agg(n_name, ', ' ORDER BY n_name)"})
shared(
    "pareto_front",
    "SELECT a.s_suppkey, a.s_acctbal, a.s_nationkey FROM {supplier} a LEFT ANTI JOIN {supplier} b ON b.s_nationkey = a.s_nationkey AND b.s_acctbal > a.s_acctbal",
    {"LEFT ANTI JOIN": "ANTI JOIN"},
)
shared("confusion_matrix", "SELECT quality AS truth, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END AS predicted, count(*) AS n FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY 1, 2")
