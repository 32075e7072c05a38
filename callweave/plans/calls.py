"""Queries over calls and their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from callweave.operators import calls as op
from callweave.operators import ingest
from callweave.sources import bindings as b

C = """c AS (SELECT event_id AS id, user_id AS customer_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
 CAST(json_extract(props, '$.k') AS BIGINT) % 20 AS agent_id, event_type AS category_raw, event_type AS category_sub,
 CAST(ts AS DATE) AS call_date, ts AS call_ts, CAST(floor(value) AS BIGINT) AS secs, value FROM events),
f AS (SELECT c.*, NOT EXISTS (SELECT 1 FROM c AS o WHERE o.customer_id = c.customer_id AND o.category_raw = c.category_raw
 AND o.call_date > c.call_date AND o.call_date <= c.call_date + INTERVAL 7 DAY) AS fcr FROM c)"""
W = "WITH " + C
PERF = C + """,
p0 AS (SELECT agent_id, count(*) AS consultations, count(*) FILTER (fcr) AS resolved, CAST(floor(avg(secs)) AS BIGINT) AS avg_seconds FROM f GROUP BY agent_id),
p1 AS (SELECT *, CAST(floor(CAST(resolved AS DOUBLE) / consultations * 100) AS BIGINT) AS fcr_rate FROM p0),
p AS (SELECT agent_id, consultations, fcr_rate, avg_seconds, CASE WHEN avg_seconds > 0 THEN CAST(avg_seconds // 60 AS VARCHAR) || ':' || lpad(CAST(avg_seconds % 60 AS VARCHAR), 2, '0') ELSE '0:00' END AS avg_time,
 row_number() OVER (ORDER BY consultations DESC, fcr_rate DESC, avg_seconds, agent_id) AS rank FROM p1)"""
STATS = C + ", s AS (SELECT customer_id, count(*) AS total_consultations, count(*) FILTER (fcr) AS resolved_first_call, max(call_date) AS last_consultation_date FROM f GROUP BY customer_id)"
D = "WITH d AS (SELECT event_id AS id, user_id AS downloaded_by, CAST(json_extract(props, '$.k') AS BIGINT) AS consultation_id, ts AS downloaded_at FROM events WHERE event_type = 'view')"
END = dt.datetime(2024, 1, 31)


def _flagged(spark, d):
    return op.fcr_flags(b.consultations(spark, d))


def _stats_applied(spark, d):
    return op.apply_customer_stats(b.customers(spark, d), op.customer_stats(_flagged(spark, d)))


def _round_robin(spark, d):
    calls = b.consultations(spark, d)
    pools = b.table(spark, d, "nation").select(F.col("n_name").alias("agent"), (F.col("n_nationkey") % 5).alias("g"), F.floor(F.col("n_nationkey") / 5).alias("slot"))
    names = spark.createDataFrame([(0, "click"), (1, "error"), (2, "purchase"), (3, "signup"), (4, "view")], "g int, category_raw string")
    return op.round_robin(calls, pools.join(names, "g").select("category_raw", "slot", "agent")).groupBy("category_raw", "agent").agg(F.count(F.lit(1)).alias("calls"))


def _weighted(spark, d):
    li = b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("c"), (F.col("l_linenumber") % 4).cast("string")).alias("criterion"), (F.floor("l_quantity") % 101).alias("score"))
    weights = spark.createDataFrame([("c0", 30.0), ("c1", 25.0), ("c2", 25.0), ("c3", 20.0)], "criterion string, weight double")
    return op.weighted_evaluation(li, weights)


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
LEAST = {"region": 10, "supplier": 10}
POOLS = {"결제/승인": 12, "한도": 19}


def _main_categories(spark, d):
    calls = b.consultations(spark, d).select("id", "agent_id", "category_raw")
    mapping = spark.createDataFrame([("view", "결제/승인", "조회/안내"), ("purchase", "결제/승인", "발급"), ("click", "한도", "변경")], "category_raw string, category_main string, category_sub string")
    return ingest.map_category(calls, mapping)


def _targets(spark, d):
    calls = b.consultations(spark, d)
    return op.agent_targets(op.agent_performance(_flagged(spark, d)), calls.agg(F.count(F.lit(1)).alias("calls")))


QUERIES = {
    "fcr_flags": lambda s, d: _flagged(s, d).select("id", "customer_id", "category_raw", "call_date", "fcr"),
    "similar_recent_consultations": lambda s, d: op.similar_recent(b.consultations(s, d), b.AS_OF),
    "agent_performance": lambda s, d: op.agent_performance(_flagged(s, d)),
    "agent_performance_apply": lambda s, d: op.apply_agent_performance(b.employees(s, d), op.agent_performance(_flagged(s, d))),
    "customer_stats": lambda s, d: op.customer_stats(_flagged(s, d)),
    "customer_stats_apply": lambda s, d: _stats_applied(s, d),
    "fcr_summary": lambda s, d: op.fcr_summary(_flagged(s, d)),
    "customer_recent_history": lambda s, d: op.customer_recent_history(b.consultations(s, d), b.AS_OF),
    "suspicious_downloads": lambda s, d: op.suspicious_downloads(b.downloads(s, d), b.employees(s, d), END, hours=24 * 30, least=3),
    "daily_download_stats": lambda s, d: op.daily_download_stats(b.downloads(s, d), b.AS_OF),
    "agent_distribution": lambda s, d: op.agent_distribution(b.consultations(s, d)),
    "agent_balance": lambda s, d: op.agent_balance(b.consultations(s, d)),
    "agent_extremes": lambda s, d: op.agent_extremes(b.consultations(s, d)),
    "category_rollup": lambda s, d: op.category_rollup(_main_categories(s, d)),
    "category_pools": lambda s, d: op.category_pools(_main_categories(s, d), POOLS),
    "type_distribution": lambda s, d: op.type_distribution(b.customers(s, d), "grade"),
    "frequency_of_frequencies": lambda s, d: op.frequency_of_frequencies(b.consultations(s, d)),
    "scenario_catalog": lambda s, d: op.scenario_catalog(b.consultations(s, d), "category_raw"),
    "recent_rank": lambda s, d: op.recent_rank(b.consultations(s, d)),
    "consultation_relevance": lambda s, d: op.consultation_relevance(b.consultations(s, d), b.AS_OF),
    "persona_relevance": lambda s, d: op.persona_relevance(b.customers(s, d), b.consultations(s, d), b.AS_OF),
    "customer_guidance_info": lambda s, d: op.customer_guidance_info(_stats_applied(s, d), b.AS_OF),
    "slot_conflicts": lambda s, d: op.slot_conflicts(b.consultations(s, d)),
    "agent_round_robin": _round_robin,
    "agent_targets": _targets,
    "calls_per_agent_lateral": lambda s, d: op.calls_per_agent(b.consultations(s, d)),
    "learning_analytics": lambda s, d: op.learning_analytics(b.simulation_results(s, d)),
    "learning_by_type": lambda s, d: op.learning_breakdown(b.simulation_results(s, d), "kind"),
    "learning_by_category": lambda s, d: op.learning_breakdown(b.simulation_results(s, d), "category"),
    "weighted_evaluation": _weighted,
    "personality_majority": lambda s, d: op.personality_majority(b.personality_labels(s, d)),
    "model_summary": lambda s, d: op.model_summary(b.evaluation_rows(s, d)),
    "class_accuracy_pivot": lambda s, d: op.class_accuracy(b.evaluation_rows(s, d), [0, 1]),
    "value_counts": lambda s, d: op.value_counts(b.personality_labels(s, d), "label"),
    "table_counts": lambda s, d: op.table_counts({t: b.table(s, d, t).filter("n_nationkey < 0") if t == "nation" else b.table(s, d, t) for t in TABLES}, LEAST),
}

_MAIN = W + ", m AS (SELECT *, CASE category_raw WHEN 'view' THEN '결제/승인' WHEN 'purchase' THEN '결제/승인' WHEN 'click' THEN '한도' ELSE '기타' END AS category_main FROM c)"
_LABELS = "WITH l AS (SELECT event_id AS id, user_id AS customer_id, ts, (['N1','N2','N3','S1','S2','S3'])[CAST(json_extract(props, '$.k') AS BIGINT) % 6 + 1] AS label FROM events)"
_EVAL = "WITH e AS (SELECT l.doc_id AS id, d.source AS model, CAST(l.quality AS BIGINT) AS truth, CAST(l.toxic AS BIGINT) AS res, d.doc_id % 100 / 100 AS ttft, CAST(n_chars % 50 AS DOUBLE) AS tps, CASE WHEN d.doc_id % 5 > 0 THEN n_chars END AS tokens FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def _breakdown(value: str, name: str) -> str:
    return f"WITH r AS (SELECT user_id AS employee_id, CAST(floor(value) AS BIGINT) % 101 AS score, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'purchase') SELECT employee_id, {value} AS {name}, count(*) AS attempts, round(avg(score), 6) AS avg_score, max(score) AS best_score, CAST(round(count(*) FILTER (score >= 70) * 100.0 / count(*), 2) AS DOUBLE) AS pass_rate FROM r GROUP BY 1, 2"


ORACLE_SQL = {
    "fcr_flags": W + " SELECT id, customer_id, category_raw, call_date, fcr FROM f",
    "similar_recent_consultations": W + " SELECT id, customer_id, category_sub, call_date, NOT fcr AS fcr_failed FROM f WHERE call_date >= DATE '2024-01-01'",
    "agent_performance": "WITH " + PERF + " SELECT * FROM p",
    "agent_performance_apply": "WITH " + PERF + " SELECT s_suppkey AS id, s_name AS name, n_name AS department, coalesce(consultations, 0) AS consultations, coalesce(fcr_rate, 0) AS fcr_rate, rank FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN p ON p.agent_id = s_suppkey",
    "customer_stats": "WITH " + STATS + " SELECT * FROM s",
    "customer_stats_apply": "WITH " + STATS + " SELECT c_custkey AS id, c_name AS name, c_mktsegment AS grade, coalesce(total_consultations, 0) AS total_consultations, coalesce(resolved_first_call, 0) AS resolved_first_call, last_consultation_date FROM customer LEFT JOIN s ON customer_id = c_custkey",
    "fcr_summary": W + " SELECT count(*) AS total, count(*) FILTER (fcr) AS fcr_true, count(*) FILTER (NOT fcr) AS fcr_false, CAST(round(count(*) FILTER (fcr) * 100.0 / count(*), 6) AS DOUBLE) AS rate FROM f",
    "customer_recent_history": W + " SELECT customer_id, count(*) AS calls, max(call_date) AS last_date, min(call_date) AS first_date, list_sort(list(DISTINCT category_sub)) AS categories, date_diff('day', max(call_date), DATE '2024-01-31') AS days_since, date_diff('day', max(call_date), DATE '2024-01-31') <= 30 AS has_relevant FROM c WHERE call_date >= DATE '2024-01-31' - INTERVAL 90 DAY GROUP BY customer_id",
    "suspicious_downloads": D + ", g AS (SELECT downloaded_by, count(*) AS downloads, max(downloaded_at) AS last_at, list_sort(list(DISTINCT consultation_id)) AS consultations FROM d WHERE downloaded_at >= TIMESTAMP '2024-01-01' AND downloaded_at <= TIMESTAMP '2024-01-31' GROUP BY downloaded_by HAVING count(*) >= 3) SELECT g.*, s_name AS name FROM g LEFT JOIN supplier ON s_suppkey = downloaded_by",
    "daily_download_stats": D + " SELECT CAST(downloaded_at AS DATE) AS day, count(*) AS downloads, count(DISTINCT downloaded_by) AS users, count(DISTINCT consultation_id) AS consultations FROM d WHERE CAST(downloaded_at AS DATE) >= DATE '2024-01-01' GROUP BY 1",
    "agent_distribution": W + ", n AS (SELECT agent_id, count(*) AS n FROM c GROUP BY 1) SELECT count(*) AS agents, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 2) AS average, min(n) AS least, max(n) AS most, max(n) - min(n) AS spread FROM n",
    "agent_balance": W + ", n AS (SELECT agent_id, count(*) AS n FROM c GROUP BY 1) SELECT round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS deviation, stddev_pop(n) / avg(n) > 0.5 AS uneven FROM n",
    "agent_extremes": W + ", n AS (SELECT agent_id, count(*) AS calls FROM c GROUP BY 1), t AS (SELECT *, row_number() OVER (ORDER BY calls DESC, agent_id) AS a, row_number() OVER (ORDER BY calls, agent_id) AS z FROM n) SELECT agent_id, calls, 'top' AS side FROM t WHERE a <= 5 UNION ALL SELECT agent_id, calls, 'bottom' FROM t WHERE z <= 5",
    "category_rollup": _MAIN + " SELECT category_main, category_raw, count(*) AS calls, count(DISTINCT agent_id) AS agents, CAST(grouping(category_main, category_raw) AS BIGINT) AS level FROM m GROUP BY ROLLUP (category_main, category_raw)",
    "category_pools": _MAIN + ", n AS (SELECT category_main, count(DISTINCT agent_id) AS agents FROM m GROUP BY 1), e AS (SELECT *, CASE category_main WHEN '결제/승인' THEN 12 WHEN '한도' THEN 19 ELSE agents END AS expected FROM n) SELECT *, abs(agents - expected) > 2 AS warn FROM e",
    "type_distribution": "SELECT c_mktsegment AS code, count(*) AS n, CAST(round(count(*) * 100.0 / (SELECT count(*) FROM customer), 1) AS DOUBLE) AS percent FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1",
    "frequency_of_frequencies": W + ", n AS (SELECT customer_id, count(*) AS calls FROM c GROUP BY 1) SELECT calls, count(*) AS customers FROM n GROUP BY calls",
    "scenario_catalog": W + " SELECT category_raw AS category, count(*) AS n, level FROM c, (VALUES ('beginner'), ('advanced')) AS v(level) GROUP BY category_raw, level",
    "recent_rank": W + " SELECT id, customer_id, call_date, row_number() OVER (PARTITION BY customer_id ORDER BY call_date DESC, id DESC) AS recency FROM c",
    "consultation_relevance": W + ", r AS (SELECT id, customer_id, date_diff('day', call_date, DATE '2024-01-31') AS d, row_number() OVER (PARTITION BY customer_id ORDER BY call_date DESC, id DESC) AS n FROM c) SELECT id, customer_id, d AS days_ago, CASE WHEN d <= 7 THEN 'high' WHEN d <= 30 THEN 'medium' WHEN d <= 90 THEN 'low' ELSE 'none' END AS level, CAST(CASE WHEN d <= 7 THEN 100 - 5 * d WHEN d <= 30 THEN 65 - 2 * (d - 7) WHEN d <= 90 THEN 20 - (d - 30) // 6 ELSE 0 END AS BIGINT) AS score FROM r WHERE n <= 10",
    "persona_relevance": W + ", l AS (SELECT customer_id, max(call_date) AS last, count(*) FILTER (call_date >= DATE '2024-01-31' - INTERVAL 90 DAY) AS recent_calls FROM c GROUP BY 1), j AS (SELECT c_custkey AS id, coalesce(date_diff('day', last, DATE '2024-01-31'), 9999) AS days_since, coalesce(recent_calls, 0) AS recent_calls FROM customer LEFT JOIN l ON customer_id = c_custkey) SELECT id, days_since, CASE WHEN days_since <= 30 THEN 'valid' WHEN days_since <= 180 THEN 'stale' ELSE 'outdated' END AS state, recent_calls FROM j",
    "customer_guidance_info": "WITH " + STATS + ", j AS (SELECT c_custkey AS id, total_consultations AS t, resolved_first_call AS r, date_diff('day', last_consultation_date, DATE '2024-01-31') AS d FROM customer LEFT JOIN s ON customer_id = c_custkey) SELECT id, CASE WHEN t IS NULL THEN 'new' WHEN d <= 7 THEN 'very_recent' WHEN d <= 30 THEN 'recent' WHEN d <= 90 THEN 'quarter' WHEN d <= 365 THEN 'year' ELSE 'inactive' END AS tier, CAST(round(CAST(r * 100 AS DECIMAL(20, 6)) / t, 1) AS DOUBLE) AS fcr_rate FROM j",
    "slot_conflicts": W + ", m AS (SELECT id, agent_id, date_trunc('minute', call_ts) AS minute, count(*) OVER (PARTITION BY agent_id, date_trunc('minute', call_ts)) AS booked FROM c) SELECT * FROM m WHERE booked > 1",
    "agent_round_robin": W + ", n AS (SELECT category_raw, count(*) AS n FROM c GROUP BY 1), p AS (SELECT n_name AS agent, (['click', 'error', 'purchase', 'signup', 'view'])[n_nationkey % 5 + 1] AS category_raw, n_nationkey // 5 AS slot FROM nation) SELECT category_raw, agent, (n - slot + 4) // 5 AS calls FROM n JOIN p USING (category_raw) WHERE n > slot",
    "agent_targets": "WITH " + PERF + """, b(a, z, hi, lo) AS (VALUES (1, 5, 132, 124), (6, 15, 122, 108), (16, 35, 106, 88), (36, 55, 87, 79), (56, 60, 78, 75)),
t AS (SELECT agent_id, rank, coalesce(CAST(round_even(CAST(hi AS DOUBLE) - (hi - lo) * (rank - a) / CAST(z - a AS DOUBLE), 0) AS BIGINT), 93) AS target FROM p LEFT JOIN b ON rank BETWEEN a AND z),
g AS (SELECT (SELECT count(*) FROM c) - sum(target) AS gap, count(*) FILTER (rank BETWEEN 15 AND 55) AS n FROM t)
SELECT agent_id, CAST(target + CASE WHEN rank BETWEEN 15 AND 55 THEN sign(gap) * (abs(gap) // n + CASE WHEN rank - 14 <= abs(gap) % n THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS target FROM t, g""",
    "calls_per_agent_lateral": W + ", r AS (SELECT agent_id, id, row_number() OVER (PARTITION BY agent_id ORDER BY id) AS place FROM c) SELECT * FROM r WHERE place <= 3 ORDER BY agent_id, place LIMIT 100",
    "learning_analytics": """WITH r AS (SELECT event_id AS id, user_id AS employee_id, CAST(floor(value) AS BIGINT) % 101 AS score, CAST(floor(value) AS BIGINT) AS secs, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) % 5 AS scenario_id, ts FROM events WHERE event_type = 'purchase'),
o AS (SELECT *, score >= 70 AS passed, row_number() OVER (PARTITION BY employee_id ORDER BY ts, id) AS up, row_number() OVER (PARTITION BY employee_id ORDER BY ts DESC, id DESC) AS down FROM r)
SELECT employee_id, count(*) AS attempts, round(avg(score), 6) AS avg_score, max(score) AS best_score, CAST(round(count(*) FILTER (passed) * 100.0 / count(*), 2) AS DOUBLE) AS pass_rate,
round(avg(score) FILTER (down <= 5) - avg(score) FILTER (up <= 5), 6) AS improvement, list_sort(coalesce(list(DISTINCT scenario_id) FILTER (passed), [])) AS completed, CAST(sum(secs) AS BIGINT) AS total_seconds, round(avg(k % 10 / 10), 6) AS avg_similarity, round(avg(CASE WHEN k % 7 > 0 THEN k % 100 / 100 END), 6) AS avg_completion, max(ts) AS latest_at, max(score) FILTER (down = 1) AS latest_score FROM o GROUP BY employee_id""",
    "learning_by_type": _breakdown("CASE WHEN k % 2 = 0 THEN 'practice' ELSE 'exam' END", "kind"),
    "learning_by_category": _breakdown("'c' || k % 4", "category"),
    "weighted_evaluation": "WITH s AS (SELECT l_orderkey AS id, ([30.0, 25.0, 25.0, 20.0])[l_linenumber % 4 + 1]::DOUBLE * (CAST(floor(l_quantity) AS BIGINT) % 101) / 100.0 AS x FROM lineitem) SELECT id, round(sum(x), 6) AS overall, round(sum(x), 6) >= 70 AS passed FROM s GROUP BY id",
    "personality_majority": _LABELS + ", w AS (SELECT id, customer_id, label, lag(label, 1) OVER o AS b, lag(label, 2) OVER o AS a FROM l WINDOW o AS (PARTITION BY customer_id ORDER BY ts, id)) SELECT id, customer_id, label, CASE WHEN label = b OR label = a THEN label WHEN a = b THEN a WHEN 'S3' IN (label, a, b) THEN 'S3' WHEN 'S2' IN (label, a, b) THEN 'S2' WHEN 'S1' IN (label, a, b) THEN 'S1' ELSE label END AS personality FROM w",
    "model_summary": _EVAL + " SELECT model, count(*) AS n, round(avg(CAST(truth = res AS INT)) * 100, 6) AS accuracy, round(avg(ttft), 6) AS mean_ttft, round(avg(tps), 6) AS mean_tps, round(avg(tokens), 6) AS mean_tokens FROM e GROUP BY model",
    "class_accuracy_pivot": _EVAL + " SELECT model, round(avg(CAST(res = 0 AS INT)) FILTER (truth = 0) * 100, 6) AS class_0, round(avg(CAST(res = 1 AS INT)) FILTER (truth = 1) * 100, 6) AS class_1 FROM e GROUP BY model",
    "value_counts": _LABELS + " SELECT label AS value, count(*) AS n FROM l GROUP BY 1",
    "table_counts": "WITH n AS (" + " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}{' WHERE n_nationkey < 0' if t == 'nation' else ''}" for t in TABLES) + ") SELECT *, CASE WHEN rows = 0 THEN 'empty' WHEN name IN ('region', 'supplier') AND rows < 10 THEN 'few' ELSE 'ok' END AS status FROM n",
}
