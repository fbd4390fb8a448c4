"""Analogues, on the driver's tables, of the record types that the operators work on.

Each is one projection written in SQL that Spark and DuckDB read alike, so no frame costs a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "conversations")

_K = {"spark": "CAST(get_json_object(props, '$.k') AS BIGINT)", "duck": "CAST(json_extract_string(props, '$.k') AS BIGINT)"}

FRAMES = {
    # one answer of a model to a question through a channel
    "measurements": """
        SELECT event_id, ts, event_type AS model, user_id AS question_id, CAST(k % 5 + 1 AS STRING) AS channel,
               'd' || CAST(user_id % 8 AS STRING) AS domain, CASE WHEN user_id % 3 = 0 THEN 'hard' WHEN user_id % 3 = 1 THEN 'easy' ELSE 'medium' END AS difficulty,
               CAST((event_id * 7 + k) % 10 + 1 AS INT) AS bet, k % 4 = 0 AS skipped, CASE WHEN event_id % 3 = 0 THEN 'A' ELSE 'B' END AS choice,
               CAST(k % 3 AS INT) AS n_tools, CAST((k + user_id) % 4 AS INT) AS n_hedges, CAST(event_id * 13 % 2500 AS INT) AS length,
               CASE WHEN event_id % 17 = 0 THEN NULL ELSE (k * 3 + user_id) % 5 < 3 END AS correct,
               CASE WHEN value >= 200 THEN CAST(1.0 AS DOUBLE) ELSE value / 200 END AS conf, event_id % 9 <> 0 AS parse_success, event_id % 23 = 0 AS refused
        FROM (SELECT event_id, ts, user_id, event_type, value, {k} AS k FROM events) e""",
    # one task with two slots under a condition and a paradigm
    "trials": """
        SELECT o_orderkey AS task_id, o_orderpriority AS model, CAST(o_orderkey % 4 + 1 AS INT) AS condition, CAST(o_custkey % 3 + 1 AS INT) AS paradigm,
               o_orderkey % 5 <> 0 AS circularity_free, o_orderkey % 11 = 0 AS false_score, o_orderstatus <> 'P' AS api_success, CASE WHEN o_custkey % 4 = 0 THEN 'tailored' ELSE 'fixed' END AS task_type, o_orderdate AS ts,
               'd' || CAST(o_custkey % 8 AS STRING) AS domain_a, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'd' || CAST((o_custkey + 3) % 8 AS STRING) END AS domain_b,
               's' || CAST(c % 5 AS STRING) AS subcategory_a, 's' || CAST(e % 5 AS STRING) AS subcategory_b,
               CASE WHEN o_custkey % 8 < 3 THEN 'weak' WHEN o_custkey % 8 < 6 THEN 'strong' WHEN o_custkey % 8 = 6 THEN 'medium' ELSE 'unknown' END AS strength_a,
               CASE WHEN (o_custkey + 3) % 8 < 3 THEN 'weak' WHEN (o_custkey + 3) % 8 < 6 THEN 'strong' WHEN (o_custkey + 3) % 8 = 6 THEN 'medium' ELSE 'unknown' END AS strength_b,
               CASE WHEN c % 4 = 0 THEN 'defer' WHEN c % 4 = 1 THEN 'use_tool' ELSE 'proceed' END AS decision_a, CASE WHEN e % 4 = 0 THEN 'defer' WHEN e % 4 = 1 THEN 'use_tool' ELSE 'proceed' END AS decision_b,
               c % 7 < 4 AS correct_a, e % 7 < 4 AS correct_b, c % 6 = 0 AS routed_a, e % 6 = 0 AS routed_b,
               CAST(c % 3 AS INT) AS hedges_a, CAST(e % 3 AS INT) AS hedges_b, CAST(c % 5 AS INT) AS decomps_a, CAST(e % 5 AS INT) AS decomps_b, CAST(c % 211 AS INT) AS tokens_a, CAST(e % 211 AS INT) AS tokens_b,
               CASE WHEN c % 7 < 4 THEN NULL WHEN c % 3 = 0 THEN 'overconfident_precise' ELSE 'cautious_approximate' END AS error_a, CASE WHEN e % 7 < 4 THEN NULL WHEN e % 3 = 0 THEN 'overconfident_precise' ELSE 'cautious_approximate' END AS error_b
        FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS c, CAST(floor(o_totalprice * 3) AS BIGINT) AS e FROM orders) o""",
    # how good a model is in a domain, by two channels
    "capability": """
        SELECT model, domain, avg(CASE WHEN ok THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS natural_acc, avg(CASE WHEN sure THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS wagering_acc
        FROM (SELECT o_orderpriority AS model, 'd' || CAST(o_custkey % 8 AS STRING) AS domain, CAST(floor(o_totalprice) AS BIGINT) % 11 < 5 AS ok, CAST(floor(o_totalprice) AS BIGINT) % 13 < 7 AS sure FROM orders) x
        GROUP BY model, domain""",
    # requests, outcomes and costs of a deployment
    "requests": """
        SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 3 = 0 THEN 'high' WHEN o_orderkey % 3 = 1 THEN 'low' ELSE 'medium' END AS risk_tier, CASE WHEN o_custkey % 6 = 0 THEN 'ESCALATE' ELSE 'PROCEED' END AS model_decision, o_orderdate AS ts FROM orders""",
    "outcomes": """
        SELECT l_orderkey AS request_id, l_returnflag = 'N' AS final_correct, l_linestatus AS resolver_type, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey % 17 <> 0""",
    "costs": """
        SELECT l_orderkey AS request_id, l_extendedprice / 10000 AS cost, l_quantity * 30 AS latency, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey % 19 <> 0""",
    # labelled documents; labels cover a part of them
    "ratings": """
        SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic, CASE WHEN d.n_chars > 1200 THEN 1 ELSE 0 END AS rule FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
}


#: One slot of a trial: the trials unpivoted, slots without a domain left out.
_SLOT = "SELECT task_id, model, condition, paradigm, circularity_free, false_score, api_success, task_type, ts, '{s}' AS slot, domain_{s} AS domain, subcategory_{s} AS subcategory, strength_{s} AS strength, decision_{s} AS decision, correct_{s} AS correct, routed_{s} AS routed, hedges_{s} AS hedges, decomps_{s} AS decomps, tokens_{s} AS tokens, error_{s} AS error FROM ({t}) t WHERE domain_{s} <> ''"


def expand(sql: str) -> str:
    """Put the frames' SQL, in DuckDB's dialect, in place of their names."""
    sql = sql.replace("{components}", f"({_SLOT.format(s='a', t='{trials}')} UNION ALL {_SLOT.format(s='b', t='{trials}')})")
    for name, text in FRAMES.items():
        sql = sql.replace("{" + name + "}", "(" + text.replace("{k}", _K["duck"]) + ")")
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = FRAMES[name].replace("{k}", _K["spark"])
    used = [t for t in TABLES if re.search(rf"(?:FROM|JOIN) {t}\b", text)]
    for t in used:
        text = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})
