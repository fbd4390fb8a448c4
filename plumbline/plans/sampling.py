"""Queries on sampling and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sample as A
from .frames import frame, table
from .registry import query

_H = "sha1({x}::VARCHAR || '|{s}')"


@query("stratified_sample", """WITH g AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS g, count(*) OVER () AS k FROM (SELECT DISTINCT p_brand FROM part) b), r AS (SELECT p_partkey, part.p_brand, row_number() OVER (PARTITION BY part.p_brand ORDER BY p_size, p_partkey) AS rn, (500 // k) + (g <= 500 % k)::INT AS share FROM part JOIN g USING (p_brand)),
    t AS (SELECT * FROM r WHERE rn <= share), f AS (SELECT * FROM r WHERE rn > share ORDER BY rn, p_brand LIMIT (SELECT 500 - count(*) FROM t)) SELECT p_partkey FROM t UNION ALL SELECT p_partkey FROM f""")
def stratified(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return A.stratified(p, "p_brand", 500, ["p_size", "p_partkey"]).select("p_partkey")


@query("balanced_sample", f"SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {_H.format(x='doc_id', s=7)}) AS rn FROM labels) x WHERE rn <= 20")
def balanced(spark, d):
    return A.balanced(table(spark, d, "labels"), "quality", 40, "doc_id", 7).select("doc_id", "quality")


@query(
    "pair_quota_sample",
    f"""WITH t AS (SELECT task_id, model, condition, CASE WHEN strength_a = 'weak' AND strength_b = 'weak' THEN 'ww' WHEN strength_a <> 'weak' AND strength_b <> 'weak' THEN 'ss' ELSE 'sw' END AS stratum FROM {{trials}} t), n AS (SELECT model, condition, stratum, count(*) AS n FROM t GROUP BY ALL), q AS (SELECT model, condition, min(n) AS q FROM n GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY model, condition, stratum ORDER BY {_H.format(x='task_id', s=3)}) AS rn FROM t JOIN q USING (model, condition))
        SELECT task_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_H.format(x='task_id', s=4)}) AS r2 FROM r WHERE rn <= q) x WHERE r2 <= 400""",
)
def quota(spark, d):

    t = frame(spark, d, "trials").withColumn("stratum", F.when((F.col("strength_a") == "weak") & (F.col("strength_b") == "weak"), "ww").when((F.col("strength_a") != "weak") & (F.col("strength_b") != "weak"), "ss").otherwise("sw"))
    return A.pair_quota(t.select("task_id", "model", "condition", "stratum"), ["model", "condition"], "stratum", "task_id", 3, 400).select("task_id", "stratum")


@query("one_per_source", f"SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY f, {_H.format(x='doc_id', s=1)}) AS rn FROM (SELECT doc_id, lang, source, (row_number() OVER (PARTITION BY lang, source ORDER BY {_H.format(x='doc_id', s=1)}) > 1)::INT AS f FROM documents) y) x WHERE rn <= 30")
def sources(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return A.one_per_source(docs, ["lang"], "source", 30, [A.order_key(F.col("doc_id"), 1)]).select("doc_id", "lang", "source")


@query("half_and_half", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority, o_custkey % 8 < 3 ORDER BY o_orderkey) AS rn FROM orders) x WHERE rn <= 25")
def halves(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_custkey") % 8 < 3).alias("weak"))
    return A.per_group(o, ["o_orderpriority", "weak"], 25, ["o_orderkey"]).select("o_orderkey")


@query("sampled_accuracy", f"SELECT model, round(avg(correct::INT), 9) AS accuracy, count(*)::BIGINT AS n FROM {{measurements}} m WHERE correct IS NOT NULL AND question_id IN (SELECT question_id FROM (SELECT DISTINCT question_id FROM {{measurements}} q) x ORDER BY {_H.format(x='question_id', s=5)} LIMIT 50) GROUP BY model")
def sampled(spark, d):
    m = frame(spark, d, "measurements")
    ids = m.select("question_id").distinct().orderBy(A.order_key(F.col("question_id"), 5)).limit(50)
    return m.where("correct is not null").join(ids, "question_id", "left_semi").groupBy("model").agg(F.round(F.avg(F.col("correct").cast("int")), 9).alias("accuracy"), F.count("*").alias("n"))
