"""Queries on sources, schemas and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import datasets as D
from ..sources import files as S
from .frames import frame, table
from .registry import query


@query("scan_pushdown", "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_shipdate <= '1998-09-02' AND l_quantity > 10 GROUP BY ALL")
def pushdown(spark, d):
    l = table(spark, d, "lineitem").where((F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")) & (F.col("l_quantity") > 10))  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("json_with_defaults", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k, 'none' AS note, true AS ok FROM events")
def json_defaults(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k int, note string, ok boolean").alias("p"))
    return e.select("event_id", "p.k", F.coalesce("p.note", F.lit("none")).alias("note"), F.coalesce("p.ok", F.lit(True)).alias("ok"))


@query("tolerant_casts", "SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE o_totalprice::VARCHAR END AS DOUBLE) AS price FROM orders")
def casts(spark, d):
    o = table(spark, d, "orders").withColumn("text", F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")))
    return o.select("o_orderkey", F.col("text").try_cast("double").alias("price"))


@query("domain_cap_scan", "SELECT domain, event_id FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY event_id) AS rn FROM {measurements} m WHERE domain IN ('d1', 'd2', 'd5')) x WHERE rn <= 40")
def capped(spark, d):
    from ..operators.reshape import first_n

    return first_n(frame(spark, d, "measurements").where(F.col("domain").isin("d1", "d2", "d5")), ["domain"], ["event_id"], 40).select("domain", "event_id")


@query("resolver_accuracy", "SELECT lower(trim(o_orderstatus || ' ')) AS resolver, count(*)::BIGINT AS n, round(avg((o_orderkey % 3 > 0)::INT), 9) AS accuracy FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY resolver")
def resolver(spark, d):
    label = F.when(F.col("o_orderkey") % 3 > 0, " Correct").otherwise("incorrect")
    o = table(spark, d, "orders").select(F.lower(F.trim("o_orderstatus")).alias("resolver"), F.lower(F.trim(label)).alias("label"))
    return o.where(F.col("resolver").isin("o", "f") & F.col("label").isin("correct", "incorrect")).groupBy("resolver").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == "correct").cast("int")), 9).alias("accuracy"))


@query("normalize_numeric_set", "SELECT 'gsm8k_' || o_orderkey AS source_id, o_orderpriority AS question_text, (1000 + o_custkey)::VARCHAR AS correct_answer, 'exact_numeric' AS answer_type FROM orders")
def numeric_set(spark, d):
    raw = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("question"), F.concat(F.lit("steps\n#### "), F.format_number(F.col("o_custkey") + 1000, 0)).alias("answer"))
    return D.gsm8k(raw).select("source_id", "question_text", "correct_answer", "answer_type")


@query("normalize_boxed_set", "SELECT 'math_' || p_partkey AS source_id, p_size::VARCHAR AS correct_answer, 'exact_numeric' AS answer_type, CASE p_partkey % 2 WHEN 0 THEN 'spatial' ELSE 'arithmetic' END AS domain, CASE WHEN p_partkey % 5 + 1 <= 2 THEN 'easy' WHEN p_partkey % 5 + 1 = 3 THEN 'medium' ELSE 'hard' END AS difficulty FROM part")
def boxed_set(spark, d):
    raw = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("problem"), F.concat(F.lit("so \\boxed{1} then\n\\boxed{"), F.col("p_size").cast("string"), F.lit("}.")).alias("solution"), F.when(F.col("p_partkey") % 2 == 0, "Geometry").otherwise("Algebra").alias("type"), F.concat(F.lit("Level "), (F.col("p_partkey") % 5 + 1).cast("string")).alias("level"))
    return D.math_set(raw).select("source_id", "correct_answer", "answer_type", "domain", "difficulty")


@query("normalize_choice_sets", """SELECT 'logiqa_' || n_nationkey AS source_id, CASE WHEN n_regionkey = 0 THEN 'A' ELSE n_regionkey::VARCHAR END AS correct_answer, n_name || chr(10) || 'q' || chr(10) || 'A. x' || chr(10) || 'B. ' || n_name AS question_text FROM nation
    UNION ALL SELECT 'siqa_' || n_nationkey, CASE n_regionkey WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' ELSE 'A' END, n_name || chr(10) || 'q' || chr(10) || 'A. x' || chr(10) || 'B. y' || chr(10) || 'C. z' FROM nation
    UNION ALL SELECT 'reclor_' || n_nationkey, CASE WHEN n_regionkey BETWEEN 0 AND 3 THEN chr(65 + n_regionkey) ELSE 'A' END, n_name || chr(10) || 'q' || chr(10) || 'A. x' || chr(10) || 'B. y' FROM nation
    UNION ALL SELECT 'arc_' || n_nationkey, 'B', n_name || chr(10) || 'A. x' || chr(10) || 'B. y' FROM nation
    UNION ALL SELECT 'folio_' || n_nationkey, CASE WHEN n_regionkey = 1 THEN 'True' ELSE 'False' END, n_name || chr(10) || 'p' || chr(10) || 'c' FROM nation
    UNION ALL SELECT 'trivia_' || n_nationkey, n_name, 'q' FROM nation UNION ALL SELECT 'bb_' || n_nationkey, n_name, 'i' FROM nation WHERE n_regionkey = 2""")
def choice_sets(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("context"), F.lit("q").alias("question"), F.col("n_regionkey").alias("k"))
    parts = {
        "logiqa": lambda: D.logiqa(n.select("id", "context", "question", F.array(F.lit("x"), "context").alias("options"), F.col("k").alias("label"))),
        "social": lambda: D.social_iqa(n.select("id", "context", "question", F.lit("x").alias("answer_a"), F.lit("y").alias("answer_b"), F.lit("z").alias("answer_c"), F.col("k").cast("string").alias("label"))),
        "reclor": lambda: D.reclor(n.select("id", "context", "question", F.array(F.lit("x"), F.lit("y")).alias("options"), F.col("k").alias("label"))),
        "arc": lambda: D.arc(n.select("id", F.col("context").alias("question"), F.array(F.lit("A"), F.lit("B")).alias("labels"), F.array(F.lit("x"), F.lit("y")).alias("texts"), F.lit("B").alias("answer"))),
        "folio": lambda: D.folio(n.select("id", F.array("context", F.lit("p")).alias("premises"), F.lit("c").alias("conclusion"), (F.col("k") == 1).alias("label"))),
        "trivia": lambda: D.triviaqa(n.select("id", "question", F.col("context").alias("value"), F.array("context").alias("aliases"))),
        "bigbench": lambda: D.bigbench(n.select("id", F.when(F.col("k") == 2, "causal").otherwise("chess").alias("task"), F.lit("i").alias("inputs"), F.col("context").alias("target")), {"causal": "logical"}),
        "broken": lambda: D.gsm8k(n.select("nothing")),
    }
    out, failed = D.union(parts)
    assert set(failed) == {"broken"}
    return out.select("source_id", "correct_answer", "question_text")


@query("compiled_bank", "SELECT p_partkey, 'verified' AS origin, NULL AS parent FROM part WHERE p_size < 10 UNION ALL SELECT p_partkey, 'counterfactual', p_brand FROM part WHERE p_size > 45")
def bank(spark, d):
    p = table(spark, d, "part")
    return S.compile_bank(p.where("p_size < 10").select("p_partkey", F.lit("verified").alias("origin")), p.where("p_size > 45").select("p_partkey", F.lit("counterfactual").alias("origin"), F.col("p_brand").alias("parent")))


@query("cleaned_documents", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size / 5.0 END::DOUBLE AS x FROM part")
def cleaned(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, float("nan")).otherwise(F.col("p_size") / 5.0).alias("x"))
    return S.clean_numbers(p)


@query("content_manifest", "SELECT doc_id, strlen(text)::BIGINT AS size, sha256(text) AS sha256 FROM documents")
def manifest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"))


@query("manifest_changes", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 10 = 1 THEN 'new' ELSE 'changed' END AS reason FROM documents WHERE doc_id % 10 IN (0, 1, 2)")
def changes(spark, d):
    m = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    stored = m.where("doc_id % 10 <> 1")
    now = m.where("doc_id % 10 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 10 == 2, "x").otherwise(F.col("sha256")))
    return S.changed_files(stored, now, "doc_id")


@query("provenance_table", "SELECT n_name AS source_id, 'tpch' AS source, NULL AS domain, NULL AS parent_id FROM nation")
def provenance(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("source_id"), F.lit("tpch").alias("source"))
    return S.provenance(n).select("source_id", "source", "domain", "parent_id")


@query("row_validation", "SELECT count(*)::BIGINT AS n, count(*) FILTER (o_custkey % 9 = 0)::BIGINT AS blank, count(*) FILTER (o_custkey % 9 = 1)::BIGINT AS foreign_, count(*) <> 15000 AS wrong_count FROM orders")
def validation(spark, d):
    label = F.when(F.col("o_custkey") % 9 == 0, " ").when(F.col("o_custkey") % 9 == 1, "maybe").otherwise("correct")
    o = table(spark, d, "orders").select(F.trim(label).alias("label"))
    return o.agg(F.count("*").alias("n"), F.count_if(F.col("label") == "").alias("blank"), F.count_if((F.col("label") != "") & ~F.col("label").isin("correct", "incorrect")).alias("foreign_"), (F.count("*") != 15000).alias("wrong_count"))
