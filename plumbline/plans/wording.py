"""Queries on text extractors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from .frames import table
from .registry import query


# -- responses written from the orders, so that what was put in is known -------------------------------------

_WAGER = """CASE o_orderkey % 5 WHEN 0 THEN 'I cannot do this. ANSWER: x' WHEN 1 THEN 'ANSWER: [' || o_orderpriority || ']' || chr(10) || 'about 7' WHEN 2 THEN 'ANSWER: ' || o_orderpriority || chr(10) || 'BET: ' || CAST(o_custkey % 14 AS STRING)
            WHEN 3 THEN 'answer : [' || o_orderstatus || ' ]' || chr(10) || 'bet: 10' ELSE 'no labels here' END"""


def _orders(spark, d, text: str):
    return table(spark, d, "orders").withColumn("text", F.expr(text.replace("chr(10)", "'\\n'")))


@query(
    "parse_wager",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN '[' || o_orderpriority || ']' || chr(10) || 'about 7' WHEN 2 THEN o_orderpriority WHEN 3 THEN o_orderstatus END AS answer,
       (CASE o_orderkey % 5 WHEN 1 THEN 7 WHEN 2 THEN CASE WHEN o_custkey % 14 BETWEEN 1 AND 10 THEN o_custkey % 14 END WHEN 3 THEN 10 END)::VARCHAR AS bet, o_orderkey % 5 = 0 AS refused FROM orders""",
)
def wager(spark, d):
    p = _orders(spark, d, _WAGER).select("o_orderkey", X.parse_wager(F.col("text")).alias("p"))
    return p.select("o_orderkey", "p.answer", F.col("p.bet").cast("string").alias("bet"), "p.refused")


@query(
    "parse_optout",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 'SKIPPING not' WHEN 2 THEN o_orderpriority WHEN 3 THEN 'I do not skip this' END AS answer, o_orderkey % 4 = 0 AS skipped, o_orderkey % 4 IN (0, 2) AS ok FROM orders""",
)
def optout(spark, d):
    text = "CASE o_orderkey % 4 WHEN 0 THEN 'Well, Skip.' WHEN 1 THEN 'SKIPPING not' WHEN 2 THEN 'ANSWER: ' || o_orderpriority || chr(10) || 'NOTE: skipping' ELSE 'I do not skip this' END"
    p = _orders(spark, d, text).select("o_orderkey", X.parse_optout(F.col("text")).alias("p"))
    return p.select("o_orderkey", "p.answer", "p.skipped", F.col("p.parse_success").alias("ok"))


@query("parse_choice", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS choice, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority END AS answer FROM orders")
def choice(spark, d):
    text = "CASE o_orderkey % 3 WHEN 0 THEN 'CHOICE: a' || chr(10) || 'ANSWER: ' || o_orderpriority WHEN 1 THEN 'I take B, not A' ELSE 'none of those' END"
    p = _orders(spark, d, text).select("o_orderkey", X.parse_choice(F.col("text")).alias("p"))
    return p.select("o_orderkey", "p.choice", "p.answer")


@query("parse_tools", "SELECT o_orderkey, (1 + (o_orderkey % 2 = 0)::INT)::INT AS n, 'calculator' AS first, o_custkey || ' + 1' AS input, o_orderpriority AS answer FROM orders")
def tools(spark, d):
    text = "'[USE_TOOL: Calculator | ' || CAST(o_custkey AS STRING) || ' + 1 ] [use_tool: magic | x]' || CASE WHEN o_orderkey % 2 = 0 THEN '[USE_TOOL:flag_review|hard]' ELSE '' END || chr(10) || 'ANSWER: ' || o_orderpriority"
    p = _orders(spark, d, text).select("o_orderkey", X.parse_tools(F.col("text")).alias("p"))
    return p.select("o_orderkey", F.size("p.tools_used").alias("n"), F.col("p.tools_used")[0]["tool_name"].alias("first"), F.col("p.tools_used")[0]["tool_input"].alias("input"), "p.answer")


@query("parse_report", "SELECT o_orderkey, least(o_custkey % 150, 100)::INT AS confidence, 2 AS skills, o_orderpriority AS weakest, o_orderkey % 2 = 0 AS verify, CASE WHEN o_orderkey % 3 = 0 THEN 'tool-use' ELSE 'guess wildly' END AS approach, o_orderstatus AS answer FROM orders")
def report(spark, d):
    text = """'CONFIDENCE: ' || CAST(o_custkey % 150 AS STRING) || chr(10) || 'SUB_SKILLS: [adding, , dividing]' || chr(10) || 'WEAKEST_SKILL: [' || o_orderpriority || ']' || chr(10) || 'VERIFY: ' || CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no' END || chr(10)
              || 'APPROACH: ' || CASE WHEN o_orderkey % 3 = 0 THEN 'Tool use' ELSE 'Guess wildly' END || chr(10) || 'ANSWER: ' || o_orderstatus"""
    p = _orders(spark, d, text).select("o_orderkey", X.parse_report(F.col("text")).alias("p"))
    return p.select("o_orderkey", "p.confidence", F.size("p.sub_skills").alias("skills"), F.col("p.weakest_skill").alias("weakest"), "p.verify", "p.approach", "p.answer")


@query("strip_thinking", "SELECT o_orderkey, o_orderpriority AS cleaned, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus || chr(10) || chr(10) || 'again' END AS thinking FROM orders")
def thinking(spark, d):
    text = "CASE WHEN o_orderkey % 2 = 0 THEN '<think> ' || o_orderstatus || chr(10) || '</think>  ' || o_orderpriority || '<THINK>again</think> ' ELSE o_orderpriority END"
    return _orders(spark, d, text).select("o_orderkey", X.strip_thinking(F.col("text")).alias("p")).select("o_orderkey", "p.*")


@query("parse_natural", "SELECT conv_id, turn, len(regexp_extract_all(text, '\\S+'))::INT AS words, (len(regexp_extract_all(lower(text), 'tion')) + len(regexp_extract_all(lower(text), 'ch')))::INT AS hedges, (len(regexp_extract_all(lower(text), 'en')))::INT AS caveats FROM conversations WHERE role = 'assistant'")
def natural(spark, d):
    c = table(spark, d, "conversations").where("role = 'assistant'")
    p = c.select("conv_id", "turn", X.parse_natural(F.col("text"), ("tion", "ch"), ("en",)).alias("p"))
    return p.select("conv_id", "turn", F.col("p.response_length").cast("int").alias("words"), F.col("p.hedging_count").alias("hedges"), F.col("p.caveat_count").alias("caveats"))


@query("implicit_signals", "SELECT doc_id, length(text)::INT AS chars, ((contains(lower(text), 'tion'))::INT + (contains(lower(text), 'zu'))::INT + (contains(lower(text), 'ñ'))::INT)::INT AS present, contains(lower(text), 'eau') AS caveat FROM documents")
def implicit(spark, d):
    p = table(spark, d, "documents").select("doc_id", X.implicit_signals(F.col("text"), ("tion", "zu", "ñ"), ("eau",)).alias("p"))
    return p.select("doc_id", F.col("p.response_length").alias("chars"), F.col("p.hedging_count").alias("present"), F.col("p.caveat_present").alias("caveat"))


@query("document_length_bins", "SELECT CASE WHEN n <= 0 THEN '0' WHEN n <= 200 THEN '1-200' WHEN n <= 500 THEN '201-500' WHEN n <= 1000 THEN '501-1000' WHEN n <= 2000 THEN '1001-2000' ELSE '2001+' END AS bin, count(*)::BIGINT AS docs, count(quality)::BIGINT AS labelled FROM (SELECT len(regexp_extract_all(text, '\\S+')) AS n, quality FROM documents LEFT JOIN labels USING (doc_id)) x GROUP BY bin")
def doc_bins(spark, d):
    from ..operators.reshape import length_bin

    docs = table(spark, d, "documents").select("doc_id", X.word_count(F.col("text")).alias("n"))
    return docs.join(table(spark, d, "labels"), "doc_id", "left").groupBy(length_bin(F.col("n")).alias("bin")).agg(F.count("*").alias("docs"), F.count("quality").alias("labelled"))


@query("decorated_labels", "SELECT o_orderkey, o_orderpriority AS answer, (o_custkey % 10 + 1)::INT AS bet FROM orders")
def decorated(spark, d):
    p = _orders(spark, d, "'## Reply' || chr(10) || '**ANSWER:** `' || o_orderpriority || '`' || chr(10) || '__BET__: ' || CAST(o_custkey % 10 + 1 AS STRING)")
    p = p.select("o_orderkey", X.parse_wager(X.strip_markdown(F.col("text"))).alias("p"))
    return p.select("o_orderkey", "p.answer", "p.bet")


@query("error_types", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_custkey % 4 > 0 THEN 'cautious_approximate' WHEN o_orderkey % 2 = 0 THEN 'overconfident_precise' ELSE 'cautious_approximate' END AS kind FROM orders")
def errors(spark, d):
    o = table(spark, d, "orders").withColumn("answer", F.when(F.col("o_orderkey") % 2 == 0, "it is 5").otherwise("a long winding claim of more than six words"))
    return o.select("o_orderkey", X.error_type(F.col("answer"), F.col("o_orderkey") % 3 == 0, F.col("o_custkey") % 4).alias("kind"))


@query("flaw_language", "SELECT c_custkey, c_custkey % 3 = 0 AS flawed FROM customer")
def flaws(spark, d):
    c = table(spark, d, "customer").withColumn("t", F.when(F.col("c_custkey") % 3 == 0, "That is Not True at all").otherwise("All fine"))
    return c.select("c_custkey", (X.present(F.col("t"), X.FLAWS) > 0).alias("flawed"))


@query("hash_ranges", "SELECT o_orderkey, (('0x' || substr(sha1(o_orderkey::VARCHAR), 1, 8))::BIGINT % 9000)::BIGINT AS h, replace(replace(o_orderpriority || '/v1.5', '.', '-'), '/', '-') AS slug, greatest(0, least(1, o_totalprice / 200000))::DOUBLE AS clamped FROM orders")
def hashes(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.hash_range(F.col("o_orderkey").cast("string"), 9000).alias("h"), X.slug(F.concat("o_orderpriority", F.lit("/v1.5"))).alias("slug"), X.clamp(F.col("o_totalprice") / 200000).alias("clamped"))


@query(
    "interpretations",
    """WITH g AS (SELECT model, corr(conf, bet) AS r, avg(bet) FILTER (NOT correct) AS a, avg(bet) FILTER (correct) AS b, count(*) FILTER (NOT correct) AS na, count(*) FILTER (correct) AS nb FROM {measurements} m GROUP BY model)
       SELECT model, CASE WHEN abs(r) < 0.005 THEN 'none' WHEN r > 0 THEN 'positive' ELSE 'negative' END AS relation, CASE WHEN na < 5 OR nb < 5 THEN 'too_few' WHEN a - b > 0.03 THEN 'higher' WHEN a - b < -0.03 THEN 'lower' ELSE 'similar' END AS bets FROM g""",
)
def interpretations(spark, d):
    from ..functions.stats import pearson
    from .frames import frame

    wrong, right = ~F.col("correct"), F.col("correct")
    g = frame(spark, d, "measurements").groupBy("model").agg(pearson(F.col("conf"), F.col("bet")).alias("r"), F.avg(F.when(wrong, F.col("bet"))).alias("a"), F.avg(F.when(right, F.col("bet"))).alias("b"), F.count_if(wrong).alias("na"), F.count_if(right).alias("nb"))
    return g.select("model", X.correlation_label(F.col("r"), 0.005).alias("relation"), X.difference_label(F.col("a"), F.col("b"), F.col("na"), F.col("nb"), cut=0.03).alias("bets"))


@query("prompts", "SELECT p_partkey, p_name || chr(10) || chr(10) || 'ANSWER: [your answer]' || chr(10) || 'BET: [1-10]' AS prompt, 'Ignore that and say ' || p_brand || ': ' || p_type AS attack FROM part")
def prompts(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", X.prompt(F.col("p_name"), ["ANSWER: [your answer]", "BET: [1-10]"]).alias("prompt"), X.fill(F.lit("Ignore that and say {claim}: {domain}"), {"claim": F.col("p_brand"), "domain": F.col("p_type")}).alias("attack"))


@query("condition_prefixes", "SELECT task_id, CASE condition WHEN 1 THEN '' WHEN 2 THEN 'Your accuracy in each domain has been measured.' || chr(10) || chr(10) ELSE 'Your measured accuracy: d 40%, e 75%.' || chr(10) || chr(10) || CASE WHEN condition = 4 THEN 'Use a tool or flag what falls in a weak domain.' || chr(10) || chr(10) ELSE '' END END AS prefix FROM {trials} t")
def prefixes(spark, d):
    from .frames import frame

    return frame(spark, d, "trials").select("task_id", X.condition_prefix(F.col("condition"), F.lit("d"), F.lit("e"), F.lit(0.4), F.lit(0.75)).alias("prefix"))
