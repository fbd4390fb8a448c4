"""Queries on projections, filters and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reshape as R
from .frames import frame, table
from .registry import query

C = "{components}"


@query("unpivot_slots", f"SELECT model, slot, domain, count(*)::BIGINT AS n, sum(tokens)::BIGINT AS tokens FROM {C} c GROUP BY ALL")
def unpivot(spark, d):
    return R.unpivot_slots(frame(spark, d, "trials")).groupBy("model", "slot", "domain").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@query("trial_filter", f"SELECT task_id, slot, model, domain FROM {C} c WHERE condition = 1 AND paradigm IN (1, 2) AND circularity_free AND NOT false_score AND api_success")
def base_filter(spark, d):
    rows = frame(spark, d, "trials").where(R.trial_filter([1], [1, 2], True, False, success=True))
    return R.unpivot_slots(rows).select("task_id", "slot", "model", "domain")


_RAW = "CASE channel WHEN '1' THEN bet::DOUBLE WHEN '2' THEN CASE WHEN skipped THEN 0.0 ELSE 1.0 END WHEN '3' THEN CASE WHEN choice = 'A' THEN 1.0 ELSE 0.0 END WHEN '4' THEN 1.0 / (1 + n_tools) WHEN '5' THEN 1.0 / (1 + n_hedges) END"


@query(
    "channel_signals",
    f"""SELECT event_id, round(({_RAW})::DOUBLE, 9) AS raw, round((CASE channel WHEN '1' THEN (bet - 1) / 9.0 WHEN '2' THEN CASE WHEN skipped THEN 0.0 ELSE 1.0 END
        WHEN '3' THEN CASE WHEN choice = 'A' THEN 1.0 ELSE 0.0 END WHEN '4' THEN CASE WHEN n_tools > 0 THEN 0.5 ELSE 1.0 END WHEN '5' THEN greatest(0.0, 1 - n_hedges / 5.0) END)::DOUBLE, 9) AS unit FROM {{measurements}} m""",
)
def signals(spark, d):
    return frame(spark, d, "measurements").select("event_id", F.round(R.channel_signal(), 9).alias("raw"), F.round(R.channel_signal("unit"), 9).alias("unit"))


@query(
    "minmax_signals",
    f"""WITH s AS (SELECT model, channel, event_id, ({_RAW})::DOUBLE AS x FROM {{measurements}} m), e AS (SELECT model, channel, min(x) AS lo, max(x) AS hi FROM s GROUP BY ALL)
        SELECT event_id, round(CASE WHEN hi - lo < 1e-12 THEN 0.5 ELSE (x - lo) / (hi - lo) END, 9) AS scaled FROM s JOIN e USING (model, channel)""",
)
def minmaxed(spark, d):
    s = frame(spark, d, "measurements").select("model", "channel", "event_id", R.channel_signal().alias("x"))
    return R.minmax(s, "x", ["model", "channel"], "scaled").select("event_id", F.round("scaled", 9).alias("scaled"))


@query(
    "strength_classes",
    """SELECT model, domain, CASE WHEN natural_acc >= 0.46 THEN 'strong' WHEN natural_acc <= 0.44 THEN 'weak' ELSE 'medium' END AS strength, round(abs(wagering_acc - natural_acc)::DOUBLE, 9) AS gap FROM {capability} c""",
)
def strengths(spark, d):
    return frame(spark, d, "capability").select("model", "domain", R.strength(F.col("natural_acc"), 0.46, 0.44).alias("strength"), F.round(F.abs(F.col("wagering_acc") - F.col("natural_acc")).cast("double"), 9).alias("gap"))


@query(
    "patch_unknown_strength",
    f"""SELECT strength, count(*)::BIGINT AS n FROM (SELECT CASE WHEN strength <> 'unknown' THEN strength WHEN natural_acc >= 0.6 THEN 'strong' WHEN natural_acc <= 0.4 THEN 'weak' WHEN natural_acc IS NULL THEN 'unknown' ELSE 'medium' END AS strength
        FROM {C} c LEFT JOIN {{capability}} k USING (model, domain)) x GROUP BY strength""",
)
def patched(spark, d):
    return R.patch_strength(R.unpivot_slots(frame(spark, d, "trials")), frame(spark, d, "capability")).groupBy("strength").agg(F.count("*").alias("n"))


@query(
    "length_bins",
    """SELECT CASE WHEN length <= 0 THEN '0' WHEN length <= 200 THEN '1-200' WHEN length <= 500 THEN '201-500' WHEN length <= 1000 THEN '501-1000' WHEN length <= 2000 THEN '1001-2000' ELSE '2001+' END AS bin,
       count(*)::BIGINT AS n, count(*) FILTER (parse_success)::BIGINT AS observed FROM {measurements} m GROUP BY bin""",
)
def bins(spark, d):
    return frame(spark, d, "measurements").groupBy(R.length_bin(F.col("length")).alias("bin")).agg(F.count("*").alias("n"), F.count_if("parse_success").alias("observed"))


@query(
    "difficulty_buckets",
    """WITH q AS (SELECT question_id, avg(correct::INT) AS p FROM {measurements} m WHERE correct IS NOT NULL GROUP BY question_id)
       SELECT question_id, CASE WHEN p >= 0.5 THEN 'easy' WHEN p >= 0.2 THEN 'medium' ELSE 'hard' END AS bucket, round(p, 9) AS p FROM q""",
)
def buckets(spark, d):
    q = frame(spark, d, "measurements").groupBy("question_id").agg(F.avg(F.col("correct").cast("int")).alias("p")).where("p is not null")
    return q.select("question_id", R.difficulty_bin(F.col("p")).alias("bucket"), F.round("p", 9).alias("p"))


@query(
    "pair_strata",
    """SELECT CASE WHEN strength_a = 'weak' AND strength_b = 'weak' THEN 'weak_weak' WHEN strength_a <> 'weak' AND strength_b <> 'weak' THEN 'strong_strong' ELSE 'strong_weak' END AS stratum, count(*)::BIGINT AS n FROM {trials} t GROUP BY stratum""",
)
def strata(spark, d):
    return frame(spark, d, "trials").groupBy(R.pair_stratum(F.col("strength_a") == "weak", F.col("strength_b") == "weak").alias("stratum")).agg(F.count("*").alias("n"))


@query(
    "normalize_decisions",
    """SELECT CASE decision_a WHEN 'defer' THEN 'flag_for_review' WHEN 'use_tool' THEN 'use_tool' ELSE 'proceed' END AS decision, CASE decision_a WHEN 'defer' THEN '' WHEN 'use_tool' THEN '' ELSE 'PROCEED' END AS human, count(*)::BIGINT AS n FROM {trials} t GROUP BY ALL""",
)
def decisions(spark, d):
    spelled = F.when(F.col("decision_a") == "defer", " Human_Review").when(F.col("decision_a") == "use_tool", "DELEGATE ").otherwise("Proceed")
    return frame(spark, d, "trials").groupBy(R.normalize_decision(spelled).alias("decision"), R.normalize_decision(spelled, R.HUMAN_DECISIONS, F.lit("")).alias("human")).agg(F.count("*").alias("n"))


@query(
    "composite_score",
    f"""WITH c AS (SELECT * FROM {C} c WHERE paradigm = 3), e AS (SELECT model, min(hedges) AS hl, max(hedges) AS hh, min(decomps) AS dl, max(decomps) AS dh, min(tokens) AS tl, max(tokens) AS th FROM c GROUP BY model)
        SELECT task_id, slot, round((0.5 * (hedges - hl) / (hh - hl) + 0.3 * (decomps - dl) / (dh - dl) + 0.2 * (tokens - tl) / (th - tl))::DOUBLE, 9) AS score FROM c JOIN e USING (model)""",
)
def composites(spark, d):
    c = R.unpivot_slots(frame(spark, d, "trials").where("paradigm = 3"))
    for name in ("hedges", "decomps", "tokens"):
        c = R.minmax(c, name, ["model"], f"{name}_n", 0.0)
    return c.select("task_id", "slot", F.round(R.composite(F.col("hedges_n"), F.col("decomps_n"), F.col("tokens_n")), 9).alias("score"))


def _tasks(spark, d):
    t = frame(spark, d, "trials")
    return t.select(
        "task_id", "task_type", F.when(F.col("task_id") % 31 != 0, F.col("circularity_free")).alias("circularity_free"), "domain_a", "domain_b", F.when(F.col("task_id") % 7 == 0, "brutal").otherwise("easy").alias("difficulty_a"), F.lit("hard").alias("difficulty_b"),
        F.element_at(F.array(*map(F.lit, ("exact_numeric", "multiple_choice", "boolean", "short_text"))), (F.col("task_id") % 4 + 1).cast("int")).alias("answer_type_a"), F.lit("exact_numeric").alias("answer_type_b"),
        F.when(F.col("task_id") % 5 == 0, "A").when(F.col("task_id") % 5 == 1, "yes").when(F.col("task_id") % 5 == 2, "1,200").otherwise("").alias("answer_a"), F.when(F.col("task_id") % 6 == 0, "x").otherwise("7.5").alias("answer_b"),
        F.col("model").alias("task_text"), F.when(F.col("task_id") % 3 == 0, F.col("model")).alias("target_model"),
    )


@query(
    "task_issues",
    """WITH t AS (SELECT *, task_id % 5 AS m, task_id % 4 AS k FROM {trials} t), i AS (
        SELECT 'no_flag' AS issue FROM t WHERE task_id % 31 = 0 UNION ALL SELECT 'bad_domain_b' FROM t WHERE domain_b = '' UNION ALL SELECT 'bad_difficulty_a' FROM t WHERE task_id % 7 = 0
        UNION ALL SELECT 'no_answer_a' FROM t WHERE m > 2 UNION ALL SELECT 'not_a_letter_a' FROM t WHERE k = 1 AND m <> 0 UNION ALL SELECT 'not_boolean_a' FROM t WHERE k = 2 AND m <> 1
        UNION ALL SELECT 'not_numeric_a' FROM t WHERE k = 0 AND m <> 2 UNION ALL SELECT 'not_numeric_b' FROM t WHERE task_id % 6 = 0 UNION ALL SELECT 'no_target' FROM t WHERE task_type = 'tailored' AND task_id % 3 <> 0)
       SELECT issue, count(*)::BIGINT AS n FROM i GROUP BY issue""",
)
def task_issues(spark, d):
    return R.issue_counts(_tasks(spark, d), R.task_rules([f"d{i}" for i in range(8)]))


@query(
    "adaptive_thresholds",
    """WITH RECURSIVE l AS (SELECT model, 0.6::DOUBLE AS s, 0.4::DOUBLE AS w, false AS done FROM (SELECT DISTINCT model FROM {capability} c) m
        UNION ALL SELECT model, CASE WHEN ns < 2 THEN round(s - 0.05, 10) ELSE s END, CASE WHEN nw < 2 THEN round(w + 0.05, 10) ELSE w END, (ns >= 2 AND nw >= 2)
        FROM (SELECT l.*, (SELECT count(*) FROM {capability} c WHERE c.model = l.model AND natural_acc >= s) AS ns, (SELECT count(*) FROM {capability} c WHERE c.model = l.model AND natural_acc <= w) AS nw FROM l) x WHERE NOT done AND s > w)
       SELECT model, CASE WHEN done THEN s ELSE round(s + 0.05, 10) END AS strong_cut, CASE WHEN done THEN w ELSE round(w - 0.05, 10) END AS weak_cut FROM l WHERE done OR s <= w""",
)
def adaptive(spark, d):
    return R.adaptive_thresholds(frame(spark, d, "capability"))


@query("round_robin", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END AS sub FROM orders")
def robin(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.round_robin(["x", "y", "z"], F.col("o_orderkey")).alias("sub"))


@query("repair_monotone", "SELECT count(*) FILTER (correct_a)::BIGINT AS before, count(*) FILTER (correct_a OR correct_b)::BIGINT AS after FROM {trials} t")
def monotone(spark, d):
    t = frame(spark, d, "trials").withColumn("was", F.col("correct_a"))
    return R.repair_monotone(t).agg(F.count_if("was").alias("before"), F.count_if("correct_a").alias("after"))


@query(
    "verification_triage",
    """SELECT CASE WHEN a = 3 AND NOT b THEN 'PASS' WHEN a = 2 AND NOT b THEN 'PASS_WITH_NOTE' WHEN a >= 2 AND b THEN 'FLAG_AMBIGUOUS' ELSE 'FLAG_WRONG_ANSWER' END AS verdict, CASE WHEN s AND f = 'hard' THEN 'medium' WHEN s THEN 'easy' WHEN f = 'easy' THEN 'medium' ELSE 'hard' END AS difficulty, count(*)::BIGINT AS n
       FROM (SELECT question_id % 4 AS a, bool_or(refused) AS b, bool_and(correct) AS s, any_value(difficulty) AS f FROM {measurements} m WHERE correct IS NOT NULL GROUP BY question_id) q GROUP BY ALL""",
)
def triaged(spark, d):
    q = frame(spark, d, "measurements").where("correct is not null").groupBy("question_id").agg(F.bool_or("refused").alias("b"), F.bool_and("correct").alias("s"), F.any_value("difficulty").alias("f"))
    return q.groupBy(R.triage(F.col("question_id") % 4, F.col("b")).alias("verdict"), R.relabel_difficulty(F.col("s"), F.col("f")).alias("difficulty")).agg(F.count("*").alias("n"))


@query("eligible_tasks", "SELECT model, task_id FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY task_id) AS rn FROM {trials} t WHERE circularity_free AND (task_type = 'fixed' OR condition = 2)) x WHERE rn <= 20")
def eligible(spark, d):
    t = frame(spark, d, "trials").where("circularity_free and (task_type = 'fixed' or condition = 2)")
    return R.first_n(t, ["model"], ["task_id"], 20).select("model", "task_id")


@query(
    "audit_binarise",
    "SELECT doc_id, (abs(n_chars / 5000.0 - 0.5) >= 0.2) AS shifted, CASE WHEN quality IS NULL THEN NULL ELSE n_chars / 5000.0 - quality END::DOUBLE AS shift FROM {ratings} r",
)
def binarise(spark, d):
    r = frame(spark, d, "ratings")
    return r.select("doc_id", (F.abs(F.col("n_chars") / 5000.0 - 0.5) >= 0.2).alias("shifted"), (F.col("n_chars") / 5000.0 - F.col("quality")).alias("shift"))
