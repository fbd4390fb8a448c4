"""Queries on failure rates, routing and escalation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rates as Q
from ..operators import reshape as R
from .frames import frame
from .registry import query

C = "{components}"
_CFR = "count(*) FILTER (strength = 'weak' AND decision = 'proceed' AND NOT correct) / nullif(count(*) FILTER (strength = 'weak'), 0)::DOUBLE"
_UDR = "count(*) FILTER (strength = 'strong' AND decision <> 'proceed' AND correct) / nullif(count(*) FILTER (strength = 'strong'), 0)::DOUBLE"


def components(spark, d, *where):
    t = frame(spark, d, "trials")
    for w in where:
        t = t.where(w)
    return R.unpivot_slots(t)


def nines(df):
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes])


@query("failure_by_subcategory", f"SELECT model, domain, subcategory, count(*)::BIGINT AS n, round({_CFR}, 9) AS cfr, round({_UDR}, 9) AS udr FROM {C} c WHERE circularity_free AND condition = 1 GROUP BY ALL")
def by_subcategory(spark, d):
    return nines(Q.failure_rates(components(spark, d, R.trial_filter([1])), ["model", "domain", "subcategory"]))


@query("failure_by_model", f"SELECT model, count(*)::BIGINT AS n, round({_CFR}, 9) AS cfr, round({_UDR}, 9) AS udr FROM {C} c WHERE circularity_free AND condition = 1 AND paradigm IN (1, 2) GROUP BY ALL")
def by_model(spark, d):
    return nines(Q.failure_rates(components(spark, d, R.trial_filter([1], [1, 2])), ["model"]))


@query(
    "failure_definitions",
    f"""SELECT model, round({_CFR}, 9) AS proceed, round(count(*) FILTER (strength = 'weak' AND NOT routed AND NOT correct) / count(*) FILTER (strength = 'weak')::DOUBLE, 9) AS unrouted,
        round(count(*) FILTER (decision = 'proceed' AND NOT correct) / count(*)::DOUBLE, 9) AS autonomous FROM {C} c GROUP BY model""",
)
def definitions(spark, d):
    return nines(components(spark, d).groupBy("model").agg(*[Q.failure(k).alias(k) for k in ("proceed", "unrouted", "autonomous")]))


@query("oracle_failure", f"SELECT model, round(count(*) FILTER (strength = 'weak' AND natural_acc >= 0.45 AND NOT correct) / count(*) FILTER (strength = 'weak')::DOUBLE, 9) AS oracle_cfr, round(count(*) FILTER (strength = 'strong' AND natural_acc < 0.45 AND correct) / count(*) FILTER (strength = 'strong')::DOUBLE, 9) AS oracle_udr FROM {C} c JOIN {{capability}} k USING (model, domain) GROUP BY model")
def oracle(spark, d):
    c = components(spark, d).join(frame(spark, d, "capability"), ["model", "domain"])
    c = c.withColumn("decision", F.when(F.col("natural_acc") < 0.45, "defer").otherwise("proceed"))
    return nines(c.groupBy("model").agg(Q.failure().alias("oracle_cfr"), Q.deferral().alias("oracle_udr")))


@query(
    "routing_comparison",
    f"""WITH c AS (SELECT c.model, decision = 'proceed' AND NOT correct AS bad, natural_acc, abs(wagering_acc - natural_acc) AS gap FROM {C} c LEFT JOIN {{capability}} k ON k.model = c.model AND k.domain = c.domain AND k.domain <> 'd1' WHERE strength = 'weak'),
        p AS (SELECT *, 'none' AS policy, false AS m FROM c UNION ALL SELECT *, 'accuracy', coalesce(natural_acc < 0.46, true) FROM c UNION ALL SELECT *, 'gap', coalesce(gap > 0.08, true) FROM c UNION ALL SELECT *, 'oracle', coalesce(natural_acc < 0.5, true) FROM c)
        SELECT model, policy, count(*)::BIGINT AS n, round(avg((bad AND NOT m)::INT), 9) AS cfr FROM p GROUP BY model, policy""",
)
def routing(spark, d):
    cap = frame(spark, d, "capability").where("domain <> 'd1'").withColumn("gap", F.abs(F.col("wagering_acc") - F.col("natural_acc")))
    c = components(spark, d).join(cap, ["model", "domain"], "left")
    return nines(Q.routing(c, ["model"], Q.policies(accuracy_cut=0.46, gap_cut=0.08)))


@query(
    "knowledge_deferral_index",
    f"""WITH f AS (SELECT model, domain, subcategory, {_CFR} AS cfr FROM {C} c GROUP BY ALL), k AS (SELECT f.model, abs(wagering_acc - natural_acc) - (1 - cfr) AS kdi FROM f JOIN {{capability}} x USING (model, domain) WHERE cfr IS NOT NULL)
        SELECT model, round(avg(kdi), 8) AS mean, round(quantile_cont(kdi, 0.5), 8) AS median, round(avg((kdi > 0.2)::INT), 8) AS above FROM k GROUP BY model""",
)
def kdi(spark, d):
    f = Q.failure_rates(components(spark, d), ["model", "domain", "subcategory"]).where("cfr is not null").join(frame(spark, d, "capability"), ["model", "domain"])
    k = f.withColumn("kdi", F.abs(F.col("wagering_acc") - F.col("natural_acc")) - (1 - F.col("cfr")))
    return k.groupBy("model").agg(F.round(F.avg("kdi"), 8).alias("mean"), F.round(F.percentile("kdi", F.lit(0.5)), 8).alias("median"), F.round(F.avg((F.col("kdi") > 0.2).cast("int")), 8).alias("above"))


@query(
    "behaviour_by_strength",
    f"SELECT model, domain, round(avg(hedges) FILTER (strength = 'weak'), 9) AS weak_hedges, round(avg(hedges) FILTER (strength = 'strong'), 9) AS strong_hedges, round(avg(decomps) FILTER (strength = 'weak'), 9) AS weak_decomps, round(avg(tokens) FILTER (strength = 'weak') / avg(tokens) FILTER (strength = 'strong'), 9) AS token_ratio, round(avg((error = 'overconfident_precise')::INT) FILTER (strength = 'weak'), 9) AS overconfident FROM {C} c WHERE paradigm = 3 AND condition = 1 AND circularity_free GROUP BY model, domain",
)
def behaviour(spark, d):
    c = components(spark, d, R.trial_filter([1], [3]))
    mean = lambda x, w: F.avg(F.when(w, F.col(x)))
    sure = F.avg(F.when(Q.WEAK(), (F.col("error") == "overconfident_precise").cast("int")))
    return nines(c.groupBy("model", "domain").agg(mean("hedges", Q.WEAK()).alias("weak_hedges"), mean("hedges", Q.STRONG()).alias("strong_hedges"), mean("decomps", Q.WEAK()).alias("weak_decomps"), F.try_divide(mean("tokens", Q.WEAK()), mean("tokens", Q.STRONG())).alias("token_ratio"), sure.alias("overconfident")))


@query("escalation_curve", f"SELECT condition, round(avg(cfr), 9) AS mean_cfr, round(stddev_samp(cfr), 9) AS sd, count(cfr)::BIGINT AS models FROM (SELECT model, condition, {_CFR} AS cfr FROM {C} c WHERE circularity_free GROUP BY ALL) x GROUP BY condition")
def curve(spark, d):
    return nines(Q.escalation_curve(components(spark, d, "circularity_free")))


@query("failure_breakdown", f"SELECT domain, task_type, error, count(*)::BIGINT AS n, round({_CFR}, 9) AS cfr FROM {C} c WHERE condition = 4 GROUP BY GROUPING SETS ((domain), (task_type), (error))")
def breakdown(spark, d):
    c = components(spark, d, "condition = 4")
    g = c.groupingSets([["domain"], ["task_type"], ["error"]], "domain", "task_type", "error").agg(F.count("*").alias("n"), Q.failure().alias("cfr"))
    return nines(g.select("domain", "task_type", "error", "n", "cfr"))


@query("deferral_breakdown", f"SELECT model, paradigm::VARCHAR AS paradigm, domain, count(*)::BIGINT AS n, round(avg((decision <> 'proceed')::INT), 9) AS deferral FROM {C} c WHERE condition = 4 GROUP BY GROUPING SETS ((model), (paradigm), (domain))")
def deferrals(spark, d):
    c = components(spark, d, "condition = 4")
    g = c.groupingSets([["model"], ["paradigm"], ["domain"]], "model", "paradigm", "domain").agg(F.count("*").alias("n"), F.avg((~Q.PROCEED()).cast("int")).alias("deferral"))
    return nines(g.select("model", F.col("paradigm").cast("string").alias("paradigm"), "domain", "n", "deferral"))


@query(
    "false_score_control",
    f"SELECT model, round(r, 9) AS real, round(f, 9) AS false_, CASE WHEN r IS NULL OR f IS NULL THEN 'INSUFFICIENT_DATA' WHEN f > r + 0.10 THEN 'A_PROCESSES_SCORES' WHEN abs(f - r) <= 0.05 THEN 'B_IGNORES_CONTEXT' WHEN f < r - 0.10 THEN 'C_WORSENED' ELSE 'D_AMBIGUOUS' END AS finding FROM (SELECT model, avg((decision <> 'proceed')::INT) FILTER (NOT false_score) AS r, avg((decision <> 'proceed')::INT) FILTER (false_score) AS f FROM {C} c WHERE condition = 2 AND strength = 'weak' GROUP BY model) x",
)
def control(spark, d):
    defer = (~Q.PROCEED()).cast("int")
    x = components(spark, d, "condition = 2").where(Q.WEAK()).groupBy("model").agg(F.avg(F.when(~F.col("false_score"), defer)).alias("real"), F.avg(F.when(F.col("false_score"), defer)).alias("false_"))
    return x.select("model", F.round("real", 9).alias("real"), F.round("false_", 9).alias("false_"), Q.control_finding(F.col("real"), F.col("false_")).alias("finding"))


@query("data_quality", "SELECT model, count(*)::BIGINT AS n, round(avg((NOT api_success)::INT), 9) AS failed, CASE WHEN avg((NOT api_success)::INT) >= 0.3 THEN 'partial' WHEN avg((NOT api_success)::INT) >= 0.1 THEN 'acceptable' ELSE 'clean' END AS status FROM {trials} t GROUP BY model")
def quality(spark, d):
    bad = F.avg((~F.col("api_success")).cast("int"))
    return frame(spark, d, "trials").groupBy("model").agg(F.count("*").alias("n"), F.round(bad, 9).alias("failed"), Q.quality_status(bad).alias("status"))


@query("task_distribution", f"SELECT domain, subcategory, count(DISTINCT task_id)::BIGINT AS tasks, count(DISTINCT task_id) < 500 AS thin FROM {C} c GROUP BY ALL")
def distribution(spark, d):
    return components(spark, d).groupBy("domain", "subcategory").agg(F.count_distinct("task_id").alias("tasks"), (F.count_distinct("task_id") < 500).alias("thin"))


@query(
    "error_type_failure",
    f"WITH t AS (SELECT model, domain, count(*) AS total FROM {C} c WHERE strength = 'weak' GROUP BY ALL) SELECT model, domain, error, count(*)::BIGINT AS n, round(count(*) / any_value(total)::DOUBLE, 9) AS rate FROM {C} c JOIN t USING (model, domain) WHERE strength = 'weak' AND decision = 'proceed' AND NOT correct GROUP BY model, domain, error",
)
def error_types(spark, d):
    weak = components(spark, d).where(Q.WEAK())
    total = weak.groupBy("model", "domain").agg(F.count("*").alias("total"))
    per = weak.where(Q.PROCEED() & Q.WRONG()).groupBy("model", "domain", "error").agg(F.count("*").alias("n"))
    return per.join(total, ["model", "domain"]).select("model", "domain", "error", "n", F.round(F.col("n") / F.col("total"), 9).alias("rate"))


# a task has one condition here, so the counterpart under condition 1 is that of the same model, domain, slot and paradigm
_KEY = "model, domain, slot, paradigm"
_TRADE = f"""WITH four AS (SELECT * FROM {C} c WHERE condition = 4 AND NOT false_score AND strength <> 'unknown'), one AS (SELECT {_KEY}, arg_min(correct, task_id) AS was FROM {C} c WHERE condition = 1 AND NOT false_score AND domain <> 'd2' GROUP BY ALL),
        j AS (SELECT four.*, was, decision <> 'proceed' OR routed AS esc FROM four LEFT JOIN one USING ({_KEY})),
        m AS (SELECT model, count(*) FILTER (strength = 'weak')::BIGINT AS n_weak, count(*) FILTER (strength = 'weak' AND esc)::BIGINT AS n_escalated, count(*) FILTER (strength = 'weak' AND esc AND was IS NULL)::BIGINT AS n_unknown,
              count(*) FILTER (strength = 'weak' AND esc AND NOT was)::DOUBLE AS needed, count(*) FILTER (strength = 'weak' AND esc AND was)::DOUBLE AS needless, avg(correct::INT) FILTER (strength = 'weak') AS weak_accuracy_4, avg(correct::INT) FILTER (strength = 'weak' AND NOT esc) AS kept_success,
              avg((decision <> 'proceed' AND coalesce(was, false))::INT) FILTER (strength = 'strong') AS strong_udr, avg(correct::INT) FILTER (strength = 'strong') AS strong_accuracy, avg(correct::INT) FILTER (strength <> 'weak' OR NOT esc) AS autonomous_accuracy FROM j GROUP BY model),
        t AS (SELECT *, n_escalated / n_weak AS escalation, needed / (needed + needless) AS right_escalation, needless / (needed + needless) AS false_escalation, needless / (needed + needless) AS weak_accuracy_1, 1 - n_escalated / n_weak AS autonomy, 100 * needed / n_weak AS prevented, 100 * needless / n_weak AS blocked, 100 * (needed - needless) / n_weak AS utility FROM m)"""


def _tradeoff(spark, d):
    key = ["model", "domain", "slot", "paradigm"]
    c = components(spark, d, "not false_score")
    one = c.where("condition = 1 and domain <> 'd2'").groupBy(*key).agg(F.min_by("correct", "task_id").alias("correct"))
    return Q.tradeoff(c.where("condition = 4"), one, key)


_RATES = ("escalation", "right_escalation", "false_escalation", "weak_accuracy_1", "weak_accuracy_4", "kept_success", "autonomy", "prevented", "blocked", "utility", "strong_udr", "strong_accuracy", "autonomous_accuracy")


@query("escalation_tradeoff", _TRADE + " SELECT model, n_weak, n_escalated, n_unknown, " + ", ".join(f"round({c}, 9) AS {c}" for c in _RATES) + " FROM t")
def tradeoff(spark, d):
    return nines(_tradeoff(spark, d))


@query("tradeoff_summary", _TRADE + ", l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS measure, {c} AS v FROM t" for c in _RATES) + ") SELECT measure, round(avg(v), 9) AS mean, round(min(v), 9) AS lo, round(max(v), 9) AS hi, count(v)::BIGINT AS n FROM l GROUP BY measure")
def tradeoffs(spark, d):
    return nines(Q.summarize(_tradeoff(spark, d), list(_RATES)))


@query("utility_table", f"SELECT condition, round(avg(autonomy), 9) AS autonomy, round(avg(success), 9) AS success, round(avg(failure), 9) AS failure FROM (SELECT model, condition, avg((decision = 'proceed')::INT) AS autonomy, avg((decision <> 'proceed' OR correct)::INT) AS success, avg((decision = 'proceed' AND NOT correct)::INT) AS failure FROM {C} c GROUP BY ALL) x GROUP BY condition")
def utility(spark, d):
    per = components(spark, d).groupBy("model", "condition").agg(F.avg(Q.PROCEED().cast("int")).alias("autonomy"), F.avg((~Q.PROCEED() | F.col("correct")).cast("int")).alias("success"), Q.failure("autonomous").alias("failure"))
    return nines(per.groupBy("condition").agg(*[F.avg(c).alias(c) for c in ("autonomy", "success", "failure")]))


@query("provider_failure", f"SELECT CASE WHEN model LIKE '%URGENT' OR model LIKE '%HIGH' THEN 'first' ELSE 'second' END AS provider, round(avg(cfr), 9) AS mean_cfr, count(*)::BIGINT AS models FROM (SELECT model, {_CFR} AS cfr FROM {C} c GROUP BY model) x GROUP BY provider")
def providers(spark, d):
    per = components(spark, d).groupBy("model").agg(Q.failure().alias("cfr"))
    provider = F.when(F.col("model").endswith("URGENT") | F.col("model").endswith("HIGH"), "first").otherwise("second")
    return nines(per.groupBy(provider.alias("provider")).agg(F.avg("cfr").alias("mean_cfr"), F.count("*").alias("models")))


@query("resolver_sensitivity", f"SELECT q / 100.0::DOUBLE AS q, condition, count(*)::BIGINT AS n, round(avg((NOT routed)::INT), 9) AS autonomy, round(avg(correct::INT) FILTER (NOT routed), 9) AS autonomous_correct, round(avg(CASE WHEN routed THEN q / 100.0::DOUBLE ELSE correct::INT END), 9) AS success, round(avg(CASE WHEN routed THEN 1 - q / 100.0::DOUBLE ELSE (NOT correct)::INT END) FILTER (strength = 'weak'), 9) AS weak_failure FROM {C} c, (VALUES (50), (60), (70), (80), (90), (100)) g(q) GROUP BY q, condition")
def resolver(spark, d):
    return nines(Q.resolver_quality(components(spark, d), ["condition"], [q / 100 for q in (50, 60, 70, 80, 90, 100)], Q.WEAK()))


@query("packet_metrics", """WITH o AS (SELECT request_id, arg_max(final_correct, l_linenumber * 1000000000000 + l_partkey * 10000 + l_suppkey) AS ok FROM {outcomes} o GROUP BY request_id), c AS (SELECT request_id, max(cost) AS cost, max(latency) AS latency FROM {costs} c GROUP BY request_id)
    SELECT risk_tier, count(*)::BIGINT AS n, round(avg((model_decision = 'ESCALATE')::INT), 9) AS escalation, round(avg(ok::INT), 9) AS accuracy, round(avg(cost), 8) AS cost, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95, quantile_cont(latency, 0.95) <= 1400 AND avg(cost) <= 6 AS within
    FROM {requests} r JOIN o USING (request_id) JOIN c USING (request_id) GROUP BY risk_tier""")
def packet(spark, d):
    order = F.col("l_linenumber") * F.lit(1000000000000) + F.col("l_partkey") * 10000 + F.col("l_suppkey")
    o = frame(spark, d, "outcomes").groupBy("request_id").agg(F.max_by("final_correct", order).alias("ok"))
    c = frame(spark, d, "costs").groupBy("request_id").agg(F.max("cost").alias("cost"), F.max("latency").alias("latency"))
    p95 = F.percentile("latency", F.lit(0.95))
    return frame(spark, d, "requests").join(o, "request_id").join(c, "request_id").groupBy("risk_tier").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("model_decision") == "ESCALATE").cast("int")), 9).alias("escalation"), F.round(F.avg(F.col("ok").cast("int")), 9).alias("accuracy"), F.round(F.avg("cost"), 8).alias("cost"),
        F.round(F.percentile("latency", F.lit(0.5)), 6).alias("p50"), F.round(p95, 6).alias("p95"), ((p95 <= 1400) & (F.avg("cost") <= 6)).alias("within"),
    )


@query("provenance_counts", "SELECT p_brand, p_type, p_size::VARCHAR AS p_size, count(*)::BIGINT AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), (p_size))")
def provenance(spark, d):
    from .frames import table

    return table(spark, d, "part").groupingSets([["p_brand"], ["p_type"], ["p_size"]], "p_brand", "p_type", "p_size").agg(F.count("*").alias("n")).select("p_brand", "p_type", F.col("p_size").cast("string").alias("p_size"), "n")


@query("pass_rates", "SELECT t / 100.0::DOUBLE AS level, round(avg((acc > t / 100.0)::INT), 9) AS pass_rate FROM (SELECT natural_acc AS acc FROM {capability} c) x, (VALUES (40), (45), (50)) g(t) GROUP BY t")
def pass_rates(spark, d):
    grid = F.explode(F.array(*[F.lit(t / 100) for t in (40, 45, 50)]))
    x = frame(spark, d, "capability").select("natural_acc", grid.alias("level"))
    return x.groupBy("level").agg(F.round(F.avg((F.col("natural_acc") > F.col("level")).cast("int")), 9).alias("pass_rate"))


@query("capability_profile", "SELECT model, coalesce(string_agg(domain, ',' ORDER BY domain) FILTER (natural_acc >= 0.46), '') AS strong, coalesce(string_agg(domain, ',' ORDER BY domain) FILTER (natural_acc <= 0.44), '') AS weak FROM {capability} c GROUP BY model")
def profile(spark, d):
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("domain")))), ",")
    return frame(spark, d, "capability").groupBy("model").agg(names(F.col("natural_acc") >= 0.46).alias("strong"), names(F.col("natural_acc") <= 0.44).alias("weak"))
