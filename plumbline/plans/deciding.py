"""Queries on weak sets, abstention policies and missing data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import policy as P
from ..operators import rates as Q
from .frames import frame
from .rating import components, nines
from .registry import query

C = "{components}"
K = "{capability} k"
_MEDIAN = f"(SELECT model, domain FROM (SELECT *, bool_or(t) OVER (PARTITION BY model) AS found FROM (SELECT model, domain, natural_acc < quantile_cont(natural_acc, 0.5) OVER (PARTITION BY model) AS t, row_number() OVER (PARTITION BY model ORDER BY natural_acc, domain) AS rn FROM {K}) a) b WHERE CASE WHEN found THEN t ELSE rn <= 2 END)"


@query("weak_bottom_k", f"SELECT model, domain FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY natural_acc, domain) AS rn FROM {K}) x WHERE rn <= 2")
def bottom(spark, d):
    return P.weak_sets(frame(spark, d, "capability"), "bottom")


@query("weak_median_split", f"SELECT model, domain FROM {_MEDIAN} m")
def median(spark, d):
    return P.weak_sets(frame(spark, d, "capability"), "median")


@query("weak_absolute", f"SELECT model, domain FROM (SELECT *, bool_or(natural_acc <= 0.44) OVER (PARTITION BY model) AS found, row_number() OVER (PARTITION BY model ORDER BY natural_acc, domain) AS rn FROM {K}) x WHERE CASE WHEN found THEN natural_acc <= 0.44 ELSE rn <= 2 END")
def absolute(spark, d):
    return P.weak_sets(frame(spark, d, "capability"), "absolute", cut=0.44)


@query("weak_quantile", f"SELECT model, domain FROM (SELECT *, list(natural_acc) OVER (PARTITION BY model ORDER BY natural_acc ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM {K}) x WHERE natural_acc <= l[floor((len(l) - 1) * 0.4::DOUBLE)::INT + 1]")
def quantile(spark, d):
    return P.weak_sets(frame(spark, d, "capability"), "quantile", q=0.4)


@query("weak_leave_one_out", f"SELECT model, held_out, domain FROM (SELECT a.model, b.domain AS held_out, a.domain, a.natural_acc < quantile_cont(a.natural_acc, 0.5) OVER (PARTITION BY a.model, b.domain) AS t FROM {K} JOIN {{capability}} a ON a.model = k.model JOIN {{capability}} b ON b.model = a.model AND b.domain = k.domain WHERE a.domain <> b.domain) x WHERE t")
def holdout(spark, d):
    return P.leave_one_out_sets(frame(spark, d, "capability"))


_MARKED = f"(SELECT c.*, m.domain IS NOT NULL AS weak FROM {C} c LEFT JOIN {_MEDIAN} m ON c.model = m.model AND c.domain = m.domain)"


def _marked(spark, d):
    return P.with_weak(components(spark, d), P.weak_sets(frame(spark, d, "capability"), "median"))


@query("weak_set_sensitivity", f"WITH s AS (SELECT 'median' AS rule, model, domain FROM {_MEDIAN} m UNION ALL SELECT 'bottom', model, domain FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY natural_acc, domain) AS rn FROM {K}) x WHERE rn <= 3) SELECT rule, condition, count(*)::BIGINT AS n, round(avg((decision = 'proceed' AND NOT correct)::INT), 9) AS cfr FROM {C} c JOIN s USING (model, domain) GROUP BY ALL")
def sensitivity(spark, d):
    cap = frame(spark, d, "capability")
    s = P.weak_sets(cap, "median").withColumn("rule", F.lit("median")).unionByName(P.weak_sets(cap, "bottom", 3).withColumn("rule", F.lit("bottom")))
    c = components(spark, d).join(s, ["model", "domain"])
    return nines(c.groupBy("rule", "condition").agg(F.count("*").alias("n"), F.avg((Q.PROCEED() & Q.WRONG()).cast("int")).alias("cfr")))


@query("hash_split", "SELECT task_id, (('0x' || substr(sha1(task_id::VARCHAR || '|a'), 1, 8))::BIGINT % 2)::INT AS half FROM {trials} t")
def split(spark, d):
    return frame(spark, d, "trials").select("task_id", P.hash_half(F.concat(F.col("task_id").cast("string"), F.lit("|a"))).alias("half"))


_RISK = f"(SELECT *, tokens + 211 * hedges AS risk, ('0x' || substr(sha1(task_id::VARCHAR || '|' || slot), 1, 8))::BIGINT % 2 AS half FROM {_MARKED} m)"


def _risk(spark, d):
    c = _marked(spark, d).withColumn("risk", F.col("tokens") + 211 * F.col("hedges"))
    return c.withColumn("half", P.hash_half(F.concat_ws("|", F.col("task_id").cast("string"), "slot")))


@query("conformal_threshold", f"WITH s AS (SELECT model, risk AS t, count(*) AS n, count(*) FILTER (NOT correct) AS w FROM {_RISK} r WHERE half = 0 GROUP BY ALL), c AS (SELECT model, t, sum(n) OVER p AS n, sum(w) OVER p AS w FROM s WINDOW p AS (PARTITION BY model ORDER BY t)) SELECT model, (max(t) FILTER (n >= 20 AND w <= n * 0.43))::INT::DOUBLE AS threshold FROM c GROUP BY model")
def conformal(spark, d):
    return P.conformal_threshold(_risk(spark, d).where("half = 0"), ["model"], "risk", "correct", 0.43).select("model", F.col("threshold").cast("double").alias("threshold"))


@query("budget_threshold", f"WITH s AS (SELECT model, risk AS t, count(*) AS n FROM {_RISK} r GROUP BY ALL), c AS (SELECT model, t, 1 - sum(n) OVER (PARTITION BY model ORDER BY t) / sum(n) OVER (PARTITION BY model)::DOUBLE AS rate FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY abs(rate - 0.3), t) AS rn FROM c) SELECT model, t::DOUBLE AS threshold, round(rate, 9) AS rate FROM r WHERE rn = 1")
def budget(spark, d):
    return nines(P.budget_threshold(_risk(spark, d), ["model"], "risk", 0.3))


@query(
    "autonomy_frontier",
    f"""WITH r AS (SELECT model, weak, correct, row_number() OVER (PARTITION BY model ORDER BY risk DESC, task_id * 2 + (slot = 'b')::INT DESC) AS rn, count(*) OVER (PARTITION BY model) AS n FROM {_RISK} r)
        SELECT model, a / 10.0::DOUBLE AS autonomy, round(count(*) FILTER (NOT correct AND rn > round_even((1 - a / 10.0::DOUBLE) * n, 0)) / count(*)::DOUBLE, 9) AS failure, round(count(*) FILTER (weak AND NOT correct AND rn > round_even((1 - a / 10.0::DOUBLE) * n, 0)) / count(*) FILTER (weak)::DOUBLE, 9) AS weak_failure
        FROM r, (VALUES (2), (4), (6), (8), (10)) g(a) GROUP BY model, a""",
)
def frontier(spark, d):
    r = _risk(spark, d).withColumn("id", F.col("task_id") * 2 + (F.col("slot") == "b").cast("int"))
    return nines(P.frontier(r, ["model"], "risk", "id", "correct", "weak", [a / 10 for a in (2, 4, 6, 8, 10)]))


@query(
    "strategy_comparison",
    f"""WITH c AS (SELECT * FROM {_RISK} r WHERE condition = 1), p AS (SELECT *, 'none' AS policy, false AS m FROM c UNION ALL SELECT *, 'domain', weak FROM c UNION ALL SELECT *, 'confidence', hedges >= 2 FROM c UNION ALL SELECT *, 'own', decision <> 'proceed' FROM c),
        e AS (SELECT model, policy, avg(m::INT) AS escalation, count(*) FILTER (weak AND NOT m AND NOT correct) / count(*) FILTER (weak)::DOUBLE AS weak_failure FROM p GROUP BY ALL)
        SELECT e.model, e.policy, round(e.escalation, 9) AS escalation, round(e.weak_failure, 9) AS weak_failure, round(n.weak_failure - e.weak_failure, 9) AS reduction FROM e JOIN e n ON n.model = e.model AND n.policy = 'none'""",
)
def strategies(spark, d):
    c = _risk(spark, d).where("condition = 1")
    masks = {"none": F.lit(False), "domain": F.col("weak"), "confidence": F.col("hedges") >= 2, "own": F.col("decision") != "proceed"}
    e = Q.compare(c, ["model"], masks, F.col("weak"), F.col("correct")).select("model", "policy", "escalation", "weak_failure")
    base = e.where("policy = 'none'").select("model", F.col("weak_failure").alias("base"))
    return nines(e.join(base, "model").withColumn("reduction", F.col("base") - F.col("weak_failure")).drop("base"))


@query("policy_frontier_points", f"WITH e AS (SELECT model, avg(correct::INT) AS s, avg((decision <> 'proceed')::INT) AS r FROM {C} c GROUP BY model) SELECT model, round(r * 0.3 + (1 - r) * 0.02, 9)::DOUBLE AS cost, round(r * 5200 + (1 - r) * 900, 6)::DOUBLE AS latency, round(s, 9) AS success FROM e")
def points(spark, d):
    e = components(spark, d).groupBy("model").agg(F.avg(F.col("correct").cast("int")).alias("s"), F.avg((~Q.PROCEED()).cast("int")).alias("r"))
    blend = lambda a, b: F.col("r") * a + (1 - F.col("r")) * b
    return e.select("model", F.round(blend(0.3, 0.02), 9).alias("cost"), F.round(blend(5200.0, 900.0), 6).alias("latency"), F.round("s", 9).alias("success"))


_OBS = "(SELECT *, CASE WHEN length <= 200 THEN 0 WHEN length <= 1000 THEN 1 ELSE 2 END AS bin FROM {measurements} m)"


def _obs(spark, d):
    return frame(spark, d, "measurements").withColumn("bin", F.when(F.col("length") <= 200, 0).when(F.col("length") <= 1000, 1).otherwise(2))


@query("missingness_by_keys", "SELECT model, channel, count(*)::BIGINT AS n, count(*) FILTER (NOT parse_success)::BIGINT AS missing, round(avg((NOT parse_success)::INT), 9) AS rate FROM {measurements} m GROUP BY ALL")
def missing(spark, d):
    return nines(P.missingness(frame(spark, d, "measurements"), ["model", "channel"], F.col("parse_success")))


@query(
    "weighted_accuracy_modes",
    f"""WITH p AS (SELECT bin, channel, avg(parse_success::INT) AS p FROM {_OBS} o GROUP BY ALL), j AS (SELECT o.*, least(1 / greatest(p, 1e-3), 20) AS w FROM {_OBS} o JOIN p USING (bin, channel))
        SELECT model, round(count(*) FILTER (parse_success AND NOT coalesce(correct, true)) / count(*) FILTER (parse_success)::DOUBLE, 9) AS complete, round(count(*) FILTER (NOT parse_success OR NOT coalesce(correct, true)) / count(*)::DOUBLE, 9) AS conservative,
               round(sum(w) FILTER (parse_success AND NOT coalesce(correct, true)) / sum(w) FILTER (parse_success), 8) AS ipw FROM j GROUP BY model""",
)
def modes(spark, d):
    m = P.propensity(_obs(spark, d), ["bin", "channel"], F.col("parse_success"))
    out = P.three_modes(m, ["model"], F.col("parse_success"), ~F.col("correct"), F.col("p_obs"))
    return out.select("model", F.round("complete", 9).alias("complete"), F.round("conservative", 9).alias("conservative"), F.round("ipw", 8).alias("ipw"))


@query(
    "weak_failure_modes",
    f"""WITH c AS (SELECT *, api_success AS obs, NOT correct AND NOT routed AS bad FROM {_MARKED} m WHERE weak), p AS (SELECT model, avg(obs::INT) AS p FROM c GROUP BY model), j AS (SELECT c.*, least(1 / greatest(p, 1e-3), 20) AS w FROM c JOIN p USING (model)),
        e AS (SELECT model, condition, count(*) FILTER (obs AND bad) / count(*) FILTER (obs)::DOUBLE AS complete, count(*) FILTER (NOT obs OR bad) / count(*)::DOUBLE AS conservative, sum(w) FILTER (obs AND bad) / sum(w) FILTER (obs) AS ipw FROM j GROUP BY ALL),
        l AS (SELECT 'complete' AS mode, a.complete AS a, b.complete AS b FROM e a JOIN e b ON a.model = b.model AND a.condition = 1 AND b.condition = 4 UNION ALL SELECT 'conservative', a.conservative, b.conservative FROM e a JOIN e b ON a.model = b.model AND a.condition = 1 AND b.condition = 4
              UNION ALL SELECT 'ipw', a.ipw, b.ipw FROM e a JOIN e b ON a.model = b.model AND a.condition = 1 AND b.condition = 4)
        SELECT mode, round(avg(a), 8) AS c_first, round(avg(b), 8) AS c_second, round(avg((a - b) / a), 8) AS reduction, count(a)::BIGINT AS groups FROM l GROUP BY mode""",
)
def weak_modes(spark, d):
    c = P.propensity(_marked(spark, d).where("weak"), ["model"], F.col("api_success"))
    e = P.three_modes(c, ["model", "condition"], F.col("api_success"), ~F.col("correct") & ~F.col("routed"), F.col("p_obs"))
    r = P.condition_reduction(e, ["complete", "conservative", "ipw"])
    return r.select("mode", *[F.round(x, 8).alias(x) for x in ("c_first", "c_second", "reduction")], "groups")


_BOUNDS = f"SELECT model, condition, h / (n + 0.5 * m) AS lower, (h + 0.5 * m) / (n + 0.5 * m) AS upper FROM (SELECT model, condition, count(*) FILTER (api_success AND NOT correct AND NOT routed)::DOUBLE AS h, count(*) FILTER (api_success)::DOUBLE AS n, count(*) FILTER (NOT api_success)::DOUBLE AS m FROM {_MARKED} m WHERE weak GROUP BY ALL) x"


def _bounds(spark, d):
    return P.mnar_bounds(_marked(spark, d).where("weak"), ["model", "condition"], F.col("api_success"), ~F.col("correct") & ~F.col("routed"))


@query("mnar_bounds", f"SELECT model, condition, round(lower, 9) AS lower, round(upper, 9) AS upper FROM ({_BOUNDS}) b")
def mnar(spark, d):
    return nines(_bounds(spark, d))


@query("mnar_reduction", f"WITH b AS ({_BOUNDS}) SELECT a.model, round((a.lower - b.upper) / a.lower, 9) AS worst, round((a.upper - b.lower) / a.upper, 9) AS best FROM b a JOIN b ON a.model = b.model AND a.condition = 1 AND b.condition = 4")
def mnar_fall(spark, d):
    return nines(P.reduction_bounds(_bounds(spark, d)))


@query("logistic_missingness")
def logistic(spark, d):
    m = _obs(spark, d).withColumn("failed", ~F.col("parse_success"))
    beta = P.logistic(m, ["bin", "n_hedges", "bet"], "failed")
    rows = [F.struct(F.lit(n).alias("term"), F.lit(round(float(b), 6)).alias("coefficient")) for n, b in zip(("intercept", "bin", "n_hedges", "bet"), beta)]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query(
    "missingness_odds",
    """WITH c AS (SELECT channel, count(*) FILTER (NOT parse_success)::DOUBLE AS m, count(*) FILTER (parse_success)::DOUBLE AS o FROM {measurements} x GROUP BY channel), b AS (SELECT ln(m / o) AS base FROM c WHERE channel = '1'),
       a AS (SELECT sum(x.m * y.o * CASE WHEN x.m / x.o > y.m / y.o THEN 1 WHEN x.m / x.o = y.m / y.o THEN 0.5 ELSE 0 END) / sum(x.m * y.o) AS auc FROM c x, c y),
       t AS (SELECT CASE channel WHEN '1' THEN 'intercept' ELSE 'channel=' || channel END AS term, ln(m / o) - CASE channel WHEN '1' THEN 0 ELSE base END AS k FROM c, b)
       SELECT term, round(k, 4) AS coefficient, round(exp(k), 4) AS odds_ratio, round(auc, 4) AS auc FROM t, a""",
)
def odds(spark, d):
    """With one column the fit has a closed form, which the SQL states."""
    m = P.missingness_model(frame(spark, d, "measurements"), ["channel"], F.col("parse_success"))
    return m.select("term", *[F.round(c, 4).alias(c) for c in ("coefficient", "odds_ratio", "auc")])


@query("platt_calibration")
def platt(spark, d):
    """Score calibrated on the hashed half, judged on the other."""
    r = _risk(spark, d).withColumn("x", F.col("risk") / 633.0).withColumn("wrong", ~F.col("correct"))
    beta = P.logistic(r.where("half = 0"), ["x"], "wrong")
    p = 1 / (1 + F.exp(-(F.col("x") * float(beta[1]) + float(beta[0]))))
    held = r.where("half = 1").withColumn("p", p)
    return nines(held.groupBy("model").agg(M.brier(F.col("p"), F.col("wrong")).alias("brier"), F.avg("p").alias("mean_p"), F.avg(F.col("wrong").cast("int")).alias("rate")))




@query(
    "budget_matched_strategies",
    f"""WITH c AS (SELECT * FROM {_MARKED} m WHERE condition = 1 AND paradigm IN (1, 2) AND circularity_free), e AS (SELECT model, min(hedges) AS hl, max(hedges) AS hh, min(decomps) AS dl, max(decomps) AS dh, min(tokens) AS tl, max(tokens) AS th FROM c GROUP BY model),
        s AS (SELECT c.*, 0.5::DOUBLE * ((hedges - hl) / (hh - hl)::DOUBLE) + 0.3::DOUBLE * ((decomps - dl) / (dh - dl)::DOUBLE) + 0.2::DOUBLE * ((tokens - tl) / (th - tl)::DOUBLE) AS u, task_id * 2 + (slot = 'b')::INT AS id FROM c JOIN e USING (model)),
        r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY u DESC, id DESC) AS rn, avg(weak::INT) OVER (PARTITION BY model) * count(*) OVER (PARTITION BY model) AS k FROM s),
        p AS (SELECT *, 'none' AS policy, false AS m FROM r UNION ALL SELECT *, 'domain', weak FROM r UNION ALL SELECT *, 'confidence', rn <= round_even(k, 0) FROM r),
        v AS (SELECT model, policy, avg(m::INT) AS escalation, avg((NOT m AND NOT correct)::INT) AS failure, count(*) FILTER (weak AND NOT m AND NOT correct) / count(*) FILTER (weak)::DOUBLE AS weak_failure FROM p GROUP BY ALL)
        SELECT v.model, v.policy, round(v.escalation, 9) AS escalation, round(v.failure, 9) AS failure, round(v.weak_failure, 9) AS weak_failure, round((n.weak_failure - v.weak_failure) / n.weak_failure, 9) AS reduction FROM v JOIN v n ON n.model = v.model AND n.policy = 'none'""",
)
def budget_matched(spark, d):
    """Signals, scaled and weighted into an uncertainty; its riskiest rows escalated as often as the weak domains are; against doing nothing."""
    from ..functions.ranks import top_share
    from ..operators import reshape as R

    c = _marked(spark, d).where(R.trial_filter([1], [1, 2]))
    for name in ("hedges", "decomps", "tokens"):
        c = R.minmax(c, name, ["model"], f"{name}_n", 0.0)
    c = c.withColumn("u", R.composite(F.col("hedges_n"), F.col("decomps_n"), F.col("tokens_n"))).withColumn("id", F.col("task_id") * 2 + (F.col("slot") == "b").cast("int"))
    rate = c.groupBy("model").agg(F.avg(F.col("weak").cast("int")).alias("rate"))
    c = top_share(c.join(rate, "model"), ["model"], "u", "id", F.col("rate"))
    v = Q.compare(c, ["model"], {"none": F.lit(False), "domain": F.col("weak"), "confidence": F.col("top")}, F.col("weak"), F.col("correct"))
    base = v.where("policy = 'none'").select("model", F.col("weak_failure").alias("base"))
    return nines(v.join(base, "model").select("model", "policy", "escalation", "failure", "weak_failure", P.reduction(F.col("base"), F.col("weak_failure")).alias("reduction")))
