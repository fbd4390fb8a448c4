"""Queries on ranks, multiple testing, quantiles and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ranks as K
from ..operators import metrics as M
from .frames import frame
from .joining import _RATERS, raters
from .rating import components, nines
from .registry import query

C = "{components}"


@query("average_ranks", "SELECT event_id, (rank() OVER (PARTITION BY model ORDER BY bet) + (count(*) OVER (PARTITION BY model, bet) - 1) / 2.0)::DOUBLE AS r FROM {measurements} m")
def ranks(spark, d):
    return K.average_ranks(frame(spark, d, "measurements").select("model", "bet", "event_id"), "bet", ["model"], "r").select("event_id", "r")


_TESTS = f"SELECT model, domain, avg(correct::INT) AS p FROM {C} c WHERE strength = 'weak' GROUP BY ALL"


def _tests(spark, d):
    return components(spark, d).where("strength = 'weak'").groupBy("model", "domain").agg(F.avg(F.col("correct").cast("int")).alias("p"))


@query("benjamini_hochberg", f"SELECT model, domain, round(least(min(p * n / rn) OVER (PARTITION BY model ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 9) AS p_bh FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p, domain) AS rn, count(*) OVER (PARTITION BY model) AS n FROM ({_TESTS}) t) x")
def bh(spark, d):
    return K.benjamini_hochberg(_tests(spark, d), "p", ["model"], ["domain"]).select("model", "domain", F.round("p_bh", 9).alias("p_bh"))


@query("fdr_reject", f"SELECT domain, model, least(min(p * n / rn) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) <= 0.58 AS reject FROM (SELECT *, row_number() OVER (ORDER BY p, model, domain) AS rn, count(*) OVER () AS n FROM ({_TESTS}) t) x")
def fdr(spark, d):
    return K.benjamini_hochberg(_tests(spark, d), "p", [], ["model", "domain"]).select("model", "domain", (F.col("p_bh") <= 0.58).alias("reject"))


@query("holm", f"SELECT model, domain, round(max(least(p / 50 * (n - rn + 1), 1)) OVER (PARTITION BY model ORDER BY rn), 9) AS p_holm FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p, domain) AS rn, count(*) OVER (PARTITION BY model) AS n FROM ({_TESTS}) t) x")
def holm(spark, d):
    t = _tests(spark, d).withColumn("p", F.col("p") / 50)
    return K.holm(t, "p", ["model"], ["domain"]).select("model", "domain", F.round("p_holm", 9).alias("p_holm"))


@query("top_share", "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY conf DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY model) AS n FROM {measurements} m) x WHERE rn <= round_even(0.15 * n, 0)")
def top(spark, d):
    m = frame(spark, d, "measurements").select("model", "event_id", "conf")
    return K.top_share(m, ["model"], "conf", "event_id", 0.15).where("top").select("event_id")


@query(
    "quantile_definitions",
    """SELECT model, round(linear, 9) AS linear, round(l[(round_even((n - 1) * 0.3::DOUBLE, 0))::INT + 1], 9) AS nearest, round(l[floor((n - 1) * 0.3::DOUBLE)::INT + 1], 9) AS lower, round(l[least(ceil(n * 0.3::DOUBLE), n)::INT], 9) AS upper
       FROM (SELECT model, quantile_cont(conf, 0.3) AS linear, list(conf ORDER BY conf) AS l, count(*) AS n FROM {measurements} m WHERE conf IS NOT NULL GROUP BY model) x""",
)
def quantiles(spark, d):
    return nines(K.quantile_table(frame(spark, d, "measurements"), ["model"], "conf", 0.3))


_POINTS = f"SELECT domain, model, avg((decision = 'proceed')::INT) AS autonomy, avg(correct::INT) AS success, avg(tokens) AS cost, CASE WHEN domain = 'd2' THEN NULL ELSE avg(hedges) END AS latency FROM {C} c GROUP BY domain, model"


@query("pareto_front", f"WITH p AS ({_POINTS}) SELECT model, domain FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.autonomy >= p.autonomy AND q.success >= p.success AND q.cost <= p.cost AND (q.latency IS NULL OR p.latency IS NULL OR q.latency <= p.latency) AND (q.autonomy > p.autonomy OR q.success > p.success OR q.cost < p.cost OR coalesce(q.latency < p.latency, false)))")
def pareto(spark, d):
    p = components(spark, d).groupBy("model", "domain").agg(F.avg((F.col("decision") == "proceed").cast("int")).alias("autonomy"), F.avg(F.col("correct").cast("int")).alias("success"), F.avg("tokens").alias("cost"), F.when(F.col("domain") != "d2", F.avg("hedges")).alias("latency"))
    return K.pareto_front(p, ["model", "domain"], ["autonomy", "success"], ["cost", "latency"]).select("model", "domain")


@query("majority_label", f"SELECT doc_id, label::INT AS majority, n::BIGINT AS votes FROM (SELECT doc_id, label, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(CASE rater WHEN 'quality' THEN 0 WHEN 'rule' THEN 1 ELSE 2 END)) AS rn FROM ({_RATERS}) r GROUP BY doc_id, label) x WHERE rn = 1")
def majority(spark, d):
    r = raters(spark, d).withColumn("seen", F.when(F.col("rater") == "quality", 0).when(F.col("rater") == "rule", 1).otherwise(2))
    return K.majority(r, ["doc_id"], "label", "seen")


@query("stated_rank_agreement", "WITH r AS (SELECT model, domain, row_number() OVER (PARTITION BY model ORDER BY natural_acc DESC, domain) AS a, row_number() OVER (PARTITION BY model ORDER BY wagering_acc DESC, domain) AS s FROM {capability} c) SELECT model, round(corr(a, s), 9) AS agreement FROM r GROUP BY model")
def stated(spark, d):
    from pyspark.sql import window as W

    w = W.Window.partitionBy("model")
    r = frame(spark, d, "capability").withColumn("a", F.row_number().over(w.orderBy(F.col("natural_acc").desc(), "domain"))).withColumn("s", F.row_number().over(w.orderBy(F.col("wagering_acc").desc(), "domain")))
    return nines(K.rank_agreement(r, ["model"], "s", "a"))


@query("demeaned", "SELECT event_id, round(conf - avg(conf) OVER (PARTITION BY model), 9) AS centred FROM {measurements} m WHERE channel = '3'")
def demeaned(spark, d):
    m = frame(spark, d, "measurements").where("channel = '3'")
    mean = m.groupBy("model").agg(F.avg("conf").alias("mean"))
    return m.join(mean, "model").select("event_id", F.round(F.col("conf") - F.col("mean"), 9).alias("centred"))


@query("ranking_list", "SELECT model, round(avg(conf), 9) AS score, (row_number() OVER (ORDER BY avg(conf) DESC, model))::BIGINT AS place FROM {measurements} m GROUP BY model")
def ranking(spark, d):
    from pyspark.sql import window as W

    g = frame(spark, d, "measurements").groupBy("model").agg(F.avg("conf").alias("score"))
    return g.select("model", F.round("score", 9).alias("score"), F.row_number().over(W.Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), "model")).cast("long").alias("place"))


@query("mean_of_group_aurocs", "SELECT round(avg(auroc), 8) AS mean, count(auroc)::BIGINT AS models FROM (SELECT model, sum(p * (below + n / 2.0)) / nullif(sum(p) * sum(n), 0) AS auroc FROM (SELECT model, bet, p, n, coalesce(sum(n) OVER (PARTITION BY model ORDER BY bet ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT model, bet, sum(correct::INT) AS p, sum((NOT correct)::INT) AS n FROM {measurements} m WHERE channel = '1' AND correct IS NOT NULL GROUP BY ALL) y) x GROUP BY model) z")
def mean_auroc(spark, d):
    m = frame(spark, d, "measurements").where("channel = '1'")
    return M.auroc(m, ["model"], "bet", "correct").agg(F.round(F.avg("auroc"), 8).alias("mean"), F.count("auroc").alias("models"))

