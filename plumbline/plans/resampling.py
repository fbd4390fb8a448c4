"""Queries on resampling, with draws that SQL can make too: scattered ids for weights, sha1 for orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rates as Q
from ..operators import sample as A
from .frames import frame
from .rating import components, nines
from .registry import query

REPLICATES = 1000
_W = "(" + " + ".join(f"(u >= {e!r}::DOUBLE)::INT" for e in A.poisson_edges()) + ")"
_REP = f"range(1, {REPLICATES + 1}) g(r)"


def _weighted(source: str, ident: str = "event_id") -> str:
    return f"(SELECT *, {_W} AS w FROM (SELECT *, {A.scattered_sql(ident, 'r', 42)} AS u FROM {source}, {_REP}) d)"


_ENDS = "round(quantile_cont({m}, 0.025), 8) AS lo, round(quantile_cont({m}, 0.975), 8) AS hi, count({m})::BIGINT AS replicates"


def eights(df):
    return df.select(*[F.round(c, 8).alias(c) if t == "double" else c for c, t in df.dtypes])


@query("bootstrap_mean", f"SELECT model, {_ENDS.format(m='m')} FROM (SELECT model, r, sum(conf * w) / sum(w) AS m FROM {_weighted('{measurements} m')} x GROUP BY ALL) y GROUP BY model")
def mean(spark, d):
    m = frame(spark, d, "measurements")
    reps = A.bootstrap(m, ["model"], "event_id", {"m": F.try_divide(F.sum(F.col("conf") * F.col("weight")), F.sum("weight").cast("double"))}, REPLICATES, portable=True)
    return eights(A.percentile_interval(reps, ["model"], "m"))


@query("bootstrap_bca")
def bca(spark, d):
    return nines(A.bca_interval(frame(spark, d, "measurements"), ["model"], "event_id", "conf", 200))


@query("bootstrap_correlation", f"SELECT model, {_ENDS.format(m='m')} FROM (SELECT model, r, (sum(w) * sum(w * conf * bet) - sum(w * conf) * sum(w * bet)) / sqrt((sum(w) * sum(w * conf * conf) - sum(w * conf) ** 2) * (sum(w) * sum(w * bet * bet) - sum(w * bet) ** 2)) AS m FROM {_weighted('{measurements} m')} x GROUP BY ALL) y GROUP BY model")
def correlation(spark, d):
    """Weighted sums of products give every replicate's Pearson r in one pass."""
    w, x, y = F.col("weight"), F.col("conf"), F.col("bet").cast("double")
    sums = {"n": F.sum(w), "sx": F.sum(w * x), "sy": F.sum(w * y), "sxx": F.sum(w * x * x), "syy": F.sum(w * y * y), "sxy": F.sum(w * x * y)}
    reps = A.bootstrap(frame(spark, d, "measurements"), ["model"], "event_id", sums, REPLICATES, portable=True)
    r = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt((F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy"))))
    return eights(A.percentile_interval(reps.withColumn("r", r), ["model"], "r"))


@query("bootstrap_slope", f"SELECT channel, round(quantile_cont(b, 0.025), 10) AS lo, round(quantile_cont(b, 0.975), 10) AS hi, count(b)::BIGINT AS replicates FROM (SELECT channel, r, (sum(w) * sum(w * length * conf) - sum(w * length) * sum(w * conf)) / (sum(w) * sum(w * length * length) - sum(w * length) ** 2) AS b FROM {_weighted('{measurements} m')} x GROUP BY ALL) y GROUP BY channel")
def slope(spark, d):
    w, x, y = F.col("weight"), F.col("length").cast("double"), F.col("conf")
    sums = {"n": F.sum(w), "sx": F.sum(w * x), "sy": F.sum(w * y), "sxx": F.sum(w * x * x), "sxy": F.sum(w * x * y)}
    reps = A.bootstrap(frame(spark, d, "measurements"), ["channel"], "event_id", sums, REPLICATES, portable=True)
    b = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    i = A.percentile_interval(reps.withColumn("b", b), ["channel"], "b")
    return i.select("channel", F.round("lo", 10).alias("lo"), F.round("hi", 10).alias("hi"), "replicates")


_SLOTTED = "(SELECT *, task_id || '|' || slot AS id FROM {components} c WHERE condition = 1)"


@query(
    "permutation_difference",
    f"""WITH c AS (SELECT model, id, tokens, strength = 'weak' AS w FROM {_SLOTTED} s), n AS (SELECT model, count(*) FILTER (w) AS k, avg(tokens) FILTER (w) - avg(tokens) FILTER (NOT w) AS observed FROM c GROUP BY model),
        d AS (SELECT model, r, tokens, row_number() OVER (PARTITION BY model, r ORDER BY sha1(id || '|' || r || '|42'), id) AS rn FROM c, range(1, 51) g(r)),
        e AS (SELECT model, r, avg(tokens) FILTER (rn <= k) - avg(tokens) FILTER (rn > k) AS d, any_value(observed) AS o FROM d JOIN n USING (model) GROUP BY model, r)
        SELECT model, round(any_value(o), 8) AS observed, count(*) FILTER (abs(d) >= abs(o)) / 50.0::DOUBLE AS p FROM e GROUP BY model""",
)
def permutation(spark, d):
    c = components(spark, d).where("condition = 1").withColumn("w", F.col("strength") == "weak").withColumn("id", F.concat_ws("|", F.col("task_id").cast("string"), "slot"))
    return eights(A.permutation_test(c, ["model"], "id", "tokens", "w", 50, portable=True))


@query(
    "label_flip_sensitivity",
    f"""WITH c AS (SELECT id, model, decision, correct FROM {_SLOTTED} s WHERE strength = 'weak'), f AS (SELECT id, r FROM (SELECT id, r, row_number() OVER (PARTITION BY r ORDER BY sha1(id || '|' || r || '|42'), id) AS rn FROM c, range(1, 51) g(r)) x WHERE rn <= 17),
        a AS (SELECT c.*, g.r, f.id IS NOT NULL AS flip FROM c CROSS JOIN range(1, 51) g(r) LEFT JOIN f ON f.id = c.id AND f.r = g.r),
        m AS (SELECT r, model, avg((decision = 'proceed' AND NOT (correct <> flip))::INT) AS cfr FROM a GROUP BY ALL), n AS (SELECT r, avg(cfr) AS cfr FROM m GROUP BY r)
        SELECT round(avg(cfr), 8) AS mean, round(stddev_samp(cfr), 8) AS sd, count(*)::BIGINT AS replicates FROM n""",
)
def flips(spark, d):
    c = components(spark, d).where("condition = 1 and strength = 'weak'").withColumn("id", F.concat_ws("|", F.col("task_id").cast("string"), "slot")).select("id", "model", "strength", "decision", "correct", "routed")
    per = A.label_flips(c, "id", "correct", 17, 50, portable=True).groupBy("replicate", "model").agg(Q.failure().alias("cfr"))
    means = per.groupBy("replicate").agg(F.avg("cfr").alias("mean_cfr"))
    return eights(means.agg(F.avg("mean_cfr").alias("mean"), F.stddev_samp("mean_cfr").alias("sd"), F.count("*").alias("replicates")))
