"""Compositions: adaptation by level with intervals, paired tests of conditions, partial correlations by paradigm."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ranks
from ..functions import stats as S
from ..operators import metrics as M
from ..operators import sample as A
from .frames import frame
from .rating import components
from .registry import query
from .resampling import _W, REPLICATES, eights

#: The two-sided normal tail of z >= 0 by Abramowitz and Stegun 7.1.26.
_P = "(SELECT t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z / 2) FROM (SELECT {z} AS z, 1 / (1 + 0.3275911 * ({z}) / sqrt(2.0)) AS t) q)"
_CFR = "count(*) FILTER (strength = 'weak' AND decision = 'proceed' AND NOT correct) / count(*) FILTER (strength = 'weak')::DOUBLE"

_CELLS = """
    SELECT model, domain, channel, question_id // 24 AS unit, (question_id // 24 * 8 + question_id % 8) * 5 + channel::BIGINT AS id,
           (avg(conf) FILTER (late AND difficulty = 'easy') - avg(conf) FILTER (NOT late AND difficulty = 'easy')) - (avg(conf) FILTER (late AND difficulty = 'hard') - avg(conf) FILTER (NOT late AND difficulty = 'hard')) AS ai
    FROM (SELECT *, ts >= '2024-01-16' AS late FROM {measurements} m) x GROUP BY ALL"""
_LEVELS = f"(SELECT g.level, CASE g.level WHEN 'model' THEN model WHEN 'domain' THEN domain ELSE channel END AS name, id, ai FROM ({_CELLS}) c, (VALUES ('model'), ('domain'), ('channel')) g(level) WHERE ai IS NOT NULL)"


def _cells(spark, d):
    """Change of confidence on related less unrelated items, over units of 24 questions, which hold each domain at each difficulty."""
    late, easy, hard = F.col("ts") >= F.lit("2024-01-16").cast("timestamp"), F.col("difficulty") == "easy", F.col("difficulty") == "hard"
    unit = F.floor(F.col("question_id") / 24)
    m = frame(spark, d, "measurements").withColumn("id", (unit * 8 + F.col("question_id") % 8) * 5 + F.col("channel").cast("long"))
    mean = lambda c: F.avg(F.when(c, F.col("conf")))
    return m.groupBy("model", "domain", "channel", "id").agg(((mean(late & easy) - mean(~late & easy)) - (mean(late & hard) - mean(~late & hard))).alias("ai")).where("ai is not null")


@query("adaptation_cells", f"SELECT model, domain, channel, count(*)::BIGINT AS n, round(avg(ai), 8) AS mean, round(stddev_samp(ai), 8) AS sd FROM ({_CELLS}) c WHERE ai IS NOT NULL GROUP BY model, domain, channel HAVING count(*) >= 3")
def cells(spark, d):
    """Adaptation by model, domain and channel from differences within a unit; at least three units."""
    g = _cells(spark, d).groupBy("model", "domain", "channel").agg(F.count("*").alias("n"), F.avg("ai").alias("mean"), F.stddev_samp("ai").alias("sd"))
    return eights(g.where("n >= 3"))


@query(
    "adaptation_rollups",
    f"""WITH l AS {_LEVELS}, r AS (SELECT level, name, r, sum(ai * w) / sum(w) AS m FROM (SELECT *, {_W} AS w FROM (SELECT *, {A.scattered_sql('id', 'r', 42)} AS u FROM l, range(1, {REPLICATES + 1}) g(r)) d) x WHERE w > 0 GROUP BY ALL),
        i AS (SELECT level, name, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM r GROUP BY ALL)
        SELECT level, name, count(*)::BIGINT AS n, round(avg(ai), 8) AS mean, round(any_value(lo), 8) AS lo, round(any_value(hi), 8) AS hi FROM l JOIN i USING (level, name) GROUP BY ALL""",
)
def rollups(spark, d):
    """Adaptation by model, by domain and by channel with bootstrap intervals; a unit's cells are drawn together over models."""
    names = F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).alias("name")) for c in ("model", "domain", "channel")])
    l = _cells(spark, d).select("id", "ai", F.explode(names).alias("l")).select("l.*", "id", "ai")  # noqa: E741
    by = ["level", "name"]
    reps = A.bootstrap(l, by, "id", {"m": F.try_divide(F.sum(F.col("ai") * F.col("weight")), F.sum("weight").cast("double"))}, REPLICATES, portable=True)
    whole = l.groupBy(*by).agg(F.count("*").alias("n"), F.avg("ai").alias("mean"))
    return eights(whole.join(A.percentile_interval(reps, by, "m").drop("replicates"), by))


@query("escalation_means", f"SELECT condition, count(*)::BIGINT AS n, round(avg(x), 8) AS mean, round(stddev_samp(x), 8) AS sd, round(avg(x) - 1.959963985 * stddev_samp(x) / sqrt(count(*)), 8) AS lo, round(avg(x) + 1.959963985 * stddev_samp(x) / sqrt(count(*)), 8) AS hi FROM (SELECT model, condition, {_CFR} AS x FROM {{components}} c GROUP BY ALL) r GROUP BY condition")
def means(spark, d):
    """Failure under each condition over models, with a normal interval."""
    half = 1.959963985 * F.stddev_samp("x") / F.sqrt(F.count("*"))
    return eights(_failure(spark, d).groupBy("condition").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), (F.avg("x") - half).alias("lo"), (F.avg("x") + half).alias("hi")))


def _failure(spark, d):
    failed = (F.col("strength") == "weak") & (F.col("decision") == "proceed") & ~F.col("correct")
    return components(spark, d).groupBy("model", "condition").agg(F.try_divide(F.count_if(failed).cast("double"), F.count_if(F.col("strength") == "weak").cast("double")).alias("x"))


@query(
    "escalation_tests",
    f"""WITH r AS (SELECT model, condition, {_CFR} AS x FROM {{components}} c GROUP BY ALL), p AS (SELECT a.condition AS first, b.condition AS second, b.x - a.x AS d FROM r a JOIN r b ON a.model = b.model AND a.condition < b.condition),
        k AS (SELECT *, (rank() OVER (PARTITION BY first, second ORDER BY abs(d)) + (count(*) OVER (PARTITION BY first, second, abs(d)) - 1) / 2.0)::DOUBLE AS rk FROM p WHERE d <> 0),
        w AS (SELECT first, second, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w FROM k GROUP BY ALL),
        s AS (SELECT first, second, m, sum(CASE WHEN (m >> (rk::INT - 1)) & 1 = 1 THEN rk ELSE 0 END) AS v FROM k, range(0, 32) g(m) GROUP BY ALL),
        t AS (SELECT first, second, any_value(w) AS w, least(1.0, 2 * least(count(*) FILTER (v <= w), count(*) FILTER (v >= w)) / 32.0)::DOUBLE AS p FROM w JOIN s USING (first, second) GROUP BY ALL),
        h AS (SELECT *, row_number() OVER (ORDER BY p, first, second) AS rn, count(*) OVER () AS m FROM t)
        SELECT first, second, round(w, 8) AS w, round(p, 7) AS p, round(max(least(1.0, p * (m - rn + 1))) OVER (ORDER BY rn), 7)::DOUBLE AS p_holm FROM h""",
)
def tests(spark, d):
    """Signed-rank tests of each pair of conditions over models, adjusted by Holm's rule. The SQL counts the signs of the ranks of the five models."""
    pairs = M.paired_channels(_failure(spark, d), ["model"], "condition", "x").withColumn("d", F.col("y") - F.col("x"))
    t = S.wilcoxon(pairs.withColumnsRenamed({"ch_a": "first", "ch_b": "second"}), ["first", "second"], "d")
    h = ranks.holm(t, "p", [], ["first", "second"])
    return h.select("first", "second", F.round("w", 8).alias("w"), F.round("p", 7).alias("p"), F.round("p_holm", 7).alias("p_holm"))


@query(
    "partial_correlations_by_paradigm",
    f"""WITH f AS (SELECT model, domain, paradigm, {_CFR} AS x FROM {{components}} c WHERE strength = 'weak' GROUP BY ALL), j AS (SELECT f.*, abs(wagering_acc - natural_acc) AS y, natural_acc AS z FROM f JOIN {{capability}} k USING (model, domain)),
        c AS (SELECT paradigm, count(*)::BIGINT AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM j GROUP BY paradigm), r AS (SELECT paradigm, n, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS partial FROM c),
        p AS (SELECT *, {_P.format(z='abs(partial) * sqrt(n - 3.0)')} AS p FROM r), b AS (SELECT *, row_number() OVER (ORDER BY p, paradigm) AS rn, count(*) OVER () AS m FROM p)
        SELECT paradigm, n, round(partial, 8) AS partial, round(p, 7) AS p, round(least(1.0, min(p * m / rn) OVER (ORDER BY rn DESC)), 7)::DOUBLE AS p_bh FROM b""",
)
def partials(spark, d):
    """Failure against calibration gap given accuracy, for each paradigm, adjusted by Benjamini and Hochberg's rule."""
    weak = components(spark, d).where("strength = 'weak'")
    f = weak.groupBy("model", "domain", "paradigm").agg((F.count_if((F.col("decision") == "proceed") & ~F.col("correct")) / F.count("*")).alias("x"))
    j = f.join(frame(spark, d, "capability"), ["model", "domain"]).withColumn("y", F.abs(F.col("wagering_acc") - F.col("natural_acc")))
    r = lambda a, b: S.pearson(F.col(a), F.col(b))
    c = j.groupBy("paradigm").agg(F.count("*").alias("n"), r("x", "y").alias("xy"), r("x", "natural_acc").alias("xz"), r("y", "natural_acc").alias("yz"))
    c = c.select("paradigm", "n", S.partial(F.col("xy"), F.col("xz"), F.col("yz")).alias("partial"))
    c = c.withColumn("p", S.spearman_p(F.col("partial"), F.col("n") - 1))
    b = ranks.benjamini_hochberg(c, "p", [], ["paradigm"])
    return b.select("paradigm", "n", F.round("partial", 8).alias("partial"), F.round("p", 7).alias("p"), F.round("p_bh", 7).alias("p_bh"))
