"""Queries on correlation, effect sizes, tests and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import metrics as M
from .frames import frame, table
from .joining import _RATERS, raters
from .rating import components, nines
from .registry import query

C = "{components}"
_RANK = "(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0)::DOUBLE"


def eights(df):
    return df.select(*[F.round(c, 8).alias(c) if t == "double" else c for c, t in df.dtypes])


@query("pearson_by_model", "SELECT model, round(corr(bet, correct::INT), 8) AS r, round(regr_slope(correct::INT, bet), 8) AS slope, count(*)::BIGINT AS n FROM {measurements} m WHERE correct IS NOT NULL GROUP BY model")
def pearson(spark, d):
    m = frame(spark, d, "measurements").where("correct is not null")
    y = F.col("correct").cast("int")
    return eights(m.groupBy("model").agg(S.pearson(F.col("bet"), y).alias("r"), S.slope(F.col("bet"), y).alias("slope"), F.count("*").alias("n")))


@query("spearman_by_model", f"SELECT model, round(corr(a, b), 8) AS rho, count(*)::BIGINT AS n FROM (SELECT model, {_RANK.format(by='model', x='length')} AS a, {_RANK.format(by='model', x='conf')} AS b FROM {{measurements}} m) x GROUP BY model")
def spearman(spark, d):
    return eights(S.spearman(frame(spark, d, "measurements"), ["model"], "length", "conf"))


_PHI = "CASE WHEN z >= 0 THEN 1 - phi ELSE phi END"
_TAIL = "(0.254829592 * t - 0.284496736 * t * t + 1.421413741 * t * t * t - 1.453152027 * t * t * t * t + 1.061405429 * t * t * t * t * t) * exp(-z * z / 2)"


@query(
    "spearman_p_values",
    f"SELECT model, round(2 * ({_TAIL}) / 2, 7) AS p FROM (SELECT model, abs(corr(a, b)) * sqrt(count(*) - 2.0) AS z, 1 / (1 + 0.3275911 * abs(corr(a, b)) * sqrt(count(*) - 2.0) / sqrt(2.0)) AS t FROM (SELECT model, {_RANK.format(by='model', x='length')} AS a, {_RANK.format(by='model', x='conf')} AS b FROM {{measurements}} m) x GROUP BY model) y",
)
def spearman_p(spark, d):
    s = S.spearman(frame(spark, d, "measurements"), ["model"], "length", "conf")
    return s.select("model", F.round(S.spearman_p(F.col("rho"), F.col("n")), 7).alias("p"))


@query("partial_correlation", "SELECT model, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 8) AS partial FROM (SELECT model, corr(bet, conf) AS xy, corr(bet, n_hedges) AS xz, corr(conf, n_hedges) AS yz FROM {measurements} m GROUP BY model) x")
def partial(spark, d):
    x = frame(spark, d, "measurements").groupBy("model").agg(S.pearson(F.col("bet"), F.col("conf")).alias("xy"), S.pearson(F.col("bet"), F.col("n_hedges")).alias("xz"), S.pearson(F.col("conf"), F.col("n_hedges")).alias("yz"))
    return x.select("model", F.round(S.partial(F.col("xy"), F.col("xz"), F.col("yz")), 8).alias("partial"))


@query(
    "kendall_tau",
    """WITH c AS (SELECT model, bet, n_hedges, count(*)::DOUBLE AS c FROM {measurements} m WHERE bet IS NOT NULL AND n_hedges IS NOT NULL GROUP BY model, bet, n_hedges)
       SELECT model, round(sum(a.c * b.c * sign(a.bet - b.bet) * sign(a.n_hedges - b.n_hedges)) / (sqrt(sum(a.c * b.c * (a.bet <> b.bet)::INT)) * sqrt(sum(a.c * b.c * (a.n_hedges <> b.n_hedges)::INT))), 8) AS tau
       FROM c a JOIN (SELECT model, bet, n_hedges, c FROM c) b USING (model) GROUP BY model""",
)
def kendall(spark, d):
    return eights(S.kendall_tau(frame(spark, d, "measurements"), ["model"], "bet", "n_hedges"))


@query("ols_by_channel", "SELECT channel, count(*)::BIGINT AS n, round(regr_slope(conf, length), 10) AS slope, round(regr_r2(conf, length), 8) AS r2, round(regr_intercept(conf, length), 8) AS intercept, round(sqrt((1 - regr_r2(conf, length)) * var_pop(conf) / (var_pop(length) * (count(*) - 2))), 10) AS se, round(regr_slope(conf, length) / sqrt((1 - regr_r2(conf, length)) * var_pop(conf) / (var_pop(length) * (count(*) - 2))), 6) AS t FROM {measurements} m GROUP BY channel")
def ols(spark, d):
    o = S.ols(frame(spark, d, "measurements"), ["channel"], "length", "conf")
    return o.select("channel", "n", F.round("slope", 10).alias("slope"), F.round("r2", 8).alias("r2"), F.round("intercept", 8).alias("intercept"), F.round("se", 10).alias("se"), F.round("t", 6).alias("t"))


@query("scaling_regressions", "SELECT metric, round(regr_slope(y, log2(x)), 8) AS slope, round(regr_r2(y, log2(x)), 8) AS r2 FROM (SELECT p_size AS x, 'price' AS metric, p_retailprice AS y FROM part UNION ALL SELECT p_size, 'key', p_partkey FROM part) s GROUP BY metric")
def scaling(spark, d):
    p = table(spark, d, "part")
    long = p.select(F.log2(F.col("p_size").cast("double")).alias("x"), F.explode(F.array(F.struct(F.lit("price").alias("metric"), F.col("p_retailprice").alias("y")), F.struct(F.lit("key").alias("metric"), F.col("p_partkey").cast("double").alias("y")))).alias("m")).select("x", "m.*")
    return S.ols(long, ["metric"], "x", "y").select("metric", F.round("slope", 8).alias("slope"), F.round("r2", 8).alias("r2"))


@query("residuals", "SELECT event_id, round(conf - (i + s * length), 8) AS residual FROM {measurements} m JOIN (SELECT channel, regr_slope(conf, length) AS s, regr_intercept(conf, length) AS i FROM {measurements} x GROUP BY channel) f USING (channel)")
def residuals(spark, d):
    m = frame(spark, d, "measurements")
    fit = S.ols(m, ["channel"], "length", "conf").select("channel", "slope", "intercept")
    return m.join(fit, "channel").select("event_id", F.round(F.col("conf") - (F.col("intercept") + F.col("slope") * F.col("length")), 8).alias("residual"))


@query("within_model_slope", "SELECT round(sum((length - ml) * (conf - mc)) / sum((length - ml) ** 2), 10) AS slope FROM (SELECT length, conf, avg(length) OVER (PARTITION BY model) AS ml, avg(conf) OVER (PARTITION BY model) AS mc FROM {measurements} m) x")
def within(spark, d):
    g = frame(spark, d, "measurements").groupBy("model").agg(F.count("*").alias("n"), F.covar_pop("length", "conf").alias("c"), F.var_pop("length").alias("v"))
    return g.agg(F.round(F.sum(F.col("n") * F.col("c")) / F.sum(F.col("n") * F.col("v")), 10).alias("slope"))


@query("cohens_d", f"SELECT model, round((avg(tokens) FILTER (w) - avg(tokens) FILTER (NOT w)) / sqrt(((count(*) FILTER (w) - 1) * var_samp(tokens) FILTER (w) + (count(*) FILTER (NOT w) - 1) * var_samp(tokens) FILTER (NOT w)) / (count(*) - 2)), 8) AS pooled, round((avg(tokens) FILTER (w) - avg(tokens) FILTER (NOT w)) / stddev_samp(tokens) FILTER (NOT w), 8) AS control FROM (SELECT model, tokens, strength = 'weak' AS w FROM {C} c WHERE strength IN ('weak', 'strong')) x GROUP BY model")
def effect(spark, d):
    c = components(spark, d).where("strength in ('weak', 'strong')")
    w = F.col("strength") == "weak"
    return eights(c.groupBy("model").agg(S.cohens_d(F.col("tokens"), w).alias("pooled"), S.cohens_d(F.col("tokens"), w, False).alias("control")))


_CFR = "count(*) FILTER (strength = 'weak' AND decision = 'proceed' AND NOT correct) / count(*) FILTER (strength = 'weak')::DOUBLE"


@query("paired_condition_effects", f"WITH r AS (SELECT model, condition, {_CFR} AS x FROM {C} c GROUP BY ALL) SELECT a.condition AS first, b.condition AS second, round(avg(b.x - a.x), 8) AS difference, round(avg(b.x - a.x) / stddev_samp(b.x - a.x), 8) AS d FROM r a JOIN r b ON a.model = b.model AND a.condition < b.condition GROUP BY ALL")
def paired(spark, d):
    r = components(spark, d).groupBy("model", "condition").agg((F.count_if((F.col("strength") == "weak") & (F.col("decision") == "proceed") & ~F.col("correct")) / F.count_if(F.col("strength") == "weak")).alias("x"))
    p = M.paired_channels(r, ["model"], "condition", "x").withColumn("diff", F.col("y") - F.col("x"))
    return p.groupBy(F.col("ch_a").alias("first"), F.col("ch_b").alias("second")).agg(F.round(F.avg("diff"), 8).alias("difference"), F.round(S.paired_d(F.col("diff")), 8).alias("d"))


@query("mann_whitney", f"SELECT model, (sum(r) FILTER (w) - count(*) FILTER (w) * (count(*) FILTER (w) + 1) / 2.0)::DOUBLE AS u FROM (SELECT model, strength = 'weak' AS w, {_RANK.format(by='model', x='tokens')} AS r FROM {C} c) x GROUP BY model")
def mann_whitney(spark, d):
    c = components(spark, d).withColumn("w", F.col("strength") == "weak")
    return S.mann_whitney(c, ["model"], "tokens", "w").select("model", "u")


@query("wilcoxon_signed_rank", f"WITH q AS (SELECT model, domain, avg(correct::INT) FILTER (condition = 1) - avg(correct::INT) FILTER (condition = 2) AS diff FROM {C} c GROUP BY ALL), r AS (SELECT *, {_RANK.format(by='model', x='abs(diff)')} AS r FROM q WHERE diff <> 0) SELECT model, sum(CASE WHEN diff > 0 THEN r ELSE 0 END)::DOUBLE AS w FROM r GROUP BY model")
def wilcoxon(spark, d):
    ok = F.col("correct").cast("int")
    q = components(spark, d).groupBy("model", "domain").agg((F.avg(F.when(F.col("condition") == 1, ok)) - F.avg(F.when(F.col("condition") == 2, ok))).alias("diff"))
    return S.wilcoxon(q, ["model"], "diff").select("model", "w")


@query("friedman", f"WITH x AS (SELECT model, condition, avg(correct::INT) AS v FROM {C} c GROUP BY ALL), r AS (SELECT condition, sum({_RANK.format(by='model', x='v').replace('::DOUBLE', '')}) OVER (PARTITION BY condition) AS s FROM x), s AS (SELECT condition, sum(r)::DOUBLE AS s FROM (SELECT condition, {_RANK.format(by='model', x='v')} AS r FROM x) y GROUP BY condition) SELECT round(sum(s * s) * 12.0 / (5 * 4 * 5) - 5 * 5 * 3.0, 8)::DOUBLE AS chi2, 5::BIGINT AS blocks, 4::BIGINT AS treatments FROM s".replace("r AS (SELECT condition, sum(" + _RANK.format(by="model", x="v").replace("::DOUBLE", "") + ") OVER (PARTITION BY condition) AS s FROM x), ", ""))
def friedman(spark, d):
    x = components(spark, d).groupBy("model", "condition").agg(F.avg(F.col("correct").cast("int")).alias("v"))
    return eights(S.friedman(x, "model", "condition", "v"))


@query("cohen_kappa", "WITH r AS (SELECT quality AS a, rule AS b FROM {ratings} r WHERE quality IS NOT NULL), n AS (SELECT count(*) AS n, avg((a = b)::INT) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM r) SELECT n::BIGINT AS n, round(po, 8) AS po, round(pe, 8) AS pe, round((po - pe) / (1 - pe), 8) AS kappa FROM n")
def kappa(spark, d):
    return eights(S.cohen_kappa(frame(spark, d, "ratings"), "quality", "rule"))


@query("fleiss_kappa", f"WITH c AS (SELECT doc_id, label, count(*) AS c FROM ({_RATERS}) r WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY ALL), i AS (SELECT doc_id, (sum(c * c) - 3) / 6.0 AS p FROM c GROUP BY doc_id), s AS (SELECT label, sum(c) / (3.0 * (SELECT count(*) FROM i)) AS q FROM c GROUP BY label) SELECT (SELECT count(*) FROM i)::BIGINT AS items, round((((SELECT avg(p) FROM i) - sum(q * q)) / (1 - sum(q * q)))::DOUBLE, 8) AS kappa FROM s")
def fleiss(spark, d):
    return eights(S.fleiss_kappa(raters(spark, d), "doc_id", "label"))


@query("wilson_intervals", "SELECT model, k, n, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 8)::DOUBLE AS lo, round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 8)::DOUBLE AS hi FROM (SELECT model, count(*) FILTER (correct)::BIGINT AS k, count(correct)::BIGINT AS n, avg(correct::INT)::DOUBLE AS p FROM {measurements} m GROUP BY model) x")
def wilson(spark, d):
    g = frame(spark, d, "measurements").groupBy("model").agg(F.count_if("correct").alias("k"), F.count("correct").alias("n"))
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return eights(g.select("model", "k", "n", lo.alias("lo"), hi.alias("hi")))


@query("chi_square", "WITH c AS (SELECT difficulty AS x, parse_success AS y, count(*) AS c FROM {measurements} m GROUP BY ALL), a AS (SELECT x, sum(c) AS cx FROM c GROUP BY x), b AS (SELECT y, sum(c) AS cy FROM c GROUP BY y), n AS (SELECT sum(c) AS n FROM c) SELECT any_value(n)::BIGINT AS n, round(sum((c - cx * cy / n) ** 2 / (cx * cy / n))::DOUBLE, 8) AS chi2, 2::BIGINT AS df FROM c JOIN a USING (x) JOIN b USING (y), n")
def chi2(spark, d):
    return eights(S.chi_square(frame(spark, d, "measurements"), "difficulty", "parse_success"))


@query("normal_quantiles", "SELECT k, round(q, 6)::DOUBLE AS q FROM (VALUES (5, -1.6448536), (16, -0.9944579), (25, -0.6744898), (50, 0.0), (84, 0.9944579), (95, 1.6448536), (99, 2.3263479), (1, -2.3263479)) v(k, q)")
def ppf(spark, d):
    k = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in (5, 16, 25, 50, 84, 95, 99, 1)])).alias("k"))
    return k.select("k", (F.round(S.normal_ppf(F.col("k") / 100.0), 6) + 0.0).alias("q"))


_PAIRS = "WITH q AS (SELECT model, question_id, channel, avg(conf) AS v FROM {measurements} m GROUP BY ALL), p AS (SELECT a.model, a.channel AS x, b.channel AS y, a.v AS u, b.v AS w FROM q a JOIN q b ON a.model = b.model AND a.question_id = b.question_id AND a.channel < b.channel), r AS (SELECT model, x, y, " + _RANK.format(by="model, x, y", x="u") + " AS ru, " + _RANK.format(by="model, x, y", x="w") + " AS rw FROM p), c AS (SELECT model, x, y, corr(ru, rw) AS rho FROM r GROUP BY ALL)"


def _pair_rho(spark, d):
    p = M.paired_channels(frame(spark, d, "measurements"), ["model", "question_id"], "channel", "conf")
    return S.spearman(p, ["model", "ch_a", "ch_b"], "x", "y")


@query("convergence_index", _PAIRS + " SELECT model, round(avg(rho), 8) AS mci, count(rho)::BIGINT AS pairs FROM c GROUP BY model")
def convergence(spark, d):
    return eights(_pair_rho(spark, d).groupBy("model").agg(F.avg("rho").alias("mci"), F.count("rho").alias("pairs")))


@query("dissociation_matrix", _PAIRS + " SELECT model, x AS ch_a, y AS ch_b, round(rho, 8) AS rho, abs(rho) < 0.1 AS dissociated FROM c UNION ALL SELECT model, y, x, round(rho, 8), abs(rho) < 0.1 FROM c UNION ALL SELECT DISTINCT model, channel, channel, 1.0, false FROM q")
def dissociation(spark, d):
    c = _pair_rho(spark, d).select("model", "ch_a", "ch_b", F.round("rho", 8).alias("rho"), (F.abs("rho") < 0.1).alias("dissociated"))
    mirrored = c.select("model", F.col("ch_b").alias("ch_a"), F.col("ch_a").alias("ch_b"), "rho", "dissociated")
    same = frame(spark, d, "measurements").select("model", F.col("channel").alias("ch_a"), F.col("channel").alias("ch_b"), F.lit(1.0).alias("rho"), F.lit(False).alias("dissociated")).distinct()
    return c.union(mirrored).union(same)


@query("leave_one_channel_out", _PAIRS + ", v AS (SELECT k AS left_out, model, avg(rho) AS mci FROM c, (VALUES ('0'), ('1'), ('2'), ('3'), ('4'), ('5')) g(k) WHERE x <> k AND y <> k GROUP BY ALL), z AS (SELECT model, mci AS whole FROM v WHERE left_out = '0') SELECT left_out, model, round(mci, 8) AS mci, sign(mci)::DOUBLE <> sign(whole)::DOUBLE AS sign_shift FROM v JOIN z USING (model)")
def leave_out(spark, d):
    c = _pair_rho(spark, d)
    v = c.select("*", F.explode(F.array(*[F.lit(str(k)) for k in range(6)])).alias("left_out")).where("ch_a <> left_out and ch_b <> left_out").groupBy("left_out", "model").agg(F.avg("rho").alias("mci"))
    z = v.where("left_out = '0'").select("model", F.col("mci").alias("whole"))
    return v.join(z, "model").select("left_out", "model", F.round("mci", 8).alias("mci"), (F.signum("mci") != F.signum("whole")).alias("sign_shift"))


@query("rank_correlation_of_models", f"WITH j AS (SELECT domain, a.natural_acc AS x, b.natural_acc AS y FROM {{capability}} a JOIN {{capability}} b USING (domain) WHERE a.model = '1-URGENT' AND b.model = '5-LOW') SELECT round(corr(rx, ry), 8) AS rho FROM (SELECT {_RANK.format(by='1', x='x')} AS rx, {_RANK.format(by='1', x='y')} AS ry FROM j) z")
def rank_corr(spark, d):
    c = frame(spark, d, "capability")
    a, b = c.where("model = '1-URGENT'").select("domain", F.col("natural_acc").alias("x")), c.where("model = '5-LOW'").select("domain", F.col("natural_acc").alias("y"))
    j = a.join(b, "domain").withColumn("g", F.lit(0))
    return S.spearman(j, ["g"], "x", "y").select(F.round("rho", 8).alias("rho"))


@query("cell_correlations", f"WITH f AS (SELECT model, domain, subcategory, {_CFR} AS x, avg(tokens) AS y FROM {C} c WHERE strength = 'weak' GROUP BY ALL), r AS (SELECT domain, subcategory, count(*)::BIGINT AS n, corr(x, y) AS r FROM f GROUP BY ALL) SELECT domain, subcategory, n, round(r, 8) AS r FROM r WHERE r IS NOT NULL AND NOT isnan(r)")
def cells(spark, d):
    weak = components(spark, d).where("strength = 'weak'")
    f = weak.groupBy("model", "domain", "subcategory").agg((F.count_if((F.col("decision") == "proceed") & ~F.col("correct")) / F.count("*")).alias("x"), F.avg("tokens").alias("y"))
    return eights(f.groupBy("domain", "subcategory").agg(F.count("*").alias("n"), S.pearson(F.col("x"), F.col("y"), 3).alias("r")).where("r is not null"))


@query("paradigm_convergence", f"WITH f AS (SELECT model, domain, paradigm, {_CFR} AS cfr FROM {C} c WHERE strength = 'weak' GROUP BY ALL) SELECT paradigm, round(corr(cfr, abs(wagering_acc - natural_acc)), 8) AS r, count(*)::BIGINT AS n FROM f JOIN {{capability}} k USING (model, domain) GROUP BY paradigm")
def paradigms(spark, d):
    weak = components(spark, d).where("strength = 'weak'")
    f = weak.groupBy("model", "domain", "paradigm").agg((F.count_if((F.col("decision") == "proceed") & ~F.col("correct")) / F.count("*")).alias("cfr")).join(frame(spark, d, "capability"), ["model", "domain"])
    return eights(f.groupBy("paradigm").agg(S.pearson(F.col("cfr"), F.abs(F.col("wagering_acc") - F.col("natural_acc"))).alias("r"), F.count("*").alias("n")))


@query("confidence_accuracy_by_channel", "SELECT model, round(avg(r), 8) AS r, count(r)::BIGINT AS channels FROM (SELECT model, channel, corr(conf, correct::INT) AS r FROM {measurements} m WHERE correct IS NOT NULL GROUP BY ALL HAVING count(*) >= 10) x GROUP BY model")
def c_mci(spark, d):
    m = frame(spark, d, "measurements")
    per = m.groupBy("model", "channel").agg(S.pearson(F.col("conf"), F.col("correct").cast("int"), 10).alias("r"))
    return eights(per.groupBy("model").agg(F.avg("r").alias("r"), F.count("r").alias("channels")))


@query("difficulty_adjusted_correlation", "WITH q AS (SELECT question_id, avg(correct::INT) AS z FROM {measurements} m WHERE correct IS NOT NULL GROUP BY question_id), c AS (SELECT model, corr(conf, bet) AS xy, corr(conf, z) AS xz, corr(bet, z) AS yz FROM {measurements} m JOIN q USING (question_id) GROUP BY model) SELECT model, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 8) AS r FROM c")
def adjusted(spark, d):
    m = frame(spark, d, "measurements")
    q = m.where("correct is not null").groupBy("question_id").agg(F.avg(F.col("correct").cast("int")).alias("z"))
    c = m.join(q, "question_id").groupBy("model").agg(S.pearson(F.col("conf"), F.col("bet")).alias("xy"), S.pearson(F.col("conf"), F.col("z")).alias("xz"), S.pearson(F.col("bet"), F.col("z")).alias("yz"))
    return c.select("model", F.round(S.partial(F.col("xy"), F.col("xz"), F.col("yz")), 8).alias("r"))



@query("mean_pairwise_pearson", "WITH q AS (SELECT model, question_id, channel, avg(conf) AS v FROM {measurements} m GROUP BY ALL), c AS (SELECT a.model, a.channel AS x, b.channel AS y, corr(a.v, b.v) AS r FROM q a JOIN q b ON a.model = b.model AND a.question_id = b.question_id AND a.channel < b.channel GROUP BY ALL HAVING count(*) >= 3) SELECT model, round(avg(r), 8) AS mci, count(r)::BIGINT AS pairs FROM c GROUP BY model")
def mean_pearson(spark, d):
    p = M.paired_channels(frame(spark, d, "measurements"), ["model", "question_id"], "channel", "conf")
    c = p.groupBy("model", "ch_a", "ch_b").agg(S.pearson(F.col("x"), F.col("y"), 3).alias("r"))
    return eights(c.groupBy("model").agg(F.avg("r").alias("mci"), F.count("r").alias("pairs")))


@query(
    "adjusted_convergence",
    """WITH z AS (SELECT question_id, avg(correct::INT) AS z FROM {measurements} m WHERE correct IS NOT NULL GROUP BY question_id), q AS (SELECT model, question_id, channel, avg(conf) AS v FROM {measurements} m GROUP BY ALL),
       p AS (SELECT a.model, a.channel AS x, b.channel AS y, a.v AS u, b.v AS w, z FROM q a JOIN q b ON a.model = b.model AND a.question_id = b.question_id AND a.channel < b.channel JOIN z ON z.question_id = a.question_id),
       r AS (SELECT model, x, y, """ + ", ".join(_RANK.format(by="model, x, y", x=c) + f" AS r{c}" for c in "uwz") + """ FROM p), c AS (SELECT model, x, y, corr(ru, rw) AS a, corr(ru, rz) AS b, corr(rw, rz) AS c FROM r GROUP BY ALL)
       SELECT model, round(avg((a - b * c) / sqrt((1 - b * b) * (1 - c * c))), 8) AS mci, count(*)::BIGINT AS pairs FROM c GROUP BY model""",
)
def adjusted_convergence(spark, d):
    """Partial rank correlations of channel pairs given the question's difficulty, averaged."""
    from ..functions.ranks import average_ranks

    m = frame(spark, d, "measurements")
    z = m.where("correct is not null").groupBy("question_id").agg(F.avg(F.col("correct").cast("int")).alias("z"))
    p = M.paired_channels(m, ["model", "question_id"], "channel", "conf").join(z, "question_id")
    by = ["model", "ch_a", "ch_b"]
    for c in ("x", "y", "z"):
        p = average_ranks(p, c, by, f"r{c}")
    r = lambda a, b: S.pearson(F.col(f"r{a}"), F.col(f"r{b}"), 3)
    c = p.groupBy(*by).agg(r("x", "y").alias("a"), r("x", "z").alias("b"), r("y", "z").alias("c"))
    c = c.select("model", S.partial(F.col("a"), F.col("b"), F.col("c")).alias("r"))
    return eights(c.groupBy("model").agg(F.avg("r").alias("mci"), F.count("r").alias("pairs")))


@query(
    "correlation_bundle",
    f"""WITH f AS (SELECT model, domain, {_CFR} AS cfr FROM {C} c WHERE strength = 'weak' GROUP BY ALL), j AS (SELECT f.*, abs(wagering_acc - natural_acc) AS gap, natural_acc AS acc FROM f JOIN {{capability}} k USING (model, domain)),
        r AS (SELECT *, {_RANK.format(by='1', x='cfr')} AS rc, {_RANK.format(by='1', x='gap')} AS rg, cfr - avg(cfr) OVER (PARTITION BY model) AS dc, gap - avg(gap) OVER (PARTITION BY model) AS dg FROM j), c AS (SELECT count(*)::BIGINT AS n, corr(cfr, gap) AS r, corr(rc, rg) AS rho, corr(cfr, acc) AS ca, corr(gap, acc) AS ga, corr(dc, dg) AS within FROM r)
        SELECT n, round(r, 8) AS r, round(rho, 8) AS rho, round((r - ca * ga) / sqrt((1 - ca * ca) * (1 - ga * ga)), 8) AS partial, round(within, 8) AS within FROM c""",
)
def bundle(spark, d):
    """Failure rate against calibration gap over (model, domain): Pearson, Spearman, partial given accuracy, and within models."""
    weak = components(spark, d).where("strength = 'weak'")
    f = weak.groupBy("model", "domain").agg((F.count_if((F.col("decision") == "proceed") & ~F.col("correct")) / F.count("*")).alias("cfr")).join(frame(spark, d, "capability"), ["model", "domain"])
    f = f.select("model", "cfr", F.abs(F.col("wagering_acc") - F.col("natural_acc")).alias("gap"), F.col("natural_acc").alias("acc"), F.lit(0).alias("g"))
    means = f.groupBy("model").agg(F.avg("cfr").alias("mc"), F.avg("gap").alias("mg"))
    c = f.join(means, "model").groupBy("g").agg(F.count("*").alias("n"), S.pearson(F.col("cfr"), F.col("gap")).alias("r"), S.pearson(F.col("cfr"), F.col("acc")).alias("ca"), S.pearson(F.col("gap"), F.col("acc")).alias("ga"), S.pearson(F.col("cfr") - F.col("mc"), F.col("gap") - F.col("mg")).alias("within"))
    rho = S.spearman(f, ["g"], "cfr", "gap").select("g", "rho")
    return eights(c.join(rho, "g").select("n", "r", "rho", S.partial(F.col("r"), F.col("ca"), F.col("ga")).alias("partial"), "within"))
