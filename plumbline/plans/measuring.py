"""Queries on calibration and accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import reshape as R
from .frames import frame
from .registry import query

_KNOWN = "{measurements} m WHERE correct IS NOT NULL"
_ECE = "SELECT {by}, sum(abs(y - c)) / sum(n) AS ece FROM (SELECT {by}, least(floor(conf * 10), 9) AS b, count(*) AS n, sum(conf) AS c, sum(correct::INT) AS y FROM {k} GROUP BY ALL) x GROUP BY {by}"
_AUC = """SELECT {by}, sum(p * (below + n / 2.0)) / nullif(sum(p) * sum(n), 0) AS auroc FROM (SELECT {by}, conf, p, n, coalesce(sum(n) OVER (PARTITION BY {by} ORDER BY conf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
          FROM (SELECT {by}, conf, sum(correct::INT) AS p, sum((NOT correct)::INT) AS n FROM {k} GROUP BY ALL) y) x GROUP BY {by}"""
_BASE = """SELECT {by}, count(*)::BIGINT AS n, avg(correct::INT) AS accuracy, avg(pow(conf - correct::INT, 2)) AS brier,
           avg(CASE WHEN correct THEN -ln(greatest(least(conf, 1 - 1e-6), 1e-6)) ELSE -ln(1 - greatest(least(conf, 1 - 1e-6), 1e-6)) END) AS log_score, avg(conf) - avg(correct::INT) AS overconfidence FROM {k} GROUP BY {by}"""


def _bundle_sql(by: str) -> str:
    parts = [x.replace("{by}", by).replace("{k}", _KNOWN) for x in (_BASE, _ECE, _AUC)]
    numbers = ", ".join(f"round({c}::DOUBLE, 8) AS {c}" for c in ("accuracy", "brier", "log_score", "overconfidence", "ece", "auroc"))
    return f"SELECT {by}, n, {numbers} FROM ({parts[0]}) a JOIN ({parts[1]}) b USING ({by}) JOIN ({parts[2]}) c USING ({by})"


def _rounded(df, by):
    return df.select(*[F.round(c, 8).alias(c) if t == "double" else c for c, t in df.dtypes])


@query("calibration_bundle", _bundle_sql("model"))
def bundle(spark, d):
    return _rounded(M.calibration_bundle(frame(spark, d, "measurements"), ["model"]), ["model"])


@query("calibration_by_domain", _bundle_sql("model, domain").replace("USING (model, domain)", "USING (model, domain)"))
def by_domain(spark, d):
    return _rounded(M.calibration_bundle(frame(spark, d, "measurements"), ["model", "domain"]), ["model", "domain"])


@query(
    "accuracy_by_channel",
    f"""SELECT model, domain, round(avg(correct::INT) FILTER (channel = '1'), 9) AS c1, round(avg(correct::INT) FILTER (channel = '2'), 9) AS c2, round(avg(correct::INT) FILTER (channel = '3'), 9) AS c3,
        round(avg(correct::INT) FILTER (channel = '4'), 9) AS c4, round(avg(correct::INT) FILTER (channel = '5'), 9) AS c5 FROM {_KNOWN} GROUP BY model, domain""",
)
def pivoted(spark, d):
    m = frame(spark, d, "measurements")
    wide = m.where("correct is not null").groupBy("model", "domain").pivot("channel", ["1", "2", "3", "4", "5"]).agg(M.accuracy(F.col("correct")))
    return wide.select("model", "domain", *[F.round(str(i), 9).alias(f"c{i}") for i in range(1, 6)])


@query("ece_rescaled", "SELECT model, round(sum(abs(y - c)) / sum(n), 9) AS ece FROM (SELECT model, least(floor(x * 10), 9) AS b, count(*) AS n, sum(x) AS c, sum(correct::INT) AS y FROM (SELECT model, correct, CASE WHEN bet * 10 > 1 THEN bet * 10 / 100.0 ELSE bet * 10 END::DOUBLE AS x FROM {measurements} m WHERE correct IS NOT NULL AND channel = '1') z GROUP BY ALL) x GROUP BY model")
def rescaled(spark, d):
    m = frame(spark, d, "measurements").where("channel = '1'").withColumn("x", F.col("bet") * 10.0)
    return M.ece(m, ["model"], "x", "correct", rescale=True).select("model", F.round("ece", 9).alias("ece"))


@query("roc_points", f"SELECT model, bet, sum(p) OVER w::BIGINT AS tp, sum(n) OVER w::BIGINT AS fp FROM (SELECT model, bet, count(*) FILTER (correct) AS p, count(*) FILTER (NOT correct) AS n FROM {_KNOWN} GROUP BY ALL) x WINDOW w AS (PARTITION BY model ORDER BY bet DESC)")
def roc(spark, d):
    return M.roc_points(frame(spark, d, "measurements"), ["model"], "bet", "correct")


@query(
    "metric_tree",
    f"""SELECT model, CASE WHEN grouping(domain) = 1 THEN 'overall' ELSE domain END AS domain, count(*)::BIGINT AS n, round(avg(correct::INT), 9) AS accuracy, round(avg(pow(conf - correct::INT, 2)), 9) AS brier FROM {_KNOWN} GROUP BY GROUPING SETS ((model), (model, domain))""",
)
def tree(spark, d):
    m = frame(spark, d, "measurements").where("correct is not null")
    g = m.groupingSets([["model"], ["model", "domain"]], "model", "domain").agg(F.grouping("domain").alias("g"), F.count("*").alias("n"), M.accuracy(F.col("correct")).alias("accuracy"), M.brier(F.col("conf"), F.col("correct")).alias("brier"))
    return g.select("model", F.when(F.col("g") == 1, "overall").otherwise(F.col("domain")).alias("domain"), "n", F.round("accuracy", 9).alias("accuracy"), F.round("brier", 9).alias("brier"))


@query(
    "skip_error_alignment",
    """WITH s AS (SELECT DISTINCT model, question_id FROM {measurements} m WHERE channel = '2' AND skipped)
       SELECT n.model, count(*)::BIGINT AS n, round(avg((NOT correct)::INT), 9) AS error_rate FROM {measurements} n SEMI JOIN s ON n.model = s.model AND n.question_id = s.question_id WHERE channel = '5' AND correct IS NOT NULL GROUP BY n.model""",
)
def skip_alignment(spark, d):
    m = frame(spark, d, "measurements")
    skipped = m.where("channel = '2' and skipped").select("model", "question_id")
    return m.where("channel = '5' and correct is not null").join(skipped, ["model", "question_id"], "left_semi").groupBy("model").agg(F.count("*").alias("n"), F.round(1 - M.accuracy(F.col("correct")), 9).alias("error_rate"))


@query(
    "hallucination_bets",
    f"""SELECT model, domain, count(*) FILTER (bet >= 7 AND NOT correct)::BIGINT AS hallucinated, round(count(*) FILTER (bet >= 7 AND NOT correct) / count(*) FILTER (bet >= 7)::DOUBLE, 9) AS rate,
        round(avg(bet) FILTER (correct), 9) AS bet_right, round(avg(bet) FILTER (NOT correct), 9) AS bet_wrong FROM {_KNOWN} AND channel = '1' GROUP BY ALL""",
)
def hallucinations(spark, d):
    m = frame(spark, d, "measurements").where("channel = '1' and correct is not null")
    bad = F.count_if((F.col("bet") >= 7) & ~F.col("correct"))
    return m.groupBy("model", "domain").agg(
        bad.alias("hallucinated"), F.round(F.try_divide(bad.cast("double"), F.count_if(F.col("bet") >= 7).cast("double")), 9).alias("rate"),
        F.round(F.avg(F.when(F.col("correct"), F.col("bet"))), 9).alias("bet_right"), F.round(F.avg(F.when(~F.col("correct"), F.col("bet"))), 9).alias("bet_wrong"),
    )


@query(
    "hedge_odds_ratio",
    f"SELECT model, round(a * d / nullif(b * c, 0)::DOUBLE, 9) AS odds_ratio FROM (SELECT model, count(*) FILTER (n_hedges > 0 AND NOT correct) AS a, count(*) FILTER (n_hedges > 0 AND correct) AS b, count(*) FILTER (n_hedges = 0 AND NOT correct) AS c, count(*) FILTER (n_hedges = 0 AND correct) AS d FROM {_KNOWN} GROUP BY model) x",
)
def odds(spark, d):
    m = frame(spark, d, "measurements").where("correct is not null")
    h, y = F.col("n_hedges") > 0, F.col("correct")
    n = m.groupBy("model").agg(F.count_if(h & ~y).alias("a"), F.count_if(h & y).alias("b"), F.count_if(~h & ~y).alias("c"), F.count_if(~h & y).alias("d"))
    return n.select("model", F.round(M.odds_ratio(F.col("a"), F.col("b"), F.col("c"), F.col("d")), 9).alias("odds_ratio"))


@query(
    "parse_failures",
    "SELECT model, channel, count(*)::BIGINT AS n, round(avg((NOT parse_success)::INT), 9) AS fail_rate, round(avg(refused::INT), 9) AS refusal_rate, avg((NOT parse_success)::INT) > 0.15 AS flagged FROM {measurements} m GROUP BY model, channel",
)
def parse_failures(spark, d):
    fail = F.avg(M.as_number(~F.col("parse_success")))
    return frame(spark, d, "measurements").groupBy("model", "channel").agg(F.count("*").alias("n"), F.round(fail, 9).alias("fail_rate"), F.round(F.avg(M.as_number(F.col("refused"))), 9).alias("refusal_rate"), (fail > 0.15).alias("flagged"))


_CCE = "abs(conf - correct::INT)"


@query("cce_by_type", f"SELECT model, difficulty, count(*)::BIGINT AS n, round(avg({_CCE}), 9) AS mean, round(quantile_cont({_CCE}, 0.5), 9) AS median, round(stddev_pop({_CCE}), 9) AS sd, round(avg(conf), 9) AS conf, round(avg(correct::INT), 9) AS acc FROM {_KNOWN} GROUP BY ALL")
def cce(spark, d):
    m = frame(spark, d, "measurements").where("correct is not null").withColumn("cce", F.abs(F.col("conf") - M.as_number(F.col("correct"))))
    return m.groupBy("model", "difficulty").agg(
        F.count("*").alias("n"), F.round(F.avg("cce"), 9).alias("mean"), F.round(F.percentile("cce", F.lit(0.5)), 9).alias("median"), F.round(F.stddev_pop("cce"), 9).alias("sd"),
        F.round(F.avg("conf"), 9).alias("conf"), F.round(M.accuracy(F.col("correct")), 9).alias("acc"),
    )


@query("contrast_by_channel", "SELECT model, channel, round(avg(conf) FILTER (difficulty = 'hard') - avg(conf) FILTER (difficulty = 'easy'), 9) AS contrast FROM {measurements} m GROUP BY ALL")
def contrast(spark, d):
    return frame(spark, d, "measurements").groupBy("model", "channel").agg(F.round(F.avg(F.when(F.col("difficulty") == "hard", F.col("conf"))) - F.avg(F.when(F.col("difficulty") == "easy", F.col("conf"))), 9).alias("contrast"))


@query(
    "three_level_accuracy",
    f"SELECT model, round(e, 9) AS easy, round(m, 9) AS medium, round(h, 9) AS hard, round(h - e, 9) AS gradient, e >= m AND m >= h AS monotone FROM (SELECT model, avg(correct::INT) FILTER (difficulty = 'easy') AS e, avg(correct::INT) FILTER (difficulty = 'medium') AS m, avg(correct::INT) FILTER (difficulty = 'hard') AS h FROM {_KNOWN} GROUP BY model) x",
)
def three_levels(spark, d):
    y = M.as_number(F.col("correct"))
    g = frame(spark, d, "measurements").groupBy("model").agg(*[F.avg(F.when(F.col("difficulty") == k, y)).alias(k) for k in ("easy", "medium", "hard")])
    return g.select("model", *[F.round(k, 9).alias(k) for k in ("easy", "medium", "hard")], F.round(F.col("hard") - F.col("easy"), 9).alias("gradient"), ((F.col("easy") >= F.col("medium")) & (F.col("medium") >= F.col("hard"))).alias("monotone"))


_PHASE = "SELECT model, question_id, avg(conf) FILTER (ts < '2024-01-16' AND difficulty = 'easy') AS ar, avg(conf) FILTER (ts >= '2024-01-16' AND difficulty = 'easy') AS cr, avg(conf) FILTER (ts < '2024-01-16' AND difficulty = 'hard') AS au, avg(conf) FILTER (ts >= '2024-01-16' AND difficulty = 'hard') AS cu FROM {measurements} m GROUP BY ALL"


def _phase(spark, d, *by):
    """Confidence before (a) and after (c) a date on related (r) and unrelated (u) items."""
    early, easy = F.col("ts") < F.lit("2024-01-16").cast("timestamp"), F.col("difficulty") == "easy"
    hard = F.col("difficulty") == "hard"
    return frame(spark, d, "measurements").groupBy(*by).agg(*[F.avg(F.when(c, F.col("conf"))).alias(n) for n, c in (("ar", early & easy), ("cr", ~early & easy), ("au", early & hard), ("cu", ~early & hard))])


@query("adaptation_index", f"SELECT model, channel, round((cr - ar) - (cu - au), 9) AS ai FROM ({_PHASE.replace('question_id', 'channel')}) x")
def adaptation(spark, d):
    return _phase(spark, d, "model", "channel").select("model", "channel", F.round((F.col("cr") - F.col("ar")) - (F.col("cu") - F.col("au")), 9).alias("ai"))


@query(
    "signal_adaptation_ratio",
    f"""WITH a AS (SELECT model, channel, abs((cr - ar) - (cu - au)) AS ai FROM ({_PHASE.replace('question_id', 'channel')}) x), m AS (SELECT model, avg(ai) FILTER (channel IN ('1', '2')) AS t, avg(ai) FILTER (channel IN ('3', '4', '5')) AS f FROM a GROUP BY model)
        SELECT model, round(CASE WHEN t > 0.01 THEN f / t ELSE 0.0 END, 8) AS sar, CASE WHEN t <= 0.01 OR f / t < 0.3 THEN 'genuine' WHEN f / t < 0.7 THEN 'partial' WHEN f / t < 1.3 THEN 'equal' ELSE 'paradoxical' END AS label FROM m""",
)
def sar(spark, d):
    a = _phase(spark, d, "model", "channel").withColumn("ai", F.abs((F.col("cr") - F.col("ar")) - (F.col("cu") - F.col("au"))))
    m = a.groupBy("model").agg(F.avg(F.when(F.col("channel").isin("1", "2"), F.col("ai"))).alias("t"), F.avg(F.when(F.col("channel").isin("3", "4", "5"), F.col("ai"))).alias("f"))
    return m.select("model", F.round(M.sycophancy(F.col("f"), F.col("t")), 8).alias("sar"), M.sycophancy_label(M.sycophancy(F.col("f"), F.col("t"))).alias("label"))


@query(
    "recency_decay",
    "WITH x AS (SELECT model, question_id % 5 AS delay, avg(conf) AS ai FROM {measurements} m GROUP BY ALL) SELECT model, round(max(ai) FILTER (delay = 0) - arg_max(ai, delay), 9) AS decay, round(avg(ai), 9) AS mean FROM x GROUP BY model",
)
def decay(spark, d):
    x = frame(spark, d, "measurements").groupBy("model", (F.col("question_id") % 5).alias("delay")).agg(F.avg("conf").alias("ai"))
    return x.groupBy("model").agg(F.round(F.max(F.when(F.col("delay") == 0, F.col("ai"))) - F.max_by("ai", "delay"), 9).alias("decay"), F.round(F.avg("ai"), 9).alias("mean"))


@query(
    "adversarial_shift",
    """WITH q AS (SELECT model, question_id, channel, avg(conf) FILTER (parse_success) AS clean, avg(conf) FILTER (NOT parse_success) AS attacked FROM {measurements} m GROUP BY ALL), s AS (SELECT model, channel, question_id % 8 < 3 AS weak, attacked - clean AS shift FROM q WHERE clean IS NOT NULL AND attacked IS NOT NULL),
       c AS (SELECT model, channel, avg(shift) AS m FROM s GROUP BY ALL)
       SELECT s.model, count(*)::BIGINT AS n, round(avg(shift), 8) AS shift, round(1 - abs(avg(shift)), 8) AS ars, round(avg(shift) FILTER (weak), 8) AS weak_shift, round(avg(shift) FILTER (NOT weak), 8) AS strong_shift, round((SELECT stddev_pop(m) FROM c WHERE c.model = s.model), 8) AS channel_sd FROM s GROUP BY s.model""",
)
def attacked(spark, d):
    q = frame(spark, d, "measurements").groupBy("model", "question_id", "channel").agg(F.avg(F.when(F.col("parse_success"), F.col("conf"))).alias("clean"), F.avg(F.when(~F.col("parse_success"), F.col("conf"))).alias("hit"))
    s = q.where("clean is not null and hit is not null").withColumn("shift", F.col("hit") - F.col("clean")).withColumn("weak", F.col("question_id") % 8 < 3)
    per = s.groupBy("model", "channel").agg(F.count("*").alias("n"), F.sum("shift").alias("t"), F.avg("shift").alias("m"), F.sum(F.when(F.col("weak"), F.col("shift"))).alias("ws"), F.count_if("weak").alias("wn"), F.sum(F.when(~F.col("weak"), F.col("shift"))).alias("ss"), F.count_if(~F.col("weak")).alias("sn"))
    g = per.groupBy("model").agg(F.sum("n").alias("n"), (F.sum("t") / F.sum("n")).alias("shift"), F.try_divide(F.sum("ws"), F.sum("wn")).alias("weak_shift"), F.try_divide(F.sum("ss"), F.sum("sn")).alias("strong_shift"), F.stddev_pop("m").alias("channel_sd"))
    return g.select("model", "n", F.round("shift", 8).alias("shift"), F.round(1 - F.abs("shift"), 8).alias("ars"), F.round("weak_shift", 8).alias("weak_shift"), F.round("strong_shift", 8).alias("strong_shift"), F.round("channel_sd", 8).alias("channel_sd"))


@query(
    "primed_divergence",
    """WITH p AS (SELECT model, question_id, avg(conf) FILTER (channel = '1') AS a, avg(conf) FILTER (channel = '2') AS b, avg(conf) FILTER (channel = '3') AS c, avg(conf) FILTER (channel = '4') AS d FROM {measurements} m GROUP BY ALL)
       SELECT model, count(*)::BIGINT AS n, round(avg(greatest(a, b, c, d) - least(a, b, c, d)), 8) AS spread, round(avg((abs(a - b) + abs(c - d)) / 2), 8) AS divergence FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL GROUP BY model""",
)
def primed(spark, d):
    p = frame(spark, d, "measurements").groupBy("model", "question_id").pivot("channel", ["1", "2", "3", "4"]).agg(F.avg("conf")).toDF("model", "question_id", "a", "b", "c", "d").dropna(subset=["a", "b", "c", "d"])
    cols = [F.col(x) for x in "abcd"]
    return p.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg(F.greatest(*cols) - F.least(*cols)), 8).alias("spread"), F.round(F.avg((F.abs(cols[0] - cols[1]) + F.abs(cols[2] - cols[3])) / 2), 8).alias("divergence"))


@query(
    "detection_rates",
    "SELECT model, round(count(*) FILTER (refused AND difficulty = 'hard') / count(*) FILTER (difficulty = 'hard')::DOUBLE, 9) AS detected, round(count(*) FILTER (refused AND difficulty <> 'hard') / count(*) FILTER (difficulty <> 'hard')::DOUBLE, 9) AS false_alarm, round(1 - stddev_pop(conf * 100) / 100, 9) AS stability FROM {measurements} m GROUP BY model",
)
def detection(spark, d):
    hard, r = F.col("difficulty") == "hard", F.col("refused")
    rate = lambda c, of: F.round(F.try_divide(F.count_if(c & of).cast("double"), F.count_if(of).cast("double")), 9)
    return frame(spark, d, "measurements").groupBy("model").agg(rate(r, hard).alias("detected"), rate(r, ~hard).alias("false_alarm"), F.round(1 - F.stddev_pop(F.col("conf") * 100) / 100, 9).alias("stability"))


@query("question_difficulty", f"SELECT question_id, count(DISTINCT model)::BIGINT AS models, round(avg(acc), 9) AS difficulty FROM (SELECT question_id, model, avg(correct::INT) AS acc FROM {_KNOWN} GROUP BY ALL) x GROUP BY question_id")
def question_difficulty(spark, d):
    x = frame(spark, d, "measurements").where("correct is not null").groupBy("question_id", "model").agg(M.accuracy(F.col("correct")).alias("acc"))
    return x.groupBy("question_id").agg(F.count("model").alias("models"), F.round(F.avg("acc"), 9).alias("difficulty"))


@query(
    "level_degradation",
    f"""WITH a AS (SELECT model, avg(correct::INT) AS l0 FROM {_KNOWN} AND channel = '1' AND model <> 'click' GROUP BY model), b AS (SELECT model, avg(correct::INT) AS l2 FROM {_KNOWN} AND channel = '5' AND model <> 'view' GROUP BY model)
        SELECT coalesce(a.model, b.model) AS model, round(l0, 9) AS l0, round(l2, 9) AS l2, round(l0 - l2, 9) AS degradation FROM a FULL JOIN b ON a.model = b.model""",
)
def degradation(spark, d):
    m = frame(spark, d, "measurements").where("correct is not null")
    a = m.where("channel = '1' and model <> 'click'").groupBy("model").agg(M.accuracy(F.col("correct")).alias("l0"))
    b = m.where("channel = '5' and model <> 'view'").groupBy("model").agg(M.accuracy(F.col("correct")).alias("l2"))
    return a.join(b, "model", "full").select("model", F.round("l0", 9).alias("l0"), F.round("l2", 9).alias("l2"), F.round(F.col("l0") - F.col("l2"), 9).alias("degradation"))


@query("size_families", "SELECT CASE WHEN p_size <= 12 THEN 'small' WHEN p_size <= 40 AND p_size >= 15 THEN 'middle' WHEN p_size >= 50 THEN 'large' ELSE 'between' END AS family, count(*)::BIGINT AS n, round(avg(p_retailprice), 6) AS mean, round(stddev_samp(p_retailprice), 6) AS sd, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY family")
def families(spark, d):
    from .frames import table

    s = F.col("p_size")
    family = F.when(s <= 12, "small").when(s.between(15, 40), "middle").when(s >= 50, "large").otherwise("between")
    p = F.col("p_retailprice")
    return table(spark, d, "part").groupBy(family.alias("family")).agg(F.count("*").alias("n"), F.round(F.avg(p), 6).alias("mean"), F.round(F.stddev_samp(p), 6).alias("sd"), F.min(p).alias("lo"), F.max(p).alias("hi"))


@query("unit_signal_tools", "SELECT n_tools, CASE n_tools WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS signal, count(*)::BIGINT AS n FROM {measurements} m GROUP BY n_tools")
def tools(spark, d):
    names = F.when(F.col("n_tools") == 0, F.array().cast("array<string>")).when(F.col("n_tools") == 1, F.array(F.lit("calculator"))).otherwise(F.array(F.lit("calculator"), F.lit("Expert")))
    return frame(spark, d, "measurements").groupBy("n_tools", R.tool_signal(names).alias("signal")).agg(F.count("*").alias("n"))


@query(
    "transfer_scores",
    """WITH a AS (SELECT domain, avg(correct::INT) AS acc FROM {measurements} m WHERE correct IS NOT NULL GROUP BY domain), j AS (SELECT model, channel, m.domain, avg(conf) AS signal, any_value(acc) AS acc FROM {measurements} m JOIN a USING (domain) GROUP BY ALL),
       r AS (SELECT model, channel, (rank() OVER (PARTITION BY model, channel ORDER BY signal) + (count(*) OVER (PARTITION BY model, channel, signal) - 1) / 2.0)::DOUBLE AS x, (rank() OVER (PARTITION BY model, channel ORDER BY acc) + (count(*) OVER (PARTITION BY model, channel, acc) - 1) / 2.0)::DOUBLE AS y FROM j),
       s AS (SELECT model, channel, corr(x, y) AS rho FROM r GROUP BY ALL) SELECT model, round(avg(rho), 8) AS transfer, count(rho)::BIGINT AS channels FROM s GROUP BY model""",
)
def transfer(spark, d):
    from ..functions.stats import spearman

    m = frame(spark, d, "measurements")
    acc = m.where("correct is not null").groupBy("domain").agg(M.accuracy(F.col("correct")).alias("acc"))
    j = m.groupBy("model", "channel", "domain").agg(M.exact_mean(F.col("conf")).alias("signal")).join(acc, "domain")
    s = spearman(j, ["model", "channel"], "signal", "acc")
    return s.groupBy("model").agg(F.round(F.avg("rho"), 8).alias("transfer"), F.count("rho").alias("channels"))


@query(
    "verbal_transfer",
    "SELECT lang, count(*)::BIGINT AS n, round(avg((contains(lower(text), 'tion') OR contains(lower(text), 'zu'))::INT), 9) AS named FROM documents WHERE text IS NOT NULL GROUP BY lang",
)
def verbal(spark, d):
    from ..functions.text import present
    from .frames import table

    docs = table(spark, d, "documents").where("text is not null")
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg((present(F.col("text"), ("tion", "zu")) > 0).cast("int")), 9).alias("named"))


@query(
    "monitoring_mismatch",
    """WITH m AS (SELECT * FROM {measurements} m WHERE correct IS NOT NULL AND channel = '1'), q AS (SELECT model, quantile_cont(bet, 0.25) AS lo, quantile_cont(bet, 0.75) AS hi, count(*) AS n FROM m GROUP BY model)
       SELECT model, round(avg(correct::INT) FILTER (bet >= hi) - avg(correct::INT) FILTER (bet <= lo), 9) AS gap FROM m JOIN q USING (model) WHERE n >= 50 GROUP BY model""",
)
def monitoring(spark, d):
    m = frame(spark, d, "measurements").where("correct is not null and channel = '1'")
    q = m.groupBy("model").agg(F.percentile("bet", F.lit(0.25)).alias("lo"), F.percentile("bet", F.lit(0.75)).alias("hi"), F.count("*").alias("n")).where("n >= 50")
    y = M.as_number(F.col("correct"))
    return m.join(q, "model").groupBy("model").agg(F.round(F.avg(F.when(F.col("bet") >= F.col("hi"), y)) - F.avg(F.when(F.col("bet") <= F.col("lo"), y)), 9).alias("gap"))


@query("worst_case_row", "SELECT model, domain, n FROM (SELECT model, domain, count(*)::BIGINT AS n, row_number() OVER (PARTITION BY model ORDER BY avg(conf) DESC, domain DESC) AS rn FROM {measurements} m GROUP BY model, domain) x WHERE rn = 1")
def worst(spark, d):
    g = frame(spark, d, "measurements").groupBy("model", "domain").agg(F.count("*").alias("n"), F.avg("conf").alias("c"))
    return g.groupBy("model").agg(F.max_by(F.struct("domain", "n"), F.struct("c", "domain")).alias("w")).select("model", "w.domain", "w.n")


@query("named_row_delta", "WITH g AS (SELECT model, avg(conf) AS conf, avg(bet) AS bet FROM {measurements} m GROUP BY model) SELECT 'conf' AS metric, round((SELECT conf FROM g WHERE model = 'click') - (SELECT conf FROM g WHERE model = 'view'), 9) AS delta UNION ALL SELECT 'bet', round((SELECT bet FROM g WHERE model = 'click') - (SELECT bet FROM g WHERE model = 'view'), 9)")
def delta(spark, d):
    m = frame(spark, d, "measurements").where("model in ('click', 'view')")
    of = lambda c, k: F.avg(F.when(F.col("model") == k, F.col(c)))
    g = m.agg(*[F.round(of(c, "click") - of(c, "view"), 9).alias(c) for c in ("conf", "bet")])
    return g.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("delta")) for c in ("conf", "bet")])).alias("x")).select("x.*")
