"""Queries on joins and de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import reshape as R
from .frames import frame, table
from .rating import components, nines
from .registry import query

C = "{components}"


@query("capability_join", f"SELECT model, domain, count(*)::BIGINT AS n, round(any_value(natural_acc), 9) AS natural_acc FROM {C} c JOIN {{capability}} k USING (model, domain) GROUP BY ALL")
def capability(spark, d):
    c = components(spark, d).groupBy("model", "domain").agg(F.count("*").alias("n"))
    return c.join(frame(spark, d, "capability"), ["model", "domain"]).select("model", "domain", "n", F.round("natural_acc", 9).alias("natural_acc"))


_LAST_O = "SELECT request_id, arg_max(final_correct, l_linenumber * 1000000000000 + l_partkey * 10000 + l_suppkey) AS final_correct FROM {outcomes} o GROUP BY request_id"


@query("packet_join", f"SELECT request_id, risk_tier, final_correct, round(cost, 9) AS cost FROM {{requests}} r JOIN ({_LAST_O}) o USING (request_id) JOIN (SELECT request_id, max(cost) AS cost FROM {{costs}} c GROUP BY request_id) k USING (request_id)")
def packet(spark, d):
    tie = [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    joined = J.packet(frame(spark, d, "requests"), frame(spark, d, "outcomes").select("request_id", "final_correct", "l_linenumber", "l_partkey", "l_suppkey"), frame(spark, d, "costs").select("request_id", "cost"), "request_id", {"outcomes": tie, "costs": [F.col("cost")]})
    return joined.select("request_id", "risk_tier", "final_correct", F.round("cost", 9).alias("cost"))


@query("cost_left_join", "SELECT r.model_decision, coalesce(c.decision, 'PROCEED') AS decision, count(*)::BIGINT AS n FROM {requests} r LEFT JOIN (SELECT request_id, CASE WHEN max(cost) > 7 THEN 'ESCALATE' END AS decision FROM {costs} c GROUP BY request_id) c USING (request_id) GROUP BY ALL")
def costs(spark, d):
    c = frame(spark, d, "costs").groupBy("request_id").agg(F.when(F.max("cost") > 7, "ESCALATE").alias("decision"))
    return frame(spark, d, "requests").join(c, "request_id", "left").groupBy("model_decision", F.coalesce("decision", F.lit("PROCEED")).alias("decision")).agg(F.count("*").alias("n"))


_M = "SELECT model, question_id, avg({x}) AS {n} FROM {{measurements}} m WHERE channel = '{c}' GROUP BY ALL"


@query("three_way_lookup", f"SELECT model, question_id, round(bet, 9) AS bet, round(conf, 9) AS conf, round(ok, 9) AS ok FROM ({_M.format(x='bet', n='bet', c=1)}) a LEFT JOIN ({_M.format(x='conf', n='conf', c=2)}) b USING (model, question_id) LEFT JOIN ({_M.format(x='correct::INT', n='ok', c=5)}) c USING (model, question_id)".replace("{{", "{").replace("}}", "}"))
def lookups(spark, d):
    m = frame(spark, d, "measurements")
    side = lambda c, x, n: m.where(F.col("channel") == c).groupBy("model", "question_id").agg(F.avg(x).alias(n))
    key = ["model", "question_id"]
    return nines(side("1", F.col("bet"), "bet").join(side("2", F.col("conf"), "conf"), key, "left").join(side("5", F.col("correct").cast("int"), "ok"), key, "left"))


@query("channel_inner_join", f"SELECT model, count(*)::BIGINT AS n, round(avg(bet * conf), 8) AS product FROM ({_M.format(x='bet', n='bet', c=1)}) a JOIN ({_M.format(x='conf', n='conf', c=4)}) b USING (model, question_id) GROUP BY model".replace("{{", "{").replace("}}", "}"))
def inner(spark, d):
    m = frame(spark, d, "measurements")
    side = lambda c, x: m.where(F.col("channel") == c).groupBy("model", "question_id").agg(F.avg(x).alias(x))
    return side("1", "bet").join(side("4", "conf"), ["model", "question_id"]).groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg(F.col("bet") * F.col("conf")), 8).alias("product"))


@query("customers_without_orders", "SELECT c_custkey, c_mktsegment FROM customer c ANTI JOIN (SELECT * FROM orders WHERE o_orderkey % 20 = 0) o ON c_custkey = o_custkey")
def anti(spark, d):
    done = table(spark, d, "orders").where("o_orderkey % 20 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return J.remaining(table(spark, d, "customer"), done, ["c_custkey"]).select("c_custkey", "c_mktsegment")


@query("coverage_semi_join", "SELECT p_brand, count(*)::BIGINT AS covered FROM part p SEMI JOIN lineitem l ON p_partkey = l_partkey AND l_quantity > 45 GROUP BY p_brand")
def semi(spark, d):
    used = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(used, "p_partkey", "left_semi").groupBy("p_brand").agg(F.count("*").alias("covered"))


_ORD = "ORDER BY l_partkey {o}, l_suppkey {o}, l_quantity {o}, l_extendedprice {o}, l_discount {o}, l_tax {o}, l_shipdate {o}, l_returnflag {o}, l_linestatus {o}"
_TIE = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


@query("dedup_first_wins", f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber {_ORD.format(o='')}) AS rn FROM lineitem) x WHERE rn = 1")
def dedup_first(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_TIE)  # noqa: E741
    return J.first_wins(l, ["l_orderkey", "l_linenumber"], [F.col(c) for c in _TIE]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("dedup_last_wins", f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber {_ORD.format(o='DESC')}) AS rn FROM lineitem WHERE l_tax IS NOT NULL) x WHERE rn = 1")
def dedup_last(spark, d):
    l = table(spark, d, "lineitem").where("l_tax is not null").select("l_orderkey", "l_linenumber", *_TIE)  # noqa: E741
    return J.last_wins(l, ["l_orderkey", "l_linenumber"], [F.col(c) for c in _TIE]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("dedup_best_coverage", "SELECT model, version, domains FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY domains DESC, version DESC) AS rn FROM (SELECT model, question_id % 6 AS version, count(DISTINCT domain)::BIGINT AS domains FROM {measurements} m WHERE length % 3 = 0 AND correct GROUP BY ALL) v) x WHERE rn = 1")
def best(spark, d):
    v = frame(spark, d, "measurements").where("length % 3 = 0 and correct").groupBy("model", (F.col("question_id") % 6).alias("version")).agg(F.count_distinct("domain").alias("domains"))
    return J.last_wins(v, ["model"], [F.col("domains"), F.col("version")]).select("model", "version", "domains")


@query("shard_merge", "SELECT o_orderkey, 'old' AS origin FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 3 = 0")
def merge(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return J.merge_new(o.where("o_orderkey % 3 <> 0").withColumn("origin", F.lit("old")), o.where("o_orderkey % 2 = 0 or o_orderkey % 3 = 0").withColumn("origin", F.lit("new")), ["o_orderkey"])


@query("retry_merge", "SELECT task_id, CASE WHEN NOT api_success AND task_id % 2 = 0 THEN 'retry' ELSE model END AS model, api_success OR task_id % 2 = 0 AS api_success FROM {trials} t")
def retries(spark, d):
    t = frame(spark, d, "trials").select("task_id", "model", "api_success")
    again = t.withColumn("model", F.lit("retry")).withColumn("api_success", F.col("task_id") % 2 == 0)
    return J.merge_retries(t, again, ["task_id"], "api_success")


@query("channel_pairs", "WITH q AS (SELECT model, question_id, channel, avg(conf) AS v FROM {measurements} m GROUP BY ALL) SELECT a.model, a.channel AS ch_a, b.channel AS ch_b, count(*)::BIGINT AS shared, round(sum(a.v * b.v), 6) AS products FROM q a JOIN q b ON a.model = b.model AND a.question_id = b.question_id AND a.channel < b.channel GROUP BY ALL HAVING count(*) >= 2")
def pairs(spark, d):
    from ..operators import metrics as M

    p = M.paired_channels(frame(spark, d, "measurements"), ["model", "question_id"], "channel", "conf")
    return p.groupBy("model", "ch_a", "ch_b").agg(F.count("*").alias("shared"), F.round(F.sum(F.col("x") * F.col("y")), 6).alias("products")).where("shared >= 2")


@query("opposed_model_pairs", "SELECT s.model AS strong_model, w.model AS weak_model, domain, round(s.natural_acc - w.natural_acc, 9) AS gap FROM {capability} s JOIN {capability} w USING (domain) WHERE s.natural_acc >= 0.46 AND w.natural_acc <= 0.44 AND s.model <> w.model")
def opposed(spark, d):
    return nines(J.opposed_pairs(frame(spark, d, "capability"), 0.46, 0.44))


@query(
    "crossed_model_pairs",
    """WITH p AS (SELECT s.model AS s, w.model AS w, domain FROM {capability} s JOIN {capability} w USING (domain) WHERE s.natural_acc >= 0.46 AND w.natural_acc <= 0.44 AND s.model <> w.model)
       SELECT x.s AS a, x.w AS b, x.domain AS domain_a, y.domain AS domain_b FROM p x JOIN p y ON x.s = y.w AND x.w = y.s WHERE x.s < x.w""",
)
def crossed(spark, d):
    return J.crossed_pairs(frame(spark, d, "capability"), 0.46, 0.44).select("a", "b", "domain_a", "domain_b")


@query("clean_baseline_join", "WITH b AS (SELECT model, question_id, channel, avg(conf) AS base FROM {measurements} m WHERE parse_success GROUP BY ALL) SELECT event_id, round(conf - base, 9) AS shift FROM {measurements} m JOIN b USING (model, question_id, channel) WHERE NOT parse_success")
def baseline(spark, d):
    m = frame(spark, d, "measurements")
    b = m.where("parse_success").groupBy("model", "question_id", "channel").agg(F.avg("conf").alias("base"))
    return m.where("not parse_success").join(b, ["model", "question_id", "channel"]).select("event_id", F.round(F.col("conf") - F.col("base"), 9).alias("shift"))


_RATERS = "SELECT doc_id, 'quality' AS rater, quality AS label FROM {ratings} r WHERE quality IS NOT NULL UNION ALL SELECT doc_id, 'rule', rule FROM {ratings} r UNION ALL SELECT doc_id, 'toxic', 1 - toxic FROM {ratings} r WHERE toxic IS NOT NULL"


def raters(spark, d):
    r = frame(spark, d, "ratings")
    long = r.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("rater"), c.alias("label")) for n, c in (("quality", F.col("quality")), ("rule", F.col("rule")), ("toxic", 1 - F.col("toxic")))])).alias("x"))
    return long.select("doc_id", "x.*").where("label is not null")


@query("complete_raters", f"SELECT rater, count(*)::BIGINT AS n, sum(label)::BIGINT AS yes FROM ({_RATERS}) r WHERE doc_id IN (SELECT doc_id FROM ({_RATERS}) q GROUP BY doc_id HAVING count(DISTINCT rater) = 3) GROUP BY rater")
def complete(spark, d):
    return J.raters_complete(raters(spark, d), "doc_id", "rater", 3).groupBy("rater").agg(F.count("*").alias("n"), F.sum("label").alias("yes"))


@query(
    "cyclic_pairing",
    """WITH e AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer), h AS (SELECT s_nationkey AS c_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS j, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
       SELECT c_nationkey, c_custkey, s_suppkey FROM e JOIN h USING (c_nationkey) WHERE i % n = j""",
)
def cyclic(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey")
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), "s_suppkey")
    return J.cyclic_zip(c, s, ["c_custkey"], ["s_suppkey"], ["c_nationkey"]).select("c_nationkey", "c_custkey", "s_suppkey")


@query("first_pair_lookup", "WITH p AS (SELECT n_nationkey AS pair, n_nationkey % 7 AS l, n_nationkey % 5 AS r FROM nation), x AS (SELECT l AS id, pair FROM p UNION SELECT r, pair FROM p) SELECT id::INT AS id, min(pair) AS pair, count(*)::BIGINT AS pairs FROM x GROUP BY id")
def first_pair(spark, d):
    p = table(spark, d, "nation").select(F.col("n_nationkey").alias("pair"), (F.col("n_nationkey") % 7).alias("l"), (F.col("n_nationkey") % 5).alias("r"))
    first = J.first_pair_of(p, "l", "r", "pair").select("id", "pair")
    index = p.select(F.explode(F.array_distinct(F.array("l", "r"))).alias("id")).groupBy("id").agg(F.count("*").alias("pairs"))
    return first.join(index, "id").select("id", "pair", "pairs")


@query(
    "scaling_record",
    """SELECT n_name, round(a, 4) AS balance, coalesce(b, 0)::BIGINT AS suppliers, round(c, 4) AS spend FROM nation LEFT JOIN (SELECT c_nationkey AS k, avg(c_acctbal) AS a FROM customer GROUP BY k) x ON x.k = n_nationkey
       LEFT JOIN (SELECT s_nationkey AS k, count(*) AS b FROM supplier WHERE s_acctbal > 0 GROUP BY k) y ON y.k = n_nationkey LEFT JOIN (SELECT c_nationkey AS k, avg(o_totalprice) AS c FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY k) z ON z.k = n_nationkey""",
)
def scaling(spark, d):
    c = table(spark, d, "customer")
    a = c.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("a")).withColumnRenamed("c_nationkey", "n_nationkey")
    b = table(spark, d, "supplier").where("s_acctbal > 0").groupBy("s_nationkey").agg(F.count("*").alias("b")).withColumnRenamed("s_nationkey", "n_nationkey")
    z = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.avg("o_totalprice").alias("c")).withColumnRenamed("c_nationkey", "n_nationkey")
    n = table(spark, d, "nation")
    for side in (a, b, z):
        n = n.join(side, "n_nationkey", "left")
    return n.select("n_name", F.round("a", 4).alias("balance"), F.coalesce("b", F.lit(0)).cast("long").alias("suppliers"), F.round("c", 4).alias("spend"))


@query("rescore_flips", "SELECT CASE WHEN q.question_id IS NULL THEN 'no_question' WHEN m.correct IS NULL THEN 'unscored' WHEN m.correct = (m.bet > 5) THEN 'same' WHEN m.correct THEN 'lost' ELSE 'gained' END AS flip, count(*)::BIGINT AS n FROM {measurements} m LEFT JOIN (SELECT DISTINCT question_id FROM {measurements} x WHERE question_id % 10 <> 0) q USING (question_id) GROUP BY flip")
def rescored(spark, d):
    m = frame(spark, d, "measurements")
    q = m.where("question_id % 10 <> 0").select("question_id").distinct().withColumn("known", F.lit(True))
    now = F.col("bet") > 5
    flip = F.when(F.col("known").isNull(), "no_question").when(F.col("correct").isNull(), "unscored").when(F.col("correct") == now, "same").when(F.col("correct"), "lost").otherwise("gained")
    return m.join(q, "question_id", "left").groupBy(flip.alias("flip")).agg(F.count("*").alias("n"))


@query("nearest_by_key", "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(c_acctbal - 5000), c_custkey) AS rn FROM customer) x WHERE rn = 1")
def nearest(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return J.nearest(c, ["c_nationkey"], "c_acctbal", F.lit(5000.0), ["c_custkey"])


@query("id_intersection", "SELECT count(*)::BIGINT AS n FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem WHERE l_orderkey % 17 <> 0 INTERSECT SELECT l_orderkey FROM lineitem WHERE l_orderkey % 19 <> 0) x")
def intersection(spark, d):
    r, o, c = (frame(spark, d, n).select("request_id") for n in ("requests", "outcomes", "costs"))
    return r.intersect(o).intersect(c).agg(F.count("*").alias("n"))


@query("model_exclusion", "SELECT model, count(*)::BIGINT AS n FROM {trials} t WHERE model NOT IN ('5-LOW', '1-URGENT') GROUP BY model")
def exclusion(spark, d):
    return frame(spark, d, "trials").where(~F.col("model").isin("5-LOW", "1-URGENT")).groupBy("model").agg(F.count("*").alias("n"))


@query(
    "weak_union_intersection",
    """WITH w AS (SELECT model, domain FROM {capability} c WHERE natural_acc < 0.4545), n AS (SELECT count(DISTINCT model) AS n FROM w), f AS (SELECT domain, count(*)::BIGINT AS models FROM w GROUP BY domain)
       SELECT domain, models, models = n AS everywhere FROM f, n""",
)
def weak_sets(spark, d):
    w = frame(spark, d, "capability").where("natural_acc < 0.4545")
    n = w.agg(F.count_distinct("model").alias("n"))
    return w.groupBy("domain").agg(F.count("*").alias("models")).crossJoin(F.broadcast(n)).select("domain", "models", (F.col("models") == F.col("n")).alias("everywhere"))


_PAIRS = "SELECT a.label, a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id"


@query("similarity_join", f"SELECT label, i, j, round(c, 6) AS cosine FROM ({_PAIRS}) p WHERE c >= 0.33")
def similar(spark, d):
    return J.similar_pairs(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.33).select("label", "i", "j", F.round("cosine", 6).alias("cosine"))


@query("greedy_similarity_clusters")
def clusters(spark, d):
    e = table(spark, d, "embeddings")
    return J.greedy_clusters(e, J.similar_pairs(e, "label", "vec_id", "embedding", 0.33), "label", "vec_id")


@query("participant_rates", "SELECT c_mktsegment, round(min(p), 9) AS lo, round(max(p), 9) AS hi, round(avg(p), 9) AS mean, round(stddev_samp(p), 9) AS sd FROM (SELECT c_mktsegment, c_nationkey, avg((c_acctbal > 4000)::INT) AS p FROM customer GROUP BY ALL) x GROUP BY c_mktsegment")
def participants(spark, d):
    x = table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.avg((F.col("c_acctbal") > 4000).cast("int")).alias("p"))
    return nines(x.groupBy("c_mktsegment").agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.avg("p").alias("mean"), F.stddev_samp("p").alias("sd")))


@query("first_n_per_group", "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer) x WHERE rn <= 3")
def first_rows(spark, d):
    return R.first_n(table(spark, d, "customer"), ["c_nationkey"], ["c_custkey"], 3).select("c_nationkey", "c_custkey")
