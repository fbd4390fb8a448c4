import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions.ranks import pareto_front
from plumbline.operators import joins as J
from plumbline.operators import policy as P
from plumbline.operators import rates as Q
from plumbline.operators import reshape as R
from plumbline.operators import sample as A


def slots(spark):
    fields = "domain string, subcategory string, strength string, decision string, correct boolean, routed boolean, hedges int, decomps int, tokens int, error string"
    names = [f"{f.split()[0]}_{s} {f.split()[1]}" for s in "ab" for f in fields.split(", ")]
    one = lambda d, st, dec, ok: (d, "s", st, dec, ok, False, 0, 0, 0, None)
    rows = [
        ("m", 1, *one("x", "weak", "proceed", False), *one("y", "strong", "defer", True)), ("m", 2, *one("x", "weak", "defer", False), *one("", "strong", "defer", True)),
        ("m", 3, *one("x", "weak", "proceed", True), *one("y", "strong", "proceed", True)), ("m", 4, *one("x", "weak", "proceed", None), *one(None, "strong", None, True)),
    ]
    return spark.createDataFrame(rows, "model string, task int, " + ", ".join(names))


def test_rates_by_hand(spark):
    c = R.unpivot_slots(slots(spark))
    assert c.count() == 6
    r = Q.failure_rates(c, ["model"]).first()
    assert r["cfr"] == pytest.approx(2 / 4) and r["udr"] == pytest.approx(1 / 2)
    assert Q.failure_rates(c.where("domain = 'y'"), ["model"]).first()["cfr"] is None


def test_minmax_edges(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", 2.0), ("b", 2.0)], "g string, v double")
    got = sorted([(r["g"], r["s"]) for r in R.minmax(df, "v", ["g"], "s").collect()], key=str)
    assert got == [("a", 0.0), ("a", 1.0), ("a", None), ("b", 0.5), ("b", 0.5)]


def test_weak_sets_fall_back(spark):
    acc = spark.createDataFrame([("m", d, 0.5) for d in "abcd"] + [("n", d, v) for d, v in zip("abcd", (0.1, 0.2, 0.3, 0.4))], "model string, domain string, natural_acc double")
    got = sorted((r["model"], r["domain"]) for r in P.weak_sets(acc).collect())
    assert got == [("m", "a"), ("m", "b"), ("n", "a"), ("n", "b")]
    assert sorted((r["model"], r["domain"]) for r in P.weak_sets(acc, "quantile", q=0.0).collect() if r["model"] == "n") == [("n", "a")]


def test_conformal_and_budget(spark):
    rows = [("g", i, i < 60) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, s int, ok boolean")
    assert P.conformal_threshold(df, ["g"], "s", "ok", 0.2).first()["threshold"] == max(t for t in range(100) if sum(i >= 60 for i in range(t + 1)) <= (t + 1) * 0.2 and t >= 19)
    assert P.conformal_threshold(df, ["g"], "s", "ok", 0.2, least=200).first()["threshold"] is None
    assert P.budget_threshold(df, ["g"], "s", 0.3).first()["threshold"] == 69


def test_pareto_with_null(spark):
    p = spark.createDataFrame([(1, 0.9, 1.0), (2, 0.8, 1.0), (3, 0.95, None), (4, 0.9, 0.5)], "id int, up double, down double")
    assert {r["id"] for r in pareto_front(p, ["id"], ["up"], ["down"]).collect()} == {3}


def test_ipw_and_bounds(spark):
    rows = [("g", True, True)] * 6 + [("g", True, False)] * 2 + [("g", False, None)] * 2
    df = spark.createDataFrame(rows, "g string, seen boolean, bad boolean")
    r = P.three_modes(P.propensity(df, ["g"], F.col("seen")), ["g"], F.col("seen"), F.col("bad"), F.col("p_obs")).first()
    assert (r["complete"], r["conservative"], r["ipw"]) == (0.75, 0.8, pytest.approx(0.75))
    b = P.mnar_bounds(df, ["g"], F.col("seen"), F.col("bad")).first()
    assert (b["lower"], b["upper"]) == (pytest.approx(6 / 9), pytest.approx(7 / 9))
    assert spark.range(1).select(P.weight(F.lit(None).cast("double")).alias("w")).first()["w"] == 2.0


def test_logistic_recovers(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(4000):
        x = rng.gauss(0, 1)
        rows.append((x, rng.random() < 1 / (1 + 2.718281828 ** -(0.5 + 1.5 * x))))
    beta = P.logistic(spark.createDataFrame(rows, "x double, y boolean"), ["x"], "y")
    assert beta[0] == pytest.approx(0.5, abs=0.15) and beta[1] == pytest.approx(1.5, abs=0.2)


def test_winners_and_merges(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None), (None, 5, "n"), (None, 4, "m")], "k int, o int, v string")
    assert sorted([(r["k"], r["v"]) for r in J.first_wins(df, ["k"], [F.col("o")]).collect()], key=str) == [(1, "a"), (2, None), (None, "m")]
    assert sorted([(r["k"], r["v"]) for r in J.last_wins(df, ["k"], [F.col("o")]).collect()], key=str) == [(1, "b"), (2, None), (None, "n")]
    main = spark.createDataFrame([(1, False, "old"), (2, True, "old"), (3, False, "old")], "k int, ok boolean, v string")
    again = spark.createDataFrame([(1, True, "new"), (2, True, "new"), (3, False, "new")], "k int, ok boolean, v string")
    assert {(r["k"], r["v"]) for r in J.merge_retries(main, again, ["k"], "ok").collect()} == {(1, "new"), (2, "old"), (3, "old")}


def test_greedy_clusters_follow_seed_order(spark):
    nodes = spark.createDataFrame([("g", i) for i in range(8)], "g string, i long")
    rng = random.Random(2)
    links = {(a, b) for a in range(8) for b in range(a + 1, 8) if rng.random() < 0.3}
    edges = spark.createDataFrame([("g", a, b) for a, b in links], "g string, i long, j long")
    seed, want = {}, {}
    for i in range(8):
        if i not in want:
            want[i] = i
            for j in range(i + 1, 8):
                if j not in want and (i, j) in links:
                    want[j] = i
    seed = {r["i"]: r["seed"] for r in J.greedy_clusters(nodes, edges, "g", "i").collect()}
    assert seed == want


def test_similar_pairs_in_blocks(spark):
    rng = random.Random(4)
    rows = [(i % 2, i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, i int, v array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and cos(a[2], b[2]) >= 0.8}
    assert {(r["i"], r["j"]) for r in J.similar_pairs(df, "g", "i", "v", 0.8, block=7).collect()} == want


def test_samples(spark):
    df = spark.createDataFrame([("abc"[i % 3] if i < 60 else "d", i) for i in range(62)], "g string, i int")
    got = A.stratified(df, "g", 30, ["i"]).collect()
    assert len(got) == 30 and sum(r["g"] == "d" for r in got) == 2
    assert A.stratified(df, "g", 500, ["i"]).count() == 62
    a = {r["i"] for r in A.balanced(df.withColumn("l", F.col("i") % 2), "l", 10, "i", 1).collect()}
    assert a == {r["i"] for r in A.balanced(df.repartition(9).withColumn("l", F.col("i") % 2), "l", 10, "i", 1).collect()} and len(a) == 10


def test_resampling(spark):
    df = spark.createDataFrame([("g", i, float(i < 50)) for i in range(100)], "g string, i int, v double")
    reps = A.bootstrap(df, ["g"], "i", {"m": F.sum(F.col("v") * F.col("weight")) / F.sum("weight")}, 300)
    r = A.percentile_interval(reps, ["g"], "m").first()
    assert 0.35 < r["lo"] < 0.5 < r["hi"] < 0.65 and r["replicates"] == 300
    b = A.bca_interval(df, ["g"], "i", "v", 300).first()
    assert 0.35 < b["lo"] < 0.5 < b["hi"] < 0.65
    assert A.bca_interval(df.limit(1), ["g"], "i", "v", 20).first()["lo"] is None
    far = spark.createDataFrame([("g", i, 10.0 if i < 50 else 0.0, i < 50) for i in range(100)], "g string, i int, v double, f boolean")
    assert A.permutation_test(far, ["g"], "i", "v", "f", 200).first()["p"] < 0.01
    same = spark.createDataFrame([("g", i, float(i % 7), i % 2 == 0) for i in range(98)], "g string, i int, v double, f boolean")
    assert A.permutation_test(same, ["g"], "i", "v", "f", 200).first()["p"] > 0.05
    flips = A.label_flips(df.withColumn("y", F.col("v") > 0).select("i", "y"), "i", "y", 7, 5)
    changed = flips.withColumn("was", F.col("i") < 50).groupBy("replicate").agg(F.count_if(F.col("y") != F.col("was")).alias("n")).collect()
    assert [r["n"] for r in changed] == [7] * 5


def test_poisson_weights(spark):
    w = spark.range(20000).select(A.poisson_weight(F.col("id"), F.lit(1), 3).alias("w")).agg(F.avg("w").alias("m"), F.var_pop("w").alias("v"), F.avg((F.col("w") == 0).cast("int")).alias("z")).first()
    assert w["m"] == pytest.approx(1, abs=0.03) and w["v"] == pytest.approx(1, abs=0.05) and w["z"] == pytest.approx(0.3679, abs=0.01)


def test_adaptive_thresholds_loop(spark):
    rng = random.Random(7)
    acc = [(f"m{k}", f"d{i}", round(rng.uniform(0.3, 0.7), 3)) for k in range(12) for i in range(8)]
    got = {r["model"]: (r["strong_cut"], r["weak_cut"]) for r in R.adaptive_thresholds(spark.createDataFrame(acc, "model string, domain string, natural_acc double")).collect()}
    for m in {a[0] for a in acc}:
        v = [a[2] for a in acc if a[0] == m]
        s, w = 0.6, 0.4
        while True:
            ns, nw = sum(x >= s for x in v), sum(x <= w for x in v)
            if ns >= 2 and nw >= 2:
                break
            s, w = round(s - 0.05 * (ns < 2), 10), round(w + 0.05 * (nw < 2), 10)
            if s <= w:
                s, w = round(s + 0.05, 10), round(w - 0.05, 10)
                break
        assert got[m] == (s, w)


def test_missingness_model(spark):
    cells = [("x", None, 30, 70), ("x", "u", 30, 70), ("y", None, 60, 40), ("y", "u", 60, 40)]
    rows = [(a, b, i >= m) for a, b, m, o in cells for i in range(m + o)] + [("x", "u", None)]
    df = spark.createDataFrame(rows, "a string, b string, seen boolean")
    got = {r["term"]: r for r in P.missingness_model(df, ["a", "b"], F.col("seen")).collect()}
    assert set(got) == {"intercept", "a=y", "b=u"}
    assert got["a=y"]["odds_ratio"] == pytest.approx((60 / 40) / (30 / 70), rel=1e-6) and got["b=u"]["odds_ratio"] == pytest.approx(1, abs=1e-6)
    assert got["a=y"]["auc"] == pytest.approx((120 * 140 + 0.5 * (120 * 80 + 60 * 140)) / (180 * 220), abs=1e-9)
    with pytest.raises(ValueError):
        P.missingness_model(df, ["a", "b"], F.col("seen"), most=3)
    assert [tuple(r) for r in P.missingness_model(df.limit(0), ["a"], F.col("seen")).collect()] == [("intercept", None, None, None)]
