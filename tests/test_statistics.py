import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import ranks as K
from plumbline.functions import stats as S
from plumbline.operators import metrics as M


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    "rows,want",
    [([(0.7, i < 70) for i in range(100)], 0.0), ([(1.0, i < 50) for i in range(100)], 0.5), ([(0.0, True)] * 100, 1.0), ([(70.0, i < 70) for i in range(100)], 0.0), ([], None), ([(None, True), (0.5, None)], None)],
)
def test_ece(spark, rows, want):
    got = M.ece(frame(spark, [("g", *r) for r in rows], "g string, c double, y boolean"), ["g"], "c", "y", rescale=True).collect()
    assert (got == [] if want is None else got[0]["ece"] == pytest.approx(want, abs=1e-9))


@pytest.mark.parametrize("pos,neg,want", [([0.9] * 10, [0.1] * 10, 1.0), ([0.1] * 10, [0.9] * 10, 0.0), ([0.5], [], None), ([0.5, 0.5], [0.5], 0.5), ([1, 2, 2], [2, 0], 4 / 6)])
def test_auroc(spark, pos, neg, want):
    rows = [("g", float(x), True) for x in pos] + [("g", float(x), False) for x in neg]
    assert M.auroc(frame(spark, rows, "g string, c double, y boolean"), ["g"], "c", "y").first()["auroc"] == (None if want is None else pytest.approx(want))


def test_golden_holm_and_effects(spark):
    t = frame(spark, [(1, 0.5195), (2, 0.0273), (3, 0.0186), (4, None)], "k int, p double")
    got = {r["k"]: r["p_holm"] for r in K.holm(t, "p", [], ["k"]).collect()}
    assert got == {1: pytest.approx(0.5195, abs=1e-3), 2: pytest.approx(0.0557, abs=1e-3), 3: pytest.approx(0.0557, abs=1e-3)}
    none = frame(spark, [(i, p) for i, p in enumerate([0.3, 0.5, 0.7, 0.9])], "k int, p double")
    assert all(r["p_bh"] > 0.05 for r in K.benjamini_hochberg(none, "p", [], ["k"]).collect())


def test_correlations_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 9, 80).astype(float)
    y = x + rng.integers(0, 9, 80)
    z = rng.normal(size=80)
    df = frame(spark, [("g", *map(float, r)) for r in zip(x, y, z)] + [("g", None, 1.0, 1.0)], "g string, x double, y double, z double")

    def rank(v):
        return np.array([np.mean(np.flatnonzero(np.sort(v) == a)) + 1 for a in v])

    assert S.spearman(df, ["g"], "x", "y").first()["rho"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    r = df.agg(S.pearson(F.col("x"), F.col("y")).alias("xy"), S.pearson(F.col("x"), F.col("z")).alias("xz"), S.pearson(F.col("y"), F.col("z")).alias("yz")).select(S.partial(F.col("xy"), F.col("xz"), F.col("yz")).alias("r")).first()["r"]
    res = lambda v: v - np.polyval(np.polyfit(z, v, 1), z)
    # the row with a null x counts for y and z alone
    assert r == pytest.approx(np.corrcoef(res(x), res(y))[0, 1], abs=0.05)
    tau = S.kendall_tau(df, ["g"], "x", "y").first()["tau"]
    num = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(80) for j in range(i))
    den = math.sqrt(sum(x[i] != x[j] for i in range(80) for j in range(i)) * sum(y[i] != y[j] for i in range(80) for j in range(i)))
    assert tau == pytest.approx(num / den)
    assert df.withColumn("c", F.lit(1.0)).agg(S.pearson(F.col("c"), F.col("y")).alias("r")).first()["r"] is None
    fit = S.ols(df, ["g"], "x", "y").first()
    assert (fit["slope"], fit["intercept"]) == (pytest.approx(np.polyfit(x, y, 1)[0]), pytest.approx(np.polyfit(x, y, 1)[1]))


def test_normal(spark):
    z = [i / 10 for i in range(-50, 51)]
    got = frame(spark, [(v,) for v in z], "z double").select("z", S.normal_cdf(F.col("z")).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx((1 + math.erf(r["z"] / math.sqrt(2))) / 2, abs=2e-7)
    p = frame(spark, [(i / 200,) for i in range(201)], "p double").select("p", S.normal_ppf(F.col("p")).alias("z")).collect()
    assert p[0]["z"] is None and p[-1]["z"] is None
    for r in p[1:-1]:
        assert (1 + math.erf(r["z"] / math.sqrt(2))) / 2 == pytest.approx(r["p"], abs=1e-8)


def test_agreement_edges(spark):
    same = frame(spark, [("a", "a")] * 5, "x string, y string")
    assert S.cohen_kappa(same, "x", "y").first()["kappa"] == 1.0 and S.cohen_kappa(same, "x", "y", certain=0.0).first()["kappa"] == 0.0
    rows = frame(spark, [(i, r, x) for i, (a, b, c) in enumerate([(1, 1, 0), (0, 0, 0), (1, 1, 1), (0, 1, 0)]) for r, x in enumerate((a, b, c))], "item int, rater int, label int")
    p = [(4 + 1 - 3) / 6, 1, 1, (4 + 1 - 3) / 6]
    pe = (6 / 12) ** 2 + (6 / 12) ** 2
    assert S.fleiss_kappa(rows, "item", "label").first()["kappa"] == pytest.approx((np.mean(p) - pe) / (1 - pe))


def test_tests(spark):
    random.seed(3)
    a, b = [random.gauss(0, 1) for _ in range(40)], [random.gauss(1, 1) for _ in range(30)]
    df = frame(spark, [("g", x, True) for x in a] + [("g", x, False) for x in b], "g string, v double, f boolean")
    r = S.mann_whitney(df, ["g"], "v", "f").first()
    assert r["u"] == sum((x > y) + 0.5 * (x == y) for x in a for y in b) and r["p"] < 0.01
    d = S.cohens_d(F.col("v"), F.col("f"))
    pooled = math.sqrt((39 * np.var(a, ddof=1) + 29 * np.var(b, ddof=1)) / 68)
    assert df.agg(d.alias("d")).first()["d"] == pytest.approx((np.mean(a) - np.mean(b)) / pooled)
    w = frame(spark, [("g", 0.0)] * 4, "g string, d double")
    assert S.wilcoxon(w, ["g"], "d").first()["p"] == 1.0
    assert S.wilcoxon(frame(spark, [("g", 1.0)], "g string, d double"), ["g"], "d").first()["p"] is None
    two = frame(spark, [("a", True)] * 12 + [("a", False)] * 5 + [("b", True)] * 3 + [("b", False)] * 9, "x string, y boolean")
    e = [17 * 15 / 29, 17 * 14 / 29, 12 * 15 / 29, 12 * 14 / 29]
    want = sum((abs(o - x) - 0.5) ** 2 / x for o, x in zip((12, 5, 3, 9), e))
    assert S.chi_square(two, "x", "y").first()["chi2"] == pytest.approx(want)


def test_half_even_and_quantiles(spark):
    df = frame(spark, [("g", float(i), i) for i in range(5)], "g string, s double, i int")
    assert [r["i"] for r in K.top_share(df, ["g"], "s", "i", 0.5).where("top").collect()] == [4, 3]
    q = df.agg(*[c.alias(n) for n, c in K.quantiles("s", 0.6).items()]).first()
    assert (q["linear"], q["nearest"], q["lower"], q["upper"]) == (pytest.approx(2.4), 2.0, 2.0, 2.0)


def test_tau_and_quantiles_of_many_values(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(x), float(y)) for x, y in rng.normal(size=(300, 2))] + [("b", float(x), float(y)) for x, y in rng.integers(0, 6, size=(200, 2))]
    rows += [("c", 1.0, float(i)) for i in range(5)] + [("d", None, 1.0), ("d", 2.0, None), (None, 1.0, 2.0), (None, 2.0, 3.0), ("e", 1.0, 1.0)]
    df = frame(spark, rows, "g string, x double, y double")
    tau = {r["g"]: r["tau"] for r in S.kendall_tau(df, ["g"], "x", "y").collect()}

    def brute(g):
        p = np.array([r[1:] for r in rows if r[0] == g], float)
        dx, dy = np.sign(p[:, None, 0] - p[None, :, 0]), np.sign(p[:, None, 1] - p[None, :, 1])
        return (dx * dy).sum() / math.sqrt((dx != 0).sum() * (dy != 0).sum())

    assert tau["a"] == pytest.approx(brute("a"), abs=1e-12) and tau["b"] == pytest.approx(brute("b"), abs=1e-12)
    assert tau[None] == pytest.approx(1.0) and tau["c"] is None and tau["e"] is None and "d" not in tau
    for q in (0.0, 0.25, 0.6, 1.0):
        want = {r["g"]: r for r in df.where("x is not null").groupBy("g").agg(*[c.alias(n) for n, c in K.quantiles("x", q).items()]).collect()}
        for r in K.quantile_table(df, ["g"], "x", q).collect():
            for name in ("linear", "nearest", "lower", "upper"):
                if q > 0 or name != "upper":
                    assert r[name] == pytest.approx(want[r["g"]][name], abs=1e-12)
    assert K.quantile_table(df.limit(0), ["g"], "x", 0.5).collect() == [] == S.kendall_tau(df.limit(0), ["g"], "x", "y").collect()


def test_exact_signed_ranks(spark):
    rng = np.random.default_rng(9)
    rows = [("a", float(d)) for d in rng.normal(0.4, 1, 9)] + [("b", float(d)) for d in rng.normal(0, 1, 60)]
    rows += [("t", d) for d in (1.0, 1.0, -1.0, 2.0, 3.0)] + [("z", 0.0)] * 4 + [("s", 1.0), ("s", 2.0), ("n", None)]
    got = {r["g"]: r for r in S.wilcoxon(frame(spark, rows, "g string, d double"), ["g"], "d").collect()}
    d = np.array([v for g, v in rows if g == "a"])
    rank = np.abs(d).argsort().argsort() + 1
    w = rank[d > 0].sum()
    sums = [sum(k + 1 for k in range(9) if m >> k & 1) for m in range(512)]
    assert got["a"]["w"] == w
    assert got["a"]["p"] == pytest.approx(min(1, 2 * min(sum(s <= w for s in sums), sum(s >= w for s in sums)) / 512), abs=1e-12)
    normal = lambda z: math.erfc(abs(z) / math.sqrt(2))
    assert got["b"]["p"] == pytest.approx(normal((got["b"]["w"] - 60 * 61 / 4) / math.sqrt(60 * 61 * 121 / 24)), abs=1e-6)
    assert got["t"]["p"] == pytest.approx(normal((13 - 7.5) / math.sqrt((5 * 6 * 11 - 24 / 2) / 24)), abs=1e-6)
    assert got["z"]["p"] == 1.0 and got["s"]["p"] is None and "n" not in got
