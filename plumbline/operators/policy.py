"""Weak sets, abstention policies, frontiers and missing-data sensitivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .rates import ratio


def weak_sets(acc: DataFrame, rule: str = "median", k: int = 2, cut: float = 0.5, q: float = 0.25, by: str = "model", item: str = "domain", value: str = "natural_acc") -> DataFrame:
    """(by, item) rows of the weak set of each group.

    bottom: the k lowest. median: below the group's median. absolute: at most ``cut``. quantile: at most the value at index floor((n - 1) q).
    The last three fall back to the k lowest where no row qualifies. Ties go by item. For capability tables, a few rows a group.
    """
    w = W.Window.partitionBy(by)
    rows = acc.where(F.col(value).isNotNull()).withColumn("__rn", F.row_number().over(w.orderBy(value, item)))
    if rule == "bottom":
        return rows.where(F.col("__rn") <= k).select(by, item)
    if rule == "median":
        test = F.col(value) < F.percentile(value, F.lit(0.5)).over(w)
    elif rule == "absolute":
        test = F.col(value) <= cut
    elif rule == "quantile":
        n = F.count("*").over(w)
        edge = F.max(F.when(F.col("__rn") == F.col("__at"), F.col(value))).over(w)
        rows = rows.withColumn("__at", F.floor((n - 1) * q) + 1)
        test = F.col(value) <= edge
    else:
        raise ValueError(f"no rule {rule!r}")
    rows = rows.withColumn("__t", test).withColumn("__any", F.max("__t").over(w))
    return rows.where(F.when(F.col("__any"), F.col("__t")).otherwise(F.col("__rn") <= k)).select(by, item)


def leave_one_out_sets(acc: DataFrame, k: int = 2, by: str = "model", item: str = "domain", value: str = "natural_acc") -> DataFrame:
    """(by, held_out, item): for each held-out item the median rule over the others, by a self-join within the group."""
    held = acc.select(by, F.col(item).alias("held_out"))
    rest = acc.join(held, by).where(F.col(item) != F.col("held_out"))
    keyed = rest.withColumn("__g", F.struct(by, "held_out"))
    return weak_sets(keyed, "median", k, by="__g", item=item, value=value).select(F.col(f"__g.{by}").alias(by), F.col("__g.held_out").alias("held_out"), item)


def with_weak(components: DataFrame, weak: DataFrame, by: str = "model", item: str = "domain", out: str = "weak") -> DataFrame:
    """Mark components whose (by, item) is in the weak set."""
    marked = weak.select(by, item).distinct().withColumn("__w", F.lit(True))
    return components.join(marked, [by, item], "left").withColumn(out, F.coalesce("__w", F.lit(False))).drop("__w")


def hash_half(key: Column) -> Column:
    """0 or 1 from the first 32 bits of sha1: the split into calibration and evaluation halves."""
    return F.pmod(F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("bigint"), F.lit(2)).cast("int")


def score_curve(df: DataFrame, by: list[str], score: str, correct: str) -> DataFrame:
    """At each distinct score t of a group: rows with score <= t and the wrong ones among them, cumulated over distinct scores."""
    per = df.groupBy(*by, F.col(score).alias("t")).agg(F.count("*").alias("__n"), F.count_if(~F.coalesce(F.col(correct), F.lit(False))).alias("__w"))
    w = W.Window.partitionBy(*by).orderBy("t").rowsBetween(W.Window.unboundedPreceding, 0)
    return per.select(*by, "t", F.sum("__n").over(w).alias("n"), F.sum("__w").over(w).alias("wrong"))


def conformal_threshold(df: DataFrame, by: list[str], score: str, correct: str, target: float, least: int = 20) -> DataFrame:
    """Largest risk score t such that proceeding at or below it errs at most ``target``, with ``least`` rows or more; null if none.

    Give it the calibration half only (:func:`hash_half`)."""
    curve = score_curve(df, by, score, correct)
    ok = (F.col("n") >= least) & (F.col("wrong") <= F.col("n") * target)
    return curve.groupBy(*by).agg(F.max(F.when(ok, F.col("t"))).alias("threshold"))


def budget_threshold(df: DataFrame, by: list[str], score: str, rate: float) -> DataFrame:
    """Score above which escalating comes nearest to ``rate`` of the rows; the lower threshold wins ties.

    Candidates are the distinct scores and one below them all, which escalates everything."""
    curve = score_curve(df.withColumn("__ok", F.lit(True)), by, score, "__ok").select(*by, F.col("t").cast("double").alias("t"), "n")
    total = df.groupBy(*by).agg(F.count("*").alias("__total"), (F.min(score).cast("double") - 1e-12).alias("__below"))
    all_ = total.select(*by, F.col("__below").alias("t"), F.lit(0).cast("long").alias("n"))
    got = curve.unionByName(all_).join(total, by).withColumn("rate", 1 - F.col("n") / F.col("__total"))
    best = F.min(F.struct(F.abs(F.col("rate") - rate).alias("gap"), F.col("t"), F.col("rate")))
    return got.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.t").alias("threshold"), F.col("b.rate").alias("rate"))


def frontier(df: DataFrame, by: list[str], score: str, tie: str, correct: str, weak: str, grid: list[float]) -> DataFrame:
    """Failure and weak failure when the riskiest rows are escalated, for each autonomy in ``grid``.

    Rows are ranked once by group; the grid reads cumulative counts at its cut-offs instead of multiplying the rows."""
    w = W.Window.partitionBy(*by)
    order = w.orderBy(F.col(score).desc(), F.col(tie).desc())
    wrong = (~F.coalesce(F.col(correct), F.lit(False))).cast("int")
    ranked = df.select(*by, F.row_number().over(order).alias("__rn"), F.sum(wrong).over(order.rowsBetween(W.Window.unboundedPreceding, 0)).alias("__cw"), F.sum(wrong * F.col(weak).cast("int")).over(order.rowsBetween(W.Window.unboundedPreceding, 0)).alias("__cww"))
    total = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(wrong).alias("__w"), F.sum(wrong * F.col(weak).cast("int")).alias("__ww"), F.count_if(weak).alias("__weak"))
    cuts = total.select("*", F.explode(F.array(*[F.lit(float(a)) for a in grid])).alias("autonomy")).withColumn("__k", F.bround((1 - F.col("autonomy")) * F.col("n"), 0).cast("long"))
    hit = cuts.join(ranked.withColumnRenamed("__rn", "__k"), [*by, "__k"], "left")
    return hit.select(*by, "autonomy", ratio(F.col("__w") - F.coalesce("__cw", F.lit(0)), F.col("n")).alias("failure"), ratio(F.col("__ww") - F.coalesce("__cww", F.lit(0)), F.col("__weak")).alias("weak_failure"))


def missingness(df: DataFrame, keys: list[str], observed: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~observed).alias("missing"), F.avg(F.when(observed, 0.0).otherwise(1.0)).alias("rate"))


def propensity(df: DataFrame, keys: list[str], observed: Column, out: str = "p_obs") -> DataFrame:
    """Add the share of observed rows in the row's cell of ``keys``: a saturated model of being observed."""
    cells = df.groupBy(*keys).agg(F.avg(F.when(observed, 1.0).otherwise(0.0)).alias(out))
    return df.join(cells, keys, "left")


def weight(p: Column, default: float = 0.5, floor: float = 1e-3, cap: float = 20.0) -> Column:
    """Inverse-probability weight; unknown probabilities count as ``default``."""
    return F.least(1 / F.greatest(F.coalesce(p, F.lit(default)), F.lit(floor)), F.lit(cap))


def three_modes(df: DataFrame, by: list[str], observed: Column, bad: Column, p: Column) -> DataFrame:
    """Share of ``bad`` rows by group: among the observed (complete), with the unobserved counted bad (conservative) and
    among the observed weighted by inverse probability (ipw)."""
    w = F.when(observed, weight(p))
    hit = observed & F.coalesce(bad, F.lit(False))
    return df.groupBy(*by).agg(
        ratio(F.count_if(hit), F.count_if(observed)).alias("complete"), ratio(F.count_if(hit | ~observed), F.count("*")).alias("conservative"), F.try_divide(F.sum(F.when(hit, w).otherwise(0.0)), F.sum(w)).alias("ipw"),
    )


def mnar_bounds(df: DataFrame, by: list[str], observed: Column, bad: Column, alpha: float = 0.5) -> DataFrame:
    """Bounds of the bad share when a share ``alpha`` of the unobserved rows would count, with none or all of them bad."""
    hit, n = F.count_if(observed & F.coalesce(bad, F.lit(False))), F.count_if(observed)
    extra = F.count_if(~observed) * alpha
    return df.groupBy(*by).agg(F.try_divide(hit.cast("double"), n + extra).alias("lower"), F.try_divide(hit + extra, n + extra).alias("upper"))


def reduction(first: Column, second: Column) -> Column:
    """Relative fall from the first rate to the second; null unless the first is above 0."""
    return F.when(first > 0, (first - second) / F.nullif(first, F.lit(0.0)))


def condition_reduction(rates: DataFrame, modes: list[str], by: str = "model", condition: str = "condition", first: int = 1, second: int = 4) -> DataFrame:
    """Mean over groups of each mode's rate under two conditions and of its relative fall: (mode, c_first, c_second, reduction, groups)."""
    pick = lambda m, k: F.max(F.when(F.col(condition) == k, F.col(m)))
    wide = rates.groupBy(by).agg(*[x for m in modes for x in (pick(m, first).alias(f"{m}_1"), pick(m, second).alias(f"{m}_2"))])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"{m}_1").alias("a"), F.col(f"{m}_2").alias("b")) for m in modes])).alias("x")).select("x.*")
    return long.groupBy("mode").agg(F.avg("a").alias("c_first"), F.avg("b").alias("c_second"), F.avg(reduction(F.col("a"), F.col("b"))).alias("reduction"), F.count("a").alias("groups"))


def reduction_bounds(bounds: DataFrame, by: str = "model", condition: str = "condition", first: int = 1, second: int = 4) -> DataFrame:
    """Worst and best relative fall by group from :func:`mnar_bounds` by (group, condition)."""
    pick = lambda m, k: F.max(F.when(F.col(condition) == k, F.col(m)))
    wide = bounds.groupBy(by).agg(pick("lower", first).alias("l1"), pick("upper", first).alias("u1"), pick("lower", second).alias("l2"), pick("upper", second).alias("u2"))
    return wide.select(by, reduction(F.col("l1"), F.col("u2")).alias("worst"), reduction(F.col("u1"), F.col("l2")).alias("best"))


def logistic(df: DataFrame, features: list[str], label: str, ridge: float = 1e-6, rounds: int = 30):
    """Coefficients (intercept first) of a logistic regression on numeric features by Newton's method.

    Each round is one pass that returns a gradient and a Hessian, (k + 1)(k + 4)/2 numbers, however many rows there are."""
    import numpy as np

    k = len(features) + 1
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    y = F.when(F.col(label), 1.0).otherwise(0.0)
    rows = df.where(F.col(label).isNotNull()).dropna(subset=features).select(*[c.alias(f"x{i}") for i, c in enumerate(x)], y.alias("y"))
    beta = np.zeros(k)
    for _ in range(rounds):
        eta = sum((F.col(f"x{i}") * float(beta[i]) for i in range(1, k)), F.lit(float(beta[0])))
        p = 1 / (1 + F.exp(-eta))
        g = [F.sum(F.col(f"x{i}") * (F.col("y") - p)) for i in range(k)]
        h = [F.sum(F.col(f"x{i}") * F.col(f"x{j}") * p * (1 - p)) for i in range(k) for j in range(i, k)]
        got = list(rows.agg(*g, *h).first())
        if got[0] is None:
            return beta
        grad, hess = np.array(got[:k]) - ridge * beta, np.zeros((k, k))
        hess[np.triu_indices(k)] = got[k:]
        hess = hess + np.triu(hess, 1).T + ridge * np.eye(k)
        step = np.linalg.solve(hess, grad)
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    return beta


def missingness_model(df: DataFrame, categories: list[str], observed: Column, most: int = 500) -> DataFrame:
    """Which categories go with missing records: (term, coefficient, odds_ratio, auc) of a logistic regression on one indicator a category.

    The first value of each column, by text, is the reference; a null value is a category of its own, named null. The area under the curve of the
    fitted risk is the same in each row. More than ``most`` categories raise an error, as each adds a row to the Hessian. No rows: no terms but the
    intercept, which is null then.
    """
    from .metrics import auroc

    spark = df.sparkSession
    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c) for c in categories], (~observed).alias("__missing")).where("__missing is not null")
    levels = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in categories])).alias("l")).select("l.*").distinct()
    known = sorted((r["c"], r["v"]) for r in levels.limit(most + 1).collect())
    if len(known) > most:
        raise ValueError(f"more than {most} categories")
    first = {c: min(v for k, v in known if k == c) for c, _ in known}
    terms = [(c, v) for c, v in known if v != first[c]]
    names = [f"__x{i}" for i in range(len(terms))]
    coded = rows.select("__missing", *[(F.col(c) == F.lit(v)).cast("double").alias(n) for n, (c, v) in zip(names, terms)])
    beta = logistic(coded, names, "__missing") if known else [None]
    risk = sum((F.col(n) * float(b) for n, b in zip(names, beta[1:])), F.lit(0.0))
    area = auroc(coded.select(risk.alias("risk"), "__missing"), [], "risk", "__missing", "auc") if known else spark.range(1).select(F.lit(None).cast("double").alias("auc"))
    listed = [("intercept", *beta[:1]), *((f"{c}={v}", b) for (c, v), b in zip(terms, beta[1:]))]
    out = spark.createDataFrame([(t, None if b is None else float(b)) for t, b in listed], "term string, coefficient double")
    return out.join(F.broadcast(area), how="left").select("term", "coefficient", F.exp("coefficient").alias("odds_ratio"), "auc")
