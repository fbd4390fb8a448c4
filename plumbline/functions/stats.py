"""Statistics as aggregates and columns. Undefined values are null, never NaN or an error."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .ranks import average_ranks


def _both(x: Column, y: Column) -> Column:
    return x.isNotNull() & y.isNotNull()


def pearson(x: Column, y: Column, least: int = 2) -> Column:
    """Correlation (aggregate) over rows where both are known; null with fewer than ``least`` rows or a constant side."""
    ok = _both(x, y)
    a, b = F.when(ok, x.cast("double")), F.when(ok, y.cast("double"))
    n = F.count(a)
    va, vb = F.var_pop(a), F.var_pop(b)
    defined = (n >= least) & (va > 0) & (vb > 0)
    return F.when(defined, F.greatest(F.least(F.covar_pop(a, b) / F.nullif(F.sqrt(va) * F.sqrt(vb), F.lit(0.0)), F.lit(1.0)), F.lit(-1.0)))


def slope(x: Column, y: Column) -> Column:
    ok = _both(x, y)
    a, b = F.when(ok, x.cast("double")), F.when(ok, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.var_pop(a))


def ols(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Slope, intercept, R2, standard error and t of y on x by group."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.where(_both(F.col(x), F.col(y)))
    m = rows.groupBy(*by).agg(F.count("*").alias("n"), slope(a, b).alias("slope"), F.avg(a).alias("__mx"), F.avg(b).alias("__my"), F.var_pop(a).alias("__vx"), F.var_pop(b).alias("__vy"), F.pow(pearson(a, b), F.lit(2.0)).alias("r2"))
    se = F.sqrt(F.try_divide((1 - F.col("r2")) * F.col("__vy"), F.when(F.col("n") > 2, F.col("__vx") * (F.col("n") - 2))))
    m = m.withColumn("intercept", F.col("__my") - F.col("slope") * F.col("__mx")).withColumn("se", se)
    return m.withColumn("t", F.try_divide(F.col("slope"), F.col("se"))).drop("__mx", "__my", "__vx", "__vy")


def spearman(df: DataFrame, by: list[str], x: str, y: str, least: int = 3, out: str = "rho") -> DataFrame:
    """Rank correlation by group over rows where both are known, ties sharing ranks."""
    rows = df.where(_both(F.col(x), F.col(y))).select(*by, F.col(x).alias("__x"), F.col(y).alias("__y"))
    ranked = average_ranks(average_ranks(rows, "__x", by, "__rx"), "__y", by, "__ry")
    return ranked.groupBy(*by).agg(pearson(F.col("__rx"), F.col("__ry"), least).alias(out), F.count("*").alias("n"))


def partial(xy: Column, xz: Column, yz: Column) -> Column:
    """First-order partial correlation from three correlations."""
    rest = (1 - xz * xz) * (1 - yz * yz)
    return F.try_divide(xy - xz * yz, F.when(rest > 1e-12, F.sqrt(F.greatest(rest, F.lit(0.0)))))


def kendall_tau(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Kendall's tau-b by group; null where a side is constant.

    Concordant less discordant pairs are counted bit by bit of the dense rank of y: two rows part at the highest bit in which their ranks differ, so
    every pair is met once, among the rows that share the bits above it, by running sums in the order of x. Work is n log n in a group's distinct (x, y),
    which are never gathered into one value; ties cost nothing.
    """
    group = W.Window.partitionBy(*by)
    cells = df.where(_both(F.col(x), F.col(y))).groupBy(*by, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).agg(F.count("*").cast("double").alias("__c"))
    ranked = cells.withColumn("__r", F.dense_rank().over(group.orderBy("__y")).cast("long") - 1)
    ranked = ranked.withColumn("__bits", F.length(F.bin(F.max("__r").over(group))))
    split = ranked.select(*by, "__x", "__c", "__r", F.explode(F.sequence(F.lit(0), F.col("__bits") - 1)).alias("__l"))
    split = split.withColumns({"__above": F.expr("shiftright(__r, __l + 1)"), "__one": F.expr("shiftright(__r, __l) % 2 = 1")})
    sides = split.groupBy(*by, "__l", "__above", "__x").agg(*[F.sum(F.when(side, F.col("__c")).otherwise(0.0)).alias(n) for n, side in (("__c0", ~F.col("__one")), ("__c1", F.col("__one")))])
    before = W.Window.partitionBy(*by, "__l", "__above").orderBy("__x").rowsBetween(W.Window.unboundedPreceding, -1)
    sides = sides.withColumns({"__b0": F.sum("__c0").over(before), "__b1": F.sum("__c1").over(before)})
    zero = F.lit(0.0)

    def part(rows: DataFrame, **sums: Column) -> DataFrame:
        return rows.groupBy(*by).agg(*[F.sum(sums.get(n, zero)).alias(n) for n in ("s", "n", "xx", "yy")])

    squares = lambda c: cells.groupBy(*by, c).agg(F.sum("__c").alias("__c"))
    parts = part(sides, s=F.coalesce(F.col("__c1") * F.col("__b0") - F.col("__c0") * F.col("__b1"), zero))
    parts = parts.union(part(squares("__x"), n=F.col("__c"), xx=F.col("__c") * F.col("__c"))).union(part(squares("__y"), yy=F.col("__c") * F.col("__c")))
    total = parts.groupBy(*by).agg(*[F.sum(n).alias(f"__{n}") for n in ("s", "n", "xx", "yy")])
    untied = lambda c: F.sqrt((F.col("__n") * F.col("__n") - F.col(c)) / 2)
    return total.select(*by, F.try_divide(F.col("__s"), untied("__xx") * untied("__yy")).alias("tau"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function by Abramowitz and Stegun 7.1.26; error below 1.5e-7."""
    return let(z, _cdf)


def _cdf(z: Column) -> Column:
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x * 0.3275911)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


#: Coefficients of Acklam's rational approximation of the normal quantile.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _horner(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_ppf(p: Column) -> Column:
    """Standard normal quantile; null outside (0, 1)."""
    return let(p, _ppf)


def _ppf(p: Column) -> Column:
    q = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    tail = _horner(_C, q) / (_horner(_D, q) * q + 1)
    r = (p - 0.5) * (p - 0.5)
    middle = _horner(_A, r) * (p - 0.5) / (_horner(_B, r) * r + 1)
    return F.when((p <= 0) | (p >= 1), None).when(p < 0.02425, tail).when(p > 1 - 0.02425, -tail).otherwise(middle)


def spearman_p(rho: Column, n: Column) -> Column:
    """Two-sided p-value of a rank correlation by the normal approximation of its t, which is rho times the root of n - 2; null below
    three rows, 0 at a perfect correlation."""
    return F.when(n >= 3, F.when(F.abs(rho) >= 1, 0.0).otherwise(2 * (1 - normal_cdf(F.abs(rho) * F.sqrt(n - 2.0)))))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Ends of the Wilson interval of k successes in n."""
    p = F.try_divide(k.cast("double"), n.cast("double"))
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, F.greatest(mid - half, F.lit(0.0))), F.when(n > 0, F.least(mid + half, F.lit(1.0)))


def cohens_d(value: Column, first: Column, pooled: bool = True) -> Column:
    """Standardised difference of means (aggregate) of the rows where ``first`` holds and the others."""
    a, b = F.when(first, value.cast("double")), F.when(~first, value.cast("double"))
    na, nb = F.count(a), F.count(b)
    if pooled:
        sd = F.sqrt(F.try_divide((na - 1) * F.var_samp(a) + (nb - 1) * F.var_samp(b), (na + nb - 2).cast("double")))
    else:
        sd = F.stddev_samp(b)
    return F.try_divide(F.avg(a) - F.avg(b), F.when(sd > 1e-10, sd))


def paired_d(difference: Column) -> Column:
    sd = F.stddev_samp(difference)
    return F.try_divide(F.avg(difference), F.when(sd > 1e-10, sd))


def mann_whitney(df: DataFrame, by: list[str], value: str, first: str) -> DataFrame:
    """U of the rows where ``first`` holds, its z without tie correction, and the two-sided normal p."""
    ranked = average_ranks(df.where(_both(F.col(value), F.col(first))).select(*by, value, first), value, by, "__r")
    g = ranked.groupBy(*by).agg(F.sum(F.when(F.col(first), F.col("__r"))).alias("s"), F.count_if(F.col(first)).alias("a"), F.count_if(~F.col(first)).alias("b"))
    u = F.col("s") - F.col("a") * (F.col("a") + 1) / 2.0
    z = F.try_divide(u - F.col("a") * F.col("b") / 2.0, F.sqrt(F.col("a") * F.col("b") * (F.col("a") + F.col("b") + 1) / 12.0))
    return g.select(*by, u.alias("u"), z.alias("z"), (2 * (1 - normal_cdf(F.abs(z)))).alias("p"))


def _signed_rank_tail(n: int) -> list[float]:
    """P(W+ <= w) for w = 0, 1, ...: the share of the subsets of 1 to n with a sum of at most w."""
    ways = [1]
    for k in range(1, n + 1):
        ways = [(ways[w] if w < len(ways) else 0) + (ways[w - k] if w >= k else 0) for w in range(len(ways) + k)]
    total, out = 0, []
    for count in ways:
        total += count
        out.append(total / 2**n)
    return out


def signed_rank_p(n: Column, w: Column) -> Column:
    """Exact two-sided p of a signed-rank statistic of n differences without ties. One row a group, in Arrow batches."""

    @F.pandas_udf("double")
    def exact(n: pd.Series, w: pd.Series) -> pd.Series:
        tails = {int(k): _signed_rank_tail(int(k)) for k in n.dropna().unique()}

        def p(k, v):
            if k != k or v != v:
                return None
            low, top = tails[int(k)], int(k) * (int(k) + 1) // 2
            return min(1.0, 2 * low[min(int(v), top - int(v))])

        return pd.Series([p(k, v) for k, v in zip(n, w)], dtype="float64")

    return exact(n.cast("double"), w)


#: Differences up to which the signed-rank test is exact where it has neither ties nor zeros.
EXACT = 50


def wilcoxon(df: DataFrame, by: list[str], difference: str) -> DataFrame:
    """Signed-rank statistic W+ of the non-zero differences with its two-sided p: exact for at most 50 differences without ties and zeros, else by the
    normal approximation with the correction for ties. Fewer than three: null; all zero: p 1."""
    rows = df.where(F.col(difference).isNotNull()).select(*by, F.col(difference).alias("__d"))
    sized = rows.where("__d <> 0").withColumn("__a", F.abs("__d"))
    ranked = average_ranks(sized, "__a", by, "__r")
    g = ranked.groupBy(*by).agg(F.sum(F.when(F.col("__d") > 0, F.col("__r")).otherwise(0.0)).alias("w"), F.count("*").alias("n"))
    t = F.col("__t").cast("double")
    ties = sized.groupBy(*by, "__a").agg(F.count("*").alias("__t")).groupBy(*by).agg(F.sum(t * t * t - t).alias("ties"))
    all_ = rows.groupBy(*by).agg(F.count("*").alias("rows"))
    n = F.col("n")
    z = F.try_divide(F.col("w") - n * (n + 1) / 4.0, F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24.0))
    alone = (F.col("ties") == 0) & (n == F.col("rows")) & (n <= EXACT)
    joined = all_.join(g, by, "left").join(ties, by, "left").withColumn("exact", signed_rank_p(F.when(alone, n), F.when(alone, F.col("w"))))
    p = F.when(n.isNull(), 1.0).otherwise(F.coalesce("exact", 2 * (1 - normal_cdf(F.abs(z)))))
    return joined.select(*by, F.col("w"), F.when(F.col("rows") >= 3, p).alias("p"))


def friedman(df: DataFrame, block: str, treatment: str, value: str, ranked: bool = True) -> DataFrame:
    """Friedman's chi-square over complete blocks; ``ranked=False`` uses the values themselves in place of ranks."""
    rows = df.where(F.col(value).isNotNull()).select(block, treatment, value)
    rows = average_ranks(rows, value, [block], "__r") if ranked else rows.withColumn("__r", F.col(value).cast("double"))
    sums = rows.groupBy(treatment).agg(F.sum("__r").alias("s"), F.count("*").alias("n"))
    g = sums.agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n"), F.count("*").alias("k"))
    n, k = F.col("n"), F.col("k")
    return g.select((F.col("ss") * 12.0 / (n * k * (k + 1)) - n * (k + 1) * 3.0).alias("chi2"), n.alias("blocks"), k.alias("treatments"))


def cohen_kappa(df: DataFrame, a: str, b: str, certain: float = 1.0) -> DataFrame:
    """Cohen's kappa of two label columns; ``certain`` is the value where chance agreement is 1."""
    rows = df.where(_both(F.col(a), F.col(b)))
    cells = rows.groupBy(F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")).agg(F.count("*").alias("c"))
    n = cells.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)).alias("agree"))
    left, right = cells.groupBy("x").agg(F.sum("c").alias("cx")), cells.groupBy("y").agg(F.sum("c").alias("cy"))
    pe = left.join(right, F.col("x") == F.col("y")).agg(F.coalesce(F.sum(F.col("cx") * F.col("cy")), F.lit(0)).alias("e"))
    out = n.crossJoin(pe).select("n", (F.col("agree") / F.col("n")).alias("po"), (F.col("e") / (F.col("n") * F.col("n"))).alias("pe"))
    return out.select("n", "po", "pe", F.when(F.col("pe") >= 1, certain).otherwise((F.col("po") - F.col("pe")) / F.nullif(1 - F.col("pe"), F.lit(0.0))).alias("kappa"))


def fleiss_kappa(df: DataFrame, item: str, label: str) -> DataFrame:
    """Fleiss' kappa over items that all have the same number of ratings; items with another number than the largest are left out."""
    per = df.where(F.col(label).isNotNull()).groupBy(item, F.col(label).cast("string").alias("l")).agg(F.count("*").alias("c"))
    items = per.groupBy(item).agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("ss"))
    most = items.agg(F.max("m").alias("r"))
    full = items.crossJoin(F.broadcast(most)).where("m = r and r > 1")
    p = full.agg(F.avg((F.col("ss") - F.col("r")) / (F.col("r") * (F.col("r") - 1))).alias("pbar"), F.count("*").alias("items"), F.max("r").alias("r"))
    shares = per.join(full.select(item), item, "left_semi").groupBy("l").agg(F.sum("c").alias("c")).crossJoin(F.broadcast(p))
    pe = shares.groupBy("pbar", "items").agg(F.sum(F.pow(F.col("c") / (F.col("items") * F.col("r")), F.lit(2.0))).alias("pe"))
    return pe.select("items", F.try_divide(F.col("pbar") - F.col("pe"), 1 - F.col("pe")).alias("kappa"))


def chi_square(df: DataFrame, a: str, b: str, yates: bool = True) -> DataFrame:
    """Pearson's chi-square of independence with its degrees of freedom; 2x2 tables take Yates' correction if asked."""
    rows = df.where(_both(F.col(a), F.col(b)))
    cells = rows.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("c"))
    left, right = cells.groupBy("x").agg(F.sum("c").alias("cx")), cells.groupBy("y").agg(F.sum("c").alias("cy"))
    n = cells.agg(F.sum("c").alias("n"), F.count_distinct("x").alias("kx"), F.count_distinct("y").alias("ky"))
    grid = left.crossJoin(right).join(cells, ["x", "y"], "left").crossJoin(F.broadcast(n))
    e = F.col("cx") * F.col("cy") / F.col("n")
    gap = F.abs(F.coalesce("c", F.lit(0)) - e)
    two = (F.col("kx") == 2) & (F.col("ky") == 2)
    gap = F.when(two & F.lit(yates), F.greatest(gap - F.least(gap, F.lit(0.5)), F.lit(0.0))).otherwise(gap)
    return grid.groupBy("n", "kx", "ky").agg(F.sum(gap * gap / e).alias("chi2")).select("n", "chi2", ((F.col("kx") - 1) * (F.col("ky") - 1)).alias("df"))
