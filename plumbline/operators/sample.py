"""Sampling, pairing and resampling whose draws depend on hashes of ids, so that they do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.stats import let, normal_cdf, normal_ppf


def order_key(ident: Column, seed: int) -> Column:
    """Pseudo-random order of ids: sha1 of id and seed, which SQL engines share."""
    return F.sha1(F.concat_ws("|", ident.cast("string"), F.lit(str(seed))))


def per_group(df: DataFrame, by: list[str], n: Column | int, order: list) -> DataFrame:
    """The first n rows of each group in ``order``; n may be a column that is constant in the group."""
    w = W.Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def stratified(df: DataFrame, by: str, total: int, order: list) -> DataFrame:
    """About ``total`` rows in equal shares of the groups of ``by`` in ``order``; what small groups cannot give is filled from the rest.

    Shares are floor(total / groups), the remainder going to the first groups by name; the fill is the rest's first rows by (order, group).
    """
    w = W.Window.partitionBy(by).orderBy(*order)
    groups = df.select(by).distinct()
    k = groups.withColumn("__g", F.row_number().over(W.Window.partitionBy(F.lit(0)).orderBy(by))).withColumn("__k", F.count("*").over(W.Window.partitionBy(F.lit(0))))
    share = (F.floor(F.lit(total) / F.col("__k")) + F.when(F.col("__g") <= F.lit(total) % F.col("__k"), 1).otherwise(0)).alias("__share")
    ranked = df.withColumn("__rn", F.row_number().over(w)).join(k.select(by, share), by)
    took = ranked.where("__rn <= __share")
    lack = total - took.count()
    if lack <= 0:
        return took.drop("__rn", "__share")
    rest = ranked.where("__rn > __share").orderBy("__rn", by).limit(lack)
    return took.unionByName(rest).drop("__rn", "__share")


def balanced(df: DataFrame, label: str, n: int, ident: str, seed: int) -> DataFrame:
    """n / 2 rows of each value of a binary label, in hash order."""
    return per_group(df, [label], n // 2, [order_key(F.col(ident), seed)])


def pair_quota(df: DataFrame, pair: list[str], stratum: str, ident: str, seed: int, cap: int | None = None) -> DataFrame:
    """As many rows of each stratum as the pair's rarest one has, in hash order; then at most ``cap`` a stratum."""
    counts = df.groupBy(*pair, stratum).agg(F.count("*").alias("__n"))
    quota = counts.groupBy(*pair).agg(F.min("__n").alias("__q"))
    rows = per_group(df.join(quota, pair), [*pair, stratum], F.col("__q"), [order_key(F.col(ident), seed)]).drop("__q")
    return per_group(rows, [stratum], cap, [order_key(F.col(ident), seed + 1)]) if cap else rows


def one_per_source(df: DataFrame, by: list[str], source: str, n: int, order: list) -> DataFrame:
    """n rows of each group, one of each source first, then by ``order``."""
    inner = W.Window.partitionBy(*by, source).orderBy(*order)
    ranked = df.withColumn("__first", (F.row_number().over(inner) > 1).cast("int"))
    return per_group(ranked, by, n, ["__first", *order]).drop("__first")


def _draw(ident: Column, replicate: Column, seed: int, portable: bool) -> Column:
    """Hash of a row in a replicate: xxhash64, or sha1, which other engines have too but which costs some fifty times as much."""
    return F.sha1(F.concat_ws("|", ident.cast("string"), replicate.cast("string"), F.lit(str(seed)))) if portable else F.xxhash64(ident, replicate, F.lit(seed))


#: Rounds that scatter integer ids over 31 bits, each (factor, term, factor of the replicate, shift): multiplication carries upwards, the shifted
#: exclusive or downwards.
MASK = (1 << 31) - 1
ROUNDS = ((73244475, 42, 40503001, 15), (48271069, 12345, 0, 14), (65537111, 7, 16807003, 16))


def scattered(ident: Column, replicate: Column, seed: int) -> Column:
    """A number from 0 to 1 for an integer id in a replicate, from arithmetic that SQL engines share and that stays in compiled code. The lower
    31 bits of ids count, and of replicates the lower 31."""
    x, r = ident.cast("bigint").bitwiseAND(MASK), replicate.cast("bigint").bitwiseAND(MASK)
    for factor, term, stride, shift in ROUNDS:
        x = (x * factor + r * stride + (term + seed)).bitwiseAND(MASK)
        x = x.bitwiseXOR(F.shiftright(x, shift))
    return x / F.lit(float(1 << 31))


def scattered_sql(ident: str, replicate: str, seed: int) -> str:
    """:func:`scattered` as SQL."""
    x, r = f"(({ident})::BIGINT & {MASK})", f"(({replicate})::BIGINT & {MASK})"
    for factor, term, stride, shift in ROUNDS:
        x = f"(({x} * {factor} + {r} * {stride} + {term + seed}) & {MASK})"
        x = f"xor({x}, {x} >> {shift})"
    return f"({x} / 2147483648.0::DOUBLE)"


def poisson_edges() -> list[float]:
    """Distribution function of Poisson(1) at 0 to 7; what lies beyond counts as 8."""
    mass, edges = 0.36787944117144233, []
    for k in range(8):
        edges.append((edges[-1] if edges else 0.0) + mass)
        mass /= k + 1
    return edges


def _uniform(ident: Column, replicate: Column, seed: int, portable: bool) -> Column:
    return scattered(ident, replicate, seed) if portable else F.pmod(F.xxhash64(ident, replicate, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _poisson(u: Column) -> Column:
    return sum(((u >= F.lit(e)).cast("int") for e in poisson_edges()), F.lit(0))


def poisson_weight(ident: Column, replicate: Column, seed: int, portable: bool = False) -> Column:
    """A Poisson(1) number of draws of a row in a replicate, from a hash: the bootstrap of independent rows."""
    return let(_uniform(ident, replicate, seed, portable), _poisson)


def bootstrap(df: DataFrame, by: list[str], ident: str, measures: dict[str, Column], replicates: int, seed: int = 42, weight: str = "weight", portable: bool = False) -> DataFrame:
    """Replicates of aggregates: (by, replicate, measures), where each measure is an aggregate of columns and ``weight``.

    A row's weight in a replicate is a Poisson(1) draw, the bootstrap of independent rows, from a hash of its id; ``portable`` draws, for integer ids, are
    those of :func:`scattered`, which SQL can make too. Rows are multiplied by replicates on the map side only, in compiled code: what is
    shuffled is one partial row a (group, replicate) and task.
    """
    grown = df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    grown = grown.withColumn("__draw", _uniform(F.col(ident), F.col("replicate"), seed, portable)).where(F.col("__draw") >= poisson_edges()[0])
    grown = grown.withColumn(weight, _poisson(F.col("__draw"))).drop("__draw")  # a column of its own, so that the draw is made once
    return grown.groupBy(*by, "replicate").agg(*[m.alias(n) for n, m in measures.items()])


def percentile_interval(reps: DataFrame, by: list[str], measure: str, level: float = 0.95) -> DataFrame:
    a = (1 - level) / 2
    return reps.groupBy(*by).agg(F.percentile(measure, F.lit(a)).alias("lo"), F.percentile(measure, F.lit(1 - a)).alias("hi"), F.count(measure).alias("replicates"))


def bca_interval(df: DataFrame, by: list[str], ident: str, value: str, replicates: int, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Bias-corrected accelerated interval of a mean by group. The jackknife of a mean is closed form, so acceleration comes from central moments; fewer than two rows: null."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull())
    base = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("__m2"), F.skewness(v).alias("__skew"))
    reps = bootstrap(rows, by, ident, {"m": F.try_divide(F.sum(v * F.col("weight")), F.sum("weight").cast("double"))}, replicates, seed)
    below = reps.join(base, by).groupBy(*by).agg(((F.count_if(F.col("m") < F.col("mean")) + 0.5 * F.count_if(F.col("m") == F.col("mean"))) / F.count("m")).alias("__b"), F.sort_array(F.collect_list("m")).alias("__s"))
    j = base.join(below, by)
    z0 = normal_ppf(F.least(F.greatest(F.col("__b"), F.lit(0.5 / replicates)), F.lit(1 - 0.5 / replicates)))
    accel = F.coalesce(F.when(F.col("__m2") > 0, F.col("__skew")), F.lit(0.0)) / (6 * F.sqrt(F.col("n").cast("double")))

    def end(p: float) -> Column:
        q = let(F.struct(z0.alias("z0"), (z0 + normal_ppf(F.lit(p))).alias("z"), accel.alias("a")), lambda s: normal_cdf(s["z0"] + s["z"] / (1 - s["a"] * s["z"])))
        return F.get("__s", F.least(F.greatest(F.floor(q * F.size("__s")), F.lit(0)), F.size("__s") - 1).cast("int"))

    a = (1 - level) / 2
    return j.select(*by, "n", "mean", F.when(F.col("n") > 1, end(a)).alias("lo"), F.when(F.col("n") > 1, end(1 - a)).alias("hi"))


def permutation_test(df: DataFrame, by: list[str], ident: str, value: str, first: str, replicates: int, seed: int = 42, alternative: str = "two-sided", portable: bool = False) -> DataFrame:
    """Permutation test of the difference of means of the rows where ``first`` holds and the others; p = count / replicates.

    A replicate relabels by the hash order of ids within the group.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(first).isNotNull()).select(*by, ident, F.col(value).cast("double").alias("__v"), F.col(first).alias("__f"))
    size = rows.groupBy(*by).agg(F.count_if("__f").alias("__k"), (F.avg(F.when(F.col("__f"), F.col("__v"))) - F.avg(F.when(~F.col("__f"), F.col("__v")))).alias("observed"))
    grown = rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    w = W.Window.partitionBy(*by, "replicate").orderBy(_draw(F.col(ident), F.col("replicate"), seed, portable), ident)
    drawn = grown.withColumn("__rn", F.row_number().over(w)).join(size, by)
    g = drawn.groupBy(*by, "replicate", "observed").agg((F.avg(F.when(F.col("__rn") <= F.col("__k"), F.col("__v"))) - F.avg(F.when(F.col("__rn") > F.col("__k"), F.col("__v")))).alias("d"))
    tail = {"two-sided": F.abs("d") >= F.abs("observed"), "greater": F.col("d") >= F.col("observed"), "less": F.col("d") <= F.col("observed")}[alternative]
    return g.groupBy(*by).agg(F.first("observed").alias("observed"), (F.count_if(tail) / F.lit(replicates)).alias("p"))


def label_flips(df: DataFrame, ident: str, label: str, flips: int, replicates: int, seed: int = 42, portable: bool = False) -> DataFrame:
    """Rows of each replicate with ``flips`` labels inverted: those with the smallest hashes. Adds replicate.

    The flips of a replicate are taken as a top-k by hash; k times the number of replicates ids, both parameters, are broadcast back to the rows.
    """
    grown = df.select(ident).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("__h", _draw(F.col(ident), F.col("replicate"), seed, portable))
    picked = per_group(grown, ["replicate"], flips, ["__h", ident])
    marked = picked.select("replicate", ident, F.lit(True).alias("__flip"))
    all_ = df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    return all_.join(F.broadcast(marked), ["replicate", ident], "left").withColumn(label, F.when(F.coalesce("__flip", F.lit(False)), ~F.col(label)).otherwise(F.col(label))).drop("__flip")
