"""Ranks, corrections for multiple testing, quantiles and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def average_ranks(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """Add the 1-based rank of ``value`` within ``by``, ties sharing the mean of their places; null stays null.

    Ranks come from counts of distinct values joined back, so the window sees one row a distinct value.
    """
    known = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    w = W.Window.partitionBy(*(by or [F.lit(0)])).orderBy(value).rowsBetween(W.Window.unboundedPreceding, -1)
    known = known.withColumn(out, F.coalesce(F.sum("__n").over(w), F.lit(0)) + (F.col("__n") + 1) / 2.0).drop("__n")
    return df.join(known, [*by, value], "left")


def benjamini_hochberg(df: DataFrame, p: str, by: list[str], order: list[str], out: str = "p_bh") -> DataFrame:
    """Adjusted p-values: the smallest p n / rank from here up, at most 1. For tables of tests, which are small."""
    part = by or [F.lit(0)]
    asc = W.Window.partitionBy(*part).orderBy(p, *order)
    n = F.count(p).over(W.Window.partitionBy(*part))
    raw = df.where(F.col(p).isNotNull()).withColumn("__rn", F.row_number().over(asc)).withColumn("__x", F.col(p) * n / F.col("__rn"))
    up = W.Window.partitionBy(*part).orderBy("__rn").rowsBetween(0, W.Window.unboundedFollowing)
    return raw.withColumn(out, F.least(F.min("__x").over(up), F.lit(1.0))).drop("__rn", "__x")


def holm(df: DataFrame, p: str, by: list[str], order: list[str], out: str = "p_holm") -> DataFrame:
    """Adjusted p-values: the largest p (n - rank + 1) up to here, at most 1."""
    part = by or [F.lit(0)]
    asc = W.Window.partitionBy(*part).orderBy(p, *order)
    n = F.count(p).over(W.Window.partitionBy(*part))
    raw = df.where(F.col(p).isNotNull()).withColumn("__rn", F.row_number().over(asc)).withColumn("__x", F.least(F.col(p) * (n - F.col("__rn") + 1), F.lit(1.0)))
    down = W.Window.partitionBy(*part).orderBy("__rn").rowsBetween(W.Window.unboundedPreceding, 0)
    return raw.withColumn(out, F.max("__x").over(down)).drop("__rn", "__x")


def top_share(df: DataFrame, by: list[str], score: str, tie: str, rate: Column | float, out: str = "top") -> DataFrame:
    """Mark the round-half-even(rate n) rows of each group with the highest (score, tie)."""
    w = W.Window.partitionBy(*by)
    k = F.bround(F.lit(rate) * F.count("*").over(w) if not isinstance(rate, Column) else rate * F.count("*").over(w), 0)
    return df.withColumn(out, F.row_number().over(w.orderBy(F.col(score).desc(), F.col(tie).desc())) <= k)


def quantiles(value: str, q: float) -> dict[str, Column]:
    """Aggregates for the four quantile definitions: linear, nearest rank, lower index, upper index. A group's values are gathered; for groups of any
    size see :func:`quantile_table`."""
    line = F.array_sort(F.collect_list(value))
    n = F.count(value)
    at = lambda i: F.get(line, i.cast("int"))
    return {
        "linear": F.percentile(value, F.lit(q)),
        "nearest": at(F.bround((n - 1) * F.lit(q), 0)),
        "lower": at(F.floor((n - 1) * F.lit(q))),
        "upper": at(F.least(F.ceil(n * F.lit(q)), n) - 1),
    }


def quantile_table(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """(by, linear, nearest, lower, upper): the four quantile definitions of ``value`` by group, nulls left out.

    A place is looked up in the running counts of distinct values, so no group is gathered; the window sees one row a distinct value.
    """
    w = W.Window.partitionBy(*(by or [F.lit(0)]))
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(w.orderBy("__v").rowsBetween(W.Window.unboundedPreceding, 0))
    counts = counts.withColumns({"__to": upto, "__n": F.sum("__c").over(w)})
    n, at = F.col("__n"), (F.col("__n") - 1) * F.lit(q)
    places = {"nearest": F.bround(at, 0), "lower": F.floor(at), "upper": F.least(F.ceil(n * F.lit(q)), n) - 1, "__hi": F.ceil(at)}
    value_at = lambda i: F.max(F.when((i >= F.col("__to") - F.col("__c")) & (i < F.col("__to")), F.col("__v")))
    found = counts.groupBy(*by).agg(*[value_at(i).alias(name) for name, i in places.items()], F.max(at - F.floor(at)).alias("__part"))
    linear = F.col("lower") * (1 - F.col("__part")) + F.col("__hi") * F.col("__part")
    return found.select(*by, linear.alias("linear"), "nearest", "lower", "upper")


def pareto_front(points: DataFrame, key: list[str], up: list[str], down: list[str]) -> DataFrame:
    """Points that no other point dominates: at least as good everywhere and better somewhere. A missing ``up`` value counts as -1; a missing ``down`` value
    is no objection.

    For tables of policies: a left anti-join on the dominance condition, which has no equality, so its cost is the square of the number of points.
    """
    other = points.select(*[F.col(c).alias(f"__{c}") for c in {*key, *up, *down}])
    weak, strict = F.lit(True), F.lit(False)
    for c, sign in [*((c, 1) for c in up), *((c, -1) for c in down)]:
        a, b = F.col(f"__{c}") * sign, F.col(c) * sign
        if sign > 0:
            a, b = F.coalesce(a, F.lit(-1.0)), F.coalesce(b, F.lit(-1.0))
        weak = weak & (a.isNull() | b.isNull() | (a >= b))
        strict = strict | F.coalesce(a > b, F.lit(False))
    return points.join(F.broadcast(other) if points.count() <= 100_000 else other, weak & strict, "left_anti")


def majority(df: DataFrame, by: list[str], label: str, first: str) -> DataFrame:
    """Commonest label of each group; ties go to the label seen first in ``first``."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("__n"), F.min(first).alias("__f"))
    return counts.groupBy(*by).agg(F.max_by(label, F.struct(F.col("__n"), (-F.col("__f")).alias("f"))).alias("majority"), F.max("__n").alias("votes"))


def rank_agreement(df: DataFrame, by: list[str], stated: str, actual: str) -> DataFrame:
    """Spearman's rho of stated and actual places, which have no ties, by group; null below two rows."""
    d = F.col(stated) - F.col(actual)
    n = F.count("*")
    return df.groupBy(*by).agg(F.when(n >= 2, 1 - F.sum(d * d) * 6.0 / F.nullif(n * (n * n - 1), F.lit(0))).alias("agreement"))
