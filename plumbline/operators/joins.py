"""Joins and de-duplication with a stated winner."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..session import shared_folder


def first_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in ``order``. The order must be total for a repeatable result.

    With one plain ordering the winner is a grouped minimum of a struct, combined before the shuffle; a window would
    bring every duplicate of a hot key to one task.
    """
    rest = [c for c in df.columns if c not in key]
    ordered = F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("__row"))
    return df.groupBy(*key).agg(F.min(ordered).alias("__w")).select(*key, *[F.col(f"__w.__row.{c}").alias(c) for c in rest])


def last_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the last in ``order``."""
    rest = [c for c in df.columns if c not in key]
    ordered = F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("__row"))
    return df.groupBy(*key).agg(F.max(ordered).alias("__w")).select(*key, *[F.col(f"__w.__row.{c}").alias(c) for c in rest])


def merge_new(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Union that keeps existing rows and adds new keys only."""
    return existing.unionByName(new.join(existing.select(*key), key, "left_anti"), allowMissingColumns=True)


def merge_retries(main: DataFrame, retries: DataFrame, key: list[str], ok: str) -> DataFrame:
    """Replace failed rows of ``main`` by successful retries of the same key; nothing else changes."""
    good = retries.where(F.col(ok))
    rest = [c for c in main.columns if c not in key]
    fresh = good.select(*key, F.struct(*rest).alias("__new"))
    joined = main.join(fresh, key, "left")
    use = ~F.coalesce(F.col(ok), F.lit(False)) & F.col("__new").isNotNull()
    return joined.select(*key, *[F.when(use, F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) for c in rest])


def remaining(work: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Work whose key is not done yet (resume)."""
    return work.join(done.select(*key), key, "left_anti")


def packet(traffic: DataFrame, outcomes: DataFrame, costs: DataFrame, key: str, order: dict[str, list[Column]]) -> DataFrame:
    """Inner join of three tables on ``key``; on each side the last duplicate in ``order`` wins."""
    return traffic.join(last_wins(outcomes, [key], order["outcomes"]), key).join(last_wins(costs, [key], order["costs"]), key)


def cyclic_zip(left: DataFrame, right: DataFrame, left_order: list, right_order: list, by: list[str]) -> DataFrame:
    """Pair the i-th row of ``left`` with the (i mod n)-th of the n rows of ``right``, within ``by``."""
    a = left.withColumn("__i", F.row_number().over(W.Window.partitionBy(*by).orderBy(*left_order)) - 1)
    w = W.Window.partitionBy(*by)
    b = right.withColumn("__j", F.row_number().over(w.orderBy(*right_order)) - 1).withColumn("__n", F.count("*").over(w))
    sizes = b.groupBy(*by).agg(F.max("__n").alias("__m"))
    a = a.join(sizes, by).withColumn("__j", F.pmod("__i", "__m"))
    return a.join(b.drop("__n"), [*by, "__j"]).drop("__i", "__j", "__m")


def opposed_pairs(capability: DataFrame, strong: float, weak: float) -> DataFrame:
    """(strong model, weak model, domain, gap): pairs that differ on a domain, an equi-join on domain."""
    s = capability.where(F.col("natural_acc") >= strong).select("domain", F.col("model").alias("strong_model"), F.col("natural_acc").alias("__s"))
    w = capability.where(F.col("natural_acc") <= weak).select("domain", F.col("model").alias("weak_model"), F.col("natural_acc").alias("__w"))
    return s.join(w, "domain").where("strong_model <> weak_model").select("strong_model", "weak_model", "domain", (F.col("__s") - F.col("__w")).alias("gap"))


def crossed_pairs(capability: DataFrame, strong: float, weak: float) -> DataFrame:
    """Models a < b where a is strong and b weak on one domain and the reverse holds on another.

    Two opposed pairs are joined on the pair of models, so no cross join of models is formed."""
    pairs = opposed_pairs(capability, strong, weak)
    one = pairs.select(F.col("strong_model").alias("a"), F.col("weak_model").alias("b"), F.col("domain").alias("domain_a"))
    two = pairs.select(F.col("weak_model").alias("a"), F.col("strong_model").alias("b"), F.col("domain").alias("domain_b"))
    return one.where("a < b").join(two, ["a", "b"])


def nearest(candidates: DataFrame, by: list[str], key: str, target: Column, order: list[str]) -> DataFrame:
    """The candidate of each group with ``key`` nearest to ``target``; ties go by ``order``. A grouped minimum, no sort."""
    rest = [c for c in candidates.columns if c not in by]
    best = F.min(F.struct(F.abs(F.col(key) - target).alias("__d"), *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("__row")))
    return candidates.groupBy(*by).agg(best.alias("__b")).select(*by, *[F.col(f"__b.__row.{c}").alias(c) for c in rest])


def first_pair_of(pairs: DataFrame, left: str, right: str, order: str) -> DataFrame:
    """For each id the first pair that it is in on either side: (id, pair columns)."""
    exploded = pairs.select(F.explode(F.array_distinct(F.array(left, right))).alias("id"), "*")
    return first_wins(exploded, ["id"], [F.col(order)])


def raters_complete(ratings: DataFrame, item: str, rater: str, raters: int) -> DataFrame:
    """Ratings of the items that all ``raters`` have rated."""
    full = ratings.groupBy(item).agg(F.count_distinct(rater).alias("__n")).where(F.col("__n") == raters).select(item)
    return ratings.join(full, item, "left_semi")


def similar_pairs(vectors: DataFrame, by: str, item: str, vector: str, threshold: float, block: int = 512) -> DataFrame:
    """Pairs i < j of a group with cosine at least ``threshold``: (by, i, j, cosine).

    Rows meet in pairs of blocks, so that a task holds two blocks whatever the group's size; products are matrix products.
    """
    import numpy as np
    import pandas as pd

    sizes = vectors.groupBy(by).agg(F.count("*").alias("__n"))
    n = F.ceil(F.col("__n") / F.lit(block)).cast("long")
    dealt = vectors.where(F.col(vector).isNotNull()).select(by, item, F.transform(vector, lambda x: x.cast("double")).alias("__v")).join(sizes, by).withColumn("__side", F.pmod(F.xxhash64(item), n))
    dealt = dealt.withColumn("__with", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    dealt = dealt.select(by, item, "__v", "__side", F.least("__side", "__with").alias("__lo"), F.greatest("__side", "__with").alias("__hi"))
    kind = dict(vectors.dtypes)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = np.array(part["__v"].tolist(), float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        ids, side = part[item].to_numpy(), part["__side"].to_numpy()
        lo, hi = part["__lo"].iloc[0], part["__hi"].iloc[0]
        s = x @ x.T
        keep = (s >= threshold) & (ids[:, None] < ids[None, :])
        if lo != hi:
            keep &= side[:, None] != side[None, :]
        a, b = np.nonzero(keep)
        return pd.DataFrame({by: part[by].iloc[0], "i": ids[a], "j": ids[b], "cosine": s[a, b]})

    return dealt.groupBy(by, "__lo", "__hi").applyInPandas(run, f"{by} {kind[by]}, i {kind[item]}, j {kind[item]}, cosine double")


def greedy_clusters(nodes: DataFrame, edges: DataFrame, by: str, item: str) -> DataFrame:
    """Greedy single-pass clustering: in item order an unassigned item seeds a cluster and takes the unassigned items linked to it.

    ``edges``: (by, i, j), i < j. Equal to taking, again and again, the items all of whose smaller unassigned neighbours are gone as
    seeds; each round is two joins, so no cluster is gathered, and decides at least each group's smallest open item, so rounds go on until none is
    open. Returns (by, item, seed).
    """
    shared_folder(nodes.sparkSession)
    links = edges.select(by, "i", "j")
    open_ = links.select(by, F.col("i").alias("x")).union(links.select(by, F.col("j").alias("x"))).distinct().checkpoint()
    alone = nodes.select(by, F.col(item).alias("x")).join(open_, [by, "x"], "left_anti").select(by, F.col("x").alias(item), F.col("x").alias("seed"))
    out = alone
    links = links.checkpoint()
    for turn in itertools.count(1):
        if open_.isEmpty():
            return out
        seeds = open_.join(links.select(by, F.col("j").alias("x")), [by, "x"], "left_anti")
        taken = links.join(seeds.select(by, F.col("x").alias("i")), [by, "i"]).groupBy(by, F.col("j").alias("x")).agg(F.min("i").alias("seed"))
        done = seeds.select(by, "x", F.col("x").alias("seed")).union(taken).checkpoint()
        out = out.union(done.select(by, F.col("x").alias(item), "seed"))
        if turn % 20 == 0:
            out = out.checkpoint()  # many rounds would otherwise make a union of many parts
        open_ = open_.join(done, [by, "x"], "left_anti").checkpoint()
        gone = done.select(by, "x")
        links = links.join(gone.withColumnRenamed("x", "i"), [by, "i"], "left_anti").join(gone.withColumnRenamed("x", "j"), [by, "j"], "left_anti").checkpoint()
