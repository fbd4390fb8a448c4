"""Mixing sources to target weights: a time-varying curriculum over training positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import checkpoint, global_rank

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Weight schedules over training time 0 to 1, as (time, weight) knots joined by straight lines. Their integrals
#: are 5, 2 and 1: the first kind of source fades, the second is steady, the third grows.
SCHEDULES = (((0.0, 6.0), (1.0, 4.0)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)))
CAP = 3
#: Rows of a slice of the digest order, on average.
SLICE_ROWS = 2_000


def integral(knots) -> float:
    """Area under a schedule: the weight of its source over the whole run."""
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def invert(knots, share: Column) -> Column:
    """Training time at which a source with this schedule has met ``share`` (0 to 1) of its demand: the inverse
    of the schedule's normalised integral, in closed form on each straight piece."""
    total, area, out = integral(knots), 0.0, None
    need = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * F.lit(total)
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        rest = F.greatest(need - F.lit(area), F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + rest * F.lit(2 * slope), F.lit(0.0)))
        step = F.when(rest == 0, F.lit(0.0)).otherwise(F.lit(2.0) * rest / F.greatest(F.lit(w0) + root, F.lit(1e-300)))
        piece = F.least(F.lit(t0) + step, F.lit(t1))
        out = piece if out is None else F.when(need > F.lit(area), piece).otherwise(out)
        area += (t1 - t0) * (w0 + w1) / 2
    return out


def water_fill(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """Add ``target`` to (source_size, weight) rows: shares of all sizes by weight, none above ``cap`` times its
    source's size, the excess shared again by weight. One aggregate over the sources a round; only three numbers
    reach the driver, however many sources there are."""
    level = None
    while True:
        capped = F.lit(False) if level is None else F.col("source_size") * cap < F.lit(level) * F.col("weight")
        row = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(capped, F.col("source_size") * cap).otherwise(0)).alias("kept"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        new = (row["all"] - row["kept"]) / row["open"] if row["open"] else (level or 0.0)
        if new == level or not row["open"]:
            break
        level = new
    level = level or 0.0
    return sources.withColumn("target", F.least(F.col("source_size") * float(cap), F.lit(level) * F.col("weight")))


def _digest() -> Column:
    """What a row is, beside its source: its doc_id and its whole text."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))


def mix(docs: DataFrame, schedules=SCHEDULES, cap: int = CAP) -> DataFrame:
    """Plan the mix: one row per row of ``docs`` (doc_id, text, source).

    Sources in code-point order, null last, take the schedules in turn. A schedule's integral is the source's
    weight in :func:`water_fill`. A source's documents form a stream in the order of a digest of id and text, repeated as often as
    its target asks; the stream ends at the target, in the middle of a document if need be.

    Returns doc_id, source, digest, size, source_size, target, taken (words taken over all repeats), repeats (``taken`` rounded
    to whole documents) and positions (the training times in [0, 1] at which the repeats start). Null text or no words: size 0, taken 0. Repeated rows are streamed like
    different documents. Empty input: no rows. Other columns are ignored.

    Plan: one scan of the text, which leaves id, source, digest and size; the running size in a source is a sum over
    slices of the digest order plus a window within a slice. A slice has ``SLICE_ROWS`` rows on average, so a hot source spreads over its
    share of them and rows without an id, or with one id, over all; only rows equal in id, text and source share a slice.
    """
    base = checkpoint(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _digest().alias("digest")))
    buckets = max(1, -(-base.count() // SLICE_ROWS))
    place = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    base = base.withColumn("slice", F.floor(place * buckets / F.lit(1 << 32)).cast("int"))

    slices = base.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    sources = global_rank(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), [F.col("source").asc_nulls_last()], "rank")
    kind = F.pmod("rank", F.lit(len(schedules)))
    weight = F.element_at(F.array(*[F.lit(integral(k)) for k in schedules]), (kind + 1).cast("int"))
    sources = water_fill(checkpoint(sources.select("source", "source_size", kind.cast("int").alias("kind"), weight.alias("weight"))), cap)

    before = W.Window.partitionBy("source").orderBy("slice").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = slices.withColumn("start", F.coalesce(F.sum("slice_size").over(before), F.lit(0))).drop("slice_size")
    starts = starts.join(sources, starts["source"].eqNullSafe(sources["source"])).drop(sources["source"])

    inside = W.Window.partitionBy("source", "slice").orderBy("digest").rowsBetween(W.Window.unboundedPreceding, -1)
    run = base.withColumn("run", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    run = run.join(starts, run["source"].eqNullSafe(starts["source"]) & (run["slice"] == starts["slice"])).drop(starts["source"]).drop(starts["slice"])

    offset = F.col("start") + F.col("run")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target") - full * F.col("source_size")).cast("long")
    part = F.greatest(F.least(rest - offset, F.col("size")), F.lit(0).cast("long"))
    taken = full * F.col("size") + part
    starts_at = offset / F.col("target")
    period = F.col("source_size") / F.col("target")

    def times(knots) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("long"), full - F.when(part > 0, 0).otherwise(1)), lambda e: invert(knots, starts_at + e * period))

    positions = None
    for i, knots in enumerate(schedules):
        positions = F.when(F.col("kind") == i, times(knots)) if positions is None else positions.when(F.col("kind") == i, times(knots))
    positions = F.when(taken > 0, positions).otherwise(F.array().cast("array<double>"))
    whole = full + F.when((part > 0) & (2 * part >= F.col("size")), 1).otherwise(0)
    return run.select("doc_id", "source", "digest", "size", "source_size", "target", taken.alias("taken"), whole.cast("int").alias("repeats"), positions.alias("positions"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, all columns, repeated and in training order.

    Whole documents only: one that the mix takes k and a part times comes k + 1 times if the part is half of it or more, else k
    times; documents without words are left out. Rows are matched to the plan by a digest of id, text and source, null ids and sources
    included. Rows equal in these share their turns: one of them stands for all, with its other columns, at every position that the
    plan gives to any. Empty input: no rows.
    """
    key = lambda digest: F.md5(F.concat(digest, F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-"))))
    plan = mix(docs, **options).where("repeats > 0 and size > 0")
    plan = checkpoint(plan.select(key("digest").alias("__mix_key"), F.slice("positions", 1, F.col("repeats")).alias("__mix_at")))
    named = docs.withColumn("__mix_key", key(_digest()))
    repeated = checkpoint(plan.groupBy("__mix_key").agg(F.count("*").alias("n")).where("n > 1").select("__mix_key"))
    if repeated.isEmpty():
        out = named.join(plan, "__mix_key")
    else:
        one = named.join(repeated, "__mix_key", "left_semi").dropDuplicates(["__mix_key"])
        out = named.join(plan.join(repeated, "__mix_key", "left_anti"), "__mix_key")
        out = out.unionByName(one.join(plan.join(repeated, "__mix_key", "left_semi"), "__mix_key"))
    out = out.withColumn("__mix_position", F.explode("__mix_at"))
    out = out.repartitionByRange("__mix_position", "doc_id").sortWithinPartitions("__mix_position", "doc_id")
    return out.select(*docs.columns)


def ordered(plan: DataFrame) -> DataFrame:
    """The plan range-sorted by training position, ties by doc_id, with ``position``, the first one of each row; what is not taken comes last, its
    position null. Null doc_id sorts first among ties. Empty input: no rows."""
    plan = plan.withColumn("position", F.get("positions", F.lit(0)))
    by = [F.col("position").asc_nulls_last(), F.col("doc_id")]
    return plan.repartitionByRange(*by).sortWithinPartitions(*by)


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ordered(mix(docs)).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
k AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT AS kind FROM s),
w AS (SELECT *, CASE kind WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM k),
r AS (SELECT *, 3 * source_size / weight AS ratio FROM w),
c AS (SELECT ratio, (SELECT sum(source_size) FROM r) AS total,
             (SELECT coalesce(sum(3 * source_size), 0) FROM r x WHERE x.ratio < y.ratio) AS kept,
             (SELECT sum(weight) FROM r x WHERE x.ratio >= y.ratio) AS free FROM r y),
lv AS (SELECT coalesce(arg_min((total - kept)::DOUBLE / free, ratio), 0) AS level FROM c WHERE (total - kept)::DOUBLE / free <= ratio),
t AS (SELECT source, source_size, kind, least(3.0::DOUBLE * source_size, level * weight) AS target FROM w, lv),
o AS (SELECT b.doc_id, b.size, t.source_size, t.kind, t.target,
             coalesce(sum(size) OVER (PARTITION BY b.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_
      FROM base b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM o),
g AS (SELECT *, floor(target - passes * source_size)::BIGINT AS rest, CASE WHEN target > 0 THEN least(greatest(start_ / target, 0), 1) END AS share FROM f),
h AS (SELECT *, passes * size + greatest(least(rest - start_, size), 0) AS taken,
        CASE kind WHEN 0 THEN 10 * share / (6 + sqrt(36 - 20 * share)) WHEN 1 THEN share ELSE 2 * share / (0.5 + sqrt(0.25 + 2 * share)) END AS p FROM g)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken, CASE WHEN taken > 0 THEN round(least(p, 1.0), 9) END AS position FROM h
"""
