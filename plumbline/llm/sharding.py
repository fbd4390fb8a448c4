"""Sharding along a Hilbert curve, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, global_rank

SHARDS = 24
BITS = 10


def hilbert(axes: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of the point whose coordinates are ``axes``, integers below 2**bits.

    Skilling's transform (2004) as a fold over (bit, axis) steps. The state is an array, so each step is
    evaluated once; nested expressions would double at every step.
    """
    n = len(axes)
    point = F.array(*[a.cast("long") for a in axes])

    def undo(x: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        p, first, this = q - 1, F.get(x, F.lit(0)), F.get(x, step["i"])
        hit = this.bitwiseAND(q) != 0
        swap = F.when(hit, F.lit(0).cast("long")).otherwise(first.bitwiseXOR(this).bitwiseAND(p))
        return F.transform(x, lambda v, k: F.when(k == 0, F.when(hit, first.bitwiseXOR(p)).otherwise(first.bitwiseXOR(swap))).when(k == i, v.bitwiseXOR(swap)).otherwise(v))

    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])
    turned = F.aggregate(steps, point, undo)
    gray = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), turned, lambda x, i: F.transform(x, lambda v, k: F.when(k == i, v.bitwiseXOR(F.get(x, i - 1))).otherwise(v))) if n > 1 else turned
    masks = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)])
    flips = lambda x: F.aggregate(masks, F.lit(0).cast("long"), lambda t, q: F.when(F.get(x, F.lit(n - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    marked = F.transform(F.array(gray), lambda x: F.struct(x.alias("x"), flips(x).alias("t")))[0]
    digits = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])

    def push(acc: Column, d: Column) -> Column:
        word = F.get(acc["x"], d["i"]).bitwiseXOR(acc["t"])
        bit = F.floor(word / F.pow(F.lit(2.0), d["b"])).cast("long").bitwiseAND(1)
        return F.struct(acc["x"].alias("x"), acc["t"].alias("t"), (acc["h"] * 2 + bit).alias("h"))

    start = F.transform(F.array(marked), lambda m: F.struct(m["x"].alias("x"), m["t"].alias("t"), F.lit(0).cast("long").alias("h")))[0]
    return F.aggregate(digits, start, push, lambda acc: acc["h"])


def ordinal(df: DataFrame, column: str, out: str, bits: int = BITS) -> DataFrame:
    """Add ``out``: the place of ``column`` among its distinct values (null first), scaled to 0 .. 2**bits - 1."""
    values = df.groupBy(column).agg(F.count("*").alias("__rows")).select(column)
    ranked = global_rank(values, [F.col(column).asc_nulls_first()], "__rank")
    count = ranked.agg(F.count("*").alias("__count"))
    codes = ranked.crossJoin(F.broadcast(count)).select(F.col(column).alias("__value"), F.floor(F.col("__rank") * ((1 << bits) / F.col("__count"))).cast("long").alias(out))
    return df.join(codes, F.col(column).eqNullSafe(F.col("__value")), "left").drop("__value")


def hilbert_order(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, axes and ``rank``: the place of each row in Hilbert order of (bytes, source, lang).

    Bytes are quantised by logarithm, source and language by their place among distinct values. Rows of equal
    text take the smallest source and language of their group, so they lie side by side. Null text counts as
    empty; null source or language comes first. Ties go by text hash, then doc_id. Empty input: no rows.

    Texts are read once; only ids, hashes and sizes are kept and shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), "source", "lang")
    base = checkpoint(base)
    groups = base.groupBy("text_hash", "size").agg(F.min("source").alias("source"), F.min("lang").alias("lang"))
    top = float((1 << bits) - 1)
    groups = groups.withColumn("axis_size", F.least(F.floor(F.log2(F.col("size").cast("double")) * (1 << bits) / 32), F.lit(top)).cast("long"))
    groups = ordinal(ordinal(groups, "source", "axis_source", bits), "lang", "axis_lang", bits)
    groups = groups.select("text_hash", F.col("size").alias("__size"), "axis_size", "axis_source", "axis_lang", hilbert([F.col("axis_size"), F.col("axis_source"), F.col("axis_lang")], bits).alias("curve"))
    placed = base.drop("source", "lang").join(groups, ["text_hash"]).where("size = __size").drop("__size")
    return global_rank(placed, [F.col(c) for c in ("curve", "text_hash", "doc_id", "size")], "rank")


def shard(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Cut the Hilbert order of :func:`hilbert_order` into ``shards`` runs whose row counts differ by one at most.

    Adds law ('rows'), shard, slot (place in the shard, from 0) and grown_shard (null under this law). Nulls, ties and
    repeated rows as there; fewer rows than shards leave shards empty; an empty table has no rows.
    """
    ranked = hilbert_order(docs, bits)
    total = ranked.agg(F.count("*").alias("__total"))
    number = F.floor(F.expr(f"rank * {shards} div __total"))
    out = ranked.crossJoin(F.broadcast(total)).withColumn("shard", number.cast("int"))
    first = F.expr(f"(shard * __total + {shards - 1}) div {shards}")
    return out.withColumn("slot", (F.col("rank") - first).cast("long")).withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int")).drop("__total")


def shard_ranges(sharded: DataFrame) -> DataFrame:
    """What a reader needs to skip shards: per shard its rows and the smallest and largest value on each axis. Empty input: no rows."""
    ends = [f(a).alias(f"{n}_{a.removeprefix('axis_')}") for a in ("axis_size", "axis_source", "axis_lang") for n, f in (("least", F.min), ("most", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *ends)


def op9_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve")
