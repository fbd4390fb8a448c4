"""Helpers shared by the operators: checkpoints, distributed ranks, components, pair blocks and shingle hashes."""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the folder of spark.checkpoint.dir and cut its lineage.

    Where the session names no folder, one of our own is set on a local master, as in tests; a cluster must name a shared one.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="plumbline-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def global_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Add ``out``, the gapless rank from 0 in ``order``, without sending all rows to one task.

    Rows are range-partitioned and sorted; a row's rank is its place in its partition plus the rows of the
    partitions before. Only one count per partition is gathered. The result is checkpointed, as sampled range
    bounds may differ between two evaluations. ``order`` should end in a tie-breaker: rows equal in all of it
    share a partition.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = checkpoint(sorted_rows.withColumn("__id", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND((1 << 33) - 1))
    before = W.Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = numbered.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return numbered.join(F.broadcast(starts), "__part").withColumn(out, F.col("__start") + F.col("__at")).drop("__id", "__part", "__at", "__start")


#: Rows that one task of a small iterative step takes.
ROWS_A_TASK = 100_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more partitions than its rows fill, so that a step over few rows leaves few files."""
    return df.coalesce(max(1, -(-rows // ROWS_A_TASK)))


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) of every node in ``edges``; component is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each a grouped minimum and a join, so
    no component is ever gathered; rounds go on until the edges stay the same, a number that grows like the squared
    logarithm of the nodes at most. A round's edges are checkpointed. Nulls and loops are ignored.
    """
    now = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct()
    now = checkpoint(now)

    def signature(e: DataFrame) -> tuple:
        row = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        return row["n"], row["s"]

    last = signature(now)
    while True:
        rows = last[0]
        now = sized(now, rows)
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # checkpointed minima let adaptive execution split the edges of a hub
        least = checkpoint(sized(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), 2 * rows))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = checkpoint(sized(large, 2 * rows))
        least = checkpoint(sized(large.groupBy("u").agg(F.min("v").alias("m")), 2 * rows))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        now = checkpoint(sized(small, 2 * rows))
        this = signature(now)
        if this == last:
            break
        last = this
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def pair_blocks(df: DataFrame, key: str, row: str, size: str, block: int) -> DataFrame:
    """Deal each group of ``key`` into blocks of about ``block`` rows and send every row to each pair of blocks
    that its own block is in. Adds lo, hi (the pair) and side (the row's block); a pair of rows meets in exactly
    one (key, lo, hi) if pairs are formed across the sides when lo < hi and within the block when lo = hi.

    ``size`` is the group's row count. A group of at most ``block`` rows is one block and is not copied.
    """
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("long")
    dealt = df.withColumn("side", F.pmod(F.xxhash64(row), blocks))
    dealt = dealt.withColumn("__with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return dealt.withColumn("lo", F.least("side", "__with")).withColumn("hi", F.greatest("side", "__with")).drop("__with")


# ---------------------------------------------------------------------------------------------------------
# Word and shingle hashes. Words are runs of ASCII letters, digits and anything beyond ASCII, compared in lower case, so that case
# and punctuation make no difference. A text that has none but is not blank is split at ASCII white space instead.

_BLANK = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_SPACE = bytes(b if b not in (9, 10, 11, 12, 13) else 32 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PIECE = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _piece_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and byte offsets of the words of ``data``, whose white space is all blanks."""
    raw = np.frombuffer(data, np.uint8)
    word = raw != 32
    edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64), start
    if len(data) > 4 * _PIECE and len(start) == 1:
        one = hashlib.blake2b(data.strip(b" "), digest_size=8).digest()
        return np.frombuffer(one, np.uint64), start
    power = np.cumprod(np.full(len(raw), _BASE))
    back = np.cumprod(np.full(len(raw), _INVERSE))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * power)))
    return mix64((sums[end] - sums[start]) * back[start]), start


def _pieces(data: bytes):
    while len(data) > _PIECE:
        cut = data.rfind(b" ", 0, _PIECE)
        if cut < 0:
            cut = data.find(b" ", _PIECE)
            if cut < 0:
                break
        yield data[: cut + 1]
        data = data[cut + 1 :]
    yield data


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its words in order; null counts as empty. Memory stays near one
    piece of a megabyte, whatever the length of a text."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        if held:
            hashes, start = _piece_hashes(b" ".join(held))
            bounds = np.cumsum([0] + [len(x) + 1 for x in held])
            at = np.searchsorted(start, bounds)
            out.extend(hashes[at[i] : at[i + 1]] for i in range(len(held)))
            held.clear()

    for text in texts:
        data = (text or "").lower().encode("utf-8", "surrogatepass").translate(_BLANK)
        if len(data) > _PIECE:
            flush()
            size = 0
            out.append(np.concatenate([_piece_hashes(p)[0] for p in _pieces(data)]))
            continue
        if size + len(data) > _PIECE:
            flush()
            size = 0
        held.append(data)
        size += len(data) + 1
    flush()
    for i, (text, hashes) in enumerate(zip(texts, out)):
        if text and not len(hashes):
            out[i] = np.concatenate([_piece_hashes(p)[0] for p in _pieces(text.lower().encode("utf-8", "surrogatepass").translate(_SPACE))])
    return out


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles. A text of 1 to k - 1 words has one shingle, all of it;
    an empty text has none."""
    if not len(words):
        return words
    if len(words) <= k:
        k = len(words)
    n = len(words) - k + 1
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            total = total * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return np.unique(mix64(total))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the edges a - b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, root):
            break
        root = new
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def grouped(batches, keys: list[str]):
    """Arrow tables, one for each run of equal ``keys``, from batches sorted by them; a run may span batches."""
    import pyarrow as pa

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change).tolist()
        bounds = [0, *starts, batch.num_rows]
        for i, j in zip(bounds, bounds[1:]):
            this = tuple(c[i] for c in columns)
            if held and this != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = this
    if held:
        yield pa.Table.from_batches(held)


LONG = T.LongType()
