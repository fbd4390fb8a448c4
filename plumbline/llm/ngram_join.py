"""N-gram Jaccard self-join by chosen paths (after Christiani, Pagh and Sivertsen's CPSJoin)."""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, grouped, local_roots, mix64, pair_blocks, shingle_set, sized, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
#: Wanted probability that a pair at the threshold meets in a bucket, for pairs that need the deepest split.
RECALL = 0.9999
DEPTH = 4
#: A bucket of at most this many sets is compared by brute force; a larger one is split further.
SMALL = 256
#: Sets per block where a bucket or cluster must be compared whole whatever its size.
BLOCK = 512
COORDINATES = 64
#: A set's sketch must agree with another's on this share of coordinates to be compared exactly: 0.8 less four
#: standard deviations of the share at 64 coordinates.
SKETCH_SHARE = 0.8 - 4 * math.sqrt(0.16 / COORDINATES)

_SEEDS = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64))
_FACTORS = (_SEEDS >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_TERMS = _SEEDS.astype(np.uint32)
_RECORD = "doc_id long, n int, set_key binary, coords array<int>, sketch binary"


def meeting(runs: int, threshold: float = THRESHOLD, depth: int = DEPTH) -> float:
    """Probability that a pair at the threshold shares a bucket of ``depth`` splits in some run. The runs draw from the same coordinates:
    given that a pair agrees on k of them, a split keeps it together with probability k / COORDINATES, whichever the run."""
    missed = 0.0
    for k in range(COORDINATES + 1):
        weight = math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k)
        missed += weight * (1 - (k / COORDINATES) ** depth) ** runs
    return 1 - missed


@functools.cache
def runs_needed(recall: float = RECALL, threshold: float = THRESHOLD, depth: int = DEPTH) -> int:
    """Fewest runs after which :func:`meeting` reaches ``recall``."""
    runs = 1
    while meeting(runs, threshold, depth) < recall:
        runs += 1
    return runs


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Min-hash coordinates (uint32) of non-empty sets: one row a set."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for i in range(COORDINATES):
        out[:, i] = np.minimum.reduceat(flat * _FACTORS[i] + _TERMS[i], starts)
    return out


def _chunks(batch: pa.RecordBatch, limit: int = 1 << 22):
    """Row ranges of a batch with about ``limit`` characters each."""
    size, first = 0, 0
    sizes = [len(t) if t else 0 for t in batch.column("text").to_pylist()]
    for i, n in enumerate(sizes):
        if size and size + n > limit:
            yield batch.slice(first, i - first)
            first, size = i, 0
        size += n
    yield batch.slice(first)


def _records(batches):
    for whole in batches:
        for batch in _chunks(whole) if whole.num_rows else ():
            ids = batch.column("doc_id")
            sets = [shingle_set(w, SHINGLE) for w in word_hashes(batch.column("text").to_pylist())]
            full = [i for i, s in enumerate(sets) if len(s)]
            coords: list = [None] * len(sets)
            marks: list = [None] * len(sets)
            keys: list = [None] * len(sets)
            if full:
                rows = sketches([sets[i] for i in full])
                small = (rows * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
                for at, i in enumerate(full):
                    coords[i] = rows[at].view(np.int32)
                    marks[i] = small[at].tobytes()
                    keys[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.binary()), pa.array(coords, pa.list_(pa.int32())), pa.array(marks, pa.binary())],
                ["doc_id", "n", "set_key", "coords", "sketch"],
            )


def _coarse(batches):
    """Edges (u, v) between sets of one bucket whose sketches agree enough, reduced to a forest of the bucket."""
    for part in grouped(batches, ["key", "lo", "hi"]):
        reps = part.column("rep").to_numpy()
        marks = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
        need = math.ceil(SKETCH_SHARE * COORDINATES)
        a, b = [], []
        if len(reps) == 2:
            if (marks[0] == marks[1]).sum() >= need:
                a, b = [np.array([0])], [np.array([1])]
        else:
            for i in range(len(reps) - 1):
                hit = np.flatnonzero((marks[i + 1 :] == marks[i]).sum(axis=1) >= need) + i + 1
                a.append(np.full(len(hit), i))
                b.append(hit)
        if not sum(map(len, a)):
            continue
        root = local_roots(len(reps), np.concatenate(a), np.concatenate(b))
        least = np.full(len(reps), np.iinfo(np.int64).max)
        np.minimum.at(least, root, reps)
        own = least[root]
        open_ = own != reps
        yield pa.RecordBatch.from_arrays([pa.array(own[open_]), pa.array(reps[open_])], ["u", "v"])


def _sets(batches):
    """The packed shingle sets of texts; a row whose text is not its class's is left out (its doc_id occurs twice)."""
    for whole in batches:
        for batch in _chunks(whole) if whole.num_rows else ():
            sets = [shingle_set(w, SHINGLE).tobytes() for w in word_hashes(batch.column("text").to_pylist())]
            same = pa.array([hashlib.blake2b(s, digest_size=16).digest() == k for s, k in zip(sets, batch.column("set_key").to_pylist())])
            columns = [batch.column(c) for c in ("cluster", "rep", "copies", "size")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sets, pa.binary())], ["cluster", "rep", "copies", "size", "packed"]).filter(same)


def intersections(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence matrices ``width`` tokens wide."""
    n = len(sets)
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    names, place, count = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[place]
    column, owner = column[place[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((n, n), np.float32)
    m = int(shared.sum())
    for first in range(0, m, width):
        i, j = np.searchsorted(column, [first, first + width])
        grid = np.zeros((n, min(width, m - first)), np.float32)
        grid[owner[i:j], column[i:j] - first] = 1
        total += grid @ grid.T
    return total


def _exact(batches):
    """Links at the threshold in one block or between two blocks of a cluster: for each set the number of linked
    documents that the pair of blocks accounts for, and the smallest set reached within it."""
    for part in grouped(batches, ["cluster", "lo", "hi"]):
        reps, first = np.unique(part.column("rep").to_numpy(), return_index=True)
        if len(reps) < 2:
            continue
        side, copies = (part.column(c).to_numpy()[first] for c in ("side", "copies"))
        packed = part.column("packed")
        sets = [np.frombuffer(packed[int(i)].as_buffer(), np.uint64) for i in first]
        n = np.array([len(s) for s in sets])
        if len(sets) == 2:
            both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            common = np.array([[n[0], both], [both, n[1]]], float)
        else:
            common = intersections(sets)
        linked = common * 10 >= (n[:, None] + n[None, :] - common) * (10 * THRESHOLD)
        np.fill_diagonal(linked, False)
        if part.column("lo")[0].as_py() != part.column("hi")[0].as_py():
            linked &= side[:, None] != side[None, :]
        a, b = np.nonzero(np.triu(linked))
        root = local_roots(len(reps), a, b)
        least = np.full(len(reps), np.iinfo(np.int64).max)
        np.minimum.at(least, root, reps)
        yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array((linked @ copies).astype(np.int64)), pa.array(least[root])], ["rep", "links", "low"])


def jaccard_join(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """Self-join of ``docs`` (doc_id long, text) on Jaccard similarity >= 0.8 of their sets of five-word shingles.

    Words are runs of ASCII letters and digits and anything beyond ASCII, in lower case, so case and punctuation do not matter; a text of other
    characters only is split at white space. One row per row of ``docs``: doc_id, class_id
    (the smallest doc_id reachable over links, itself included), n_links (other rows linked directly) and
    n_shingles. Texts of one to four words have one shingle, the whole text. Null, empty or blank texts have
    none and link with nothing, as have rows whose doc_id is null (class_id null for these). Repeated rows count
    as copies. Other columns are ignored. Empty input: no rows.

    Method: rows with equal sets are one class with a count. Classes carry 64 min-hash coordinates. In each of
    :func:`runs_needed` runs a class is put in a bucket by the token at a coordinate chosen by the bucket's path;
    buckets above ``SMALL`` are split again, ``DEPTH`` times at most, and what is still larger is compared whole,
    block by block. Classes whose sketches nearly agree form clusters (connected components). The clusters'
    shingle sets are rebuilt from the texts and compared exactly: a class travels once to its cluster, or once for
    each block of a cluster larger than ``BLOCK``, and pairs are counted where they are formed, not emitted.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    records = checkpoint(texts.mapInArrow(_records, _RECORD))
    usable = records.where("n > 0 and doc_id is not null")
    classes = usable.groupBy("set_key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.any_value("coords").alias("coords"), F.any_value("sketch").alias("sketch"))
    classes = checkpoint(classes.withColumn("rep", F.monotonically_increasing_id()))

    def token(path):
        return F.element_at("coords", (F.pmod(F.xxhash64(path, F.lit("coordinate")), F.lit(COORDINATES)) + 1).cast("int"))

    start = F.transform(F.sequence(F.lit(1), F.lit(runs_needed(recall))), lambda r: F.xxhash64(r, token(r)))
    front = classes.select("rep", F.explode(start).alias("key"))
    buckets = None
    for depth in range(1, DEPTH + 1):
        # a checkpointed side lets adaptive execution split a hot key of the other one
        counts = checkpoint(front.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
        multi = checkpoint(front.join(counts, "key"))
        last = depth == DEPTH
        ready = multi if last else multi.where(F.col("size") <= SMALL)
        buckets = ready if buckets is None else buckets.union(ready)
        large = multi.where(F.col("size") > SMALL)
        rows = 0 if last else large.count()
        if not rows:
            break
        front = large.join(classes.select("rep", "coords"), "rep").select("rep", F.xxhash64("key", token(F.col("key"))).alias("key"))
        front = sized(checkpoint(front), rows)
    dealt = pair_blocks(buckets.join(classes.select("rep", "sketch"), "rep"), "key", "rep", "size", BLOCK)
    dealt = dealt.select("key", "lo", "hi", "rep", "sketch").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    clusters = components(dealt.mapInArrow(_coarse, "u long, v long"))

    members = checkpoint(clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
    members = members.join(sizes, "cluster").join(classes.select("rep", "first_id", "set_key", "copies"), "rep")
    packed = texts.join(members, texts["doc_id"] == members["first_id"]).select("cluster", "rep", "copies", "size", "set_key", "text")
    packed = packed.mapInArrow(_sets, "cluster long, rep long, copies long, size long, packed binary")
    dealt = pair_blocks(packed, "cluster", "rep", "size", BLOCK).repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi")
    exact = checkpoint(dealt.select("cluster", "lo", "hi", "side", "rep", "copies", "packed").mapInArrow(_exact, "rep long, links long, low long"))
    links = exact.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = checkpoint(components(exact.select(F.col("rep").alias("u"), F.col("low").alias("v")).where("u <> v")))
    named = joined.join(classes.select(F.col("rep").alias("node"), "first_id"), "node")
    lowest = checkpoint(named.groupBy("component").agg(F.min("first_id").alias("lowest")))
    joined = joined.join(lowest, "component").select(F.col("node").alias("rep"), "lowest")
    found = classes.select("rep", "set_key", "first_id", "copies").join(links, "rep", "left").join(joined, "rep", "left")
    found = found.select(F.col("set_key").alias("__key"), F.coalesce("lowest", "first_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = records.select("doc_id", "set_key", "n").join(found, (F.col("set_key") == F.col("__key")) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("n").cast("long").alias("n_shingles"))


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS v,
       list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS b FROM documents),
o AS (SELECT doc_id, CASE WHEN len(v) > 0 THEN v ELSE b END AS w FROM w),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM o),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k * 10 >= 8 * (x.n + y.n - k)),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
m AS (SELECT node, min(root) AS class_id FROM r GROUP BY node),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT d.doc_id, m.class_id, coalesce(k.n_links, 0)::BIGINT AS n_links, coalesce(n.n, 0)::BIGINT AS n_shingles
FROM documents d JOIN m ON m.node = d.doc_id LEFT JOIN k ON k.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
