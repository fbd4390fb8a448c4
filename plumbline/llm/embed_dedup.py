"""Embedding near-duplicates by counting collisions on sorted one-dimensional projections.

A query-centred window tells a pair at the threshold from an unrelated one by a factor of sqrt(2) / 0.374 = 3.8 at most, so counting alone looks at all
pairs of a label. Labels too large for that are first cut into cells by runs of further projections; a pair is counted in the first run it shares a cell in.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, grouped, local_roots, mix64, pair_blocks

THRESHOLD = 0.93
PROJECTIONS = 24
#: Half-width of a query's window on a Gaussian projection of unit vectors, in standard deviations of the
#: difference of two vectors at the threshold.
WIDTH = 1.6
#: Wanted probability that a pair at the threshold reaches the count.
RECALL = 0.99999
BLOCK = 2048
_TILE = 256
#: Width of a cell on a projection, and the most projections that a run cuts by.
CELL = 1.5
MOST_CUTS = 24


def calibrated(projections: int = PROJECTIONS, width: float = WIDTH, recall: float = RECALL) -> int:
    """Largest collision count that a pair at the threshold reaches with probability ``recall``: its collisions
    are binomial, each with the chance that a standard normal lies within ``width``."""
    p = math.erf(width / math.sqrt(2))
    below = 0.0
    for count in range(projections + 1):
        below += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > 1 - recall:
            return count
    return projections


def same_cell(spread: float, width: float = CELL) -> float:
    """Probability that two vectors fall into one cell of a randomly shifted grid, if the difference of their projections is normal with ``spread``."""
    r = width / spread
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


@functools.cache
def cutting(size: int, block: int = BLOCK) -> tuple[int, int]:
    """(runs, projections a run cuts by) for a label of ``size`` vectors: what copies a vector least often. (1, 0) leaves the label whole.

    A pair at the threshold shares a cell in some run with probability ``RECALL``. A cell of unrelated vectors that is larger than ``block`` is
    dealt in pairs of blocks, as a whole label is, and copies its vectors accordingly."""
    near, far = same_cell(math.sqrt(2 - 2 * THRESHOLD)), same_cell(math.sqrt(2))
    best = (max(1.0, size / block), 1, 0)
    for cuts in range(1, MOST_CUTS + 1):
        runs = math.ceil(math.log(1 - RECALL) / math.log(1 - near**cuts))
        best = min(best, (runs * max(1.0, size * far**cuts / block), runs, cuts))
    return best[1:]


def directions(dim: int, projections: int = PROJECTIONS, seed: int = 20) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, projections))


def candidates(p: np.ndarray, q: np.ndarray, window: float, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``p``, row of ``q``) that fall within ``window`` of each other on ``need`` columns or more.

    Every column of ``q`` is sorted once. A query's window is a run of that order, found by bisection; runs are
    added to a tile of counters as differences at their two ends."""
    orders = np.argsort(q, axis=0, kind="stable")
    out_a, out_b = [], []
    for first in range(0, len(p), _TILE):
        tile = p[first : first + _TILE]
        counts = np.zeros((len(tile), len(q)), np.int8)
        rows = np.arange(len(tile))
        for m in range(p.shape[1]):
            order = orders[:, m]
            line = q[order, m]
            ends = np.zeros((len(tile), len(q) + 1), np.int8)
            ends[rows, np.searchsorted(line, tile[:, m] - window, "left")] += 1
            ends[rows, np.searchsorted(line, tile[:, m] + window, "right")] -= 1
            place = np.empty(len(q), np.int64)
            place[order] = np.arange(len(q))
            counts += np.cumsum(ends[:, :-1], axis=1, dtype=np.int8)[:, place]
        a, b = np.nonzero(counts >= need)
        out_a.append(a + first)
        out_b.append(b)
    return np.concatenate(out_a), np.concatenate(out_b)


def _units(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The rows' vectors in double precision scaled to length 1, and which can be linked."""
    rows = part.column("embedding").to_pylist()
    dim = max((len(r) for r in rows if r), default=0)
    out = np.zeros((len(rows), dim))
    good = np.zeros(len(rows), bool)
    for i, r in enumerate(rows):
        v = np.array(r, float)
        norm = np.linalg.norm(v / max(np.abs(v).max(), 1e-300)) * np.abs(v).max() if len(v) else 0.0
        if len(v) == dim and norm > 0 and np.isfinite(norm):
            out[i], good[i] = v / norm, True
    return out, good


def _cells(block: int, columns: list[str]):
    """Add ``keys``, a vector's cell in each run; a label left whole is one cell."""

    def run(batches):
        grids: dict = {}
        for batch in batches:
            part = pa.Table.from_batches([batch])
            sizes, dims = part.column("size").to_numpy(), part.column("dim").to_numpy()
            keys: list = [b"\0\0\0\0"] * len(sizes)
            for size, dim in sorted(set(zip(sizes.tolist(), dims.tolist()))):
                runs, cuts = cutting(size, block)
                if not cuts:
                    continue
                at = np.flatnonzero((sizes == size) & (dims == dim))
                x, _ = _units(part.take(pa.array(at)))
                if (dim, runs, cuts) not in grids:
                    rng = np.random.default_rng([31, runs, cuts])
                    grids[dim, runs, cuts] = rng.standard_normal((dim, runs * cuts)), rng.random(runs * cuts)
                lines, shift = grids[dim, runs, cuts]
                cell = np.floor(x @ lines / CELL + shift).astype(np.int64).astype(np.uint64).reshape(len(at), runs, cuts)
                name = np.zeros((len(at), runs), np.uint64)
                for j in range(cuts):
                    name = mix64(name + cell[:, :, j] + np.uint64(0x9E3779B97F4A7C15))
                name = (name >> np.uint64(32)).astype(np.uint32)
                for i, row in zip(at.tolist(), name):
                    keys[i] = row.tobytes()
            runs_of = [np.frombuffer(k, np.int32) for k in keys]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(runs_of, pa.list_(pa.int32()))], [*columns, "keys"])

    return run


def _unmet(keys: np.ndarray, run: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs share no cell in the runs before ``run``."""
    out = np.ones(len(a), bool)
    for r in range(run):
        out &= keys[a, r] != keys[b, r]
    return out


def _links(batches):
    for part in grouped(batches, ["label", "dim", "run", "cell", "lo", "hi"]):
        ids, side, copies = (part.column(c).to_numpy() for c in ("rep", "side", "copies"))
        x, _ = _units(part)
        shadow = (x @ directions(x.shape[1])).astype(np.float32)
        window = WIDTH * math.sqrt(2 - 2 * THRESHOLD) + 1e-6
        lo, hi, run = (part.column(c)[0].as_py() for c in ("lo", "hi", "run"))
        one, two = (np.arange(len(ids)),) * 2 if lo == hi else (np.flatnonzero(side == lo), np.flatnonzero(side == hi))
        if not len(one) or not len(two):
            continue
        a, b = candidates(shadow[one], shadow[two], window, calibrated())
        a, b = one[a], two[b]
        if lo == hi:
            a, b = a[a < b], b[a < b]
        hit = np.zeros(len(a), bool)
        for i in range(0, len(a), 1 << 16):
            hit[i : i + (1 << 16)] = np.einsum("ij,ij->i", x[a[i : i + (1 << 16)]], x[b[i : i + (1 << 16)]]) >= THRESHOLD
        a, b = a[hit], b[hit]
        if run:
            first = _unmet(np.array(part.column("keys").to_pylist(), np.int32), run, a, b)
            a, b = a[first], b[first]
        count = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        root = local_roots(len(ids), a, b)
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, root, ids)
        own = count > 0
        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(count[own].astype(np.int64)), pa.array(least[root][own])], ["rep", "links", "low"])


def _names(label: str, embedding: str) -> list:
    """128 bits in place of a vector, so that results are joined back without sending vectors; null without one."""
    return [F.when(F.col(embedding).isNotNull(), F.xxhash64(F.lit(salt), label, embedding)).alias(f"name_{salt}") for salt in (1, 2)]


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """Links between vectors of equal, non-null label at cosine >= 0.93 in double precision.

    ``vectors``: vec_id, embedding (array of float or double), label. One row per row: vec_id, n_links (other
    vectors linked directly), component_id (smallest vec_id reachable, itself included), kept. Vectors that are
    null, empty, zero or hold a null, NaN or infinity link with nothing; so do rows with a null label or id.
    Vectors of different length are never compared. Equal vectors of a label are one class with a count and are
    linked; repeated rows count as copies. Other columns are ignored. Empty input: no rows.

    A label's vectors meet in pairs of blocks of ``BLOCK``. Within a pair, projections are sorted, collisions
    counted in query-centred windows, and pairs reaching the calibrated count verified; only counts and one link
    a vector leave the task. A label of more than some 20 blocks is cut into cells first (:func:`cutting`), so that its
    vectors are copied once a run, with runs growing like the fourth root of its size, instead of once a block. A cell
    that is still large, such as that of a crowd of near copies, is compared whole in pairs of blocks.
    """
    value = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.coalesce(F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(value, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", "label", F.when(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), value).alias("embedding"))
    # adding zero makes -0.0 and 0.0 one value
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0))).withColumn("dim", F.size("embedding"))
    usable = rows.where("embedding is not null")
    classes = usable.groupBy("label", "dim", "embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    classes = checkpoint(classes.withColumn("rep", F.monotonically_increasing_id()))
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("size")).withColumnsRenamed({"label": "l", "dim": "d"})
    sized_rows = classes.join(sizes, (F.col("l") == F.col("label")) & (F.col("d") == F.col("dim")))
    columns = ["label", "dim", "rep", "copies", "embedding"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.select(*columns).schema)
    vectors_cells = checkpoint(sized_rows.select(*columns, "size").mapInArrow(_cells(BLOCK, columns), f"{kinds}, keys array<int>"))
    cell = ["label", "dim", "run", "cell"]
    front = vectors_cells.select("label", "dim", "rep", F.posexplode("keys").alias("run", "cell"))
    # a checkpointed side lets adaptive execution split a hot key of the other one
    crowds = checkpoint(front.groupBy(*cell).agg(F.count("*").alias("size")).where("size > 1"))
    dealt = pair_blocks(front.join(crowds, cell), "cell", "rep", "size", BLOCK).select("rep", "run", "cell", "lo", "hi", "side")
    dealt = dealt.join(vectors_cells, "rep").select(*cell, "lo", "hi", "side", "rep", "copies", "embedding", "keys")
    dealt = dealt.repartition(*cell, "lo", "hi").sortWithinPartitions(*cell, "lo", "hi")
    found = checkpoint(dealt.mapInArrow(_links, "rep long, links long, low long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = checkpoint(components(found.select(F.col("rep").alias("u"), F.col("low").alias("v")).where("u <> v")))
    lowest = checkpoint(joined.join(classes.select(F.col("rep").alias("node"), "first_id"), "node").groupBy("component").agg(F.min("first_id").alias("lowest")))
    joined = joined.join(lowest, "component").select(F.col("node").alias("rep"), "lowest")
    known = classes.join(links, "rep", "left").join(joined, "rep", "left").select("label", *_names("label", "embedding"), F.coalesce("lowest", "first_id").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    known = known.withColumnsRenamed({"label": "l", "name_1": "n1", "name_2": "n2"})
    out = rows.select("vec_id", "label", *_names("label", "embedding"))
    out = out.join(known, (F.col("label") == F.col("l")) & (F.col("name_1") == F.col("n1")) & (F.col("name_2") == F.col("n2")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id::BIGINT AS component_id, vec_id = component_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
