"""Quality classifier: histogram gradient-boosted trees over document statistics, scored on flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that the model is fitted on; above it, those with the smallest hashes of doc_id.
SAMPLE = 20_000
CUT = 0.3
BINS = 64
STATISTICS = (
    "log_bytes", "log_words", "word_length", "distinct_words", "repeated_neighbours", "top_word", "distinct_lines", "line_words",
    "upper", "digits", "blanks", "stops", "exclamations", "pipes", "symbols", "other_marks", "non_ascii", "upper_words", "marked_words", "worst_quarter_upper",
    "worst_quarter_symbols", "worst_quarter_repeats", "long_words",
)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _share(counts: np.ndarray, chars: str, total: float) -> float:
    return float(sum(counts[ord(c)] for c in chars)) / total


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, in the order of ``STATISTICS``; all zero where there is nothing to count."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = max(len(data), 1)
    words = text.split()
    n = max(len(words), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    repeats = [a == b for a, b in zip(words, words[1:])]
    upper_words = [len(w) > 1 and w.isupper() for w in words]
    marked = [not w[-1].isalnum() and w[-1] not in ".,;:?)'\"" for w in words]
    symbols = "#$%&*@^~<>=+_\\/{}[]"
    quarter = max(1, len(words) // 4)
    spans = [slice(i, i + quarter) for i in range(0, quarter * 4, quarter)]
    worst = lambda flags: max((sum(flags[s]) / max(len(flags[s]), 1) for s in spans), default=0.0)
    return [
        float(np.log1p(len(data))), float(np.log1p(len(words))), len(text) / n, len(seen) / n, sum(repeats) / n, max(seen.values(), default=0) / n,
        len(set(lines)) / max(len(lines), 1), len(words) / max(len(lines), 1), float(counts[_UPPER].sum()) / size, float(counts[_DIGIT].sum()) / size,
        _share(counts, " \t\n\r", size), _share(counts, ".,;:?", size), _share(counts, "!", size), _share(counts, "|", size), _share(counts, symbols, size),
        _share(counts, "\"'()-`", size), float(counts[128:].sum()) / size, sum(upper_words) / n, sum(marked) / n, worst(upper_words), worst(marked), worst(repeats),
        sum(len(w) > 24 for w in words) / n,
    ]


@dataclass
class Forest:
    """Trees laid end to end: at node i go to left[i] if x[feature[i]] <= cut[i], else to left[i] + 1. Leaves point to themselves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    leaf: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row: every step moves all rows in all trees one level down."""
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        for _ in range(self.depth):
            right = x[rows, self.feature[node]] > self.cut[node]
            node = np.where(self.leaf[node], node, self.left[node] + right)
        margin = self.base + self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, least: int = 5, ridge: float = 1.0) -> Forest:
    """Boost logistic loss on binned statistics. No rows, or one class only: a constant score."""
    n = len(x)
    feature, cut, left, leaf, value, roots = [], [], [], [], [], []
    mean = (y.sum() + 1) / (n + 2)
    base = float(np.log(mean / (1 - mean)))
    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
        margin = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            roots.append(len(feature))
            open_ = [(len(feature), np.arange(n), 0)]
            for column, fill in ((feature, 0), (cut, 0.0), (left, 0), (leaf, True), (value, 0.0)):
                column.append(fill)
            while open_:
                at, rows, level = open_.pop()
                g, h = grad[rows].sum(), hess[rows].sum()
                best = (1e-6, None, None)
                if level < depth and len(rows) >= 2 * least:
                    for j, c in enumerate(cuts):
                        if not len(c):
                            continue
                        b = binned[rows, j]
                        gs, hs, ns = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (grad[rows], hess[rows], None))
                        gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
                        gain[(ns < least) | (len(rows) - ns < least)] = -1
                        k = int(np.argmax(gain))
                        if gain[k] > best[0]:
                            best = (gain[k], j, k)
                if best[1] is None:
                    value[at] = rate * g / (h + ridge)
                    margin[rows] += value[at]
                    continue
                _, j, k = best
                feature[at], cut[at], left[at], leaf[at] = j, float(cuts[j][k]), len(feature), False
                low = binned[rows, j] <= k
                for side in (rows[low], rows[~low]):
                    open_.append((len(feature), side, level + 1))
                    for column, fill in ((feature, 0), (cut, 0.0), (left, 0), (leaf, True), (value, 0.0)):
                        column.append(fill)
    if not roots:
        feature, cut, left, leaf, value, roots = [0], [0.0], [0], [True], [0.0], [0]
    return Forest(np.array(feature), np.array(cut), np.array(left), np.array(leaf), np.array(value), np.array(roots), depth, base)


def held_out(doc_id="doc_id"):
    """Rows that are never learnt from: crc32 of doc_id as text is divisible by 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def _measured(batches):
    for batch in batches:
        rows = [statistics(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("quality"), pa.array(rows, pa.list_(pa.float64()))], ["id", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Fit on at most ``sample`` labelled documents outside the held-out fifth.

    A document labelled more than once takes the majority, ties counting as 1; null labels and ids are left out. A doc_id that occurs
    more than once gives one row, that of the smallest statistics. The sample's ids are bounded, so they are broadcast to one scan of
    the documents; only its statistics, at most ``sample`` times 23 numbers, reach the driver. Empty tables: a constant score.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    known = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(known), F.col("id") == F.col("doc_id")).select("id", "quality", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    measured = rows.mapInArrow(_measured, f"id {kind}, quality int, x array<double>")
    got = measured.groupBy("id").agg(F.min(F.struct("x", "quality")).alias("one")).select("one.x", "one.quality").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(STATISTICS))
    y = got["quality"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # whatever order the rows came in
    return fit(x[order], y[order])


def _scorer(forest: Forest, schema: list[str]):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            for i in range(0, len(texts), 512):
                out.append(forest.scores(np.array([statistics(t) for t in texts[i : i + 512]])))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in schema], pa.array(np.concatenate(out))], [*schema, "score"])

    return run


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= 0.3) of every row.

    Every row is scored on its own whole text, without a shuffle; null text counts as empty. Null doc_id is kept
    and held_out follows the crc32 of no bytes. Repeated rows get equal scores. Empty input: no rows.
    """
    scored = docs.select("doc_id", "text").mapInArrow(_scorer(forest, ["doc_id"]), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def _filter(forest: Forest):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                keep = np.concatenate([forest.scores(np.array([statistics(t) for t in texts[i : i + 512]])) >= CUT for i in range(0, len(texts), 512)])
                yield batch.filter(pa.array(keep))

    return run


def keep_good(docs: DataFrame, forest: Forest) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns, without a shuffle.

    Each row stands for itself: null texts are scored as empty ones, null ids and repeated rows are kept or rejected like others.
    Columns of any name pass through. Empty input: no rows.
    """
    return docs.mapInArrow(_filter(forest), docs.schema)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
