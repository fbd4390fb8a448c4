import random
import re

import pytest

import corpus_pipeline
from plumbline.llm import mixing, quality

from .test_ngram_join import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, prose):
    rng = random.Random(8)
    path = tmp_path_factory.mktemp("tables")
    items = [(i, prose(5000 + i, 30)) for i in range(5)]
    rows, labels = [], []
    for i in range(300):
        text = prose(i, 60 + i % 40)
        if i % 10 == 3:
            text = text.upper().replace(" ", "!! ")
        elif i % 10 == 5:
            text = rows[i - 3][1] + " extra"
        elif i % 10 == 7:
            text = text + " " + items[i % 5][1]
        rows.append((i, text, "en", f"src{rng.randrange(5)}", len(text)))
        labels.append((i, int(i % 10 != 3), 0))
    rows += [(900, None, None, None, None), (901, "", "en", "src1", 0), (None, prose(77, 50), "en", "src1", 9), (8, rows[8][1], "en", "src1", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_stages(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    good = corpus_pipeline.quality_stage(spark, docs, path)
    kept = good.collect()
    assert good.columns == columns and {r["doc_id"] for r in kept} >= {i for i, *_ in rows if i is not None and i < 300 and i % 10 != 3}
    assert not {r["doc_id"] for r in kept} & {i for i in range(300) if i % 10 == 3}

    near = corpus_pipeline.near_duplicate_stage(spark, good, path)
    classes = brute([(r["doc_id"], r["text"]) for r in kept])
    want = sorted({d for d, c, _ in classes if d == c and d is not None}) + [None] * sum(d is None for d, _, _ in classes)
    left = near.collect()
    assert near.columns == columns and sorted((r["doc_id"] for r in left), key=lambda d: (d is None, d)) == want

    clean = corpus_pipeline.decontamination_stage(spark, near, path)
    held = lambda t: any(i in (t or "") for _, i in items)
    remaining = clean.collect()
    assert sorted(map(str, remaining)) == sorted(str(r) for r in left if not held(r["text"]))

    mix = corpus_pipeline.mixing_stage(spark, clean, path)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert mix.columns == columns
    targets = {r["source"]: r["target"] for r in mixing.mix(clean).collect()}
    taken, largest = {}, max(words(r["text"]) for r in remaining)
    for r in mix.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + words(r["text"])
    for s, t in targets.items():
        assert abs(taken.get(s, 0) - t) <= largest

    last = corpus_pipeline.sharding_stage(spark, mix, path).collect()
    assert len(last) == mix.count()
    counts = [sum(r["shard"] == k for r in last) for k in range(24)]
    assert max(counts) - min(counts) <= 1
    assert corpus_pipeline.run(spark, path).count() == len(last)
    assert len(quality.STATISTICS) == len(quality.statistics("a b"))


def test_empty_tables(spark, folder, tmp_path):
    path, *_ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_stand_for_themselves(spark, make_docs, prose):
    """Copies under null and repeated ids go as well; extra columns, ties and very long texts pass through."""
    long = prose(1, 30000)
    rows = [(1, prose(2, 60)), (5, prose(3, 60)), (5, prose(2, 60)), (None, prose(2, 60)), (None, prose(4, 60)), (None, prose(4, 60) + " end"), (6, long), (7, long), (8, None), (9, ""), (9, "")]
    docs = make_docs(rows)
    left = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert left.schema == docs.schema
    got = left.collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got if r["doc_id"]) == sorted([("1", rows[0][1]), ("5", rows[1][1]), ("6", long), ("8", ""), ("9", ""), ("9", "")])
    assert sum(r["doc_id"] is None for r in got) == 1
    mix = corpus_pipeline.mixing_stage(spark, left, "")
    assert mix.schema == docs.schema and corpus_pipeline.sharding_stage(spark, mix, "").count() == mix.count()
