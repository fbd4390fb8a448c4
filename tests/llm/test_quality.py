import zlib

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import quality


def test_forest_matches_plain_traversal():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    f = quality.fit(x, y, trees=30)
    assert ((f.scores(x) > 0.5) == y).mean() > 0.97

    def walk(row):
        total = f.base
        for root in f.roots:
            i = root
            while not f.leaf[i]:
                i = f.left[i] + (row[f.feature[i]] > f.cut[i])
            total += f.value[i]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(r) for r in x[:50]], f.scores(x[:50]))


def test_constant_models():
    none = quality.fit(np.zeros((0, 23)), np.zeros(0))
    assert np.allclose(none.scores(np.zeros((3, 23))), 0.5)
    assert (quality.fit(np.zeros((9, 23)), np.ones(9)).scores(np.zeros((2, 23))) > 0.5).all()


def corpus(prose):
    rows, labels = [], []
    for i in range(400):
        text = prose(i, 80 + i % 50)
        bad = i % 4 == 0
        if bad:
            text = [text.upper().replace(" ", "!! "), text.replace(" ", " | "), " ".join([text.split()[0]] * 90), text.replace(" ", "%%% ")][i // 4 % 4]
        rows.append((i, text))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_held_out_accuracy(spark, make_docs, prose):
    rows, labels = corpus(prose)
    rows += [(1000, None), (1001, ""), (None, "abc def"), (3, rows[3][1]), (1002, prose(9, 40000))]
    docs = make_docs(rows)
    table = spark.createDataFrame(labels + [(3, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    forest = quality.train(docs, table)
    got = quality.score(docs, forest).collect()
    assert len(got) == len(rows)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 40 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)


def test_held_out_labels_are_not_learnt(spark, make_docs, prose):
    rows, labels = corpus(prose)
    docs = make_docs(rows)
    a = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    b = a.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    x = np.array([quality.statistics(t) for _, t in rows])
    assert np.array_equal(quality.train(docs, a).scores(x), quality.train(docs, b).scores(x))


def test_filter_keeps_columns(spark, make_docs, prose):
    rows, labels = corpus(prose)
    docs = make_docs(rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = quality.keep_good(docs, quality.train(docs, table))
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} >= {i for i, q, _ in labels if q}
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), table)).count() == 0


def test_a_repeated_id_is_one_row(spark, make_docs, prose, monkeypatch):
    rows, labels = corpus(prose)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((x, y)))
    hot = next(i for i, _ in rows if zlib.crc32(str(i).encode()) % 5)
    quality.train(make_docs(rows), table)
    quality.train(make_docs(rows + [(hot, rows[hot][1])] * 500), table)
    quality.train(make_docs(rows + [(hot, rows[hot][1])] * 500), table, sample=10)
    assert np.array_equal(seen[0][0], seen[1][0]) and np.array_equal(seen[0][1], seen[1][1]) and len(seen[2][0]) <= 10


def test_query_against_plain_traversal(spark, tmp_path, make_docs, prose):
    """The query's scores are those of trees walked one by one, fitted on the rows that are not held out."""
    rows, labels = corpus(prose)
    rows += [(1000, None), (1001, ""), (1002, "x " * 30000)]
    make_docs(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    learnt = [(i, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 5]
    x = np.array([quality.statistics(rows[i][1]) for i, _ in learnt])
    y = np.array([float(q) for _, q in learnt])
    order = np.lexsort((*x.T, y))
    forest = quality.fit(x[order], y[order])

    def walk(row):
        total = forest.base
        for i in forest.roots:
            while not forest.leaf[i]:
                i = forest.left[i] + (row[forest.feature[i]] > forest.cut[i])
            total += forest.value[i]
        return 1 / (1 + np.exp(-total))

    got = {r["doc_id"]: r for r in quality.op2_quality(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, _ in rows}
    for i, t in rows:
        want = walk(quality.statistics(t))
        assert abs(got[i]["score"] - want) < 1e-9 and got[i]["predicted"] == int(want >= 0.3)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
