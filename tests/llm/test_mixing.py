import hashlib
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixing


def brute(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = {}
    for _, t, s in rows:
        sources[s] = sources.get(s, 0) + size(t)
    order = sorted(sources, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sources.values()), set()
    while True:
        open_ = [s for s in sources if s not in full]
        left = total - sum(3 * sources[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sources[s]}
        if not over:
            return {**share, **{s: 3 * sources[s] for s in full}}, sources
        full |= over


ROWS = [(i, "w " * (i * 7 % 50), ["a", "b", "Z", None, "é"][i % 5]) for i in range(200)] + [(500, None, "a"), (501, "", "new"), (None, "one two", "b"), (None, "one two", "b"), (7, "x " * 3000, "big")]


def test_targets_and_taken(make_docs):
    got = mixing.mix(make_docs(ROWS)).collect()
    targets, sizes = brute(ROWS)
    assert len(got) == len(ROWS)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]], rel=1e-12, abs=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert all(0 <= p <= 1 for p in r["positions"]) and list(r["positions"]) == sorted(r["positions"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in taken.items():
        assert abs(t - targets[s]) <= 1
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))


def test_rerun_and_order(make_docs):
    docs = make_docs(ROWS)
    key = lambda r: str(r.asDict())
    assert sorted(map(key, mixing.mix(docs).collect())) == sorted(map(key, mixing.mix(docs.repartition(7)).collect()))
    plan = [r["position"] for r in mixing.ordered(mixing.mix(docs)).collect()]
    known = [p for p in plan if p is not None]
    assert known == sorted(known) and all(p is None for p in plan[len(known) :])


def test_inverse(spark):
    knots = ((0.0, 1.0), (0.25, 4.0), (0.5, 0.0), (1.0, 2.0))
    shares = [i / 20 for i in range(21)]
    df = spark.createDataFrame([(s,) for s in shares], "s double").select("s", mixing.invert(knots, F.col("s")).alias("t"))
    for r in df.collect():
        area, n = 0.0, 20000
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            if r["t"] > t0:
                t = min(r["t"], t1)
                area += (t - t0) * (w0 + w0 + (w1 - w0) * (t - t0) / (t1 - t0)) / 2
        assert area / mixing.integral(knots) == pytest.approx(r["s"], abs=1e-9), n


def test_mixed_rows(make_docs):
    docs = make_docs(ROWS)
    plan = {(r["doc_id"], r["size"], r["source"]): r["repeats"] for r in mixing.mix(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r["size"] == "x" for r in rows)
    count = {}
    for r in rows:
        k = (r["doc_id"], len((r["text"] or "").split()), r["source"])
        count[k] = count.get(k, 0) + 1
    for k, n in plan.items():
        copies = sum((a, len((t or "").split()), s) == k for a, t, s in ROWS)
        if k[1] and copies == 1:
            assert count.get(k, 0) == n


def test_empty(make_docs):
    assert mixing.mix(make_docs([(1, "a", "s")]).limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix(make_docs([(1, None), (2, " \n")])).collect()] == [0, 0]


def test_rows_without_or_with_one_id(make_docs):
    """Different texts under one id, or none, keep their own turns; rows equal in id, text and source share theirs."""
    rows = [(None, f"text number {i} " + "w " * i, "a") for i in range(30)] + [(7, f"other text {i} " + "v " * i, "b") for i in range(30)] + [(8, "the same words", "c")] * 4
    rows += [(9, "the same words", None), (9, "the same words", "+"), (9, "the same words", "")]
    docs = make_docs(rows)
    want = {}
    for r in mixing.mix(docs).collect():
        text = {(d, s, hashlib.md5(f"{'' if d is None else d}:{t}".encode()).hexdigest()): t for d, t, s in rows}[r["doc_id"], r["source"], r["digest"]]
        key = (r["doc_id"], text, r["source"])
        want[key] = want.get(key, 0) + r["repeats"]
    have = {}
    for r in mixing.mixed(docs).collect():
        key = (r["doc_id"], r["text"], r["source"])
        have[key] = have.get(key, 0) + 1
    assert have == {k: n for k, n in want.items() if n}


def test_a_very_long_text(make_docs):
    got = {r["doc_id"]: r for r in mixing.mix(make_docs([(1, "w " * 400000, "a"), (2, "x y", "a"), (3, "z", "b")])).collect()}
    assert got[1]["size"] == 400000 and got[1]["taken"] <= 3 * 400000 and got[3]["taken"] <= 3
