import math
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from plumbline.llm import sharding


@pytest.mark.parametrize("n,bits", [(2, 4), (3, 3), (1, 5)])
def test_curve_visits_neighbours(spark, n, bits):
    points = list(product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(points, ", ".join(f"a{i} long" for i in range(n)))
    got = df.withColumn("h", sharding.hilbert([F.col(f"a{i}") for i in range(n)], bits)).orderBy("h").collect()
    assert [r["h"] for r in got] == list(range(len(points)))
    for a, b in zip(got, got[1:]):
        assert sum(abs(a[i] - b[i]) for i in range(n)) == 1


def test_shards(make_docs, prose):
    rows = [(i, prose(i, i % 90), ["a", "b", None][i % 3]) for i in range(301)] + [(i + 1000, "copy of one text", "abc"[i % 3]) for i in range(100)]
    rows += [(None, None), (2000, ""), (2001, "é" * 100000), (5, rows[5][1], rows[5][2])]
    got = sharding.shard(make_docs(rows)).collect()
    assert len(got) == len(rows)
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r)
        assert r["law"] == "rows" and r["grown_shard"] is None
    sizes = [len(v) for v in shards.values()]
    assert set(shards) == set(range(24)) and max(sizes) - min(sizes) <= 1
    for v in shards.values():
        assert sorted(r["slot"] for r in v) == list(range(len(v)))
    text = {}
    for d, t, *_ in rows:
        text[d] = (t or "").encode()
    for r in got:
        assert r["size"] == len(text[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]])
    # rows of one text lie side by side
    line = [r["text_crc32"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    copy = [i for i, c in enumerate(line) if c == zlib.crc32(b"copy of one text")]
    assert copy == list(range(copy[0], copy[0] + 100))


def test_small_and_empty(make_docs):
    assert sorted((r["shard"], r["slot"]) for r in sharding.shard(make_docs([(1, "a"), (2, "b")])).collect()) == [(0, 0), (12, 0)]
    assert sharding.shard(make_docs([(1, "a")]).limit(0)).count() == 0


def skilling(axes, bits):
    """Place on the curve, on plain integers: axes to transposed form, then its bits in turn."""
    x, n = list(axes), len(axes)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    out = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out * 2 + ((x[i] ^ t) >> b & 1)
    return out


def test_query_against_brute_force(spark, tmp_path, make_docs, prose):
    rows = [(i, prose(i % 150, 5 + i % 150 * 3), ["a", "b", None, "é"][i % 4]) for i in range(400)] + [(None, None, "a"), (None, "", None), (3, "x" * 50000, "zz")]
    docs = make_docs(rows).withColumn("lang", F.expr("case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then 'en' else 'fr' end")).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    full = [(r["doc_id"], r["text"] or "", r["lang"], r["source"]) for r in docs.collect()]
    least = {}
    for _, t, lang, source in full:
        old = least.get(t, (None, None))
        least[t] = tuple(min((v for v in (a, b) if v is not None), default=None, key=lambda v: v.encode()) for a, b in zip(old, (source, lang)))
    place = lambda k: {v: i * 1024 // len(d) for d in [sorted({x[k] for x in least.values()}, key=lambda v: (v is not None, (v or "").encode()))] for i, v in enumerate(d)}
    at, tongue = place(0), place(1)
    log = lambda n: min(int(math.log2(n) * 1024 / 32), 1023)
    curve = {t: skilling([log(len(t.encode()) + 8), at[s], tongue[lang]], 10) for t, (s, lang) in least.items()}
    got = sharding.op9_hilbert_shards(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["text_crc32"], r["curve"]) for r in got) == sorted((str(d), zlib.crc32(t.encode()), curve[t]) for d, t, *_ in full)
    line = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in line] == sorted(r["curve"] for r in got)
    assert [r["shard"] for r in line] == [i * 24 // len(line) for i in range(len(line))]


def test_ranges_skip_shards(make_docs, prose):
    rows = [(i, prose(i, 4 ** (1 + i % 5)), f"s{i % 4}") for i in range(600)]
    sharded = sharding.shard(make_docs(rows))
    ranges = sharding.shard_ranges(sharded).collect()
    assert sum(r["rows"] for r in ranges) == 600
    got = sharded.collect()
    for r in ranges:
        own = [x for x in got if x["shard"] == r["shard"]]
        assert r["least_source"] == min(x["axis_source"] for x in own) and r["most_size"] == max(x["axis_size"] for x in own)
    # documents of one source and one size lie in few shards, and the ranges rule out most others
    want = next(x for x in got if x["doc_id"] == 4)
    held = {x["shard"] for x in got if (x["axis_source"], x["axis_size"]) == (want["axis_source"], want["axis_size"])}
    read = {r["shard"] for r in ranges if r["least_source"] <= want["axis_source"] <= r["most_source"] and r["least_size"] <= want["axis_size"] <= r["most_size"]}
    assert held <= read and len(read) <= 12
