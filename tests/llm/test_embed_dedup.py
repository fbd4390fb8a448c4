import numpy as np

from plumbline.llm import embed_dedup

SCHEMA = "vec_id long, embedding array<double>, label int, size string, rep string, dim string, e string"


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(df).collect()), key=str)


def brute(rows):
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ok = []
    for i, e, label in rows:
        v = np.array([np.nan if x is None else x for x in e], float) if e is not None else np.array([])
        ok.append(v if i is not None and label is not None and len(v) and np.isfinite(v).all() and v.any() else None)
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] is not None and ok[b] is not None and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]):
                if ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.93:
                    links[a] += 1
                    links[b] += 1
                    parent[find(a)] = find(b)
    low = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            low[find(k)] = min(low.get(find(k), r[0]), r[0])
    return sorted(((r[0], links[k], low[find(k)] if r[0] is not None else None, r[0] is None or low[find(k)] == r[0]) for k, r in enumerate(rows)), key=str)


def vectors(seed, n):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            v = np.array(rows[rng.integers(len(rows))][1])
            v = v + rng.normal(size=16) * np.linalg.norm(v) / 4 * rng.choice([0.05, 0.3, 0.4])
        else:
            v = rng.normal(size=16)
        rows.append((i, [float(x) for x in v], int(rng.integers(2))))
    return rows


def test_brute_force_and_blocks(spark, monkeypatch):
    rows = vectors(3, 300)
    base = rows[0][1]
    rows += [(1000, [x * 3 for x in base], rows[0][2]), (1001, base, rows[0][2]), (0, base, rows[0][2]), (1002, base, None), (None, base, rows[0][2]), (1003, None, 0), (1004, [], 0), (1005, [0.0] * 16, 0),
             (1006, [None] * 16, 0), (1007, [float("nan")] * 16, 0), (1008, [float("inf")] * 16, 0), (1009, [1.0, 2.0], 0), (1010, [1.0, 2.0], 0), (1011, [-0.0, 1e-300], 0), (1012, [0.0, 1e-300], 0), (1013, [1e300, 2e300], 0)]
    want = brute([r for r in rows if r[0] not in (1011, 1012, 1013)])
    assert got(spark, [r for r in rows if r[0] not in (1011, 1012, 1013)]) == want
    monkeypatch.setattr(embed_dedup, "BLOCK", 40)
    assert got(spark, [r for r in rows if r[0] not in (1011, 1012, 1013)]) == want
    extremes = {r[0]: r for r in got(spark, rows)}
    assert extremes[1011][1:3] == (1, 1011) and extremes[1012][2] == 1011 and extremes[1013][1] == 2


def test_calibration():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(20000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 0.93 * a + np.sqrt(1 - 0.93**2) * b
    p = embed_dedup.directions(64)
    window = embed_dedup.WIDTH * np.sqrt(2 - 2 * 0.93)
    met = (np.abs(a @ p - c @ p) <= window).sum(axis=1) >= embed_dedup.calibrated()
    assert met.mean() > 0.999
    q, r = embed_dedup.candidates((a[:50] @ p).astype(np.float32), (c[:90] @ p).astype(np.float32), window, embed_dedup.calibrated())
    full = {(i, j) for i in range(50) for j in range(90) if (np.abs((a[i] @ p).astype(np.float32) - (c[j] @ p).astype(np.float32)) <= window).sum() >= embed_dedup.calibrated()}
    assert len(full ^ set(zip(q.tolist(), r.tolist()))) <= 1


def test_empty(spark):
    assert got(spark, []) == []


def test_cells_of_large_labels(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 4)
    rows = vectors(11, 400)
    rows += [(2000 + i, rows[0][1], rows[0][2]) for i in range(30)]
    runs, cuts = embed_dedup.cutting(150, 4)
    assert runs > 1 and cuts > 1
    assert got(spark, rows) == brute(rows)


def test_cells_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(8)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (b * a).sum(axis=1, keepdims=True) * a
    c = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    lines, shift = rng.standard_normal((64, 4000)), rng.random(4000)
    cell = lambda x: np.floor(x @ lines / embed_dedup.CELL + shift)
    assert abs((cell(a) == cell(c)).mean() - embed_dedup.same_cell(np.sqrt(0.14))) < 0.005
    assert abs((cell(a) == cell(a[::-1])).mean() - embed_dedup.same_cell(np.sqrt(2))) < 0.005
    for size in (10**5, 10**7, 10**9):
        runs, cuts = embed_dedup.cutting(size)
        assert 1 - (1 - embed_dedup.same_cell(np.sqrt(0.14)) ** cuts) ** runs >= embed_dedup.RECALL and runs < size / embed_dedup.BLOCK
