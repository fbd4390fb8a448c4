import random
import re

import numpy as np

from plumbline.llm import ngram_join
from plumbline.llm.common import shingle_set, word_hashes


def shingles(text):
    words = [w for w in re.split("[^a-z0-9\x80-\U0010ffff]+", (text or "").lower()) if w] or [w for w in re.split(r"[\x20\x09-\x0d]+", (text or "").lower()) if w]
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = [shingles(t) if i is not None else frozenset() for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both * 10 >= 8 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, low[find(i)] if d is not None else None, links[i]) for i, (d, _) in enumerate(rows)), key=str)


def changed(text, n, rng):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def got(docs):
    return sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.jaccard_join(docs).collect()), key=str)


def test_brute_force(make_docs, prose):
    rng = random.Random(5)
    passage = prose(77, 60)
    rows, n = [], 0
    for g in range(40):
        base = prose(g, rng.choice([5, 6, 20, 80, 300])) + (" " + passage if g % 3 == 0 else "")
        for k in range(rng.choice([1, 1, 2, 4])):
            rows.append((n, base if k == 1 else changed(base, k * len(base.split()) // 100, rng)))
            n += 1
    rows += [(n, "One two"), (n + 1, "one  TWO\n"), (n + 2, ""), (n + 3, None), (n + 4, " \t"), (None, rows[0][1]), (0, rows[0][1]), (n + 5, "x " * 5000), (n + 6, "a" * 3000000), (n + 7, "?! ... -"), (n + 8, "?! ... -"), (n + 9, "One, two!")]
    assert got(make_docs(rows)) == brute(rows)


def test_large_groups_split_into_blocks(make_docs, prose, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "SMALL", 8)
    rng = random.Random(6)
    base = prose(1, 200)
    rows = [(i, changed(base, rng.randrange(4), rng)) for i in range(80)] + [(100 + i, prose(1000 + i, 40) + " " + base[:200]) for i in range(40)]
    assert got(make_docs(rows)) == brute(rows)


def test_empty_and_same_id(make_docs):
    assert got(make_docs([(1, "a")]).limit(0)) == []
    assert got(make_docs([(1, "a b c d e f"), (1, "g h i j k l")])) == [(1, 1, 0), (1, 1, 0)]
    assert got(make_docs([(1, None)])) == [(1, 1, 0)]


def test_hashes_do_not_depend_on_batching(prose):
    texts = [prose(i, i * 37 % 200) for i in range(30)] + [None, "", "a" * 2_000_000 + " b c", " x " * 700_000]
    together = word_hashes(texts)
    for t, h in zip(texts, together):
        assert (word_hashes([t])[0] == h).all() and len(h) == len((t or "").split())
    assert len(shingle_set(together[0][:0])) == 0


def test_runs_reach_their_recall():
    """Pairs of sets at Jaccard 0.8, their coordinates and paths drawn as the join draws them."""
    rng = np.random.default_rng(3)
    pairs, runs = 6000, ngram_join.runs_needed()
    tokens = rng.integers(0, 1 << 63, (pairs, 100), dtype=np.uint64)
    a, b = ngram_join.sketches(list(tokens[:, :90])), ngram_join.sketches(list(tokens[:, 10:]))
    agree = a == b
    assert abs(agree.mean() - 0.8) < 0.01
    met = np.zeros(pairs, bool)
    for _ in range(runs):
        # a path's coordinates are those of its hash: any, and the same one may come twice
        path = rng.integers(0, ngram_join.COORDINATES, (pairs, ngram_join.DEPTH))
        met |= np.take_along_axis(agree, path, axis=1).all(axis=1)
    assert met.mean() >= 0.999
    assert ngram_join.meeting(runs) >= ngram_join.RECALL > ngram_join.meeting(runs - 1)
