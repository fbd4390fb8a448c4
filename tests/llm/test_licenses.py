from plumbline.llm import licenses


def brute(rows, templates=licenses.TEMPLATES):
    """(doc_id, license, variant): the largest share of the notice's shingles in a run one and a half times as long, and where the first run with 0.8 begins."""
    grams = lambda w: [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    notices = [(n, v, grams(licenses.words_of(t))) for n, variants in templates.items() for v, t in enumerate(variants)]
    out = {}
    for d, text in rows:
        sh = grams(licenses.words_of(text or ""))
        for n, v, own in notices:
            reach = -(-len(own) * 3 // 2)
            runs = [(len(set(sh[p : p + reach]) & set(own)), p) for p, g in enumerate(sh) if g in own]
            enough = [p for c, p in runs if 10 * c >= 8 * len(set(own))]
            if enough:
                out[d, n, v] = (round(max(c for c, _ in runs) / len(set(own)), 9), enough[0])
    return out


def found(df):
    return {(r["doc_id"], r["license"], r["variant"]): (round(r["containment"], 9), r["first_word"]) for r in df.collect()}


def test_brute_force(make_docs, prose):
    texts = [t for v in licenses.TEMPLATES.values() for t in v]
    rows = [(i, prose(i, 20 + i) + "\n" + t + "\n" + prose(99 + i, 60)) for i, t in enumerate(texts)]
    rows += [(50, None), (51, ""), (52, "all rights"), (53, "All  RIGHTS-reserved"), (54, prose(3, 60000) + " Released under the MIT License. " + prose(4, 50)), (55, prose(7, 400))]
    mit = texts[4].split()
    rows += [(60, " ".join(mit[:40])), (61, " ".join(w if i % 9 else "zzz" for i, w in enumerate(mit))), (62, " ".join(w if i != 30 else "zzz" for i, w in enumerate(mit)))]
    # halves of a notice far apart, a long insertion, and the notice many times over
    rows += [(70, " ".join(mit[:35]) + " " + prose(8, 200) + " " + " ".join(mit[35:])), (71, " ".join(mit[:30]) + " " + prose(9, 12) + " " + " ".join(mit[30:])), (72, (texts[0] + " " + texts[4] + "\n") * 40)]
    got = found(licenses.find_licenses(make_docs(rows + [rows[0]])))
    want = brute(rows)
    assert got == want and len(want) > 10
    assert not any(k[0] in (50, 51, 52, 55, 60, 70) for k in got) and (53, "all-rights-reserved", 0) in got and {(62, "mit", 1), (71, "mit", 1)} <= set(got)


def test_one_changed_word_anywhere(make_docs, prose):
    """A changed word costs three shingles at most, wherever it stands."""
    rows = []
    for name, v in (("bsd", 0), ("mit", 1), ("apache-2.0", 1)):
        words = licenses.TEMPLATES[name][v].split()
        rows += [(len(rows) + i, prose(i, 30) + " " + " ".join("changed" if k == i else w for k, w in enumerate(words)) + " " + prose(i + 7, 30)) for i in range(len(words))]
    got = found(licenses.find_licenses(make_docs(rows)))
    assert got == brute(rows)
    assert {d for d, *_ in got} == {d for d, _ in rows}


def test_rows_stand_for_themselves(make_docs):
    line = "Released under the MIT License."
    mit = licenses.TEMPLATES["mit"][1].split()
    rows = [(None, line), (None, line), (None, " ".join(mit[:35])), (None, " ".join(mit[35:])), (1, line), (1, line)]
    assert sorted((str(r["doc_id"]), r["license"]) for r in licenses.find_licenses(make_docs(rows)).collect()) == [("1", "mit")] * 2 + [("None", "mit")] * 2
    assert licenses.find_licenses(make_docs(rows).limit(0)).count() == 0


def test_template_tables(spark, make_docs, prose, tmp_path, monkeypatch):
    """Full texts as a table, broadcast or not; null, empty and short templates find nothing."""
    (tmp_path / "Long-1.0.txt").write_text(prose(1, 900) + "\n" + prose(2, 900))
    (tmp_path / "Other-2.0").write_text(prose(3, 300))
    templates = licenses.read_templates(spark, str(tmp_path))
    templates = templates.union(spark.createDataFrame([("none", 0, None), ("short", 0, "two words"), ("empty", 0, "")], "license string, variant int, text string"))
    long = (prose(1, 900) + " " + prose(2, 900)).split()
    rows = [(1, prose(9, 99) + " " + " ".join(long)), (2, " ".join("x" if i % 20 == 0 else w for i, w in enumerate(long))), (3, " ".join("x" if i % 9 == 0 else w for i, w in enumerate(long))), (4, prose(3, 300) + " two words")]
    want = brute(rows, {"Long-1.0": [" ".join(long)], "Other-2.0": [prose(3, 300)]})
    assert {k[:2] for k in want} == {(1, "Long-1.0"), (2, "Long-1.0"), (4, "Other-2.0")}
    assert found(licenses.find_licenses(make_docs(rows), templates)) == want
    monkeypatch.setattr(licenses, "BROADCAST_KEYS", 10)
    assert found(licenses.find_licenses(make_docs(rows), templates)) == want
