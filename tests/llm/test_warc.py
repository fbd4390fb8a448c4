import gzip
import hashlib

import pytest

from plumbline.llm import warc

PAGES = "page_id long, url string, html string, file string, leaf string, digest string, total string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], PAGES)


ROWS = [(i, f"http://h/{i}", f"<p>{i} é</p>" * (i % 5)) for i in range(300)] + [(3, "http://h/3", "<p>3 é</p>" * 3), (None, None, None), (None, "u", "x"), (400, "http://big", "z" * 500000)]


def test_trees_match_plain_hashing(spark):
    got = warc.audit(pages(spark, ROWS), pages(spark, ROWS)).collect()
    assert len(got) == len(set(ROWS)) and not any(r["damaged"] for r in got)
    files = {}
    for r in got:
        files.setdefault(r["file"], []).append(r)
    for rows in files.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == [sum(x["length"] for x in rows[:i]) for i in range(len(rows))]
        level = [r["digest"] for r in rows]
        while len(level) > 1:
            level = [hashlib.sha256("".join(level[i : i + 16]).encode()).hexdigest() for i in range(0, len(level), 16)]
        assert {r["root"] for r in rows} == set(level)


def test_damage_is_located(spark):
    bad = {5, 77, 299}
    other = [(i, u, (h + "!") if i in bad else h) for i, u, h in ROWS]
    # the same length keeps the layout
    one = [(i, u, (h + "?") if i in bad else h) for i, u, h in ROWS]
    found = {r["page_id"] for r in warc.audit(pages(spark, one), pages(spark, other)).collect() if r["damaged"]}
    assert found == bad
    lost = [r for r in ROWS if r[0] != 299]
    assert any(r["damaged"] for r in warc.audit(pages(spark, ROWS), pages(spark, lost)).collect() if r["page_id"] in (299, 400))
    assert warc.audit(pages(spark, []), pages(spark, ROWS)).count() == 0
    assert warc.audit(pages(spark, ROWS[:1]), pages(spark, ROWS[:1])).count() == 1


def test_lost_added_and_longer_records_move_no_others(spark):
    # with the records added, B alone passes the size of a file
    added = [(i, f"http://new/{i}", "n" * 2000) for i in range(1000, 1300)]
    other = [(i, u, h + " longer" if i == 42 else h) for i, u, h in ROWS if i not in (7, 150)] + added
    other.remove((3, "http://h/3", "<p>3 é</p>" * 3))
    a, b = pages(spark, ROWS), pages(spark, other)
    got = {r["page_id"]: r["digest_b"] for r in warc.audit(a, b, 600_000).collect() if r["damaged"]}
    assert set(got) == {7, 42, 150} and got[7] is got[150] is None and got[42]
    have = sorted((r["status"], r["page_id"], r["copies_a"], r["copies_b"]) for r in warc.differences(a, b).collect())
    want = [("changed", 42, 0, 1), ("changed", 42, 1, 0), ("missing", 3, 2, 1), ("missing", 7, 1, 0), ("missing", 150, 1, 0)] + [("extra", i, 0, 1) for i, _, _ in added]
    assert have == sorted(want)
    assert warc.differences(a, a).count() == 0 and warc.differences(pages(spark, []), a).count() == len(set(ROWS))


@pytest.mark.parametrize("packed", [False, True])
def test_reading_files(spark, tmp_path, packed):
    data = b"".join(f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Target-URI: http://h/{i}\r\nContent-Length: {n}\r\n\r\n".encode() + b"\r" * n + b"\r\n\r\n" for i, n in enumerate((0, 7, 4000)))
    (tmp_path / "a.warc").write_bytes(gzip.compress(data) if packed else data)
    got = warc.read_warc(spark, str(tmp_path)).orderBy("offset").collect()
    assert [(r["record_id"], r["url"], len(r["body"])) for r in got] == [(f"<urn:page:{i}>", f"http://h/{i}", n) for i, n in enumerate((0, 7, 4000))]
    assert got[-1]["offset"] + got[-1]["length"] == len(data)


def plain_report(a, b):
    """(page_id, url, html) of each record of either replica with its status, by pairing records of one page and address in the order of digests."""
    body = lambda r: (f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if r[0] is None else r[0]}>\r\nWARC-Target-URI: {r[1] or ''}\r\nContent-Length: {len((r[2] or '').encode())}\r\n\r\n{r[2] or ''}\r\n\r\n").encode()
    count = lambda rows: {k: sum((r[0], r[1] or "", hashlib.sha256(body(r)).hexdigest()) == k for r in rows) for k in {(r[0], r[1] or "", hashlib.sha256(body(r)).hexdigest()) for r in rows}}
    ca, cb = count(a), count(b)
    out = [(*k, "same" if ca[k] == cb[k] else "damaged", None if ca[k] == cb[k] else k[2]) for k in ca if k in cb]
    for name in {k[:2] for k in [*ca, *cb]}:
        lost, gained = (sorted(k[2] for k in x if k[:2] == name and k not in y) for x, y in ((ca, cb), (cb, ca)))
        for i in range(max(len(lost), len(gained))):
            one, two = (x[i] if i < len(x) else None for x in (lost, gained))
            out.append((*name, one, "missing" if two is None else "added" if one is None else "damaged", two))
    return sorted(out, key=str)


def test_report_finds_exactly_what_changed(spark):
    import random

    rng = random.Random(12)
    for n in (0, 1, 40, 700):
        a = [(rng.choice([None, *range(n)]), rng.choice([None, "u", "v"]), rng.choice(["", "x", "y" * 400, None])) for _ in range(n)]
        b = [r if rng.random() > 0.2 else (r[0], r[1], (r[2] or "") + rng.choice("!?")) for r in a if rng.random() > 0.1] + [(rng.randrange(n + 9), "w", "new") for _ in range(n // 9)]
        for one, two in ((a, b), (b, a), (a, a), (a, [])):
            got = warc.report(pages(spark, one), pages(spark, two), 20_000).collect()
            have = sorted(((r["page_id"], r["url"], r["digest"], r["status"], r["digest_b"]) for r in got), key=str)
            assert have == plain_report(one, two)
            assert all((r["root"] is None) == (r["status"] == "added") for r in got)
