"""WARC records and a Merkle fixity audit of replicas."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import checkpoint

#: Children of a tree node.
FAN_BITS = 4
#: Wanted bytes of a WARC file.
FILE_BYTES = 64 << 20


def _plain(pages: DataFrame) -> DataFrame:
    """page_id, url, h (a hash of both, which names the record), length and digest of the record of every row."""
    body = F.coalesce("html", F.lit(""))
    url = F.coalesce("url", F.lit(""))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), name, F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    rows = pages.withColumn("record", F.concat(head, body, F.lit("\r\n\r\n")))
    return rows.select("page_id", url.alias("url"), F.md5(F.concat(name, F.lit(" "), url)).alias("h"), F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))


def records(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """WARC resource records of (page_id, url, html) rows, laid out in files: file, page_id, offset, length, digest, record.

    Equal rows are stored once. A record's file follows from a hash of page and address and from the whole table's
    size, so files are near ``file_bytes`` long; in a file records go by page_id (null first), then digest. Null url or html
    is empty. Empty input: no rows. Only ids, lengths and digests are shuffled; the record's text is built again where needed.
    """
    return _laid(_plain(pages).drop("url").distinct(), file_bytes).drop("h")


def _laid(rows: DataFrame, file_bytes: int) -> DataFrame:
    return _placed_in_files(rows, rows.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("total")), file_bytes).select("file", "page_id", "h", "leaf", "offset", "length", "digest")


def _in_file(rows: DataFrame, file_bytes: int) -> DataFrame:
    """Add ``file`` to rows with ``h`` and the ``total`` bytes that are dealt."""
    files = F.greatest(F.ceil(F.col("total") / F.lit(file_bytes)), F.lit(1).cast("long"))
    return rows.withColumn("file", F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), files)).drop("total")


def _placed_in_files(rows: DataFrame, total: DataFrame, file_bytes: int) -> DataFrame:
    """Add file, leaf and offset. A window holds one file's rows, and a file is near ``file_bytes`` long."""
    at = W.Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "digest")
    dealt = _in_file(rows.crossJoin(F.broadcast(total)), file_bytes).withColumn("leaf", (F.row_number().over(at) - 1).cast("long"))
    return dealt.withColumn("offset", F.sum("length").over(at.rowsBetween(W.Window.unboundedPreceding, 0)) - F.col("length"))


def tree(leaves: DataFrame) -> list[DataFrame]:
    """Levels of the Merkle trees of all files, leaves first: (file, node, start, end, hash) each.

    A node's hash is the sha256 of its children's, in order; it covers the offsets from its first child's start to
    its last one's end. A level has a sixteenth of the nodes of the one below, and a node gathers sixteen rows at most.
    """
    level = checkpoint(leaves.select("file", F.col("leaf").alias("node"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"), F.col("digest").alias("hash")))
    out = [level]
    while (level.agg(F.max("node").alias("m")).first()["m"] or 0) > 0:
        up = level.groupBy("file", F.shiftright("node", FAN_BITS).alias("node")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "hash"))), lambda x: x["hash"]), ""), 256).alias("hash"))
        level = checkpoint(up)
        out.append(level)
    return out


def damaged(one: list[DataFrame], two: list[DataFrame]) -> DataFrame:
    """Leaves where two replicas' trees differ: file, node, start, end, hash_a, hash_b (null where a replica has none).

    Roots are compared first; below, only children of mismatching nodes. Trees of unequal height (records lost or
    added) meet at the height of the lower one, where all its nodes are compared.
    """
    height = min(len(one), len(two)) - 1
    bad = None
    for k in range(height, -1, -1):
        a, b = one[k], two[k]
        if bad is not None:
            parents = bad.select("file", F.col("node").alias("parent"))
            child = lambda x: x.withColumn("parent", F.shiftright("node", FAN_BITS)).join(parents, ["file", "parent"], "left_semi").drop("parent")
            a, b = child(a), child(b)
        both = a.withColumnsRenamed({"start": "sa", "end": "ea", "hash": "hash_a"}).join(b.withColumnsRenamed({"start": "sb", "end": "eb", "hash": "hash_b"}), ["file", "node"], "full")
        bad = both.where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select("file", "node", F.coalesce("sa", "sb").alias("start"), F.coalesce("ea", "eb").alias("end"), "hash_a", "hash_b")
        bad = checkpoint(bad)
    return bad


def _placed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Replica B's digests at the leaves of A's layout: a record that A has too at its leaf, any other one at the leaf of a record
    of the same page and address that B has lost, in the order of digests. A leaf without either is left out."""
    rank = lambda x: x.withColumn("rank", F.row_number().over(W.Window.partitionBy("h").orderBy("digest")))
    both = a.join(b.select("h", "digest", F.lit(True).alias("same")), ["h", "digest"], "left")
    lost = rank(both.where("same is null")).select("file", "leaf", "offset", "length", "h", "rank")
    gained = rank(b.join(a.select("h", "digest"), ["h", "digest"], "left_anti")).select("h", "rank", "digest")
    changed = lost.join(gained, ["h", "rank"]).select("file", "leaf", "offset", "length", "digest")
    return both.where("same").select("file", "leaf", "offset", "length", "digest").union(changed)


def audit(pages_a: DataFrame, pages_b: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Every record of replica A with its place, digest, its file's root and whether replica B differs there.

    Returns file, page_id, offset, length, digest, root, damaged, digest_b (B's digest where damaged, null if B has no
    such record). A's layout is the manifest of both trees and a record of B goes to the leaf of its page and address, so
    lost, added or longer records move no other leaf. Equal rows count once and records of B alone have no row; :func:`differences` has
    both. Trees grow by sixteenths; nothing but grouped hashes is shuffled. See :func:`records` for nulls.
    """
    a = checkpoint(_laid(_plain(pages_a).drop("url").distinct(), file_bytes))
    b = checkpoint(_plain(pages_b).select("h", "digest").distinct())
    one, two = tree(a), tree(_placed(a, b))
    bad = damaged(one, two).select("file", F.col("node").alias("leaf"), "hash_b", F.lit(True).alias("damaged"))
    roots = one[-1].select("file", F.col("hash").alias("root"))
    out = a.join(bad, ["file", "leaf"], "left").join(roots, "file", "left")
    return out.select("file", "page_id", "offset", "length", "digest", "root", F.coalesce("damaged", F.lit(False)).alias("damaged"), F.col("hash_b").alias("digest_b"))


def differences(pages_a: DataFrame, pages_b: DataFrame) -> DataFrame:
    """Records whose numbers of copies differ between two replicas: page_id, url, digest, length, copies_a, copies_b, status.

    A record is a page, an address (null as empty) and a digest; repeated rows are counted. status is ``missing`` if B has fewer
    copies, ``extra`` if A has, and ``changed`` if the page and address has records of both kinds. Equal replicas: no rows.
    """
    count = lambda pages, one, other: _plain(pages).groupBy("page_id", "url", "h", "digest", "length").agg(F.count("*").alias("n")).withColumns({one: F.col("n"), other: F.lit(0).cast("long")}).drop("n")
    both = count(pages_a, "copies_a", "copies_b").unionByName(count(pages_b, "copies_b", "copies_a"))
    both = both.groupBy("page_id", "url", "h", "digest", "length").agg(F.sum("copies_a").alias("copies_a"), F.sum("copies_b").alias("copies_b")).where("copies_a <> copies_b")
    kinds = both.groupBy("h").agg(F.bool_or(F.expr("copies_a > copies_b")).alias("fewer"), F.bool_or(F.expr("copies_a < copies_b")).alias("more"))
    status = F.when(F.col("fewer") & F.col("more"), "changed").when(F.col("fewer"), "missing").otherwise("extra")
    return both.join(kinds, "h").select("page_id", "url", "digest", "length", "copies_a", "copies_b", status.alias("status"))


def _mark(digest: str, copies: str):
    """What a leaf holds for a record: its digest, and how often it is there if more than once."""
    return F.when(F.col(copies) > 1, F.sha2(F.concat(F.col(digest), F.lit("*"), F.col(copies).cast("string")), 256)).otherwise(F.col(digest))


def _counted(pages: DataFrame) -> DataFrame:
    return _plain(pages).groupBy("page_id", "url", "h", "length", "digest").agg(F.count("*").alias("copies"))


def report(pages_a: DataFrame, pages_b: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Every record of two replicas, with what the audit of their trees says of it.

    Returns file, page_id, url, offset, length, digest, copies, root (of A's file), status, digest_b and copies_b. A record is a page, an
    address (null as empty) and a digest, with the number of rows equal in these. One manifest serves both trees: A's records are laid out as in
    :func:`records`, by the larger replica's size, and a record that only B has goes to the leaf of A's record of the same page and address if B
    has lost that, else behind the last leaf of its file. So no record moves another one's leaf. Roots are compared first and only
    mismatching branches followed; their leaves are ``damaged`` (both replicas have a record there; also where copies differ), ``missing``
    (A alone) or ``added`` (B alone: offset, root and digest null, length that of B's record). All others are ``same``.
    Null page_id, url or html: as in :func:`records`. Two empty replicas: no rows.
    """
    a, b = checkpoint(_counted(pages_a)), checkpoint(_counted(pages_b))
    size = lambda x: F.coalesce(F.sum("length"), F.lit(0))
    total = a.agg(size(a).alias("ta")).crossJoin(F.broadcast(b.agg(size(b).alias("tb")))).select(F.greatest("ta", "tb").alias("total"))
    a = checkpoint(_placed_in_files(a, total, file_bytes))
    rank = lambda x, by: x.withColumn("rank", F.row_number().over(W.Window.partitionBy("h").orderBy(by)))
    other = b.select(F.col("h").alias("hb"), F.col("digest").alias("digest_b"), F.col("copies").alias("copies_b"), F.col("length").alias("length_b"), F.col("page_id").alias("page_b"), F.col("url").alias("url_b"))
    both = a.join(other, (a["h"] == other["hb"]) & (a["digest"] == other["digest_b"]), "left")
    stays = both.where("hb is not null").select("file", "leaf", "offset", "length", "digest_b", "copies_b", "length_b", "page_b", "url_b")
    lost = rank(both.where("hb is null").select("file", "leaf", "offset", "length", "h", "digest"), "digest").drop("digest")
    gained = rank(b.join(a.select("h", "digest"), ["h", "digest"], "left_anti"), "digest")
    gained = gained.select(F.col("h"), "rank", F.col("digest").alias("digest_b"), F.col("copies").alias("copies_b"), F.col("length").alias("length_b"), F.col("page_id").alias("page_b"), F.col("url").alias("url_b"))
    changed = lost.join(gained, ["h", "rank"]).select(*stays.columns)
    extra = gained.join(lost.select("h", "rank"), ["h", "rank"], "left_anti").withColumn("length", F.col("length_b"))
    ends = a.groupBy("file").agg((F.max("leaf") + 1).alias("leaves"), F.max(F.col("offset") + F.col("length")).alias("end"))
    extra = _in_file(extra.crossJoin(F.broadcast(total)), file_bytes).join(ends, "file", "left")
    at = W.Window.partitionBy("file").orderBy("h", "digest_b")
    before = F.sum("length").over(at.rowsBetween(W.Window.unboundedPreceding, 0)) - F.col("length")
    extra = extra.withColumn("leaf", (F.coalesce("leaves", F.lit(0)) + F.row_number().over(at) - 1).cast("long")).withColumn("offset", F.coalesce("end", F.lit(0)) + before)
    placed = checkpoint(stays.union(changed).union(extra.select(*stays.columns)))

    one = tree(a.withColumn("digest", _mark("digest", "copies")))
    two = tree(placed.withColumn("digest", _mark("digest_b", "copies_b")))
    bad = damaged(one, two).select("file", F.col("node").alias("leaf"), F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "added").otherwise("damaged").alias("status"))
    roots = one[-1].select("file", F.col("hash").alias("root"))
    theirs = placed.select("file", "leaf", "digest_b", "copies_b", "length_b", "page_b", "url_b").join(bad, ["file", "leaf"])
    known = a.join(bad.where("status <> 'added'"), ["file", "leaf"], "left").join(theirs.select("file", "leaf", "digest_b", "copies_b"), ["file", "leaf"], "left").join(roots, "file", "left")
    known = known.select("file", "page_id", "url", "offset", "length", "digest", "copies", "root", F.coalesce("status", F.lit("same")).alias("status"), "digest_b", "copies_b")
    added = theirs.where("status = 'added'").select(
        "file", F.col("page_b").alias("page_id"), F.col("url_b").alias("url"), F.lit(None).cast("long").alias("offset"), F.col("length_b").alias("length"), F.lit(None).cast("string").alias("digest"),
        F.lit(None).cast("long").alias("copies"), F.lit(None).cast("string").alias("root"), "status", "digest_b", "copies_b",
    )
    return known.unionByName(added)


def decayed(pages: DataFrame) -> DataFrame:
    """A replica with planted damage, by what page_id leaves on division by 97: 3, the last character of the page is changed; 11, the row is lost;
    19, a character is added at the end; 27, a row of a new address is added; 35, the row is there twice. Other rows and null ids stay."""
    left = F.coalesce(F.pmod("page_id", F.lit(97)), F.lit(-1))
    spoilt = F.when(F.length("html") > 0, F.concat(F.expr("left(html, length(html) - 1)"), F.when(F.expr("right(html, 1)") == "~", "!").otherwise("~"))).otherwise(F.col("html"))
    rows = pages.where(left != 11).withColumn("html", F.when(left == 3, spoilt).when(left == 19, F.concat(F.coalesce("html", F.lit("")), F.lit("+"))).otherwise(F.col("html")))
    return rows.union(pages.where(left == 27).withColumn("url", F.concat(F.coalesce("url", F.lit("")), F.lit("#new")))).union(pages.where(left == 35))


def op8_warc_audit(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return report(pages, decayed(pages))


def parse(data: bytes) -> list[tuple[dict[str, str], int, int, bytes]]:
    """(headers, offset, length, body) of the records of a plain or gzipped WARC file; offsets count unpacked bytes."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    out, at = [], 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        if head < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in data[at:head].decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
        size = int(headers["Content-Length"])
        end = head + 4 + size + 4
        out.append((headers, at, end - at, data[head + 4 : head + 4 + size]))
        at = end
    return out


def read_warc(spark, path: str) -> DataFrame:
    """Records of WARC files: path, offset, length, record_id, url, body. One file is read by one task."""
    schema = "path string, offset long, length long, record_id string, url string, body binary"

    def run(batches):
        for batch in batches:
            rows = [(p, o, n, h.get("WARC-Record-ID"), h.get("WARC-Target-URI"), b) for p, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()) for h, o, n, b in parse(data)]
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["path", "offset", "length", "record_id", "url", "body"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, coalesce(page_id::VARCHAR, '') AS name, coalesce(page_id % 97, -1) AS m FROM pages),
two AS (SELECT page_id, name, url, CASE WHEN m = 3 AND html <> '' THEN substr(html, 1, length(html) - 1) || CASE WHEN right(html, 1) = '~' THEN '!' ELSE '~' END WHEN m = 19 THEN html || '+' ELSE html END AS html FROM p WHERE m <> 11
        UNION ALL SELECT page_id, name, url || '#new', html FROM p WHERE m = 27 UNION ALL SELECT page_id, name, url, html FROM p WHERE m = 35),
pages_of AS (SELECT 'a' AS side, page_id, name, url, html FROM p UNION ALL SELECT 'b', page_id, name, url, html FROM two),
r AS (SELECT side, page_id, url, md5(name || ' ' || url) AS h, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || name || '>' || chr(13) || chr(10)
             || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages_of),
c AS (SELECT side, page_id, url, h, strlen(record)::BIGINT AS length, sha256(record) AS digest, count(*)::BIGINT AS copies FROM r GROUP BY ALL),
a AS (SELECT * FROM c WHERE side = 'a'), b AS (SELECT * FROM c WHERE side = 'b'),
n AS (SELECT greatest(ceil(max(t) / 67108864.0)::BIGINT, 1) AS files FROM (SELECT sum(length) AS t FROM c GROUP BY side)),
f AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % files AS file FROM a, n),
l AS (SELECT *, row_number() OVER w - 1 AS leaf, (sum(length) OVER (w ROWS UNBOUNDED PRECEDING) - length)::BIGINT AS "offset", CASE WHEN copies > 1 THEN sha256(digest || '*' || copies) ELSE digest END AS mark
      FROM f WINDOW w AS (PARTITION BY file ORDER BY page_id NULLS FIRST, digest)),
t1 AS (SELECT file, leaf // 16 AS n, sha256(string_agg(mark, '' ORDER BY leaf)) AS h FROM l GROUP BY ALL),
t2 AS (SELECT file, n // 16 AS n, sha256(string_agg(h, '' ORDER BY n)) AS h FROM t1 GROUP BY file, n // 16),
t3 AS (SELECT file, n // 16 AS n, sha256(string_agg(h, '' ORDER BY n)) AS h FROM t2 GROUP BY file, n // 16),
t4 AS (SELECT file, n // 16 AS n, sha256(string_agg(h, '' ORDER BY n)) AS h FROM t3 GROUP BY file, n // 16),
top AS (SELECT max(leaf) AS mx FROM l),
root AS (SELECT file, h FROM t4, top WHERE mx >= 4096 AND mx < 65536 UNION ALL SELECT file, h FROM t3, top WHERE mx >= 256 AND mx < 4096 UNION ALL SELECT file, h FROM t2, top WHERE mx >= 16 AND mx < 256 UNION ALL SELECT file, h FROM t1, top WHERE mx >= 1 AND mx < 16
         UNION ALL SELECT file, mark FROM l, top WHERE mx = 0),
lost AS (SELECT h, digest, row_number() OVER (PARTITION BY h ORDER BY digest) AS k FROM a ANTI JOIN b USING (h, digest)),
gained AS (SELECT h, digest, copies, length, page_id, url, row_number() OVER (PARTITION BY h ORDER BY digest) AS k FROM b ANTI JOIN a USING (h, digest))
SELECT l.file, l.page_id, l.url, l."offset", l.length, l.digest, l.copies, root.h AS root,
       CASE WHEN b.copies = l.copies THEN 'same' WHEN b.copies IS NOT NULL OR g.digest IS NOT NULL THEN 'damaged' ELSE 'missing' END AS status,
       CASE WHEN b.copies <> l.copies THEN l.digest ELSE g.digest END AS digest_b, CASE WHEN b.copies <> l.copies THEN b.copies ELSE g.copies END AS copies_b
FROM l JOIN root USING (file) LEFT JOIN b ON b.h = l.h AND b.digest = l.digest LEFT JOIN lost ON lost.h = l.h AND lost.digest = l.digest LEFT JOIN gained g ON g.h = lost.h AND g.k = lost.k
UNION ALL
SELECT ('0x' || substr(g.h, 1, 8))::BIGINT % n.files, g.page_id, g.url, NULL, g.length, NULL, NULL, NULL, 'added', g.digest, g.copies FROM gained g CROSS JOIN n LEFT JOIN lost ON lost.h = g.h AND lost.k = g.k WHERE lost.h IS NULL
"""
