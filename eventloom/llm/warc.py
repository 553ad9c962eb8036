r"""WARC records and a Merkle fixity audit of their replicas.

A record's leaf is the SHA-256 of its bytes, at an offset of an archive. Level 0 of an archive's tree has a node for each
offset range of SPAN bytes: the hash of its leaves in offset order; level k has a node for each FANOUT nodes of the level
below. The roots of two replicas are compared, and only the children of nodes that differ are compared further, down to
the records: a row each for `changed`, `missing` (in the second) and `extra`.

A node covers at most SPAN bytes of records or FANOUT nodes, so no group grows with the input. Leaves are hashed once and
written to the shared folder; trees are built from them.

Cases: null payloads are empty records; null urls are empty; archives without a difference give no row; an archive that
one replica lacks differs as a whole; records of one offset are compared in order of their hash and a repeated record
counts as often as it is there; empty inputs give an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut

SPAN, FANOUT = 1 << 16, 16
#: Ids of one archive file.
PER_ARCHIVE = 1024


def record(url: Column, payload: Column, date: str = "1970-01-01T00:00:00Z") -> Column:
    """A WARC/1.0 resource record as bytes."""
    body, url = F.coalesce(payload, F.lit("")).cast("binary"), F.coalesce(url, F.lit(""))
    name = F.md5(url.cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def archive_pages(pages: DataFrame, bodies: bool = True) -> DataFrame:
    """archive, offset, length, digest, page_id, record of pages (page_id, url, html): PER_ARCHIVE ids a file, in order of id,
    url and digest. Without bodies no record moves: lengths and digests alone are sorted by archive."""
    rows = pages.select("page_id", record(F.col("url"), F.col("html")).alias("record"), F.coalesce("url", F.lit("")).alias("url"))
    rows = rows.withColumn("length", F.octet_length("record").cast("long")).withColumn("digest", F.sha2("record", 256)).withColumn("archive", F.coalesce(F.floor(F.col("page_id") / PER_ARCHIVE), F.lit(-1) - F.pmod(F.xxhash64("url"), F.lit(4096))))
    order = Window.partitionBy("archive").orderBy("page_id", "url", "digest")
    rows = rows if bodies else rows.drop("record")
    return rows.select("archive", F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), "length", "digest", "page_id", *(["record"] if bodies else []))


def leaves(records: DataFrame) -> DataFrame:
    """archive, offset, length, digest of records (archive, offset, and record or its length and digest), with n for repeated ones."""
    if "record" in records.columns:
        records = records.withColumns({"length": F.octet_length("record").cast("long"), "digest": F.sha2("record", 256)})
    one = records.select("archive", "offset", "length", "digest")
    return cut(one.groupBy("archive", "offset", "length", "digest").agg(F.count("*").alias("n")))


def _fold(rows: DataFrame, item: Column, order: list[str]) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct(*order, item.alias("_item"))))
    return rows.groupBy("archive", "node").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["_item"]), "\n"), 256).alias("digest"))


def tree(found: DataFrame, depth: int, span: int = SPAN, fanout: int = FANOUT) -> list[DataFrame]:
    """archive, node, digest of each level, ranges of offsets first, the level of roots last."""
    low = found.withColumn("node", F.floor(F.col("offset") / span))
    levels = [cut(_fold(low, F.concat_ws(":", "offset", "length", "digest", "n"), ["offset", "length", "digest"]))]
    for _ in range(depth):
        below = levels[-1].withColumns({"at": F.col("node"), "node": F.floor(F.col("node") / fanout)})
        levels.append(cut(_fold(below, F.concat_ws(":", "at", "digest"), ["at"])))
    return levels


def depth_of(found: list[DataFrame], span: int = SPAN, fanout: int = FANOUT) -> int:
    """Levels above the ranges until each archive has one node."""
    top = max(f.agg(F.coalesce(F.max("offset"), F.lit(0))).first()[0] for f in found) // span
    depth = 0
    while top:
        top, depth = top // fanout, depth + 1
    return depth


def audit(first: DataFrame, second: DataFrame, span: int = SPAN, fanout: int = FANOUT) -> DataFrame:
    """archive, offset, length, status, first_digest, second_digest for each difference of two replicas' leaves."""
    depth = depth_of([first, second], span, fanout)
    a, b = tree(first, depth, span, fanout), tree(second, depth, span, fanout)
    differs = None
    for x, y in zip(reversed(a), reversed(b), strict=True):
        if differs is not None:
            # only children of nodes that differ
            parent = F.floor(F.col("node") / fanout)
            x, y = (t.withColumn("parent", parent).join(differs.toDF("archive", "parent"), ["archive", "parent"], "left_semi") for t in (x, y))
        both = x.select("archive", "node", F.col("digest").alias("x")).join(y.select("archive", "node", F.col("digest").alias("y")), ["archive", "node"], "full")
        differs = cut(both.where(~F.col("x").eqNullSafe(F.col("y"))).select("archive", "node"))

    inside = lambda t: t.withColumn("node", F.floor(F.col("offset") / span)).join(differs, ["archive", "node"], "left_semi")
    # records of one offset that are in both go; those left are paired in order
    one = inside(first).select("archive", "offset", "length", "digest", F.col("n").alias("m"))
    two = inside(second).select("archive", "offset", "length", "digest", (-F.col("n")).alias("m"))
    left = reduce(DataFrame.union, (one, two)).groupBy("archive", "offset", "length", "digest").agg(F.sum("m").alias("m")).where("m <> 0")
    place = Window.partitionBy("archive", "offset", F.col("m") > 0).orderBy("digest", "length")
    ranked = left.withColumn("k", F.row_number().over(place))
    x = ranked.where("m > 0").select("archive", "offset", "k", F.col("length").alias("lx"), F.col("digest").alias("first_digest"))
    y = ranked.where("m < 0").select("archive", "offset", "k", F.col("length").alias("ly"), F.col("digest").alias("second_digest"))
    status = F.when(F.col("second_digest").isNull(), "missing").when(F.col("first_digest").isNull(), "extra").otherwise("changed")
    return x.join(y, ["archive", "offset", "k"], "full").select("archive", "offset", F.coalesce("lx", "ly").alias("length"), status.alias("status"), "first_digest", "second_digest")


#: The query's second replica: of every 97th id the first character of the page is another one, of every 101st the record is lost.
CHANGED, LOST = (97, 5), (101, 7)


def damaged(pages: DataFrame) -> DataFrame:
    hit = F.coalesce(F.col("page_id") % CHANGED[0] == CHANGED[1], F.lit(False))
    return pages.select("page_id", "url", F.when(hit & (F.length("html") > 0), F.concat(F.lit("#"), F.substring("html", 2, 2**31 - 1))).otherwise(F.col("html")).alias("html"))


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, CAST(floor(page_id / 1024) AS BIGINT) AS archive FROM pages),
r AS (SELECT page_id, archive, url, html, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:' || md5(url)[1:8] || '-' || md5(url)[9:12] || '-' || md5(url)[13:16] || '-' || md5(url)[17:20] || '-' || md5(url)[21:32] || '>' || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) AS head FROM p),
x AS (SELECT page_id, archive, head || html || chr(13) || chr(10) || chr(13) || chr(10) AS one, head || '#' || html[2:] || chr(13) || chr(10) || chr(13) || chr(10) AS two FROM r),
o AS (SELECT page_id, archive, one, two, coalesce(sum(strlen(one)) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM x)
SELECT archive, CAST(begins AS BIGINT) AS "offset", CAST(strlen(one) AS BIGINT) AS length,
  CASE WHEN page_id % 101 = 7 THEN 'missing' ELSE 'changed' END AS status, sha256(one) AS first_digest,
  CASE WHEN page_id % 101 = 7 THEN NULL ELSE sha256(two) END AS second_digest
FROM o WHERE page_id % 97 = 5 OR page_id % 101 = 7
"""
