"""WARC records and their Merkle fixity audit.

Records stand in files, ordered by their key, each at its offset. Every copy of an archive gets its own trees from its own
manifest, one a file: a leaf sums up the digests of the records of one key, a node above hashes the digests of up to FANOUT
neighbouring nodes; each node covers a range of keys and of its copy's offsets. A node's place is its range of keys, so a
lost record changes the branch it stood in and no other. Two copies are compared from the roots down: only branches
that differ are opened, and records of both copies meet under differing leaves alone. All other records are known to be
sound from the primary's manifest. So what is joined follows the damage and not the archive.

Under a differing leaf records are matched by their place among equal keys; one that only the replica has is reported
as extra. Null html and null url are empty. Rows without a page id stand in file -1, under leaves by their digests; rows of
equal ids stand in the order of url and digest. An empty table gives an empty audit. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.llm.common import cut_lineage, rows_of, table

FANOUT = 16
#: Page ids that share a file: the leaves of a tree, whose depth follows.
IDS_PER_FILE = 1024
LEVELS = next(k for k in range(64) if FANOUT**k >= IDS_PER_FILE)
LINE = "\r\n"


def record_of(page_id: Column, url: Column, body: Column) -> Column:
    """A WARC/1.1 resource record as bytes."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.1{LINE}WARC-Type: resource{LINE}WARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(f">{LINE}WARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit(f"{LINE}Content-Type: text/html{LINE}Content-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(LINE + LINE),
    )
    return F.concat(head, body, F.lit(LINE + LINE)).cast("binary")


def records(pages: DataFrame) -> DataFrame:
    """page_id, url, file, record."""
    file = F.coalesce(F.floor(F.col("page_id") / IDS_PER_FILE).cast("long"), F.lit(-1).cast("long"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", file.alias("file"), record_of(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))


def manifest(recs: DataFrame) -> DataFrame:
    """file, leaf, page_id, url, copy (number among equal ids of a file), seq, offset, length, digest. The records' bytes go no further."""
    short = recs.select("file", "page_id", "url", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    order = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_last(), F.col("url").asc_nulls_first(), F.col("digest"))
    ahead = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = short.select("*", (F.row_number().over(order) - 1).cast("long").alias("seq"), F.coalesce(ahead, F.lit(0)).alias("offset"))
    copy = F.row_number().over(Window.partitionBy("file", "page_id").orderBy("seq")) - 1
    leaf = F.pmod(F.coalesce("page_id", F.xxhash64("digest")), F.lit(IDS_PER_FILE))
    return placed.select("*", copy.cast("long").alias("copy"), leaf.alias("leaf"))


def leaves(records: DataFrame) -> DataFrame:
    """file, node, digest, begin, end of a manifest's leaves.

    A leaf's digest is that of the number of its records and of the sums of four pieces of their digests, so a key of many records
    is added up before any shuffle.
    """
    pieces = [F.sum(F.conv(F.substring("digest", 1 + 16 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    digest = F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *pieces), 256)
    return records.groupBy("file", F.col("leaf").alias("node")).agg(digest.alias("digest"), F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("length")).alias("end"))


def parents(nodes: DataFrame) -> DataFrame:
    """The next level of the trees: file, node, digest, begin, end."""
    inside = F.array_sort(F.collect_list(F.struct("node", "digest")))  # FANOUT nodes at most
    above = nodes.groupBy("file", F.expr(f"node div {FANOUT}").alias("up")).agg(inside.alias("n"), F.min("begin").alias("begin"), F.max("end").alias("end"))
    digest = F.sha2(F.concat_ws("", F.transform("n", lambda x: F.concat_ws(":", x["node"].cast("string"), x["digest"]))), 256)
    return above.select("file", F.col("up").alias("node"), digest.alias("digest"), "begin", "end")


def trees(records: DataFrame) -> list[DataFrame]:
    """The nodes of every level of a manifest's trees, leaves first, roots (one a file) last."""
    out = [cut_lineage(leaves(records))]
    for _ in range(LEVELS):
        out.append(cut_lineage(parents(out[-1])))
    return out


def opened(nodes: DataFrame, suspects: DataFrame) -> DataFrame:
    """The children of suspect nodes."""
    return nodes.withColumn("up", F.expr(f"node div {FANOUT}")).join(suspects.withColumnRenamed("node", "up"), ["file", "up"], "left_semi").drop("up")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """file, node of the nodes that only one side has or that have another digest there."""
    both = a.select("file", "node", F.col("digest").alias("x")).join(b.select("file", "node", F.col("digest").alias("y")), ["file", "node"], "full_outer")
    return both.where(~F.col("x").eqNullSafe(F.col("y"))).select("file", "node")


def suspects(first: list[DataFrame], second: list[DataFrame]) -> DataFrame:
    """file, leaf of the leaves in which two copies' trees differ."""
    found = cut_lineage(differing(first[-1], second[-1]))
    for a, b in zip(first[-2::-1], second[-2::-1]):
        found = cut_lineage(differing(opened(a, found), opened(b, found)))
    return found.withColumnRenamed("node", "leaf")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """One row per record of either copy: its place, both digests and status (ok, differs, missing, extra).

    ``primary`` and ``replica`` as from ``records``.
    """
    a, b = cut_lineage(manifest(primary)), cut_lineage(manifest(replica))
    bad = suspects(trees(a), trees(b))
    under = ["file", "leaf"]
    key = F.col("a.file").eqNullSafe(F.col("b.file")) & F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("a.copy") == F.col("b.copy"))
    met = a.join(bad, under, "left_semi").alias("a").join(b.join(bad, under, "left_semi").alias("b"), key, "full_outer")
    place = [F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("page_id", "url", "file")]
    status = F.when(F.col("a.seq").isNull(), "extra").when(F.col("b.seq").isNull(), "missing").when(F.col("a.digest") != F.col("b.digest"), "differs").otherwise("ok")
    judged = met.select(*place, "a.seq", "a.offset", F.coalesce("a.length", "b.length").alias("length"), F.col("a.digest").alias("primary_digest"), F.col("b.digest").alias("replica_digest"), status.alias("status"))
    sound = a.join(bad, under, "left_anti").select("page_id", "url", "file", "seq", "offset", "length", F.col("digest").alias("primary_digest"), F.col("digest").alias("replica_digest"), F.lit("ok").alias("status"))
    return sound.unionByName(cut_lineage(judged))


_LENGTH = re.compile(rb"^Content-Length:\s*(\d+)\s*$", re.IGNORECASE | re.MULTILINE)
_URI = re.compile(rb"^WARC-Target-URI:\s*(.*?)\s*$", re.IGNORECASE | re.MULTILINE)


#: Bytes of a gzip member that are unpacked at a time.
_FEED = 1 << 16


def _member(content: memoryview, at: int) -> tuple[bytes, int]:
    """The unpacked gzip member that begins there, and the bytes it takes; zlib.error or EOFError if it is broken."""
    unpack, out, fed = zlib.decompressobj(31), [], at
    while not unpack.eof:
        if fed >= len(content):
            raise EOFError
        out.append(unpack.decompress(content[fed : fed + _FEED]))
        fed = min(fed + _FEED, len(content))
    return b"".join(out), fed - len(unpack.unused_data) - at


def parse_warc(content: bytes) -> Iterator[tuple[int, int, str | None, bytes | None, str | None]]:
    """(offset, length, target URI, body, error) of each record; gzip members are unpacked one at a time, offsets are those in the file.

    A stretch that cannot be read is one row with an error and without a body; reading goes on at the next record's or member's first bytes.
    """
    view, at = memoryview(content), 0
    while at < len(content):
        packed, data, size = content.startswith(b"\x1f\x8b", at), b"", 0
        try:
            if packed:
                data, size = _member(view, at)
                begin = 0
            else:
                data, begin = content, at
            head = data.find(b"\r\n\r\n", begin)
            if not data.startswith(b"WARC/", begin) or head < 0:
                raise ValueError("no record where one is due")
            header = bytes(data[begin : head + 2])
            found = _LENGTH.search(header)
            end = head + 4 + (int(found[1]) if found else 0)
            if end > len(data):
                raise ValueError("a record is cut off")
            uri = _URI.search(header)
            size = size or min(end + 4, len(data)) - begin
            yield at, size, uri and uri[1].decode("utf-8", "replace"), bytes(data[head + 4 : end]), None
        except (ValueError, EOFError, zlib.error) as error:
            marks = [p for p in (content.find(b"WARC/1.", at + 1), content.find(b"\x1f\x8b\x08", at + 1)) if p > 0]
            size = min(marks, default=len(content)) - at
            yield at, size, None, None, str(error) or "a member is cut off"
        at += size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """path, offset, length, url, body, error of the records of all files under ``path``."""
    kinds = {"path": "string", "offset": "long", "length": "long", "url": "string", "body": "binary", "error": "string"}
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(k, types[v]) for k, v in kinds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                for offset, length, url, body, error in parse_warc(content.as_py() or b""):
                    yield rows_of(schema, path=[path], offset=[offset], length=[length], url=[url], body=[body], error=[error])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()))


#: The replica that the query audits: made from the same pages, with damage at known places.
DAMAGED, LOST = "page_id % 97 = 13", "page_id % 251 = 7"


def op7_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    broken = F.when(F.expr(DAMAGED), F.concat(F.lit("!"), F.substring("html", 2, 2147483647))).otherwise(F.col("html"))
    replica = pages.where(~F.coalesce(F.expr(LOST), F.lit(False))).withColumn("html", broken)
    return audit(records(pages), records(replica))


_BYTES = "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || CAST(page_id AS VARCHAR) || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen({h}) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || {h} || chr(13) || chr(10) || chr(13) || chr(10)"
OP7_SQL = f"""
WITH r AS (
  SELECT page_id, url, page_id // {IDS_PER_FILE} AS file, {_BYTES.format(h="html")} AS a,
    CASE WHEN {DAMAGED} THEN {_BYTES.format(h="('!' || substr(html, 2))")} ELSE {_BYTES.format(h="html")} END AS b
  FROM pages
), m AS (
  SELECT page_id, url, file, CAST(strlen(a) AS BIGINT) AS length, sha256(a) AS primary_digest,
    CASE WHEN {LOST} THEN NULL ELSE sha256(b) END AS replica_digest FROM r
)
SELECT page_id, url, file,
  row_number() OVER (PARTITION BY file ORDER BY page_id, url, primary_digest) - 1 AS seq,
  CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id, url, primary_digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  length, primary_digest, replica_digest,
  CASE WHEN replica_digest IS NULL THEN 'missing' WHEN replica_digest <> primary_digest THEN 'differs' ELSE 'ok' END AS status
FROM m
"""
