"""WARC archives written and read by Spark's text source, with boundary-chain verification.

Writing: a record is one text row whose row separator is the record's closing blank lines, so archives are plain
WARC files, gzipped as a whole, on any file system Spark can write to.

Reading: the text source splits files at every occurrence of the version line. Each piece is a *candidate*: tasks
emit its offset and, from its Content-Length, the offset of its successor. Pointer jumping from the file's start
keeps the candidates that the chain reaches; the version line inside a payload starts a candidate that no record
points to. Only these light rows meet per file, and a file holds a bounded number of records.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from atlasmill.session import materialize, scratch_path

VERSION = "WARC/1.0\r\n"
BLANK = "\r\n\r\n"
REVISIT_FROM = 1000
#: Records of one archive file: bounds the rows that meet when its chain is verified.
FILE_RECORDS = 8192
#: Rows of the table of repeated payloads up to which it is broadcast; beyond, it is a shuffled join.
BROADCAST_ROWS = 20_000
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def with_originals(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """Add payload, n, digest and original: the largest page_id with the same payload of at least `least` bytes, where that is another page."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).alias("n"), F.sha1(payload.cast("binary")).alias("digest"))
    same = pages.where(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("c")).where("c > 1").drop("c")
    same = materialize(same, "originals")
    if same.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        same = F.broadcast(same)
    out = pages.join(same, "digest", "left")
    keep = (F.col("n") >= least) & (F.col("page_id") < F.col("original"))
    return out.withColumn("original", F.when(keep, F.col("original")))


def write_archive(pages: DataFrame, path: str, least: int = REVISIT_FROM, date: str = "2024-01-01T00:00:00Z") -> int:
    """Write one record per page: response, or revisit without body where another page holds the same payload; give their number.

    A page without id is never referred to. Line ends inside urls are dropped from the header. Repeated rows give
    repeated records; an empty table gives no record. What a reader needs stands before the url.
    """
    revisit = F.col("original").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(BLANK))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))

    def urn(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))

    header = F.concat(
        F.lit(VERSION + "WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), urn("page_id"),
        F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), urn("original"))).otherwise(F.lit("")),
        F.lit(f"\r\nContent-Type: application/http; msgtype=response\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]+", ""), F.lit(BLANK),
    )
    written = Observation("warc-records")
    records = with_originals(pages, least).select(F.concat(header, block).alias("value")).observe(written, F.count("*").alias("n"))
    writer = records.write.option("lineSep", BLANK).option("maxRecordsPerFile", FILE_RECORDS)
    writer.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)
    return written.get["n"]


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """The pieces between version lines; seq is their order within (file, block)."""
    rows = spark.read.option("lineSep", VERSION).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")


def _field(head: Column, name: str, pattern: str) -> Column:
    """A header field's value; lines end with a line feed only, not with the other characters that Unicode breaks lines at."""
    return F.nullif(F.regexp_extract(head, f"(?imd)^{name}: *{pattern}", 1), F.lit(""))


def _parsed(segments: DataFrame) -> DataFrame:
    """Header fields of a piece, the size and digest of its payload as far as the piece reaches, and the piece itself."""
    head = F.substring_index("value", BLANK, 1)
    out = segments.withColumn("size", F.octet_length("value")).withColumn("head", F.when(F.instr("value", BLANK) > 0, head))
    out = out.withColumn("head_size", F.octet_length(head) + 4).withColumn("length", _field(F.col("head"), "Content-Length", "(\\d{1,18})[ \\t\\r]*$").cast("long"))
    block = F.expr("substring(cast(value as binary), int(head_size + 1), int(least(length, 2147483647L)))")
    out = out.withColumn("block_bytes", block)
    http = F.expr("octet_length(substring_index(cast(block_bytes as string), '\\r\\n\\r\\n', 1)) + 4")
    payload = F.expr(f"substring(block_bytes, int({'http_size'} + 1), 2147483647)")
    out = out.withColumn("http_size", http).withColumn("payload", payload)
    return out.select(
        "file", "block", "seq", "size", "head_size", "length",
        _field(F.col("head"), "WARC-Type", "(\\w+)").alias("record_type"),
        _field(F.col("head"), "WARC-Record-ID", "<urn:page:(-?\\d+)>").cast("long").alias("page_id"),
        _field(F.col("head"), "WARC-Refers-To", "<urn:page:(-?\\d+)>").cast("long").alias("refers_to"),
        _field(F.col("head"), "WARC-Payload-Digest", "sha1:(\\w+)").alias("declared_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "value",
    )


def chain(offsets: np.ndarray, successors: np.ndarray, end: int) -> np.ndarray:
    """Mask of the candidates reachable from the first one by following successors, by pointer jumping.

    offsets are sorted; a successor that is no candidate's offset leads nowhere, `end` is the proper end.
    Each round doubles the jumps: a marked candidate marks the one 2^k records on.
    """
    n = len(offsets)
    at = np.searchsorted(offsets, successors)
    hit = (at < n) & (offsets[np.minimum(at, n - 1)] == successors) & (successors > offsets)
    jump = np.append(np.where(hit, at, n), n)
    reached = np.zeros(n + 1, dtype=bool)
    reached[0] = True
    for _ in range(max(1, int(n).bit_length())):
        reached[jump[np.flatnonzero(reached)]] = True
        jump = jump[jump]
    whole = hit | (successors == end)
    return reached[:n] & whole


def _verify(table: pa.Table) -> pa.Table:
    """Records of one file: seq of their first piece and number of pieces."""
    table = table.sort_by([("block", "ascending"), ("seq", "ascending")])
    size, seq = table["size"].to_numpy(), table["seq"].to_numpy()
    starts = np.concatenate(([0], size[0] + np.concatenate(([0], np.cumsum(size[1:] + len(VERSION))))))
    offsets, end = starts[1:-1], int(starts[-1])
    declared = table["head_size"].to_numpy()[1:] + table["length"].fill_null(-(1 << 40)).to_numpy()[1:] + len(BLANK)
    good = np.zeros(0, dtype=np.int64)
    if len(offsets) and size[0] == 0:
        successors = offsets + len(VERSION) + declared
        good = np.flatnonzero(chain(offsets, successors, end))
        pieces = np.searchsorted(np.append(offsets, end), successors[good]) - good
    else:
        pieces = good
    return pa.table({"first": seq[good + 1] if len(good) else good, "pieces": pieces.astype(np.int64), "order": np.arange(len(good), dtype=np.int64)})


def read_archive(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """Records of all archives below path: page_id, record_type, refers_to, declared_digest, payload_bytes, payload_digest (bare SHA-1).

    Payload figures are of the bytes after the HTTP head. Candidates that the chain does not reach are no records;
    after a broken successor the rest of a file is unreachable. A file that does not start with a record gives none.
    The files are read once: the candidates are written with their bytes, and a record whose payload holds the version
    line is put together from its pieces there, so pieces keep their numbers whatever becomes of the executors. Another number
    of records than `expected` is an error.
    """
    parsed = materialize(_parsed(_segments(spark, path)), "candidates")
    light = parsed.select("file", "block", "seq", "size", "head_size", "length")
    kept = materialize(light.groupBy("file").applyInArrow(_verify, "first long, pieces long, order long"), "records")
    if expected is not None and (found := kept.count()) != expected:
        raise RuntimeError(f"{expected} records were written to {path}, {found} can be read")
    fields = ["page_id", "record_type", "refers_to", "declared_digest", "payload_bytes", "payload_digest"]
    out = parsed.join(kept.where("pieces = 1").select(F.col("first").alias("seq")), "seq").select(fields)
    broken = kept.where("pieces > 1")
    if not broken.isEmpty():
        parts = broken.select("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("part"))
        numbered = parsed.select("file", "block", "seq").withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("block", "seq")))
        first = numbered.select("file", F.col("n").alias("n0"), F.col("seq").alias("first"))
        wanted = parts.join(first, "first").select("first", "part", "file", (F.col("n0") + F.col("part")).alias("n")).join(numbered, ["file", "n"]).select("seq", "first", "part")
        joined = parsed.select("file", "seq", "value").join(wanted, "seq").groupBy("file", "first").agg(F.sort_array(F.collect_list(F.struct("part", "value"))).alias("p"))
        whole = joined.select("file", F.lit(0).cast("long").alias("block"), F.col("first").alias("seq"), F.concat_ws(VERSION, F.col("p.value")).alias("value"))
        out = out.union(_parsed(whole).select(fields))
    return out


def archive_digests(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """Write pages to archives, read them back and give each page's payload size, digest and record type.

    A revisit's payload figures are those of the record it refers to: the one with that id and the payload digest that
    the revisit declares. Null html is an empty payload; null ids stay null and are responses; repeated rows give
    repeated rows; rows of one id with different html keep their own figures; extra columns are ignored.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    records = read_archive(spark, path, write_archive(pages, path, least))
    full = records.where("record_type = 'response'")
    known = full.where("page_id is not null").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("declared_digest")).agg(F.max("payload_bytes").alias("payload_bytes"))
    again = records.where("record_type = 'revisit'").select("page_id", "refers_to", "record_type", "declared_digest").join(known, ["refers_to", "declared_digest"], "left")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return full.select(out).union(again.select("page_id", "payload_bytes", F.col("declared_digest").alias("payload_digest"), "record_type", "refers_to"))
