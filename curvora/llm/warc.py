"""WARC archives with revisit records.

Headers are shuffled by payload digest, payloads are not: of the records with one digest the one with the largest
page_id stays a response, the others become revisit records that refer to it.  A hot digest is pre-aggregated to its
winner before it is joined.  Archives are written by Spark's text writer (one record a line, the record end
CR LF CR LF as line separator, gzip) into the shared folder, in files of bounded size, and are read back from there.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialise, new_path, number_rows, read_table, release

#: Payload bytes that one archive file is to hold; payloads of fewer bytes than the minimum are never revisits.
ARCHIVE_BYTES, MIN_BYTES = 8 << 20, 0
# Fixed values of the archive format.
EOL, RECORD_END = "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2020-01-01T00:00:00Z"


def base32_sha1(binary: F.Column) -> F.Column:
    """Upper-case base32 of the SHA-1: every five hex digits are four base32 digits."""
    digest = F.sha1(binary)
    out = []
    for k in range(8):
        bits = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def decide(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Headers only, of pages with a number (row, in order of page_id): row, page_id, payload_bytes, payload_digest,
    record_type, refers_to (a page_id) and refers_row."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    heads = pages.select("row", F.col("page_id").cast("long").alias("page_id"), F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("payload_digest"))
    heads = materialise(heads, "warc-heads")
    first = heads.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max(F.struct("row", "page_id")).alias("kept"), F.count("*").alias("n"))
    first = first.where("n > 1").select(F.col("payload_digest").alias("digest"), "kept")
    both = heads.join(first, (heads["payload_digest"] == first["digest"]) & (heads["payload_bytes"] >= min_bytes), "left")
    revisit = F.col("kept").isNotNull() & (F.col("row") != F.col("kept.row"))
    kind = F.when(revisit, "revisit").otherwise("response").alias("record_type")
    return both.select("row", "page_id", "payload_bytes", "payload_digest", kind, F.when(revisit, F.col("kept.page_id")).alias("refers_to"), F.when(revisit, F.col("kept.row")).alias("refers_row"))


def _uuid(*parts: F.Column) -> F.Column:
    h = F.md5(F.concat_ws(":", *parts))
    return F.concat(F.lit("urn:uuid:"), *[x for a, n, sep in ((1, 8, "-"), (9, 4, "-"), (13, 4, "-"), (17, 4, "-"), (21, 12, "")) for x in (F.substring(h, a, n), F.lit(sep))])


def records(pages: DataFrame, decisions: DataFrame, files: int) -> DataFrame:
    """One record text a page, without the record end; fresh headers, no payload in revisits.

    Payloads are shuffled once: they are dealt by row to as many partitions as there will be files, and joined there.
    Characters that would end a header line are percent-encoded in the target.
    """
    d = decisions.select(F.col("row").alias("d_row"), "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_row")
    rows = pages.select("row", F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.repartition(files, "row").join(d.hint("merge"), rows["row"] == d["d_row"])
    revisit = F.col("record_type") == "revisit"
    uri = F.replace(F.replace(F.coalesce(F.col("url"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat_ws(
        EOL,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <"), _uuid(F.lit("record"), F.col("row").cast("string")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.lit(DATE)),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("WARC-Identified-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.concat(F.lit("WARC-Page-ID: "), F.col("page_id").cast("string")),  # null, and so no line, without a page_id
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{EOL}WARC-Refers-To: <"), _uuid(F.lit("record"), F.col("refers_row").cast("string")), F.lit(">"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Page-ID: "), F.col("refers_to").cast("string"))),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    )
    return rows.select(F.concat(header, F.lit(RECORD_END), F.when(revisit, F.lit("")).otherwise(F.col("html"))).alias("value"))


def write_archives(pages: DataFrame, decisions: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Archives of about ``archive_bytes`` of payload each; pages are dealt by id, so that sizes are even."""
    total = decisions.agg(F.coalesce(F.sum(F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)) + 600 * F.count("*"), F.lit(0))).first()[0]
    files = max(1, -(-int(total) // archive_bytes))
    records(pages, decisions, files).write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)
    return path


def _inflate(chunk: bytes) -> bytes:
    out = []
    while chunk:  # a gzip file may have several members
        d = zlib.decompressobj(31)
        out.append(d.decompress(chunk) + d.flush())
        chunk = d.unused_data
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, by Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(EOL)
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record without its end at byte {at}")
        at += 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a record, from the files: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    For a response the digest and length are computed from its block, and must equal its header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                for head, block in parse(_inflate(content.as_py())):
                    kind, digest, size = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["WARC-Identified-Payload-Length"])
                    if kind == "response" and (base64.b32encode(hashlib.sha1(block).digest()).decode(), len(block)) != (digest, size):
                        raise ValueError(f"payload of record {head['WARC-Record-ID']} doesn't fit its header")
                    page, to = (int(x) if x else None for x in map(head.get, ("WARC-Page-ID", "WARC-Refers-To-Page-ID")))
                    rows.append((page, head["WARC-Target-URI"], kind, size, digest, to, block))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def resolve_revisits(pages: DataFrame, path: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write deduplicated archives of ``pages`` (page_id, url, html) and return their records, read back.

    Defined cases: a null html is an empty payload; a null url is an empty target; every row has a record, repeated rows
    and null page_ids too (those records have no page id, and lose to all others); among equal payloads one record is
    the response, of the largest page_id and, of rows equal in it, the last in an order by row; payloads of any length
    are kept whole; an empty table gives no rows; other columns are ignored.
    """
    (row,) = fresh(pages.columns, "__row")
    numbered = number_rows(pages, row, key="page_id", text="html")
    pages = numbered.select(F.col(row).alias("row"), "page_id", "url", "html")
    decisions = materialise(decide(pages, min_bytes), "warc-decisions")
    path = path or new_path(pages.sparkSession, "warc")
    write_archives(pages, decisions, path)
    release(numbered, decisions)
    return read_archives(pages.sparkSession, path)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_revisits(read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The decisions by their definition; page_ids are a key in the supplied tables.
ORACLE_SQL = f"""
with heads as (select page_id, octet_length(encode(coalesce(html, ''))) payload_bytes, sha1(coalesce(html, '')) hex, max(page_id) over (partition by coalesce(html, '')) kept from pages)
select page_id, payload_bytes::bigint payload_bytes,
  array_to_string([substr('{BASE32}', (((('0x' || substr(hex, (j // 4)::int * 5 + 1, 5))::int >> (15 - 5 * (j % 4)::int)) & 31) + 1)::int, 1) for j in range(32)], '') payload_digest,
  case when page_id = kept then 'response' else 'revisit' end record_type, case when page_id <> kept then kept end refers_to
from heads"""
