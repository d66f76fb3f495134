"""WARC archives: write, deduplicate by revisit records, read back.

Archives are gzip files written by Spark's text sink, one record per row, so
they land on any file system Spark knows. A record ends in CRLF CRLF, which is
the sink's line separator. Reading parses by Content-Length, never by
searching for separators in payloads.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenderlake.llm.common import cut, new_path

CRLF = "\r\n"
MIN_PAYLOAD = 100
#: payloads are held a file at a time when read, so files are kept short: by records, and by bytes of average payloads
RECORDS_PER_FILE, BYTES_PER_FILE = 4000, 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

HEADERS = "page_id long, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to_id string"


def _uuid(*cols: Column) -> Column:
    h = F.md5(F.concat_ws("|", *cols))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"),
                    F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _record_id(page_id: Column, digest: Column) -> Column:
    return _uuid(F.coalesce(page_id.cast("string"), F.lit("")), digest)


def resolve(headers: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """(payload_digest, first_id) of every payload that occurs more than once.

    ``headers``: (page_id, payload_bytes, payload_digest). One row per digest
    after map-side combining, whatever the size of a group. Payloads under
    ``min_payload`` bytes never become revisits.
    """
    return (headers.where(F.col("payload_bytes") >= min_payload).groupBy("payload_digest")
            .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
            .where("n > 1 and first_id is not null").drop("n"))


def write_archive(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD) -> None:
    """Write one WARC/1.1 record per row of ``pages`` (page_id, url, html) with fresh headers.

    Of equal payloads the smallest page_id is written as response, the others
    as revisit without payload. Null html is an empty payload; a null url has
    no target header; a null page_id has no page header and, in a group of
    equal payloads with some other id, is a revisit. Rows that repeat
    page_id and payload of the response are that response again.
    """
    p = pages.select("page_id", F.regexp_replace("url", r"[\r\n\x00]", "").alias("url"),
                     F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumns({"payload_bytes": F.octet_length("html").cast("long"),
                       "payload_digest": F.sha2(F.col("html").cast("binary"), 256)})
    # written first, so that the join is of plain shuffles and AQE splits a digest that very many pages share
    firsts = cut(resolve(p.select("page_id", "payload_bytes", "payload_digest"), min_payload), "firsts")
    mean = p.agg(F.coalesce(F.avg("payload_bytes"), F.lit(0.0))).first()[0]
    p = p.join(firsts, "payload_digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (
        F.col("payload_bytes") >= min_payload)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))

    def line(name: str, value: Column, where: Column | None = None) -> Column:
        out = F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
        return F.coalesce(out if where is None else F.when(where, out), F.lit(""))

    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        line("WARC-Date", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", F.col("url")), line("WARC-Page-ID", F.col("page_id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        line("WARC-Profile", F.lit(PROFILE), F.col("revisit")),
        line("WARC-Refers-To", _record_id(F.col("first_id"), F.col("payload_digest")), F.col("revisit")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        (F.octet_length("http") + F.when(F.col("revisit"), 0).otherwise(F.col("payload_bytes"))).cast("string"),
        F.lit(CRLF * 2), F.col("http"), F.when(F.col("revisit"), "").otherwise(F.col("html")))
    (p.withColumns({"revisit": revisit, "http": http}).select(record.alias("value"))
     .write.option("lineSep", CRLF * 2).option("compression", "gzip")
     .option("maxRecordsPerFile", max(1, min(RECORDS_PER_FILE, int(BYTES_PER_FILE / max(1.0, mean))))).text(path))


def parse_archive(data: bytes):
    """(headers as dict with lower-case names, block) of each record of a gzip archive."""
    unzip = zlib.decompressobj(31)
    raw = memoryview(unzip.decompress(data) + unzip.flush())
    while unzip.unused_data:  # members one after the other are one archive
        rest, unzip = unzip.unused_data, zlib.decompressobj(31)
        raw = memoryview(bytes(raw) + unzip.decompress(rest) + unzip.flush())
    whole, at = raw.obj, 0
    while at < len(whole):
        end = whole.index(b"\r\n\r\n", at)
        first, *lines = whole[at:end].decode("utf-8", "surrogateescape").split(CRLF)
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(head["content-length"])
        block = raw[end + 4:end + 4 + size]
        if len(block) != size or whole[end + 4 + size:end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"broken record {head.get('warc-record-id')}")
        yield head, block
        at = end + 8 + size


def _read_headers(batches):
    def number(v):
        return int(v) if v is not None else None

    for batch in batches:
        for data in batch.column(0):
            rows = []
            for head, block in parse_archive(data.as_py()):
                digest, size = head["warc-payload-digest"].removeprefix("sha256:"), int(head["warc-payload-length"])
                if head["warc-type"] == "response":
                    payload = bytes(block).partition(b"\r\n\r\n")[2]
                    if (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
                        raise ValueError(f"payload of {head['warc-record-id']} does not fit its digest")
                rows.append((number(head.get("warc-page-id")), head["warc-record-id"], head["warc-type"], size, digest,
                             head.get("warc-refers-to")))
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.int64()), pa.array(c[1], pa.string()), pa.array(c[2], pa.string()),
                     pa.array(c[3], pa.int64()), pa.array(c[4], pa.string()), pa.array(c[5], pa.string())],
                    names=["page_id", "record_id", "record_type", "payload_bytes", "payload_digest", "refers_to_id"])


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in ``path``; responses are checked against their digest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_read_headers, HEADERS)


def resolve_revisits(headers: DataFrame) -> DataFrame:
    """``headers`` with refers_to: the page_id of the response that a revisit names.

    Joined on digest and record id; the response side has one row per record
    id and is written first, so a digest shared by very many revisits is split
    by AQE."""
    responses = cut(headers.where("record_type = 'response'").groupBy("payload_digest", F.col("record_id").alias("refers_to_id"))
                    .agg(F.min("page_id").alias("refers_to")), "responses")
    return headers.join(responses, ["payload_digest", "refers_to_id"], "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("record_type") == "revisit", F.col("refers_to")).alias("refers_to"), "record_id", "refers_to_id")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as deduplicated archives in the shared folder and read them back, revisits resolved."""
    path = new_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    return resolve_revisits(read_headers(pages.sparkSession, path))
