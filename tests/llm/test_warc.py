import glob
import gzip

from tenderlake.llm import warc
from tenderlake.llm.queries import op5

LONG = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 20


def archive(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, first_id string, payload_digest string")
    return warc.archive_pages(df)


def test_revisits_round_trip(spark):
    rows = [(5, "http://a/", LONG, "c", "c"), (3, None, LONG, "c", "c"), (9, "http://b/\r\nX: y", LONG, "c", "c"), (1, "u", "tiny", "c", "c"),
            (2, "u", "tiny", "c", "c"), (7, "u", None, "c", "c"), (8, "u", "", "c", "c"), (6, "u", "x" * 99, "c", "c"), (10, "u", "x" * 99, "c", "c"),
            (11, "u", "y" * 100, "c", "c"), (12, "u", "y" * 100, "c", "c"), (None, "u", LONG, "c", "c"), (3, None, LONG, "c", "c")]
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in archive(spark, rows).collect()), key=str)
    n = len(LONG.encode())
    assert got == sorted([(5, n, "revisit", 3), (3, n, "response", None), (3, n, "response", None), (9, n, "revisit", 3), (None, n, "revisit", 3),
                          (1, 4, "response", None), (2, 4, "response", None), (7, 0, "response", None), (8, 0, "response", None),
                          (6, 99, "response", None), (10, 99, "response", None), (11, 100, "response", None), (12, 100, "revisit", 11)], key=str)


def test_archive_is_valid_warc(spark, scratch):
    df = spark.createDataFrame([(1, "http://a/", LONG), (2, "http://b/", LONG)], "page_id long, url string, html string")
    warc.write_archive(df, scratch + "/w")
    records = [r for f in glob.glob(scratch + "/w/*.gz") for r in warc.parse_archive(open(f, "rb").read())]
    kinds = {h["warc-page-id"]: (h, bytes(b)) for h, b in records}
    assert kinds["1"][1].endswith(LONG.encode()) and kinds["1"][1].startswith(b"HTTP/1.1 200 OK\r\n")
    assert kinds["2"][0]["warc-type"] == "revisit" and kinds["2"][0]["warc-refers-to"] == kinds["1"][0]["warc-record-id"]
    assert kinds["2"][0]["warc-profile"] == warc.PROFILE and not kinds["2"][1].partition(b"\r\n\r\n")[2]
    assert kinds["1"][0]["warc-record-id"] != kinds["2"][0]["warc-record-id"]


def test_members_one_after_another():
    one = b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [bytes(b) for _, b in warc.parse_archive(gzip.compress(one) + gzip.compress(one))] == [b"ab", b"ab"]


def test_empty_table(spark):
    assert archive(spark, []).count() == 0


def test_given_pages(spark, sf):
    import hashlib
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    first = {}
    for i, raw in sorted(pages):
        first.setdefault(raw, i)
    want = [(i, len(raw), hashlib.sha256(raw).hexdigest(), *(("revisit", first[raw]) if len(raw) >= 100 and first[raw] != i else ("response", None)))
            for i, raw in pages]
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in op5(spark, sf).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_dates_are_utc_whatever_the_session_says(spark, scratch):
    from datetime import datetime, timedelta, timezone
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        warc.write_archive(spark.createDataFrame([(1, "http://a/", "x")], "page_id long, url string, html string"), scratch + "/w")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    head = next(h for f in glob.glob(scratch + "/w/*.gz") for h, _ in warc.parse_archive(open(f, "rb").read()))
    at = datetime.strptime(head["warc-date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc)
    assert abs(datetime.now(timezone.utc) - at) < timedelta(minutes=10)


def test_large_pages_make_short_files_and_a_third_alike(spark, scratch, monkeypatch):
    monkeypatch.setattr(warc, "BYTES_PER_FILE", 3 << 20)
    rows = [(i, f"http://a/{i}", ("same " if i % 3 == 0 else f"page {i} ") * 120_000) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archive(df, scratch + "/w")
    files = [open(f, "rb").read() for f in glob.glob(scratch + "/w/*.gz")]
    assert len(files) >= 3 and sum(len(list(warc.parse_archive(x))) for x in files) == 12
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in archive(spark, [(*r, "c", "c") for r in rows]).collect()}
    assert got == {i: ("revisit", 0) if i % 3 == 0 and i else ("response", None) for i in range(12)}
