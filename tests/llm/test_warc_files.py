"""Records of files that others wrote, and the text of pages with awkward markup."""

import gzip
import time

import pytest
import zstandard

from tallyspark.llm import warc

RESPONSE = b"HTTP/1.1 200 OK\r\n\r\nbefore\r\nWARC/1.0\r\nWARC-Type: resource\r\n\r\nafter\r\n\r\n"


def record(block: bytes, version: str = "1.0", length: int | None = -1, more: str = "") -> bytes:
    said = "" if length is None else f"Content-Length: {len(block) if length < 0 else length}\r\n"
    return f"WARC/{version}\r\nWARC-Type: response\r\n{more}{said}\r\n".encode() + block + b"\r\n\r\n"


def read(spark, folder, **more):
    return [(r.headers, r.block, r.content_length, r.whole) for r in warc.read(spark, str(folder), **more).orderBy("path").collect()]


@pytest.mark.parametrize("pack", ["plain", "gzip", "zstd"])
def test_lengths_tell_records_apart_in_every_version(spark, tmp_path, pack):
    parts = [record(RESPONSE), record(b"\xff\xfe\x00", "1.1", more="WARC-Concurrent-To: <a>\r\nwarc-concurrent-to: <b>\r\nX: one\r\n  two\r\n"), record(b"")]
    packed = {"plain": lambda x: x, "gzip": gzip.compress, "zstd": zstandard.compress}[pack]
    (tmp_path / "a.warc").write_bytes(b"".join(map(packed, parts)))
    found = read(spark, tmp_path, binary=True)
    assert [bytes(b) for _, b, _, _ in found] == [RESPONSE, b"\xff\xfe\x00", b""] and all(whole for *_, whole in found)
    assert found[1][0]["warc-concurrent-to"] == "<a>, <b>" and found[1][0]["x"] == "one two"
    assert read(spark, tmp_path)[0][1] == RESPONSE.decode()


def test_records_that_are_not_whole_hide_no_others(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"stray\n" + record(b"no length", length=None) + record(b"too long", length=3) + record(b"good") + record(b"cut", length=99)[:-4])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record(b"kept")) + gzip.compress(record(b"lost" * 5000))[:60])
    (tmp_path / "c.warc").write_bytes(b"")
    found = [(b, whole) for _, b, _, whole in read(spark, tmp_path)]
    assert found[:6] == [("stray\n", False), ("no length\r\n\r\n", False), ("too", False), (" long\r\n\r\n", False), ("good", True), ("cut", False)]
    assert found[6] == ("kept", True) and found[-1] == ("", False)


def test_a_repeated_response_is_written_once_and_other_bytes_have_another_id(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (1, "u", "y")], "page_id long, url string, html string")
    made = warc.derive(warc.responses(pages))
    assert made.count() == 6
    warc.write(made, str(tmp_path / "out"))
    ids = [h["warc-record-id"] for h, *_ in read(spark, tmp_path / "out")]
    assert len(ids) == len(set(ids)) == 4


PAGES = [
    ("<p title='a>b'>x &eacute; &#8217;", "x é ’"),
    ('<p title="x>Hello</p> there', "Hello there"),
    ("a < b and c > d", "a < b and c > d"),
    ("&amp;lt; &copy 2020 &#x41;&#65; &#0; &#1114112;", "&lt; © 2020 AA � �"),
    ("one&nbsp;&#160;two", "one two"),
    ("x<!-- never closed <p>y", "x"),
    ("x<script>never closed", "x"),
    ("x<style>a</script>b</style>y", "x y"),
    ("<a href=x", ""),
    ("", ""),
    (None, ""),
]


def test_plain_text_leaves_no_markup(spark):
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PAGES)], "i long, p string")
    got = rows.select("i", warc.plain_text(warc.F.coalesce("p", warc.F.lit(""))).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [t for _, t in PAGES]


@pytest.mark.parametrize("page", ["<a " * 100_000 + '"', "<script>" * 50_000, "<!--" * 100_000, "&" * 200_000, '<a "' * 100_001])
def test_plain_text_takes_linear_time(spark, page):
    rows = spark.createDataFrame([(page,)], "p string")
    begun = time.monotonic()
    rows.select(warc.F.length(warc.plain_text(warc.F.col("p")))).collect()
    assert time.monotonic() - begun < 5


def test_sql_gives_the_same_records(spark, tmp_path):
    import duckdb

    odd = [(i, f"http://{i}/", p) for i, (p, _) in enumerate(PAGES) if p is None or "&#0;" not in p]
    pages = spark.createDataFrame(odd, "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    expected = sorted(con.sql(warc.oracle_sql()).fetchall())
    got = warc.derive(warc.responses(pages)).select("record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "source_digest", "block_digest", "content_length").collect()
    assert sorted(tuple(r[c] for c in con.sql(warc.oracle_sql()).columns) for r in got) == expected
