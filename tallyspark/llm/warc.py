"""WARC derivatives: metadata and plain-text conversion records that refer to their response."""

from __future__ import annotations

import gzip
import html
import io
import re
import zlib
from collections.abc import Iterator
from html.entities import html5

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The date of records made from a table that has none.
DATE = "2024-01-01T00:00:00Z"
#: The format's version line, line end and the end of a record.
VERSION, EOL, END = "WARC/1.0", "\r\n", "\r\n\r\n"
#: Markup, in order, each put into one space.  What is opened and not closed runs to the end of the page, as in a browser;
#: a tag whose quotes do not close ends at the next angle bracket.  Possessive, so that no tag is scanned twice.
MARKUP = (
    r"(?s)<!--.*?(?:-->|\z)",
    r"(?is)<script\b.*?(?:</script\s*>|\z)",
    r"(?is)<style\b.*?(?:</style\s*>|\z)",
    r"""<[A-Za-z/!?](?:[^<>"']++|"[^"]*+"|'[^']*+')*+>""",
    r"<[A-Za-z/!?][^<>]*+>?",
)
#: White space between words: a no-break space counts.
BLANK = r"[ \t\r\n\f\x{A0}]+"
#: A batch of records that are read ends at this many bytes of blocks.
BATCH = 1 << 24


def record_id(*parts: Column) -> Column:
    """A urn that depends on the parts alone, so that a rerun gives the same links."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


@F.pandas_udf(T.StringType())
def decoded(texts: pd.Series) -> pd.Series:
    """Texts with all named and numeric character references decoded, once."""
    return texts.map(html.unescape, na_action="ignore")


def plain_text(c: Column) -> Column:
    for pattern in MARKUP:
        c = F.regexp_replace(c, F.lit(pattern), F.lit(" "))
    return F.trim(F.regexp_replace(decoded(c), F.lit(BLANK), F.lit(" ")))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(record_id, target_uri, date, http_headers, payload, payload_digest): pages as response records.

    Null html is an empty payload, a null url or id an empty string in the name.
    Equal rows, and they alone, have one record id.
    """
    page = F.coalesce(F.col("html").cast("string"), F.lit(""))
    uri, key = F.coalesce(F.col("url").cast("string"), F.lit("")), F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.octet_length(page).cast("string"), F.lit(EOL))
    return pages.select(record_id(F.lit("response"), key, uri, digest(page)).alias("record_id"), uri.alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"), page.alias("payload"), digest(page).alias("payload_digest"))


def derive(found: DataFrame) -> DataFrame:
    """For each response a metadata and a conversion record, in one pass without a shuffle.

    Both keep the response's id in refers_to, its target, date and payload
    digest; the metadata block repeats its HTTP headers, names the conversion
    and counts its characters.  Columns: record_type, record_id, refers_to,
    target_uri, date, content_type, source_digest, block_digest,
    content_length, block.  An empty payload gives an empty conversion block;
    a null target is an empty one, a null date DATE; repeated responses give
    repeated records.
    """
    text = plain_text(F.coalesce("payload", F.lit("")))
    base = found.withColumns({"_text": text, "_conversion": record_id(F.lit("conversion"), F.col("record_id")), "_metadata": record_id(F.lit("metadata"), F.col("record_id"))})
    lines = F.concat(
        F.coalesce("http_headers", F.lit("")), F.lit("conversion: "), F.col("_conversion"), F.lit(f"{EOL}source-payload-digest: "), F.coalesce("payload_digest", F.lit("")), F.lit(f"{EOL}text-characters: "), F.length("_text").cast("string"), F.lit(EOL)
    )
    record = lambda kind, rid, mime, block: F.struct(F.lit(kind).alias("record_type"), F.col(rid).alias("record_id"), F.lit(mime).alias("content_type"), block.alias("block"))
    both = F.array(record("metadata", "_metadata", "application/warc-fields", lines), record("conversion", "_conversion", "text/plain", F.col("_text")))
    out = base.select(F.col("record_id").alias("refers_to"), F.coalesce("target_uri", F.lit("")).alias("target_uri"), F.coalesce("date", F.lit(DATE)).alias("date"), F.col("payload_digest").alias("source_digest"), F.explode(both).alias("r"))
    return out.select(
        "r.record_type", "r.record_id", "refers_to", "target_uri", "date", "r.content_type", "source_digest", digest(F.col("r.block")).alias("block_digest"), F.octet_length("r.block").cast("long").alias("content_length"), "r.block"
    )


def as_records(derived: DataFrame) -> DataFrame:
    """(value): each record as it stands in a file, without the end mark that the writer puts after it.

    A header that is null is left out; line breaks in one, as a URL may hold
    them, are percent-encoded.
    """
    named = (
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"),
        ("WARC-Source-Payload-Digest", "source_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    )
    plain = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(F.concat_ws(EOL, F.lit(VERSION), *(F.concat(F.lit(f"{name}: "), plain(c)) for name, c in named)), F.lit(END))
    return derived.select(F.concat(head, F.col("block")).alias("value"))


def write(derived: DataFrame, path: str, compression: str = "gzip") -> None:
    """One file a task; what ends a record is the text writer's line end.

    An id stands once in a set of files: of repeats of one record, as equal
    responses give, one is written.
    """
    as_records(derived.dropDuplicates(["record_id"])).write.option("lineSep", END).option("compression", compression).text(path)


def opened(path: str) -> io.BufferedIOBase:
    """The bytes of a file of any file system, unpacked if they begin as gzip or zstd do, whatever the name."""
    if path.startswith(("file:", "/")):
        system, at = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        system, at = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    raw = io.BufferedReader(system.open_input_stream(at, compression=None), 1 << 20)
    first = raw.peek(4)[:4]
    if first[:2] == b"\x1f\x8b":
        return gzip.GzipFile(fileobj=raw)
    if first == b"\x28\xb5\x2f\xfd":
        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True), 1 << 20)
    return raw


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes, int | None, bool]]:
    """(headers, block, length, whole) of a stream, one record in memory at a time.

    A block has as many bytes as its header says, whatever stands in it.  Where
    no length can be read, or bytes lie between records, they go up to the next
    version line and are not whole.  Names are lower-cased; values of a
    repeated name are joined by a comma, folded lines by a space.
    """
    begins, ends = re.compile(rb"WARC/\d+\.\d+\s*$").match, (b"\r\n", b"\n")
    line = stream.readline()
    while line:
        if line in ends:
            line = stream.readline()
            continue
        headers: dict[str, str] = {}
        if begins(line):
            name, line = "", stream.readline()
            while line and line not in ends:
                text = line.decode("utf-8", "replace").strip()
                if line[:1] in b" \t" and name:
                    headers[name] += " " + text
                elif ":" in text:
                    name, value = (x.strip() for x in text.split(":", 1))
                    name = name.lower()
                    headers[name] = f"{headers[name]}, {value}" if name in headers else value
                line = stream.readline()
            said = headers.get("content-length", "")
            if said.isascii() and said.isdigit():
                length = int(said)
                block = stream.read(length)
                line = stream.readline()
                yield headers, block, length, len(block) == length and line in (b"", *ends)
                continue
            line = stream.readline()
        parts = []
        while line and not begins(line):
            parts.append(line)
            line = stream.readline()
        yield headers, b"".join(parts), None, False


def read(spark: SparkSession, path: str, binary: bool = False) -> DataFrame:
    """(path, headers, block, content_length, whole) of the records of all files below a path, of every version.

    Files are plain, gzip or zstd, told by their first bytes; Spark lists them
    and deals them to tasks by size, and a file is one task, which streams it:
    where a record begins is known only from the length of the one before.
    `whole` is false where a block is not as long as its header says.  A file
    that breaks off gives a last row without headers that is not whole.  Blocks
    are text, with a replacement sign for what is no UTF-8, or else `binary`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "headers", "block", "content_length", "whole"]
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"content_length": "Int64"})
        for batch in batches:
            for at in batch["path"]:
                rows, size = [], 0
                with opened(at) as stream:
                    found = records(stream)
                    while True:
                        try:
                            record = next(found, None)
                        except (EOFError, gzip.BadGzipFile, zlib.error, zstandard.ZstdError):
                            record, found = ({}, b"", None, False), iter(())
                        if record is None:
                            break
                        headers, block, length, whole = record
                        rows.append((at, headers, block if binary else block.decode("utf-8", "replace"), length, whole))
                        size += len(block)
                        if size >= BATCH or len(rows) >= 4096:
                            yield frame(rows)
                            rows, size = [], 0
                yield frame(rows)

    kind = "binary" if binary else "string"
    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(run, f"path string, headers map<string, string>, block {kind}, content_length long, whole boolean")


#: DuckDB's form of derive(responses(pages)), digests in place of the blocks.
ORACLE = f"""
WITH r AS (
  SELECT coalesce(url, '') AS target_uri, coalesce(html, '') AS payload,
         md5('response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '') || '|sha256:' || sha256(coalesce(html, ''))) AS h FROM pages
), n AS (
  SELECT *, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' AS refers_to,
         'sha256:' || sha256(payload) AS source_digest FROM r
), s AS (
  SELECT *, {{stripped}} AS bare FROM n
), c AS (
  SELECT *, string_split_regex(bare, '{{reference}}') AS between, list_transform(regexp_extract_all(bare, '{{reference}}'), lambda x: CASE
    WHEN x[2] <> '#' THEN MAP {{{{named}}}}[substr(x, 2)]
    WHEN lower(x[3]) = 'x' THEN CAST(coalesce(TRY_CAST('0x' || rtrim(substr(x, 4), ';') AS BIGINT), 1114112) AS VARCHAR)
    ELSE CAST(coalesce(TRY_CAST(rtrim(substr(x, 3), ';') AS BIGINT), 1114112) AS VARCHAR) END) AS marks,
    regexp_extract_all(bare, '{{reference}}') AS refs FROM s
), d AS (
  SELECT *, list_transform(list_zip(refs, marks), lambda x: CASE WHEN x[1][2] <> '#' THEN x[2]
    WHEN CAST(x[2] AS BIGINT) BETWEEN 55296 AND 57343 OR CAST(x[2] AS BIGINT) > 1114111 THEN chr(65533)
    ELSE chr(CAST(x[2] AS INTEGER)) END) AS signs FROM c
), m AS (
  SELECT *, md5('conversion|' || refers_to) AS hc, md5('metadata|' || refers_to) AS hm,
         trim(regexp_replace(array_to_string(list_transform(list_zip(between, signs), lambda x: x[1] || coalesce(x[2], '')), ''), '{{blank}}', ' ', 'g'), ' ') AS txt FROM d
), i AS (
  SELECT *, '<urn:uuid:' || hc[1:8] || '-' || hc[9:12] || '-' || hc[13:16] || '-' || hc[17:20] || '-' || hc[21:32] || '>' AS conversion,
         '<urn:uuid:' || hm[1:8] || '-' || hm[9:12] || '-' || hm[13:16] || '-' || hm[17:20] || '-' || hm[21:32] || '>' AS metadata FROM m
), b AS (
  SELECT 'metadata' AS record_type, metadata AS record_id, refers_to, target_uri, 'application/warc-fields' AS content_type, source_digest,
         'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(payload) || chr(13) || chr(10)
         || 'conversion: ' || conversion || chr(13) || chr(10) || 'source-payload-digest: ' || source_digest || chr(13) || chr(10) || 'text-characters: ' || length(txt) || chr(13) || chr(10) AS block FROM i
  UNION ALL
  SELECT 'conversion', conversion, refers_to, target_uri, 'text/plain', source_digest, txt FROM i
)
SELECT record_type, record_id, refers_to, target_uri, '{DATE}' AS date, content_type, source_digest,
       'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length FROM b
"""


def oracle_sql() -> str:
    """The numbers that the standard moves or leaves out, from 128 to 159 and control signs, are not told apart in SQL."""
    quoted = lambda x: x.replace("'", "''")
    stripped = "payload"
    for pattern in MARKUP:
        stripped = f"regexp_replace({stripped}, '{quoted(pattern.replace('*+', '*').replace('++', '+'))}', ' ', 'g')"
    names = sorted(html5, key=lambda x: (-len(x), x))
    reference = "&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|" + "|".join(names) + ")"
    named = ", ".join(f"'{x}': '{quoted(html5[x])}'" for x in names)
    return ORACLE.replace("{stripped}", stripped).replace("{reference}", reference).replace("{named}", named).replace("{blank}", BLANK)
