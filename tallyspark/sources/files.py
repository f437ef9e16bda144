"""Finding files and reading their lines."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _since(t: datetime | None) -> dict[str, str]:
    """Spark's option is exclusive, the range is not."""
    return {"modifiedAfter": (t - timedelta(seconds=1)).strftime("%Y-%m-%dT%H:%M:%S")} if t else {}


def plain(path: Column) -> Column:
    """A path of the local file system without its scheme, as listings and scans write it in different ways."""
    return F.regexp_replace(path, "^file:/+", "/")


def read_path() -> Column:
    """The plain path of the file that a row was read from; Spark writes it as a URL."""
    return plain(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))


def listed(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """(path, bytes, changed) of the files below folders or of files; none is opened."""
    raw = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=glob).load(path)
    return raw.select(plain(F.col("path")).alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def lines(spark: SparkSession, path: str | list[str], glob: str = "*.jsonl", since: datetime | None = None) -> DataFrame:
    """(path, modified, line, text): non-blank lines of files below a folder; `line` orders those of one file.

    Large files are split between tasks; `line` is the byte range's number and
    the place inside it, so no task reads a file from its beginning to count.
    """
    raw = spark.read.options(recursiveFileLookup=True, pathGlobFilter=glob, **_since(since)).text(path)
    meta = raw.select(read_path().alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_block_start").alias("_at"), F.trim(F.regexp_replace("value", "\r$", "")).alias("text"))
    return meta.withColumn("line", F.struct(F.col("_at"), F.monotonically_increasing_id().alias("_id"))).drop("_at").where("text <> ''")


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, line_number, line): all lines of files, blank ones too, numbered from 1.

    Large files are split between tasks: lines are counted by byte range, and
    a range's first number is the sum of those before it.
    """
    raw = spark.read.text(paths).select(read_path().alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("line"))
    counts = raw.groupBy("path", "at").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    upto = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("path", "at", (F.coalesce(F.sum("n").over(upto), F.lit(0)) - F.col("low") + 1).alias("shift"))
    return raw.join(first, ["path", "at"]).select("path", (F.col("id") + F.col("shift")).alias("line_number"), "line")


def documents(spark: SparkSession, path: str, glob: str = "*.json", since: datetime | None = None) -> DataFrame:
    """(path, modified, text): whole files."""
    raw = spark.read.options(recursiveFileLookup=True, pathGlobFilter=glob, wholetext=True, **_since(since)).text(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))


def dated(paths: Column) -> Column:
    """The day of a path with /YYYY/MM/DD/ in it, null for others."""
    d = F.regexp_extract(paths, r"/(\d{4})/(\d{2})/(\d{2})/", 0)
    return F.try_to_date(F.nullif(F.translate(F.trim(F.translate(d, "/", " ")), " ", "-"), F.lit("")))


def day_folders(spark: SparkSession, path: str, first: date, last: date, lookback: int = 3, archived: str = "archived_sessions") -> list[str]:
    """The folders of these days and of `lookback` days before, and the archive, of those that exist below the path.

    Only these are listed; the folders of other days are never looked into.
    """
    days = [first + timedelta(days=k) for k in range(-lookback, (last - first).days + 1)]
    return [wanted for wanted in [*(f"{path}/sessions/{d:%Y/%m/%d}" for d in days), f"{path}/{archived}"] if exists(spark, wanted)]


def in_days(files: DataFrame, first: str, last: str, lookback: int = 3, archived: str = "archived_sessions") -> DataFrame:
    """Files of the days from `lookback` before the first up to the last, archived ones whatever their day."""
    day = dated(F.col("path"))
    return files.where(F.col("path").contains(f"/{archived}/") | (day >= F.date_sub(F.lit(first).cast("date"), lookback)) & (day <= F.lit(last).cast("date")))


def first_of_file(rows: DataFrame, *columns: str) -> DataFrame:
    """(path, columns): of each column the first value of a file that is not null, each by its own line."""
    return rows.groupBy("path").agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line"))).alias(c) for c in columns))


def decoded(rows: DataFrame, schema: str, text: str = "text") -> DataFrame:
    """rows with `r`, the parsed line; lines that are no JSON objects go, wrong-typed fields are null."""
    return rows.withColumn("r", F.from_json(text, schema)).where(F.try_parse_json(text).isNotNull() & F.col("r").isNotNull())


def whole_if_typed(rows: DataFrame, text: str, *paths_and_fields: tuple[str, Column]) -> DataFrame:
    """Drop rows of which a field is present but of the wrong type, as strict decoders drop the record."""
    for path, field in paths_and_fields:
        rows = rows.where(F.get_json_object(text, path).isNull() | field.isNotNull())
    return rows
