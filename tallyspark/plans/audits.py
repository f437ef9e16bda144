"""The registered queries of the audit over files: they write the documents as logs and databases and look at those."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.plans.catalogue import query, table
from tallyspark.sources import audited, sqlite
from tallyspark.sources.scratch import new_folder


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, text, last): documents, and the line with an assignment that the SQL has after each."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    last = F.concat(F.lit('api_token = "'), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 24), F.lit('"'))
    return docs.select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), "text", last.alias("last"))


def log_folder(spark: SparkSession, sf_dir: str) -> str:
    """A new folder of text files, below it a folder a source."""
    folder = new_folder(spark)
    planted(spark, sf_dir).select("source", F.concat_ws("\n", "text", "last").alias("value")).write.partitionBy("source").text(folder)
    return folder


@query("SELECT source, CAST(sum(strlen(text) + strlen(last) + 2) AS BIGINT) AS bytes, row_number() OVER (ORDER BY source) AS place FROM (SELECT coalesce(source, 'none') AS source, text, 'api_token = \"' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 24) || '\"' AS last FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) GROUP BY source")
def audit_files(spark, sf_dir):
    """Found by their metadata, ordered by path; no file is opened."""
    found = audited.discover(spark, audited.Place("logs", log_folder(spark, sf_dir), ("txt",)))
    sized = found.groupBy(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source")).agg(F.sum("bytes").alias("bytes"))
    return sized.withColumn("place", F.row_number().over(Window.orderBy("source")))


@query("SELECT rule_name, severity, masked, count(*) AS findings FROM fa GROUP BY ALL", "li", "fa")
def audit_logs(spark, sf_dir):
    found = audited.scan(spark, (audited.Place("logs", log_folder(spark, sf_dir), ("txt",)),))
    return found.groupBy("rule_name", "severity", "masked").agg(F.count("*").alias("findings"))


def _databases(spark, sf_dir) -> str:
    folder = new_folder(spark)
    sqlite.write_files(planted(spark, sf_dir).select("doc_id", "text", "last"), folder, "message")
    return folder


@query("SELECT rule_name, severity, masked, count(*) AS findings FROM fa GROUP BY ALL", "li", "fa")
def audit_databases(spark, sf_dir):
    """Secrets in any column of databases that a task each wrote."""
    found = audited.scan(spark, (audited.Place("databases", _databases(spark, sf_dir), ("db",), {}),))
    return found.groupBy("rule_name", "severity", "masked").agg(F.count("*").alias("findings"))


@query(
    """SELECT col, CAST(sum(n) AS BIGINT) AS lines, TRUE AS gapless FROM (
    SELECT 'doc_id' AS col, 1 AS n FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL UNION ALL
    SELECT 'last', 1 FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL UNION ALL
    SELECT 'text', len(string_split(text, chr(10))) FROM documents WHERE doc_id IS NOT NULL AND text <> '') GROUP BY col"""
)
def audit_database_lines(spark, sf_dir):
    """How many lines each column gave; gapless: the numbers of a file's lines run from 1 to their count."""
    place = audited.Place("databases", _databases(spark, sf_dir), ("db",), {})
    paths = [r.path for r in audited.discover(spark, place).select("path").collect()]
    lines = audited.numbered(sqlite.read_texts(spark, paths, rows=500))
    files = lines.groupBy("path").agg(F.count("*").alias("n"), F.min("line_number").alias("low"), F.max("line_number").alias("high"), F.sum("line_number").alias("sum"))
    whole = files.agg(F.bool_and((F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("sum") == F.col("n") * (F.col("n") + 1) / 2)).alias("gapless"))
    return lines.groupBy("col").agg(F.count("*").alias("lines")).crossJoin(whole)


@query("SELECT rule_name, severity, masked, count(*) AS findings FROM fa GROUP BY ALL", "li", "fa")
def audit_appended(spark, sf_dir):
    """The texts are scanned by a stream; then the planted lines come in new files, and only those are read."""
    folder = new_folder(spark)
    docs = planted(spark, sf_dir)
    for value in ("text", "last"):
        docs.select(F.col(value).alias("value")).write.mode("append").text(f"{folder}/logs")
        lines = audited.appended_lines(spark, f"{folder}/logs", f"{folder}/marks", endings="txt", grows="txt")
        stream = audited.keep_findings(lines, f"{folder}/found", f"{folder}/checkpoint").trigger(availableNow=True).start()
        stream.awaitTermination()
    return audited.found_now(spark, f"{folder}/found").groupBy("rule_name", "severity", "masked").agg(F.count("*").alias("findings"))
