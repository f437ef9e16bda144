"""Reports as sectioned CSV and as JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the columns of an export, in order.
COLUMNS = (
    "section", "name", "source", "model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens",
    "total_tokens", "cost_usd", "active_seconds", "start_date", "end_date", "project_path", "session_id", "attribution_quality",
)
COUNTS = COLUMNS[4:10]
_ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def dollars(nano: str) -> Column:
    """Six decimals, rounded half up in whole numbers."""
    micro = F.expr(f"({nano} + 500) div 1000")
    return F.format_string("%d.%06d", F.floor(micro / 1_000_000).cast("long"), micro % 1_000_000)


def sections(found: DataFrame, start: str, end: str) -> DataFrame:
    """All rows of an export as strings, of a cube and in one pass over it; an unpriced model has no cost."""
    text, at, col = F.lit, lambda c: F.date_format(c, _ISO), F.col
    span = {"start_date": text(start), "end_date": text(end)}
    own = {"start_date": at("first_at"), "end_date": at("last_at"), "project_path": col("project_path"), "attribution_quality": col("quality"), "name": col("project_name")}
    counts = {c: col(c).cast("string") for c in COUNTS} | {"cost_usd": dollars("cost_nano")}
    seconds = {"active_seconds": F.format_string("%.3f", col("active_us") / 1e6)}
    cells = {
        "total": counts | span | seconds | {"name": text("All")},
        "source": counts | span | seconds | {"name": col("source"), "source": col("source")},
        "model": span | {"name": col("model"), "source": col("sources"), "model": col("model"), "total_tokens": counts["total_tokens"], "cost_usd": F.when(col("price_known"), dollars("cost_nano")), "active_seconds": text("0.000")},
        "project": counts | own | {"source": col("sources")},
        "session": counts | own | {"source": col("source"), "model": col("models"), "session_id": col("session_id")},
    }

    def cell(c: str) -> Column:
        out = F.lit(None).cast("string")
        for name, of in cells.items():
            if c in of:
                out = F.when(col("section") == name, of[c].cast("string")).otherwise(out)
        return F.coalesce(out, F.lit("")).alias(c)

    return found.select(F.col("section"), *(cell(c) for c in COLUMNS[1:]))


def write_csv(rows: DataFrame, path: str) -> None:
    """Quotes only where a cell needs them, doubled inside."""
    rows.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def as_csv_lines(rows: DataFrame) -> DataFrame:
    """(line): each row as a line of CSV, quoted only where it must be."""
    quoted = lambda c: F.when(F.col(c).rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    return rows.select(F.concat_ws(",", *map(quoted, rows.columns)).alias("line"))


def as_json(rows: DataFrame) -> DataFrame:
    """(section, json): each row as an object with sorted keys and no empty cells: the form for exports of any size."""
    cells = F.struct(*(F.nullif(F.col(c), F.lit("")).alias(c) for c in sorted(rows.columns) if c != "section"))
    return rows.select("section", F.to_json(cells).alias("json"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (part, task, text) as pieces: the texts of a part in a batch, joined by commas, with their places and counts."""
    number = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        parts, tasks, texts = (c.to_pylist() for c in batch.columns)
        out = []
        for part, run in groupby(zip(parts, texts, strict=True), itemgetter(0)):
            some = [text for _, text in run]
            out.append((part, tasks[0], number, len(some), ",".join(some)))
            number += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["part", "task", "number", "n", "text"])


def as_document(found: DataFrame, date: str, start: str, end: str, most: int | None = None) -> DataFrame:
    """(json): a cube as one object with sorted keys: dates, totals, and sources, models, projects and sessions as arrays.

    Arrays are in the order of the tokens, then of the names.  Tasks order and
    write ranges of the rows; as a document is a single text, the last step
    puts the ranges' texts together in one task, up to the 2 GB that a text can
    hold.  A cube of more than `most` rows, if given, is an error, as nothing is
    left out: as_json() has no bound.
    """
    sums = {c: F.col(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", "total_tokens", "cost_nano")}
    about = {"first_at": F.date_format("first_at", _ISO), "last_at": F.date_format("last_at", _ISO), "models": F.col("models"), "project_name": F.col("project_name"), "project_path": F.col("project_path"), "quality": F.col("quality")}
    forms = {
        "models": ("model", {"model": F.col("model"), "total_tokens": F.col("total_tokens"), "cost_nano": F.col("cost_nano")}, ["model"]),
        "projects": ("project", sums | about | {"sources": F.col("sources"), "sessions": F.col("sessions")}, ["project_name", "project_path"]),
        "sessions": ("session", sums | about | {"source": F.col("source"), "session_id": F.col("session_id"), "session_key": F.col("session_key")}, ["source", "session_key"]),
        "sources": ("source", sums | {"source": F.col("source")}, ["source"]),
        "totals": ("total", sums, []),
    }

    def of_section(values: list[Column]) -> Column:
        out = F.lit(None)
        for (section, _, _), value in zip(forms.values(), values, strict=True):
            out = F.when(F.col("section") == section, value).otherwise(out)
        return out

    text = of_section([F.to_json(F.struct(*(cells[k].alias(k) for k in sorted(cells))), {"ignoreNullFields": "false"}) for _, cells, _ in forms.values()])
    name = lambda i: of_section([F.coalesce(F.col(by[i]), F.lit("")) if i < len(by) else F.lit("") for _, _, by in forms.values()])
    part = of_section([F.lit(i) for i in range(len(forms))])
    keyed = found.select(part.alias("part"), (-F.col("total_tokens")).alias("_k"), name(0).alias("_a"), name(1).alias("_b"), text.alias("text"))
    order = ["part", "_k", "_a", "_b", "text"]
    pieces = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("part", F.spark_partition_id().alias("task"), "text").mapInArrow(_joined, "part int, task int, number long, n long, text string")
    piece = F.struct("task", "number", "text")
    lists = {n: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == i, piece))), lambda x: x["text"]), ",") for i, n in enumerate(forms)}
    one = pieces.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_n"), *(c.alias(n) for n, c in lists.items()))
    array = lambda n: F.concat(F.lit(f'"{n}":['), F.col(n), F.lit("]"))
    given = lambda n, v: F.lit(f'"{n}":{json.dumps(v, ensure_ascii=False)}')
    members = [given("date", date), given("endDate", end), array("models"), array("projects"), array("sessions"), array("sources"), given("startDate", start), F.concat(F.lit('"totals":'), F.coalesce(F.nullif("totals", F.lit("")), F.lit("null")))]
    whole = F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
    if most is None:
        return one.select(whole.alias("json"))
    return one.select(F.when(F.col("_n") > most, F.raise_error(F.lit(f"more than {most} rows are no document: take as_json()")).cast("string")).otherwise(whole).alias("json"))
