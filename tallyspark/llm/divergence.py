"""Source divergence audit: how the vocabulary of each source departs from its language's and from other sources'."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, each_run, materialize
from tallyspark.llm.runs import by_table, counted, pieces, words

#: A term is a run of ASCII letters and of what is beyond ASCII: in UTF-8, of these bytes.
LETTERS = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Added to each count, and what a share of all counts is scaled to.
PRIOR, SCALE = 5, 1_000_000_000
#: Sources compared at once, terms of a slice, terms of a block of the matrix in a task.
SOURCES, SLICE, ROWS = 64, 4096, 512
#: Bits of a value, those that a histogram tells apart, and tied rows from which on they are told apart by their bytes.
VALUE_BITS, STEP, LOOSE = 30, 10, 256


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, a row a group, term and piece of the input."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    spaced = by_table(LETTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b, 2)):
            langs, sources = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
            row, code, terms = words(batch.column(2), spaced)
            (row, code), n = counted(row, code)
            group = (langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy())[row]
            key = group * max(len(terms), 1) + code
            found, back, holding = np.unique(key, return_inverse=True, return_counts=True)
            total = np.zeros(len(found), np.int64)
            np.add.at(total, back, n)
            group, code = np.divmod(found, max(len(terms), 1))
            lang, source = np.divmod(group, max(len(sources.dictionary), 1))
            out = [langs.dictionary.take(pa.array(lang)), sources.dictionary.take(pa.array(source)), terms.take(pa.array(code)).cast(pa.string()), pa.array(total), pa.array(holding.astype(np.int64))]
            yield pa.record_batch(out, ["lang", "source", "term", "n", "docs"])

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, n, lang_n, first): counts of the terms in enough documents of their language.

    One exchange by language and term serves the counts by source, the
    language's counts, and `first`, which is 1 in one row of each term.
    """
    one = term_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    told = one.withColumns({"held": F.sum("docs").over(whole), "lang_n": F.sum("n").over(whole), "first": (F.row_number().over(whole.orderBy("source")) == 1).cast("int")})
    return told.where(F.col("held") >= least_docs).select("lang", "source", "term", "n", "lang_n", "first")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exactly: decimals hold all 38 digits."""
    above = (count + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", above, (total + PRIOR * terms).cast("decimal(20,0)"))


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, terms, base): a row for each group that occurs, `base` being a missing term's share."""
    all_groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("led"))
    joined = all_groups.join(sums, ["lang", "source"], "left").na.fill(0, ["total", "led"])
    lang = Window.partitionBy("lang")
    out = joined.withColumns({"lang_total": F.sum("total").over(lang), "terms": F.sum("led").over(lang)}).drop("led")
    return out.withColumn("base", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(0))


def pair_distances(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the summed difference of each two sources of a language, in both directions.

    Two sources differ by |base - base| in each term that neither has; only
    terms that one of a block of sources has are looked at, and what they
    differ by beyond that is added.  A task compares two blocks of at most
    SOURCES sources over one slice of the terms and returns a sum a pair.
    """
    lang = Window.partitionBy("lang")
    dealt = groups.withColumns({"no": F.row_number().over(lang.orderBy("source")) - 1, "sources": F.count("*").over(lang)}).select(
        "lang", "source", "terms", "base", F.floor(F.col("no") / SOURCES).cast("int").alias("own"), F.ceil(F.col("sources") / SOURCES).cast("int").alias("blocks"), F.ceil((F.col("terms") + 1) / SLICE).cast("int").alias("slices")
    )
    dealt = materialize(dealt)
    none = dealt.select("lang", "source", "own", "blocks", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(None).cast("string").alias("term"), F.col("base").alias("p"), "terms")
    some = shares.join(dealt, ["lang", "source"]).select("lang", "source", "own", "blocks", F.pmod(F.xxhash64("term"), F.col("slices").cast("long")).cast("int").alias("slice"), "term", "p", "terms")
    spread = none.unionByName(some).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("lang", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "slice", "term", "source", "own", "p", "terms")

    def compare(t: pa.Table) -> pa.RecordBatch | None:
        lang, term = t.column("lang").combine_chunks().dictionary_encode(), t.column("term").combine_chunks().dictionary_encode()
        source = t.column("source").combine_chunks()
        term_no = pc.fill_null(term.indices, -1).to_numpy(zero_copy_only=False)
        lang_no, lo, hi, part = lang.indices.to_numpy(), *(t.column(c).to_numpy() for c in ("lo", "hi", "slice"))
        own, p, terms = (t.column(c).to_numpy() for c in ("own", "p", "terms"))
        source_no = source.dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero(np.r_[True, (np.diff(lang_no) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0) | (np.diff(part) != 0), True])
        out: list[tuple] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            names = np.flatnonzero(term_no[a:b] < 0) + a
            base, where = p[names], np.full(source_no[a:b].max() + 1, -1)
            where[source_no[names]] = np.arange(len(names))
            rows = np.flatnonzero(term_no[a:b] >= 0) + a
            line = np.unique(term_no[rows], return_inverse=True)[1]
            column, order = where[source_no[rows]], np.argsort(line, kind="stable")
            line, column, value = line[order], column[order], p[rows][order]
            total = np.zeros((len(names), len(names)), np.int64)
            for top in range(0, int(line.max(initial=-1)) + 1, ROWS):
                x, y = np.searchsorted(line, (top, top + ROWS))
                block = np.tile(base, (min(ROWS, int(line[-1]) + 1 - top), 1))
                block[line[x:y] - top, column[x:y]] = value[x:y]
                for i in range(len(names)):
                    total[i] += np.abs(block - block[:, i : i + 1]).sum(0)
                total -= len(block) * np.abs(base[:, None] - base[None, :])
            if part[a] == 0:
                total += terms[a] * np.abs(base[:, None] - base[None, :])
            mine = own[names]
            i, j = np.nonzero((mine[:, None] == lo[a]) & (mine[None, :] == hi[a]))
            distinct = i < j if lo[a] == hi[a] else i >= 0
            i, j = i[distinct], j[distinct]
            out.append((np.full(len(i), a), names[i], names[j], total[i, j]))
        at, i, j, value = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.record_batch([t.column("lang").combine_chunks().take(pa.array(at)), source.take(pa.array(i)), source.take(pa.array(j)), pa.array(value)], ["lang", "a", "b", "value"])

    keys = ["lang", "lo", "hi", "slice"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each_run(batches, keys, compare)

    sums = spread.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "lang string, a string, b string, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", ways.alias("x"), "value").select("lang", "x.source", "x.item", "value")


def _cut(bins: DataFrame, falling: bool) -> DataFrame:
    """The bin of each group in which the needed-th row lies, what is still needed in it, and its rows.

    bins: (lang, source, need, prefix, bin, rows), at most a few thousand bins
    a group.  Groups with fewer rows than needed give none: all their rows stay.
    """
    order = F.col("bin").desc() if falling else F.col("bin").asc()
    before = Window.partitionBy("lang", "source").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    told = bins.withColumn("above", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    return told.where("above < need AND need <= above + rows").withColumn("need", F.col("need") - F.col("above"))


def top_terms(values: DataFrame, top: int, loose: int = LOOSE) -> DataFrame:
    """The rows (lang, source, term, value) of the `top` largest values of each group, ties by the term's bytes, with their rank.

    Radix selection: three histograms over ten bits each find the value of
    the top-th row; where more than `loose` rows share it, histograms over two
    bytes of the term each cut the ties.  No group is sorted whole: a window
    orders at most top + loose rows.
    """
    keys = ["lang", "source"]
    state = values.select(*keys).distinct().select(*keys, F.lit(top).cast("long").alias("need"), F.lit(0).cast("long").alias("prefix"))
    for shift in range(VALUE_BITS - STEP, -1, -STEP):
        inside = values.join(state, keys).where(F.shiftright("value", shift + STEP) == F.col("prefix"))
        bins = inside.groupBy(*keys, "need", "prefix", F.shiftright("value", shift).bitwiseAND((1 << STEP) - 1).alias("bin")).agg(F.count("*").alias("rows"))
        last, state = state, materialize(_cut(bins, falling=True).select(*keys, "need", (F.shiftleft("prefix", STEP) + F.col("bin")).alias("prefix"), "rows"))
        if shift < VALUE_BITS - STEP:
            discard(values.sparkSession, last)
    ties = state.select(*keys, "need", F.col("prefix").alias("least"), F.lit("").alias("cut"), "rows", (F.col("rows") == F.col("need")).alias("done"))
    size = 0
    code = F.hex(F.encode("term", "UTF-8"))
    while ties.where(~F.col("done") & (F.col("rows") > loose)).limit(1).count():
        open_ = ties.where(~F.col("done") & (F.col("rows") > loose))
        inside = values.join(open_, keys).where((F.col("value") == F.col("least")) & (F.left(code, F.lit(size)) == F.col("cut")))
        bins = inside.groupBy(*keys, "need", "least", F.col("cut").alias("prefix"), F.substring(code, size + 1, 4).alias("bin")).agg(F.count("*").alias("rows"))
        cut = _cut(bins, falling=False).select(*keys, "need", "least", F.concat("prefix", "bin").alias("cut"), "rows", (F.col("rows") == F.col("need")).alias("done"))
        ties = materialize(ties.where(F.col("done") | (F.col("rows") <= loose)).unionByName(cut))
        size += 4
    found = values.join(ties.select(*keys, "least", "cut", F.length("cut").alias("size")), keys, "left")
    above = F.col("least").isNull() | (F.col("value") > F.col("least")) | ((F.col("value") == F.col("least")) & (F.left(code, F.col("size")) <= F.col("cut")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), F.asc("term")))
    return found.where(above).select(*keys, "term", "value").withColumn("rank", rank).where(F.col("rank") <= top)


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50, loose: int = LOOSE) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources of a language by distance, and each group's most overused terms.

    Null lang, source and text count as ''.  A group without terms has the
    shares of an empty one; a language of one source has no pairs, one without
    kept terms has distances of 0; an empty table gives no rows.  Repeated
    rows count each.  Other columns of docs are not read.
    """
    kept = materialize(kept_terms(docs, least_docs))
    groups = materialize(group_totals(docs, kept))
    known = kept.join(groups, ["lang", "source"])
    shares = known.select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    pairs = pair_distances(shares.select("lang", "source", "term", "p"), groups)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    pairs = pairs.withColumn("rank", rank).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    over = materialize(shares.where("p > q").select("lang", "source", "term", (F.col("p") - F.col("q")).alias("value")))
    terms = top_terms(over, top, loose).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(terms)


#: DuckDB's form of audit(documents).
ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), k AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ws)) AS term FROM d) GROUP BY 1, 2 HAVING count(*) >= 30
), t AS (
  SELECT lang, source, term, count(*) AS c FROM (SELECT lang, source, unnest(ws) AS term FROM d) JOIN k USING (lang, term) GROUP BY 1, 2, 3
), g AS (
  SELECT x.lang, x.source, coalesce(n, 0) AS n, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) x
  LEFT JOIN (SELECT lang, source, sum(c) AS n FROM t GROUP BY 1, 2) y ON x.lang = y.lang AND x.source = y.source
  LEFT JOIN (SELECT lang, count(*) AS v FROM k GROUP BY 1) z ON x.lang = z.lang
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 5)::HUGEINT) // (n + 5 * v)::HUGEINT AS p
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term
), q AS (
  SELECT lang, term, 1 + (1000000000 * (sum(c) + 5)::HUGEINT) // (sum(sum(c)) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang))::HUGEINT AS q FROM t GROUP BY lang, term
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, p - q FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE c > 0 AND p > q
), o AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r
)
SELECT * FROM o WHERE part = 'pair' OR rank <= 50
"""
