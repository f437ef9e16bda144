"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import materialize

#: Tokens of the shortest tile, and so of a seed.
SEED = 5
#: Share of a benchmark item's tokens that tiles must cover.
COVERED = 0.5
#: A benchmark of at most so many bytes is broadcast; a larger one is joined by shuffled seeds.
BROADCAST_BYTES = 32 << 20
WORD = re.compile(r"[^\W_]+")
#: The base of the Karp-Rabin hashes, any odd number, and its inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return WORD.findall((text or "").lower())


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of the windows of a width."""
    if len(ids) < width:
        return np.empty(0, np.uint64)
    p = powers(len(ids))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ids.astype(np.uint64) * p, dtype=np.uint64)))
    return (total[width:] - total[:-width]) * powers(len(ids) - width + 1, UNBASE)


def tiles(item: list[int], doc: list[int], least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling by running Karp-Rabin: (item position, document position, length).

    Search lengths fall from the item's length by halves to `least`.  At each,
    unmarked windows of the document are looked up among the item's by hash;
    hits are compared token by token and extended as far as both are unmarked.
    Of what is found, the longest that still lies in unmarked text is marked
    first.  Where an extension exceeds the search length, the search is redone
    at the length found, so that no longer match is marked after a shorter one.
    """
    a, b = np.asarray(item, np.int64), np.asarray(doc, np.int64)
    used_a, used_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    out: list[tuple[int, int, int]] = []
    length = max(least, len(a))
    while True:
        found, longest = [], 0
        if len(a) >= length and len(b) >= length:
            free_a = np.flatnonzero(_free(used_a, length))
            free_b = np.flatnonzero(_free(used_b, length))
            ha, hb = rolling(a, length)[free_a], rolling(b, length)[free_b]
            at = defaultdict(list)
            for p, h in zip(free_a.tolist(), ha.tolist(), strict=True):
                at[h].append(p)
            for q, h in zip(free_b[np.isin(hb, ha)].tolist(), hb[np.isin(hb, ha)].tolist(), strict=True):
                for p in at[h]:
                    if (a[p : p + length] == b[q : q + length]).all():
                        n = length
                        while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n] and not used_a[p + n] and not used_b[q + n]:
                            n += 1
                        found.append((n, p, q))
                        longest = max(longest, n)
        if longest > 2 * length:
            length = longest
            continue
        for n, p, q in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if not used_a[p : p + n].any() and not used_b[q : q + n].any():
                used_a[p : p + n] = used_b[q : q + n] = True
                out.append((p, q, n))
            elif n > length:  # what another tile has left of it
                while n > length and (used_a[p + n - 1] or used_b[q + n - 1]):
                    n -= 1
                if not used_a[p : p + n].any() and not used_b[q : q + n].any():
                    used_a[p : p + n] = used_b[q : q + n] = True
                    out.append((p, q, n))
        if length == least:
            return out
        length = max(least, length // 2)


def _free(used: np.ndarray, length: int) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(used)))
    return total[length:] == total[:-length]


def least_seeds(tokens_of_item: int, covered: float, seed: int) -> int:
    """How many seed positions of an item tiles that cover enough of it hold at least: L - seed + 1 in one of L tokens."""
    return max(1, math.ceil(covered * tokens_of_item / seed - 1e-9))


def rarest(frequency: list[tuple[int, int, int]], spare: int) -> list[int]:
    """Seeds, of (seed, positions, frequency), less the most frequent ones that together have at most `spare` positions."""
    out, left = [], spare
    for h, positions, n in sorted(frequency, key=lambda x: (-x[2], x[0])):
        if n > 1 and positions <= left:
            left -= positions
        else:
            out.append(h)
    return out


class Benchmark:
    """Items as token ids, and the items of each seed.

    What covers enough of an item shares a certain number of its seed
    positions, so each item is posted without as many of its most frequent
    ones as may be missed: a frequent seed is not asked for all items with it.
    """

    def __init__(self, items: list[tuple[int, str]], seed: int, covered: float) -> None:
        self.seed, self.covered = seed, covered
        self.ids: dict[str, int] = {}
        self.items = {r: [self.ids.setdefault(w, len(self.ids) + 1) for w in tokens(t)] for r, (_, t) in enumerate(items)}
        self.names = [i for i, _ in items]  # an id may name several texts
        self.seeds = {i: rolling(np.asarray(x), min(seed, len(x))) for i, x in self.items.items() if x}
        n = Counter(h for x in self.seeds.values() for h in set(x.tolist()))
        self.of: dict[int, list[int]] = defaultdict(list)
        for i, x in self.seeds.items():
            own = [(h, m, n[h]) for h, m in Counter(x.tolist()).items()]
            for h in rarest(own, least_seeds(len(self.items[i]), covered, seed) - 1):
                self.of[h].append(i)
        self.short = sorted({len(x) for x in self.items.values() if 0 < len(x) < seed})
        self.known = np.array(sorted(n), np.uint64)

    def candidates(self, doc: np.ndarray) -> list[int]:
        """Items that may be covered: those of whose tokens enough lie in windows that the document holds as well."""
        found = []
        for width in [self.seed, *self.short]:
            if len(doc) >= width and len(self.known):
                whole = np.flatnonzero(_free(doc == 0, width))
                if len(whole):
                    h = np.unique(_at(doc, whole, width))
                    spot = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
                    found.append(h[self.known[spot] == h])
        if not found:
            return []
        held = np.unique(np.concatenate(found))
        some = {i for h in held.tolist() for i in self.of.get(h, ())}
        return [i for i in sorted(some) if within(self.seeds[i], held, len(self.items[i]), self.seed) >= self.covered]


def within(seeds: np.ndarray, held: np.ndarray, n: int, seed: int) -> float:
    """Share of an item's n tokens in windows whose hashes are held: no tiling covers more."""
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(np.isin(seeds, held))
    edge[at] += 1
    np.add.at(edge, at + min(seed, n), -1)
    return np.count_nonzero(np.cumsum(edge[:-1])) / n


def _at(doc: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The rolling hashes of a few positions."""
    out, p = np.zeros(len(starts), np.uint64), powers(width)
    for k in range(width):
        out += doc[starts + k].astype(np.uint64) * p[k]
    return out


def coverage(item: list[int], doc: list[int], least: int = SEED) -> tuple[float, int, int]:
    """Share of the item's tokens in tiles, the number of tiles, and of the longest tile's tokens."""
    least = max(1, min(least, len(item)))
    found = tiles(item, doc, least)
    return (sum(n for _, _, n in found) / len(item) if item else 0.0), len(found), max((n for _, _, n in found), default=0)


COLUMNS = "doc_id long, item_id long, coverage double, n_tiles int, longest int"
NAMES = ["doc_id", "item_id", "coverage", "n_tiles", "longest"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
    return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], NAMES)


def matches(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED, seed: int = SEED, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest) of pairs whose tiles cover enough of the item.

    Only pairs that share a seed of `seed` consecutive tokens are tiled; a
    shorter item is its own seed.  Tiles count wherever they stand, so a
    passage with its sentences reordered is covered as well.  Null or empty
    texts match nothing; repeated rows match each; rows with a null id on
    either side are left out; empty tables give an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item")).where("item_id IS NOT NULL AND item IS NOT NULL")
    if (items.agg(F.sum(F.octet_length("item"))).head()[0] or 0) > broadcast_bytes:
        return _by_shuffle(docs, items, covered, seed)
    held = spark.sparkContext.broadcast([tuple(r) for r in items.distinct().collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(held.value, seed, covered)
        find = bench.ids.get
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = tokens(text.as_py())
                doc = np.fromiter((find(w, 0) for w in words), np.int64, len(words))
                for i in bench.candidates(doc):
                    share, n, longest = coverage(bench.items[i], doc.tolist(), seed)
                    if share >= covered:
                        rows.append((doc_id, bench.names[i], share, n, longest))
            if rows:
                yield _batch(rows)

    return docs.mapInArrow(run, COLUMNS)


def _by_shuffle(docs: DataFrame, items: DataFrame, covered: float, seed: int) -> DataFrame:
    """The same for a benchmark too large to broadcast: seeds of both sides meet in a shuffle.

    Of each item as many of the seeds that most documents hold are left out as
    may be missed.  A document's text goes to its candidates once, or once for
    each of a few parts of them.
    """

    def widths_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {n for t in b.column(0) if 0 < (n := len(tokens(t.as_py()))) < seed}
            yield pa.record_batch([pa.array(sorted(found), pa.int32())], ["width"])

    def seeds_of(short: list[int] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, hashes, positions, spare = [], [], [], []
                for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    words = tokens(text.as_py())
                    widths = [min(seed, len(words))] if short is None else [*short, seed]
                    found = Counter(xxhash.xxh64_intdigest("\x1f".join(words[k : k + w])) - (1 << 63) for w in widths if w for k in range(len(words) - w + 1))
                    ids += [i] * len(found)
                    hashes += found
                    positions += found.values()
                    spare += [least_seeds(len(words), covered, seed) - 1] * len(found)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(positions, pa.int32()), pa.array(spare, pa.int32())], ["id", "seed", "positions", "spare"])

        return run

    kinds = "id long, seed long, positions int, spare int"
    items = items.distinct().withColumn("row", F.xxhash64("item_id", "item"))
    short = sorted(r.width for r in items.select("item").mapInArrow(widths_of, "width int").distinct().collect())  # fewer than `seed`
    b = materialize(items.select("row", "item").mapInArrow(seeds_of(None), kinds).withColumnRenamed("id", "row"))
    a = docs.mapInArrow(seeds_of(short), kinds).select(F.col("id").alias("doc_id"), "seed").join(b.select("seed").distinct(), "seed", "left_semi")
    a = materialize(a.distinct())
    often = b.join(a.groupBy("seed").agg(F.count("*").alias("n")), "seed")
    upto = Window.partitionBy("row").orderBy(F.desc("n"), "seed").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = materialize(often.withColumn("sum", F.sum("positions").over(upto)).where("sum > spare").select("row", "seed"))
    pairs = a.join(kept, "seed").select("doc_id", "row").distinct().join(items, "row")
    grouped = materialize(pairs.groupBy("doc_id", F.pmod(F.xxhash64("row"), F.lit(8)).alias("part")).agg(F.collect_list(F.struct("item_id", "item")).alias("items")))
    joined = grouped.join(docs, "doc_id").select("doc_id", "text", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in range(b.num_rows):
                words = tokens(b.column(1)[r].as_py())
                for x in b.column(2)[r].as_py():
                    ids: dict[str, int] = {}
                    item = [ids.setdefault(w, len(ids) + 1) for w in tokens(x["item"])]
                    share, n, longest = coverage(item, [ids.get(w, 0) for w in words], seed)
                    if share >= covered:
                        rows.append((b.column(0)[r].as_py(), x["item_id"], share, n, longest))
            if rows:
                yield _batch(rows)

    return joined.mapInArrow(run, COLUMNS)
