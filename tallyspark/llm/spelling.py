"""Spelling variants: words one edit apart, found by each word's automaton in broadcast shards of a trie."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, materialize
from tallyspark.llm.runs import counted, pieces, words

#: One run in so many, by the checksum of its document and itself, loses a code point.
EVERY = 97
#: Code points of the words of a shard (one longer word is a shard of its own), and bytes of the shards that are broadcast at once.
SHARD, BROADCAST = 1 << 20, 32 << 20

_KEPT = np.full(256, 32, np.uint8)
_KEPT[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = list(b"abcdefghijklmnopqrstuvwxyz" * 2)


def _spaced(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, a-z and U+00C0 to U+00FF, which in UTF-8 are C3 and one byte more; all else a space."""
    out = _KEPT[data]
    lead = np.flatnonzero(data == 0xC3)
    out[lead], out[lead + 1] = 0xC3, data[lead + 1]
    return out


def _checksums(prefixes: list[bytes], row: np.ndarray, code: np.ndarray, found: list[bytes]) -> np.ndarray:
    """crc32 of each row's prefix followed by its word, by the linearity of the checksum in what came before.

    Followed by n bytes, a checksum c is changed to shift_n(c) ^ crc32(bytes),
    and shift_n is linear: a table of 256 for each of the four bytes of c.
    """
    before = np.array([zlib.crc32(p) for p in prefixes], np.int64)[row]
    own = np.array([zlib.crc32(w) for w in found], np.int64)[code]
    size = np.array([len(w) for w in found], np.int64)[code]
    out = np.zeros(len(row), np.int64)
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(size[order]) != 0, True]) if len(order) else np.zeros(1, int)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        at = order[a:b]
        nothing = bytes(int(size[at[0]]))
        zero = zlib.crc32(nothing)
        c, moved = before[at], np.zeros(len(at), np.int64)
        for byte in range(4):
            one = np.array([zlib.crc32(nothing, v << 8 * byte) ^ zero for v in range(256)], np.int64) if len(at) > 64 else None
            part = (c >> 8 * byte) & 255
            moved ^= one[part] if one is not None else np.array([zlib.crc32(nothing, int(v) << 8 * byte) ^ zero for v in part], np.int64)
        out[at] = moved ^ own[at]
    return out


def word_counts(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """(word, n): how often each word of at least one code point occurs, after the deletions, a row a word and piece of the input."""
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b, 1)):
            prefixes = [f"{x or ''}:".encode() for x in batch.column(0).to_pylist()]
            row, code, found = words(batch.column(1), _spaced)
            (row, code), n = counted(row, code)
            names = found.cast(pa.large_binary()).to_pylist()
            h = _checksums(prefixes, row, code, names)
            hit = h % every == 0
            total = np.zeros(len(names), np.int64)
            np.add.at(total, code[~hit], n[~hit])
            some = np.flatnonzero(total)
            yield pa.record_batch([found.take(pa.array(some)).cast(pa.string()), pa.array(total[some])], ["word", "n"])
            if hit.any():
                cut = [names[c].decode() for c in code[hit]]
                cut = [w[: (k := int(x) % len(w))] + w[k + 1 :] for w, x in zip(cut, h[hit], strict=True)]
                yield pa.record_batch([pa.array(cut, pa.string()), pa.array(n[hit])], ["word", "n"])

    return docs.mapInArrow(run, "word string, n long")


class Trie:
    """A trie in three flat arrays, nodes by depth: a node's children stand side by side, and are found by their label.

    labels: the code point, all below 256, that leads to each node; first:
    where each node's children begin; counts: the n of the word that ends at
    a node, or 0.
    """

    def __init__(self, labels: bytes, first: bytes, counts: bytes) -> None:
        self.labels, self.first, self.counts = labels, array("I"), array("q")
        self.first.frombytes(first)
        self.counts.frombytes(counts)

    @staticmethod
    def packed(found: list[bytes], n: list[int]) -> tuple[bytes, bytes, bytes]:
        """The arrays of the sorted, distinct words `found`; a level's new nodes are the words that depart from the one before."""
        size = np.array([len(w) for w in found], np.int64)
        text = np.frombuffer(b"".join(found), np.uint8)
        at = np.r_[0, np.cumsum(size)[:-1]]
        shared = np.zeros(len(found), np.int64)
        shared[1:] = [_shared(a, b) for a, b in zip(found[:-1], found[1:], strict=True)]
        labels, parents, counts = [np.zeros(1, np.uint8)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        alive, node, base, depth = np.arange(len(found)), np.zeros(len(found), np.int64), 1, 0
        n = np.asarray(n, np.int64)
        while len(alive):
            ends = size[alive] == depth
            counts[-1][node[alive[ends]] - (base - len(labels[-1]))] = n[alive[ends]]
            alive = alive[~ends]
            if not len(alive):
                break
            # Two words that go on share what all from the one to the other share.
            least = np.minimum.reduceat(shared[: alive[-1] + 1], np.r_[0, alive[:-1] + 1])
            new = least <= depth
            new[0] = True
            first = alive[new]
            labels.append(text[at[first] + depth])
            parents.append(node[first])
            counts.append(np.zeros(len(first), np.int64))
            node[alive] = base + np.cumsum(new) - 1
            base += len(first)
            depth += 1
        parent = np.concatenate(parents)
        first = np.searchsorted(parent, np.arange(base + 1)) + 1
        return np.concatenate(labels).tobytes(), first.astype(np.uint32).tobytes(), np.concatenate(counts).tobytes()

    def near(self, word: bytes) -> Iterator[tuple[int, bytes]]:
        """(n, neighbour) of each word of the trie that differs by exactly one insertion, deletion or replacement.

        The automaton of distance one goes down the word's own path with no
        edit used; at each node it takes every edit in turn and follows what
        is left of the word without another.  Of the places that give the same
        word, as beside equal letters, the last is taken, so none comes twice.
        """
        labels, first, counts = self.labels, self.first, self.counts
        node, size = 0, len(word)
        for i in range(size + 1):
            a, b = first[node], first[node + 1]
            own = word[i] if i < size else -1
            for child in range(a, b):
                c = labels[child]
                if c != own:
                    if i < size and (n := self._rest(child, word, i + 1)):
                        yield n, word[:i] + labels[child : child + 1] + word[i + 1 :]
                    if n := self._rest(child, word, i):
                        yield n, word[:i] + labels[child : child + 1] + word[i:]
            if i == size:
                return
            if (i + 1 == size or word[i + 1] != own) and (n := self._rest(node, word, i + 1)):
                yield n, word[:i] + word[i + 1 :]
            node = labels.find(own, a, b)
            if node < 0:
                return

    def _rest(self, node: int, word: bytes, i: int) -> int:
        labels, first = self.labels, self.first
        for k in range(i, len(word)):
            node = labels.find(word[k], first[node], first[node + 1])
            if node < 0:
                return 0
        return self.counts[node]


def _shared(a: bytes, b: bytes) -> int:
    """How many bytes two words begin with alike."""
    if b.startswith(a):
        return len(a)
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def trie_shards(counts: DataFrame, shard: int = SHARD) -> DataFrame:
    """(labels, first, counts, bytes): tries of at most `shard` code points of words each, built where neighbouring words meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[bytes] = []
        n: list[int] = []
        size = 0

        def packed() -> pa.RecordBatch:
            t = Trie.packed(found, n)
            return pa.record_batch([*(pa.array([x], pa.binary()) for x in t), pa.array([sum(map(len, t))], pa.int64())], ["labels", "first", "counts", "bytes"])

        for batch in batches:
            for word, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if found and size + len(word) > shard:
                    yield packed()
                    found.clear()
                    n.clear()
                    size = 0
                found.append(word.encode("latin-1"))
                n.append(k)
                size += len(word)
        if found:
            yield packed()

    size = counts.agg(F.sum(F.length("word"))).head()[0] or 0
    parts = max(1, -(-size // shard))
    # Latin-1 bytes, code points and UTF-8 bytes of such words have one order.
    return counts.repartitionByRange(parts, "word").sortWithinPartitions("word").mapInArrow(run, "labels binary, first binary, counts binary, bytes long")


def neighbours(counts: DataFrame, shard: int = SHARD, at_once: int = BROADCAST) -> DataFrame:
    """(word, n_near, best_n, best): for each word with near words their number, and the one of largest n, the smallest of equals.

    counts: (word, n), written.  Shards are built on the executors and go
    out in rounds of at most at_once bytes, or of one shard: so what is held
    at a time is bounded however many words there are.  In each round every
    word goes through each shard depth first and gives one row.
    """
    spark = counts.sparkSession
    shards = materialize(trie_shards(counts, shard).withColumn("id", F.monotonically_increasing_id()))
    rounds, size = [[]], 0
    for x in shards.select("id", "bytes").orderBy("id").toLocalIterator():
        if rounds[-1] and size + x["bytes"] > at_once:
            rounds.append([])
            size = 0
        rounds[-1].append(x["id"])
        size += x["bytes"]
    out = []
    for ids in rounds:
        if ids:
            sent = spark.sparkContext.broadcast([tuple(map(bytes, x[:3])) for x in shards.where(F.col("id").between(ids[0], ids[-1])).select("labels", "first", "counts").collect()])
            out.append(materialize(counts.select("word").repartition(_tasks(spark.sparkContext, counts)).mapInArrow(_intersect(sent), "word string, n_near long, best_n long, best string")))
            sent.destroy()
    discard(spark, shards)
    if not out:
        return counts.select("word", F.col("n").alias("n_near"), F.col("n").alias("best_n"), F.col("word").alias("best")).limit(0)
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def _tasks(context: SparkContext, counts: DataFrame) -> int:
    """Parts of about 8,192 words, as a word may take a tenth of a millisecond a shard."""
    return max(context.defaultParallelism, -(-counts.count() // 8192))


def _intersect(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = None
        for batch in batches:
            tries = tries or [Trie(*x) for x in sent.value]
            out: list[tuple[str, int, int, str]] = []
            for word in batch.column(0).to_pylist():
                raw, number, best = word.encode("latin-1"), 0, (0, b"")
                for trie in tries:
                    for n, other in trie.near(raw):
                        number += 1
                        best = min(best, (-n, other))
                if number:
                    out.append((word, number, -best[0], best[1].decode("latin-1")))
            yield pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True) if out else [()] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "best_n", "best"])

    return run


def variants(docs: DataFrame, least: int = 3, length: int = 5, every: int = EVERY, shard: int = SHARD, at_once: int = BROADCAST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of enough code points and occurrences.

    form is the near word of largest n if that is at least twice the word's
    own, and root where forms lead in the end; as n at least doubles with each
    step, chains are short, and doubling their links takes few rounds.  A null
    text has no words, a null doc_id reads as empty; repeated rows count each;
    no words give an empty result.
    """
    counts = materialize(word_counts(docs, every).groupBy("word").agg(F.sum("n").alias("n")).where((F.length("word") >= length) & (F.col("n") >= least)))
    near = neighbours(counts, shard, at_once)
    told = counts.join(near, "word", "left")
    best = F.col("best_n") >= 2 * F.col("n")
    told = materialize(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(best, F.col("best")).alias("form"), F.when(best, F.col("best_n")).alias("form_n")))
    links = materialize(told.where("form IS NOT NULL").select("word", "form"))
    while True:
        further = links.select(F.col("word").alias("form"), F.col("form").alias("next"))
        moved = materialize(links.join(further, "form", "left").select("word", F.coalesce("next", "form").alias("form"), F.col("next").isNotNull().alias("moved")))
        discard(docs.sparkSession, links)
        links = moved.select("word", "form")
        if not moved.where("moved").limit(1).count():
            break
    roots = links.select("word", F.col("form").alias("root"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
