"""Repeated passages by seed and extend: winnowed anchors, joined and extended to maximal repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, materialize

#: Words of the shortest repeat, and of an anchor.
LENGTH, ANCHOR = 13, 5
#: Bytes that are hashed at once; a longer word is taken whole.
CHUNK = 1 << 20
#: Any odd numbers: the base of the byte hashes and the factors of the word windows.
BASE, LEFT, RIGHT = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


@cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(LEFT)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(RIGHT)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, the runs of bytes that are no ASCII white space."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data) and not SPACE[data[end]]:
            end += 1
        b = np.frombuffer(data, np.uint8, end - at, at)
        inside = np.concatenate(([False], ~SPACE[b], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        size = max(CHUNK, 1 << int(len(b)).bit_length())
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers(BASE, size)[: len(b)], dtype=np.uint64)))
        out.append(_mix((total[ends] - total[starts]) * _powers(pow(BASE, -1, 1 << 64), size)[starts]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def spans(words: np.ndarray, width: int, factor: int) -> np.ndarray:
    """A hash of each `width` consecutive words."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    f, out = np.uint64(factor), words[: len(words) - width + 1].copy()
    for k in range(1, width):
        out = out * f + words[k : len(words) - width + 1 + k]
    return _mix(out)


def anchors(words: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, n): the winnowed anchors, and the windows of `length` words that chose each.

    A window chooses the least hash among its runs of `anchor` words, the
    leftmost of equals: equal windows, wherever they are, choose the same run
    at the same place, so no repeat of `length` words lacks a shared anchor.
    """
    grams, per = spans(words, anchor, LEFT), length - anchor + 1
    n = len(words) - length + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = grams[:n].copy()
    for k in range(1, per):
        np.minimum(least, grams[k : n + k], out=least)
    place = np.zeros(n, np.int64)
    for k in range(per - 1, -1, -1):
        place[grams[k : n + k] == least] = k
    place += np.arange(n)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return least[first], first, np.diff(np.append(first, n))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def find_anchors(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, marks = b.column("doc_id").to_numpy(), b.column("mark").to_numpy()
            parts: list[list[np.ndarray]] = [[], [], [], [], []]
            rows = 0
            for i, text in enumerate(b.column("text")):
                found = anchors(word_hashes(_bytes(text.as_py())), length, anchor)
                n = len(found[0])
                for p, x in zip(parts, (found[0].view(np.int64), np.full(n, ids[i]), np.full(n, marks[i]), found[1].astype(np.int32), found[2].astype(np.int32)), strict=True):
                    p.append(x)
                rows += n
                if rows > 200_000:
                    yield pa.record_batch([pa.array(np.concatenate(p)) for p in parts], names)
                    parts, rows = [[], [], [], [], []], 0
            if rows:
                yield pa.record_batch([pa.array(np.concatenate(p)) for p in parts], names)

    names = ["anchor", "doc_id", "mark", "first", "n"]
    return docs.mapInArrow(run, "anchor long, doc_id long, mark long, first int, n int")


def extend(shared: DataFrame, length: int) -> DataFrame:
    """Both ways from each shared anchor: the hashes of the windows of `length` words that chose it.

    Overlapping windows together make up the maximal repeats; each is named by
    96 bits of its words, 64 and 32 from word hashes that have nothing in
    common.  later: an earlier document holds the anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, marks = b.column("doc_id").to_numpy(), b.column("mark").to_numpy()
            first, n, later = b.column("first"), b.column("n"), b.column("later")
            for i, text in enumerate(b.column("text")):
                data = _bytes(text.as_py())
                words, others = word_hashes(data), np.frombuffer(b"".join(map(xxhash.xxh64_digest, data.split())), np.uint64)
                lo, count = np.asarray(first[i].values.to_numpy()), np.asarray(n[i].values.to_numpy())
                at, once = np.unique(np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum()), return_index=True)
                behind = np.repeat(later[i].values.to_numpy(zero_copy_only=False), count)[once]
                one, two = spans(words, length, LEFT)[at], spans(others, length, RIGHT)[at]
                for k in range(0, len(at), 200_000):
                    s = slice(k, k + 200_000)
                    m = len(at[s])
                    yield pa.record_batch(
                        [pa.array(one[s].view(np.int64)), pa.array((two[s] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(np.full(m, ids[i])), pa.array(np.full(m, marks[i])), pa.array(at[s].astype(np.int32)), pa.array(behind[s])],
                        ["w", "c", "doc_id", "mark", "at", "later"],
                    )

    return shared.mapInArrow(run, "w long, c int, doc_id long, mark long, at int, later boolean")


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, mark, at): for each document the windows of `length` words that also start in one with a smaller doc_id.

    mark tells apart texts that share a doc_id.  Documents meet on anchors that
    two or more of them hold; the windows around those are then compared among
    all documents.  Both times a key's smallest and largest doc_id are gathered
    by partial aggregation, so that a passage in a third of all documents makes
    no pairs and no large group.
    """
    spark = docs.sparkSession
    found = materialize(find_anchors(docs, length, anchor))
    keys = found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor", "a")
    keys = materialize(keys)
    places = found.join(keys, "anchor").groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct("first", "n", (F.col("a") < F.col("doc_id")).alias("later")))).alias("p"))
    places = materialize(places.select("doc_id", "mark", *(F.col(f"p.{c}").alias(c) for c in ("first", "n", "later"))))
    discard(spark, found)
    discard(spark, keys)
    windows = materialize(extend(docs.join(places, ["doc_id", "mark"]).select("doc_id", "mark", "text", "first", "n", "later"), length))
    discard(spark, places)
    least = windows.groupBy("w", "c").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("w", "c", "a")
    least = materialize(least)
    again = windows.where("later").join(least, ["w", "c"]).where("a < doc_id").groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("at")).alias("at"))
    again = materialize(again)
    discard(spark, windows)
    discard(spark, least)
    return again


def covered(n: int, at: np.ndarray, length: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of the places."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256 [, kept, removed]) of every document.

    Words are runs of characters other than ASCII white space, unchanged.
    Removed is each word in a window of `length` words whose words also stand,
    in order, in a document with a smaller doc_id; windows are judged on the
    input.  keep_text adds the kept words joined by spaces and the removed
    maximal repeats as [first word, one after the last].  A null text has no
    words; a document without words has the digest of the empty text; rows with
    equal doc_id take nothing from each other, those with a null doc_id neither
    give nor lose words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text, at in zip(b.column("text"), b.column("at"), strict=True):
                words = _bytes(text.as_py()).split()
                gone = covered(len(words), np.asarray(at.values.to_numpy()), length) if at.is_valid else np.zeros(len(words), bool)
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if at.is_valid else b" ".join(words)
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                for column, x in zip(out, (len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if keep_text else None, edges.reshape(-1, 2).tolist()), strict=True):
                    column.append(x)
            columns = [b.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            yield pa.record_batch([*columns, *([pa.array(out[3], pa.string()), pa.array(out[4], pa.list_(pa.list_(pa.int32())))] if keep_text else [])], names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept", "removed"] if keep_text else [])]
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string, removed array<array<int>>" if keep_text else "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    again = repeats(rows.where("doc_id IS NOT NULL"), length, anchor)
    return rows.join(again, ["doc_id", "mark"], "left").select("doc_id", "text", "at").mapInArrow(run, schema)
