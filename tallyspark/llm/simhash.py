"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

near_duplicates() links fingerprints of 64 bits within a radius.  similar_documents() links texts by the Jaccard
similarity of their shingles: sketches of 192 bits find candidates by the same covering masks, exact sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import components, discard, each_group, each_run, in_blocks, materialize, roots

BITS = 64
#: Shingles whose bits are counted at once: bounds memory for a very long text.
STEP = 65_536
#: Fingerprints of a bucket that meet in one task are at most twice this.
BLOCK = 512
#: Words of a shingle.  Two texts are similar from a Jaccard similarity of NUMER / DENOM on.
WIDTH, NUMER, DENOM = 5, 4, 5
#: A sketch: LONGS longs of two blocks of 32 bits.  Each block has the masks of radius REACH, so that sketches which
#: differ in at most 6 * (REACH + 1) - 1 = 23 bits share a table for certain, and at similarity 0.8 (29 bits on average)
#: 0.985 of all pairs do.
LONGS, REACH = 3, 3
#: Sketches of candidates differ in at most so many bits: at similarity 0.8 that is 3.8 standard deviations off.
FAR = 48
#: Texts whose shingles are compared in one task are about twice this at most.
TILE = 256


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The SimHash of a text as an unsigned 64-bit number; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < width:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = list(zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True))
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_digest
    for at in range(0, len(spans), STEP):
        bits = np.frombuffer(b"".join([digest(line[a:b], seed) for a, b in spans[at : at + STEP]]), np.uint8)
        ones += np.unpackbits(bits.reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(spans)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long.  A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2**(radius+1)-1 masks; any set of at most radius bits lies outside one of them.

    Bit i gets a vector of radius+1 binary digits, never zero, in turn.  Mask v
    keeps the bits whose vector has an odd product with v.  The vectors of
    radius bits cannot span the space, so some v has an even product with all.
    """
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    return [sum(1 << i for i, b in enumerate(vectors) if (b & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(classes: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b): links between representatives (rep, fp) within the radius, as local spanning stars.

    Each distinct fingerprint is posted under its masked value in every table.
    Buckets with one posting go; the rest are compared in bounded block pairs,
    and of the links that a block pair finds only a star for each of its
    components is returned.  Joined over all buckets they connect exactly the
    fingerprints that links within the radius connect.
    """
    masks = [F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(covering_masks(radius))]
    postings = classes.select("rep", "fp", F.explode(F.array(*masks)).alias("bucket"))
    sizes = materialize(postings.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    dealt = in_blocks(postings, "bucket", "fp", sizes, block)
    keys = ["bucket", "lo", "hi"]

    def links(group: pa.Table) -> pa.RecordBatch | None:
        fp, rep, own = (group.column(c).to_numpy() for c in ("fp", "rep", "_own"))
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        left = np.flatnonzero(own == lo)
        right = left if lo == hi else np.flatnonzero(own == hi)
        near = np.bitwise_count((fp[left][:, None] ^ fp[right][None, :]).view(np.uint64)) <= radius
        i, j = np.nonzero(near)
        if lo == hi:
            i, j = i[i < j], j[i < j]
        if not len(i):
            return None
        root = roots(len(fp), left[i], right[j])
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return pa.record_batch([pa.array(rep[moved]), pa.array(rep[root[moved]])], ["a", "b"])

    dealt = dealt.select(*keys, "_own", "rep", "fp").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(lambda it: each_group(it, keys, links), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each document.

    Equal fingerprints are one class, however many documents hold it, so copies
    never meet each other in a task.  component_id is the smallest doc_id that
    links of radius or fewer differing bits reach, the document's own included.
    Null and empty texts have fingerprint zero and link like any other.
    Repeated rows each get their row; a null doc_id is kept and names no
    component.  An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, width))
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL"))
    found = components(near_links(classes, radius)).withColumnRenamed("node", "rep")
    named = classes.join(found, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def line_of(text: str | None) -> bytes:
    """Lower-cased words joined by one space: texts that share it are equal."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def shingles(line: bytes, width: int = WIDTH) -> set[bytes]:
    """Runs of `width` words; of fewer words, or none, the whole line."""
    words = line.split()
    if len(words) < width:
        return {line}
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return {line[a:b] for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)}


def sketch(found: set[bytes]) -> np.ndarray:
    """The SimHash of distinct shingles as LONGS longs: a bit is 1 if set in over half the hashes."""
    bits = np.frombuffer(b"".join([xxhash.xxh3_128_digest(s) + xxhash.xxh64_digest(s, 42) for s in found]), np.uint8).reshape(-1, 8 * LONGS)
    ones = np.zeros(LONGS * BITS, np.int64)
    for at in range(0, len(bits), 255):  # as many as one byte counts
        ones += np.unpackbits(bits[at : at + 255], axis=1).sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(bits)).view(np.int64)


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, key, s0, s1, s2): key names the text's words.  A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, found = np.empty(b.num_rows, np.int64), np.empty((b.num_rows, LONGS), np.int64)
            for r, t in enumerate(b.column(1)):
                line = line_of(t.as_py())
                keys[r], found[r] = _key(line), sketch(shingles(line, width))
            yield pa.record_batch([b.column(0), pa.array(keys), *(pa.array(found[:, k].copy()) for k in range(LONGS))], ["doc_id", "key", *_SKETCH])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id long, key long, {', '.join(f'{s} long' for s in _SKETCH)}")


_SKETCH = [f"s{k}" for k in range(LONGS)]


def _key(line: bytes) -> int:
    return xxhash.xxh64_intdigest(line, 7) - (1 << 63)


def block_masks() -> list[int]:
    return covering_masks(REACH, BITS // 2)


def postings(classes: DataFrame, longs: int = LONGS) -> DataFrame:
    """classes with `bucket` for each table of the first longs: the table's number above 32 bits of masked sketch."""
    masks = block_masks()
    m = len(masks)
    t = F.col("_t")
    value = F.element_at(F.array(*_SKETCH), (t / (2 * m)).cast("int") + 1)
    value = F.when(F.pmod(t, F.lit(2 * m)) < m, value).otherwise(F.shiftrightunsigned(value, 32))
    mask = F.element_at(F.array(*(F.lit(x).cast("long") for x in masks)), F.pmod(t, F.lit(m)) + 1)
    out = classes.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(2 * m * longs - 1))))
    return out.withColumn("bucket", F.shiftleft(t.cast("long"), 32).bitwiseOR(value.bitwiseAND(mask))).drop("_t")


def _longs(b: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([b.column(s).to_numpy() for s in _SKETCH])


def _apart(s: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits the sketches of rows i and j differ."""
    return np.bitwise_count((s[:, i] ^ s[:, j]).view(np.uint64)).sum(0, dtype=np.int16)


def _stars(dealt: DataFrame) -> DataFrame:
    """(a, b, far): of each run of equal (bucket, salt), sorted by key, the first member with each candidate among the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first member of the run that goes on
        for b in batches:
            ids = np.stack([b.column(c).to_numpy() for c in ("bucket", "salt", "key")])
            s = _longs(b)
            if held is not None:
                ids, s = np.hstack((held[0], ids)), np.hstack((held[1], s))
            if not ids.shape[1]:
                continue
            start = np.concatenate(([True], (ids[:2, 1:] != ids[:2, :-1]).any(0)))
            lead = np.maximum.accumulate(np.where(start, np.arange(len(start)), 0))
            held = ids[:, lead[-1] :][:, :1], s[:, lead[-1] :][:, :1]
            rest = np.flatnonzero(~start)
            far = _apart(s, lead[rest], rest)
            rest, far = rest[far <= FAR], far[far <= FAR]
            yield pa.record_batch([pa.array(ids[2][lead[rest]]), pa.array(ids[2][rest]), pa.array(far.astype(np.int32))], ["a", "b", "far"])

    dealt = dealt.select("bucket", F.col("salt").cast("long").alias("salt"), "key", *_SKETCH).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "key")
    return dealt.mapInArrow(run, "a long, b long, far int").where("a <> b")


_TILE = ["bucket", "lo", "hi"]
_MEMBER = [*_TILE, "_own", "key", "part", *_SKETCH]


def _crossing(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) that are candidates of different parts in one (bucket, lo, hi), of rows sorted by these.

    A pair that meets in several tables counts in the first of them.
    """
    ids = np.stack([t.column(c).to_numpy() for c in _TILE])
    own, part, s = t.column("_own").to_numpy(), t.column("part").to_numpy(), _longs(t)
    group = np.cumsum(np.concatenate(([0], (ids[:, 1:] != ids[:, :-1]).any(0))))
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    i, step = np.arange(len(part)), 1
    while len(i := i[i + step < len(part)]) and len(i := i[group[i + step] == group[i]]):
        j = i + step
        some = np.flatnonzero((part[i] != part[j]) & ((ids[1][i] == ids[2][i]) | (own[i] != own[j])))
        some = some[_apart(s, i[some], j[some]) <= FAR]
        found_i.append(i[some])
        found_j.append(j[some])
        step += 1
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    first = np.zeros(len(i), bool)
    for at in range(0, len(i), 4096):
        k = slice(at, at + 4096)
        first[k] = _first_table(s[:, i[k]] ^ s[:, j[k]]) == ids[0][i[k]] >> 32
    return i[first], j[first]


def _first_table(differ: np.ndarray) -> np.ndarray:
    """The first table in which sketches with these differing bits share a bucket."""
    masks = np.array(block_masks(), np.int64)
    free = [differ[k][:, None] & half[None, :] == 0 for k in range(LONGS) for half in (masks, masks << 32)]
    return np.hstack(free).argmax(1)


def _crossing_members(dealt: DataFrame) -> DataFrame:
    """The rows of dealt that are in a pair of _crossing(): what must be looked at, without its pairs."""

    def run(t: pa.Table) -> pa.RecordBatch | None:
        i, j = _crossing(t)
        return t.take(pa.array(np.unique(np.concatenate((i, j))))).combine_chunks().to_batches()[0] if len(i) else None

    dealt = dealt.select(*_MEMBER).repartition(*_TILE).sortWithinPartitions(*_TILE)
    return dealt.mapInArrow(lambda it: each_run(it, _TILE, run), dealt.schema)


def _crossing_links(members: DataFrame) -> DataFrame:
    """(a, b): the similar pairs of _crossing() among members with their shingles' hashes, as local spanning stars."""

    def run(t: pa.Table) -> pa.RecordBatch | None:
        i, j = _crossing(t)
        key, grams = t.column("key").to_numpy(), t.column("grams")
        sets = {r: np.frombuffer(grams[r].as_py(), np.uint64) for r in np.unique(np.concatenate((i, j))).tolist()}
        keep = np.fromiter((near(sets[x], sets[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))
        root = roots(len(key), i[keep], j[keep])
        moved = np.flatnonzero(root != np.arange(len(key)))
        return pa.record_batch([pa.array(key[moved]), pa.array(key[root[moved]])], ["a", "b"]) if len(moved) else None

    members = members.select(*_MEMBER, "grams").repartition(*_TILE).sortWithinPartitions(*_TILE)
    return members.mapInArrow(lambda it: each_run(it, _TILE, run), "a long, b long")


def _grams(docs: DataFrame, classes: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """(key, grams), written: the sorted 64-bit hashes of the distinct shingles of each of the keys, which are written."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = [line_of(t.as_py()) for t in b.column(0)]
            grams = [np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(s, 42) for s in shingles(x, width)]), np.uint64)).tobytes() for x in lines]
            yield pa.record_batch([pa.array([_key(x) for x in lines], pa.int64()), pa.array(grams, pa.binary())], ["key", "grams"])

    reps = keys.join(classes, "key").select(F.col("rep").alias("_rep")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("_rep"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(reps, "_rep", "left_semi").select("text").mapInArrow(hashed, "key long, grams binary")
    return materialize(found.join(keys, "key", "left_semi").dropDuplicates(["key"]))


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, homes: DataFrame, width: int = WIDTH) -> DataFrame:
    """pairs (a, b), written, with `near`: what the exact similarity of the two texts says.

    homes (key, home): texts with one home are likely to meet often.  Those of
    a home fall into blocks of about TILE by hash; pairs are compared by pairs
    of blocks, to which each text goes once however many pairs it has there.
    Shingles are compared by their 64-bit hashes.
    """

    pairs = materialize(pairs)
    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    size = homes.groupBy("home").agg(F.count("*").alias("n"))
    placed = wanted.join(homes, "key", "left").withColumn("home", F.coalesce("home", "key")).join(size, "home", "left")
    placed = materialize(placed.select("key", F.struct("home", F.pmod(F.xxhash64("key"), F.ceil(F.coalesce("n", F.lit(1)) / TILE).cast("long")).alias("block")).alias("place")))
    grams = _grams(docs, classes, placed.select("key"), width)
    at = lambda c: placed.select(F.col("key").alias(c), F.col("place").alias(f"p{c}"))
    tiled = pairs.join(at("a"), "a").join(at("b"), "b").select(F.xxhash64(F.least("pa", "pb"), F.greatest("pa", "pb")).alias("tile"), "a", "b")
    tiled = materialize(tiled)
    members = tiled.select("tile", F.col("a").alias("key")).unionByName(tiled.select("tile", F.col("b").alias("key"))).distinct()
    rows = members.join(grams, "key").select("tile", F.lit(0).alias("kind"), F.col("key").alias("a"), F.lit(None).cast("long").alias("b"), "grams")
    rows = rows.unionByName(tiled.select("tile", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("grams")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, sets = None, {}
        for b in batches:
            out: list[tuple[int, int, bool]] = []
            for t, kind, x, y, g in zip(*(b.column(c).to_pylist() for c in ("tile", "kind", "a", "b")), b.column("grams"), strict=True):
                if t != tile:
                    tile, sets = t, {}
                if not kind:
                    sets[x] = np.frombuffer(g.as_py(), np.uint64)
                else:
                    out.append((x, y, near(sets[x], sets[y])))
            yield pa.record_batch([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "near"])

    return materialize(rows.repartition("tile").sortWithinPartitions("tile", "kind").mapInArrow(compare, "a long, b long, near boolean"))


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are similar."""
    least = min(len(a), len(b))
    if DENOM * least < NUMER * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate((a, b)))
    both = int((both[1:] == both[:-1]).sum())
    return DENOM * both >= NUMER * (len(a) + len(b) - both)


def similar_documents(docs: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id) for each document.

    Texts with the same words (a 64-bit hash of them) are one class.  Two
    classes are linked if the Jaccard similarity of their shingles is at least
    0.8 and their sketches share a covering table and differ in at most FAR
    bits; component_id is the smallest doc_id that links reach.

    First only the tables of one long are looked at, and in each bucket, or
    block of a large one, only pairs with its first member: that joins large
    groups without comparing all of their pairs.  Then all tables give the
    texts that have candidates in parts not joined with theirs yet; these meet
    again with their shingles, large buckets in bounded block pairs, those
    within one part not at all, and only local spanning stars leave a task.
    A null or empty text is a class like any other.  Repeated rows each get their row; a null doc_id is kept
    and names no component.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prints = materialize(sketches(docs, width))
    classes = materialize(prints.groupBy("key").agg(F.min("doc_id").alias("rep"), *(F.first(s).alias(s) for s in _SKETCH)))
    described = classes.select("key", *_SKETCH)
    hot = materialize(postings(described).groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 2 * block))

    blocks = F.ceil(F.coalesce("n", F.lit(1)) / block)
    salted = postings(described, 1).join(hot, "bucket", "left").withColumn("salt", F.pmod(F.xxhash64("key", "bucket"), blocks))
    stars = materialize(_stars(salted).groupBy("b").agg(F.min("a").alias("a"), F.min_by("a", F.struct("far", "a")).alias("nearest")))
    homes = stars.select(F.col("b").alias("key"), F.col("a").alias("home"))
    tested = verified(docs, classes, stars.select("a", "b").unionByName(stars.select(F.col("nearest").alias("a"), "b")).distinct(), homes, width)
    parts = _parts(tested.where("near"))

    held = materialize(described.join(parts, "key", "left").withColumn("part", F.coalesce("part", "key")))
    every = postings(held)
    small = every.join(hot, "bucket", "left_anti").withColumns({c: F.lit(0) for c in ("_own", "lo", "hi")})
    mixed = materialize(every.join(hot, "bucket").groupBy("bucket").agg(F.count("*").alias("n"), F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("bucket", "n"))
    rest = materialize(_crossing_members(small.unionByName(in_blocks(every, "bucket", "key", mixed, block))))
    grams = _grams(docs, classes, materialize(rest.select("key").distinct()), width)
    more = materialize(_crossing_links(rest.join(grams, "key")))
    parts = _parts(tested.where("near").select("a", "b").unionByName(more))

    named = classes.select("key", "rep").join(parts, "key", "left").withColumn("part", F.coalesce("part", "key"))
    least = named.groupBy("part").agg(F.min("rep").alias("component_id"))
    named = materialize(named.join(least, "part").select("key", "component_id"))
    for old in (classes, hot, stars, tested, rest, grams, more, held, mixed):
        discard(spark, old)
    return prints.select("doc_id", "key").join(named, "key").select("doc_id", "component_id")


def _parts(links: DataFrame) -> DataFrame:
    found = components(links.select("a", "b"))
    return found.select(F.col("node").alias("key"), F.col("component").alias("part"))
