"""Shards of nearly equal size that keep linked documents together, by balanced label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, materialize, ranked

#: Rounds of label propagation at most; it ends when no document wants to move.
ROUNDS = 8


def assign(docs: DataFrame, shards: int = 16, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot); the row counts of any two shards differ by one at most.

    Documents with equal texts are linked.  Linked documents begin in a shard
    by hash; in each round a document moves towards the shard, of those with
    room, in which most of its linked documents are, under a quota for each
    pair of shards that swaps and free places allow.  Documents without links,
    and linked ones beyond a shard's capacity, fill the places left, which
    cuts no link that stayed.  Slots run from 0 in each shard.  A null text
    has no bytes and links like an empty one; rows with null or equal ids each
    get their place; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    groups = materialize(rows.groupBy("k1", "k2").agg(F.count("*").alias("members")).where("members > 1"))
    linked = materialize(rows.select("row", "k1", "k2").join(groups.select("k1", "k2"), ["k1", "k2"]).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")))
    linked = _propagate(linked, quota, rounds)

    #: Places that linked documents keep; those beyond the capacity give theirs up.
    placed = ranked(linked.select("row", "shard"), ["shard"], [F.xxhash64("row"), F.col("row")], "slot")
    limit = F.element_at(F.array(*(F.lit(q) for q in quota)), F.col("shard") + 1)
    placed = materialize(placed.where(F.col("slot") < limit))
    kept = {r[0]: r[1] for r in placed.groupBy("shard").count().collect()}  # one row a shard
    others = rows.select("row").join(placed.select("row"), "row", "left_anti")
    others = ranked(others.withColumn("_all", F.lit(0)), ["_all"], [F.xxhash64("row"), F.col("row")], "rank").select("row", "rank")
    free, first, shard, slot = 0, F.col("rank"), F.lit(None).cast("int"), F.lit(None).cast("long")
    for s in range(shards):
        room = quota[s] - kept.get(s, 0)
        here = (first >= free) & (first < free + room)
        shard, slot = F.when(here, s).otherwise(shard), F.when(here, first - free + kept.get(s, 0)).otherwise(slot)
        free += room
    places = placed.select("row", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot")).unionByName(others.select("row", shard.cast("int").alias("shard"), slot.cast("long").alias("slot")))
    return rows.join(places, "row").select("doc_id", "size", "text_crc32", "shard", "slot")


def _propagate(linked: DataFrame, quota: list[int], rounds: int) -> DataFrame:
    """Rounds of moves; linked: (row, k1, k2, shard).  What reaches the driver is a table of shard pairs."""
    spark, shards = linked.sparkSession, len(quota)
    for turn in range(rounds):
        load = {r[0]: r[1] for r in linked.groupBy("shard").count().collect()}
        room = [max(0, q - load.get(s, 0)) for s, q in enumerate(quota)]
        # A full shard attracts nobody new but holds what is in it.
        seats = materialize(linked.groupBy("k1", "k2", "shard").agg(F.count("*").alias("here")))
        best = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "shard")
        free = F.element_at(F.array(*(F.lit(r > 0) for r in room)), F.col("shard") + 1)
        choice = seats.withColumn("score", F.when(free, F.col("here")).otherwise(0)).withColumn("n", F.row_number().over(best))
        target = materialize(choice.where("n = 1 AND score > 0").select("k1", "k2", F.col("shard").alias("target"), F.col("here").alias("gain")))
        full = F.element_at(F.array(*(F.lit(r == 0) for r in room)), F.col("shard") + 1)
        # Members in a full shard stay where more of the group sit than in the target.
        wish = seats.join(target, ["k1", "k2"]).where((F.col("shard") != F.col("target")) & ~(full & (F.col("here") > F.col("gain"))))
        wish = materialize(wish.select("k1", "k2", "shard", "target", "here"))
        pairs = {(r[0], r[1]): r[2] for r in wish.groupBy("shard", "target").agg(F.sum("here")).collect()}  # shards squared at most
        if not pairs:
            break
        allowed = {}
        for (a, b), n in sorted(pairs.items()):
            swap = min(n, pairs.get((b, a), 0))
            extra = min(n - swap, room[b])
            room[b] -= extra
            allowed[a, b] = swap + extra
        movers = linked.join(wish.select("k1", "k2", "shard", "target"), ["k1", "k2", "shard"])
        chosen = ranked(movers, ["shard", "target"], [F.xxhash64("k1", "k2"), F.col("k1"), F.col("k2"), F.xxhash64("row"), F.col("row")], "turn")
        cap = F.lit(0)
        for (a, b), n in allowed.items():
            cap = F.when((F.col("shard") == a) & (F.col("target") == b), n).otherwise(cap)
        moves = materialize(chosen.where(F.col("turn") < cap).select("row", "target"))
        moved = materialize(linked.join(moves, "row", "left").select("row", "k1", "k2", F.coalesce("target", "shard").cast("int").alias("shard")))
        for old in (seats, target, wish, moves, linked):
            discard(spark, old)
        linked = moved
        if not sum(allowed.values()):
            break
    return linked


def cut_share(placed: DataFrame) -> DataFrame:
    """(links, cut): pairs of equal texts, and those whose documents are in different shards; of rows (text_crc32, size, shard)."""
    pairs = lambda n: n * (n - 1) / 2
    here = placed.groupBy("text_crc32", "size", "shard").agg(F.count("*").alias("n"))
    groups = here.groupBy("text_crc32", "size").agg(pairs(F.sum("n")).alias("links"), F.sum(pairs(F.col("n"))).alias("kept"))
    return groups.agg(F.coalesce(F.sum("links"), F.lit(0)).alias("links"), F.coalesce(F.sum(F.col("links") - F.col("kept")), F.lit(0)).alias("cut"))
