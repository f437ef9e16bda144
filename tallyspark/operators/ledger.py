"""After the ledger's fold: splitting, merging and the state of carry-overs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.columns import COUNTERS, saturating

#: Fixed value: tokens of one counter that one event holds at most.
MOST = 1_000_000_000


def merged_events(events: DataFrame, *keys: str, most: int = MOST) -> DataFrame:
    """Events with equal keys as one, and again split so that no counter exceeds the most; the cost stays with the first part."""
    summed = events.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in COUNTERS), F.sum("cost").alias("cost"))
    parts = F.greatest(*(F.ceil(F.col(c) / most) for c in COUNTERS), F.lit(1).cast("long"))
    each = summed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    cut = {c: F.least(F.greatest(F.col(c) - F.col("part") * most, F.lit(0).cast("long")), F.lit(most).cast("long")) for c in COUNTERS}
    return each.withColumns(cut | {"cost": F.when(F.col("part") == 0, F.col("cost")).otherwise(0.0)})


def status(carried: DataFrame) -> DataFrame:
    """(count, tokens): carry-overs and their total, held within the range of a long."""
    total = sum((F.col(c).cast("decimal(38,0)") for c in COUNTERS[1:]), F.col(COUNTERS[0]).cast("decimal(38,0)"))
    return carried.agg(F.count("*").alias("count"), saturating(F.coalesce(F.sum(total), F.lit(0).cast("decimal(38,0)"))).alias("tokens"))
