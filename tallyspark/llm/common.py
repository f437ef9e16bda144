"""What the corpus operators share: reading, durable intermediate tables, bounded groups, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; where a local master names none, as in tests, a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.tallyspark.scratch", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
        spark.conf.set("spark.tallyspark.scratch", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    It cuts lineage, survives lost executors and is computed once however
    often it is used.  Collecting garbage lets Spark's cleaner drop the
    shuffle files that only finished jobs needed; those of the last one go
    when the next begins, as Spark holds on to it until then.
    """
    spark = df.sparkSession
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    path = f"{shared_dir(spark)}/tallyspark-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    root = shared_dir(spark)
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = hadoop.fs.Path(parent)
        if "/tallyspark-" in parent and root.split(":")[-1].lstrip("/") in parent:
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def in_blocks(df: DataFrame, key: str, item: str, sizes: DataFrame, block: int) -> DataFrame:
    """Deal the members of each key into block pairs of at most 2 * block rows.

    sizes: (key, n), materialized, with the keys worth comparing.  A group of
    n rows becomes b = ceil(n / block) blocks; each row goes to the b pairs
    that hold its block, so that any two rows of the group meet in the pair
    (lo, hi) of their blocks, and a hot key is spread over b * (b + 1) / 2
    tasks instead of one.
    """
    joined = df.join(sizes, key)
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64(F.col(item), F.lit(7)), blocks.cast("long")).cast("int")
    dealt = joined.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.withColumns({"lo": F.least("_own", "_other"), "hi": F.greatest("_own", "_other")}).drop("_other", "n")


def each_group(batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """Call work on each run of equal keys of a sorted partition; holds one group and one batch."""
    rest: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        rest = pa.concat_tables([rest, now]) if rest is not None and rest.num_rows else now
        cuts = _cuts(rest, keys)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1 and (out := work(rest.slice(a, b - a).combine_chunks())) is not None:
                yield out
        rest = rest.slice(cuts[-1]).combine_chunks()
    if rest is not None and rest.num_rows > 1 and (out := work(rest)) is not None:
        yield out


def each_run(batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """Call work on stretches of whole groups of a sorted partition; holds one group and one batch."""
    rest: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        rest = pa.concat_tables([rest, now]) if rest is not None and rest.num_rows else now
        end = _cuts(rest, keys)[-1]
        if end and (out := work(rest.slice(0, end).combine_chunks())) is not None:
            yield out
        rest = rest.slice(end).combine_chunks()
    if rest is not None and rest.num_rows and (out := work(rest)) is not None:
        yield out


def _cuts(t: pa.Table, keys: list[str]) -> list[int]:
    """Where groups begin; the last is the beginning of the group that may go on."""
    if not t.num_rows:
        return [0]
    change = np.zeros(t.num_rows, bool)
    change[0] = True
    for k in keys:
        v = t.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change).tolist()


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that each of n positions reaches by the links (a, b), by min-label and jumping."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected edges (a, b): the smallest node reachable.

    Each round every node takes the smallest label of its neighbours and then
    its label's label.  Labels only fall, so an unchanged sum ends the loop.
    Both inputs of every join are written tables: Spark can split a hot node's
    shuffle partition.  Nulls are no nodes; no edges give an empty table.
    """
    spark = edges.sparkSession
    edges = materialize(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct())
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")))
    total = _sum(label)
    while total is not None:
        spread = both.join(label, F.col("a") == F.col("node")).select(F.col("b").alias("node"), "component")
        low = materialize(label.unionByName(spread).groupBy("node").agg(F.min("component").alias("component")))
        up = low.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        jumped = materialize(low.join(up, F.col("component") == F.col("_n")).select("node", F.col("_c").alias("component")))
        discard(spark, label)
        discard(spark, low)
        label, before = jumped, total
        total = _sum(label)
        if total == before:
            break
    return label


def _sum(label: DataFrame):
    return label.agg(F.sum(F.col("component").cast("decimal(38,0)"))).head()[0]


def ranked(df: DataFrame, within: list[str], order: list[Column], out: str, per_bucket: int = 20_000) -> DataFrame:
    """A gapless number from 0 within each group, without one task for a whole group.

    Rows fall into hash buckets of about per_bucket rows; the small table of
    bucket counts gives each bucket's first number and a window inside the
    bucket the rest.  Order between buckets is arbitrary but fixed.
    """
    df = materialize(df)
    n = df.count()
    buckets = max(16, -(-n // per_bucket))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    keys = [*within, "_bucket"]
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = materialize(counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")))
    inside = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn("_in", F.row_number().over(inside) - 1)
    return numbered.join(first, keys).withColumn(out, (F.col("_first") + F.col("_in")).cast("long")).drop("_first", "_in", "_bucket")
