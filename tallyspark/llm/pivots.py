"""Near-duplicate embeddings by a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import components, discard, each_run, in_blocks, materialize, roots

#: Reference points of a vector's description.
NEAREST = 16
#: A vector is listed under each pair of its first reference points: of so many at least, and at most.
FIRST_LEAST, FIRST_MOST = 4, 12
#: Share of made pairs at exactly the threshold that the number of shared points and the lists must each find.
FOUND = 0.995
#: The reference points are a sample of about 2 * sqrt(N) vectors, within these bounds.
FEWEST, MOST = 64, 16_384
#: The reference points of all dimensions, which every task holds, take at most so many bytes.
HELD_BYTES = 128 << 20
#: Where linked vectors share too little of them, as in a narrow cone, their number is halved, down to this.
COARSEST = 32
#: No two reference points are as near as this, and so many sampled vectors are looked at for each point wanted.
APART, LOOKED_AT = 0.8, 4
#: Vectors of an inverted list that meet in one task are at most twice this.
BLOCK = 512


def usable(vec: str) -> F.Column:
    """True for vectors that have a direction: not null, no null or non-finite component, not zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vec).isNotNull() & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def unit(values: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first so that squares neither overflow nor vanish."""
    x = values.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def apart(x: np.ndarray, most: int, limit: float = APART) -> np.ndarray:
    """Rows in order, less those within the limit of one taken before; at most so many."""
    taken = np.empty((min(most, len(x)), x.shape[1]))
    n = 0
    for row in x:
        if n == len(taken):
            break
        if not n or (taken[:n] @ row).max() < limit:
            taken[n] = row
            n += 1
    return taken[:n]


@dataclass
class Points:
    """Reference points of one dimension, in the space moved by the sample's mean, and what two linked vectors share.

    shared: how many of their nearest points; first: of how many of the
    nearest they share two.
    """

    mean: np.ndarray
    x: np.ndarray
    shared: int
    first: int

    def order(self, units: np.ndarray, nearest: int) -> np.ndarray:
        """The numbers of the nearest points, nearest first: the vectors' permutation prefixes."""
        near = self.moved(units, self.mean) @ self.x.T
        n = min(nearest, len(self.x))
        some = np.argpartition(-near, n - 1, axis=1)[:, :n]
        by = np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable")
        return np.take_along_axis(some, by, 1).astype(np.uint16)

    @staticmethod
    def moved(units: np.ndarray, mean: np.ndarray) -> np.ndarray:
        """Of unit length again, so that vectors in a narrow cone are told apart by where in it they lie."""
        y = units - mean
        return y / np.maximum(np.sqrt((y * y).sum(1, keepdims=True)), 1e-12)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many numbers each row of a shares with the same row of b."""
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), 16_384):
        s = slice(at, at + 16_384)
        out[s] = (a[s, :, None] == b[s, None, :]).sum((1, 2))
    return out


def fit_points(sampled: np.ndarray, most: int, threshold: float, nearest: int = NEAREST) -> Points:
    """Points of a sample of unit vectors.

    How much two linked vectors share is measured, not assumed: sampled
    vectors are turned towards others until their cosine with what they were
    is exactly the threshold, and the strictest counts that FOUND of these
    pairs meet are taken; where none does, there are fewer points.
    """
    mean = sampled.mean(0)
    moved = Points.moved(sampled, mean)
    x = sampled[:2048]
    towards = x[np.random.default_rng(42).permutation(len(x))]
    towards = towards - (towards * x).sum(1, keepdims=True) * x
    length = np.sqrt((towards * towards).sum(1))
    x, towards = x[length > 1e-6], towards[length > 1e-6] / length[length > 1e-6][:, None]
    turned = threshold * x + np.sqrt(1 - threshold**2) * towards
    chosen = apart(moved, most)
    while True:
        points = Points(mean, chosen, 1, FIRST_MOST)
        if not len(x):
            return points
        a, b = points.order(x, nearest), points.order(turned, nearest)
        points.shared = max(1, int(np.quantile(common(a, b), 1 - FOUND, method="lower")))
        enough = [k for k in range(FIRST_LEAST, FIRST_MOST + 1) if (common(a[:, :k], b[:, :k]) >= 2).mean() >= FOUND]
        if enough or len(chosen) <= COARSEST:
            points.first = enough[0] if enough else FIRST_MOST
            return points
        chosen = chosen[: max(COARSEST, len(chosen) // 2)]


def fit_pivots(classes: DataFrame, threshold: float = 0.95, nearest: int = NEAREST) -> dict[int, Points]:
    """The reference points of each dimension, the most frequent first, while they fit in HELD_BYTES.

    Dimensions for which fewer than COARSEST are left, and those beyond the
    1,000 most frequent, have none and one list each.

    A bounded sample: of each dimension the vectors with the smallest hashes,
    LOOKED_AT for each of 2 * sqrt(N) points within FEWEST and MOST.  Of these
    each is taken that is not too near to one taken before: points inside one
    dense group would be ordered by chance, so such a group has one.
    """
    sizes = classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1000).collect()
    pivots, room = {}, HELD_BYTES
    for dim, n in sizes:
        m = min(MOST, max(FEWEST, 1 << int(np.ceil(np.log2(2 * np.sqrt(n))))), room // (8 * dim) - 1)  # a mean besides
        if m < COARSEST:
            continue
        sample = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("rep")).limit(LOOKED_AT * m).select("vec").toArrow()
        flat = sample.column("vec").combine_chunks().flatten()
        points = fit_points(unit(flat.to_numpy(zero_copy_only=False).reshape(-1, dim)), m, threshold, nearest)
        pivots[dim] = points
        room -= points.x.nbytes + points.mean.nbytes
    return pivots


def describe(classes: DataFrame, pivots: dict[int, Points], nearest: int = NEAREST) -> DataFrame:
    """(rep, dim, order, pairs): the numbers of the nearest points as bytes, and the lists: pairs of the first of them."""
    held = classes.sparkSession.sparkContext.broadcast(pivots)  # at most HELD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec, dims = b.column("vec"), b.column("dim").to_numpy()
            order, pairs = np.empty(b.num_rows, object), np.empty(b.num_rows, object)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                points = held.value.get(int(dim))
                x = unit(vec.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim))
                near = points.order(x, nearest) if points is not None else np.zeros((len(rows), 1), np.uint16)
                first = np.sort(near[:, : points.first if points is not None else 1].astype(np.int64), axis=1)
                i, j = np.triu_indices(first.shape[1], 1) if first.shape[1] > 1 else ([0], [0])
                lists = first[:, i] << 32 | first[:, j]
                for r, o, p in zip(rows, near, lists, strict=True):
                    order[r], pairs[r] = o.tobytes(), p
            yield pa.record_batch([b.column("rep"), b.column("dim"), pa.array(order.tolist(), pa.binary()), pa.array(pairs.tolist(), pa.list_(pa.int64()))], ["rep", "dim", "order", "pairs"])

    return classes.select("rep", "dim", "vec").mapInArrow(run, "rep long, dim int, order binary, pairs array<long>")


_TILE = ["dim", "pair", "lo", "hi"]
_MEMBER = [*_TILE, "_own", "rep", "order"]


def _candidates(t: pa.Table, pivots: dict[int, Points]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of one list that share enough points, of rows sorted by list; each pair only in its first common list."""
    ids = np.stack([t.column(c).to_numpy().astype(np.int64) for c in _TILE])
    own = t.column("_own").to_numpy()
    group = np.cumsum(np.concatenate(([0], (ids[:, 1:] != ids[:, :-1]).any(0))))
    orders: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in np.unique(ids[0]).tolist():
        rows = np.flatnonzero(ids[0] == dim)
        data = b"".join(t.column("order").take(pa.array(rows)).to_pylist())
        place = np.zeros(len(own), np.int64)
        place[rows] = np.arange(len(rows))
        orders[dim] = place, np.frombuffer(data, np.uint16).reshape(len(rows), -1)
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    i, step = np.arange(len(own)), 1
    while len(i := i[i + step < len(own)]) and len(i := i[group[i + step] == group[i]]):
        some = i[(ids[2][i] == ids[3][i]) | (own[i] != own[i + step])]
        for dim, (place, order) in orders.items():
            p = some[ids[0][some] == dim]
            a, b = order[place[p]], order[place[p + step]]
            points = pivots.get(dim)
            need, first = (min(points.shared, order.shape[1]), points.first) if points is not None else (1, 1)
            good = common(a, b) >= need
            p, a, b = p[good], a[good], b[good]
            if order.shape[1] > 1 and first > 1:
                both = (a[:, :first, None] == b[:, None, :first]).any(2)
                least = np.sort(np.where(both, a[:, :first].astype(np.int64), 1 << 31), axis=1)
                p = p[(least[:, 0] << 32 | least[:, 1]) == ids[1][p]]
            out_i.append(p)
            out_j.append(p + step)
        step += 1
    return np.concatenate(out_i), np.concatenate(out_j)


def found_links(described: DataFrame, classes: DataFrame, pivots: dict[int, Points], threshold: float, block: int = BLOCK) -> DataFrame:
    """(rep, root, n): for a vector in a list, how many rows it links there and the local component's smallest.

    First only ids and permutations are dealt to the lists, long ones in
    bounded block pairs; what shares enough points with another there comes
    back to its list with its vector and is verified.  So no pair leaves a
    task, and vectors move only where they have candidates.
    """
    postings = described.select("rep", "dim", "order", F.explode("pairs").alias("pair"))
    lists = postings.groupBy("dim", "pair").agg(F.count("*").alias("n")).where(F.col("n") > 2 * block)
    hot = materialize(lists.select("n", F.struct("dim", "pair").alias("list")))
    keyed = postings.withColumn("list", F.struct("dim", "pair"))
    small = keyed.join(hot, "list", "left_anti").withColumns({c: F.lit(0) for c in ("lo", "hi", "_own")})
    dealt = small.select(*_MEMBER).unionByName(in_blocks(keyed, "list", "rep", hot, block).select(*_MEMBER))
    held = described.sparkSession.sparkContext.broadcast(pivots)

    def flagged(t: pa.Table) -> pa.RecordBatch | None:
        i, j = _candidates(t, held.value)
        return t.take(pa.array(np.unique(np.concatenate((i, j))))).combine_chunks().to_batches()[0] if len(i) else None

    def links(t: pa.Table) -> pa.RecordBatch | None:
        rep, m, dims, vec = t.column("rep").to_numpy(), t.column("m").to_numpy(), t.column("dim").to_numpy(), t.column("vec").combine_chunks()
        i, j = _candidates(t, held.value)
        keep = np.zeros(len(i), bool)
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            x = unit(vec.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim))
            place = np.zeros(len(rep), np.int64)
            place[rows] = np.arange(len(rows))
            mine = np.flatnonzero(dims[i] == dim)
            for at in range(0, len(mine), 65_536):
                k = mine[at : at + 65_536]
                keep[k] = np.einsum("ij,ij->i", x[place[i[k]]], x[place[j[k]]]) >= threshold
        i, j = i[keep], j[keep]
        if not len(i):
            return None
        count = np.bincount(i, m[j], len(rep)) + np.bincount(j, m[i], len(rep))
        root = roots(len(rep), i, j)
        some = np.flatnonzero(count > 0)
        return pa.record_batch([pa.array(rep[some]), pa.array(rep[root[some]]), pa.array(count[some].astype(np.int64))], ["rep", "root", "n"])

    dealt = dealt.repartition(*_TILE).sortWithinPartitions(*_TILE)
    members = materialize(dealt.mapInArrow(lambda it: each_run(it, _TILE, flagged), dealt.schema))
    whole = members.join(classes.select("rep", "m", "vec"), "rep").repartition(*_TILE).sortWithinPartitions(*_TILE)
    kind = classes.schema["vec"].dataType.simpleString()
    whole = whole.select(*_MEMBER, "m", F.col("vec").cast(kind).alias("vec"))
    return whole.mapInArrow(lambda it: each_run(it, _TILE, links), "rep long, root long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, nearest: int = NEAREST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each vector.

    Links are pairs with a cosine of at least the threshold, in double
    precision, found among vectors of which two of the first reference points
    are the same and enough of all they are described by; no other pair counts.
    Equal vectors are one class of the index and link each other.
    Vectors that are null, empty, zero or hold null or non-finite components,
    and vectors of different dimension, link with nothing.  Repeated rows count
    as other vectors; a row with a null vec_id is kept, has no component and is
    nobody's representative.  An empty table gives an empty result.
    """
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"  # half the bytes to move
    vec = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).withColumn("ok", usable("vec") & F.col("vec_id").isNotNull())
    base = base.withColumns({"k1": F.when(F.col("ok"), F.xxhash64("vec")), "k2": F.when(F.col("ok"), F.hash("vec"))})
    classes = base.where("ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("vec").alias("vec"))
    classes = materialize(classes.select("k1", "k2", "rep", "m", F.size("vec").alias("dim"), "vec"))
    pivots = fit_pivots(classes, threshold, nearest)
    described = materialize(describe(classes, pivots, nearest))
    links = materialize(found_links(described, classes, pivots, threshold))
    discard(vectors.sparkSession, described)
    found = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    named = classes.select("k1", "k2", "rep", "m").join(counts, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    out = base.select("vec_id", "k1", "k2").join(named, ["k1", "k2"], "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
