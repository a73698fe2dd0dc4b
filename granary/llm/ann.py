"""Nearest neighbours by shifted space-filling curves: Hilbert orders of projected vectors, in ranges."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import lookup, written

#: Curves, dimensions that the vectors are projected to for each, and bits of a coordinate.
CURVES = 4
DIMS = 4
COORD_BITS = 12
#: Vectors of a block: neighbours on a curve, which are compared with queries by one matrix product.
BLOCK = 2048
#: Results of a query.
NEAREST = 20
#: Queries by whose true neighbours the windows are set, and the share of those neighbours that the windows must cover.
SAMPLE = 64
COVER = 0.97
#: Vectors of the sample that the curves' scales are fitted on.
FIT = 5000
SEED = 5


def hilbert(points: np.ndarray, bits: int = COORD_BITS) -> np.ndarray:
    """Places on the Hilbert curve of points with integer coordinates of `bits` bits (rows: points), by Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for shift in range(bits - 1, 0, -1):
        q = 1 << shift
        low = q - 1
        for i in range(n):
            set_ = (x[i] & q) > 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for shift in range(bits - 1, 0, -1):
        q = 1 << shift
        flip = np.where((x[n - 1] & q) > 0, flip ^ (q - 1), flip)
    x ^= flip
    key = np.zeros_like(x[0])
    for shift in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> shift) & 1)
    return key


class Curve:
    """One order: a random rotation to DIMS coordinates, scaled by the sample's range and shifted by a random offset."""

    def __init__(self, which: int, sample: np.ndarray) -> None:
        rng = np.random.default_rng((SEED, which))
        dims = min(DIMS, sample.shape[1])
        self.rotation = np.linalg.qr(rng.normal(size=(sample.shape[1], dims)))[0]
        seen = sample @ self.rotation
        low, high = np.quantile(seen, [0.001, 0.999], axis=0) if len(seen) else (np.zeros(dims), np.ones(dims))
        width = np.where(high > low, high - low, 1.0)
        self.low, self.scale = low - rng.random(dims) * width / 4, (1 << COORD_BITS) / (1.25 * width)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        at = np.clip((vectors @ self.rotation - self.low) * self.scale, 0, (1 << COORD_BITS) - 1)
        return hilbert(at)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """One more coordinate makes all vectors equally long, so that the largest inner product is the shortest distance."""
    return np.column_stack([vectors, np.sqrt(np.maximum(0.0, longest**2 - (vectors**2).sum(axis=1)))])


def _keyed(curves: list[Curve], longest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lifted = _lifted(_matrix(batch.column("v")), longest)
            for c, curve in enumerate(curves):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, c, np.int32)), pa.array(curve.keys(lifted)), batch.column("rep"), batch.column("asks"), batch.column("v")], ["curve", "key", "rep", "asks", "v"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition, sorted by (curve, key, rep), in blocks of one curve."""
    kept: list[pa.RecordBatch] = []
    number = 0

    def block(table: pa.Table, n: int) -> pa.RecordBatch:
        curve, key = table.column("curve")[0].as_py(), table.column("key")[0].as_py()
        reps, asks = table.column("rep").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        vectors = _matrix(table.column("v").combine_chunks())
        return pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in ((curve, pa.int32()), (key, pa.int64()), (int(reps[0]), pa.int64()), (n, pa.int32()), (reps.astype("<i8").tobytes(), pa.binary()), (vectors.astype("<f8").tobytes(), pa.binary()), (reps[asks].astype("<i8").tobytes(), pa.binary()), (vectors[asks].astype("<f8").tobytes(), pa.binary()))],
            ["curve", "key", "first", "number", "reps", "vectors", "ask_reps", "ask_vectors"],
        )

    def cut(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal kept, number
        table = pa.Table.from_batches(kept)
        while table.num_rows:
            curves = table.column("curve").to_numpy()
            here = int(np.searchsorted(curves, curves[0], "right"))
            n = min(here, BLOCK)
            if n == table.num_rows and n < BLOCK and not last:
                break
            yield block(table.slice(0, n), number)
            number += 1
            table = table.slice(n)
        kept = table.to_batches()

    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
            if sum(b.num_rows for b in kept) >= BLOCK:
                yield from cut(False)
    if kept:
        yield from cut(True)


def _best(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """For each query of a pair of blocks its k best vectors of the other block: (asks, reps, scores).

    The matrix product, whose last bits depend on the block, only chooses; the scores of the chosen are sums from the
    first component to the last, so they are the same wherever a pair is met.
    """
    for batch in batches:
        for at in range(batch.num_rows):
            row = {n: batch.column(n)[at].as_py() for n in ("ask_reps", "ask_vectors", "reps", "vectors")}
            asks, reps = np.frombuffer(row["ask_reps"], "<i8"), np.frombuffer(row["reps"], "<i8")
            queries, vectors = np.frombuffer(row["ask_vectors"], "<f8").reshape(len(asks), -1), np.frombuffer(row["vectors"], "<f8").reshape(len(reps), -1)
            found, exact = [], []
            for q, s in zip(queries, queries @ vectors.T, strict=True):
                some = np.arange(len(s))
                if len(s) > k:
                    bound = np.partition(s, len(s) - k)[len(s) - k]
                    some = np.flatnonzero(s >= bound - 1e-9 * abs(bound))
                scores = np.cumsum(vectors[some] * q, axis=1)[:, -1]
                top = _top(scores, reps[some], k)
                found.append(reps[some[top]])
                exact.append(scores[top])
            lists = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(asks), pa.ListArray.from_arrays(lists, pa.array(np.concatenate(found))), pa.ListArray.from_arrays(lists, pa.array(np.concatenate(exact)))], ["asks", "reps", "scores"])


def _top(scores: np.ndarray, reps: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller rep."""
    if len(scores) > k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= bound)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((reps[some], -scores[some]))][:k]


def _merged(k: int):
    """The k best of a query's lists; a vector that several curves found counts once."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        reps, scores = (np.concatenate([x.values.to_numpy() for x in table.column(c)]) for c in ("reps", "scores"))
        reps, where = np.unique(reps, return_index=True)
        top = _top(scores[where], reps, k)
        return pa.table({"asks": pa.array(np.full(len(top), table.column("asks")[0].as_py(), np.int64)), "rep": pa.array(reps[top]), "score": pa.array(scores[where][top])})

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(_vid, v, h1, h2) of the rows that take part; v is array<double>, h1 and h2 a hash of it by which equal vectors meet."""
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))  # -0.0 equals 0.0
    rows = vectors.select(F.col(id_col).cast("long").alias("_vid"), v.alias("v")).filter("_vid is not null and v is not null and size(v) > 0")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.coalesce(good, F.lit(False))).select("_vid", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = NEAREST, cover: float = COVER) -> DataFrame:
    """(query_id, rank, <id>, score): for each row whose id is divisible by `every`, the k rows with the largest inner products that the curves find.

    Rows with a null id, a null, empty or zero vector, or with null or non-finite components take no part; nor do rows
    whose vector has another length than most. Rows that repeat an id and a vector count once; rows that repeat an id
    with another vector are rows of their own: each asks, if the id does, and each finds the other. Equal vectors, whatever
    their number, are one point on the curves, with their k + 1 smallest ids; they are dealt out again at the end, so a
    group with a third of all rows is neither compared with itself nor gathered in a task. Ties go to the smaller id.
    With no more than k other rows all are returned; an empty table gives an empty result. Other columns are not read.

    Each curve's order is cut into blocks of 2,048 vectors. A query is compared with the blocks up to `reach` blocks
    from its own, on every curve; the lists of all curves merge. reach is set from the true neighbours of a bounded
    sample of queries, found by comparing those with all vectors, so that `cover` of the neighbours are in a window of
    some curve: on clustered vectors it's small; on vectors without structure no index of this kind can skip most.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors, id_col, vector_col).dropDuplicates(["_vid", "h1", "h2"]))
    found = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    if not found:
        return empty
    rows = rows.filter(F.size("v") == found[0].d)
    # equal vectors: their k + 1 smallest ids, how many of the ids ask; each task first cuts its own ids to k + 1
    same = Window.partitionBy("h1", "h2").orderBy("_vid")
    few = rows.select("_vid", "h1", "h2").withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1).groupBy("h1", "h2").agg(F.sort_array(F.collect_list("_vid")).alias("ids"))
    asking = F.pmod("_vid", F.lit(every)) == 0
    groups = rows.groupBy("h1", "h2").agg(F.min_by("v", "_vid").alias("v"), F.min("_vid").alias("first"), F.count_if(asking).alias("n_asks"))
    # rep numbers the points in the order of their smallest ids, by which ties are decided
    by_id = groups.join(few, ["h1", "h2"]).repartitionByRange("first", "h1", "h2").sortWithinPartitions("first", "h1", "h2")
    points = written(by_id.withColumn("rep", F.monotonically_increasing_id()).drop("first"))
    total = points.count()
    sample = _matrix(points.orderBy("h1", "h2").limit(FIT).select("v").toArrow().column("v").combine_chunks())
    longest = math.sqrt(points.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0])
    curves = [Curve(c, _lifted(sample, longest)) for c in range(CURVES)]
    keyed = points.select("rep", (F.col("n_asks") > 0).alias("asks"), "v").mapInArrow(_keyed(curves, longest), "curve int, key long, rep long, asks boolean, v array<double>")
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * CURVES / BLOCK)))
    ordered = keyed.repartitionByRange(parts, "curve", "key", "rep").sortWithinPartitions("curve", "key", "rep")
    blocks = written(ordered.mapInArrow(_blocks, "curve int, key long, first long, number int, reps binary, vectors binary, ask_reps binary, ask_vectors binary"))
    # a block's place on its curve: blocks are few, one for 2,048 vectors and a curve
    places = blocks.select("curve", "key", "first", "number").withColumn("place", F.row_number().over(Window.partitionBy("curve").orderBy("key", "first", "number")))
    blocks = written(blocks.join(places, ["curve", "key", "first", "number"]))
    asks = blocks.filter("length(ask_reps) > 0").select("curve", "place", "ask_reps", "ask_vectors")
    reach = _reach(points, blocks, total, k, cover)
    last = {r.curve: r.n for r in blocks.groupBy("curve").agg(F.max("place").alias("n")).collect()}
    ends = F.element_at(F.create_map(*[F.lit(x) for c, n in last.items() for x in (c, n)]), F.col("curve"))
    pairs = asks.withColumn("place", F.explode(F.sequence(F.greatest(F.lit(1), F.col("place") - reach), F.least(ends, F.col("place") + reach))))
    pairs = pairs.join(blocks.select("curve", "place", "reps", "vectors"), ["curve", "place"]).select("ask_reps", "ask_vectors", "reps", "vectors")
    lists = pairs.mapInArrow(lambda b: _best(b, k + 1), "asks long, reps array<long>, scores array<double>")
    best = written(lists.groupBy("asks").applyInArrow(_merged(k + 1), "asks long, rep long, score double"))
    # copies are dealt out: the k + 1 best rows of each distinct query, itself included
    nearest = best.join(points.select("rep", "ids"), "rep").select("asks", "score", (F.col("asks") == F.col("rep")).alias("own"), F.explode("ids").alias("id"))
    nearest = nearest.withColumn("n", F.row_number().over(Window.partitionBy("asks").orderBy(F.desc("score"), "id"))).filter(F.col("n") <= k + 1)
    nearest = nearest.groupBy("asks").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score", "own"))).alias("near"))
    answers = written(points.filter("n_asks > 0").select("h1", "h2", F.col("rep").alias("asks"), "n_asks").join(nearest, "asks").drop("asks"))
    askers = written(rows.filter(asking).select("_vid", "h1", "h2"))
    out = lookup(askers, answers, ["h1", "h2"], "n_asks", max(1, askers.count()))
    out = out.withColumn("near", F.slice(F.filter("near", lambda x: (x["id"] != F.col("_vid")) | ~x["own"]), 1, k))
    out = out.select(F.col("_vid").alias("query_id"), F.posexplode("near").alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))


def _reach(points: DataFrame, blocks: DataFrame, total: int, k: int, cover: float) -> int:
    """Blocks to each side that cover the given share of the true neighbours of a sample of queries."""
    sample = points.filter("n_asks > 0").orderBy("h2", "h1").limit(SAMPLE).select("rep", "v").toArrow()
    if not sample.num_rows:
        return 0
    reps, vectors = sample.column("rep").to_numpy(), _matrix(sample.column("v").combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row = pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (reps.astype("<i8").tobytes(), vectors.astype("<f8").tobytes(), batch.column("rep").to_numpy().astype("<i8").tobytes(), _matrix(batch.column("v")).tobytes())], ["ask_reps", "ask_vectors", "reps", "vectors"])
                yield from _best(iter([row]), k + 1)

    near = points.select("rep", "v").mapInArrow(run, "asks long, reps array<long>, scores array<double>").groupBy("asks").applyInArrow(_merged(k + 1), "asks long, rep long, score double").select("asks", "rep").filter("asks <> rep").toPandas()
    wanted = sorted({*near["asks"].tolist(), *near["rep"].tolist()})  # at most SAMPLE * (k + 2) of them

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.array(wanted, np.int64)
        for batch in batches:
            for curve, at, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                here = np.intersect1d(np.frombuffer(ids.as_py(), "<i8"), asked)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here), curve, np.int32)), pa.array(here), pa.array(np.full(len(here), at, np.int32))], ["curve", "rep", "place"])

    if not wanted:
        return 0
    at = blocks.select("curve", "place", "reps").mapInArrow(place, "curve int, rep long, place int").toPandas().pivot(index="rep", columns="curve", values="place")
    apart = np.abs(at.loc[near["asks"]].to_numpy() - at.loc[near["rep"]].to_numpy()).min(axis=1)
    return int(np.sort(apart)[min(len(apart) - 1, math.ceil(cover * len(apart)) - 1 if len(apart) else 0)])
