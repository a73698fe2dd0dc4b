"""What the training-data operators share: scratch tables, skew-proof lookups, connected components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A key with over 1/HOT of the counted rows is hot, so there are fewer than HOT hot keys, however large the input.
HOT = 1000

_paths: list[tuple[SparkSession, str]] = []
#: Folders of applications on one machine that name none, by their ids.
_folders: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a new one, on one machine only, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        name = spark.sparkContext.applicationId
        if name not in _folders:
            _folders[name] = "file://" + tempfile.mkdtemp(prefix="granary-")
        found = _folders[name]
    return found.rstrip("/")


@atexit.register
def _drop_scratch() -> None:
    for spark, path in _paths:
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session of this one may be gone by now
            continue


def forget(table: DataFrame) -> None:
    """Deletes the files of a table from written(), once nothing reads it any more."""
    spark = table.sparkSession
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of what is no longer referenced, which it does when the driver's JVM collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


#: Bytes of an Arrow batch of texts. Spark's 64 MB would be held several times over by a JVM and its Python worker.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, after bounding the session's Arrow batches, where they still have Spark's bound."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) in ("67108864b", "64MB", "67108864"):
        conf.set(name, f"{BATCH_BYTES}b")
    return df


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, so a lost executor costs one read, and later passes read narrow columns."""
    spark = df.sparkSession
    if path is None:
        path = f"{scratch_dir(spark)}/granary-{uuid.uuid4().hex}"
        _paths.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup(left: DataFrame, right: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Inner join of rows with a table that has each key once.

    count: right's column of left's rows with the key, out of total. Keys with over total / HOT rows are fewer than
    HOT, so they are broadcast and their rows stay where they are; only the rest meets its key by a shuffle, where no
    task can get more than total / HOT rows of a key. left is read twice, so it should be a table. A total that is too
    small makes more keys hot and the broadcast larger, but no row is dropped.
    """
    hot = right[count] * HOT > F.lit(total)
    spread = left.join(F.broadcast(right.filter(hot)), on)
    rest = left.join(F.broadcast(right.filter(hot).select(*on)), on, "left_anti").join(right.filter(~hot), on)
    return spread.unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """Connected components: (node, label) for every node of edges (a, b), label the smallest node reachable.

    Large-star and small-star steps in turn until nothing changes: the edge list never grows, a hub's edges are
    aggregated before the shuffle, and each round ends in a table. No component is gathered anywhere.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while True:
        if not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
        both = written(now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = written(lookup(both.filter("b > a").select("a", "b"), least, ["a"], "n", 2 * state[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = lookup(large, least, ["a"], "n", max(1, large.count()))
        old, now = now, written(small.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct())
        for table in (both, large, old):
            forget(table)
        before, state = state, _state(now)
        if before == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("b", "a") % 1_000_003), F.lit(0))).first())
