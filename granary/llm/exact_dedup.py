"""Exact deduplication: two Bloom passes, and only rows that may repeat are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import SPACES, lookup, written

#: Bits of the filter of repeated hashes: 16 a row, within these bounds. At the upper bound it is 32 MB, which is
#: what is broadcast at most; beyond it more rows take the shuffled way, with the same results.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
PROBES = 2


def normalised(text: Column | str) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACES, " ")


def digest(text: Column | str) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _slots(key: Column, bits: int) -> Column:
    """PROBES bit positions of a row's digest."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), key), F.lit(bits)) for i in range(PROBES)])


def repeated_filter(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """First pass: the filter of slots that rows have hit at least twice, as (bucket, bitmap) of 32,768 bits each.

    A counting filter: hits are summed per slot in each task before the shuffle, so a hash that a third of all rows
    share costs one row a task. Every hash that occurs twice has all its slots in the filter.
    """
    hits = keys.select(F.explode(F.array_distinct(_slots(F.col(key), bits))).alias("_slot")).groupBy("_slot").agg(F.count("*").alias("_n"))
    return hits.filter("_n > 1").groupBy(F.expr("bitmap_bucket_number(_slot)").alias("_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_slot))").alias("_bits"))


def maybe_repeated(keys: DataFrame, key: str, repeated: DataFrame, bits: int) -> DataFrame:
    """Second pass: keys with a column _maybe. The filter, of at most MOST_BITS, is broadcast; no row is shuffled."""
    out = keys
    for i in range(PROBES):
        slot = F.pmod(F.xxhash64(F.lit(i), F.col(key)), F.lit(bits))
        found = repeated.select(F.col("_bucket").alias(f"_bucket{i}"), F.col("_bits").alias(f"_bits{i}"))
        out = out.withColumn(f"_slot{i}", slot).withColumn(f"_bucket{i}", F.expr(f"bitmap_bucket_number(_slot{i})")).withColumn(f"_at{i}", F.expr(f"bitmap_bit_position(_slot{i})"))
        out = out.join(F.broadcast(found), f"_bucket{i}", "left")
    hit = F.lit(True)
    for i in range(PROBES):
        byte = F.conv(F.hex(F.substring(F.col(f"_bits{i}"), (F.expr(f"_at{i} div 8") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        hit = hit & F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, cast(_at{i} % 8 as int))")) != 0, F.lit(False))
    return out.withColumn("_maybe", hit).drop(*[f"_{k}{i}" for k in ("slot", "bucket", "at", "bits") for i in range(PROBES)])


def filter_bits(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * max(1, n) - 1).bit_length()))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; empty texts equal each other. Of equal texts the row with the smallest id stays (a null
    id comes first); of rows that repeat that id, one is marked kept. Texts of any length are read whole. An empty table
    gives an empty result. Other columns are not read, so their names do not matter.
    """
    keys = written(docs.select(F.col(id_col).alias("_id"), digest(text_col).alias("_sha")))
    n = keys.count()
    bits = filter_bits(n)
    marked = maybe_repeated(keys, "_sha", written(repeated_filter(keys, "_sha", bits)), bits)
    alone = marked.filter("not _maybe").select("_id", "_sha", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_size"), F.lit(True).alias("_kept"))
    # rows that repeat an id and a text are one row with a count until the end
    rows = written(marked.filter("_maybe").groupBy("_id", "_sha").agg(F.count("*").alias("_m")))
    groups = written(rows.groupBy("_sha").agg(F.min(F.struct(F.col("_id"))).alias("_first"), F.sum("_m").alias("_size"), F.count("*").alias("_rows")))
    joined = lookup(rows, groups, ["_sha"], "_rows", max(1, n)).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m"))))
    again = joined.select("_id", "_sha", F.col("_first._id").alias("_keep"), "_size", (F.col("_id").eqNullSafe(F.col("_first._id")) & (F.col("_copy") == 1)).alias("_kept"))
    return alone.unionByName(again).select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, that with the smallest id; every column stays.

    Rows whose hash the filter shows but once pass straight through. Only the others are shuffled, and of those each
    task first keeps its own smallest row of a text.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), digest(text_col).alias("_sha"))
    keys = written(rows.select("_sha"))
    bits = filter_bits(keys.count())
    marked = maybe_repeated(rows, "_sha", written(repeated_filter(keys, "_sha", bits)), bits)
    least = marked.filter("_maybe").groupBy("_sha").agg(F.min_by("_row", F.struct(F.col(f"_row.`{id_col}`"), F.xxhash64("_row"))).alias("_row"))
    return marked.filter("not _maybe").select("_row.*").unionByName(least.select("_row.*"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
  row_number() OVER (PARTITION BY s ORDER BY doc_id) = 1 AS kept, s AS text_sha256 FROM t
"""
