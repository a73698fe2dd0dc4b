"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import WORD, written

#: Weights of the sources in code-point order, null last, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Times its size that a source, and a document, is taken at most.
MOST = 3
SEED = 7
#: Ids of a bucket of equal sizes: a task ranks at most so many different ids of one source and size at once.
BUCKET = 1 << 14


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """_source, _size -> with _target: the share of all sizes by weight, no target over most times its source's size.

    Water-filling in closed form: in the order of size / weight the sources that stop at their bound come first, and
    the level of the others is what is left over the weights that are left. One row per source, so small.
    """
    one = F.lit(0)
    ranked = sources.withColumn("_k", F.row_number().over(Window.partitionBy(one).orderBy(F.col("_source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_k") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_bound", (F.col("_size") * most).cast("double")).withColumn("_ratio", F.col("_bound") / F.col("_weight"))
    up = Window.partitionBy(one).orderBy("_ratio", "_k")
    before, everything = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(one)
    left = F.sum("_size").over(everything) - F.coalesce(F.sum("_bound").over(before), F.lit(0.0))
    open_weight = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    level = ranked.withColumn("_level", left / open_weight)
    # the first source, in this order, that its level does not fill: its level holds for it and all after it
    final = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct(F.col("_ratio"), F.col("_k"), F.col("_level")))).over(everything)["_level"]
    return level.withColumn("_target", F.coalesce(F.least(F.col("_bound"), final * F.col("_weight")), F.col("_bound"))).select("_source", "_size", "_n", "_k", "_target")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, keep: bool = False) -> DataFrame:
    """One row per row of docs: _id, _size, _source_size, _target, _copies, and _row with all columns if keep.

    Each document of a source expects target / size copies. In the order of size (the longest first), then id, the
    expected copies are summed up, one offset for the source, drawn from the seed, is added, and a document is emitted
    once for each whole number that the sum crosses in it. Documents of alike size are neighbours, so what is taken
    differs from the target by at most about the longest document.

    The sum is a rank times the rate; ranks come from three counts (sizes of a source, buckets of ids of a size, rows
    of a bucket), so a source with a third of all rows is not sorted in one task. Null texts have size 0; a null
    source is a source, the last; repeated rows are ranked one after the other. Where a source has only empty texts,
    nothing is taken. An empty table gives an empty result.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), size_of(F.col(text_col)).alias("_size"), F.col(source_col).alias("_source"))
    if not keep:
        rows = written(rows.drop("_row"))
    rows = rows.withColumn("_null", F.col("_source").isNull()).withColumn("_source", F.coalesce("_source", F.lit(""))).withColumn("_bucket", F.coalesce(F.floor(F.col("_id") / BUCKET), F.lit(-(1 << 62))))
    cells = written(rows.groupBy("_null", "_source", "_size", "_bucket").agg(F.count("*").alias("_n")))
    of_size = cells.groupBy("_null", "_source", "_size").agg(F.sum("_n").alias("_n"))
    sources = of_size.groupBy("_null", "_source").agg(F.sum(F.col("_n") * F.col("_size")).alias("_size"), F.sum("_n").alias("_n"))
    aim = targets(sources.withColumn("_source", F.when(~F.col("_null"), F.col("_source"))), weights, most)
    aim = aim.select(F.col("_source").isNull().alias("_null"), F.coalesce("_source", F.lit("")).alias("_source"), F.col("_size").alias("_source_size"), "_target")
    # a uniform number in [0, 1) for each source
    draw = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("_null").cast("string"), "_source").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    aim = aim.withColumn("_rate", F.coalesce(F.try_divide(F.col("_target"), F.col("_source_size")), F.lit(0.0))).withColumn("_offset", draw)
    longer = Window.partitionBy("_null", "_source").orderBy(F.desc("_size")).rowsBetween(Window.unboundedPreceding, -1)
    of_size = of_size.withColumn("_longer", F.coalesce(F.sum("_n").over(longer), F.lit(0))).drop("_n").join(aim, ["_null", "_source"])
    smaller = Window.partitionBy("_null", "_source", "_size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("_smaller", F.coalesce(F.sum("_n").over(smaller), F.lit(0))).drop("_n").join(of_size, ["_null", "_source", "_size"])
    starts = starts.withColumn("_start", F.col("_longer") + F.col("_smaller")).drop("_longer", "_smaller")
    cell = Window.partitionBy("_null", "_source", "_size", "_bucket").orderBy("_id", *([F.xxhash64("_row")] if keep else []))
    ranked = rows.withColumn("_rank", F.row_number().over(cell)).join(starts, ["_null", "_source", "_size", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_start"))
    crossed = F.floor(F.col("_rank") * F.col("_rate") + F.col("_offset")) - F.floor((F.col("_rank") - 1) * F.col("_rate") + F.col("_offset"))
    ranked = ranked.withColumn("_copies", F.when(F.col("_size") > 0, F.least(crossed, F.lit(most))).otherwise(crossed))
    return ranked.select("_id", "_size", "_source_size", "_target", "_copies", *(["_row"] if keep else []))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' rows and columns, whatever their names, each row as often as it is taken, by the rules of copies: whole texts of any length, rows with null ids, texts or sources among them."""
    found = copies(docs, keep=True, **options).filter("_copies > 0")
    return found.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")


ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM t GROUP BY source),
fill(round, source, n, w, capped) AS (
  SELECT 0, source, n, w, false FROM s
  UNION ALL
  SELECT round + 1, source, n, w, capped OR (sum(n) OVER () - coalesce(sum(3.0 * n) FILTER (WHERE capped) OVER (), 0)) * w / coalesce(sum(w) FILTER (WHERE NOT capped) OVER (), 1) > 3.0 * n
  FROM fill WHERE round < 60),
f AS (SELECT * FROM fill WHERE round = 60),
aim AS (SELECT source, n, CASE WHEN capped THEN 3.0 * n ELSE (sum(n) OVER () - coalesce(sum(3.0 * n) FILTER (WHERE capped) OVER (), 0)) * w / sum(w) FILTER (WHERE NOT capped) OVER () END::DOUBLE AS target FROM f),
r AS (SELECT t.doc_id, t.size, a.n, a.target, CASE WHEN a.n > 0 THEN a.target / a.n ELSE 0.0 END AS rate,
  ('0x' || substr(md5(concat_ws('/', '7', CASE WHEN t.source IS NULL THEN 'true' ELSE 'false' END, coalesce(t.source, ''))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS o,
  row_number() OVER (PARTITION BY t.source ORDER BY t.size DESC, t.doc_id) AS k
  FROM t JOIN aim a ON t.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, n AS source_size, round(target, 4) AS target, size * (floor(k * rate + o) - floor((k - 1) * rate + o))::BIGINT AS taken FROM r
"""
