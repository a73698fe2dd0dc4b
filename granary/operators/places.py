"""Places of rows in an order, from counts of the parts of a sort: no window holds all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.scratch import written

#: Bits of a number from monotonically_increasing_id that count rows within a partition.
ROWS = 33


def from_parts(rows: DataFrame, number: str, name: str = "pos", start: int = 0) -> DataFrame:
    """rows with `name` in place of `number`, a monotonically_increasing_id of partitions that follow the order. The counts of partitions, one row for each, are summed up and joined; they are no part of the plan's expressions."""
    part = F.shiftrightunsigned(number, ROWS)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
    starts, at = [], start
    for r in counts:
        starts.append((r._part, at))
        at += r.n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part long, _start long"))
    return rows.withColumn("_part", part).join(offsets, "_part").withColumn(name, F.col("_start") + F.col(number).bitwiseAND(F.lit((1 << ROWS) - 1))).drop("_part", "_start", number)


def numbered(rows: DataFrame, order: list[Column | str], name: str = "pos", start: int = 0) -> DataFrame:
    """rows with their place, from `start`, in an order: one sort by ranges, whose result is a table, and one count for each range."""
    return from_parts(written(rows.orderBy(*order).withColumn("_number", F.monotonically_increasing_id())), "_number", name, start)
