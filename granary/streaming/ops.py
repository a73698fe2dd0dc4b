"""Metrics of operation over a stream of traces."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.feedback import LATEST, flags, latency_metrics

#: Parts of the state of exact metrics, by a hash of seq: as many tasks share each batch.
SHARDS = 16
_STATE = "request_count long, failure_count long, empty_retrieval_count long, reply_rules_hit_count long, fallback_count long, seqs array<long>, latencies array<double>"


def running_counts(traces: DataFrame) -> DataFrame:
    """Counts over all traces so far; write in complete mode. The state is one row."""
    return traces.groupBy().agg(F.count("*").alias("request_count"), *[F.count_if(c).alias(n) for n, c in flags().items()])


def windowed_counts(traces: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts, mean and approximate 95th percentile of latencies for each window of ts; traces later than `late` are dropped with the state they would need."""
    w = traces.withWatermark("ts", late).groupBy(F.window("ts", width))
    return w.agg(F.count("*").alias("request_count"), *[F.count_if(c).alias(n) for n, c in flags().items()], F.avg("latency_ms").alias("average_latency_ms"), F.percentile_approx("latency_ms", 0.95).alias("p95_latency_ms"))


def running_shards(traces: DataFrame, latest: int = LATEST, shards: int = SHARDS) -> DataFrame:
    """(shard, counts, seqs, latencies) of each shard that a batch changes: counts over all its traces so far, and its `latest` by seq; write in update mode, then see merged_metrics.

    The state of a shard is keyed and bounded, whatever has passed: the latest of all traces are among the latest of the
    shards. Traces may come in any order. seq must be known, and tells traces apart.
    """
    names = list(flags())

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        old = list(state.get) if state.exists else [0] * (1 + len(names)) + [[], []]
        counts, last = list(old[: 1 + len(names)]), list(zip(old[-2], old[-1], strict=True))
        for batch in batches:
            counts[0] += len(batch)
            for k, name in enumerate(names, 1):
                counts[k] += int(batch[name].sum())
            last += zip(batch["seq"].astype(int).tolist(), batch["ms"].astype(float).tolist(), strict=True)
            last = sorted(last)[-latest:]
        seqs, ms = [s for s, _ in last], [x for _, x in last]
        state.update((*counts, seqs, ms))
        yield pd.DataFrame([[key[0], *counts, seqs, ms]], columns=["shard", "request_count", *names, "seqs", "latencies"])

    rows = traces.select(F.pmod(F.xxhash64("seq"), F.lit(shards)).cast("int").alias("shard"), F.col("seq").cast("long"), F.coalesce("latency_ms", F.lit(0.0)).cast("double").alias("ms"), *[c.alias(n) for n, c in flags().items()])
    return rows.groupBy("shard").applyInPandasWithState(update, f"shard int, {_STATE}", _STATE, "update", "NoTimeout")


def merged_metrics(shards: DataFrame, latest: int = LATEST) -> DataFrame:
    """The row that feedback.ops_metrics gives of all traces, from the newest row of each shard."""
    counts = shards.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("request_count", *flags())])
    each = shards.select(F.inline(F.arrays_zip("seqs", "latencies"))).toDF("seq", "latency_ms")
    return counts.join(latency_metrics(each, latest))
