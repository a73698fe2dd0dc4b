"""Metrics over a stream beside those of a batch."""

import random

from granary.operators.feedback import ops_metrics
from granary.streaming import ops

TRACES = "seq long, degraded boolean, failure_stage string, retrieval_count int, reply_rules_applied boolean, used_fallback_prompt boolean, answer_source string, latency_ms double"


def test_exact_metrics_after_every_batch(spark, tmp_path):
    """The last 50 of 400 traces that come in any order, in five batches: counts, mean and percentile equal the batch form each time."""
    rng = random.Random(3)
    rows = [(i, rng.choice([True, False, None]), rng.choice(["", "none", "generation", None]), rng.choice([0, 2, None]), rng.random() < 0.5, rng.random() < 0.5, rng.choice(["rag", "fallback", None]), rng.choice([None, round(rng.random() * 900, 1)])) for i in range(400)]
    rng.shuffle(rows)
    for k in range(5):
        spark.createDataFrame(rows[80 * k : 80 * k + 80], TRACES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    newest, seen = {}, []

    def take(batch, _):
        for r in batch.collect():
            newest[r.shard] = r
        got = ops.merged_metrics(spark.createDataFrame(list(newest.values()), batch.schema), 50).first()
        so_far = sum(r.request_count for r in newest.values())
        seen.append((so_far, got))

    stream = spark.readStream.schema(TRACES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = ops.running_shards(stream, 50, 3).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [n for n, _ in seen] == [80, 160, 240, 320, 400]
    for k, (_, got) in enumerate(seen, 1):
        assert tuple(got) == tuple(ops_metrics(spark.createDataFrame(rows[: 80 * k], TRACES), 50).first())
    assert all(len(r.seqs) <= 50 for r in newest.values())
