"""Chat sessions and feedback on them, and metrics of operation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text

TRACE = "top1_intent string, latency_ms double, answer_source string, failure_stage string"
UNKNOWN_INTENT = "待人工确认"
LATEST = 1000


def upsert(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """Sessions with the rows of new in place of those with the same request_id; blank ids are left out; of several of an id the last by created_at holds."""
    rows = sessions.withColumn("_new", F.lit(0)).unionByName(new.filter(text.trimmed(text.text("request_id")) != "").withColumn("_new", F.lit(1)))
    last = Window.partitionBy("request_id").orderBy(F.desc("_new"), F.desc("created_at"))
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select(*sessions.columns)


def feedback_rows(payloads: DataFrame) -> DataFrame:
    """Payloads (id, request_id, query, reply, helpful, reason, expected_reply, trace_json, created_at) with the four fields of their trace as columns."""
    t = F.from_json(text.text("trace_json"), TRACE)
    return payloads.withColumns({"top1_intent": text.text(t["top1_intent"]), "latency_ms": F.coalesce(t["latency_ms"], F.lit(0.0)), "answer_source": text.text(t["answer_source"]), "failure_stage": text.text(t["failure_stage"]), "exported": F.lit(False)})


def recent(feedback: DataFrame, limit: int = 20, helpful: bool | None = None, intent: str | None = None, failure_stage: str | None = None) -> DataFrame:
    """The newest rows; None is no filter."""
    if not 1 <= limit <= 100:
        raise ValueError("limit is 1 to 100")
    if helpful is not None:
        feedback = feedback.filter(F.col("helpful") == helpful)
    for name, value in (("top1_intent", intent), ("failure_stage", failure_stage)):
        if value:
            feedback = feedback.filter(F.col(name) == value)
    return feedback.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def eval_cases(feedback: DataFrame, strict: bool = False) -> DataFrame:
    """Drafts of evaluation cases. Their case_type is 'feedback', which the loader of cases rejects; strict gives 'baseline'."""
    none = F.array().cast("array<string>")
    return feedback.select(
        F.concat(F.lit("feedback_"), "id").alias("id"), F.lit("feedback_bad_case").alias("scenario"), F.lit("baseline" if strict else "feedback").alias("case_type"), "query",
        F.when(text.text("top1_intent") == "", UNKNOWN_INTENT).otherwise(F.col("top1_intent")).alias("expected_intent"), none.alias("expected_evidence_keywords"), none.alias("forbidden_keywords"),
        F.concat(F.lit("reason="), text.text("reason"), F.lit("; expected_reply="), text.text("expected_reply")).alias("notes"),
    )


def exported(feedback: DataFrame, feedback_id: int) -> tuple[DataFrame, DataFrame]:
    """(the case of a row, feedback with that row marked)."""
    row = feedback.filter(F.col("id") == feedback_id)
    if row.isEmpty():
        raise KeyError(f"feedback not found: {feedback_id}")
    return eval_cases(row), feedback.withColumn("exported", F.when(F.col("id") == feedback_id, True).otherwise(F.col("exported")))


def flags() -> dict[str, Column]:
    """What a trace counts as. An absent failure_stage counts as a failure."""
    stage = F.col("failure_stage")
    return {
        "failure_count": F.coalesce("degraded", F.lit(False)) | stage.isNull() | ~stage.isin("", "none"),
        "empty_retrieval_count": F.coalesce("retrieval_count", F.lit(0)) == 0,
        "reply_rules_hit_count": F.coalesce("reply_rules_applied", F.lit(False)),
        "fallback_count": F.coalesce("used_fallback_prompt", F.lit(False)) | (text.text("answer_source") == "fallback"),
    }


def ops_metrics(traces: DataFrame, latest: int = LATEST) -> DataFrame:
    """One row: counts over all traces (seq, degraded, failure_stage, retrieval_count, reply_rules_applied, used_fallback_prompt, answer_source, latency_ms), mean and 95th percentile of the latest by seq.

    The percentile is the element at int(0.95 n), at most the last, of the sorted latencies. The latest are found by a
    top-k, so no task sorts all traces.
    """
    counts = traces.agg(F.count("*").alias("request_count"), *[F.count_if(c).alias(n) for n, c in flags().items()])
    return counts.crossJoin(latency_metrics(traces, latest))  # one row by one row


def latency_metrics(traces: DataFrame, latest: int = LATEST) -> DataFrame:
    """One row: mean and 95th percentile of the latencies of the latest traces (seq, latency_ms)."""
    last = traces.orderBy(F.desc("seq")).limit(latest).select(F.coalesce("latency_ms", F.lit(0.0)).alias("ms")).agg(F.sort_array(F.collect_list("ms")).alias("all"))
    n = F.size("all")
    mean = F.aggregate("all", F.lit(0.0), lambda a, x: a + x) / n
    p95 = F.get("all", F.least(F.floor(n * 0.95).cast("int"), n - 1))
    return last.select(F.when(n == 0, 0.0).otherwise(F.round(mean, 2)).alias("average_latency_ms"), F.when(n == 0, 0.0).otherwise(F.round(p95, 2)).alias("p95_latency_ms"))
