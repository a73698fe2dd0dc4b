"""Evaluation runs: retrieval over cases, keyword hit rates, grounding of stored or new answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text
from granary.operators import grounding, places, retrieval
from granary.plans import chat


def retrieval_run(cases: DataFrame, kb: DataFrame, weight: float = retrieval.MODEL_WEIGHT, **options) -> DataFrame:
    """Cases (query_id, query, q_embedding, expected_intents, error_type) -> judgement, top_intents and impact of reranking of each; a case without results is a miss."""
    found = retrieval.search(cases, kb, weight=weight, **options)
    judged = grounding.rerank_impact(found.join(cases.select("query_id", "expected_intents"), "query_id"))
    out = cases.select("query_id", "query", "expected_intents", "error_type").join(judged, "query_id", "left")
    return out.withColumn("judgement", F.coalesce("judgement", F.lit("未命中"))).withColumn("impact", F.coalesce("impact", F.lit("unchanged"))).withColumn("top1_changed", F.coalesce("top1_changed", F.lit(False)))


def weight_sweep(cases: DataFrame, kb: DataFrame, weights: list[float], **options) -> DataFrame:
    """Summary of a run for each weight of the cross-encoder. The weights are few; each is one plan over the same hits."""
    runs = [retrieval_run(cases, kb, w, **options).withColumn("weight", F.lit(w)) for w in weights]
    whole = runs[0]
    for r in runs[1:]:
        whole = whole.unionByName(r)
    return grounding.retrieval_summary(whole, ["weight"])


def error_types(run: DataFrame) -> DataFrame:
    """(error_type, n) of the cases whose first result isn't right; blank types count as 未标注."""
    kind = F.when(text.text("error_type") == "", "未标注").otherwise(F.col("error_type"))
    return run.filter(F.col("judgement") != "Top1 命中").groupBy(kind.alias("error_type")).agg(F.count("*").alias("n"))


def bad_case_counts(run: DataFrame) -> DataFrame:
    kind = grounding.bad_case_type(text.text("judgement"))
    return run.agg(F.count_if(kind == "ranking_error").alias("ranking_error_count"), F.count_if(kind == "miss").alias("miss_count"))


def hit_rates(rows: DataFrame, answer: str = "answer", expected: str = "expected_keywords") -> DataFrame:
    """rows with matched_keywords, hit_rate (0 if nothing is expected) and band."""
    found = text.found_and_missing(text.text(answer), F.col(expected))[0]
    rows = rows.withColumn("matched_keywords", found)
    rows = rows.withColumn("hit_rate", F.when(F.size(expected) == 0, 0.0).otherwise(F.size("matched_keywords") / F.size(expected)))
    return rows.withColumn("band", grounding.hit_band(F.col("hit_rate")))


def hit_summary(rows: DataFrame) -> DataFrame:
    """Counts of the bands and the mean rate."""
    band = lambda b: F.count_if(F.col("band") == b)
    return rows.agg(F.count("*").alias("total"), band("OK").alias("ok"), band("部分命中").alias("partial"), band("弱命中").alias("weak"), band("未命中").alias("miss"), F.round(F.avg("hit_rate"), 4).alias("mean_hit_rate"))


def keyword_totals(rows: DataFrame, reply: str = "reply", keywords: str = "must_have_keywords") -> DataFrame:
    """(hits, total) of the words that replies must have."""
    found = text.found_and_missing(text.text(reply), F.col(keywords))[0]
    return rows.agg(F.coalesce(F.sum(F.size(found)), F.lit(0)).alias("hits"), F.coalesce(F.sum(F.size(keywords)), F.lit(0)).alias("total"))


def smoke_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"))


def by_position(queries: DataFrame, metadata: DataFrame) -> DataFrame:
    """Queries (pos, ...) with the metadata at the same position; missing metadata is empty."""
    extra = [c for c in metadata.columns if c not in queries.columns]
    return queries.join(metadata.select("pos", *extra), "pos", "left").na.fill("", [c for c, k in metadata.select(*extra).dtypes if k == "string"])


def grounding_run(cases: DataFrame, kb: DataFrame, raw_judge: Column | None = None, **options) -> DataFrame:
    """Cases (query_id, query, q_embedding and metadata by query) answered, reported, judged where raw_judge gives a judge's text, and classified."""
    rows = chat.answers(cases.select("query_id", "query", "q_embedding"), kb, metadata=cases, **options)
    if raw_judge is not None:
        rows = grounding.judged(rows.withColumn("raw_judge_response", raw_judge))
    return grounding.classified(rows)


def stored_run(cases: DataFrame, raw_judge: Column | None = None) -> DataFrame:
    """Reports of answers that are stored with their cases (query, reply and, as far as they were kept, retrieved_items, prompt_context_items, retrieved_documents, final_prompt, the metadata and a judge's text), judged where raw_judge gives one, and classified. No answer is made anew; what wasn't kept is empty."""
    item = "struct<rank: int, category: string, intent: string, question: string, answer: string>"
    used = "struct<role: string, intent: string, answer: string>"
    kept = {"retrieved_items": f"array<{item}>", "prompt_context_items": f"array<{used}>", "retrieved_documents": "array<string>", "expected_evidence_keywords": "array<string>", "forbidden_keywords": "array<string>", "final_prompt": "string", "expected_intent": "string", "reply": "string"}
    rows = cases.withColumns({c: F.lit(None).cast(k) for c, k in kept.items() if c not in cases.columns})
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)) for c in ("retrieved_items", "prompt_context_items")})
    rows = grounding.reports(rows).withColumn("judge_status", F.lit("not_run"))
    if raw_judge is not None:
        rows = grounding.judged(rows.withColumn("raw_judge_response", raw_judge))
    return grounding.classified(rows)


def run_config(spark, **settings) -> DataFrame:
    """(key, value) of a run's settings, in the order of their names, as config_diff compares them."""
    return spark.createDataFrame(sorted((k, "" if v is None else str(v)) for k, v in settings.items()), "key string, value string")


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows with pos by order."""
    return places.numbered(rows, [order])
