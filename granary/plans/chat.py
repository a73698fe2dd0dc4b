"""The whole answer to a batch of queries: retrieval, evidence, prompt, generation, composition, rules, trace, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.functions import fixed_values as fixed
from granary.functions import rules, text
from granary.operators import compose, context, grounding, retrieval
from granary.sources.readers import Settings


def answers(queries: DataFrame, kb: DataFrame, settings: Settings | None = None, generate=None, metadata: DataFrame | None = None, hints=rules.INTENT_HINTS, exclude_self: bool = False, model=None) -> DataFrame:
    """One row per query (query_id, query, q_embedding): reply, confidence_score, final_prompt, items, trace, grounding diagnostics.

    generate: a column function from prompt to reply, or to (reply, error) as providers.replies gives; null replies are
    failed generations. A query without a vector, as when its embedding failed, is a failed retrieval: it is answered
    from the fallback prompt. Composition and rules are expressions that do not raise, so they have no stage of failure.
    Without generate, the reply is empty before composition. metadata (query, expected_intent, expected_evidence_keywords, forbidden_keywords) is met by
    the exact query; else the first item's intent is expected.
    """
    s = settings or Settings()
    unfound = F.col("q_embedding").isNull()
    found = retrieval.search(queries.filter(~unfound), kb, min_score=s.min_vector_score, weight=s.model_rerank_weight, hints=hints, exclude_self=exclude_self, model=model)
    items = retrieval.items(found)
    used = context.prompts(queries, context.context_items(items))
    fields = [c for c in items.columns if c != "query_id"]
    gathered = items.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("retrieved_items"))
    rows = used.join(gathered, "query_id", "left").join(queries.select("query_id", unfound.alias("_unfound")), "query_id").withColumn("intent_hint", rules.intent_hint(F.col("query"), hints) if hints else F.lit(""))
    none = F.expr("slice(array(named_struct(" + ", ".join(f"'{n}', cast(null as {k})" for n, k in items.dtypes if n != "query_id") + ")), 1, 0)")
    rows = rows.withColumn("retrieved_items", F.coalesce("retrieved_items", none))
    first = F.get("retrieved_items", F.lit(0))
    fallback = F.col("context_items").isNull()
    rows = rows.withColumn("generated", generate("final_prompt") if generate is not None else F.lit(""))
    reason = F.lit("generation_failed")
    if isinstance(rows.schema["generated"].dataType, StructType):
        rows = rows.withColumns({"generated": F.col("generated.reply"), "_error": F.col("generated.error")})
        reason = F.concat_ws(": ", reason, "_error")
    failed, unfound = F.col("generated").isNull(), F.col("_unfound")
    rows = rows.withColumns({"_answer": text.text(first["answer"]), "_intent": text.text(first["intent"]), "_category": text.text(first["category"]), "_has": F.size("retrieved_items") > 0, "_reply": text.text("generated")})
    if s.answer_composer_enabled:
        rows = compose.compose(rows, "query", "_reply", "_answer", "_intent", F.col("_has"))
    else:
        rows = rows.withColumns({"composed_reply": F.col("_reply"), "composer_applied": F.lit(False), "composer_reason": F.lit("")})
    if s.reply_rules_enabled:
        rows = compose.reply_rules(rows, "query", "composed_reply", "_category", "_intent")
    else:
        rows = rows.withColumns({"ruled_reply": F.col("composed_reply"), "rules_applied": F.lit(False), "rules_trace": F.lit(None).cast("string")})
    rows = rows.withColumn("reply", F.when(failed, fixed.FALLBACK_REPLY).otherwise(F.col("ruled_reply")))
    rows = rows.withColumn("confidence_score", F.when(failed, 0.2).when(fallback, 0.5).otherwise(0.95))
    hinted = F.size(F.filter("retrieved_items", lambda x: x["retrieval_origin"] == retrieval.ORIGIN_HINT))
    matches = F.size(F.filter("retrieved_items", lambda x: (F.col("intent_hint") != "") & (x["intent"] == F.col("intent_hint"))))
    trace = F.struct(
        F.size("retrieved_items").alias("retrieval_count"),
        F.struct(F.col("intent_hint"), (F.col("intent_hint") != "").alias("intent_hint_applied"), (hinted > 0).alias("hint_supplement_added"), hinted.alias("hint_supplement_count"), matches.alias("hint_match_count")).alias("retrieval_trace"),
        fallback.alias("used_fallback_prompt"), F.lit(s.generation_provider).alias("generation_provider"), (F.col("composer_applied") & ~failed).alias("answer_composer_applied"), F.col("composer_reason").alias("answer_composer_reason"),
        (F.col("rules_applied") & ~failed).alias("reply_rules_applied"), F.col("rules_trace").alias("reply_rules_trace"), F.when(failed | fallback, "fallback").otherwise("rag").alias("answer_source"), (failed | unfound).alias("degraded"),
        F.when(failed, "generation").when(unfound, "retrieval").otherwise("none").alias("failure_stage"), F.when(failed, reason).when(unfound, "retrieval_failed: no vector").when(fallback, "no_retrieved_documents").otherwise("").alias("fallback_reason"), F.col("_intent").alias("top1_intent"),
    )
    rows = rows.withColumn("trace", trace)
    rows = rows.withColumn("retrieved_documents", F.transform(F.coalesce("context_items", F.expr("slice(context_items, 1, 0)")), lambda x: x["answer"]))
    rows = rows.withColumnRenamed("context_items", "prompt_context_items").drop("_answer", "_category", "_has", "_reply", "_unfound", "_error", "generated", "composed_reply", "ruled_reply", "composer_applied", "composer_reason", "answer_parts", "rules_applied", "rules_trace")
    lists = ("expected_evidence_keywords", "forbidden_keywords")
    if metadata is not None:
        known = metadata.select("query", F.col("expected_intent").alias("_expected"), *lists, F.lit(True).alias("_known")).dropDuplicates(["query"])
        rows = rows.join(known, "query", "left").withColumn("expected_intent", F.when(F.col("_known"), text.text("_expected")).otherwise(F.col("_intent"))).drop("_expected", "_known")
    else:
        rows = rows.withColumns({"expected_intent": F.col("_intent"), **{c: F.lit(None).cast("array<string>") for c in lists}})
    return grounding.classified(grounding.reports(rows.drop("_intent", "intent_hint")).withColumn("judge_status", F.lit("not_run")))


def masked_log(rows: DataFrame, query: str = "query") -> DataFrame:
    """(query, trace) for a log: private data in the query is masked."""
    return rows.select(text.masked(F.col(query)).alias("query"), "trace")


def session_rows(rows: DataFrame, request_id: Column, at: Column, latency_ms: float = 0.0) -> DataFrame:
    """Answers as rows of the sessions table; latency_ms is what the batch took."""
    return rows.select(request_id.alias("request_id"), "query", "reply", F.to_json("trace").alias("trace_json"), F.col("trace.top1_intent").alias("top1_intent"), F.lit(latency_ms).alias("latency_ms"), F.col("trace.answer_source").alias("answer_source"), at.alias("created_at"))
