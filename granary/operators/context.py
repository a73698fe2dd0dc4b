"""Evidence for a prompt: distinct answers, roles, close matches, and the prompts' texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import fixed_values as fixed
from granary.functions import text

GAP, MOST = 0.08, 3
INSTRUCTIONS = {
    "close": "优先使用这条证据回答；但分数差距较小，避免引用辅助证据中的不同业务结论。",
    "primary": "优先使用这条证据回答用户问题。",
    "supporting": "只能补充流程、凭证、入口等通用信息，不能覆盖主证据的业务意图。",
}
LABELS = {"close": "最相关参考资料（与补充资料较接近，优先使用本条，不要混用其他意图结论）", "primary": "最相关参考资料", "supporting": "补充参考资料"}


def context_items(items: DataFrame, most: int = MOST, gap: float = GAP) -> DataFrame:
    """Items (query_id, rank, category, intent, question, answer, score, rerank_score) -> those that go into the prompt.

    The first of each answer, white space aside, and at most `most`; empty answers are left out. The first is primary,
    and a close match if the second is less than `gap` behind it. role, evidence_strength, display_title,
    evidence_summary, prompt_instruction and place (from 1) are added; question and answer of the source are kept as
    source_question and source_answer, and question and answer are what is shown.
    """
    rows = items.withColumn("_answer", text.collapsed(text.text("answer"))).filter("_answer <> ''")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "_answer").orderBy("rank"))).filter("_n = 1").drop("_n", "_answer")
    order = Window.partitionBy("query_id").orderBy("rank")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("_next", F.lead(text_score("rerank_score")).over(order)).filter(F.col("place") <= most)
    first = F.col("place") == 1
    close = first & F.col("_next").isNotNull() & (text_score("rerank_score") - F.col("_next") < gap)
    intent = F.when(text.text("intent") == "", "unknown").otherwise(text.text("intent"))
    title = F.when(first, F.concat(F.lit("主证据：优先按「"), intent, F.lit("」回答"))).otherwise(F.concat(F.lit("辅助证据：仅补充「"), intent, F.lit("」相关细节")))
    rows = rows.withColumns({
        "role": F.when(first, "primary").otherwise("supporting"), "evidence_strength": F.when(close, "close_match").otherwise("normal"), "display_title": title,
        "evidence_summary": text.shortened(text.text("answer")), "prompt_instruction": F.when(close, INSTRUCTIONS["close"]).when(first, INSTRUCTIONS["primary"]).otherwise(INSTRUCTIONS["supporting"]),
        "source_question": text.text("question"), "source_answer": text.text("answer"),
    })
    return rows.withColumn("question", F.col("display_title")).withColumn("answer", F.col("evidence_summary")).drop("_next")


def text_score(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def _or(*columns: Column) -> Column:
    out = F.lit("unknown")
    for c in reversed(columns):
        out = F.when(text.text(c) != "", c).otherwise(out)
    return out


def prompts(queries: DataFrame, context: DataFrame) -> DataFrame:
    """(query_id, query, context_items, final_prompt): the prompt from a query's items, or the fallback prompt where it has none."""
    label = F.when((F.col("role") == "primary") & (F.col("evidence_strength") == "close_match"), LABELS["close"]).when(F.col("role") == "primary", LABELS["primary"]).otherwise(LABELS["supporting"])
    block = F.concat_ws("\n", F.concat(F.col("rank").cast("string"), F.lit(". "), label), F.concat(F.lit("   title: "), "display_title"), F.concat(F.lit("   instruction: "), "prompt_instruction"), F.concat(F.lit("   intent: "), _or(F.col("intent"))), F.concat(F.lit("   question: "), _or(F.col("source_question"), F.col("question"))), F.concat(F.lit("   evidence_summary: "), F.when(F.col("evidence_summary") != "", F.col("evidence_summary")).otherwise(F.col("answer"))))
    fields = [c for c in ("place", "rank", "role", "evidence_strength", "display_title", "evidence_summary", "prompt_instruction", "source_question", "source_answer", "category", "intent", "question", "answer", "score", "rerank_score") if c in context.columns]
    gathered = context.withColumn("_block", block).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("context_items"), F.array_sort(F.collect_list(F.struct("place", "_block"))).alias("_blocks"))
    rows = queries.select("query_id", text.text("query").alias("query")).join(gathered, "query_id", "left")
    head, tail = fixed.PROMPT_HEAD, fixed.PROMPT_TAIL
    at = len(head) - 2
    full = F.concat_ws("\n", F.lit("\n".join(head[:at])), "query", F.lit("\n".join(head[at:])), F.array_join(F.transform("_blocks", lambda b: b["_block"]), "\n"), F.lit("\n".join(tail)))
    return rows.withColumn("final_prompt", F.when(F.col("_blocks").isNull(), F.concat(F.lit(fixed.FALLBACK_PROMPT), "query")).otherwise(full)).drop("_blocks")


def judge_prompt(query: Column, documents: Column, reply: Column) -> Column:
    numbered = F.array_join(F.transform(documents, lambda d, i: F.concat((i + 1).cast("string"), F.lit(". "), d)), "\n")
    p = fixed.JUDGE_PROMPT_PARTS
    return F.concat(F.lit(p[0]), query, F.lit(p[1]), numbered, F.lit(p[2]), reply, F.lit(p[3]))


def plan_prompt(query: Column, documents: Column) -> Column:
    numbered = F.transform(documents, lambda d, i: F.concat((i + 1).cast("string"), F.lit(". "), d))
    head, tail = fixed.PLAN_PROMPT_HEAD, fixed.PLAN_PROMPT_TAIL
    at = len(head) - 2
    lines = F.concat(F.array(*map(F.lit, head[:at])), F.array(query), F.array(*map(F.lit, head[at:])), numbered, F.array(*map(F.lit, tail)))
    return F.array_join(lines, "\n")
