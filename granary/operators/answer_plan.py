"""Answer plans: JSON of a model, checked, normalised and rendered; errors are values, not exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import fixed_values as fixed
from granary.functions import text

BRIEF = 32
#: What an action needs not say, in order, and what it says if nothing is left.
CUT = ("相关结果以页面展示和平台处理为准", "相关结果以页面展示为准", "具体结果以页面展示为准", "请您", "您可以")
DEFAULT_ACTION = "查看订单页退款进度"
END = "具体结果请以订单页面展示或平台核实结果为准。"
STRINGS = ("user_intent", "answer_type", "direct_answer_brief", "action_suggestion", "caution_reason")


def json_object(c: Column) -> Column:
    """From the first { to the last }; null without."""
    return F.nullif(F.regexp_extract(text.text(c), r"(?s)\{.*\}", 0), F.lit(""))


def brief(c: Column) -> Column:
    """The first clause, or the first 32 characters without marks at the end."""
    plain = text.trimmed(c)
    out = F.when(F.length(plain) <= BRIEF, plain).otherwise(F.regexp_replace(F.substring(plain, 1, BRIEF), "[，；。 ]+$", ""))
    for mark in ("。", "；", "，"):
        at = F.position(F.lit(mark), plain)
        head = text.trimmed(F.substring(plain, F.lit(1), at - 1))
        out = F.when((at > 1) & (head != ""), head).otherwise(out)
    return out


def action(c: Column) -> Column:
    out = F.regexp_replace(text.trimmed(c), "。+$", "")
    for word in CUT:
        out = F.replace(out, F.lit(word), F.lit(""))
    out = F.regexp_replace(out, "^[，,；;。 ]+|[，,；;。 ]+$", "")
    return F.when(out == "", DEFAULT_ACTION).otherwise(out)


def parsed(df: DataFrame, raw: str = "raw_output") -> DataFrame:
    """df with parse_error and plan. An empty reason of a needed caution is repaired; every other fault is an error."""
    body = json_object(F.col(raw))
    df = df.withColumn("_v", F.try_parse_json(body))
    kind = lambda f: F.coalesce(F.schema_of_variant(F.try_variant_get("_v", f"$.{f}", "variant")), F.lit("absent"))
    s = lambda f: F.coalesce(F.try_variant_get("_v", f"$.{f}", "string"), F.lit(""))
    keys = F.coalesce(F.map_keys(F.from_json(body, "map<string,string>")), F.array().cast("array<string>"))
    missing = F.get(F.filter(F.array(*map(F.lit, fixed.PLAN_FIELDS)), lambda f: ~F.array_contains(keys, f)), F.lit(0))
    evidence = F.try_variant_get("_v", "$.key_evidence", "array<string>")
    listed = kind("key_evidence").startswith("ARRAY")
    error = F.when(text.trimmed(text.text(raw)) == "", "Answer plan output is empty").when(body.isNull(), "Answer plan output does not contain a JSON object").when(F.col("_v").isNull(), "not JSON").when(missing.isNotNull(), F.concat(F.lit("Answer plan missing field: "), missing))
    for f in STRINGS:
        error = error.when(kind(f) != "STRING", f"{f} must be a string")
    for f in STRINGS[:-1]:
        error = error.when(text.trimmed(s(f)) == "", f"{f} must be a non-empty string")
    error = error.when(~listed | (F.coalesce(F.size(evidence), F.lit(0)) <= 0), "key_evidence must be a non-empty list")
    error = error.when((kind("key_evidence") != "ARRAY<STRING>") | F.exists(evidence, lambda e: e.isNull() | (text.trimmed(text.text(e)) == "")), "key_evidence items must be non-empty strings")
    error = error.when(kind("needs_caution") != "BOOLEAN", "needs_caution must be a boolean").otherwise("")
    df = df.withColumn("parse_error", error)
    needs = F.coalesce(F.try_variant_get("_v", "$.needs_caution", "boolean"), F.lit(False))
    reason = text.trimmed(s("caution_reason"))
    plan = F.struct(
        text.trimmed(s("user_intent")).alias("user_intent"), text.trimmed(s("answer_type")).alias("answer_type"), brief(s("direct_answer_brief")).alias("direct_answer_brief"),
        F.transform(evidence, lambda e: F.regexp_replace(text.trimmed(e), "。+$", "")).alias("key_evidence"), action(s("action_suggestion")).alias("action_suggestion"), needs.alias("needs_caution"),
        F.when(needs & (reason == ""), fixed.PLAN_CAUTION).otherwise(reason).alias("caution_reason"),
    )
    return df.withColumn("plan", F.when(F.col("parse_error") == "", plan)).drop("_v")


def debug_reply(plan: Column) -> Column:
    evidence = F.array_join(F.slice(plan["key_evidence"], 1, 2), "；")
    lines = [plan["direct_answer_brief"], F.when(evidence != "", F.concat(F.lit("参考依据："), evidence, F.lit("。"))), F.when(plan["action_suggestion"] != "", F.concat(F.lit("建议您"), plan["action_suggestion"], F.lit("。"))), F.when(plan["needs_caution"] & (plan["caution_reason"] != ""), F.concat(F.lit("这类问题需要保守处理，原因是："), plan["caution_reason"], F.lit("。"))), F.when(plan["needs_caution"], F.lit(END))]
    return F.when(plan.isNotNull(), F.array_join(F.array_compact(F.array(*lines)), "\n")).otherwise("")


def user_reply(plan: Column) -> Column:
    a = plan["action_suggestion"]
    said = F.when(a.startswith("请") | a.startswith("建议"), a).otherwise(F.concat(F.lit("建议您"), a))
    lines = [plan["direct_answer_brief"], F.when(a != "", F.concat(said, F.lit("。"))), F.when(plan["needs_caution"], F.lit(END))]
    return F.when(plan.isNotNull(), F.array_join(F.array_compact(F.array(*lines)), "\n")).otherwise("")
