"""Answers composed from the primary evidence, and reply rules over them. Every rule is a CASE; nothing leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import fixed_values as fixed
from granary.functions import rules, text

_NEEDS = {k: "q:" + "|".join(v) for k, v in fixed.QUERY_NEED_KEYWORDS.items()}
_UNREACHABLE = "q:联系不上|联系不到|打不通|电话不接|无法联系"
_ARRIVED = "q:定位|位置 & q:说到了|显示到了|说已到"
#: Steps that end the composition: condition and name of its texts, in order.
FINAL_STEPS = [
    (f"i=未收到餐 & {rules.GUARANTEE}", "missing_food_guarantee"),
    (f"i=退款进度 & {rules.GUARANTEE}", "refund_time_guarantee"),
    (f"i=退款金额咨询 & {rules.GUARANTEE}", "refund_amount_guarantee"),
    (f"i=延误补偿 & {rules.GUARANTEE}", "delay_guarantee"),
    (f"i=少送漏送 & {rules.GUARANTEE}", "missing_item_guarantee"),
    (f"i=食品安全投诉 & {rules.GUARANTEE}", "food_safety_guarantee"),
    (f"i=骑手态度投诉 & {rules.GUARANTEE}", "rider_guarantee"),
    (f"i=接单后取消 & {rules.GUARANTEE}", "cancel_guarantee"),
    ("i=优惠券不可用 & q:补我|补偿|赔", "coupon_compensation"),
    ("i=发票开具咨询", "invoice"),
    ("i=联系商家咨询 & q:帮我打|直接打|私下打|打给店家|打给商家 & q:退款|退钱|全款", "contact_for_refund"),
    ("i=联系商家咨询 & q:帮我打|直接打|私下打|打给店家|打给商家", "contact_by_call"),
    (f"i=配送异常追问 & {_UNREACHABLE}", "rider_unreachable"),
    ("i=隐私保护咨询 & q:商家 & q:手机号", "merchant_sees_phone"),
    (f"i=商家电话咨询 & {_NEEDS['safety_or_privacy_boundary']} & {_NEEDS['yes_no_request']} OR i=商家电话咨询 & q:直接发|店主电话", "merchant_phone"),
]
#: Steps that change all three texts and let later steps follow; of several the last holds.
EDIT_STEPS = [
    (f"i=退款金额咨询 & {_NEEDS['refund_dispute']} & q:没吃上|没收到|没用餐", "refund_not_eaten"),
    ("i=退款金额咨询 & q:配送费 & !q:合理吗", "delivery_fee"),
    ("i=退款金额咨询 & q:配送费 & q:合理吗", "delivery_fee_fairness"),
    ("i=备注未满足 & q:忌口 & !q:过敏|花生|葱|香菜", "remark_diet"),
    ("i=备注未满足 & q:香菜 & !q:过敏|花生|葱", "remark_coriander"),
    ("i=备注未满足 & q:葱 & !q:过敏|花生", "remark_scallion"),
    ("i=备注未满足 & q:过敏|花生", "remark_allergy"),
    (f"i=配送异常追问 & {_ARRIVED}", "rider_arrived_elsewhere"),
    ("i=未收到餐 & q:能退", "missing_food_refund"),
]
#: What is said where the evidence is empty.
EMPTY_PARTS = ("建议您先在订单详情页查看当前状态", "如果页面无法处理，可以联系平台客服核实", "具体结果以订单页面和平台处理结果为准")
#: Terms of the conclusion by what a query asks, in order of priority.
CONCLUSIONS = [
    ("q:可以吗|能不能|可以不|还能取消吗", ("不可以", "不建议", "可以", "取决于", "需要", "是否")),
    ("q:多久到账|多久退|什么时候到账|钱多久", ("到账时间", "支付渠道", "原路退回", "退款通常", "退款进度")),
    ("q:在哪里|哪里看|在哪看", ("订单详情页", "商家主页", "入口", "查看", "联系商家")),
]


def _parts(values: tuple[str, str, str]) -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in zip(("conclusion", "action", "caveat"), values, strict=True)])


def _first_with(sentences: Column, terms, *others: Column) -> Column:
    found = F.filter(sentences, lambda s: reduce(lambda a, o: a & (s != o), others, text.has_any(s, terms)))
    return F.get(found, F.lit(0))


def _by_intent(table: dict[str, str], intent: Column) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(intent == k, F.lit(v))
    return out.otherwise(F.lit(""))


def extracted_parts(df: DataFrame, query: str, answer: str) -> DataFrame:
    """df with _parts: the conclusion by the kind of query (else the first sentence), the first other sentence of an action, the first other of a caveat."""
    q = text.text(query)
    df = df.withColumn("_sentences", text.sentences(text.text(answer)))
    s = F.col("_sentences")
    boundary = rules.condition(f"{_NEEDS['safety_or_privacy_boundary']} & {_NEEDS['yes_no_request']}", {"q": q})
    conclusion = F.when(boundary, _first_with(s, fixed.BOUNDARY_TERMS))
    for rule, terms in CONCLUSIONS:
        conclusion = conclusion.when(rules.condition(rule, {"q": q}), _first_with(s, terms))
    df = df.withColumn("_conclusion", F.coalesce(conclusion.otherwise(_first_with(s, fixed.CONCLUSION_TERMS)), F.get(s, F.lit(0)), F.lit("")))
    df = df.withColumn("_action", F.coalesce(_first_with(s, fixed.ACTION_TERMS, F.col("_conclusion")), F.lit("")))
    df = df.withColumn("_caveat", F.coalesce(_first_with(s, fixed.CAVEAT_TERMS, F.col("_conclusion"), F.col("_action")), F.lit("")))
    found = F.struct(F.col("_conclusion").alias("conclusion"), F.col("_action").alias("action"), F.col("_caveat").alias("caveat"))
    return df.withColumn("_parts", F.when(F.size(s) == 0, _parts(EMPTY_PARTS)).otherwise(found)).drop("_sentences", "_conclusion", "_action", "_caveat")


def required_steps(df: DataFrame, query: str, intent: str) -> DataFrame:
    """df with _parts after the steps that an intent requires: a final step's texts, else the edits, required action and caveat, and the answer on the platform's own service."""
    fields = {"q": text.text(query), "i": text.text(intent)}
    i = fields["i"]
    texts = lambda name: _parts(fixed.STEPS[name])
    final = rules.first_match(FINAL_STEPS, fields, texts, F.lit(None))
    edit = rules.first_match(EDIT_STEPS[::-1], fields, texts, F.lit(None))
    df = df.withColumn("_final", final).withColumn("_edit", edit)
    conclusion = _by_intent(fixed.REQUIRED_CONCLUSIONS_BY_INTENT, i)
    df = df.withColumn("_now", F.coalesce("_edit", F.struct(F.when(conclusion != "", conclusion).otherwise(F.col("_parts.conclusion")).alias("conclusion"), F.col("_parts.action").alias("action"), F.col("_parts.caveat").alias("caveat"))))
    action, caveat = _by_intent(fixed.REQUIRED_ACTIONS_BY_INTENT, i), _by_intent(fixed.REQUIRED_CAVEATS_BY_INTENT, i)
    df = df.withColumn("_required", F.struct(action.alias("action"), caveat.alias("caveat")))
    completed = F.struct(F.col("_now.conclusion").alias("conclusion"), *[F.when((F.col(f"_required.{k}") != "") & ~F.col(f"_now.{k}").contains(F.col(f"_required.{k}")), F.col(f"_required.{k}")).otherwise(F.col(f"_now.{k}")).alias(k) for k in ("action", "caveat")])
    privacy = _parts((fixed.PLATFORM_PHONE_CONCLUSION, fixed.REQUIRED_ACTIONS_BY_INTENT["隐私保护咨询"], fixed.REQUIRED_CAVEATS_BY_INTENT["隐私保护咨询"]))
    platform = rules.condition("q:平台客服 & q:手机号", fields)
    return df.withColumn("_parts", F.coalesce("_final", F.when(platform, privacy).otherwise(completed))).drop("_final", "_edit", "_now", "_required")


def rendered(df: DataFrame) -> DataFrame:
    """df with _composed: the parts as sentences, without an action or caveat that repeats what stands before it."""
    c, a, v = F.col("_parts.conclusion"), F.col("_parts.action"), F.col("_parts.caveat")
    df = df.withColumn("_action", F.when(text.overlap(c, a), F.lit("")).otherwise(a))
    df = df.withColumn("_caveat", F.when(text.overlap(c, v) | text.overlap(F.col("_action"), v), F.lit("")).otherwise(v))
    return df.withColumn("_composed", F.concat(text.with_period(c), text.with_period(F.col("_action")), text.with_period(F.col("_caveat")))).drop("_action", "_caveat")


def needs_composer(query: Column, reply: Column, answer: Column) -> Column:
    """Whether a model's reply is of low quality: empty, short, an echo, generic, or without the evidence."""
    r, a = text.collapsed(reply), text.collapsed(answer)
    return (r == "") | (F.length(r) < 20) | text.echoes(query, r) | text.has_any(r, fixed.BAD_GENERIC_REPLIES) | ((a != "") & ~text.evidence_overlap(r, a))


def compose(df: DataFrame, query: str = "query", reply: str = "reply", answer: str = "answer", intent: str = "intent", present: Column | None = None) -> DataFrame:
    """df with composed_reply, composer_applied, composer_reason and answer_parts (before repeats are left out).

    present: whether the row has a primary item; without one the reply stays as it is.
    """
    has = F.lit(True) if present is None else present
    df = rendered(required_steps(extracted_parts(df, query, answer), query, intent))
    low = needs_composer(text.text(query), text.without_tails(text.text(reply)), text.text(answer))
    out = F.when(has, F.col("_composed")).otherwise(text.text(reply))
    return (
        df.withColumn("composed_reply", out).withColumn("composer_applied", has & (out != text.text(reply)))
        .withColumn("composer_reason", F.when(~has, "no_primary_item").when(low, "low_quality_model_reply").otherwise("structured_from_primary_evidence"))
        .withColumn("answer_parts", F.when(has, F.col("_parts"))).drop("_parts", "_composed")
    )


def reply_rules(df: DataFrame, query: str = "query", reply: str = "reply", category: str = "category", intent: str = "intent") -> DataFrame:
    """df with ruled_reply, rules_applied and rules_trace: three special cases, a refused guarantee, a forced reply, else the reply itself.

    The first rule with a keyword in query, category and intent is the matching one, so a query's words can win over the intent.
    """
    q, r, i = text.text(query), text.text(reply), text.text(intent)
    context = F.concat_ws(" ", q, text.text(category), i)
    none = F.lit(None)
    index, keyword, words, forced = F, F, F, F
    for k, (keywords, answer) in enumerate(fixed.REPLY_RULES, 1):
        hit = text.has_any(context, keywords)
        index, forced = index.when(hit, F.lit(k)), forced.when(hit, F.lit(answer))
        words = words.when(hit, F.array(*map(F.lit, keywords)))
        for word in keywords:
            keyword = keyword.when(context.contains(word), F.lit(word))
    df = df.withColumn("_rule", F.struct(index.otherwise(none).alias("rule_index"), keyword.otherwise(none).alias("matched_keyword"), words.otherwise(none).alias("rule_keywords"), forced.otherwise(F.lit("")).alias("reply")))
    is_forced = i.isin(*fixed.FORCED_INTENTS)
    fields = {"q": q, "i": i}
    special = rules.first_match([(f"i=配送异常追问 & {_ARRIVED}", fixed.SPECIAL_REPLIES[0]), ("i=未收到餐 & q:能退", fixed.SPECIAL_REPLIES[1]), ("i=退款失败 & q:付款失败|支付失败|扣了一次|扣了两次|重复扣款", fixed.SPECIAL_REPLIES[2])], fields, F.lit, none)
    refused = is_forced & rules.condition(rules.GUARANTEE, fields) & r.startswith("不能")
    out = F.coalesce(special, F.when(~refused & is_forced & (F.col("_rule.reply") != ""), F.col("_rule.reply")), r)
    trace = F.struct(F.col("_rule.rule_index").isNotNull().alias("matched"), F.col("_rule.rule_index").alias("rule_index"), F.col("_rule.matched_keyword").alias("matched_keyword"), F.col("_rule.rule_keywords").alias("rule_keywords"), text.text(category).alias("primary_category"), i.alias("primary_intent"), F.when(is_forced, "force").otherwise("pass_through").alias("mode"))
    return df.withColumn("rules_trace", trace).withColumn("ruled_reply", out).withColumn("rules_applied", F.col("ruled_reply") != r).drop("_rule")
