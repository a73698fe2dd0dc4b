"""Grounding of replies: reports, judges' answers and their calibration, causes of failure, metrics, comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import fixed_values as fixed
from granary.functions import rules, text

SCORES = ("direct_answer", "grounded", "useful")
LEVELS = ("yes", "partial", "no", "empty")
EMPTY = F.array


def _list(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>"))


def _sentences(answer: Column) -> Column:
    """Match keys of an answer's sentences."""
    parts = F.split(F.translate(answer, "？！.", "。。。"), "。")
    return F.filter(F.transform(parts, text.match_key), lambda s: s != "")


def used_primary(reply: Column, items: Column) -> Column:
    """Whether a reply contains a sentence of the primary item; items: array of structs with role, intent, answer."""
    key = text.match_key(reply)
    first = F.get(F.filter(items, lambda x: x["role"] == "primary"), F.lit(0))
    return F.coalesce((key != "") & F.exists(_sentences(text.text(first["answer"])), lambda s: key.contains(s)), F.lit(False))


def mixed_intent(reply: Column, items: Column) -> Column:
    """Whether a reply contains a sentence of a supporting item with another intent than the primary's."""
    key = text.match_key(reply)
    first = F.get(F.filter(items, lambda x: x["role"] == "primary"), F.lit(0))
    intent = text.trimmed(text.text(first["intent"]))
    other = lambda x: (x["role"] != "primary") & (text.trimmed(text.text(x["intent"])) != "") & (text.trimmed(text.text(x["intent"])) != intent)
    return F.coalesce((intent != "") & (key != "") & F.exists(items, lambda x: other(x) & F.exists(_sentences(text.text(x["answer"])), lambda s: key.contains(s))), F.lit(False))


def reports(answers: DataFrame) -> DataFrame:
    """Answers (query, reply, retrieved_documents, retrieved_items, prompt_context_items, final_prompt, expected_intent, expected_evidence_keywords, forbidden_keywords, ...) with what a report says of them. Missing lists are empty."""
    reply = text.text("reply")
    matched, missing = text.found_and_missing(reply, _list("expected_evidence_keywords"))
    items = F.col("prompt_context_items")
    return answers.withColumns({
        "expected_intent": text.text("expected_intent"), "expected_evidence_keywords": _list("expected_evidence_keywords"), "forbidden_keywords": _list("forbidden_keywords"), "retrieved_documents": _list("retrieved_documents"),
        "matched_evidence_keywords": matched, "missing_evidence_keywords": missing, "forbidden_keyword_hits": text.forbidden_hits(reply, _list("forbidden_keywords")),
        "retrieved_document_count": F.size(_list("retrieved_documents")), "used_primary_evidence": used_primary(reply, items), "mixed_supporting_intent": mixed_intent(reply, items),
        "risky_promises": text.promises(reply), "needs_manual_review": F.size(text.promises(reply)) > 0,
        "manual_judgment": F.struct(*[F.lit("").alias(f) for f in (*SCORES, "notes")]),
    })


def top1_intent(items: Column) -> Column:
    return F.coalesce(F.get(items, F.lit(0))["intent"], F.lit(""))


def judge_score(c: Column) -> Column:
    """A judge's score in one of its spellings."""
    plain = F.lower(text.trimmed(c))
    return F.when(plain.isin("yes", "y", "true"), "yes").when(plain.isin("partial", "part"), "partial").when(plain.isin("no", "n", "false"), "no").otherwise(plain)


def parsed_judgement(df: DataFrame, raw: str = "raw_judge_response") -> DataFrame:
    """df with judge_status, judge_error, judge_failure_type and judge_result (the scores, risk_notes, reason)."""
    r = text.text(raw)
    df = df.withColumn("_json", F.when(text.trimmed(r) == "", F.lit(None)).otherwise(F.try_parse_json(r)))
    fields = [F.coalesce(F.try_variant_get("_json", f"$.{f}", "string"), F.lit("None")) for f in fixed.JUDGE_REQUIRED_FIELDS]
    there = F.from_json(r, "map<string,string>", {"mode": "PERMISSIVE"})
    keys = F.coalesce(F.map_keys(there), F.array().cast("array<string>"))
    missing = F.get(F.filter(F.array(*map(F.lit, fixed.JUDGE_REQUIRED_FIELDS)), lambda f: ~F.array_contains(keys, f)), F.lit(0))
    scores = {f: judge_score(fields[k]) for k, f in enumerate(SCORES)}
    wrong = F.get(F.filter(F.array(*[F.struct(F.lit(f).alias("f"), s.alias("s")) for f, s in scores.items()]), lambda x: ~x["s"].isin("yes", "partial", "no")), F.lit(0))
    reason = F.when(text.trimmed(fields[4]) == "", "judge returned valid scores without reason").otherwise(fields[4])
    empty, broken = text.trimmed(r) == "", F.col("_json").isNull()
    error = F.when(empty, "Judge response is empty").when(broken, "not JSON").when(missing.isNotNull(), F.concat(F.lit("Judge response missing field: "), missing)).when(wrong.isNotNull(), F.concat(F.lit("Invalid judge score for "), wrong["f"], F.lit(": "), wrong["s"])).otherwise("")
    kind = F.when(empty, "empty_response").when(broken, "not_json").when(missing.isNotNull(), "missing_field").when(wrong.isNotNull(), "invalid_enum").otherwise("")
    df = df.withColumn("judge_error", error).withColumn("judge_failure_type", kind).withColumn("judge_status", F.when(F.col("judge_error") == "", "succeeded").otherwise("failed"))
    result = F.struct(*[s.alias(f) for f, s in scores.items()], fields[3].alias("risk_notes"), reason.alias("reason"))
    return df.withColumn("judge_result", F.when(F.col("judge_status") == "succeeded", result)).drop("_json")


def calibrated(df: DataFrame, result: str = "judge_result") -> DataFrame:
    """df with the result relaxed by every rule that fits: scores of no, for most rules of partial too, become yes; each rule appends its reason."""
    fields = {"q": text.text("query"), "r": text.text("reply"), "i": text.text("expected_intent"), "d": F.array_join(_list("retrieved_documents"), "\n")}
    hits = [rules.condition(rule, fields) for _, _, rule in rules.CALIBRATION]
    df = df.withColumn("_hits", F.array(*hits))
    part = F.exists(F.slice("_hits", 3, len(hits)), lambda h: h)
    full = F.exists("_hits", lambda h: h)
    score = lambda f: F.when(full & (F.col(f"{result}.{f}") == "no"), "yes").when(part & (F.col(f"{result}.{f}") == "partial"), "yes").otherwise(F.col(f"{result}.{f}"))
    reasons = F.array_compact(F.array(*[F.when(F.get("_hits", F.lit(k)), F.lit(r)) for k, r in enumerate(fixed.CALIBRATION_REASONS)]))
    reason = F.when(full, text.trimmed(F.concat_ws(" ", text.text(f"{result}.reason"), F.array_join(reasons, " ")))).otherwise(F.col(f"{result}.reason"))
    names = F.transform(F.filter(F.transform("_hits", lambda h, k: F.struct(h.alias("h"), F.element_at(F.array(*[F.lit(n) for n, _, _ in rules.CALIBRATION]), k + 1).alias("n"))), lambda x: x["h"]), lambda x: x["n"])
    made = F.struct(*[score(f).alias(f) for f in SCORES], F.col(f"{result}.risk_notes").alias("risk_notes"), reason.alias("reason"))
    return df.withColumn("calibrations", names).withColumn(result, F.when(F.col(result).isNotNull(), made)).drop("_hits")


def applied(df: DataFrame, result: str = "judge_result") -> DataFrame:
    """df with manual_judgment from the judge's result, where there is one."""
    notes = F.concat(F.lit("风险提示："), text.text(f"{result}.risk_notes"), F.lit(" 判断理由："), text.text(f"{result}.reason"))
    return df.withColumn("manual_judgment", F.when(F.col(result).isNotNull(), F.struct(*[F.col(f"{result}.{f}").alias(f) for f in SCORES], notes.alias("notes"))).otherwise(F.col("manual_judgment")))


def judged(df: DataFrame, raw: str = "raw_judge_response") -> DataFrame:
    return applied(calibrated(parsed_judgement(df, raw)))


def judge_reason(notes: Column) -> Column:
    marker = "判断理由："
    at = F.position(F.lit(marker), notes)
    return text.trimmed(F.when(at > 0, F.substring(notes, at + len(marker), F.length(notes))).otherwise(notes))


def guessed_intents(documents: Column) -> Column:
    words = ("退款", "超时", "食品安全", "异物", "私下转账", "优惠券", "骑手", "手机号", "撒漏", "商家拒绝")
    found = lambda d: F.array_join(F.filter(F.array(*map(F.lit, words)), lambda w: d.contains(w)), "/")
    return F.transform(documents, lambda d: F.when(found(d) == "", "unrecognized").otherwise(found(d)))


def classified(df: DataFrame) -> DataFrame:
    """df with is_bad, issue_type, suggested_layer, attribution and sub_attribution of each report."""
    j = lambda f: text.text(F.col("manual_judgment")[f])
    status, n_items = text.text("judge_status"), F.coalesce(F.size("retrieved_items"), F.lit(0))
    none, risky = n_items <= 0, F.size(_list("risky_promises")) > 0
    bad = (j("direct_answer") != "yes") | (j("grounded") != "yes") | (j("useful") != "yes")
    indirect, weak = j("direct_answer").isin("no", "partial"), j("grounded").isin("no", "partial")
    issue = F.when(none, "retrieval_bad").when(risky, "safety_overclaim").when(j("grounded") == "no", "generation_not_grounded").when(indirect, "generation_not_direct").when(j("grounded") == "partial", "generation_not_grounded").otherwise("judge_or_other")
    used, mixed = F.coalesce("used_primary_evidence", F.lit(False)), F.coalesce("mixed_supporting_intent", F.lit(False))
    layer = (
        F.when(status == "failed", "judge").when(~bad, "pass").when(none, "retrieval").when(text.text("final_prompt") == "", "context_builder").when(mixed, "context_builder_or_reply_rules").when(risky, "reply_rules")
        .when(used & (j("grounded") == "no"), "judge").when(~used, "generation_or_reply_rules").when(indirect, "generation_or_reply_rules").otherwise("judge")
    )
    absent = F.exists(_list("missing_evidence_keywords"), lambda w: ~F.exists(_list("retrieved_documents"), lambda d: d.contains(w)))
    expected = text.text("expected_intent")
    cause = (
        F.when(~bad, "pass").when(status == "failed", "judge").when(none, "retrieval_failure").when((expected != "") & (top1_intent(F.col("retrieved_items")) != expected), "retrieval_failure")
        .when(absent, "evidence_insufficient").when(weak | indirect | risky, "generation_not_using_evidence").otherwise("judge_or_other")
    )
    df = df.withColumns({"is_bad": bad, "issue_type": issue, "suggested_layer": layer, "attribution": cause, "_reason": judge_reason(j("notes"))})
    said = F.exists(_list("missing_evidence_keywords"), lambda w: text.text("reply").contains(w))
    r = F.col("_reason")
    sub = (
        F.when(F.col("attribution") != "generation_not_using_evidence", "").when((j("direct_answer") == "yes") & (j("useful") == "yes") & (j("grounded") == "no"), "judge_too_strict")
        .when(indirect & j("grounded").isin("yes", "partial"), "reply_not_direct_enough").when(said, "evidence_wording_mismatch").when(r.contains("参考文档没有明确") | r.contains("参考文档未明确"), "evidence_wording_mismatch")
        .when(r.contains("未明确"), "reply_missing_required_step").otherwise("reply_not_direct_enough")
    )
    return df.withColumn("sub_attribution", sub).drop("_reason")


def rate(n: Column, of: Column) -> Column:
    return F.when(of == 0, 0.0).otherwise(F.round(n / of, 4))


def summary(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of reports: reviews, use of evidence, judges' states and failures, and scores of each kind, in one pass."""
    status = F.when(text.text("judge_status").isin("succeeded", "failed"), F.col("judge_status")).otherwise("not_run")
    kind = F.when(text.text("judge_failure_type").isin(*fixed.JUDGE_FAILURE_TYPES), F.col("judge_failure_type")).otherwise("other")
    score = lambda f: F.when(text.text(F.col("manual_judgment")[f]).isin(*LEVELS), F.col("manual_judgment")[f]).otherwise("empty")
    counts = [F.count("*").alias("total"), *[F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(n) for c, n in (("needs_manual_review", "manual_review_count"), ("used_primary_evidence", "used_primary_evidence_count"), ("mixed_supporting_intent", "mixed_supporting_intent_count"))]]
    counts += [F.count_if(status == s).alias(f"judge_{s}") for s in ("succeeded", "failed", "not_run")]
    counts += [F.count_if((status == "failed") & (kind == k)).alias(f"failure_{k}") for k in fixed.JUDGE_FAILURE_TYPES]
    counts += [F.count_if(score(f) == v).alias(f"{f}_{v}") for f in SCORES for v in LEVELS]
    return df.groupBy(*(by or [])).agg(*counts)


def metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rates of a run: top-1 intents, coverage of evidence words, forbidden words, judges' passes; rates of nothing are 0."""
    expected = text.text("expected_intent")
    asked = expected != ""
    size = lambda c: F.coalesce(F.sum(F.size(_list(c))), F.lit(0))
    passed = F.lit(True)
    for f in SCORES:
        passed = passed & (text.text(F.col("manual_judgment")[f]) == "yes")
    found = df.groupBy(*(by or [])).agg(
        F.count("*").alias("total_cases"), F.count_if(asked).alias("expected_intent_case_count"), F.count_if(asked & (top1_intent(F.col("retrieved_items")) == expected)).alias("top1_intent_hit_count"),
        size("matched_evidence_keywords").alias("matched_evidence_keyword_count"), size("expected_evidence_keywords").alias("expected_evidence_keyword_count"), size("forbidden_keyword_hits").alias("forbidden_hit_count"), F.count_if(passed).alias("judge_pass_count"),
    )
    return found.withColumns({
        "top1_intent_hit_rate": rate(F.col("top1_intent_hit_count"), F.col("expected_intent_case_count")), "evidence_keyword_coverage": rate(F.col("matched_evidence_keyword_count"), F.col("expected_evidence_keyword_count")),
        "judge_pass_rate": rate(F.col("judge_pass_count"), F.col("total_cases")),
    })


def histogram(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """(<column>, n) of its non-empty values."""
    rows = df if where is None else df.filter(where)
    return rows.filter(text.text(column) != "").groupBy(column).agg(F.count("*").alias("n"))


def fixed_counts(df: DataFrame, values: Column, keys: list[str], other: str | None = None, where: Column | None = None) -> DataFrame:
    """(place, key, n) for each of some keys, in their order, those without rows with 0; other: the key that all other values count as, else they are left out."""
    rows = df if where is None else df.filter(where)
    key = F.when(values.isin(*keys), values).otherwise(F.lit(other))
    wide = rows.agg(*[F.count_if(key == k).alias(f"_{i}") for i, k in enumerate(keys)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("key"), F.col(f"_{i}").alias("n")) for i, k in enumerate(keys)])))


def failure_counts(df: DataFrame) -> DataFrame:
    """Judges' failures by kind, all kinds; a kind that isn't known counts as other."""
    return fixed_counts(df, text.text("judge_failure_type"), fixed.JUDGE_FAILURE_TYPES, "other", text.text("judge_status") == "failed")


def transition_counts(df: DataFrame) -> DataFrame:
    """How many cases of two compared runs improved, worsened, stayed and changed."""
    return fixed_counts(df, F.col("transition"), ["improved", "worsened", "unchanged", "changed"])


def attribution_table(df: DataFrame, column: str = "attribution", actions: list[tuple[str, str]] = fixed.ISSUE_ACTIONS) -> DataFrame:
    """(place, attribution, count, action, cases): causes in a fixed order, those without cases left out, cases in the order of pos."""
    order = df.sparkSession.createDataFrame([(k, *x) for k, x in enumerate(actions)], "place int, attribution string, action string")
    found = df.groupBy(F.col(column).alias("attribution")).agg(F.count("*").alias("count"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "query"))), lambda x: x["query"]).alias("cases"))
    return found.join(F.broadcast(order), "attribution").select("place", "attribution", "count", "action", "cases")


def transition(base: Column, target: Column) -> Column:
    """Change of a case between two runs, by whether all three scores are yes."""

    def ok(j: Column) -> Column:
        out = F.lit(True)
        for f in SCORES:
            out = out & (text.text(j[f]) == "yes")
        return out

    return F.when(ok(base) & ~ok(target), "worsened").when(~ok(base) & ok(target), "improved").when(base.eqNullSafe(target), "unchanged").otherwise("changed")


def latest(df: DataFrame, key: str = "query") -> DataFrame:
    """The last row, by pos, of each query of a run."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("pos")))).filter("_n = 1").drop("_n")


def compare(base: DataFrame, target: DataFrame) -> DataFrame:
    """(query, base, target, transition) of the queries that both runs have."""
    side = lambda df, n: latest(df).select("query", F.col("manual_judgment").alias(n))
    return side(base, "base").join(side(target, "target"), "query").withColumn("transition", transition(F.col("base"), F.col("target")))


def bad_case_type(judgement: Column) -> Column:
    return F.when(judgement.startswith("Top1"), "top1").when(judgement.startswith("Top3"), "ranking_error").otherwise("miss")


def compare_retrieval(base: DataFrame, target: DataFrame) -> DataFrame:
    """(query, judgements, types, transition) of two retrieval runs (query, pos, judgement)."""
    place = lambda c: F.when(c == "top1", 0).when(c == "ranking_error", 1).otherwise(2)
    side = lambda df, n: latest(df).select("query", F.col("judgement").alias(f"{n}_judgement"), bad_case_type(text.text("judgement")).alias(f"{n}_type"))
    a, b = place(F.col("base_type")), place(F.col("target_type"))
    return side(base, "base").join(side(target, "target"), "query").withColumn("transition", F.when(b < a, "improved").when(b > a, "worsened").otherwise("unchanged"))


def config_diff(base: DataFrame, target: DataFrame) -> DataFrame:
    """(key, base, target) of the settings (key, value) that differ or that one side lacks."""
    rows = base.select("key", F.col("value").alias("base")).join(target.select("key", F.col("value").alias("target")), "key", "full_outer")
    return rows.filter(~F.col("base").eqNullSafe(F.col("target")))


def retrieval_judgement(intents: Column, expected: Column) -> Column:
    first = F.get(intents, F.lit(0))
    return F.when(F.size(intents) == 0, "未命中").when(F.array_contains(expected, first), "Top1 命中").when(F.arrays_overlap(intents, expected), "Top3 召回但 Top1 错误").otherwise("未命中")


def rerank_impact(results: DataFrame) -> DataFrame:
    """Results (query_id, rank, intent, score, expected_intents) -> per query whether reranking changed the first intent, and for better or worse."""
    found = results.groupBy("query_id").agg(F.min_by("intent", F.struct((-F.round("score", 9)).alias("s"), "rank")).alias("original_top_intent"), F.min_by("intent", "rank").alias("reranked_top_intent"), F.first("expected_intents").alias("_e"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "intent"))), lambda x: x["intent"]).alias("top_intents"))
    before, after = F.array_contains("_e", F.col("original_top_intent")), F.array_contains("_e", F.col("reranked_top_intent"))
    changed = F.col("original_top_intent") != F.col("reranked_top_intent")
    impact = F.when(~changed, "unchanged").when(~before & after, "improved").when(before & ~after, "worsened").otherwise("changed_neutral")
    return found.withColumn("top1_changed", changed).withColumn("impact", impact).withColumn("judgement", retrieval_judgement(F.col("top_intents"), F.col("_e"))).drop("_e")


def retrieval_summary(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts over rerank_impact's rows."""
    is_ = lambda p: F.count_if(F.col("judgement").startswith(p))
    impact = lambda v: F.count_if(F.col("impact") == v)
    return df.groupBy(*(by or [])).agg(F.count("*").alias("total"), is_("Top1").alias("top1"), is_("Top3").alias("top3_error"), F.count_if(~F.col("judgement").startswith("Top1") & ~F.col("judgement").startswith("Top3")).alias("miss"), F.count_if(F.col("impact") != "unchanged").alias("changed_top1"), *[impact(v).alias(v) for v in ("improved", "worsened", "unchanged", "changed_neutral")])


def hit_band(rate_: Column) -> Column:
    return F.when(rate_ == 1, "OK").when(rate_ >= 0.5, "部分命中").when(rate_ > 0, "弱命中").otherwise("未命中")


def smoke(cases: DataFrame, responses: DataFrame) -> DataFrame:
    """Cases (id, query, expected_top1_intent, expected_reply_keywords, forbidden_reply_keywords) against responses (id, reply, retrieved_items): passed and the failures' texts."""
    rows = cases.join(responses, "id", "left")
    reply, top = text.text("reply"), top1_intent(F.col("retrieved_items"))
    missing, hits = text.found_and_missing(reply, F.col("expected_reply_keywords"))[1], text.found_and_missing(reply, F.col("forbidden_reply_keywords"))[0]
    show = lambda a: F.when(F.size(a) == 0, "[]").otherwise(F.concat(F.lit("['"), F.array_join(a, "', '"), F.lit("']")))
    failures = F.array_compact(F.array(F.when(top != F.col("expected_top1_intent"), F.concat(F.lit("top1 intent expected "), F.col("expected_top1_intent"), F.lit(", got "), top)), F.when(F.size(missing) > 0, F.concat(F.lit("missing reply keywords: "), show(missing))), F.when(F.size(hits) > 0, F.concat(F.lit("forbidden reply hits: "), show(hits)))))
    return rows.withColumns({"actual_top1_intent": top, "missing_reply_keywords": missing, "forbidden_reply_hits": hits, "failures": failures}).withColumn("passed", F.size("failures") == 0)


def score_lines(items: Column, names: tuple[tuple[str, str], ...] = (("score", "score"), ("vector", "vector_score"), ("rerank", "rerank_score"), ("keyword", "keyword_bonus"), ("penalty", "direction_penalty"))) -> Column:
    """Display lines of retrieved items with their scores to 4 decimals; missing scores are left out."""

    def line(x: Column, i: Column) -> Column:
        parts = F.array_compact(F.array(*[F.when(x[c].isNotNull(), F.concat(F.lit(f"{n}="), text.score_text(x[c]))) for n, c in names]))
        known = lambda c, other: F.when(text.text(x[c]) == "", other).otherwise(x[c])
        return F.concat(F.lit("  #"), F.coalesce(x["rank"], i + 1).cast("string"), F.lit(" "), known("category", "unknown_category"), F.lit("/"), known("intent", "unknown_intent"), F.lit(" | "), F.array_join(parts, ", "), F.lit(" | question="), text.text(x["question"]))

    return F.transform(items, line)
