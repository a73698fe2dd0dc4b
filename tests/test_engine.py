"""Retrieval against plain Python, state changes, sources, training data, plans, and the catalog beside its SQL."""

import json
import random
import subprocess
import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from granary.operators import answer_plan, context, feedback, grounding, knowledge, retrieval, training
from granary.sources import readers

ROOT = Path(__file__).resolve().parent.parent
MARKS = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~，。！？；：、（）《》“”‘’")


def key(t):
    return "".join(c for c in t.lower() if c.strip() and c not in MARKS)


def alike(a, b):
    a, b = sorted((key(a), key(b)), key=len)
    if not a or not b:
        return False
    if a in b:
        return len(a) / len(b) >= 0.6
    x, y = ({s[i : i + 2] for i in range(len(s) - 1)} or {s} for s in (a, b))
    return len(x & y) / len(x | y) >= 0.72


def test_greedy_choice_equals_a_plain_walk(spark):
    rng = random.Random(5)
    rows = []
    for g in range(6):
        base = ["".join(rng.choice("abcdef。 ，") for _ in range(rng.randint(1, 30))) for _ in range(6)]
        for i in range(25):
            t = rng.choice(base)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(t) + 1)
                t = t[:k] + rng.choice("abcxyz。") + t[k + rng.randint(0, 1) :]
            rows.append((g, i, t))
    want = []
    for g in range(6):
        kept = []
        for _, i, t in (r for r in rows if r[0] == g):
            if len(kept) < 5 and t not in [x for _, x in kept] and not any(alike(t, x) for _, x in kept):
                kept.append((i, t))
        want += [(g, i, n + 1) for n, (i, _) in enumerate(kept)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, pos int, answer string").repartition(5)
    got = retrieval.greedy_dedupe(df, ["g"], [F.col("pos")], 5)
    assert sorted((r.g, r.pos, r["rank"]) for r in got.collect()) == want


KB = [(0, "退款多久到账", "退款通常按支付渠道原路退回，请查看订单详情页。", "退款", "退款进度"), (1, "优惠券不能用", "优惠券有使用门槛。", "优惠", "优惠券不可用"), (2, "骑手联系不上", "请提交配送异常反馈。", "配送", "配送异常追问"), (3, "退款进度在哪看", "退款进度在订单详情页。", "退款", "退款进度"), (4, "发票", "", "发票", "发票开具咨询")]


def kb(spark):
    from granary.functions.providers import embedder

    rows = spark.createDataFrame(KB, "pos long, question string, answer string, category string, intent string")
    return rows.withColumn("embedding", embedder()(retrieval.document_text(*[F.col(c) for c in ("category", "intent", "question", "answer")])))


def asked(spark, queries):
    from granary.functions.providers import embedder

    return spark.createDataFrame(list(enumerate(queries)), "query_id long, query string").withColumn("q_embedding", embedder()("query"))


def test_search_supplements_and_reranks(spark):
    got = retrieval.search(asked(spark, ["钱什么时候退，重点是取消后多久到账", "无关"]), kb(spark), min_score=0.99)
    rows = [r for r in got.collect() if r.query_id == 0]
    assert {r.intent for r in rows} == {"退款进度"} and all(r.retrieval_origin == "intent_hint_supplement" and r.score == 0.80 for r in rows)
    assert all(abs(r.rerank_score - 0.90) < 1e-9 for r in rows) and [r.pos for r in sorted(rows, key=lambda r: r["rank"])] == [0, 3]


def test_keyword_search(spark):
    got = retrieval.keyword_search(asked(spark, ["退款多久到账"]), kb(spark)).orderBy("rank").collect()
    assert got[0].pos == 0 and got[0].score > got[1].score


def test_bonus_and_penalty(spark):
    rows = spark.createDataFrame([("退款多久到账", "退款", "退款进度", "退款多久到账", ""), ("餐品有异物", "优惠", "优惠券", "", ""), ("骑手联系不上", "", "", "骑手联系不到我", "")], "q string, category string, intent string, question string, answer string")
    f = {c: F.col(c) for c in ("category", "intent", "question", "answer")}
    got = rows.select(F.round(retrieval.keyword_bonus(F.col("q"), f), 4).alias("b"), retrieval.direction_penalty(F.col("q"), *[F.col(c) for c in ("category", "intent", "question")]).alias("p")).collect()
    assert got[0].b == round(0.04 + 0.03 + 0.02 * (1 + 1 + 0.5), 4) and [r.p for r in got] == [0.0, 0.15, 0.08]


def test_context_roles(spark):
    rows = spark.createDataFrame([(1, 1, "c", "i", "q1", "answer one", 0.8, 0.9), (1, 2, "c", "i", "q2", "answer  one", 0.8, 0.88), (1, 3, "c", "", "q3", "x" * 130, 0.8, 0.86), (2, 1, "c", "i", "q", "a", 0.9, 0.9), (2, 2, "c", "j", "q", "b", 0.8, 0.82)], "query_id int, rank int, category string, intent string, question string, answer string, score double, rerank_score double")
    got = context.context_items(rows).orderBy("query_id", "place").collect()
    assert [(r.role, r.evidence_strength) for r in got] == [("primary", "close_match"), ("supporting", "normal"), ("primary", "normal"), ("supporting", "normal")]
    assert got[1].evidence_summary == "x" * 120 + "..." and "unknown" in got[1].display_title
    p = context.prompts(spark.createDataFrame([(1, "问"), (3, "无")], "query_id int, query string"), context.context_items(rows)).orderBy("query_id").collect()
    assert "1. 最相关参考资料（与补充资料较接近" in p[0].final_prompt and p[0].final_prompt.endswith("最终客服回复：") and p[1].final_prompt.endswith("用户问题：无")


def test_chat_answers_are_one_row_each(spark):
    from granary.plans import chat

    rows = chat.answers(asked(spark, ["退款多久到账", "zzz"]), kb(spark)).orderBy("query_id").collect()
    assert len(rows) == 2 and rows[0].reply and rows[0].confidence_score == 0.95
    assert rows[1].trace.used_fallback_prompt and rows[1].confidence_score == 0.5 and rows[1].suggested_layer == "retrieval"


def test_failures_of_stages_are_answered(spark):
    from granary.functions.providers import replies
    from granary.plans import chat

    def run(prompts):
        if any("zzz" in p for p in prompts):
            raise RuntimeError("no model for this")
        return ["ok"] * len(prompts)

    def missing():
        raise ValueError("no key")

    queries = asked(spark, ["退款多久到账", "zzz", "发票怎么开"]).withColumn("q_embedding", F.when(F.col("query_id") < 2, F.col("q_embedding")))
    rows = chat.answers(queries, kb(spark), generate=replies(lambda: run)).orderBy("query_id").collect()
    assert [(r.trace.failure_stage, r.trace.degraded, r.confidence_score) for r in rows] == [("none", False, 0.95), ("generation", True, 0.2), ("retrieval", True, 0.5)]
    assert rows[1].trace.fallback_reason == "generation_failed: no model for this" and rows[1].trace.answer_source == "fallback" and rows[2].trace.used_fallback_prompt and not rows[2].retrieved_items
    rows = chat.answers(queries, kb(spark), generate=replies(missing)).collect()
    assert {r.trace.fallback_reason for r in rows} == {"generation_failed: no key"} and len(rows) == 3


def test_knowledge_versions(spark):
    at = F.lit("2024-01-01").cast("timestamp")
    items = spark.createDataFrame([], knowledge.ITEMS)
    edit = lambda i, base: spark.createDataFrame([(i, base, f"q{i}", "a", "c", "i")], "id long, base_id string, question string, answer string, category string, intent string").withColumn("at", at)
    items = knowledge.next_versions(items, edit(1, None))
    base = items.first().base_id
    assert base.startswith("kb_") and len(base) == 15
    items = knowledge.next_versions(items, edit(2, base))
    assert [(r.version, r.status) for r in items.orderBy("id").collect()] == [(1, "draft"), (2, "draft")]
    items = knowledge.review(items, 2, "approved", "ok", at)
    with pytest.raises(ValueError):
        knowledge.review(items, 2, "published", "", at)
    with pytest.raises(KeyError):
        knowledge.archive(items, 9, at)
    base_rows = spark.createDataFrame([(0, "old", "a", "c", "i")], "pos long, question string, answer string, category string, intent string")
    after, merged = knowledge.publish(items, base_rows)
    assert [(r.pos, r.question) for r in merged.orderBy("pos").collect()] == [(0, "old"), (1, "q2")] and after.filter("id = 2").first().status == "published"
    history = knowledge.recorded(spark.createDataFrame([], knowledge.HISTORY), spark, publish_id="p", action="publish", status="succeeded", item_ids=[2], backup_path="b", merged_count=1)
    assert knowledge.rolled_back(after, history).filter("id = 2").first().status == "approved"
    line = json.loads(knowledge.export_approved(items).first().line)
    assert line["id"] == f"{base}_v2" and line["entities"] == {"risk": "待确认"}
    assert knowledge.page(items, keyword="Q2")[0] == 1


def test_feedback_and_metrics(spark):
    s = spark.createDataFrame([("r1", "old", "2024-01-01")], "request_id string, query string, created_at string")
    n = spark.createDataFrame([("r1", "new", "2024-01-02"), (" ", "x", "2024-01-02")], "request_id string, query string, created_at string")
    assert [tuple(r) for r in feedback.upsert(s, n).collect()] == [("r1", "new", "2024-01-02")]
    p = spark.createDataFrame([(1, "r", "q", "a", False, "bad", "exp", '{"top1_intent": "i", "latency_ms": 3.5}', "2024-01-01")], "id long, request_id string, query string, reply string, helpful boolean, reason string, expected_reply string, trace_json string, created_at string")
    case, marked = feedback.exported(feedback.feedback_rows(p), 1)
    assert case.first().expected_intent == "i" and case.first().notes == "reason=bad; expected_reply=exp" and marked.first().exported
    rows = [(i, None, "none" if i else None, i % 3, False, False, "rag", float(i)) for i in range(1500)]
    t = spark.createDataFrame(rows, "seq int, degraded boolean, failure_stage string, retrieval_count int, reply_rules_applied boolean, used_fallback_prompt boolean, answer_source string, latency_ms double")
    m = feedback.ops_metrics(t).first()
    assert (m.request_count, m.failure_count, m.empty_retrieval_count) == (1500, 1, 500) and m.average_latency_ms == 999.5 and m.p95_latency_ms == 1450.0
    assert feedback.ops_metrics(t.limit(0)).first().p95_latency_ms == 0.0


def test_sources(spark, tmp_path):
    p = tmp_path / "kb.jsonl"
    p.write_text("\n".join(json.dumps({"question": f"q{i}", "answer": None}) for i in range(50)) + "\n", encoding="utf-8")
    rows = readers.knowledge_base(spark, str(p)).orderBy("pos").collect()
    assert [r.question for r in rows] == [f"q{i}" for i in range(50)] and rows[0].answer == ""
    p.write_text('{"question": "a"}\n\n{"question": "b"}\n', encoding="utf-8")
    with pytest.raises(ValueError):
        readers.knowledge_base(spark, str(p))
    assert readers.json_lines(spark, str(p), readers.KB, strict=False).count() == 2
    case = {"id": "1", "scenario": "s", "case_type": "oral", "query": "q", "expected_intent": "i", "expected_evidence_keywords": [], "forbidden_keywords": [], "notes": ""}
    for bad, message in ((case | {"case_type": "x"}, "case_type"), ({k: v for k, v in case.items() if k != "notes"}, "missing"), (case, "Duplicate")):
        p.write_text(json.dumps(case) + "\n" + json.dumps(bad) + "\n", encoding="utf-8")
        with pytest.raises(ValueError, match=message):
            readers.evaluation_cases(spark, str(p))
    readers.swap(spark.range(3).toDF("id"), str(tmp_path), "1")
    readers.swap(spark.range(5).toDF("id"), str(tmp_path), "2")
    assert readers.current(spark, str(tmp_path)).count() == 5
    readers.point(spark, str(tmp_path), f"{tmp_path}/v_1")
    assert readers.current(spark, str(tmp_path)).count() == 3 and not [x for x in tmp_path.iterdir() if x.name.startswith("CURRENT.")]
    readers.swap(spark.range(7).toDF("id"), f"file://{tmp_path}/other", "1")
    assert readers.current(spark, f"file://{tmp_path}/other").count() == 7 and not readers.has_version(spark, f"{tmp_path}/none")
    at = datetime(2024, 1, 2, 3, 4, 5)
    paths = [readers.save_report(spark, f"{tmp_path}/reports", {"n": i}, at) for i in range(3)]
    assert [x.rpartition("/")[2] for x in paths] == ["2024-01-02_03-04-05.json", "2024-01-02_03-04-05-1.json", "2024-01-02_03-04-05-2.json"]
    assert json.loads(Path(paths[1]).read_text(encoding="utf-8")) == {"run_id": "2024-01-02_03-04-05", "created_at": "2024-01-02T03:04:05", "n": 1}
    base = kb(spark)
    assert readers.compatible(base, base.repartition(3)) and not readers.compatible(base, base.withColumn("answer", F.lit("z")))
    assert readers.markdown_table([{"a": "x|y\nz"}], ["a"]).splitlines()[2] == "| x\\|y<br>z |"


def test_training_data(spark):
    seeds = spark.createDataFrame([(i, f"怎么办{i}", f"答{i}", "c", "i", "negative" if i % 2 else "x") for i in range(4)], "pos int, question string, answer string, category string, intent string, sentiment string").withColumn("entities", F.create_map().cast("map<string,string>"))
    seeds = seeds.withColumns({c: F.lit(None).cast("string") for c in ("id", "source", "dialogue_type", "quality")})
    rows = training.augmented(seeds, 25).orderBy("id").collect()
    assert len(rows) == 25 and rows[0].id == "takeout_0001" and len({(r.question, r.answer, r.intent) for r in rows}) == 25
    assert [r.source for r in rows[:4]] == ["curated_seed"] * 4 and rows[4].question == "您好，怎么办0" and rows[5].question.startswith("咋办0")
    m = training.messages(training.augmented(seeds, 25)).collect()
    assert {len(r.messages) for r in m} == {3, 5}
    n = training.split(spark.range(100).toDF("id"), "id").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in n} == {"train": 80, "val": 10, "test": 10}


def test_answer_plans(spark):
    good = {"user_intent": "u", "answer_type": "t", "direct_answer_brief": "可以，先看", "key_evidence": ["e1。"], "action_suggestion": "请您查看退款。", "needs_caution": True, "caution_reason": ""}
    raws = ["说明 " + json.dumps(good) + " 完", "", "none", json.dumps(good | {"needs_caution": "yes"}), json.dumps({k: v for k, v in good.items() if k != "key_evidence"}), json.dumps(good | {"key_evidence": []})]
    got = answer_plan.parsed(spark.createDataFrame([(r,) for r in raws], "raw_output string")).withColumn("reply", answer_plan.user_reply(F.col("plan"))).collect()
    assert [r.parse_error for r in got] == ["", "Answer plan output is empty", "Answer plan output does not contain a JSON object", "needs_caution must be a boolean", "Answer plan missing field: key_evidence", "key_evidence must be a non-empty list"]
    assert got[0].plan.direct_answer_brief == "可以" and got[0].plan.action_suggestion == "查看退款" and got[0].plan.caution_reason and got[0].reply.startswith("可以\n建议您查看退款。")


def test_reports_of_evidence(spark):
    item = "struct<role string, intent string, answer string>"
    rows = spark.createDataFrame([("q", "请在订单详情页查看。保证退款", [("primary", "a", "请在订单详情页查看。"), ("supporting", "b", "保证退款")], ["订单详情页", "凭证"])], f"query string, reply string, prompt_context_items array<{item}>, expected_evidence_keywords array<string>")
    rows = rows.withColumns({"expected_intent": F.lit(""), "forbidden_keywords": F.lit(None).cast("array<string>"), "retrieved_documents": F.lit(None).cast("array<string>")})
    r = grounding.reports(rows).first()
    assert r.used_primary_evidence and r.mixed_supporting_intent and r.risky_promises == ["保证"] and r.missing_evidence_keywords == ["凭证"]


def test_stream_equals_batch(spark, tmp_path):
    from granary.streaming.ops import running_counts

    rows = [(None, "none", i % 2, False, False, "rag") for i in range(20)]
    schema = "degraded boolean, failure_stage string, retrieval_count int, reply_rules_applied boolean, used_fallback_prompt boolean, answer_source string"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(str(tmp_path / "in"))
    q = running_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("ops_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert tuple(spark.table("ops_counts").first())[:3] == (20, 0, 10)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_catalog_equals_its_sql():
    names = "vector_topk hybrid_rank rerank_rank weight_sweep hint_supplement keyword_rank toy_vector context_items greedy_dedupe mask_pii failure_attribution grounding_metrics report_compare ops_metrics kb_versions kb_audit".split()
    run = subprocess.run([sys.executable, str(ROOT / "tools/compare.py"), "/root/testdata/sf0.001", *names], capture_output=True, text=True, timeout=900)
    assert run.stdout.count(": same") == len(names), run.stdout


def test_service(spark, tmp_path):
    from granary.plans.service import Service

    s = Service(spark, str(tmp_path), kb(spark))
    assert s.categories() == sorted({r[3] for r in KB}) and s.examples_by_category("退款").count() == 2
    with pytest.raises(KeyError):
        s.examples_by_category("没有")
    rows = s.chat_prompt(["退款多久到账"]).collect()
    assert len(rows) == 1 and s.table("sessions").count() == 1 and s.ops_metrics()["request_count"] == 1
    n = s.create_item({"question": "新问题", "answer": "新答案", "category": "新", "intent": "新意图"})
    assert s.publish_approved() == "skipped"
    s.review_item(n, "approved", "ok")
    assert s.export_approved()[0] == 1 and s.publish_approved() == "succeeded" and s.search_examples("新问题").count() == 1
    assert s.retrieval_search("新问题", min_score=0.0).count() > 0 and s.rollback_latest() == "succeeded" and s.search_examples("新问题").count() == 0
    assert s.update_item(n, {"question": "q2"}) == 2 and [r.action for r in s.publish_history().collect()] == ["rollback", "publish", "publish"]
    assert s.table("sessions").first().latency_ms > 0 and s.ops_metrics()["average_latency_ms"] > 0 and json.loads(s.table("sessions").first().trace_json)["request_id"] == rows[0].request_id
    s.review_item(2, "approved", "ok")
    put = s.put

    def failing(name, rows):
        if name == "items":
            raise OSError("disk")
        put(name, rows)

    s.put = failing
    with pytest.raises(OSError, match="disk"):
        s.publish_approved()
    s.put = put
    assert s.search_examples("q2").count() == 0 and s.kb().count() == len(KB) and s.publish_history().first().status == "failed" and s.items(status="approved")[0] >= 1
    f = s.add_feedback({"query": "q", "reply": "r", "helpful": False, "reason": "bad", "trace_json": '{"top1_intent": "i"}'})
    assert s.recent_feedback(helpful=False).count() == 1 and s.export_eval_case(f)["expected_intent"] == "i" and s.table("feedback").first().exported
    assert s.prompt_preview("退款多久到账").first().final_prompt.endswith("最终客服回复：") and s.intent_hint("优惠券不能用") == "优惠券不可用"


def test_evaluation_runs(spark):
    from granary.plans import evaluation

    cases = asked(spark, ["退款多久到账，重点是取消", "优惠券不能用", "zzz"]).withColumn("expected_intents", F.when(F.col("query_id") == 0, F.array(F.lit("退款进度"))).otherwise(F.array(F.lit("别的")))).withColumn("error_type", F.lit(""))
    run = evaluation.retrieval_run(cases, kb(spark), min_score=0.9)
    got = {r.query_id: r.judgement for r in run.collect()}
    assert got == {0: "Top1 命中", 1: "未命中", 2: "未命中"}
    assert {r.error_type: r.n for r in evaluation.error_types(run).collect()} == {"未标注": 2} and evaluation.bad_case_counts(run).first().miss_count == 2
    rows = evaluation.hit_rates(spark.createDataFrame([("a b", ["a", "b"]), ("a", ["a", "b"]), ("z", ["a"]), ("z", [])], "answer string, expected_keywords array<string>"))
    assert [r.band for r in rows.collect()] == ["OK", "部分命中", "未命中", "未命中"] and evaluation.hit_summary(rows).first().mean_hit_rate == 0.375
