"""Reports, smoke tests, stores, lines and windows of operation, against values worked out by hand."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from granary.functions import providers
from granary.operators import answer_plan, context, grounding
from granary.plans import chat, evaluation
from granary.sources import readers
from granary.streaming import ops


def test_tables_and_comparisons_of_runs(spark):
    actions = [("late", "hurry"), ("never", "nothing"), ("lost", "search")]
    rows = spark.createDataFrame([(2, "b", "lost"), (1, "a", "lost"), (3, "c", "late"), (4, "d", "else")], "pos int, query string, attribution string")
    got = grounding.attribution_table(rows, actions=actions).orderBy("place").collect()
    assert [tuple(r) for r in got] == [(0, "late", 1, "hurry", ["c"]), (2, "lost", 2, "search", ["a", "b"])]
    run = lambda *j: spark.createDataFrame([(q, k, x) for k, (q, x) in enumerate(j)], "query string, pos int, judgement string")
    base = run(("a", "未命中"), ("a", "Top1 命中"), ("b", "Top3 召回但 Top1 错误"), ("c", "未命中"), ("only", "未命中"))
    target = run(("a", "未命中"), ("b", "Top1 命中"), ("c", "未命中"))
    assert {r.query: (r.base_type, r.target_type, r.transition) for r in grounding.compare_retrieval(base, target).collect()} == {"a": ("top1", "miss", "worsened"), "b": ("ranking_error", "top1", "improved"), "c": ("miss", "miss", "unchanged")}
    docs = spark.createDataFrame([(["退款超时了", "骑手", "天气"],)], "d array<string>")
    assert docs.select(grounding.guessed_intents(F.col("d"))).first()[0] == ["退款/超时", "骑手", "unrecognized"]


def test_smoke_and_totals(spark):
    cases = spark.createDataFrame([("1", "q", "i", ["a", "b"], ["z"]), ("2", "q", "i", ["a"], []), ("3", "q", "i", [], [])], readers.SMOKE)
    replies = spark.createDataFrame([("1", "a z", [("other",)]), ("2", "a", [("i",)])], "id string, reply string, retrieved_items array<struct<intent string>>")
    got = grounding.smoke(cases, replies)
    assert {r.id: (r.passed, r.failures) for r in got.collect()} == {
        "1": (False, ["top1 intent expected i, got other", "missing reply keywords: ['b']", "forbidden reply hits: ['z']"]),
        "2": (True, []),
        "3": (False, ["top1 intent expected i, got "]),
    }
    assert tuple(evaluation.smoke_summary(got).first()) == (3, 1)
    assert tuple(evaluation.keyword_totals(got, keywords="expected_reply_keywords").first()) == (2, 3)
    assert tuple(evaluation.keyword_totals(got.limit(0), keywords="expected_reply_keywords").first()) == (0, 0)
    queries = spark.createDataFrame([(0, "a"), (1, "b")], "pos int, query string")
    extra = spark.createDataFrame([(0, "x", "other")], "pos int, note string, query string")
    assert [tuple(r) for r in evaluation.by_position(queries, extra).orderBy("pos").collect()] == [(0, "a", "x"), (1, "b", "")]


def test_smoke_cases(spark, tmp_path):
    path, good = tmp_path / "s.jsonl", {"id": "1", "query": "q", "expected_top1_intent": "i", "expected_reply_keywords": [], "forbidden_reply_keywords": []}
    path.write_text(json.dumps(good) + "\n\n" + json.dumps(good | {"id": "2"}) + "\n", encoding="utf-8")
    assert [r.id for r in readers.smoke_cases(spark, str(path)).orderBy("pos").collect()] == ["1", "2"]
    for bad, message in (({k: v for k, v in good.items() if k != "query"} | {"id": "2"}, "lacks a field"), (good, "Duplicate")):
        path.write_text(json.dumps(good) + "\n" + json.dumps(bad) + "\n", encoding="utf-8")
        with pytest.raises(ValueError, match=message):
            readers.smoke_cases(spark, str(path))


def test_score_lines_and_prompts(spark):
    item = "struct<rank int, category string, intent string, question string, score double, vector_score double, rerank_score double, keyword_bonus double, direction_penalty double>"
    rows = spark.createDataFrame([([(1, "c", "i", "q", 0.5, None, 0.25, None, None), (None, "", None, None, None, None, None, None, None)],)], f"items array<{item}>")
    assert rows.select(grounding.score_lines(F.col("items"))).first()[0] == ["  #1 c/i | score=0.5000, rerank=0.2500 | question=q", "  #2 unknown_category/unknown_intent |  | question="]
    made = spark.createDataFrame([("问", ["d1", "d2"], "答")], "q string, d array<string>, r string").select(context.judge_prompt(F.col("q"), F.col("d"), F.col("r")), context.plan_prompt(F.col("q"), F.col("d"))).first()
    assert all("1. d1\n2. d2" in p and "问" in p for p in made) and "答" in made[0]
    plan = "struct<direct_answer_brief string, key_evidence array<string>, action_suggestion string, needs_caution boolean, caution_reason string>"
    plans = spark.createDataFrame([(0, ("可以", ["一", "二", "三"], "查看", True, "因为")), (1, ("可以", [], "", False, "x")), (2, None)], f"id int, p {plan}")
    got = [r[0] for r in plans.orderBy("id").select(answer_plan.debug_reply(F.col("p"))).collect()]
    assert got == [f"可以\n参考依据：一；二。\n建议您查看。\n这类问题需要保守处理，原因是：因为。\n{answer_plan.END}", "可以", ""]
    log = chat.masked_log(spark.createDataFrame([("电话13812345678", "t")], "query string, trace string")).first()
    assert "13812345678" not in log.query and log.trace == "t"


def test_stores_and_lines(spark, tmp_path):
    kb = spark.createDataFrame([(0, "c", "i", "q", "a"), (1, "c", "i", "q2", "b")], "pos int, category string, intent string, question string, answer string")
    made = []

    def embed(rows):
        made.append(1)
        return rows.withColumn("embedding", F.array(F.lit(1.0), F.length("text").cast("double")))

    path = str(tmp_path / "store")
    for base, dimension, times in ((kb, None, 1), (kb.orderBy(F.desc("pos")), 2, 1), (kb, 3, 2), (kb.withColumn("answer", F.lit("z")), None, 3)):
        assert readers.ensured(spark, path, base, embed, dimension).count() == 2 and len(made) == times
    readers.write_lines(spark.range(20).select("id", F.lit("é").alias("t"), (-F.col("id")).alias("o")), str(tmp_path / "lines"), order="o")
    lines = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "lines").glob("part-*"))).splitlines()
    assert [json.loads(x) for x in lines] == [{"id": i, "t": "é"} for i in range(19, -1, -1)]
    one = tmp_path / "one.jsonl"
    one.write_text("a", encoding="utf-8")
    readers.append_lines(str(one), ["b", "c"])
    readers.append_lines(str(one), ["d"])
    assert one.read_text(encoding="utf-8") == "a\nb\nc\nd\n"


def test_providers_by_name(spark):
    assert providers.provider("local", local="x") == "x"
    with pytest.raises(ValueError, match="Unsupported"):
        providers.provider("online", local="x")
    rows = spark.createDataFrame([("ab", "c"), ("a", None)], "query string, rerank_text string")
    score = providers.cross_encoder(lambda: lambda pairs: [len(q) + len(t or "") for q, t in pairs])
    assert sorted(r.model_score for r in score(rows).collect()) == [1.0, 3.0]
    with pytest.raises(Exception, match="scores count"):
        providers.cross_encoder(lambda: lambda pairs: [])(rows).collect()


def test_windows_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    schema = "ts timestamp, latency_ms double, degraded boolean, failure_stage string, retrieval_count int, reply_rules_applied boolean, used_fallback_prompt boolean, answer_source string"
    rows = [(datetime(2024, 1, 1, 0, i // 20, i % 60), float(i), i % 3 == 0, "none", i % 2, False, False, "rag") for i in range(60)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ops.windowed_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    batch = ops.windowed_counts(spark.read.parquet(str(tmp_path / "in")))
    assert sorted(map(str, spark.table("windows").collect())) == sorted(map(str, batch.collect())) and {r.request_count for r in batch.collect()} == {20}
    assert sorted(r.average_latency_ms for r in batch.collect()) == [9.5, 29.5, 49.5]
