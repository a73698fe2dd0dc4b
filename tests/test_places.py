"""Places without a window over all rows, counts of fixed keys, reports of stored answers."""

import random

from pyspark.sql import functions as F

from granary.operators import grounding, knowledge, places
from granary.plans import evaluation
from granary.sources import readers


def test_places_follow_the_order_without_a_window(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(50), i) for i in range(3000)]
    got = places.numbered(spark.createDataFrame(rows, "a int, b int").repartition(7), [F.desc("a"), "b"], start=5)
    assert "Window" not in got._jdf.queryExecution().toString()
    assert [(r.a, r.b, r.pos) for r in got.orderBy("pos").collect()] == [(*r, 5 + k) for k, r in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))]
    assert evaluation.numbered(spark.createDataFrame([("b",), ("a",)], "q string"), "q").orderBy("pos").collect() == [("a", 0), ("b", 1)]
    assert places.numbered(spark.createDataFrame([], "a int"), ["a"]).collect() == []
    path = tmp_path / "lines.txt"
    path.write_text("".join(f"line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        lines = readers.numbered_lines(spark, f"file://{path}")
        assert [(r.pos, r.line) for r in lines.orderBy("pos").collect()] == [(i, f"line {i}") for i in range(5000)]
        assert lines.rdd.getNumPartitions() > 5 and len(lines._jdf.queryExecution().analyzed().toString()) < 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_publishing_appends_without_a_window(spark):
    items = spark.createDataFrame([], knowledge.ITEMS)
    for i in range(1, 5):
        edit = spark.createDataFrame([(i, None, f"q{i}", "a", "c", "i")], "id long, base_id string, question string, answer string, category string, intent string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
        items = knowledge.review(knowledge.next_versions(items, edit), i, "approved", "", F.lit("2024-01-01").cast("timestamp"))
    base = spark.createDataFrame([(6, "old", "a", "c", "i")], "pos long, question string, answer string, category string, intent string")
    _, merged = knowledge.publish(items, base)
    rows = merged.orderBy("pos").collect()
    assert [r.pos for r in rows] == [6, 7, 8, 9, 10] and {r.question for r in rows[1:]} == {"q1", "q2", "q3", "q4"}


def test_counts_of_fixed_keys(spark):
    rows = spark.createDataFrame([("failed", "not_json"), ("failed", "x"), ("failed", None), ("succeeded", "not_json")], "judge_status string, judge_failure_type string")
    assert {r.key: r.n for r in grounding.failure_counts(rows).collect()} == {"empty_response": 0, "not_json": 1, "missing_field": 0, "invalid_enum": 0, "empty_reason": 0, "other": 2}
    moved = spark.createDataFrame([("improved",), ("changed",), ("improved",)], "transition string")
    assert [tuple(r) for r in grounding.transition_counts(moved).orderBy("place").collect()] == [(0, "improved", 2), (1, "worsened", 0), (2, "unchanged", 0), (3, "changed", 1)]


def test_reports_of_stored_answers(spark):
    item, used = "struct<intent: string>", "struct<role: string, intent: string, answer: string>"
    cases = spark.createDataFrame(
        [("q1", "请在订单详情页查看。", [("退款进度",)], [("primary", "退款进度", "请在订单详情页查看。")], "退款进度", ["订单详情页", "凭证"], '{"direct_answer": "yes", "grounded": "yes", "useful": "yes", "risk_notes": "", "reason": "r"}'), ("q2", None, None, None, "x", None, "")],
        f"query string, reply string, retrieved_items array<{item}>, prompt_context_items array<{used}>, expected_intent string, expected_evidence_keywords array<string>, raw string",
    )
    a, b = evaluation.stored_run(cases, F.col("raw")).orderBy("query").collect()
    assert a.used_primary_evidence and a.missing_evidence_keywords == ["凭证"] and a.judge_status == "succeeded" and a.manual_judgment.useful == "yes"
    assert b.judge_status == "failed" and b.suggested_layer == "judge" and not b.used_primary_evidence
    bare = evaluation.stored_run(spark.createDataFrame([("q", "r")], "query string, reply string")).first()
    assert bare.judge_status == "not_run" and bare.retrieved_document_count == 0
    base, target = evaluation.run_config(spark, judge=True, model=None), evaluation.run_config(spark, judge=False, model="")
    assert [tuple(r) for r in grounding.config_diff(base, target).collect()] == [("judge", "True", "False")]
