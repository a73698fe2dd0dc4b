"""Phrases in texts, and keyword retrieval, against plain comparison."""

import random

import numpy as np

from granary.operators import phrases

SCHEMA = "doc_id long, item_id string, body string"


def test_containing_equals_comparing_all(spark):
    rng = random.Random(4)
    parts = ["the ", "of ", "é", "ü-", "abcdefgh", "aaaaaaaa", "x", "退款", "多久到账", "\n", "zzzzzzzzzzzzzzzz"]
    texts = [(i % 90, "k", "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(120)] + [(1, "k", None), (2, "k", ""), (3, "k", "a" * 5000)]
    whole = [t for _, _, t in texts if t]
    wanted = [(i, t[a : a + n]) for i in range(150) for t in [rng.choice(whole)] for n in [rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 40, 64, 90, 130, 200])] for a in [rng.randint(0, max(0, len(t) - n))]]
    wanted += [(200, "not there at all"), (201, ""), (202, None), (203, "a" * 4000), (204, "退"), (205, "the "), (206, "the "), (None, "of ")]
    got = phrases.containing(spark.createDataFrame(texts, SCHEMA).repartition(3).drop("item_id"), spark.createDataFrame(wanted, "item_id long, phrase string"), "body", "item_id").collect()
    want = [(d, i) for d, _, t in texts for i, p in wanted if t is not None and p is not None and p in t]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    none = phrases.containing(spark.createDataFrame(texts, SCHEMA).select("doc_id", "body"), spark.createDataFrame([], "item_id long, phrase string"), "body", "item_id")
    assert none.collect() == []


def test_any_text_shows_the_anchors_of_what_it_contains():
    rng = random.Random(6)
    for _ in range(200):
        text = bytes(rng.choice(b"ab c") for _ in range(rng.randint(20, 400)))
        n = rng.randint(1, len(text))
        at = rng.randint(0, len(text) - n)
        kind, own, grams = phrases._anchors(text[at : at + n])
        size, width = (8, phrases.WINDOWS.get(kind, 64)) if kind > 0 else (-kind, 1)
        shown = set(phrases.places(phrases._grams(np.frombuffer(text, np.uint8), size), width).tolist())
        assert len(own) and {at + int(p) for p in own} <= shown


def test_keyword_top_equals_scoring_all(spark):
    """The pruned ranking beside the scores of all rows: few and many terms, ties, whole queries, rows without any."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from granary.operators import retrieval

    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    some = lambda n: " ".join(words[min(299, int(rng.paretovariate(0.6)))] for _ in range(n))
    rows = [(i, some(rng.randint(0, 4)), some(rng.randint(0, 30)), rng.choice(["c1", "c2", None, "w3"]), rng.choice(["i w5", None])) for i in range(400)]
    queries = [(i, some(rng.randint(1, 25))) for i in range(60)] + [(60 + i, rows[i][2]) for i in range(20)] + [(90, "nothing known"), (91, None), (92, "w1 w1"), (93, "w2"), (94, "退款多久到账")]
    rows += [(400 + i, rows[i][1], rows[i][2], rows[i][3], rows[i][4]) for i in range(30)] + [(500, "退款进度", "退款", "退款", "退款进度")]
    kb = spark.createDataFrame(rows, "pos long, question string, answer string, category string, intent string")
    asked = spark.createDataFrame(queries, "query_id long, query string")
    scored = retrieval.keyword_scores(asked, kb).join(kb.select("pos", F.length(F.coalesce("answer", F.lit(""))).alias("_l")), "pos")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("matched_term_count"), "_l", "pos")
    for limit, seeds in ((3, 32), (1, 4), (10, 2)):
        want = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query_id", "pos", F.col("score").cast("long"), F.col("matched_term_count").cast("long"), "rank").collect()
        got = retrieval.keyword_top(asked, kb, limit, seeds=seeds).select("query_id", "pos", F.col("score").cast("long"), F.col("matched_term_count").cast("long"), "rank").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert retrieval.keyword_top(asked.limit(0), kb).collect() == [] and retrieval.keyword_top(asked, kb.limit(0)).collect() == []
