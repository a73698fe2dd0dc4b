"""The greedy choice by rounds against a plain walk."""

import random

import pytest
from pyspark.sql import functions as F

from granary.operators import greedy, retrieval
from tests.test_engine import alike, key


def walk(rows):
    kept: dict = {}
    for g, i, t in sorted(rows, key=lambda r: r[1]):
        own = kept.setdefault(g, [])
        if not any((t or "") == x or alike(t or "", x) for _, x in own):
            own.append((i, t or ""))
    return sorted((g, i, n + 1) for g, own in kept.items() for n, (i, _) in enumerate(own))


def answers(n, groups, seed, letters="abcdefgh。 ，"):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(max(4, n // 12))]
    out = []
    for i in range(n):
        t = rng.choice(base)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(t) + 1)
            t = t[:k] + rng.choice(letters + "xyz") + t[k + rng.randint(0, 1) :]
        if rng.random() < 0.2:
            t += rng.choice(base)[: rng.randint(1, 15)]
        out.append((rng.randrange(groups), i, t))
    return out + [(0, n, None), (0, n + 1, ""), (0, n + 2, "。。"), (0, n + 3, "。"), (0, n + 4, "。。"), (1, n + 5, "一"), (1, n + 6, "一二"), (1, n + 7, "一。")]


@pytest.mark.parametrize(("n", "groups", "seed"), [(400, 1, 1), (600, 5, 2)])
def test_rounds_equal_a_plain_walk(spark, n, groups, seed):
    rows = answers(n, groups, seed)
    df = spark.createDataFrame(rows, "g int, pos int, answer string").repartition(5)
    got = greedy.greedy_kept(df, ["g"], [F.col("pos")])
    assert got.columns == ["g", "pos", "answer", "rank"]
    assert sorted((r.g, r.pos, r["rank"]) for r in got.collect()) == walk(rows)
    first = retrieval.greedy_dedupe(df, ["g"], [F.col("pos")], 3).select("g", "pos", "rank").collect()
    assert sorted(map(tuple, greedy.greedy_kept(df, ["g"], [F.col("pos")], 3).select("g", "pos", "rank").collect())) == sorted(map(tuple, first))


def test_a_chain_is_decided_in_order_and_no_array_holds_a_group(spark):
    """Each text is similar to the next only: every other one stays; and the plan collects no group."""
    chain = ["".join(chr(0x4E00 + 3 * i + k) for k in range(16)) for i in range(60)]
    rows = [(0, i, t) for i, t in enumerate(chain)]
    df = spark.createDataFrame(rows, "g int, pos int, answer string")
    got = greedy.greedy_kept(df, ["g"], [F.col("pos")])
    assert sorted((r.g, r.pos, r["rank"]) for r in got.collect()) == walk(rows)
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_a_group_of_many_rows(spark):
    """100,000 answers of one group, four variants of each of 25,000 unlike texts: the first of each stays, and no group is held as a whole."""
    rng = random.Random(3)
    unlike = ["".join(chr(rng.randrange(0x4E00, 0x9E00)) for _ in range(24)) for _ in range(25_000)]
    df = spark.createDataFrame([(1, i, unlike[i % 25_000] + chr(0x4E00 + i // 25_000)) for i in range(100_000)], "g int, pos int, answer string")
    got = greedy.greedy_kept(df, ["g"], [F.col("pos")])
    assert tuple(got.agg(F.count("*"), F.max("pos"), F.max("rank")).first()) == (25_000, 24_999, 25_000)
    assert greedy.greedy_kept(df.limit(0), ["g"], [F.col("pos")]).collect() == []
