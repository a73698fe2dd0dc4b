"""The pipeline's stages against what their operators say of their own input."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import exact_dedup, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    try:
        docs = spark.read.parquet(f"{SF}/documents.parquet")
    except Exception:
        pytest.skip("no test tables")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        seen[name] = (before, docs)
        assert name == "bpe" or docs.columns == columns
    before, after = seen["exact_dedup"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in exact_dedup.exact_groups(before).filter("kept").collect()}
    before, after = seen["simhash_near_dedup"]
    assert {r.doc_id for r in after.collect()} == {r.component_id for r in simhash.near_groups(before, words=5).collect()}
    before, after = seen["toxicity"]
    assert 0 < after.count() <= before.count() and not any(w in (r.text or "") for r in after.collect() for w in ("idiot trash",))
    mix, out = seen["bpe"]
    assert Counter(r.doc_id for r in mix.collect()) == Counter(r.doc_id for r in out.collect()) and max(Counter(r.doc_id for r in mix.collect()).values()) <= 3
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "source_mixing", "bpe"]


def test_near_copies_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    texts = []
    for n in (3, 9, 30, 60, 200):
        for _ in range(6):
            base = [f"w{rng.randrange(400)}" for _ in range(n)]
            texts.append(base)
            for edits in (0, 1, 1, 2, 3, 5, 8):  # some copies are above 0.8, some below, some linked by others only
                base = list(rng.choice([base, texts[-1]]))
                for _ in range(edits):
                    base[rng.randrange(len(base))] = f"x{rng.randrange(10**6)}"
                texts.append(base)
    passage = [f"p{k}" for k in range(40)]
    texts += [[*passage, *[f"y{rng.randrange(10**6)}" for _ in range(rng.randint(0, 60))]] for _ in range(60)]
    texts = [*(" ".join(t) for t in texts), None, "", " \n", "Same  Words", "same words"]
    sets = [{" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    label = list(range(len(texts)))
    far = 0
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                far += (simhash.fingerprint((texts[i] or "").encode(), 5) ^ simhash.fingerprint((texts[j] or "").encode(), 5)).bit_count() > 4
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert far > 20  # links that 4 bits lose
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.component_id for r in simhash.near_groups(docs, words=5).collect()} == dict(enumerate(label))
    out = simhash.near_dedup(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(set(label))
    assert simhash.near_groups(docs.limit(0), words=5).count() == 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _store(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, DOCS).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"file://{tmp_path}/labels.parquet")
    return f"file://{tmp_path}"


def test_odd_tables_run_whole(spark, tmp_path):
    """Null ids, texts and sources, repeated rows, a long text and no labels: nothing fails, no clean text is lost but for the mix."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)), "en", "a" if i % 3 else None, 1) for i in range(60)]
    rows += [(None, "a row without id " * 5, "en", "a", 1), (None, None, None, None, None), (60, None, "en", "a", 0), (61, "", "en", "b", 0), (62, " ".join(rng.choice(words) for _ in range(60_000)), "en", "b", 1), rows[5], rows[5], (63, rows[7][1], "en", "a", 1)]
    sf = _store(spark, tmp_path, rows, [])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf)
        if name == "toxicity":
            assert docs.count() == len(rows)
    kept = [r.doc_id for r in docs.collect()]
    assert {*range(60), 62} <= set(kept) and 63 not in kept and kept.count(5) == 1
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and {r.doc_id for r in out} <= set(kept)


def test_an_empty_corpus(spark, tmp_path):
    assert corpus_pipeline.run(spark, _store(spark, tmp_path, [], [(1, 1, 1)])).collect() == []


def test_sets_meet_part_by_part(spark, monkeypatch):
    """Only a part of the pairs' shingles moves at a time, each part once, and a pair that differs too much already doesn't go on."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    some = {0: base, 1: [*base[:395], "x1", "x2", "x3", "x4", "x5"], 2: [*base[:150], *[f"y{rng.randrange(10**6)}" for _ in range(250)]], 3: [*base[:340], *[f"z{k}" for k in range(60)]]}
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in some.items()], "doc_id long, text string")
    names = {k: simhash._name(simhash.shingles(" ".join(t).encode(), 5)) for k, t in some.items()}
    nodes = spark.createDataFrame([(names[k], r._k) for k, r in zip(some, docs.orderBy("doc_id").selectExpr("xxhash64(text) as _k").collect())], "_set long, _text_key long")
    pairs = spark.createDataFrame([(names[0], names[k]) for k in (1, 2, 3)], "a long, b long")
    moved, meet = [], simhash._meet
    monkeypatch.setattr(simhash, "_meet", lambda p, *rest: moved.append((p.count(), meet(p, *rest))) or moved[-1][1])
    found = simhash._alike(pairs, nodes, docs, "text", 5).collect()
    assert [(r.a, r.b) for r in found] == [(names[0], names[1])]
    assert [n for n, _ in moved][0] == 3 and [n for n, _ in moved][-1] < 3 and len(moved) == simhash.PARTS


def test_odd_counts_never_part_alike_sets():
    """The bound holds for any two sets, of sizes with fewer or more slots too, and parts most of those that differ by much."""
    rng = np.random.default_rng(3)
    parted = 0
    for n in (0, 1, 2, 5, 63, 64, 65, 120, 600, 1024, 1030, 5000):
        for share in (0, 0.02, 0.1, 0.2, 0.5, 1):
            x = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
            y = np.unique(np.concatenate([x[int(n * share) :], rng.integers(0, 1 << 64, int(n * share * rng.choice([0, 1, 2])), np.uint64)]))
            apart, least = len(np.setxor1d(x, y)), simhash.least_apart(simhash.odd_counts(x), simhash.odd_counts(y))
            assert least <= apart and (apart - least) % 2 == 0 and least == simhash.least_apart(simhash.odd_counts(y), simhash.odd_counts(x))
            parted += n >= 600 and share == 1 and len(y) and least * 9 > len(x) + len(y)
    assert parted


def test_texts_of_unlike_sets_are_not_read_again(spark, monkeypatch):
    """Sets that meet at a rare shingle of theirs but are unlike don't go on to the comparison of whole sets, and no text of the others is shuffled."""
    rng = random.Random(11)
    lead, texts = [f"p{k}" for k in range(12)], []
    for _ in range(40):  # the same beginning, and an own text behind
        texts.append([*lead, *[f"y{rng.randrange(10**6)}" for _ in range(48)]])
    texts += [[*texts[0][:-1], "z"], [*texts[1][:-1], "z"]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    asked, plans, alike, written = [], [], simhash._alike, simhash.written
    monkeypatch.setattr(simhash, "_fits", lambda *_: F.lit(True))  # every two that meet are a pair
    monkeypatch.setattr(simhash, "_alike", lambda p, *rest: asked.append(p.count()) or alike(p, *rest))
    monkeypatch.setattr(simhash, "written", lambda df: plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or written(df))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {r.doc_id: r.component_id for r in simhash.near_groups(docs, words=5).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == {**{k: k for k in range(40)}, 40: 0, 41: 1}
    assert sum(asked) <= 2
    of_texts = [p for c, p in plans if "_own0" in c]
    assert of_texts and not any("SortMergeJoin" in p for p in of_texts)


def test_a_set_of_many_pairs_is_dealt(spark, monkeypatch):
    """A set that most pairs have meets them in parts, and each pair gets its own columns once."""
    monkeypatch.setattr(simhash, "SHARE", 4)
    pairs = spark.createDataFrame([(0, k) for k in range(1, 50)] + [(7, 8), (9, 7)], "a long, b long")
    hot = simhash._shared(pairs)
    assert {r._set: r._parts for r in hot.collect()} == {0: 13}
    table = spark.range(50).selectExpr("id as _set", "10 * id as v").join(hot, "_set", "left")
    both = simhash._meet(pairs, table, hot, {"v": "x"}, {"v": "y"})
    assert sorted((r.a, r.b, r.x, r.y) for r in both.collect()) == sorted((r.a, r.b, 10 * r.a, 10 * r.b) for r in pairs.collect())
    assert "Union" not in both._jdf.queryExecution().optimizedPlan().toString()
