"""Class-based n-grams against a model written out plainly, and what the exchange gains."""

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import brown

DOCS = "doc_id long, text string, lang string, _word string, _n long"
LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return (text or "").translate(LETTERS).encode().split() + [b""]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def texts(n=400, seed=1):
    """Two languages whose verbs follow their nouns, rare words, copies and odd rows."""
    rng = random.Random(seed)
    nouns, verbs = ([[f"{k}{x}{i}" for i in range(25)] for x in "ab"] for k in ("n", "v"))
    out = []
    for i in range(n):
        lang = rng.randrange(2)
        own = []
        for _ in range(rng.randint(1, 30)):
            own += ["The" if lang else "le", rng.choice(nouns[lang]), rng.choice(verbs[lang])]
            if rng.random() < 0.2:
                own += [f"r{rng.randrange(4000)}"] * rng.randint(1, 2) + [f"q{rng.randrange(4000)}"] * rng.randint(0, 1)
        out.append((i, " ".join(own)))
    return out + [(n, None), (n + 1, ""), (n + 2, " \t"), (3, out[3][1]), (3, out[5][1]), (None, out[1][1]), (n + 3, "zz " * 5000 + "é Ü"), (n + 4, "hot\nunknown " * 40)]


@pytest.mark.parametrize(("words", "sweeps"), [(1 << 18, 4), (40, 3), (1, 1)])
def test_scores_are_those_of_the_model_written_out(spark, words, sweeps):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x", "w", 7) for i, t in rows], DOCS).repartition(5)
    classes = 12
    model = brown.train(docs.filter(~brown.held_out("doc_id")), "text", words=words, classes=classes, sweeps=sweeps)
    of = {w: int(k) for w, k in zip(model.words, model.classes[:-1], strict=True)}
    if model.rare is not None:
        of |= {r._word.encode(): r._class for r in model.rare.collect()}
    train = [tokens(t) for i, t in rows if not held(i)]
    count = Counter(w for t in train for w in t)
    assert set(of) == set(count) and model.tokens == sum(count.values()) and model.known == len(count)
    n, v = model.tokens, len(count)
    move, size, kinds = Counter(), Counter(), Counter(of.values())
    for t in train:
        move.update((of[a], of[b]) for a, b in zip([b"", *t], t))
        size.update(of[w] for w in t)
    assert {(a, b): int(x) for (a, b), x in np.ndenumerate(model.transitions) if x} == dict(move)
    unknown, after = 0.1 / (n + 0.1 * (v + 1)), Counter()
    for (a, _), x in move.items():
        after[a] += x

    def p(h, w):
        if w not in of:
            return unknown
        mass = size[of[w]] + 0.1 * kinds[of[w]]
        share = mass / (n + 0.1 * v)
        seen, total = (move[of[h], of[w]], after[of[h]]) if h in of else (0, 0)
        return (1 - unknown) * (seen + 64 * share) / (total + 64) * (count[w] + 0.1) / mass

    for h in [b"", b"the", b"le", b"never"]:
        assert abs(sum(p(h, w) for w in of) + unknown - 1) < 1e-9
    want = []
    for i, t in rows:
        ts = tokens(t)
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts)
        want.append((i, held(i), len(ts), sum(w in count for w in ts), n, base, sum(math.log10(p(h, w)) for h, w in zip([b"", *ts], ts))))
    got = sorted((tuple(r) for r in brown.class_scores(docs, words=words, classes=classes, sweeps=sweeps).collect()), key=repr)
    want.sort(key=repr)
    assert sorted(r[:5] for r in got if r[0] is not None) == sorted(r[:5] for r in want if r[0] is not None)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 4))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6) and a[6] == pytest.approx(b[6], abs=1e-6)
    if words > 1:
        assert sum(r[6] for r in got if r[1]) > sum(r[5] for r in got if r[1]) * 0.97  # held-out texts are likelier by classes


def test_the_exchange_gains_and_finds_the_parts_of_speech(spark):
    docs = spark.createDataFrame([(t,) for i, t in texts(600) if i is not None and i < 600], "text string")
    near = [brown.train(docs, sweeps=k, classes=8) for k in (0, 6)]
    assert brown.objective(near[1].transitions) > brown.objective(near[0].transitions)
    kinds: dict[int, Counter] = {}
    for w, c in zip(near[1].words, near[1].classes, strict=False):
        if w[:2] in (b"na", b"nb", b"va", b"vb"):
            kinds.setdefault(int(c), Counter())[w[:2]] += 1
    print(kinds)
    assert sum(max(k.values()) for k in kinds.values()) > 0.7 * sum(sum(k.values()) for k in kinds.values())


def test_gains_of_a_word_are_differences_of_the_objective():
    rng = np.random.default_rng(3)
    matrix = rng.integers(0, 50, (6, 6)).astype(float)
    near = np.zeros((1, 12))
    near[0, [1, 5]], near[0, [6 + 2, 6 + 3]] = [4, 1], [3, 2]
    got = brown.gains(near, matrix)[0]
    for b in range(5):
        if b not in (1, 2, 3):  # classes that stand beside the word count it on both sides at once
            then = matrix.copy()
            then[:, b] += near[0, :6]
            then[b] += near[0, 6:]
            f = lambda x: float(np.sum(x * np.log(np.maximum(x, 1))))
            sizes = lambda m: f(m.sum(axis=0)[b]) + f(m.sum(axis=1)[b])
            assert got[b] == pytest.approx(f(then) - f(matrix) - sizes(then) + sizes(matrix))


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(i, t, "x", "w", 7) for i, t in texts(20)], DOCS)
    empty = brown.class_scores(docs.filter(brown.held_out("doc_id"))).collect()
    assert empty and all(r.train_tokens == 0 and r.score == r.base_score == 0 and r.n_known == 0 for r in empty)
    assert brown.class_scores(docs.limit(0)).collect() == []
    one = brown.class_scores(docs.filter("text is null or text = ''").withColumn("doc_id", F.lit(1))).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in one] == [(1, 1, 2)] * 2


def test_tokens_of_a_run_are_not_all_held_as_objects():
    """Numbers of 600,000 tokens are given at once, but only SPLIT of the tokens themselves are held."""
    text = " ".join(f"w{i % 5000}" for i in range(6000))
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 100)], ["text"])
    numbers = {f"w{i}".encode(): i for i in range(100)} | {b"": 100}
    tracemalloc.start()
    runs = list(brown._flat(iter([batch, batch.slice(0, 1)]), numbers, lambda at: [at]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(r) for r in runs] == [101 * 6001 + 1] and peak < 20 << 20
    want = [*[i % 5000 if i % 5000 < 100 else 101 for i in range(6000)], 100]
    assert runs[0].tolist() == [100, *want * 101]
