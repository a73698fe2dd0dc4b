"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from granary.llm import collocations

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, most, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LETTERS)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    made = {}
    for (lang, *w), a in f.items():
        if len(w) > 1 and a >= least:
            cuts = [(2_000_000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            made[lang, tuple(w)] = (a, f[lang, *w[:k]], f[lang, *w[k:]], n[lang], score)
    out = []
    for lang in n:
        own = [(w, *r) for (x, w), r in made.items() if x == lang]
        kept = [r for r in own if not any(len(v) > len(r[0]) and 100 * b >= 80 * r[1] and any(v[i : i + len(r[0])] == r[0] for i in range(len(v))) for v, b, *_ in own)]
        kept.sort(key=lambda r: (-r[5], -r[1], " ".join(r[0]).encode()))
        out += [(lang, i + 1, " ".join(r[0]), *r[1:]) for i, r in enumerate(kept[:top])]
    return sorted(out)


def texts(seed):
    rng = random.Random(seed)
    words = ["The", "of", "new", "york", "city", "hall", "é", "Ü", "a-b", "x y", " "] + [f"w{i}" for i in range(60)]
    out = []
    for _ in range(300):
        own = []
        for _ in range(rng.randint(0, 30)):
            own += rng.choice([["New", "York"], ["new", "york", "city"], ["new", "york", "city", "hall"], [rng.choice(words)], [rng.choice(words)], ["the"]])
        out.append(("".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "! "]) for w in own), rng.choice(["en", "en", "en", "de", None, "und"])))
    return out + [(None, "en"), ("", "fr"), (" \t.", None), ("of the " * 3000, "en"), ("zz " * 200, "zz")] + out[:40]


@pytest.mark.parametrize(("most", "least", "bits", "top"), [(4, 30, 1 << 27, 2000), (4, 3, 1 << 17, 15), (3, 2, 1 << 27, 9), (2, 1, 1 << 27, 10_000)])
def test_collocations(spark, most, least, bits, top):
    rows = texts(1)
    docs = spark.createDataFrame([(t, x, 1, "a") for t, x in rows], "text string, lang string, _n long, _phrase string").repartition(5)
    got = collocations.collocations(docs, most=most, least=least, top=top).collect()
    assert sorted(map(tuple, got)) == brute(rows, most, least, top)
    assert collocations.collocations(docs.limit(0)).collect() == []


def test_blocks_and_long_texts():
    """Blocks of a few words, and parts of a few bytes, count what one block counts."""
    lang, body = "en", ("a b c d e a b c. " * 50 + "f g " * 90).encode().translate(collocations._PLAIN)
    whole = collocations.Counter(lang, (1, 2, 3, 4), [])
    whole.add(body)
    want = {g: int(k) for grams, n in whole.counts() for g, k in zip(grams, n, strict=True)}
    got = Counter()
    parts = collocations.Counter(lang, (1, 2, 3, 4), [])
    for piece in body.split(b"\n"):
        parts.add(piece)
        for grams, n in parts.counts():
            got.update(dict(zip(grams, map(int, n), strict=True)))
        parts.forget()
    assert got == want and want[b"a b c d"] == 50 and want[b"c a"] if b"c a" in want else got == want


def test_a_full_filter_only_lets_more_through(spark):
    phrases = spark.createDataFrame([("en", f"w{i}") for i in range(3000)] + [("en", f"w{i} w{i + 1}") for i in range(3000)], "_lang string, _phrase string")
    small = collocations.frequent_filter(phrases, 1 << 15, 1 << 15)
    large = collocations.frequent_filter(phrases)
    keys = np.array([collocations._word_key("en", f"w{i}".encode()) for i in range(3001)], np.uint64)
    pairs = collocations._joined(keys[:-1], keys[1:])
    other = np.array([collocations._word_key("en", f"v{i}".encode()) for i in range(5000)], np.uint64)
    for f in (small, large):
        assert f(keys[:-1]).all() and f(pairs).all()
    assert large(other).mean() < 0.05 < small(other).mean() < 0.5


def test_counts_beyond_64_bits_of_products(spark):
    """The score's product is of decimals: counts near 2**62 give the exact quotient."""
    big = 1 << 61
    row = spark.createDataFrame([(big + 1, big + 3, big + 7)], "_a long, _l long, _r long").selectExpr(f"cast(_a as decimal(20,0)) * {collocations.SCALE} div (cast(_l as decimal(20,0)) + _r) AS s").first()
    assert row.s == (big + 1) * 2_000_000 // (2 * big + 10)
