"""The prefix trie against a walk over dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from granary.llm import trie

TURNS = "conv_id long, turn long, role string, text string, _c string, depth int"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))] for c, v in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(own.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + own[c][h:])
    members = defaultdict(set)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for path, m in members.items():
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(m) - 1) * len(path[-1][1].encode()) if path else 0
            leaves[path[:d]] += children[path] == 0
    out = []
    for path, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(made[c]) == len(path))
        out.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def sample(n, seed, ids=range(0, 400)):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(list(ids), n):
        for t in range(rng.choice([1, 2, 3, 5, 9, 12])):
            out.append((c, None if rng.random() < 0.05 else t if rng.random() < 0.9 else t - 1, rng.choice(["user", "assistant", None]), rng.choice(["", None, "a", "b", "é ü", "x" * 50]), "z", 1))
    return out


@pytest.mark.parametrize("bits", [61, 3, 0])
def test_trie(spark, bits):
    """Few bits make nearly all fingerprints collide: what is verified and split gives the same nodes."""
    rows = sample(150, 1) + [(None, 1, "user", "no conversation", "z", 1)] + [(500, 3, "user", "same", "z", 1)] * 4 + [(505, 3, "user", "same", "z", 1)] * 9 + [(-7, 1, "u", "q", "z", 1), (-5, 1, "u", "q", "z", 1)] + [(3 * 10**18, 1, "u", "y" * 200_000, "z", 1)]
    got = trie.prefix_trie(spark.createDataFrame(rows, TURNS), bits).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[1], r[0])) == brute(rows)


def test_a_conversation_that_spans_all_tasks(spark):
    """One conversation, and its copies, with most of the rows: places, fingerprints and sums go on from task to task."""
    rng = random.Random(2)
    long = [rng.choice(["a", "b"]) for _ in range(1500)]
    rows = [(c, t, "user", x, "z", 1) for c in (1000, 1001, 1002) for t, x in enumerate(long)] + sample(30, 3)
    want = brute(rows)
    got = trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(5)).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[1], r[0])) == want


def test_ends_of_a_large_node_and_turnless_conversations(spark, monkeypatch):
    rows = [(c, 0, "user", "hi", "z", 1) for c in range(0, 4000, 5)] + [(c, 0, "user", "hi", "z", 1) for c in range(10_001, 10_400, 5)]
    monkeypatch.setattr(trie, "ENDS", 16)
    got = trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[1], r[0])) == brute(rows)
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    lonely = [(10_001 + 5 * k, 0, "user", "hi", "z", 1) for k in range(9)]
    assert sorted(map(tuple, trie.prefix_trie(spark.createDataFrame(lonely, TURNS)).collect()), key=lambda r: (r[1], r[0])) == brute(lonely)


def test_arithmetic():
    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, trie.P, 500, dtype=np.uint64) for _ in range(2))
    a[:3], b[:3] = [0, trie.P - 1, trie.P - 1], [trie.P - 1, trie.P - 1, 1]
    assert trie.times(a, b).tolist() == [int(x) * int(y) % trie.P for x, y in zip(a, b)]
    assert trie.minus(a, b).tolist() == [(int(x) - int(y)) % trie.P for x, y in zip(a, b)]
    total, want = 0, []
    for x in a.tolist():
        want.append(total := (total + x) % trie.P)
    assert trie.sums(a).tolist() == want
    assert trie.power(np.arange(70)).tolist() == [pow(trie.BASE, k, trie.P) for k in range(70)]
