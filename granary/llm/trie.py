"""Prefix trie of conversations: polynomial prefix fingerprints, verified turn by turn, and sums of subtrees without a walk over levels."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import forget, lookup, small_batches, written

#: Fingerprints are polynomials in BASE over the turns' hashes, modulo the prime 2**61 - 1.
P = (1 << 61) - 1
BITS = 61
BASE = 0x0B5E_55A1_7C0D_E123 % P
SEED = 13
#: Turns that a conversation takes over from the one it is rebuilt on, at most, and ids that share such a one.
HEAD, FAMILY = 8, 5
#: Ids of a node's ends that are joined into one piece of text at most.
ENDS = 4096

_P, _LOW, _30 = np.uint64(P), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_S = {i: np.uint64(i) for i in (1, 30, 31, 61)}


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _S[61])
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo P, of numbers below P, by halves of 30 and 31 bits."""
    ah, al, bh, bl = a >> _S[31], a & _LOW, b >> _S[31], b & _LOW
    mid = ah * bl + al * bh
    return _reduced(((ah * bh) << _S[1]) + (mid >> _S[30]) + ((mid & _30) << _S[31]) + al * bl)


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _reduced(a + b)


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _reduced(a + (_P - b))


def power(places: np.ndarray, base: int = BASE) -> np.ndarray:
    """base to each of the places, by squaring."""
    out, left, square = np.ones(len(places), np.uint64), places.astype(np.uint64), np.full(1, base, np.uint64)
    while left.any():
        odd = (left & _S[1]).astype(bool)
        out[odd] = times(out[odd], np.broadcast_to(square, int(odd.sum())))
        left, square = left >> _S[1], times(square, square)
    return out


def sums(x: np.ndarray) -> np.ndarray:
    """Prefix sums modulo P."""
    high, low = np.cumsum(x >> _S[31]), np.cumsum(x & _LOW)
    return plus(times(_reduced(high), np.full(len(x), 1 << 31, np.uint64)), _reduced(low))


def _runs(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in the order of a key: where each row's run begins, and where all runs begin."""
    starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    return np.repeat(starts, np.diff(np.append(starts, len(own)))), starts


def _turn_hash(role: str, text: str, bits: int) -> int:
    role_bytes = role.encode()
    return xxhash.xxh3_64_intdigest(struct.pack("<q", len(role_bytes)) + role_bytes + text.encode(), SEED) % P & ((1 << bits) - 1)


def _prefixes(bits: int):
    """Rows (_pid, _conv, _role, _text) of a partition, in order -> with _lpos, the place within the conversation's rows there, _lfp, their fingerprint up to the row, and _bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place, so_far = None, 0, np.zeros(1, np.uint64)
        for batch in batches:
            own = batch.column(1).to_numpy()
            if not len(own):
                continue
            at, starts = _runs(own)
            places = np.arange(len(own), dtype=np.int64) - at
            goes_on = own[0] == conv
            if goes_on:
                places[: starts[1] if len(starts) > 1 else len(own)] += place
            hashes = np.array([_turn_hash(r, t, bits) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], np.uint64)
            total = sums(times(hashes, power(places)))
            prints = minus(total, np.where(at > 0, total[at - 1], np.uint64(0)))
            if goes_on:
                first = at == 0
                prints[first] = plus(prints[first], so_far)
            conv, place, so_far = own[-1], int(places[-1]) + 1, prints[-1:]
            size = np.array([len(t.as_buffer()) for t in batch.column(3)], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places), pa.array(prints.view(np.int64)), pa.array(size)], ["_pid", "_conv", "_role", "_text", "_lpos", "_lfp", "_bytes"])

    return run


def _moved(carry: dict[int, tuple[int, int, int]]):
    """Rows (_pid, _conv, _lpos, _lfp, _bytes) -> with _pos and _fp over the whole conversation; carry: for a partition, the conversation that goes on in it, its rows before and their fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pid, conv, places, prints = (batch.column(c).to_numpy() for c in range(4))
            places, prints = places.copy(), prints.view(np.uint64).copy()
            for p in np.unique(pid).tolist():
                if p in carry:
                    on = (pid == p) & (conv == carry[p][0])
                    n = int(on.sum())
                    before = np.full(n, carry[p][1], np.int64)
                    prints[on] = plus(np.full(n, carry[p][2], np.uint64), times(prints[on], power(before)))
                    places[on] += before
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places), pa.array(prints.view(np.int64))], ["_pid", "_conv", "_lpos", "_lfp", "_bytes", "_pos", "_fp"])

    return run


def _crossing(table: DataFrame, key: str) -> DataFrame | None:
    """The keys, as many as there are partitions at most, whose rows go on from one partition of a table in the order of keys into the next."""
    spark = table.sparkSession
    ends = table.groupBy("_pid").agg(F.min(key).alias("a"), F.max(key).alias("b")).orderBy("_pid").collect()
    found = sorted({x.b for x, y in zip(ends, ends[1:], strict=False) if x.b == y.a})
    return spark.createDataFrame([(x,) for x in found], f"{key} long") if found else None


def numbered(turns: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """turns (_conv, _turn, _role, _text) -> a table of texts by (_conv, _pid, _lpos), and one without texts that has _pos, a turn's place from 0, and _fp, the fingerprint of the conversation up to it.

    One sort by ranges of conversation and turn, so a conversation of any length spans as many tasks as it needs. Each
    task scans its own rows; what a conversation has in earlier tasks is added from one row for each task.
    """
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["_conv", F.col("_turn").asc_nulls_first(), "_role", "_text"]
    rows = turns.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("_pid"), "_conv", "_role", "_text")
    texts = written(small_batches(rows).mapInArrow(_prefixes(bits), "_pid int, _conv long, _role string, _text string, _lpos long, _lfp long, _bytes long"))
    carry: dict[int, tuple[int, int, int]] = {}
    if (over := _crossing(texts, "_conv")) is not None:
        parts = texts.join(F.broadcast(over), "_conv").groupBy("_conv", "_pid").agg(F.count("*").alias("n"), F.max_by("_lfp", "_lpos").alias("f")).orderBy("_conv", "_pid").collect()
        before: dict[int, tuple[int, int]] = {}
        for r in parts:
            n, f = before.get(r._conv, (0, 0))
            if n:
                carry[r._pid] = (r._conv, n, f)
            before[r._conv] = (n + r.n, (f + pow(BASE, n, P) * r.f) % P)
    narrow = texts.select("_pid", "_conv", "_lpos", "_lfp", "_bytes").mapInArrow(_moved(carry), "_pid int, _conv long, _lpos long, _lfp long, _bytes long, _pos long, _fp long")
    return texts, written(narrow.drop("_lfp"))


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (fingerprint, of what is left out, of what comes first, places to move back, ...) -> the fingerprint in the rebuilt conversation, ..."""
    back = np.ones(HEAD + 1, np.uint64)
    back[1:] = power(np.arange(1, HEAD + 1), pow(BASE, -1, P))
    for batch in batches:
        own, out, first = (batch.column(c).to_numpy().view(np.uint64) for c in range(3))
        moved = plus(first, times(minus(own, out), back[batch.column(3).to_numpy()]))
        yield pa.RecordBatch.from_arrays([pa.array(moved.view(np.int64)), *batch.columns[4:]], ["_f", "_c", "_d", "_last", "_bytes", "_rconv", "_rpid", "_rlpos"])


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows of numbered() -> (_c, _d, _f, _last, _bytes, _r*: the turn's place in the texts) of the rebuilt conversations, and one row (_c, _len) for each of them.

    Conversation c takes the first h turns of c - c % FAMILY, h = crc32(c) % 9, then its own turns after its first h. A
    rebuilt conversation's fingerprints follow from those of its two parts, so nothing is sorted again.
    """
    convs = written(rows.groupBy("_conv").agg(F.count("*").alias("_n"), F.sort_array(F.collect_list(F.when(F.col("_pos") < HEAD, F.struct("_pos", "_fp")))).alias("_first")))
    base = convs.select(F.col("_conv").alias("_b"), F.col("_n").alias("_nb"), F.col("_first").alias("_fb"))
    heads = convs.withColumn("_b", F.expr(f"_conv - _conv % {FAMILY}")).withColumn("_h", F.crc32(F.col("_conv").cast("string").cast("binary")) % (HEAD + 1))
    heads = heads.join(base, "_b", "left").withColumn("_k", F.least("_h", F.coalesce("_nb", F.lit(0).cast("long"))))
    upto = lambda c, n: F.coalesce(F.try_element_at(c, F.when(F.col(n) > 0, F.col(n)).otherwise(HEAD + 1).cast("int"))["_fp"], F.lit(0).cast("long"))
    heads = written(heads.select("_conv", "_b", "_h", "_k", "_n", upto("_fb", "_k").alias("_pb"), upto("_first", "_h").alias("_pc"), (F.col("_k") + F.greatest(F.col("_n") - F.col("_h"), F.lit(0))).alias("_len")))
    place = [F.col("_pid").alias("_rpid"), F.col("_lpos").alias("_rlpos")]
    own = lookup(rows, heads, ["_conv"], "_n", max(1, rows.count())).filter("_pos >= _h")
    own = own.select(F.col("_fp"), F.col("_pc"), F.col("_pb"), (F.col("_h") - F.col("_k")).cast("int").alias("_back"), F.col("_conv").alias("_c"), (F.col("_k") + F.col("_pos") - F.col("_h") + 1).alias("_d"), "_len", "_bytes", F.col("_conv").alias("_rconv"), *place)
    zero = F.lit(0).cast("long")
    first = rows.filter(F.col("_pos") < HEAD).withColumnRenamed("_conv", "_rconv").join(heads.filter("_k > 0").select("_b", "_k", "_len", F.col("_conv").alias("_c")), F.col("_rconv") == F.col("_b")).filter("_pos < _k")
    first = first.select("_fp", zero.alias("_pc"), zero.alias("_pb"), F.lit(0).alias("_back"), "_c", (F.col("_pos") + 1).alias("_d"), "_len", "_bytes", "_rconv", *place)
    both = own.unionByName(first).select("_fp", "_pc", "_pb", "_back", "_c", "_d", (F.col("_d") == F.col("_len")).alias("_last"), "_bytes", "_rconv", "_rpid", "_rlpos")
    out = written(both.mapInArrow(_shifted, "_f long, _c long, _d long, _last boolean, _bytes long, _rconv long, _rpid int, _rlpos long"))
    forget(convs)
    return out, heads.select(F.col("_conv").alias("_c"), "_len")


def _groups(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows with the node's representative _rep (its smallest conversation), _n (members) and _ends (members of just that length).

    Rows of one depth and fingerprint are candidates for a node. Each turn is compared with the representative's turn at
    that depth; as this holds at every depth, equal turns all along are equal prefixes. Turns that differ, by a
    collision, get the digest of what they are as a part of their key, from their depth on, and all is grouped anew.
    """
    place = ["_rconv", "_rpid", "_rlpos"]
    total, bad = max(1, rows.count()), None
    keyed = rows.withColumn("_v", F.lit(""))
    text_of = lambda s: texts.select(*[F.col(c).alias(f"{s}{c}") for c in ("_conv", "_pid", "_lpos")], F.struct("_role", "_text").alias(f"{s}_turn"))
    while True:
        groups = written(keyed.groupBy("_d", "_f", "_v").agg(F.min(F.struct(F.col("_c").alias("_rep"), *[F.col(c).alias(f"o{c}") for c in place])).alias("_o"), F.count("*").alias("_n"), F.count_if("_last").alias("_ends")).select("_d", "_f", "_v", "_o.*", "_n", "_ends"))
        found = written(lookup(keyed, groups, ["_d", "_f", "_v"], "_n", total))
        forget(groups)
        pairs = written(found.filter(F.struct(*place) != F.struct(*[F.col(f"o{c}") for c in place])).select(*place, *[f"o{c}" for c in place]).distinct())
        uses = pairs.groupBy(*[f"o{c}" for c in place]).agg(F.count("*").alias("_uses"))
        theirs = text_of("o").join(uses.toDF("o_conv", "o_pid", "o_lpos", "_uses"), ["o_conv", "o_pid", "o_lpos"])
        mine = pairs.toDF("_conv", "_pid", "_lpos", "o_conv", "o_pid", "o_lpos").join(text_of(""), ["_conv", "_pid", "_lpos"])
        differ = lookup(mine, theirs, ["o_conv", "o_pid", "o_lpos"], "_uses", max(1, pairs.count())).filter("_turn <> o_turn")
        digest = F.sha2(F.concat(F.length("_turn._role").cast("string"), F.lit(":"), "_turn._role", "_turn._text").cast("binary"), 256)
        differ = written(differ.select(*[F.col(a).alias(b) for a, b in zip(("_conv", "_pid", "_lpos", "o_conv", "o_pid", "o_lpos"), (*place, *[f"o{c}" for c in place]), strict=True)], digest.alias("_key")))
        forget(pairs)
        if differ.isEmpty():
            return found.drop("_v", "_f", *place, *[f"o{c}" for c in place])
        new = found.join(differ, [*place, *[f"o{c}" for c in place]]).select("_c", F.struct("_d", "_key").alias("_e"))
        bad = written(new if bad is None else bad.unionByName(new))
        forget(found)
        of_conv = bad.groupBy("_c").agg(F.sort_array(F.collect_list("_e")).alias("_es"))
        until = F.filter(F.coalesce("_es", F.array()), lambda e: e["_d"] <= F.col("_d"))
        path = F.array_join(F.transform(until, lambda e: F.concat_ws(":", e["_d"].cast("string"), e["_key"])), ",")
        keyed = written(rows.join(of_conv, "_c", "left").withColumn("_v", F.sha2(path.cast("binary"), 256)).drop("_es"))


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_pid, _c, _d, _rep, _n, _saved, _leaf) of a partition, conversations from their last turn to their first -> _saved and _leaf summed up from the last turn on."""
    conv, so_far = None, (0, 0)
    for batch in batches:
        own = batch.column(1).to_numpy()
        if not len(own):
            continue
        at, _ = _runs(own)
        totals = []
        for c, before in zip((5, 6), so_far, strict=True):
            total = np.cumsum(batch.column(c).to_numpy())
            total = total - np.where(at > 0, total[at - 1], 0)
            totals.append(np.where(at == 0, total + before, total) if own[0] == conv else total)
        conv, so_far = own[-1], (int(totals[0][-1]), int(totals[1][-1]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], *[pa.array(t) for t in totals]], ["_pid", "_c", "_d", "_rep", "_n", "_saved", "_leaf"])


def _rolled(found: DataFrame) -> DataFrame:
    """One row for each node but the root: _rep, _d, _n, _leaves, _saved.

    Each node's own saving, and each leaf, is charged to the node's representative, which is a member of all nodes above.
    Summed up along each conversation from its end, then over the members of each node, they are the sums of subtrees:
    no walk over levels, however deep the trie is.
    """
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stands = F.col("_c") == F.col("_rep")
    rows = found.select("_c", "_d", "_rep", "_n", F.when(stands, (F.col("_n") - 1) * F.col("_bytes")).otherwise(0).alias("_saved"), (stands & F.col("_last") & (F.col("_ends") == F.col("_n"))).cast("long").alias("_leaf"))
    order = ["_c", F.col("_d").desc()]
    rows = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("_pid"), "*")
    local = written(rows.mapInArrow(_suffixes, "_pid int, _c long, _d long, _rep long, _n long, _saved long, _leaf long"))
    out = local
    if (over := _crossing(local, "_c")) is not None:
        parts = local.join(F.broadcast(over), "_c").groupBy("_c", "_pid").agg(F.max("_saved").alias("s"), F.max("_leaf").alias("l")).orderBy("_c", "_pid").collect()
        carry, before = [], {}
        for r in parts:
            s, leaf = before.get(r._c, (0, 0))
            carry.append((r._c, r._pid, s, leaf))
            before[r._c] = (s + r.s, leaf + r.l)
        more = found.sparkSession.createDataFrame(carry, "_c long, _pid int, _s long, _l long")
        out = local.join(F.broadcast(more), ["_c", "_pid"], "left").withColumn("_saved", F.col("_saved") + F.coalesce("_s", F.lit(0))).withColumn("_leaf", F.col("_leaf") + F.coalesce("_l", F.lit(0)))
    return written(out.groupBy("_rep", "_d").agg(F.count("*").alias("_n"), F.sum("_leaf").alias("_leaves"), F.sum("_saved").alias("_saved")))


def _ends_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of text (_rep, _d, _ids) in order -> SHA-256 of each node's pieces, comma-joined, one piece at a time."""
    key, digest = None, None
    for batch in batches:
        done = []
        for rep, d, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if (rep, d) == key:
                digest.update(b"," + ids.encode())
            else:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (rep, d), hashlib.sha256(ids.encode())
        yield _hash_rows(done)
    if key is not None:
        yield _hash_rows([(*key, digest.hexdigest())])


def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["_rep", "_d", "_sha"])


def ends(rows: DataFrame) -> DataFrame:
    """rows (_rep, _d, _c) -> (_rep, _d, _sha): SHA-256 of the comma-joined _c, ascending. Ids are first joined in pieces of ENDS numbers' range, which are then hashed one after the other, so a node of any size is held nowhere."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = rows.groupBy("_rep", "_d", F.floor(F.col("_c") / ENDS).alias("_piece")).agg(F.array_join(F.sort_array(F.collect_list("_c")).cast("array<string>"), ",").alias("_ids"))
    pieces = pieces.repartition(tasks, "_rep", "_d").sortWithinPartitions("_rep", "_d", "_piece").select("_rep", "_d", "_ids")
    return small_batches(pieces).mapInArrow(_ends_hash, "_rep long, _d long, _sha string")


def prefix_trie(conversations: DataFrame, bits: int = BITS) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations: conv_id, turn, role, text. Turns are ordered by turn (null first), then role, then text; null roles and
    texts count as empty, and rows that repeat are turns of their own. Conversation c is rebuilt as told in rebuilt();
    with too few turns it may be turnless, which makes it a member of the root alone. Rows with a null conv_id take no
    part. Texts and conversations of any length are read whole. An empty table has no conversation, so no node either.
    Columns beside the four are not read, so their names do not matter. bits: of a turn's hash; fewer only make more
    collisions, which are split, with the same result.
    """
    spark = conversations.sparkSession
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("_conv"), F.col("turn").alias("_turn"), F.coalesce("role", F.lit("")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text"))
    texts, rows = numbered(turns, bits)
    parts, convs = rebuilt(rows)
    forget(rows)
    found = _groups(parts, texts)
    nodes = _rolled(found)
    root = convs.agg(F.min("_c").alias("a"), F.count("*").alias("n")).first()
    top = nodes.filter("_d = 1").agg(F.count("*").alias("_children"), F.greatest(F.coalesce(F.sum("_leaves"), F.lit(0)), F.lit(1)).alias("_leaves"), F.coalesce(F.sum("_saved"), F.lit(0)).alias("_saved"))
    first = F.lit(root.a).cast("long")
    top = top.filter(F.lit(root.n > 0)).select(first.alias("_rep"), F.lit(0).cast("long").alias("_d"), F.lit(root.n).cast("long").alias("_n"), "_leaves", "_saved", F.lit(None).cast("long").alias("_parent"))
    above = found.select(F.col("_c").alias("_rep"), (F.col("_d") + 1).alias("_d"), F.col("_rep").alias("_above"))
    linked = nodes.join(above, ["_rep", "_d"], "left").withColumn("_parent", F.coalesce("_above", first)).drop("_above")
    every = written(linked.unionByName(top))
    children = every.filter("_d > 0").groupBy(F.col("_parent").alias("_rep"), (F.col("_d") - 1).alias("_d")).agg(F.count("*").alias("_children"))
    last = found.filter("_last").select("_rep", "_d", "_c").unionByName(convs.filter("_len = 0").select(first.alias("_rep"), F.lit(0).cast("long").alias("_d"), "_c"))
    out = every.join(children, ["_rep", "_d"], "left").join(ends(last), ["_rep", "_d"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("_rep").alias("conv_id"), F.col("_d").alias("depth"), F.col("_parent").alias("parent_conv_id"), F.col("_n").alias("n_convs"), F.coalesce("_children", F.lit(0).cast("long")).alias("n_children"), F.col("_leaves").alias("n_leaves"), F.col("_saved").alias("saved_tokens"), F.coalesce("_sha", F.lit(none)).alias("ends_sha256"))


ORACLE_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT DISTINCT conv_id FROM t),
h AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 9 AS h FROM i),
r AS (SELECT h.conv_id AS c, 0 AS part, t.pos, t.role, t.text FROM h JOIN t ON t.conv_id = h.base AND t.pos <= h.h
  UNION ALL SELECT h.conv_id, 1, t.pos, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id AND t.pos > h.h),
d AS (SELECT c, row_number() OVER w AS d, strlen(text) AS bytes, sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER w) AS path,
  row_number() OVER w = count(*) OVER (PARTITION BY c) AS last FROM r WINDOW w AS (PARTITION BY c ORDER BY part, pos)),
g AS (SELECT c, d, last, bytes, min(c) OVER (PARTITION BY d, path) AS m FROM d
  UNION ALL SELECT conv_id, 0, conv_id NOT IN (SELECT c FROM r), 0, (SELECT min(conv_id) FROM i) FROM i),
n AS (SELECT m, d, count(*) AS n, max(bytes) AS bytes, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last) AS ends FROM g GROUP BY m, d),
p AS (SELECT n.*, g.m AS parent FROM n LEFT JOIN g ON g.c = n.m AND g.d = n.d - 1),
k AS (SELECT parent, d - 1 AS d, count(*) AS children FROM p WHERE d > 0 GROUP BY ALL),
a AS (SELECT p.*, coalesce(children, 0) AS children FROM p LEFT JOIN k ON k.parent = p.m AND k.d = p.d),
s AS (SELECT g.m, g.d, sum((v.n - 1) * v.bytes) AS saved, count(*) FILTER (WHERE v.children = 0) AS leaves FROM g JOIN a v ON v.m = g.c AND v.d >= g.d GROUP BY g.m, g.d)
SELECT a.m AS conv_id, a.d::BIGINT AS depth, a.parent AS parent_conv_id, a.n::BIGINT AS n_convs, a.children::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens,
  sha256(coalesce(a.ends, '')) AS ends_sha256 FROM a JOIN s ON s.m = a.m AND s.d = a.d
"""
