"""Substring deduplication with a log-structured index of fingerprints."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import forget, lookup, release, small_batches, written

#: Words of a window, and of the anchors that stand for windows in the index.
WORDS = 13
ANCHOR = 5
#: Batches that the query takes one after the other, in the order of ids, and runs that are compacted into one.
BATCHES = 3
FANOUT = 2
#: Bits of the filter of shared anchors, 16 an anchor within these bounds: at most 32 MB go to the executors. Beyond
#: that bound more windows are verified, with the same results.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: Bytes of text that are hashed at once.
BLOCK = 1 << 20
_RNG = np.random.default_rng(13)
_SEED = [int(x) for x in _RNG.integers(1, 1 << 63, 2, dtype=np.uint64)]
_ODD = [np.uint64(int(x) | 1) for x in _RNG.integers(1 << 40, 1 << 63, 2, dtype=np.uint64)]
_BASE = [int(x) | 1 for x in _RNG.integers(1 << 40, 1 << 63, 2, dtype=np.uint64)]
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
#: Bytes of a word that are hashed eight at a time beside other words; a longer word goes through XXH64 alone.
LONG = 256


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX[0]
    h = (h ^ (h >> np.uint64(33))) * _MIX[1]
    return h ^ (h >> np.uint64(33))


_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class Hasher:
    """Hashes of words and of runs of words. Two families, which = 0 and 1, are independent.

    A word is mixed after every eight bytes, so that no structure of its letters carries over; a run of words, of which
    spans have 21 at most, is a polynomial of its words' hashes modulo 2**64, mixed.
    """

    def __init__(self) -> None:
        self.power = [_powers(b, 1) for b in _BASE]
        self.inverse = [_powers(1, 1) for _ in _BASE]

    def _reserve(self, n: int) -> None:
        if len(self.power[0]) < n:
            n = max(n, 1 << 18)
            self.power = [_powers(b, n) for b in _BASE]
            self.inverse = [_powers(pow(b, -1, 1 << 64), n) for b in _BASE]

    def between(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
        """The hash of values[start:end] for each pair."""
        self._reserve(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.power[which][: len(values)], out=sums[1:])
        return _mixed((sums[ends] - sums[starts]) * self.inverse[which][starts] + (ends - starts).astype(np.uint64))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
        """One hash for each word of some text."""
        size = ends - starts
        out = _mixed(size.astype(np.uint64) * _MIX[0] + np.uint64(_SEED[which]))
        lanes = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))  # the eight bytes from each place
        at, done = np.flatnonzero(size <= LONG), 0
        while len(at):
            lane, left = lanes[starts[at] + done], size[at] - done
            lane &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.maximum(0, 8 - left) * 8).astype(np.uint64)
            out[at] = _mixed((out[at] ^ lane) * _ODD[which])
            done += 8
            at = at[left > 8]
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), _SEED[which])
        return out

    def runs(self, words: np.ndarray, k: int, which: int) -> np.ndarray:
        """The hash of each run of k words."""
        n = len(words) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * np.uint64(_BASE[which]) + words[j : j + n]
        return _mixed(out)


class Texts:
    """Some documents' texts side by side: where words begin and end, and the document of each, by array operations on the Arrow buffer."""

    def __init__(self, column: pa.StringArray, hasher: Hasher) -> None:
        self.hasher = hasher
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = column.buffers()[2]
        self.data = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
        bounds = offsets - offsets[0]
        n = len(self.data)
        space = _SPACES[self.data]
        first = np.zeros(n + 1, bool)
        first[bounds] = True  # no word goes on from one document to the next
        begins, ends = ~space, ~space
        if n:
            begins[1:] &= space[:-1] | first[1:n]
            ends[:-1] &= space[1:] | first[1:n]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(bounds, self.starts, "right") - 1
        self.head = np.searchsorted(self.doc, np.arange(len(column)))  # the first word of each document
        self.hashes: dict[int, np.ndarray] = {}

    def words(self, which: int = 0) -> np.ndarray:
        if which not in self.hashes:
            self.hashes[which] = self.hasher.words(self.data, self.starts, self.ends, which)
        return self.hashes[which]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes of the runs of ANCHOR words, the windows, the place of each window's anchor).

        A window's anchor is that of its runs with the smallest hash, the first of several. Windows with the same words
        have the same anchor at the same place in them, and about one run in five is an anchor.
        """
        grams = self.hasher.runs(self.words(), ANCHOR, 0)
        n = len(self.starts) - WORDS + 1
        if n <= 0:
            return grams, np.zeros(0, np.int64), np.zeros(0, np.int64)
        best, place = grams[:n].copy(), np.zeros(n, np.int8)
        for k in range(1, WORDS - ANCHOR + 1):
            other = grams[k : k + n]
            less = other < best
            np.copyto(best, other, where=less)
            place[less] = k
        windows = np.flatnonzero(self.doc[:n] == self.doc[WORDS - 1 :])
        return grams, windows, windows + place[windows]

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, first window, number of windows) of the runs of windows that share an anchor's place."""
        grams, windows, place = self.anchors()
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, np.int64)
        return grams[place[first]] if len(first) else np.zeros(0, np.uint64), windows[first], np.diff(np.append(first, len(place)))

    def span_hash(self, first: np.ndarray, count: np.ndarray, which: int) -> np.ndarray:
        return self.hasher.between(self.words(which), first, first + count + WORDS - 1, which)


def _parts(batch: pa.RecordBatch, hasher: Hasher) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """A batch in parts of about BLOCK bytes of text; one very long text is a part of its own."""
    column = batch.column(1)
    sizes = np.cumsum(np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])) if len(column) else np.zeros(0)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK, "right")))
        part = batch.slice(at, to - at)
        yield part, Texts(part.column(1), hasher)
        at = to


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, least id, span to the largest id) of parts of the documents: what many documents of a part share is one row."""
    hasher = Hasher()
    for batch in batches:
        for part, texts in _parts(batch, hasher):
            keys, first, _ = texts.spans()
            if not len(keys):
                continue
            owners = part.column(0).to_numpy()[texts.doc[first]]
            order = np.lexsort((owners, keys))
            keys, owners = keys[order], owners[order]
            at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            to = np.append(at[1:], len(keys)) - 1
            yield pa.RecordBatch.from_arrays([_signed(keys[at]), pa.array(owners[at]), pa.array(owners[to])], ["anchor", "least", "most"])


class FingerprintIndex:
    """Sorted immutable runs of the anchors of all documents so far: (anchor, least id, largest id), in buckets by anchor.

    A new batch is aggregated into a run of its own, which Spark merge-joins with each older run without a shuffle or a
    sort of the older one, as both are bucketed and sorted alike. Runs of like age are compacted into one. Runs are
    tables, so they outlive executors and, under a name, the session.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int = 0) -> None:
        self.spark = spark
        self.name = name or f"granary_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str]] = []  # (tier, table), oldest first
        self.made = 0

    def _write(self, rows: DataFrame, tier: int) -> None:
        table = f"{self.name}_{self.made}"
        self.made += 1
        rows.repartition(self.buckets, "anchor").write.bucketBy(self.buckets, "anchor").sortBy("anchor").option("compression", "zstd").format("parquet").saveAsTable(table)
        self.runs.append((tier, table))

    def add(self, docs: DataFrame) -> DataFrame:
        """Adds documents (_id, _text) as a run. Gives the anchors (anchor) that the batch shares with earlier ones, or that two of its documents share."""
        rows = docs.mapInArrow(_anchor_rows, "anchor long, least long, most long")
        self._write(rows.groupBy("anchor").agg(F.min("least").alias("least"), F.max("most").alias("most")), 0)
        new = self.spark.table(self.runs[-1][1])
        found = new.filter("least < most").select("anchor")
        for _, table in self.runs[:-1]:
            old = self.spark.table(table).select("anchor", F.col("least").alias("old_least"), F.col("most").alias("old_most"))
            found = found.unionByName(new.hint("merge").join(old, "anchor").filter("least(least, old_least) < greatest(most, old_most)").select("anchor"))
        found = written(found.distinct())
        self.compact()
        return found

    def compact(self) -> None:
        """Merges the runs of a tier, once there are FANOUT of them, into one of the next."""
        tier = 0
        while tier <= max((t for t, _ in self.runs), default=-1):
            same = [x for x in self.runs if x[0] == tier]
            if len(same) >= FANOUT:
                rows = self.spark.table(same[0][1])
                for _, table in same[1:]:
                    rows = rows.unionByName(self.spark.table(table))
                self._write(rows.groupBy("anchor").agg(F.min("least").alias("least"), F.max("most").alias("most")), tier + 1)
                merged = self.runs.pop()
                at = self.runs.index(same[0])
                self.runs = [x for x in self.runs if x not in same]
                self.runs.insert(at, merged)
                for _, table in same:
                    self.spark.sql(f"DROP TABLE {table}")
            tier += 1

    def drop(self) -> None:
        for _, table in self.runs:
            self.spark.sql(f"DROP TABLE {table}")
        self.runs = []


def _filter(shared: DataFrame, bits: int) -> np.ndarray:
    """The filter of shared anchors: one bit for each, by its lowest bits; parts of 4 KB are made by the executors."""
    slot = F.col("anchor").bitwiseAND(F.lit(bits - 1)) + 1  # Spark numbers the places of its bitmaps from 1
    parts = shared.select(slot.alias("s")).groupBy(F.expr("bitmap_bucket_number(s)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s))").alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():
        out[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.m, np.uint8)
    return out


def _set(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slots = (keys & np.uint64(len(bitmap) * 8 - 1)).astype(np.int64)
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


def filter_bits(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * max(1, n) - 1).bit_length()))


def _span_rows(bitmap):
    """(anchor, h1, h2, _id, _row, start, n) of the spans whose anchor the filter shows: n windows from start, and two independent hashes of all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bits = Hasher(), bitmap.value
        for batch in batches:
            for part, texts in _parts(batch, hasher):
                keys, first, count = texts.spans()
                some = np.flatnonzero(_set(bits, keys))
                if len(some):
                    keys, first, count = keys[some], first[some], count[some]
                    doc = texts.doc[first]
                    yield pa.RecordBatch.from_arrays([_signed(keys), *[_signed(texts.span_hash(first, count, w)) for w in (0, 1)], pa.array(part.column(0).to_numpy()[doc]), pa.array(part.column(2).to_numpy()[doc]), pa.array((first - texts.head[doc]).astype(np.int32)), pa.array(count.astype(np.int16))], ["anchor", "h1", "h2", "_id", "_row", "start", "n"])

    return run


def _mark(h1, ids):
    """A number by which a span of a document is found again."""
    return _mixed(h1 + ids.astype(np.uint64) * _MIX[0])


def _window_rows(bitmap):
    """(h1, h2, _id, _row, start) of the windows of the spans that the filter shows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bits = Hasher(), bitmap.value
        for batch in batches:
            for part, texts in _parts(batch, hasher):
                _, first, count = texts.spans()
                if not len(first):
                    continue
                ids = part.column(0).to_numpy()[texts.doc[first]]
                some = np.flatnonzero(_set(bits, _mark(texts.span_hash(first, count, 0), ids)))
                if len(some):
                    first, count = first[some], count[some]
                    at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    doc = texts.doc[at]
                    yield pa.RecordBatch.from_arrays([*[_signed(hasher.runs(texts.words(w), WORDS, w)[at]) for w in (0, 1)], pa.array(part.column(0).to_numpy()[doc]), pa.array(part.column(2).to_numpy()[doc]), pa.array((at - texts.head[doc]).astype(np.int32))], ["h1", "h2", "_id", "_row", "start"])

    return run


def _mark_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([_signed(_mark(batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))], ["anchor"])


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, removed, kept = [], [], []
        for t, at, n in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
            tokens = t.as_py().encode().split() if t.is_valid else []
            gone = 0
            if at.is_valid and len(at):
                edge = np.zeros(len(tokens) + 1, np.int64)
                a = at.values.to_numpy()
                np.add.at(edge, a, 1)
                np.add.at(edge, a + n.values.to_numpy() + WORDS - 1, -1)
                cover = np.cumsum(edge[:-1]) > 0
                gone = int(cover.sum())
                tokens = [w for w, c in zip(tokens, cover.tolist(), strict=True) if not c]
            words.append(len(tokens) + gone)
            removed.append(gone)
            kept.append(b" ".join(tokens).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["_id", "n_words", "n_removed", "kept"])


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """(_id, _row, starts, counts): for each document the runs of windows whose words also start in a document with a smaller id.

    Documents go into the index in batches by ranges of ids, so what the index holds are the smaller ids. The anchors
    that two documents share make a filter, and are verified in two steps, by 128 bits of two independent hashes of all
    words. First whole spans, the windows of one anchor in one place: all windows of a span repeat if a smaller id has
    the same span, which settles all of a long passage but its ends. Then, where an anchor has several different spans,
    their windows one by one, for the smallest id of each span only. What a third of all documents have is summed up in
    each task first, and its rows then meet the result without a shuffle (see common.lookup). _row is a hash of the
    text, for rows that repeat an id with another text.
    """
    spark = small_batches(docs).sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.xxhash64(F.col(text_col)).alias("_row")).filter("_id is not null")
    edges = texts.approxQuantile("_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    edges = sorted({int(e) for e in edges})
    index = FingerprintIndex(spark)
    shared = None
    for low, high in zip([None, *edges], [*edges, None]):
        part = texts.select("_id", "_text")
        part = part if low is None else part.filter(F.col("_id") > low)
        part = part if high is None else part.filter(F.col("_id") <= high)
        found = index.add(part)
        shared = found if shared is None else shared.unionByName(found)
        release(spark)
    index.drop()
    bitmap = spark.sparkContext.broadcast(_filter(shared, filter_bits(shared.count())))
    spans = written(texts.mapInArrow(_span_rows(bitmap), "anchor long, h1 long, h2 long, _id long, _row long, start int, n short"))
    first = written(spans.groupBy("h1", "h2").agg(F.min("anchor").alias("anchor"), F.min("_id").alias("_first"), F.max("_id").alias("_last"), F.count("*").alias("_n")))
    repeats = first.filter("_first < _last").select("h1", "h2", "_first", "_n")
    whole = written(lookup(spans.drop("anchor"), repeats, ["h1", "h2"], "_n", max(1, spans.count())).filter("_id > _first").select("_id", "_row", "start", F.col("n").cast("int").alias("n")))
    several = first.groupBy("anchor").agg(F.count("*").alias("_spans"), F.min("_first").alias("_a"), F.max("_last").alias("_b")).filter("_spans > 1 and _a < _b").select("anchor", "_spans")
    marks = written(lookup(first, several, ["anchor"], "_spans", max(1, first.count())).select("h1", "_first").mapInArrow(_mark_rows, "anchor long"))
    release(spark)
    bitmap = spark.sparkContext.broadcast(_filter(marks, filter_bits(marks.count())))
    windows = written(texts.mapInArrow(_window_rows(bitmap), "h1 long, h2 long, _id long, _row long, start int"))
    least = written(windows.groupBy("h1", "h2").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"), F.count("*").alias("_n")).filter("_first < _last").drop("_last"))
    single = lookup(windows, least, ["h1", "h2"], "_n", max(1, windows.count())).filter("_id > _first").select("_id", "_row", "start", F.lit(1).alias("n"))
    out = written(whole.unionByName(single).groupBy("_id", "_row").agg(F.collect_list(F.struct("start", "n")).alias("_r")).select("_id", "_row", F.col("_r.start").alias("starts"), F.col("_r.n").alias("counts")))
    for table in (spans, first, whole, windows, least):
        forget(table)
    release(spark)
    return out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept (the words that stay, joined by one space).

    A null text has no words. Texts of under 13 words, and rows with a null id, lose nothing. A window that repeats
    within one document only, or in rows with the same id only, stays: rows that repeat are one document here, each
    with its own row of the result. Windows are judged on the input, not on what is left. Texts and words of any length
    are hashed whole; a text of over 1 MB is a part of its own. An empty table gives an empty result. Other columns are
    not read, so their names do not matter.
    """
    starts = repeated_windows(docs, id_col, text_col, batches)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(F.col(text_col)).alias("_row"))
    none = F.lit(None).cast("array<int>")
    texts = texts.filter("_id is not null").join(starts, ["_id", "_row"], "left").select("_id", "_text", "starts", "counts").unionByName(texts.filter("_id is null").select("_id", "_text", none.alias("starts"), none.alias("counts")))
    out = texts.mapInArrow(_kept_rows, "_id long, n_words long, n_removed long, kept string")
    return out.select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), "n_words", "n_removed", "kept")



ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t)),
f AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN f USING (s) WHERE win.doc_id > f.m),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM t),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k FROM words WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = words.doc_id AND gone.p = words.p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT t.doc_id, len(w) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
