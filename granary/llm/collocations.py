"""Phrase collocation mining: n-grams as rows, hash-aggregated per language, scored in Decimal by their weakest cut, without what a longer phrase explains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import forget, lookup, small_batches, written

#: Longest phrase, least count of a candidate, scale of scores, percentage from which a longer phrase explains one, rows for each language.
MAX_WORDS, LEAST, SCALE, EXPLAINED, TOP = 4, 30, 2_000_000, 80, 2000
#: Bytes that end a piece become a line end, a tab a space, A to Z small letters.
_PLAIN = bytes.maketrans(b".,;:!?\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n" * 9 + b" abcdefghijklmnopqrstuvwxyz")
#: Bytes of a text that are split at once: a longer text is cut at the next end of a piece.
PART = 4 << 20
#: Bits of a filter of frequent phrases: 16 a phrase within these bounds, of which MOST_BITS, 16 MB, is all that is broadcast. When full it lets more n-grams through, which are counted and dropped.
LEAST_BITS, MOST_BITS, PROBES = 1 << 17, 1 << 27, 2
#: Words whose n-grams a task counts at once, and different words that it keeps numbers of.
BLOCK, NUMBERS = 1 << 20, 1 << 18
_K, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M
    return h ^ (h >> np.uint64(29))


def _joined(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a phrase and one more word, from the keys of both; a first word's key holds its language too."""
    return _mixed(h * _K + word)


def _slots(key: np.ndarray, bits: int) -> list[np.ndarray]:
    return [_mixed(key + np.uint64(i) * _K) & np.uint64(bits - 1) for i in range(PROBES)]


def _word_key(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, xxhash.xxh32_intdigest(lang.encode()))


class Filter:
    """Which phrases may be frequent: a bitmap over hashed keys. It never says no to one that was put in."""

    def __init__(self, bits: int, pieces: dict[int, bytes]):
        self.bits, self.map = bits, np.zeros(bits // 8, np.uint8)
        for bucket, piece in pieces.items():  # Spark's buckets count from 1, of 4,096 bytes each
            at = (bucket - 1) * 4096
            self.map[at : at + len(piece)] = np.frombuffer(piece, np.uint8)[: len(self.map) - at]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for slot in _slots(keys, self.bits):
            found &= (self.map[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def _phrase_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.zeros(batch.num_rows, np.uint64)
        for i, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            words = np.array([_word_key(lang, w) for w in phrase.encode().split(b" ")], np.uint64)
            key = words[:1]
            for k in range(1, len(words)):
                key = _joined(key, words[k : k + 1])
            keys[i] = key[0]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["_key"])


def frequent_filter(phrases: DataFrame, least_bits: int = LEAST_BITS, most_bits: int = MOST_BITS) -> Filter:
    """The filter of phrases (_lang, _phrase): its bitmap is put together in Spark, and only that, of a bounded size, comes to the driver."""
    bits = min(most_bits, max(least_bits, 1 << (16 * max(1, phrases.count()) - 1).bit_length()))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _phrase_keys(batches):
            found = np.unique(np.concatenate(_slots(batch.column(0).to_numpy().view(np.uint64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64))], ["_slot"])

    rows = phrases.select("_lang", "_phrase").mapInArrow(slots, "_slot long")
    rows = rows.groupBy(F.expr("bitmap_bucket_number(_slot + 1)").alias("_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_slot + 1))").alias("_bits"))
    return Filter(bits, {r._bucket: bytes(r._bits) for r in rows.collect()})


def _distinct(columns: list[np.ndarray], below: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct row of the columns, of numbers under `below`, stands first, and how often it does; as many columns as fit are packed into one key."""
    keys, width = [], 1 << 62
    for c in columns:
        if width * below < 1 << 62:
            keys[-1], width = keys[-1] * below + c, width * below
        else:
            keys.append(c)
            width = below
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


class _Numbers(dict):
    """A number for each word, given when it is first asked for; 0 ends a piece."""

    def __init__(self) -> None:
        super().__init__({b"\n": 0})
        self.words = [b"\n"]

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        self[word] = n = len(self.words) - 1
        return n


class Counter:
    """n-grams of pieces of text of one language, counted in blocks of BLOCK words."""

    def __init__(self, lang: str, lengths: tuple[int, ...], filters: list[Filter]):
        self.lang, self.lengths, self.filters, self.flat = lang, lengths, filters, []
        self.forget()

    def forget(self) -> None:
        self.number = _Numbers()
        self.keys, self.common = np.zeros(1, np.uint64), np.zeros(1, bool)

    def add(self, part: bytes) -> bool:
        """Takes pieces of plain text in. Whether a block is full."""
        self.flat += map(self.number.__getitem__, filter(None, part.replace(b"\n", b" \n ").split(b" ")))
        self.flat.append(0)
        return len(self.flat) >= BLOCK

    def counts(self) -> Iterator[tuple[list[bytes], np.ndarray]]:
        """(n-grams, counts) of what was taken in, for each length; begins anew."""
        if not self.flat:
            return
        at, words = np.array(self.flat, np.int64), self.number.words
        self.flat = []
        if len(words) > len(self.keys):
            new = np.array([_word_key(self.lang, w) for w in words[len(self.keys) :]], np.uint64)
            self.common = np.concatenate([self.common, self.filters[0](new) if self.filters else np.ones(len(new), bool)])
            self.keys = np.concatenate([self.keys, new])
        if 1 in self.lengths:
            n = np.bincount(at, minlength=len(words))
            n[0] = 0
            some = np.flatnonzero(n)
            yield [words[i] for i in some.tolist()], n[some]
        if max(self.lengths) > 1:
            starts = np.flatnonzero(self.common[at[:-1]] & self.common[at[1:]])  # both words are frequent
            for length in range(2, max(self.lengths) + 1):
                if length > 2:  # go on where the last two starts are neighbours and both shorter phrases may be frequent
                    starts = starts[:-1][np.diff(starts) == 1] if len(starts) else starts
                if not len(starts):
                    break
                if length in self.lengths:
                    first, n = _distinct([at[starts + k] for k in range(length)], len(words))
                    grams = [[words[i] for i in at[starts[first] + k].tolist()] for k in range(length)]
                    yield list(map(b" ".join, zip(*grams, strict=True))), n
                if length < max(self.lengths) and length - 1 < len(self.filters):
                    key = self.keys[at[starts]]
                    for k in range(1, length):
                        key = _joined(key, self.keys[at[starts + k]])
                    starts = starts[self.filters[length - 1](key)]
        if len(words) > NUMBERS:
            self.forget()


def _counted(lengths: tuple[int, ...], shared: Broadcast | None):
    """Rows (_lang, _text) -> (_lang, _words, _phrase, _n): each task's counts of the n-grams whose parts may all be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value if shared else []
        of: dict[str, Counter] = {}

        def flushed(lang: str) -> Iterator[pa.RecordBatch]:
            for grams, n in of[lang].counts():
                size = grams[0].count(b" ") + 1 if grams else 1
                for k in range(0, len(grams), 1 << 16):
                    part = pa.array(grams[k : k + (1 << 16)], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(np.full(len(part), size, np.int32)), part, pa.array(n[k : k + (1 << 16)])], ["_lang", "_words", "_phrase", "_n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if lang not in of:
                    if len(of) >= 64:  # a task with many languages keeps few of them at once
                        for old in of:
                            yield from flushed(old)
                        of.clear()
                    of[lang] = Counter(lang, lengths, filters)
                plain, at = bytes(text.as_buffer()).translate(_PLAIN), 0
                while at < len(plain):
                    end = plain.find(b"\n", at + PART) + 1 or len(plain)
                    if of[lang].add(plain[at:end]):
                        yield from flushed(lang)
                    at = end
        for lang in of:
            yield from flushed(lang)

    return run


def phrase_counts(docs: DataFrame, lengths: tuple[int, ...], filters: list[Filter]) -> DataFrame:
    """(_lang, _words, _phrase, _n) of docs (_lang, _text): counts of the n-grams of these lengths, all of whose parts pass the filters of the shorter lengths; summed up in the tasks before they are shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(filters) if filters else None
    rows = small_batches(docs).mapInArrow(_counted(lengths, shared), "_lang string, _words int, _phrase string, _n long")
    return rows.groupBy("_lang", "_words", "_phrase").agg(F.sum("_n").alias("_n"))


def frequent_phrases(docs: DataFrame, most: int = MAX_WORDS, least: int = LEAST, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """(_lang, _words, _phrase, _n) of all phrases of up to `most` words that occur `least` times or more, and (_lang, _total), the number of all words.

    A phrase occurs no more often than its parts. So words are counted first, then pairs of frequent words, then longer
    phrases all of whose pairs are frequent; which ones may be is known from filters that let nothing frequent pass by.
    Counts are exact, of the phrases themselves.
    """
    words = written(phrase_counts(docs, (1,), []))
    totals = words.groupBy("_lang").agg(F.sum("_n").alias("_total"))
    often = [written(words.filter(F.col("_n") >= least))]
    filters: list[Filter] = []
    for lengths in ((2,), tuple(range(3, most + 1))):
        if lengths and lengths[0] <= most:
            filters.append(frequent_filter(often[-1], most_bits=most_bits))
            often.append(written(phrase_counts(docs, lengths, filters).filter(F.col("_n") >= least)))
    every = often[0]
    for table in often[1:]:
        every = every.unionByName(table)
    out, totals = written(every), written(totals)
    for table in (words, *often):
        forget(table)
    return out, totals


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MAX_WORDS, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The best phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    Texts are lower-cased (A to Z), split into pieces at [.,;:!?] and line ends and into words at spaces and tabs. A
    candidate is a phrase of 2 to `most` words that occurs a >= `least` times within pieces. Each cut of it into l (count
    of the first part) and r (of the rest) has the score floor(SCALE * a / (l + r)), in Decimal; the lowest counts, ties
    to the shortest first part. Candidates that a longer phrase explains, with 80 % of their count, are dropped: it is
    enough to look at phrases one word longer, as a phrase between two has a count between theirs.

    Null and empty texts have no words; a null language is `und`. Texts of any length are read whole; repeated rows
    count as often as they stand there. Ties in score and count are in the order of the phrase's bytes. An empty table
    gives an empty result. Other columns are not read, so their names do not matter.
    """
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("_lang"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    counts, totals = frequent_phrases(rows, most, least)
    joined = lambda a, n: F.array_join(F.slice("_parts", a, n), " ")
    found = counts.filter("_words > 1").withColumn("_parts", F.split("_phrase", " ")).select("_lang", "_phrase", "_words", F.col("_n").alias("_a"), "_parts")
    cuts = found.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_words") - 1)))
    cuts = written(cuts.select("_lang", "_phrase", "_a", "_k", joined(F.lit(1), F.col("_k")).alias("_left"), joined(F.col("_k") + 1, F.col("_words") - F.col("_k")).alias("_right")))
    total = max(1, cuts.count())
    for side, name in (("_left", "_l"), ("_right", "_r")):
        uses = cuts.groupBy("_lang", side).agg(F.count("*").alias("_uses"))
        of = counts.select("_lang", F.col("_phrase").alias(side), F.col("_n").alias(name)).join(uses, ["_lang", side])
        cuts = written(lookup(cuts, of, ["_lang", side], "_uses", total).drop("_uses", side))
    exact = F.expr(f"cast(_a as decimal(20,0)) * {SCALE} div (cast(_l as decimal(20,0)) + _r)")  # of decimals, rounded down
    scored = cuts.withColumn("_score", exact).groupBy("_lang", "_phrase").agg(F.min(F.struct("_score", "_k", "_l", "_r")).alias("_cut"), F.first("_a").alias("_a"))
    longer = found.filter("_words > 2").select("_lang", F.col("_a").alias("_b"), F.explode(F.array(joined(F.lit(1), F.col("_words") - 1), joined(F.lit(2), F.col("_words") - 1))).alias("_phrase"))
    longer = longer.groupBy("_lang", "_phrase").agg(F.max("_b").alias("_b"))
    kept = scored.join(longer, (scored["_lang"] == longer["_lang"]) & (scored["_phrase"] == longer["_phrase"]) & (F.lit(100) * longer["_b"] >= F.lit(EXPLAINED) * scored["_a"]), "left_anti")
    # the best of each part of a language first, so that no task sorts all of its candidates
    part = F.pmod(F.xxhash64("_phrase"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    for keys in (("_lang", "_part"), ("_lang",)):
        best = Window.partitionBy(*keys).orderBy(F.desc("_cut._score"), F.desc("_a"), "_phrase")
        kept = kept.withColumn("_part", part).withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= top)
    ranked = kept.join(totals, "_lang")
    return ranked.select(F.col("_lang").alias("lang"), F.col("_rank").cast("long").alias("rank"), F.col("_phrase").alias("phrase"), F.col("_a").alias("a"), F.col("_cut._l").alias("l"), F.col("_cut._r").alias("r"), F.col("_total").alias("n"), F.col("_cut._score").cast("long").alias("score"))


ORACLE_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND n >= 30),
e AS (SELECT lang, phrase, a, cut, array_to_string(ws[1 : cut], ' ') AS x, array_to_string(ws[cut + 1 :], ' ') AS y FROM c, (SELECT unnest([1, 2, 3]) AS cut) WHERE cut < k),
s AS (SELECT e.lang, e.phrase, a, x.n AS l, y.n AS r, 2000000::HUGEINT * a // (x.n + y.n) AS score, cut FROM e JOIN f x ON x.lang = e.lang AND x.phrase = e.x JOIN f y ON y.lang = e.lang AND y.phrase = e.y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
u AS (SELECT lang, c.a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')] || CASE WHEN k = 4 THEN [array_to_string(ws[3:4], ' '), array_to_string(ws[1:3], ' '), array_to_string(ws[2:4], ' ')] ELSE [] END) AS phrase FROM c WHERE k > 2),
o AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.lang = b.lang AND u.phrase = b.phrase AND 100::HUGEINT * u.a >= 80 * b.a)),
z AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score::BIGINT AS score FROM o)
SELECT z.lang, z.rank, z.phrase, z.a, z.l, z.r, t.n, z.score FROM z JOIN t USING (lang) WHERE rank <= 2000
"""
