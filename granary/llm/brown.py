"""Language-model scoring by Brown classes: exchange clustering of words, class transitions and word emissions, smoothed by the unigram model."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import WORD, forget, lookup, small_batches, written

#: Classes of words, and sweeps of the exchange over the frequent words.
CLASSES, SWEEPS = 64, 5
#: Frequent words, at most: what is known of them is broadcast (about 40 MB in a worker), and they are exchanged in every
#: sweep. All other words, however many, are exchanged in a last sweep, by a shuffle, and are looked up by a join.
WORDS = 1 << 18
#: What is added to each count, and the weight of the unigram model in each class's transitions.
PRIOR, STRENGTH = 0.1, 64.0
FOLDS = 10
#: Tokens that a task pairs at once, tokens that it holds as objects at once, different words that it counts at once, words of a cell of the contexts' table.
BLOCK, SPLIT, DISTINCT, CELL = 1 << 21, 1 << 17, 1 << 18, 256
#: The most frequent words, which a sweep moves one by one, and how many of the others it judges at once.
FIRST, TOGETHER = 4096, 32
#: Counts whose gains are looked up where many words are judged by the same matrix.
SMALL = 16
#: The token at the end of each text, which also stands before its first word. No word is empty.
END = b""


@dataclass
class Model:
    """P(w | h) = (1 - u) T(class of h, class of w) E(w) for a known word, u for an unknown one, after each history h.

    T(a, b) = (N(a, b) + STRENGTH P(b)) / (N(a) + STRENGTH), P(b) = (N(b) + PRIOR V(b)) / (N + PRIOR V), E(w) = (c(w) +
    PRIOR) / (N(b) + PRIOR V(b)), u = PRIOR / (N + PRIOR (V + 1)); after an unknown word T is P. The probabilities of all
    known words and the unknown one sum to 1, and where nothing is known of the history they are the unigram model's.
    """

    tokens: int
    known: int
    words: list[bytes]
    counts: np.ndarray
    classes: np.ndarray
    transitions: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    #: (_word, _n, _class) of the words that are not among the frequent ones.
    rare: DataFrame | None

    @property
    def unknown(self) -> float:
        return PRIOR / (self.tokens + PRIOR * (self.known + 1))

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """log10 of T, with a last row for unknown histories, and of 1 / (N(b) + PRIOR V(b))."""
        mass = self.class_tokens + PRIOR * self.class_words
        share = mass / max(PRIOR, self.tokens + PRIOR * self.known)
        after = np.vstack([self.transitions, np.zeros(len(share))])
        moved = (after + STRENGTH * share) / (after.sum(axis=1, keepdims=True) + STRENGTH)
        with np.errstate(divide="ignore"):
            return np.log10(moved), -np.log10(mass)


def _tokens(x: pa.Scalar) -> list[bytes]:
    return x.as_buffer().to_pybytes().lower().split() if x.is_valid else []


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["_word", "_n"])
        counts.clear()
        return made

    for batch in batches:
        for text in batch.column(0):
            counts.update(_tokens(text))
            counts[END] += 1
            if len(counts) > DISTINCT:
                yield rows()
    yield rows()


def _frequent(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """At most `most` words, the most frequent by steps of counts (of one step, by a hash), the end among them, by falling count. Only their number is bounded; the others stay in the table."""
    step = F.floor(F.log2("_n") * 16) * 64 + F.pmod(F.xxhash64("_word"), F.lit(64))
    least, kept = None, 0
    for r in counts.filter("_word <> ''").groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect():
        kept += r["count"]
        if kept >= most:
            break
        least = r.s
    chosen = F.col("_word") == ""
    if least is not None:
        chosen = chosen | (step >= least)
    found = counts.filter(chosen).toArrow()
    rows = sorted(zip((-n for n in found.column("_n").to_pylist()), (w.encode() for w in found.column("_word").to_pylist()), strict=True))
    return [w for _, w in rows], -np.array([n for n, _ in rows], np.int64)


def _flat(batches: Iterator[pa.RecordBatch], numbers: dict[bytes, int], take: Callable) -> Iterator:
    """take(token numbers) of runs of whole texts of about BLOCK tokens, each text's end after it and an end before the first. Tokens become numbers after every SPLIT of them, as an object takes ten times a number's room."""
    other, flat, done, size = len(numbers), [END], [], 0
    for batch in batches:
        for text in batch.column(0):
            flat += _tokens(text)
            flat.append(END)
            if len(flat) >= SPLIT:
                done.append(np.fromiter(map(numbers.get, flat, repeat(other)), np.int32, len(flat)))
                size, flat = size + len(flat), []
                if size >= BLOCK:
                    at, done, size, flat = np.concatenate(done), [], 0, [END]
                    yield from take(at)
    done.append(np.fromiter(map(numbers.get, flat, repeat(other)), np.int32, len(flat)))
    at = np.concatenate(done)
    if len(at) > 1:
        yield from take(at)


def _numbers(words: list[bytes]) -> dict[bytes, int]:
    return {w: i for i, w in enumerate(words)}


def _binary(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([a.astype("<u4").tobytes()], pa.binary()) for a in arrays]


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The keys, each once and in order, and the sums of their counts. What was given is let go, as it may be large."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    keys.clear()
    counts.clear()
    if not len(key):
        return [key], [n]
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return [key[first]], [np.add.reduceat(n, first, dtype=np.int64)]


def contexts(docs: DataFrame, text_col: str, words: list[bytes], tokens: int = 0) -> DataFrame:
    """(_words, _sizes, _codes, _counts): for cells of CELL frequent words, with what each one stands next to and how often. A code is the left neighbour's number, or the right one's plus one more than there are words; all rare words have the last number.

    Neighbours are counted in the tasks, then by word in one shuffle, of arrays of numbers, whose tasks are as many as so
    many tokens ask for; every sweep reads the table where it lies.
    """
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // BLOCK))
    shared, wide = spark.sparkContext.broadcast(words), 2 * (len(words) + 1)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        other = len(names)

        # sorted by task, word and code, packed into one number
        first = (np.arange(other, dtype=np.int64) % tasks * other + np.arange(other)) * wide

        def take(at: np.ndarray) -> Iterator[pa.RecordBatch]:
            left, right = at[:-1], at[1:]
            lead, after = left[right < other], right[left < other]
            key = np.concatenate([first[right[right < other]], first[left[left < other]]])
            key[: len(lead)] += lead
            key[len(lead) :] += after
            key[len(lead) :] += other + 1
            key.sort()
            at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else key
            key, n = key[at], np.diff(np.append(at, len(key)))
            word, code = key // wide % other, key % wide
            ends = np.searchsorted(key // wide // other, np.arange(tasks + 1))
            for b in range(tasks):
                if ends[b] < ends[b + 1]:
                    some = slice(ends[b], ends[b + 1])
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *_binary(word[some], code[some], n[some])], ["_b", "_word", "_code", "_n"])

        return _flat(batches, _numbers(names), take)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, size, least = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, BLOCK
        for batch in batches:
            for k in range(batch.num_rows):
                word, code, count = (np.frombuffer(batch.column(c)[k].as_buffer(), "<u4") for c in (1, 2, 3))
                key.append(word.astype(np.int64) * wide + code)
                n.append(count.astype(np.int64))
                size += len(word)
                if size > least:
                    key, n = _merged(key, n)
                    size, least = 0, max(BLOCK, len(key[0]) // 2)
        (key,), (n,) = _merged(key, n)
        word = key // wide
        own, sizes = np.unique(word, return_counts=True)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        for k in range(0, len(own), CELL):
            some = slice(ends[k], ends[min(k + CELL, len(own))])
            yield pa.RecordBatch.from_arrays(_binary(own[k : k + CELL], sizes[k : k + CELL], key[some] % wide, n[some]), ["_words", "_sizes", "_codes", "_counts"])

    rows = small_batches(docs).select(text_col).mapInArrow(paired, "_b int, _word binary, _code binary, _n binary")
    return written(rows.repartition(tasks, "_b").mapInArrow(merged, "_words binary, _sizes binary, _codes binary, _counts binary"))


def _cells(batches: Iterator[pa.RecordBatch], classes: np.ndarray, wide: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The words of each cell of the contexts, and how often each stands next to each class: left ones first, with one more class for rare words on either side."""
    both = np.concatenate([classes, classes + wide])
    for batch in batches:
        for k in range(batch.num_rows):
            own, sizes, codes, n = (np.frombuffer(batch.column(c)[k].as_buffer(), "<u4").astype(np.int64) for c in range(4))
            at = np.repeat(np.arange(len(own)), sizes) * (2 * wide) + both[codes]
            yield own, np.bincount(at, weights=n, minlength=len(own) * 2 * wide).reshape(len(own), 2 * wide)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def objective(matrix: np.ndarray) -> float:
    """The part of the training tokens' log probability that depends on the classes: what transitions and classes' sizes make of it."""
    return float(_f(matrix).sum() - _f(matrix.sum(axis=0)).sum() - _f(matrix.sum(axis=1)).sum())


def _added(n: np.ndarray, before: np.ndarray) -> np.ndarray:
    """f(N + n) - f(N), f(x) = x log x."""
    return before * np.log1p(n / np.maximum(before, 0.5)) + n * np.log(np.maximum(before + n, 1))


def small_gains(matrix: np.ndarray) -> list[np.ndarray]:
    """_added for counts under SMALL, for both sides of a word."""
    wide = len(matrix)
    return [np.stack([_added(np.float64(n), cells) for n in range(SMALL)]) for cells in (matrix[:, : wide - 1], matrix.T[:, : wide - 1])]


def gains(near: np.ndarray, matrix: np.ndarray, small: list[np.ndarray] | None = None) -> np.ndarray:
    """What the objective gains when each word, by its neighbours' classes, joins each class: f(N + n) - f(N) of the cells it adds to, less that of the class's sizes. small: what small_gains says of the matrix, where many words are judged by one."""
    wide = len(matrix)
    out = np.zeros((len(near), wide - 1))
    for side, (counts, cells) in enumerate(((near[:, :wide], matrix[:, : wide - 1]), (near[:, wide:], matrix.T[:, : wide - 1]))):
        word, context = np.nonzero(counts)
        if len(word):
            n = counts[word, context]
            if small is None:
                each = _added(n[:, None], cells[context])
            else:
                each = small[side][np.minimum(n, SMALL - 1).astype(np.int64), context]
                more = np.flatnonzero(n >= SMALL)
                each[more] = _added(n[more, None], cells[context[more]])
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            out[word[first]] += np.add.reduceat(each, first, axis=0)
        size, of = np.unique(counts.sum(axis=1), return_inverse=True)
        out -= _added(size[:, None], cells.sum(axis=0)[None, :])[of]
    return out


def _swept(classes: np.ndarray, matrix: np.ndarray):
    """One sweep over a part of the words: each moves to the class where the objective gains most, and counts move along before the next ones are judged. Yields the words that moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, wide, at = matrix.copy(), len(matrix), classes.astype(np.int64)
        for own, near in _cells(batches, at, wide):
            single = int(np.searchsorted(own, FIRST))  # the most frequent words one by one
            for k in [*range(single), *range(single, len(own), TOGETHER)]:
                upto = k + (1 if k < single else TOGETHER)
                words, some = own[k:upto], near[k:upto]
                left, right, old, i = some[:, :wide], some[:, wide:], at[words], np.arange(len(words))
                # words that are judged together are out of their classes together
                without = now.copy()
                np.add.at(without.T, old, -left)
                np.add.at(without, old, -right)
                np.maximum(without, 0, out=without)
                gain = gains(some, without)
                new = gain.argmax(axis=1)
                new = np.where(gain[i, new] > gain[i, old] + 1e-9, new, old)
                now = without
                np.add.at(now.T, new, left)
                np.add.at(now, new, right)
                at[words] = new
                moved = new != old
                if moved.any():
                    yield pa.RecordBatch.from_arrays([pa.array(words[moved]), pa.array(new[moved].astype(np.int32))], ["_word", "_class"])

    return run


def class_matrix(near: DataFrame, classes: np.ndarray, wide: int, rest: float) -> np.ndarray:
    """How often each class follows each, rare words as the last class; rest: the number of rare tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((wide, wide))
        for own, counts in _cells(batches, classes, wide):
            np.add.at(total.T, classes[own], counts[:, :wide])
            np.add.at(total, (classes[own], wide - 1), counts[:, 2 * wide - 1])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at].astype(np.int64))], ["_cell", "_n"])

    out = np.zeros(wide * wide)
    for r in near.mapInArrow(run, "_cell long, _n long").groupBy("_cell").agg(F.sum("_n").alias("_n")).collect():
        out[r._cell] = r._n
    out = out.reshape(wide, wide)
    out[-1, -1] = max(0.0, rest - out[:-1, -1].sum())
    return out


def exchange(near: DataFrame, n_words: int, rest: float, classes: int, sweeps: int) -> tuple[np.ndarray, np.ndarray]:
    """(classes of the frequent words and, last, the rare ones' own; matrix of transitions).

    At first the most frequent words have a class each and all others share the last one. In each sweep every task moves
    the words whose contexts it holds, starting from the same classes, which are two bytes a word; it is taken back, and
    the last one, if the objective doesn't gain.
    """
    at = np.minimum(np.arange(n_words + 1), classes - 1)
    at[-1] = classes
    matrix = class_matrix(near, at, classes + 1, rest)
    for _ in range(sweeps):
        moved = near.mapInArrow(_swept(at.astype(np.int16), matrix), "_word long, _class int").toArrow()
        new = at.copy()
        new[moved.column("_word").to_numpy()] = moved.column("_class").to_numpy()
        then = class_matrix(near, new, classes + 1, rest)
        if not moved.num_rows or objective(then) <= objective(matrix):
            break
        at, matrix = new, then
    return at, matrix


def _rare_neighbours(none: int, end: int):
    """Coded texts (_kinds, _rare) -> (_word, _codes, _next): the classes that stand beside a rare word, and the rare word after a rare one. end: the class of the end, which stands before the first word."""
    kind_type = _kind_type(none)

    def rows(kinds: list[bytes], words: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        kind = np.frombuffer(b"".join(kinds), kind_type).astype("<u2")
        kind = np.concatenate((np.array([end], "<u2"), kind))
        here, each = np.flatnonzero(kind == none), pa.concat_arrays(words)
        coded = each.dictionary_encode()
        own, number = coded.dictionary, coded.indices.to_numpy()
        order = np.argsort(number, kind="stable")
        codes = np.stack([kind[here - 1], kind[here + 1] + np.uint16(none + 1)], axis=1)[order]
        ends = np.concatenate(([0], np.cumsum(np.bincount(number, minlength=len(own))))) * codes.itemsize * 2
        beside = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(codes.tobytes())])
        yield pa.RecordBatch.from_arrays([own, beside, pa.nulls(len(own), pa.string())], ["_word", "_codes", "_next"])
        after = pa.array(np.flatnonzero(np.diff(here) == 1))  # every text ends with a frequent word, so both are of one text
        following = pa.array(after.to_numpy() + 1)
        yield pa.RecordBatch.from_arrays([each.take(after), pa.nulls(len(after), pa.binary()), each.take(following)], ["_word", "_codes", "_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, words, size = [], [], 0
        for batch in batches:
            if batch.num_rows:
                kinds += batch.column(0).to_pylist()
                words.append(batch.column(1).flatten())
                size += sum(map(len, kinds[-batch.num_rows :]))
            if size > BLOCK:
                yield from rows(kinds, words)
                kinds, words, size = [], [], 0
        if kinds:
            yield from rows(kinds, words)

    return run


def _rare_classes(matrix: np.ndarray):
    """Rows (_word, _codes) in the order of words -> (_word, _n, _class), each word in the class where the objective gains most, and what its neighbours add to the transitions (_cell, _n)."""
    wide = len(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, word, beside, small = np.zeros((wide, wide)), None, None, small_gains(matrix)

        def judged(words: list[str], near: np.ndarray) -> pa.RecordBatch:
            new = gains(near, matrix, small).argmax(axis=1)
            np.add.at(total.T, new, near[:, :wide])
            np.add.at(total, new, near[:, wide:])
            n = near[:, :wide].sum(axis=1).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n), pa.array(new.astype(np.int32)), pa.nulls(len(words), pa.int64())], ["_word", "_n", "_class", "_cell"])

        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                words = part.column(0).to_pylist()
                codes = [np.frombuffer(x.as_buffer(), "<u2").astype(np.int64) for x in part.column(1)]
                new = np.array([a != b for a, b in zip(words, [word, *words], strict=False)])
                run_of = np.cumsum(new) - (1 if new[0] else 0)
                near = np.bincount(np.repeat(run_of, [len(c) for c in codes]) * 2 * wide + np.concatenate(codes), minlength=(int(run_of[-1]) + 1) * 2 * wide).reshape(-1, 2 * wide).astype(float)
                names = ([] if new[0] else [word]) + [w for w, x in zip(words, new.tolist(), strict=True) if x]
                if not new[0]:
                    near[0] += beside
                elif word is not None:
                    names, near = [word, *names], np.vstack([beside[None], near])
                word, beside = names[-1], near[-1]
                if len(names) > 1:
                    yield judged(names[:-1], near[:-1])
        if word is not None:
            yield judged([word], beside[None])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.string()), pa.array(total.ravel()[at].astype(np.int64)), pa.nulls(len(at), pa.int32()), pa.array(at)], ["_word", "_n", "_class", "_cell"])

    return run


@dataclass
class Exchanged:
    """What is known once the frequent words have their classes: counts of all training tokens and words, the frequent words with counts and classes (last the rare ones' own), and transitions with rare words as one class."""

    tokens: int
    known: int
    words: list[bytes]
    counts: np.ndarray
    classes: np.ndarray
    matrix: np.ndarray


def exchanged(docs: DataFrame, text_col: str = "text", words: int = WORDS, classes: int = CLASSES, sweeps: int = SWEEPS) -> Exchanged:
    """The words of all texts counted, and the frequent ones exchanged: two passes over the texts."""
    counts = written(small_batches(docs).select(text_col).mapInArrow(_word_counts, "_word string, _n long").groupBy("_word").agg(F.sum("_n").alias("_n")))
    tokens, known = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count("*")).first()
    if not known:
        return Exchanged(0, 0, [], np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros((classes + 1, classes + 1)))
    names, n = _frequent(counts, words)
    forget(counts)
    near = contexts(docs, text_col, names, tokens)
    at, matrix = exchange(near, len(names), float(tokens - n.sum()), classes, sweeps)
    forget(near)
    return Exchanged(tokens, known, names, n, at, matrix)


def _kind_type(classes: int) -> np.dtype:
    """Of the number of a class, or of the rare words, which comes after the classes."""
    return np.dtype("u1" if classes < 256 else "<u2")


def _coded(names: list[bytes], kinds: np.ndarray, base: np.ndarray, spark):
    """Rows (_text, _key, _id, _train) -> the classes of a text's tokens, what its frequent words make of the unigram score, and its rare words in their order."""
    shared = spark.sparkContext.broadcast((names, kinds.astype(_kind_type(int(kinds[-1]))), np.append(base, 0.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds, base = shared.value
        numbers, other = _numbers(names), len(names)
        for batch in batches:
            flat, ends = [], [0]
            for text in batch.column(0):
                flat += _tokens(text)
                flat.append(END)
                ends.append(len(flat))
            at = np.fromiter(map(numbers.get, flat, repeat(other)), np.int64, len(flat))
            kind, until = kinds[at], np.array(ends)
            sums = np.add.reduceat(base[at], until[:-1]) if batch.num_rows else np.zeros(0)
            here = np.flatnonzero(at == other)
            rare = pa.array([flat[i] for i in here.tolist()], pa.binary()).cast(pa.string())
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(here, until).astype(np.int32)), rare)
            coded = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((until * kind.itemsize).astype("<i4").tobytes()), pa.py_buffer(kind.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.diff(until)), coded, pa.array(sums), rare], ["_key", "_id", "_train", "_tokens", "_kinds", "_base", "_rare"])

    return run


def coded(rows: DataFrame, found: Exchanged | Model) -> DataFrame:
    """Rows (_id, _text, _train) as a table of _key, _id, _train, _tokens, _kinds (the class of each token, in one number each), _base (log10 of the frequent words by the unigram model), _rare (the other words). Rare words are learnt from it and texts are scored from it, so no text is split again."""
    logs = np.log10(found.counts + PRIOR) - math.log10(found.tokens + PRIOR * (found.known + 1))
    kind = rows.schema["_id"].dataType.simpleString()
    texts = small_batches(rows).select("_text", F.monotonically_increasing_id().alias("_key"), "_id", "_train")
    return written(texts.mapInArrow(_coded(found.words, found.classes, logs, rows.sparkSession), f"_key long, _id {kind}, _train boolean, _tokens long, _kinds binary, _base double, _rare array<string>"))


def finished(found: Exchanged, texts: DataFrame | None) -> Model:
    """The model, with the classes of the rare words of the coded training texts, and what they add to transitions."""
    classes, at, n = len(found.matrix) - 1, found.classes, found.counts
    class_tokens, class_words = np.bincount(at[:-1], weights=n, minlength=classes), np.bincount(at[:-1], minlength=classes).astype(float)
    transitions, rare = found.matrix[:classes, :classes].copy(), None
    if texts is not None and len(found.words) < found.known:
        tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        end = int(at[found.words.index(END)])
        rows = written(small_batches(texts).select("_kinds", "_rare").mapInArrow(_rare_neighbours(classes, end), "_word string, _codes binary, _next string"))
        own = rows.filter("_next is null").select("_word", "_codes").repartition(tasks, "_word").sortWithinPartitions("_word")
        judged = written(small_batches(own).mapInArrow(_rare_classes(found.matrix), "_word string, _n long, _class int, _cell long"))
        rare = judged.filter("_word is not null").select("_word", "_n", "_class")
        for r in judged.filter("_cell is not null").groupBy("_cell").agg(F.sum("_n").alias("n")).collect():
            a, b = divmod(r._cell, classes + 1)
            if a < classes and b < classes:
                transitions[a, b] += r.n
        pairs = rows.filter("_next is not null").groupBy("_word", "_next").agg(F.count("*").alias("_m"))
        of = rare.select("_word", F.col("_class").alias("_a")), rare.select(F.col("_word").alias("_next"), F.col("_class").alias("_b"))
        for r in pairs.join(of[0], "_word").join(of[1], "_next").groupBy("_a", "_b").agg(F.sum("_m").alias("n")).collect():
            transitions[r._a, r._b] += r.n
        for r in rare.groupBy("_class").agg(F.sum("_n").alias("n"), F.count("*").alias("v")).collect():
            class_tokens[r._class] += r.n
            class_words[r._class] += r.v
        forget(rows)
    return Model(found.tokens, found.known, found.words, n, at, transitions, class_tokens, class_words, rare)


def train(docs: DataFrame, text_col: str = "text", words: int = WORDS, classes: int = CLASSES, sweeps: int = SWEEPS) -> Model:
    """Counts, classes and transitions of all tokens of docs; see Model, exchange and scored."""
    found = exchanged(docs, text_col, words, classes, sweeps)
    if len(found.words) == found.known:
        return finished(found, None)
    texts = coded(docs.select(F.lit(0).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.lit(True).alias("_train")), found)
    model = finished(found, texts)
    forget(texts)
    return model


def _last_scores(moved: np.ndarray, inverse: np.ndarray, log_known: float, unknown: float, total: float, end: int):
    """Coded texts (_id, _tokens, _kinds, _base, _found: list of (place, count, class) of the rare words) -> the whole scores."""
    none, kind_type, log_total = len(moved) - 1, _kind_type(len(moved) - 1), math.log10(total)
    with np.errstate(invalid="ignore"):  # classes without words, which no token has
        step = np.column_stack([log_known + moved[:, :none] + inverse[:none], np.full(len(moved), unknown)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                until = np.concatenate(([0], np.cumsum(batch.column(1).to_numpy())))
                kind = np.frombuffer(b"".join(batch.column(2).to_pylist()), kind_type).astype(np.int64)
                here, starts = np.flatnonzero(kind == none), until[:-1]
                before = np.searchsorted(here, until)
                lists = batch.column(4)
                place, n, of = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
                at = np.repeat(before[:-1], lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) + place
                count, own = np.zeros(len(here)), np.full(len(here), none)
                count[at], own[at] = n, np.where(n > 0, of, none)
                kind[here] = own
                into, logs = step[np.concatenate(([end], kind[:-1])), kind], np.log10(count + PRIOR)
                into[here] += np.where(own < none, logs, 0.0)
                rare, text = np.diff(before), np.repeat(np.arange(batch.num_rows), np.diff(before))
                base = batch.column(3).to_numpy()
                score = np.add.reduceat(into, starts) + base + (np.diff(until) - rare) * log_total
                base = base + np.bincount(text, weights=logs - log_total, minlength=batch.num_rows)
                known = np.add.reduceat((kind < none).astype(np.int64), starts)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(known), pa.array(base), pa.array(score)], ["_id", "_tokens", "_known", "_base", "_score"])

    return run


def _scores(first: DataFrame, model: Model) -> DataFrame:
    """Coded texts -> _id, _tokens, _known, _base (log10 by the unigram model), _score (log10 by the classes).

    Rare words are rows of their own, looked up by word, hot ones by a broadcast, and go back to their text as numbers.
    """
    moved, inverse = model.tables()
    total, kind = model.tokens + PRIOR * (model.known + 1), first.schema["_id"].dataType.simpleString()
    run = _last_scores(moved, inverse, math.log10(1 - model.unknown), math.log10(model.unknown), total, int(model.classes[model.words.index(END)]))
    each = first.select("_key", F.posexplode("_rare").alias("_place", "_word"))
    uses = each.groupBy("_word").agg(F.count("*").alias("_uses"))
    of = uses.select("_word", "_uses", F.lit(0).cast("long").alias("_n"), F.lit(None).cast("int").alias("_class")) if model.rare is None else uses.join(model.rare, "_word", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    found = lookup(each, written(of), ["_word"], "_uses", max(1, first.agg(F.sum(F.size("_rare"))).first()[0] or 1))
    found = found.groupBy("_key").agg(F.collect_list(F.struct("_place", "_n", F.coalesce("_class", F.lit(0)).alias("_class"))).alias("_found"))
    both = first.select("_key", "_id", "_tokens", "_kinds", "_base").join(found, "_key", "left").select("_id", "_tokens", "_kinds", "_base", "_found")
    return small_batches(both).mapInArrow(run, f"_id {kind}, _tokens long, _known long, _base double, _score double")


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: _id, _tokens, _known, _base, _score; see _scores. Frequent words are coded where the text is read; texts themselves are never shuffled."""
    if not model.known:
        return docs.select(F.col(id_col).alias("_id"), (F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(WORD)) + 1).cast("long").alias("_tokens"), F.lit(0).cast("long").alias("_known"), F.lit(0.0).alias("_base"), F.lit(0.0).alias("_score"))
    return _scores(coded(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.lit(False).alias("_train")), model), model)



def held_out(id_col: str):
    """Whether a row is left out of training: crc32 of its id as text is divisible by FOLDS. A null id counts as the empty text, so it is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def class_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score; the model is that of the rows that are not held out.

    Tokens are lower-cased (A to Z) words and one end for each text. Null and empty texts are an end alone. Texts of any
    length are scored whole; rows that repeat, or share an id, each get their row, and count as often in training.
    Words that training hasn't seen count as one unknown word. Without training rows nothing is known and every score is
    0. An empty table gives an empty result. Other columns are not read, so their names do not matter.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_train", ~held_out("_id"))
    found = exchanged(rows.filter("_train"), "_text", **options)
    texts = coded(rows, found) if found.known else None
    model = finished(found, texts.filter("_train") if found.known else None)
    out = _scores(texts, model) if found.known else scored(rows, model, "_id", "_text")
    return out.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), F.col("_tokens").alias("n_tokens"), F.col("_known").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), F.col("_base").alias("base_score"), F.col("_score").alias("score"))
