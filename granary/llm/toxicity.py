"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import forget, small_batches, written

#: Lengths of the n-grams, in characters of the lower-cased text between two spaces, and bits of the feature space.
NGRAMS = (3, 4, 5)
BITS = 18
#: Labelled rows that the model is fitted on at most: those with the smallest hashes of their ids, one text for an id,
#: as far as their n-grams are no more than TRAIN_NGRAMS (4 bytes each) together.
TRAIN_ROWS, TRAIN_NGRAMS = 5000, 24_000_000
FOLDS = 5
EPOCHS = 12
BATCH = 256
RATE = 0.3
#: Characters of a text that are hashed at once; one very long text takes several blocks, which overlap by an n-gram.
BLOCK = 1 << 20
_K = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xBF58476D1CE4E5B9)
class Features:
    """The set of n-grams of a text, as sorted indexes. The table of what was seen is reused from text to text."""

    def __init__(self) -> None:
        self.seen = np.zeros(1 << BITS, bool)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int64)
        chars = np.frombuffer(f" {text} ".lower().encode("utf-32-le", "replace"), "<u4")
        for at in range(0, len(chars), BLOCK):
            data = chars[at : at + BLOCK + NGRAMS[-1] - 1].astype(np.uint64)
            data[(data >= 9) & (data <= 13)] = 32  # white space of the word rules counts as a space
            data += np.uint64(1)
            h = data * _K
            for n in range(2, NGRAMS[-1] + 1):
                if len(data) < n:
                    break
                h = (h[:-1] + data[n - 1 :]) * _K
                if n in NGRAMS:
                    mixed = (h ^ (h >> np.uint64(29))) * _M
                    self.seen[(mixed >> np.uint64(64 - BITS)).astype(np.int64)] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found


@dataclass
class Model:
    """score = sigmoid(bias + sum(weight[f]) / sqrt(sum(square[f]))) over the n-grams f of a text; weight holds the ratio's factor."""

    weight: np.ndarray
    square: np.ndarray
    bias: float

    @property
    def learnt(self) -> bool:
        """Whether labels of both classes were there to learn from."""
        return bool(self.square.any())

    def score(self, found: np.ndarray) -> float:
        z = self.bias
        if len(found) and (norm := float(self.square[found].sum(dtype=np.float64))) > 0:
            z += float(self.weight[found].sum(dtype=np.float64)) / math.sqrt(norm)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def fit(found: np.ndarray, ends: np.ndarray, labels: np.ndarray) -> Model:
    """Log-count ratios of the n-grams' document counts, then logistic regression on the ratios, scaled to length 1, by Adagrad over small batches.

    found: the n-grams of all texts one after the other, up to ends. With labels of one class only, or none, every text
    gets the smoothed share of label 1.
    """
    size, n, ones = 1 << BITS, len(labels), int(labels.sum())
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    zero = Model(np.zeros(size, np.float32), np.zeros(size, np.float32), math.log((ones + 1) / (n - ones + 1)))
    if not 0 < ones < n:
        return zero
    counts = np.ones((2, size))
    for i in range(n):
        counts[int(labels[i]), found[starts[i] : ends[i]]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    norms = np.array([math.sqrt(float((ratio[found[a:b]] ** 2).sum())) or 1.0 for a, b in zip(starts, ends, strict=True)])
    w, b, w2, b2 = np.zeros(size), 0.0, np.full(size, 1e-12), 1e-12
    order = np.random.default_rng(1)
    for _ in range(EPOCHS):
        shuffled = order.permutation(n)
        for at in range(0, n, BATCH):
            some = shuffled[at : at + BATCH]
            index = np.concatenate([found[starts[i] : ends[i]] for i in some])
            row = np.repeat(np.arange(len(some)), ends[some] - starts[some])
            value = ratio[index] / norms[some][row]
            z = b + np.bincount(row, weights=value * w[index], minlength=len(some))
            e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[some]) / len(some)
            g = np.bincount(index, weights=value * e[row], minlength=size)
            w2 += g * g
            b2 += e.sum() ** 2
            w -= RATE * g / np.sqrt(w2)
            b -= RATE * e.sum() / math.sqrt(b2)
    return Model((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), float(b))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(order, label, n-grams as the bytes of 32-bit numbers)."""
    of = Features()
    for batch in batches:
        found = [of(t.as_py()).astype("<i4").tobytes() for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["place", "label", "features"])


def _fitted(bound: int):
    """The model of the sample, whose rows come in order in one task, as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, labels, total = [], [], 0
        for batch in batches:
            for label, ngrams in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                ngrams = np.frombuffer(ngrams.as_buffer(), "<i4")
                if total + len(ngrams) <= bound:
                    total += len(ngrams)
                    found.append(ngrams)
                    labels.append(float(label))
        ends = np.cumsum([len(x) for x in found]).astype(np.int64)
        model = fit(np.concatenate([np.zeros(0, "<i4"), *found]), ends, np.array(labels, np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.square.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], ["weight", "square", "bias"])

    return run


def held_out(docs: DataFrame, id_col: str = "doc_id"):
    return F.crc32(F.coalesce(docs[id_col].cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS, ngrams: int = TRAIN_NGRAMS) -> Model:
    """Fits the model on labelled rows that are not held out, on at most `rows` of them, chosen by a hash of the id.

    Rows without a label and labels without a text take no part, and the sample is drawn from the others; of several
    labels of an id the largest holds, of several texts of an id the first by their bytes. A text with whom the sample would have more than `ngrams` n-grams is left out of it. The
    n-grams are made in the tasks that read the texts, and the model, of that bounded sample, in one task of an
    executor; only the model's 2 MB come to the driver.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    known = known.filter(F.crc32(F.col("_id").cast("string").cast("binary")) % FOLDS != 0)
    has_text = docs.filter(F.col(text_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_n")).select("_id")
    known = known.join(has_text, "_id", "left_semi")
    order = F.struct(F.xxhash64("_id").alias("_h"), F.col("_id"))
    sample = written(known.orderBy(F.xxhash64("_id"), "_id").limit(rows).select("_id", order.alias("_place"), "_label"))
    texts = small_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    texts = texts.groupBy("_place").agg(F.min("_label").alias("_label"), F.min("_text").alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    features = written(texts.mapInArrow(_feature_batches, f"place struct<_h:bigint,_id:{kind}>, label int, features binary"))
    got = features.repartition(1).sortWithinPartitions("place").mapInArrow(_fitted(ngrams), "weight binary, square binary, bias double").collect()
    forget(sample)
    forget(features)
    if not got:
        return fit(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))
    return Model(np.frombuffer(got[0].weight, np.float32), np.frombuffer(got[0].square, np.float32), got[0].bias)


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a column of the score of each whole text; a null text counts as empty. The new column's name must not be one of docs'."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two vectors of 1 MB each
    names = [*docs.columns, score_col]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, model = Features(), shared.value
        for batch in batches:
            scores = pa.array([model.score(of(t.as_py())) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names)

    kinds = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    return small_batches(docs).mapInArrow(run, kinds)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted.

    Null and empty texts have no n-grams: they get the score of the bias alone. Texts of any length are scored whole,
    in blocks. Rows that repeat an id, or a whole row, each get their own row and score; a row with a null id is scored
    too, never trained on, and held out, as the empty text that stands for its id has a remainder of 0. Other columns
    are not read, so their names do not matter. Without labels that have a text every score is 0.5. An empty table gives an empty result.
    """
    model = train(docs, labels, id_col, text_col, label_col)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = scored(texts, model, "_text", "_score").drop("_text")
    return out.select(F.col("_id").alias(id_col), held_out(out, "_id").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """docs without the rows that the model predicts to be toxic; every column stays, whatever its name.

    Rows are judged one by one: null, empty, very long and repeated ones as in toxicity. Where no text has a label, or
    all labels are the same, nothing was learnt and all rows stay.
    """
    model = train(docs, labels, id_col, text_col, label_col)
    if not model.learnt:
        return docs
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    return scored(docs, model, text_col, name).filter(F.col(name) < 0.5).drop(name)
