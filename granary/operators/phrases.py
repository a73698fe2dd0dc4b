"""Which texts contain which phrases: both sides meet at one rare anchor of the phrase, by an equi-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.scratch import written

#: Bytes of a gram, and windows of grams by the class of a phrase (the bits of its length): any text that contains the
#: phrase has the smallest gram of each such window of it. Shorter phrases are grams of their own length.
GRAM, WINDOWS, WIDEST = 8, {4: 1, 5: 8, 6: 16, 7: 32}, 64
#: Bits of the filter of anchors: 16 for each within these bounds; 16 MB is all that is broadcast. A full one lets more through, which the join drops.
LEAST_BITS, MOST_BITS = 1 << 17, 1 << 27
#: Bytes of an Arrow batch of texts.
BATCH_BYTES = 4 << 20
_K, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M
    x = (x ^ (x >> np.uint64(27))) * _K
    return x ^ (x >> np.uint64(31))


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """A number for the `size` bytes at each place; of 8 bytes, one for each different gram."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out |= data[i : i + n].astype(np.uint64) << np.uint64(8 * i)
    return _mixed(out + np.uint64(0 if size == GRAM else size << 56))


def _slid(x: np.ndarray, width: int, of) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = of(x[:-step], x[step:])
        done += step
    return x


def places(grams: np.ndarray, width: int) -> np.ndarray:
    """Where a gram is the smallest of a window of `width` grams around it."""
    if len(grams) < width or width == 1:
        return np.arange(len(grams) if width == 1 else 0)
    least = _slid(grams, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_slid(np.concatenate([edge, least, edge]), width, np.maximum) == grams)


def class_of(size: int) -> int:
    """1 to 7: the length itself, in negative; from 8 on: the bits of the length."""
    return -size if size < GRAM else size.bit_length()


def _anchors(phrase: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    kind = class_of(len(phrase))
    grams = _grams(np.frombuffer(phrase, np.uint8), GRAM if kind > 0 else -kind)
    at = places(grams, WINDOWS.get(kind, WIDEST) if kind > 0 else 1)
    return kind, at, grams[at]


def _phrase_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_phrase) -> (_phrase, _kind, _anchor, _at) for each of its possible anchors, once."""
    for batch in batches:
        rows: tuple[list, list, list, list] = ([], [], [], [])
        for k, x in enumerate(batch.column(0)):
            kind, at, grams = _anchors(x.as_buffer().to_pybytes())
            grams, first = np.unique(grams, return_index=True)
            for column, values in zip(rows, ([k] * len(grams), [kind] * len(grams), grams.view(np.int64).tolist(), at[first].tolist()), strict=True):
                column += values
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int64())), *[pa.array(r, t) for r, t in zip(rows[1:], (pa.int32(), pa.int64(), pa.int32()), strict=True)]], ["_phrase", "_kind", "_anchor", "_at"])


def _slot(kind: int, grams: np.ndarray, bits: int) -> np.ndarray:
    return _mixed(grams + np.uint64((kind & 0xFF) * int(_K) % 2**64)) & np.uint64(bits - 1)


def _filter(anchors: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the anchors by class, put together in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, grams = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            found = [_slot(int(k), grams[kinds == k], bits) for k in np.unique(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.zeros(0, np.uint64), *found])).astype(np.int64) + 1)], ["_slot"])

    rows = anchors.select("_kind", "_anchor").mapInArrow(run, "_slot long")
    rows = rows.groupBy(F.expr("bitmap_bucket_number(_slot)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_slot))").alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.collect():
        at = (r.b - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r.m), np.uint8)[: len(out) - at]
    return out


def containing(rows: DataFrame, phrases: DataFrame, body: str, id_col: str, on: list[str] | None = None) -> DataFrame:
    """rows without body, with the id of each phrase (id_col, phrase) that their body contains; exact. on: columns of both sides that must be equal too.

    Of the grams that any text with the phrase must show, each phrase's rarest one is its anchor. Texts are read once,
    however many phrases there are: where a gram may be an anchor, which a filter tells, the bytes around it go to the
    phrases of that anchor by a join, and are compared there. Null bodies and phrases contain nothing; an empty phrase
    is contained in every body; rows that repeat each get their own; of a phrase with several ids each is named.
    """
    spark, names, on = rows.sparkSession, [c for c in rows.columns if c != body], on or []
    known = phrases.filter("phrase is not null").select(F.col(id_col).alias("_phrase_id"), F.encode("phrase", "utf-8").alias("_phrase"), *on)
    some = written(known.filter(F.length("_phrase") > 0).select("_phrase").distinct().mapInArrow(_phrase_anchors, "_phrase binary, _kind int, _anchor long, _at int"))
    shared_by = some.groupBy("_kind", "_anchor").agg(F.count("*").alias("_n"))
    first = Window.partitionBy("_phrase").orderBy("_n", "_anchor")
    anchors = written(some.join(shared_by, ["_kind", "_anchor"]).withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k", "_n"))
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * max(1, anchors.count()) - 1).bit_length()))
    kinds = sorted(r._kind for r in anchors.select("_kind").distinct().collect())
    shared = spark.sparkContext.broadcast((kinds, _filter(anchors, bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, bitmap = shared.value
        bits = len(bitmap) * 8
        for batch in batches:
            at, kind_of, keys, pieces, befores = [], [], [], [], []
            for r, text in enumerate(batch.column(len(names) + 1)):
                if not text.is_valid or not len(text.as_buffer()):
                    continue
                whole = text.as_buffer().to_pybytes()
                data, grams, seen = np.frombuffer(whole, np.uint8), {}, set()
                for kind in kinds:
                    size, width = (GRAM, WINDOWS.get(kind, WIDEST)) if kind > 0 else (-kind, 1)
                    if size not in grams:
                        grams[size] = _grams(data, size)
                    if width not in grams.setdefault("places", {}) or kind < 0:
                        grams["places"][width] = places(grams[size], width)
                    here = grams["places"][width]
                    slot = _slot(kind, grams[size][here], bits)
                    here = here[(bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                    reach = 1 << kind if kind > 0 else -kind
                    for p, key in zip(here.tolist(), grams[size][here].view(np.int64).tolist(), strict=True):
                        start = max(0, p - reach) if kind > 0 else p
                        piece = (kind, key, whole[start : p + reach], p - start)
                        if piece not in seen:
                            seen.add(piece)
                            at.append(r)
                            kind_of.append(kind)
                            keys.append(key)
                            pieces.append(piece[2])
                            befores.append(piece[3])
                    if kind < 0:
                        grams["places"].pop(1)
            part = batch.select(["_row", *names]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(kind_of, pa.int32()), pa.array(keys, pa.int64()), pa.array(pieces, pa.binary()), pa.array(befores, pa.int32())], ["_row", *names, "_kind", "_anchor", "_piece", "_before"])

    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(conf) in ("67108864b", "64MB", "67108864"):
        spark.conf.set(conf, f"{BATCH_BYTES}b")
    kinds_of = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != body)
    numbered = rows.select(F.monotonically_increasing_id().alias("_row"), *[F.col(f"`{c}`") for c in names], F.col(body).alias("_body"))
    hits = numbered.mapInArrow(run, f"_row long, {kinds_of}{', ' if kinds_of else ''}_kind int, _anchor long, _piece binary, _before int")
    inside = F.substring(F.col("_piece"), F.col("_before") - F.col("_at") + 1, F.length("_phrase")) == F.col("_phrase")
    anchors = anchors.join(known.select("_phrase", *on).distinct(), "_phrase") if on else anchors
    met = hits.join(anchors, ["_kind", "_anchor", *on]).filter((F.col("_before") >= F.col("_at")) & inside)
    met = met.select("_row", *[F.col(f"`{c}`") for c in names], "_phrase").dropDuplicates(["_row", "_phrase"]).join(known, ["_phrase", *on])
    out = met.select(*[F.col(f"`{c}`") for c in names], F.col("_phrase_id").alias(id_col))
    always = known.filter(F.length("_phrase") == 0).select(F.lit(True).alias("_is_text"), F.col("_phrase_id").alias(id_col), *on)
    if always.isEmpty():
        return out
    return out.unionByName(rows.withColumn("_is_text", F.col(body).isNotNull()).join(F.broadcast(always), ["_is_text", *on]).select(*[F.col(f"`{c}`") for c in names], id_col))
