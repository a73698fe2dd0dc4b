"""SimHash near-duplicates by segment popcounts and a grid join under the Manhattan distance; near copies by the Jaccard similarity of their shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import HOT, components, forget, lookup, release, small_batches, written

WORDS = 4
DISTANCE = 4
SEED = 42
#: The similarity of near copies where no contract fixes the bits, as a fraction.
ALIKE = (4, 5)
#: Parts of sets that are compared one after the other.
PARTS = 4
#: Documents in which shingles are counted to put the common ones last, and the number of shingles kept of them.
COUNTED, COMMON = 20_000, 1 << 20
#: Pairs of a set that meet its shingles in one task, where that is over a thousandth of all.
SHARE = 64
#: Ids that are broadcast at most, 16 MB of them; more are joined by a shuffle.
BROADCAST_IDS = 1 << 20
#: A fingerprint is two halves of 32 bits, a half is segments of equal width. The grid starts with the widest segments
#: that leave few fingerprints to a cell; members of cells with over CROWDED of them go on to the next, narrower width.
HALF, WIDTHS, CROWDED = 32, (4, 2, 1), 64
#: Bits of information in the counts of a half, for the widths: what random fingerprints spread over.
SPREAD = {4: 16, 2: 24, 1: 32}
#: Fingerprints of a crowded cell of the narrowest width that are compared in a task; of more, each two parts meet.
CHUNK = 4096


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of 64 bits over the shingles of a text, repeats included: a bit is set if it is set in over half of their XXH64.

    A to Z are lower-cased; words are runs of bytes other than space and 9 to 13. Fewer words than a shingle has: the
    whole sequence is the only one. No words: 0.
    """
    return _print(_hashes(text, words, seed))


def _hashes(text: bytes, words: int, seed: int = SEED) -> list[int]:
    """XXH64 of each shingle in the text's order, repeats included."""
    tokens = text.lower().split()
    n = len(tokens)
    if not n:
        return []
    joined = b" ".join(tokens)
    if n <= words:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - words] + 1))
    of = xxhash.xxh64_intdigest
    return [of(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)]


def _print(hashes: list[int]) -> int:
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # blocks bound the memory of one very long text
        part = np.array(hashes[i : i + (1 << 16)], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py().encode() if t.is_valid else b"", words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], ["_id", "_fp"])

    return small_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, _fp long")


def popcounts(half: Column, width: int) -> Column:
    """The bit counts of the segments of a half; a segment's count stays in the segment's own bits."""
    counts = half
    for step, mask in ((1, 0x55555555), (2, 0x33333333)):
        if step < width:
            part = F.lit(mask).cast("long")
            counts = counts.bitwiseAND(part) + F.shiftright(counts, step).bitwiseAND(part)
    return counts


def grid(halves: DataFrame, width: int) -> DataFrame:
    """(_cell, _fp, _half): the cells of fingerprints (_fp, _half) by the counts of one half's segments.

    The Hamming distance is at least the Manhattan distance of the counts. Two fingerprints within 4 bits are within 2
    in one half, so there their counts are within 2, and a vector of counts lies one step or less from both: if each
    takes its own cell and those a step beside it, within the counts' bounds, they share one. No pair is missed.
    """
    low, high = F.col("_fp").bitwiseAND(F.lit((1 << HALF) - 1)), F.shiftrightunsigned("_fp", HALF)
    rows = halves.select("_fp", "_half", popcounts(F.when(F.col("_half") == 0, low).otherwise(high), width).alias("_counts"))
    counts, found = F.col("_counts"), [F.col("_counts")]
    for i in range(0, HALF, width):
        at = F.shiftright(counts, i).bitwiseAND(F.lit((1 << width) - 1))
        found += [F.when(at < width, counts + F.lit(1 << i)), F.when(at > 0, counts - F.lit(1 << i))]
    return rows.select(F.explode(F.array_compact(F.array(*found))).alias("_c"), "_fp", "_half").select((F.col("_c") + F.shiftleft(F.col("_half").cast("long"), HALF)).alias("_cell"), "_fp", "_half")


def _forest(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join what is linked among distinct fingerprints: one for each but the first of a component.

    Whatever is reached goes out of the search, so a dense group costs little more than its size.
    """
    a, b, left = [own[:0]], [own[:0]], own
    while len(left):
        root, reached, left = left[0], left[:1], left[1:]
        while len(reached) and len(left):
            some, reached = reached[:64], reached[64:]
            near = (np.bitwise_count(some[:, None] ^ left) <= DISTANCE).any(axis=0)
            if near.any():
                new, left = left[near], left[~near]
                a.append(new)
                b.append(np.full(len(new), root))
                reached = np.concatenate([reached, new])
    return np.concatenate(a), np.concatenate(b)


def _small_cells(cell: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _forest, for many small cells at once; rows are in the order of cells."""
    n, label = len(own), np.arange(len(own))
    at, step, left, right = np.arange(n), 0, [label[:0]], [label[:0]]
    while len(at):
        step += 1
        at = at[at + step < n]
        at = at[cell[at + step] == cell[at]]
        near = at[np.bitwise_count(own[at] ^ own[at + step]) <= DISTANCE]
        left.append(near)
        right.append(near + step)
    left, right = np.concatenate(left), np.concatenate(right)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        if (before == label).all():
            break
    linked = np.flatnonzero(label != np.arange(n))
    return own[linked], own[label[linked]]


def _cell_links(crowded: int, last: bool):
    """(a, b, half) of whole groups of rows (_fp, _half, _n, _g: group), which come in the order of groups: links, and with b null, but for the last width, what belongs to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            fp, half, n, group = (batch.column(c).to_numpy() for c in range(4))
            rows = [fp.view(np.uint64), half, n, group]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows, strict=True)]
            if not len(rows[0]):
                continue
            starts = np.flatnonzero(np.concatenate(([True], rows[3][1:] != rows[3][:-1])))
            tail = starts[-1]
            whole = len(rows[0]) if len(rows[0]) - tail == rows[2][tail] else tail
            rest = [x[whole:] for x in rows]
            fp, half, n, group = (x[:whole] for x in rows)
            few = n <= crowded
            links = [_small_cells(group[few], fp[few])]
            if last:
                links += [_forest(fp[s : s + n[s]]) for s in starts[starts < whole] if n[s] > crowded]
            a, b = (np.concatenate(x) for x in zip(*links, strict=True))
            if len(a):
                a, b = np.unique(np.stack([a, b]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.zeros(len(a), np.int32))], ["a", "b", "half"])
            if not last and not few.all():
                more, which = np.unique(np.stack([fp[~few], half[~few].astype(np.uint64)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(more.view(np.int64)), pa.nulls(len(more), pa.int64()), pa.array(which.astype(np.int32))], ["a", "b", "half"])

    return run


def _linked(rows: DataFrame, keys: list[str], last: bool) -> DataFrame:
    """Rows (_cell, _fp, _half, more keys) -> the links within each group of keys, by one shuffle; a group of one row ends there."""
    same = Window.partitionBy(*keys)
    sized = rows.withColumn("_n", F.count("*").over(same)).filter("_n > 1").select("_fp", "_half", F.col("_n").cast("int").alias("_n"), F.xxhash64(*keys).alias("_g"))
    return sized.mapInArrow(_cell_links(CROWDED, last), "a long, b long, half int")


def _hot(sample: DataFrame) -> DataFrame:
    """(_cell) of at most HOT cells that many rows of a sample share, so that their rows need not meet in a task. The sample decides about the way only, not about what is found."""
    return written(sample.groupBy("_cell").agg(F.count("*").alias("_n")).filter(F.col("_n") > CROWDED).orderBy(F.desc("_n"), "_cell").limit(HOT).select("_cell"))


def _coarse(halves: DataFrame, width: int) -> DataFrame:
    """Links of the cells of one width, and what its crowded cells hold. The members of hot cells go on from where they are, without a shuffle into one task."""
    cells = grid(halves, width)
    hot = _hot(grid(halves.filter(F.pmod(F.xxhash64("_fp"), F.lit(16)) == 0), width))
    links = _linked(cells.join(F.broadcast(hot), "_cell", "left_anti"), ["_cell"], False)
    return links.unionByName(cells.join(F.broadcast(hot), "_cell", "left_semi").select(F.col("_fp").alias("a"), F.lit(None).cast("long").alias("b"), F.col("_half").alias("half")))


def _fine(halves: DataFrame, width: int) -> DataFrame:
    """Links of all cells of the narrowest width; large ones in parts, each two of which meet in a group of their own."""
    cells = written(grid(halves, width))
    sizes = written(cells.groupBy("_cell").agg(F.count("*").alias("_n")).filter("_n > 1"))
    parts = F.ceil(F.col("_n") / CHUNK).cast("int")
    rows = lookup(cells, sizes, ["_cell"], "_n", max(1, cells.count())).withColumn("_parts", parts).withColumn("_p", F.pmod(F.xxhash64("_fp"), F.col("_parts")).cast("int"))
    rows = rows.select("_cell", "_fp", "_half", "_p", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_q"))
    return _linked(rows.select("_cell", "_fp", "_half", F.least("_p", "_q").alias("_p"), F.greatest("_p", "_q").alias("_q")), ["_cell", "_p", "_q"], True)


def widths_for(n: int) -> tuple[int, ...]:
    """The widths to begin with: the first leaves a cell a quarter of CROWDED on average; the others refine its crowded cells."""
    found = [w for w in WIDTHS if n * (1 + min(HALF, 2 * HALF // w)) * 4 <= CROWDED << SPREAD[w]]
    return WIDTHS[WIDTHS.index(found[0]) :] if found else WIDTHS[-1:]


def fingerprint_components(prints: DataFrame) -> DataFrame:
    """(_fp, _label) for the distinct fingerprints that link to another; the label is the same within a component.

    In each cell of the grid, fingerprints within 4 bits are joined by as few links as it takes, verified exactly; the
    members of crowded cells meet again in the cells of narrower segments, where fewer unlike ones do. So no group's
    pairs are all emitted, and no cell's size is cut.
    """
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    halves = prints.select("_fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("_half")).repartition(tasks, "_fp", "_half")
    links, widths = None, widths_for(prints.count())
    for width in widths:
        found = written((_fine if width == widths[-1] else _coarse)(halves, width))
        own = found.filter("b is not null").select("a", "b")
        links = own if links is None else links.unionByName(own)
        halves = found.filter("b is null").select(F.col("a").alias("_fp"), F.col("half").alias("_half")).distinct()
    return components(links).select(F.col("node").alias("_fp"), F.col("label").alias("_label"))


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct shingles of a text, sorted. No words: none."""
    return np.unique(np.array(_hashes(text, words), np.uint64))


def _bytes(x: pa.Scalar) -> bytes:
    return x.as_py().encode() if x.is_valid else b""


def odd_counts(own: np.ndarray) -> bytes:
    """One bit for each of 2^k slots, as many as shingles or up to twice that, set if an odd number of the shingles fall there."""
    bits = 1 << max(6, (len(own) - 1).bit_length())
    return np.packbits((np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def least_apart(x: bytes, y: bytes) -> int:
    """The number of shingles in which two sets differ is at least this, by their odd_counts: a shingle of one set only turns one bit."""
    x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    if len(y) > len(x):  # a slot of fewer holds those of the more that have its number in their last bits
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _name(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def common_shingles(docs: DataFrame, id_col: str, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, sorted, that several of about COUNTED documents have, and the number of those; the most common if they are many.

    Only an order of shingles comes of it, and any order finds the same copies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([np.zeros(0, np.uint64), *[shingles(_bytes(t), words) for t in batch.column(0)]])
            found, counts = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts.astype(np.int64))], ["_h", "_n"])

    every = max(1, math.ceil(docs.count() / COUNTED))
    some = small_batches(docs).filter(F.pmod(F.xxhash64(id_col, text_col), F.lit(every)) == 0).select(text_col)
    counted = written(some.mapInArrow(run, "_h long, _n long").groupBy("_h").agg(F.sum("_n").alias("_n")).filter("_n > 1"))
    least, kept = 2, 0
    for r in sorted(counted.groupBy("_n").count().collect(), reverse=True):
        kept += r["count"]
        if kept > COMMON:
            least = r["_n"] + 1
            break
    found = counted.filter(F.col("_n") >= least).toArrow()
    hashes, counts = (found.column(c).to_numpy().astype(np.int64) for c in ("_h", "_n"))
    order = np.argsort(hashes.view(np.uint64))
    return hashes.view(np.uint64)[order], counts[order].astype(np.int32)


def prefixes(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(_id, _fp, _text_key, _set, _size, _prefix, _odd): a row's fingerprint, and a hash, the size, the prefix, in the order of all shingles, and the odd_counts of its set of shingles.

    Sets of a similarity of t have an overlap of at least t times the size of each. So in any one order of all
    shingles, both sets have one in common among their first n - ceil(t * n) + 1: no copy is missed. The order puts common shingles
    last, by which few unlike sets meet and a near copy's own changes come first.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    common, counts = common_shingles(docs, id_col, text_col, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, names, sizes, firsts, odd = [], [], [], [], []
            for t in batch.column(2):
                hashes = _hashes(_bytes(t), words)
                own = np.unique(np.array(hashes, np.uint64))
                n, often = len(own), np.zeros(len(own), np.int32)
                if len(common) and n:
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    often = np.where(common[at] == own, counts[at], 0)
                most = n - -(-n * ALIKE[0] // ALIKE[1]) + 1 if n else 0
                prints.append(_print(hashes))
                names.append(_name(own))
                sizes.append(n)
                odd.append(odd_counts(own))
                firsts.append(own[np.lexsort((own, often))][:most].view(np.int64))
            ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *firsts])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64)), batch.column(1), pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), lists, pa.array(odd, pa.binary())], ["_id", "_fp", "_text_key", "_set", "_size", "_prefix", "_odd"])

    rows = small_batches(docs).select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text_key"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, _fp long, _text_key long, _set long, _size int, _prefix array<long>, _odd binary")


def _may_be_alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) without those whose odd_counts differ more than ALIKE sets do: none that is ALIKE goes.

    The counts are a few hundredths of the shingles, so of nearly all unlike sets the shingles are neither read again nor moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.array([least_apart(x.as_py(), y.as_py()) for x, y in zip(batch.column(3), batch.column(4), strict=True)], np.int64)
            yield batch.select([0, 1]).filter(pa.array(apart * (ALIKE[0] + ALIKE[1]) <= batch.column(2).to_numpy() * (ALIKE[1] - ALIKE[0])))

    pairs = written(pairs.select("a", "b"))
    hot = _shared(pairs)
    table = nodes.select("_set", "_size", "_odd").join(F.broadcast(hot), "_set", "left")
    both = _meet(pairs, table, hot, {"_odd": "_x", "_size": "_m"}, {"_odd": "_y", "_size": "_n"})
    out = written(both.select("a", "b", (F.col("_m") + F.col("_n")).cast("long").alias("_both"), "_x", "_y").mapInArrow(run, "a long, b long"))
    for table in (pairs, hot):
        forget(table)
    return out


def _alike(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """The pairs (a, b) of sets whose similarity is ALIKE or more, counted over all their shingles.

    ALIKE sets differ in at most a ninth of their sizes' sum. The shingles are dealt by their hash in PARTS, which move
    to the pairs one after the other, each once: a pair goes on with the number in which it differs so far, and ends as
    soon as that is over the ninth. So no more than a part of the sets that are still met is on the move at a time.
    """
    spark, columns = docs.sparkSession, [f"_own{k}" for k in range(PARTS)]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(_bytes(t), words) for t in batch.column(0)]
            parts = [[x[x % np.uint64(PARTS) == k].tobytes() for x in found] for k in range(PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array([_name(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64()), *[pa.array(p, pa.binary()) for p in parts]], ["_set", "_size", *columns])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                apart.append(len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True)))
            apart = np.array(apart, np.int64) + batch.column(2).to_numpy()
            good = apart * (ALIKE[0] + ALIKE[1]) <= batch.column(3).to_numpy() * (ALIKE[1] - ALIKE[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(apart)], ["a", "b", "_apart"]).filter(pa.array(good))

    pairs = written(pairs.select("a", "b", F.lit(0).cast("long").alias("_apart")))
    hot = _shared(pairs)
    used = pairs.select(F.explode(F.array("a", "b")).alias("_set")).distinct()
    keys = written(nodes.select("_set", "_text_key").join(used, "_set").select("_text_key"))
    # broadcast, whole texts stay where they are
    near = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
    texts = docs.select(F.xxhash64(text_col).alias("_text_key"), F.col(text_col).alias("_text")).join(near, "_text_key", "left_semi").select("_text")
    found = small_batches(texts).mapInArrow(sets, ", ".join(["_set long", "_size long", *[f"{c} binary" for c in columns]])).dropDuplicates(["_set"])
    own = written(found.join(F.broadcast(hot), "_set", "left"))
    release(spark)
    for column in columns:
        both = _meet(pairs, own, hot, {column: "_x", "_size": "_m"}, {column: "_y", "_size": "_n"})
        out = written(both.select("a", "b", "_apart", F.col("_m") + F.col("_n"), "_x", "_y").mapInArrow(compared, "a long, b long, _apart long"))
        forget(pairs)
        release(spark)
        pairs = out
    for table in (keys, own, hot):
        forget(table)
    return pairs.select("a", "b")


def _shared(pairs: DataFrame) -> DataFrame:
    """(_set, _parts): the sets that over a thousandth of the pairs (a, b) have, so under 2 * HOT, and in how many parts each set's pairs are dealt."""
    most = max(SHARE, pairs.count() // HOT)
    uses = pairs.select(F.explode(F.array("a", "b")).alias("_set")).groupBy("_set").agg(F.count("*").alias("_n"))
    return written(uses.filter(F.col("_n") > most).select("_set", F.ceil(F.col("_n") / most).alias("_parts")))


def _meet(pairs: DataFrame, table: DataFrame, hot: DataFrame, as_a: dict[str, str], as_b: dict[str, str]) -> DataFrame:
    """pairs (a, b) with columns of table for a and for b, found by _set. hot is _shared(); table: _parts of it, else null.

    A set of many pairs is copied for each part of them, so each join is one shuffle in which no key has many rows.
    """
    for key, other, names in (("a", "b", as_a), ("b", "a", as_b)):
        part = F.coalesce(F.pmod(F.xxhash64(other), F.col("_parts")), F.lit(0).cast("long")).alias("_part")
        left = pairs.join(F.broadcast(hot.withColumnRenamed("_set", key)), key, "left").select(*pairs.columns, part)
        copies = F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1).cast("long")) - 1)
        right = table.select(F.col("_set").alias(key), *[F.col(c).alias(n) for c, n in names.items()], F.explode(copies).alias("_part"))
        pairs = left.join(right, [key, "_part"]).drop("_part")
    return pairs


def _fits(size: str, place: str, size2: str, place2: str) -> Column:
    """Whether two sets whose first common shingle, in the order of all, stands at these places may be ALIKE: no more than what is left from there on is common.

    For a later common shingle this is too strict, but the pair also meets at its first.
    """
    most = F.least(F.col(size) - F.col(place), F.col(size2) - F.col(place2))
    return most * (ALIKE[0] + ALIKE[1]) >= (F.col(size) + F.col(size2)) * ALIKE[0]


def open_pairs(mixed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b): sets of different components that share a cell and _fits. mixed: _cell, _fp, _size, _place, _label, _main (the cell's largest component), _all (its rows).

    Of two sets that fit, one at least has the shingle within the first ninth of its own; such a light set meets the
    others. So sets that share no more than their common lines, which stand further back, don't meet at all. Sizes of
    sets that fit differ by a quarter at most, so they meet by steps of their size; and a cell of more than `chunk` rows
    is cut into parts, each two of which meet as a key of their own.
    """
    ninth, main = F.col("_place") * (ALIKE[0] + ALIKE[1]) <= F.col("_size") * (ALIKE[1] - ALIKE[0]), F.col("_label") == F.col("_main")
    step = F.floor(F.log(F.col("_size")) / math.log(ALIKE[1] / ALIKE[0]) + 1e-9).cast("int")
    rows = mixed.withColumn("_parts", F.ceil(F.col("_all") / chunk).cast("int")).withColumn("_own", F.pmod(F.xxhash64("_fp"), F.col("_parts")).cast("int")).withColumn("_light", ninth)
    every = F.sequence(F.lit(0), F.col("_parts") - 1)
    # the light ones of small components meet all; those of the largest one meet the others that aren't light
    x = rows.filter("_light").select("_cell", F.explode(F.array(step - 1, step, step + 1)).alias("_step"), F.col("_own").alias("_p"), every.alias("_qs"), "_fp", "_size", "_place", "_label", main.alias("_is_main"))
    y = rows.select("_cell", step.alias("_step"), every.alias("_ps"), F.col("_own").alias("_q"), F.col("_fp").alias("_fp2"), F.col("_size").alias("_size2"), F.col("_place").alias("_place2"), F.col("_label").alias("_label2"), "_light", main.alias("_is_main2"))
    x, y = x.withColumn("_q", F.explode("_qs")).drop("_qs"), y.withColumn("_p", F.explode("_ps")).drop("_ps")
    meets = (F.col("_label") != F.col("_label2")) & _fits("_size", "_place", "_size2", "_place2")
    keys, found = ["_cell", "_step", "_p", "_q"], []
    for mains, theirs in ((False, F.lit(True)), (True, ~F.col("_light") & ~F.col("_is_main2"))):
        both = x.filter(F.col("_is_main") == mains).join(y.filter(theirs), keys).filter(meets)
        found.append(both.filter(~F.col("_light") | F.col("_is_main2") | (F.col("_label") < F.col("_label2"))).select(F.col("_fp").alias("a"), F.col("_fp2").alias("b")))
    return found[0].unionByName(found[1])


def set_components(nodes: DataFrame, texts: DataFrame, docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """(_fp, _label) for the sets, by their hash, that link to another. nodes: (_set, _size, _prefix), a table that is deleted once read; texts: (_set, _text_key, _size, _odd).

    Sets meet at the shingles of their prefixes. First each meets the one that has the fewest rarer shingles there: in
    a group of near copies that is the one the others were made from, as their changes are rare. Then, where a shingle
    still has several components, sets of different components meet. Both steps keep a pair only if the places of the
    shingle in both orders and the sets' odd_counts leave room for the similarity, and verify it over whole sets.
    """
    spark = docs.sparkSession
    of = lambda n: n.select(F.posexplode("_prefix").alias("_place", "_cell"), F.col("_set").alias("_fp"), "_size")
    cells, hot = of(nodes), _hot(of(nodes.filter(F.pmod(F.xxhash64("_set"), F.lit(16)) == 0)))
    first, names = F.min(F.struct("_place", "_fp", "_size")), {"_place": "_place1", "_fp": "_fp1", "_size": "_size1"}
    within = Window.partitionBy("_cell")
    alone = cells.join(F.broadcast(hot), "_cell", "left_anti").withColumn("_first", first.over(within)).withColumn("_n", F.count("*").over(within)).filter("_n > 1").drop("_n")
    of_hot = cells.join(F.broadcast(hot), "_cell", "left_semi").groupBy("_cell").agg(first.alias("_first"))
    rows = alone.unionByName(cells.join(F.broadcast(of_hot), "_cell"), allowMissingColumns=False)
    shared = written(rows.select("_cell", "_fp", "_size", "_place", *[F.col(f"_first.{c}").alias(n) for c, n in names.items()]))
    forget(nodes)  # their prefixes are many bytes; what is read from here on is ids
    release(spark)
    stars = shared.filter((F.col("_fp") != F.col("_fp1")) & _fits("_size", "_place", "_size1", "_place1")).select(F.col("_fp").alias("a"), F.col("_fp1").alias("b")).distinct()
    linked = written(components(_alike(_may_be_alike(stars, texts), texts, docs, text_col, words)))
    labelled = written(shared.drop("_fp1", "_size1", "_place1").join(linked.select(F.col("node").alias("_fp"), "label"), "_fp", "left").withColumn("_label", F.coalesce("label", "_fp")).drop("label"))
    forget(shared)
    # most shingles have one component by now: only the others' rows go on
    several = written(labelled.groupBy("_cell").agg(F.min("_label").alias("_a"), F.max("_label").alias("_b")).filter("_a < _b").select("_cell"))
    open_ = written(labelled.join(several, "_cell", "left_semi"))
    sizes = open_.groupBy("_cell", "_label").agg(F.count("*").alias("_n"))
    of_cell = sizes.groupBy("_cell").agg(F.max_by("_label", F.struct("_n", "_label")).alias("_main"), F.sum("_n").alias("_all"))
    mixed = written(lookup(open_, of_cell, ["_cell"], "_all", max(1, open_.count())))
    forget(labelled)
    release(spark)
    links = _alike(_may_be_alike(open_pairs(mixed).distinct(), texts), texts, docs, text_col, words)
    every = links.unionByName(linked.select(F.col("node").alias("a"), F.col("label").alias("b")))
    found = components(every).select(F.col("node").alias("_fp"), F.col("label").alias("_label"))
    for table in (mixed, several, open_, linked, links):
        forget(table)
    release(spark)
    return found


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 lower-case hexadecimal digits), component_id.

    component_id is the smallest id reachable over links, the row's own included. With shingles of four words, links are
    of at most 4 differing bits; with others, whose fingerprints no contract bounds, they are between sets of shingles
    with a Jaccard similarity of 0.8 or more. Null and empty texts have fingerprint zero, which links like any other,
    and are equal sets. Repeated ids and rows each get a row; a null id
    joins in, and is a component's id only if all its ids are null. Texts of any length are read whole, their shingles
    counted in blocks. An empty table gives an empty result. Other columns are not read, so their names do not matter.
    """
    if words == WORDS:
        rows = written(fingerprints(docs, id_col, text_col, words))
        prints = written(rows.groupBy("_fp").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")))
        linked = fingerprint_components(prints)
    else:
        found = written(prefixes(docs, id_col, text_col, words))
        rows = written(found.select("_id", F.col("_fp").alias("_print"), F.col("_set").alias("_fp")))
        nodes = found.groupBy("_set").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"), F.first("_text_key").alias("_text_key"), F.first("_size").alias("_size"), F.first("_prefix").alias("_prefix"), F.first("_odd").alias("_odd"))
        nodes = written(nodes)
        forget(found)
        texts = written(nodes.select("_set", "_text_key", "_first", "_n", "_size", "_odd"))
        prints = texts.select(F.col("_set").alias("_fp"), "_first", "_n")
        release(docs.sparkSession)
        linked = set_components(nodes, texts, docs, text_col, words)
    labelled = written(prints.join(linked, "_fp", "left").withColumn("_label", F.coalesce("_label", "_fp")))
    smallest = labelled.groupBy("_label").agg(F.min("_first").alias("_component"), F.count("*").alias("_members"))
    total = max(1, labelled.count())
    of_print = written(lookup(labelled, smallest, ["_label"], "_members", total).select("_fp", "_component", "_n"))
    out = lookup(rows, of_print, ["_fp"], "_n", max(1, rows.count()))
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp" if words == WORDS else "_print"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """docs with one row of each component, that with the smallest id; every column stays. Shingles are of five words
    here, and near copies have a Jaccard similarity of 0.8 or more, all of which are found.

    Of rows that repeat that id, the one with the smallest hash over all columns stays. Rows with a null id all stay.
    """
    ids = near_groups(docs, id_col, text_col, words).filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_n"), F.bool_or(F.col(id_col) == F.col("component_id")).alias("_stays"))
    # ids that go, and those that stay but repeat; all others pass straight through, so whole rows hardly move
    odd = written(ids.filter("not _stays or _n > 1").select("_id", "_stays"))
    odd = F.broadcast(odd) if odd.count() <= BROADCAST_IDS else odd
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"))
    first = Window.partitionBy("_id").orderBy(F.xxhash64("_row"))
    again = rows.join(odd.filter("_stays"), "_id", "left_semi").withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return rows.join(odd, "_id", "left_anti").select("_row.*").unionByName(again.select("_row.*"))
