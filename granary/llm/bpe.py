"""BPE encoding and decoding with content-defined chunks that are encoded once."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import small_batches

#: A chunk ends at the first white space after a place where the rolling hash of WINDOW bytes has MASK's bits all zero: about every 512 bytes.
WINDOW = 16
MASK = 511
#: Bytes of chunks, and words, that a worker keeps at most; when full, it starts anew.
CHUNK_BYTES = 48 << 20
WORDS = 600_000
#: Bytes of a text whose chunks are found at once, and of texts whose new words are encoded at once.
BLOCK, TOGETHER = 1 << 20, 1 << 18
_TABLE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64)
#: Punctuation that ends a word, after an ASCII letter or digit: to the tokenizer a token of its own, so it's cut off.
#: It starts with the punctuation, as a search for one of some bytes is faster than one that looks back at every place.
_TAIL = re.compile(rb"([.,;:!?](?<=[0-9a-z].)[.,;:!?]*)(?=[\x20\x09-\x0D]|\Z)")
_PROBES = (b"Alpha, beta. Gamma! 7; x", "\u00c9t\u00e9, \u00fcber. Stra\u00dfe:".encode(), b"don't, I'LL. we've ?!")
#: What follows a word in a decoded text.
_END = "</w> "
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def cuts(text: bytes) -> list[int]:
    """Where the chunks of a text begin and end. They depend on the bytes nearby alone, so texts that share a passage share its inner chunks.

    Cuts are at the start of a run of white space only; a text without any is one chunk.
    """
    found = []
    for at in range(0, len(text), BLOCK):
        data = _TABLE[np.frombuffer(text[max(0, at - WINDOW + 1) : at + BLOCK], np.uint8)]
        n = len(data) - WINDOW + 1
        if n <= 0:
            continue
        rolled, width = data, 1
        while width < WINDOW:  # the hash of a window twice as wide, from its two halves
            rolled = (rolled[:-width] << np.uint64(width)) + rolled[width:]
            width *= 2
        hits = np.flatnonzero(((rolled >> np.uint64(20)) & np.uint64(MASK)) == 0)
        found += (hits + max(0, at - WINDOW + 1) + WINDOW).tolist()
    places, last = [0], 0
    for hit in found:
        if hit > last and (space := _SPACE.search(text, hit)) and space.start() > last:
            last = space.start()
            places.append(last)
    if places[-1] < len(text) or len(places) == 1:
        places.append(len(text))
    return places


class Codec:
    """Encodes and decodes texts as the tokenizer does, by chunks and, within new chunks, by words that were seen before."""

    def __init__(self, path: str, words: int = WORDS, chunk_bytes: int = CHUNK_BYTES) -> None:
        from tokenizers import Tokenizer

        self.most_words, self.most_bytes = words, chunk_bytes
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.chunks: dict[bytes, tuple[bytes, str]] = {}
        self.chunk_bytes = 0
        self.words: dict[bytes, tuple[bytes, str]] = {}
        self.joins: dict[bytes, bool] = {}
        self.repairs = 0
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.by_words = all(self.whole([p]) == [self.joined(self.whole(_TAIL.sub(rb" \1", p.lower()).split()))] for p in _PROBES)

    def whole(self, texts: list[bytes]) -> list[tuple[bytes, str]]:
        """(ids as bytes, decoded text) of each text, by the tokenizer alone."""
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        ids = [e.ids for e in found]
        return [(np.array(i, "<u4").tobytes(), d) for i, d in zip(ids, self.tokenizer.decode_batch(ids, skip_special_tokens=False), strict=True)]

    def joined(self, parts: list[tuple[bytes, str]]) -> tuple[bytes, str]:
        if len(parts) == 1:
            return parts[0] if parts[0][0] else (b"", "")
        if not parts:
            return b"", ""
        ids, texts = zip(*parts)
        return b"".join(ids), " ".join(texts if all(ids) else [t for i, t in parts if i])

    def leaves(self, chunk: bytes) -> list[bytes]:
        """The parts of a chunk that the tokenizer takes one by one: words in lower case, end punctuation apart.

        A chunk with the start of a special token, whose case matters, is only cut at white space. For a tokenizer
        that treats white space, case or punctuation otherwise, which the probes show, the whole chunk is the part.
        """
        if not self.by_words:
            return [chunk]
        return chunk.split() if b"<|" in chunk else _TAIL.sub(rb" \1", chunk.lower()).split()

    def learn(self, words: list[bytes]) -> None:
        """Encodes words. Those of letters only go together, as texts of 100 words, and fall apart after the tokens that end words; if their count differs, each goes alone."""
        if len(self.words) + len(words) > self.most_words:
            self.words.clear()
        text = [w.decode() for w in words]
        letters = [i for i, t in enumerate(text) if t.isalpha()] if self.by_words else []
        split = False
        if letters:
            found = self.tokenizer.encode_batch_fast([" ".join([text[i] for i in letters[k : k + 100]]) for k in range(0, len(letters), 100)], add_special_tokens=False)
            each = [e.ids for e in found]
            ids = list(chain.from_iterable(each))
            raw = np.array(ids, "<u4")
            last = np.flatnonzero(self.ends[raw]) + 1
            split = len(last) == len(letters)
        if split:
            at, data = [0, *last.tolist()], raw.tobytes()
            decoded = self._decoded(each, ids, at)
            own = [data[a:b] for a, b in pairwise((last * 4).tolist())]
            self.words.update(zip([words[i] for i in letters], zip([data[: 4 * at[1]], *own], decoded, strict=True), strict=True))
            known = set(letters)
            words = [w for i, w in enumerate(words) if i not in known]
        if words:
            self.words.update(zip(words, self.whole(words), strict=True))

    def _decoded(self, texts: list[list[int]], ids: list[int], at: list[int]) -> list[str]:
        """The decoded texts of words that follow each other in texts: where a text decodes to its tokens with spaces between, its words fall apart after the tokens that end them."""
        if self.tokenizer.decoder is None:
            found = [w for d in self.tokenizer.decode_batch(texts, skip_special_tokens=False) for w in (d + " ").split(_END)[:-1]]
            if len(found) == len(at) - 1:
                return [w + _END[:-1] for w in found]
        return self.tokenizer.decode_batch([ids[a:b] for a, b in pairwise(at)], skip_special_tokens=False)

    def of_chunks(self, chunks: list[bytes]) -> list[tuple[bytes, str]]:
        """Each chunk's ids and text: kept ones as they are, new ones by their parts, all new parts of them at once."""
        new = [c for c in dict.fromkeys(chunks) if c not in self.chunks]
        tokens = [self.leaves(c) for c in new]
        seen = set().union(*tokens)
        unknown = list(seen.difference(self.words))
        if unknown and (len(self.words) + len(unknown) > self.most_words or len(unknown) > self.most_words // 4):
            self.words.clear()
            unknown = list(seen)
        if len(unknown) > self.most_words // 4:  # a text of very many words: what is kept of them may not hold all
            own = {c: self.joined([x for i in range(0, len(t), 1000) for x in self._alone(t[i : i + 1000])]) for c, t in zip(new, tokens, strict=True)}
        else:
            if unknown:
                self.learn(unknown)
            known = {w: self.words[w] for w in seen}.__getitem__  # few enough to stay in the processor's cache
            own = {c: self.joined(list(map(known, t))) for c, t in zip(new, tokens, strict=True)}
        out = [own[c] if c in own else self.chunks[c] for c in chunks]
        for c, (ids, text) in own.items():
            self.chunk_bytes += len(c) + len(ids) + len(text)
            if self.chunk_bytes > self.most_bytes:
                self.chunks.clear()
                self.chunk_bytes = 0
                break
            self.chunks[c] = (ids, text)
        return out

    def _alone(self, words: list[bytes]) -> list[tuple[bytes, str]]:
        self.learn(list({w for w in words if w not in self.words} if len(self.words) + len(words) <= self.most_words else set(words)))
        return [self.words[w] for w in words]

    def agrees(self, left: bytes, right: bytes) -> bool:
        """Whether a join is right: what stands around it, encoded and decoded as one text, is what its two sides are alone.

        Joins with the same bytes next to the gap, and the same gap, are tried once.
        """
        bare = right.lstrip()
        gap = right[: len(right) - len(bare)]
        key = left[-2:] + b"\0" + gap[:2] + b"\0" + bare[:2]
        if key not in self.joins:
            a, b = left[-256:].decode("utf-8", "ignore").split()[-1:], bare[:256].decode("utf-8", "ignore").split()[:1]
            if not a or not b:
                return True
            if len(self.joins) > self.most_words:
                self.joins.clear()
            sides = self.whole([a[0].encode(), b[0].encode(), a[0].encode() + gap + b[0].encode()])
            self.joins[key] = self.joined(sides[:2]) == sides[2]
        return self.joins[key]

    def __call__(self, text: bytes) -> tuple[bytes, str]:
        """ids and decoded text."""
        return self.batch([text])[0]

    def batch(self, texts: list[bytes]) -> list[tuple[bytes, str]]:
        """ids and decoded text of each text. New chunks of all of them are encoded at once; a text with a join that does not agree is repaired."""
        chunks, ends, out = [], [], []
        for text in texts:
            places = cuts(text)
            own = [text[a:b] for a, b in zip(places, places[1:])]
            good = all(self.agrees(a, b) for a, b in zip(own, own[1:]))
            chunks += own if good else []
            ends.append(len(chunks) if good else None)
            out.append(None if good else self.repaired(own))
        parts, at = self.of_chunks(chunks), 0
        for i, end in enumerate(ends):
            if end is not None:
                out[i], at = self.joined(parts[at:end]), end
        return out

    def repaired(self, chunks: list[bytes]) -> tuple[bytes, str]:
        """Of chunks with a join that does not agree: both its sides, and more while need be, are encoded as one."""
        merged: list[bytes] = []
        again: list[bool] = []
        for chunk in chunks:
            repaired = False
            while merged and not self.agrees(merged[-1], chunk):
                chunk, repaired = merged.pop() + chunk, True
                again.pop()
                self.repairs += 1
            merged.append(chunk)
            again.append(repaired)
        parts = [self.whole([c])[0] if r else self.of_chunks([c])[0] for c, r in zip(merged, again, strict=True)]
        return self.joined(parts)


def _together(texts: pa.Array) -> Iterator[list[bytes]]:
    """Runs of texts of about TOGETHER bytes."""
    run, size = [], 0
    for t in texts:
        run.append(t.as_buffer().to_pybytes() if t.is_valid else b"")
        size += len(run[-1])
        if size >= TOGETHER:
            yield run
            run, size = [], 0
    if run:
        yield run


_codecs: dict[tuple, Codec] = {}


def codec(path: str, words: int = WORDS, chunk_bytes: int = CHUNK_BYTES) -> Codec:
    """One codec for each worker process: what it keeps serves all tasks of the worker."""
    key = (path, words, chunk_bytes)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", full: bool = False, words: int = WORDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256, decoded_sha256, and with full ids (array<int>) and decoded.

    A null text counts as empty: no ids. Texts of any length are taken whole. Rows that repeat an id or a text each get
    their own row, the text encoded once by a worker that still has its chunks; a null id is kept. An empty table gives
    an empty result. The vocabulary's path is a parameter; it must be readable on every executor. Other columns are not
    read, so their names do not matter.
    """
    at = path or default_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(at, words, chunk_bytes)
        for batch in batches:
            sizes, ids_sha, text_sha, ids, texts = [], [], [], [], []
            for raw, decoded in chain.from_iterable(map(of.batch, _together(batch.column(1)))):
                sizes.append(len(raw) // 4)
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                if full:
                    ids.append(np.frombuffer(raw, "<u4").astype(np.int32))
                    texts.append(decoded)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if full:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full
    out = small_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)
    return out.withColumnRenamed("_id", id_col)
