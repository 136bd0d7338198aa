"""Packing along a space-filling curve.

A document's token ids are hashed to a vector, which a fixed random matrix projects to
a few dimensions; the Hilbert key of that point orders all documents, so that
neighbours on the curve share vocabulary. Documents are range-sorted by key, and each
task fills sequences one after the other, cutting documents where a sequence is full.
What is left at the end of a task is cut into sequences whose lengths are powers of two.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from graphloom.llm.common import row_key, utf8, written

# entries of a worker's word table: half of it is dropped when it is full
WORD_TABLE = 1_000_000
PIECE_TABLE = 400_000
# letters whose case folds one to one, with ASCII marks behind them: their pieces are tokenized apart
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordTokenizer:
    """Ids of a tokenizer whose normalizer and pieces never look across ASCII white space.

    Such a tokenizer gives a text the ids of its words in turn, so each word is
    tokenized once and then looked up. When the table is full its older half
    goes, and what is used again moves to the newer half. Words of Latin letters with marks behind go through the model directly,
    all others through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.get_vocab_size() > 65_536:
            raise ValueError("ids are kept in 16 bits")
        from tokenizers.pre_tokenizers import ByteLevel

        # the model's spelling of each byte that Latin letters and marks have in UTF-8
        probe = "".join(chr(c) for c in (*range(33, 127), *range(0xC0, 0x100)))
        self.spelling = {c: ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0] for c in probe}
        self.model = self.tokenizer.model
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= PIECE_TABLE:
                self.pieces.clear()
            spelled = piece if piece.isascii() else "".join([self.spelling[c] for c in piece])
            found = self.pieces[piece] = array("H", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return found

    def _word(self, word: bytes) -> bytes:
        found = self.older.get(word)
        if found is None:
            text = word.decode("utf-8", "replace")
            if word.isalpha():  # ASCII letters only
                found = self._piece(text.lower())
            elif plain := PLAIN.fullmatch(text):
                letters, marks = plain.groups()
                found = self._piece(letters.lower())
                if marks:
                    found += self._piece(marks)
            else:
                found = array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.words) >= WORD_TABLE // 2:
            self.older, self.words = self.words, {}
        if len(word) < 64:
            self.words[word] = found
        return found

    def ids(self, text: bytes) -> bytes:
        """Token ids as 16-bit numbers."""
        words = (text.lower() if text.isascii() else text).split()
        found = list(map(self.words.get, words))
        if None in found:
            word = self._word
            found = [ids if ids is not None else word(w) for ids, w in zip(found, words)]
        return b"".join(found)


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker: its word table outlives a task."""
    return WordTokenizer(path)


def _mixed(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        values = (values + np.uint64(1)) * MIX
        values ^= values >> np.uint64(29)
        values *= np.uint64(0xBF58476D1CE4E5B9)
        values ^= values >> np.uint64(32)
    return values


def hashed_projection(dims: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each id its place in the hashed vector, and the signs that project that vector."""
    places = (_mixed(np.arange(65_536, dtype=np.uint64) + np.uint64(seed)) % np.uint64(size)).astype(np.int64)
    cells = np.arange(size * dims, dtype=np.uint64) + np.uint64(seed << 20)
    signs = np.where(_mixed(cells) >> np.uint64(63), 1.0, -1.0).reshape(size, dims)
    return places, signs


def hilbert_key(point: list[int], bits: int) -> int:
    """Place of a point of non-negative coordinates on the Hilbert curve of its cube."""
    x, n = list(point), len(point)
    bit = 1 << (bits - 1)
    while bit > 1:  # turn each sub-cube to the orientation of the first
        low = bit - 1
        for i in range(n):
            if x[i] & bit:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, bit = 0, 1 << (bits - 1)
    while bit > 1:
        if x[n - 1] & bit:
            flip ^= bit - 1
        bit >>= 1
    key = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ flip) >> b & 1)
    return key


def _tokenized(path: str, end_id: int, dims: int, bits: int, size: int, seed: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        places, signs = hashed_projection(dims, size, seed)
        last = np.array([end_id], np.uint16).tobytes()
        top = (1 << bits) - 1
        for batch in batches:
            keys, tokens = [], []
            for text in batch.column("text").to_pylist():
                ids = tokenizer.ids(text)
                vector = np.bincount(places[np.frombuffer(ids, np.uint16)], minlength=size).astype(np.float64)
                norm = float(np.sqrt(vector @ vector)) or 1.0
                # coordinates of a unit vector's projection lie about 0 with spread 1
                point = [min(max(round(x), 0), top) for x in (vector @ signs * (top / 8.0 / norm) + top / 2).tolist()]
                keys.append(hilbert_key(point, bits))
                tokens.append(ids + last)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(keys, pa.int64()), pa.array(tokens, pa.binary())],
                ["doc_id", "row_key", "curve_key", "tokens"],
            )

    return rows


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _packed(length: int):
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        open_pieces: list[tuple] = []
        filled = 0
        out: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out.clear()

        def close(pieces: list[tuple], sizes: list[int]) -> None:
            """Deal pieces out to sequences of the given sizes."""
            nonlocal sequence
            queue = iter(pieces)
            doc_id, start, ids, total = next(queue, (None, 0, np.empty(0, "<u4"), 0))
            for size in sizes:
                offset = 0
                while offset < size:
                    if not len(ids):
                        doc_id, start, ids, total = next(queue)
                    take = min(len(ids), size - offset)
                    out.append((doc_id, start, take, total, sequence, offset, ids[:take].tobytes()))
                    start, ids, offset = start + take, ids[take:], offset + take
                sequence += 1

        for batch in batches:
            for doc_id, tokens in zip(batch.column("doc_id").to_pylist(), batch.column("tokens").to_pylist()):
                ids = np.frombuffer(tokens, np.uint16).astype("<u4")
                start = 0
                while start < len(ids):
                    take = min(len(ids) - start, length - filled)
                    open_pieces.append((doc_id, start, ids[start : start + take], len(ids)))
                    start, filled = start + take, filled + take
                    if filled == length:
                        close(open_pieces, [length])
                        open_pieces, filled = [], 0
                if len(out) >= 5_000:
                    yield from flush()
        close(open_pieces, powers_of_two(filled))
        yield from flush()

    return rows


def pack(
    docs: DataFrame,
    tokenizer: str,
    length: int = 2048,
    end_id: int = 1,
    dims: int = 3,
    bits: int = 12,
    vector_size: int = 512,
    seed: int = 42,
    doc_id: Column | None = None,
) -> DataFrame:
    """Rows (doc_id, start, length, doc_tokens, sequence_id, offset, ids), one per piece.

    ``tokenizer`` is the path of a tokenizer file that every executor can read.
    A document's ids end with ``end_id``; a null or empty text has that id only.
    Sequences have ``length`` ids; those at the end of a task have a power of
    two, so nothing is padded. ``ids`` holds a piece as little-endian 32-bit
    numbers. Ties of the curve go by id and text, rows that repeat are packed
    like any other, null ids come first.
    """
    narrow = docs.select((F.col("doc_id") if doc_id is None else doc_id).cast("bigint").alias("doc_id"), row_key().alias("row_key"), utf8().alias("text"))
    tokens = narrow.mapInArrow(
        _tokenized(tokenizer, end_id, dims, bits, vector_size, seed), "doc_id bigint, row_key binary, curve_key bigint, tokens binary"
    )
    # tokenized once: the range sort reads its input twice
    tokens = written(tokens, "tokens")
    order = ["curve_key", "doc_id", "row_key"]
    along = tokens.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "tokens")
    return along.mapInArrow(
        _packed(length), "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    )
