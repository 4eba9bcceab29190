"""Problem 8: byte-level BPE of a whole corpus with a public vocabulary.

Words of equal length are encoded together as padded matrices of ids. In each
round every row merges its leftmost pair of minimum rank; ranks come from an
open-addressing hash table of pairs, and the row is closed up over the merged
cell. Only ranks beside a merge are looked up again.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from weftlight.plans.spread import spread

#: Folder of the public vocabularies.
VOCABULARY_DIR = "/opt/tokenizers"
#: The pattern that splits text into words before the merges (fixed by the vocabulary).
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept per worker between batches; beyond it the memory is emptied (results do not change).
CACHED_WORDS = 200_000
#: Cells of one padded matrix.
MATRIX_CELLS = 1 << 20
_NONE = np.int64(1 << 40)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    spare = 256
    for b in range(256):
        if b not in plain:
            letters[chr(spare)] = b
            spare += 1
    return letters


class PairTable:
    """Open-addressing hash table from a pair of ids to the rank and the id of its merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(len(left) * 4 + 1))))
        size = 1 << self.bits
        self.mask = np.int64(size - 1)
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, _NONE, np.int64)
        self.merged = np.zeros(size, np.int64)
        key = (left.astype(np.int64) << 20) | right.astype(np.int64)
        slot = self._home(key)
        left_over = np.arange(len(key))
        self.reach = 0
        while len(left_over):
            at = slot[left_over]
            free = self.keys[at] == -1
            _, first = np.unique(at, return_index=True)
            chosen = np.zeros(len(left_over), bool)
            chosen[first] = True
            chosen &= free
            put, where = left_over[chosen], at[chosen]
            self.keys[where], self.rank[where], self.merged[where] = key[put], rank[put], merged[put]
            left_over = left_over[~chosen]
            # a slot lost to another pair: go on to the next one
            slot[left_over] = (slot[left_over] + (self.keys[slot[left_over]] != -1)) & self.mask
            self.reach += 1

    def _home(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; a pair without a merge has the rank ``_NONE``."""
        key = (left.astype(np.int64) << 20) | right.astype(np.int64)
        key = np.where((left < 0) | (right < 0), np.int64(-2), key)
        slot = self._home(key)
        rank, merged = np.full(key.shape, _NONE, np.int64), np.zeros(key.shape, np.int64)
        open_ = np.flatnonzero(key.ravel() >= 0)
        flat_key, flat_slot = key.ravel(), slot.ravel()
        flat_rank, flat_merged = rank.ravel(), merged.ravel()
        while len(open_):
            at = flat_slot[open_]
            there = self.keys[at]
            hit = there == flat_key[open_]
            flat_rank[open_[hit]] = self.rank[at[hit]]
            flat_merged[open_[hit]] = self.merged[at[hit]]
            open_ = open_[~hit & (there != -1)]
            flat_slot[open_] = (flat_slot[open_] + 1) & self.mask
        return flat_rank.reshape(key.shape), flat_merged.reshape(key.shape)


class MatrixEncoder:
    """Encodes texts with the byte-level vocabulary in ``path``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary = model["vocab"]
        self.of_byte = np.zeros(256, np.int64)
        for letter, byte in _byte_letters().items():
            self.of_byte[byte] = vocabulary[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.table = PairTable(
            np.array([vocabulary[a] for a, _ in pairs]),
            np.array([vocabulary[b] for _, b in pairs]),
            np.arange(len(pairs)),
            np.array([vocabulary[a + b] for a, b in pairs]),
        )
        self.words = regex.compile(WORD_PATTERN)
        self.cache: dict[str, np.ndarray] = {}

    def merge_rows(self, ids: np.ndarray) -> list[np.ndarray]:
        """Merges the rows of a matrix of byte ids until no row has a pair with a rank."""
        out: list[np.ndarray | None] = [None] * len(ids)
        row = np.arange(len(ids))
        rank, merged = self.table.find(ids[:, :-1], ids[:, 1:])
        while True:
            best = rank.min(axis=1) if rank.shape[1] else np.full(len(ids), _NONE)
            done = best >= _NONE
            if done.any():
                for r, cells in zip(row[done], ids[done], strict=True):
                    out[r] = cells[cells >= 0]
                ids, rank, merged, row = ids[~done], rank[~done], merged[~done], row[~done]
            if not len(row):
                return out  # type: ignore[return-value]
            at = rank.argmin(axis=1)  # the leftmost of the least
            every = np.arange(len(row))
            ids[every, at] = merged[every, at]
            keep = np.ones(ids.shape, bool)
            keep[every, at + 1] = False
            width = ids.shape[1] - 1
            ids = ids[keep].reshape(len(row), width)
            # the pair (at, at+1) is gone; those at at-1 and at at are new
            keep = np.ones(rank.shape, bool)
            keep[every, at] = False
            rank, merged = rank[keep].reshape(len(row), width - 1), merged[keep].reshape(len(row), width - 1)
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side < width - 1))
                if len(ok):
                    rank[ok, side[ok]], merged[ok, side[ok]] = self.table.find(ids[ok, side[ok]], ids[ok, side[ok] + 1])
            longest = int((ids >= 0).sum(axis=1).max())
            if longest < width:  # compaction: columns that hold nothing but padding go
                ids, rank, merged = ids[:, :longest], rank[:, : max(longest - 1, 0)], merged[:, : max(longest - 1, 0)]

    def learn(self, words: list[str]) -> None:
        """Encodes words that are not in memory yet, in buckets of like length."""
        raw = [w.encode("utf-8") for w in words]
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        start = 0
        while start < len(order):
            longest = len(raw[order[start]])
            end = start
            # a bucket: lengths within a quarter of the shortest, and a bounded matrix
            top = longest + max(1, longest // 4)
            while end < len(order) and len(raw[order[end]]) <= top and (end - start + 1) * top <= max(MATRIX_CELLS, top):
                end += 1
            part = order[start:end]
            width = len(raw[part[-1]])
            lengths = np.array([len(raw[i]) for i in part])
            cells = np.full((len(part), width), -1, np.int64)
            cells[np.arange(width) < lengths[:, None]] = self.of_byte[
                np.frombuffer(b"".join(raw[i] for i in part), np.uint8)
            ]
            for i, ids in zip(part, self.merge_rows(cells), strict=True):
                self.cache[words[i]] = ids.astype(np.int32)
            start = end

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and the offset at which each text begins."""
        split = [self.words.findall(t) if t else [] for t in texts]
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        cache = self.cache
        new = {w for words in split for w in words if w not in cache}
        if new:
            self.learn(list(new))
        rows = [cache[w] for words in split for w in words]
        counts = np.fromiter((len(words) for words in split), np.int64, len(split))
        sizes = np.fromiter((len(r) for r in rows), np.int64, len(rows))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        offsets = ends[np.concatenate([[0], np.cumsum(counts)])]
        return (np.concatenate(rows) if rows else np.zeros(0, np.int32)), offsets


_encoders: dict[str, MatrixEncoder] = {}


def encoder(path: str) -> MatrixEncoder:
    """The encoder of a vocabulary file, loaded once per worker."""
    if path not in _encoders:
        _encoders[path] = MatrixEncoder(path)
    return _encoders[path]


def token_ids(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str = "byte_bpe_50k",
    directory: str = VOCABULARY_DIR,
) -> DataFrame:
    """(id_col, ids): the token ids of each row's text, without special tokens.

    Null and empty texts give an empty list. Every row gives one row (a repeated
    row is repeated; a null id stays null), other columns are ignored, and texts
    of any length are encoded whole.
    """
    path = os.path.join(directory, f"{vocabulary}.json")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = encoder(path)
        for batch in batches:
            ids, offsets = machine.encode(batch.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "ids"])

    plain = spread(documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    schema = T.StructType([T.StructField("id", plain.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return plain.mapInArrow(encode, schema).withColumnRenamed("id", id_col)


def token_counts(
    documents: DataFrame, keep: list[str], text_col: str = "text", *, vocabulary: str = "byte_bpe_50k",
    directory: str = VOCABULARY_DIR,
) -> DataFrame:
    """The columns ``keep`` of each row and ``n_tokens``, the number of its text's tokens (0 for null)."""
    path = os.path.join(directory, f"{vocabulary}.json")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = encoder(path)
        for batch in batches:
            _, offsets = machine.encode(batch.column(len(keep)).to_pylist())
            sizes = pa.array(np.diff(offsets), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], sizes], [*keep, "n_tokens"])

    plain = spread(documents.select(*keep, F.col(text_col).cast("string").alias("_text")))
    schema = T.StructType([*[plain.schema[c] for c in keep], T.StructField("n_tokens", T.LongType())])
    return plain.mapInArrow(count, schema)
