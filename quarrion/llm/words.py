"""Hashes of words and of sequences of words, and compressed texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

from quarrion.llm.arrow import slices, texts

_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MULTIPLIERS[0]
    x ^= x >> np.uint64(29)
    return x


def doubled(h: np.ndarray, length: int, times: int) -> np.ndarray:
    """Hashes of grams of length * 2**times from the hashes of grams of the given length."""
    for _ in range(times):
        if len(h) <= length:
            return h[:0]
        h = _mixed(h[:-length] * _MULTIPLIERS[1] + h[length:])
        length *= 2
    return h


class WordHashes(dict):
    """Hash of each word, kept for the words seen lately."""

    MOST = 50_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.MOST:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in slices(batches):
        yield pa.record_batch([batch.column("doc_id"), batch.column("h"), pa.array(map(pack, texts(batch.column("text"))), pa.binary())], ["doc_id", "h", "z"])


def unpacked(column: pa.Array) -> list[bytes]:
    return list(map(zstandard.ZstdDecompressor().decompress, column.to_pylist()))
