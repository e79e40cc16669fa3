"""Word shingles as sorted sets of 64-bit hashes, and b-bit MinHash signatures of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from packetloom.llm.support import WordTable, mix, text_slices

WORDS = 5
HASHES = 160
# Minima per band; with 8 bits kept of each, a band's value has 32 bits.
ROWS = 4
BANDS = HASHES // ROWS
_BASE = np.uint64(0x9FB21C651E98DF25)
_BLOCK = 512


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Distinct shingles of each text; a shorter text is one shingle, one without words has none."""
    table = WordTable(texts, lower=True)
    counts, ids = np.diff(table.first).tolist(), table.hashes()
    rolled = np.zeros(max(0, len(ids) - words + 1), np.uint64)
    for i in range(words):
        rolled = rolled * _BASE + ids[i:i + len(rolled)]
    rolled = mix(rolled)
    start = 0
    for n in counts:
        if n >= words:
            yield np.unique(rolled[start:start + n - words + 1])
        elif n:
            short = np.full(1, n, np.uint64)
            for value in ids[start:start + n]:
                short = short * _BASE + value
            yield mix(short)
        else:
            yield np.zeros(0, np.uint64)
        start += n


def permutations(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    draw = lambda: random.integers(0, 1 << 32, HASHES, dtype=np.uint32)
    return draw(), draw() | np.uint32(1)


def signature(shingles: np.ndarray, xors: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Low 8 bits of the least value under each hash function, packed by band."""
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(values), _BLOCK):
        hashed = (values[at:at + _BLOCK, None] ^ xors) * factors
        hashed ^= hashed >> np.uint32(15)
        np.minimum(least, hashed.min(axis=0), out=least)
    return (least & np.uint32(0xFF)).astype(np.uint8).view("<i4")


SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("signature", pa.list_(pa.int32()))])
SIGNED_DDL = "doc_id long, n_shingles long, set_key binary, signature array<int>"


def signed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: size, digest and signature of every document's shingle set."""
    from xxhash import xxh3_128_digest
    xors, factors = permutations()
    for batch in text_slices(batches):
        sizes, keys, signatures = [], [], []
        for shingles in shingle_sets(batch.column(1)):
            sizes.append(len(shingles))
            keys.append(xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
            signatures.append(signature(shingles, xors, factors) if len(shingles) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                                          pa.array(signatures, pa.list_(pa.int32()))], schema=SIGNED)


def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: the whole shingle set of every document, as bytes."""
    for batch in text_slices(batches):
        sets = [s.tobytes() for s in shingle_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])
