"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from packetloom.session import scratch_path

# Words are runs of anything but space and the control characters 9 to 13.
# bytes.split() cuts at exactly these six bytes.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
SLICE_BYTES = 4 << 20
HOT_SHARE = 10_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def hex_number(digest: Column, start: int, digits: int) -> Column:
    """``digits`` hexadecimal digits (at most 15) of a digest as a long."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def text_slices(batches: Iterator[pa.RecordBatch], column: int = 1,
                limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice hold about ``limit`` bytes.

    Work arrays are sized by the slice, so memory does not depend on the batch
    size; a longer text is a slice of its own.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8; null as empty."""
    return [text or b"" for text in column.cast(pa.binary()).to_pylist()]


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that all bits depend on all bits."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_PIECE_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_LONG_WORD = 256


class WordTable:
    """The words of a column of texts, by numpy: places in the bytes, counts per text, hashes."""

    def __init__(self, column: pa.Array | pa.ChunkedArray, lower: bool = False, breaks: np.ndarray = _BLANK) -> None:
        """``breaks`` tells of each byte whether it parts words."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        if len(column) == 0 or column.buffers()[2] is None:
            offsets, data = np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
        else:
            data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        size = len(data)
        self.bytes = np.zeros(size + 8, np.uint8)  # room for reading 8 bytes from any place
        self.bytes[:size] = LOWER[data] if lower else data
        blank = np.ones(size + 2, bool)
        blank[1:-1] = breaks[data]
        edge = np.zeros(size + 1, bool)
        edge[offsets] = True  # texts part words, too
        inside = self._inside = ~blank[1:-1]
        self.starts = np.nonzero(inside & (blank[:-2] | edge[:-1]))[0]
        self.ends = np.nonzero(inside & (blank[2:] | edge[1:]))[0] + 1
        # Text i has the words first[i] to first[i + 1].
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        lengths = self.ends - self.starts
        view = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, strides=(1,))
        out = mix(lengths.astype(np.uint64))
        at, start, left = np.arange(len(lengths)), self.starts, lengths
        for place in range(0, _LONG_WORD, 8):
            piece = view[start + place] & _PIECE_MASKS[np.minimum(left, 8)]
            out[at] = mix(out[at] ^ piece) * np.uint64(0xD6E8FEB86659FD93)
            rest = np.nonzero(left > 8)[0]
            if not len(rest):
                break
            at, start, left = at[rest], start[rest], left[rest] - 8
        for i in np.nonzero(lengths > _LONG_WORD)[0]:
            out[i] = xxh3_64_intdigest(self.bytes[self.starts[i]:self.ends[i]])
        return out

    def joined(self) -> tuple[memoryview, np.ndarray, np.ndarray]:
        """All words with one space behind each, and where each word starts and ends there."""
        lengths = self.ends - self.starts
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
        inside = np.ones(len(out), bool)
        inside[ends] = False
        out[inside] = self.bytes[:-8][self._inside]
        return memoryview(out), starts, ends


def byte_digests(view: memoryview, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit digests of stretches of bytes, as two 64-bit numbers each."""
    found = [xxh3_128_digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)


def join_counted(rows: DataFrame, keys: DataFrame, on: str, count: str = "n") -> DataFrame:
    """``rows`` joined with ``keys``, one row per value of ``on`` with its number of rows.

    Values that hold more than one in ``HOT_SHARE`` of all rows, of which
    there are fewer than ``HOT_SHARE``, are broadcast; the rest is joined by
    a shuffle in which no value weighs much. Read both sides from storage.
    """
    limit = rows.count() // HOT_SHARE
    hot = F.broadcast(keys.filter(F.col(count) > limit).drop(count))
    cold = rows.join(hot.select(on), on, "left_anti")
    return rows.join(hot, on).unionByName(cold.join(keys.filter(F.col(count) <= limit).drop(count), on))


def shielded(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with neutral column names, and the neutral name of each column.

    An operator that adds columns of its own works on these, so that columns
    of any name may come along.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def empty_like(df: DataFrame, schema: str) -> DataFrame:
    """A table of the given schema without rows."""
    return df.sparkSession.createDataFrame([], schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Cuts the lineage as a checkpoint does, in a tenth of the space for wide or
    repetitive rows. Shuffle files of the write go when it has ended.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
