"""Exact top-k search by distributed histogram selection.

Every query is scored against every vector. Scores are located digit by digit:
each task counts its scores by the next eight bits within the range known to
hold a query's k-th best score, the counts are added up, and the range shrinks
until the k-th score is exact. A last pass keeps what is above it, and ties in
order of their ids. A task reports its counts from the top down only until
they reach what a query still needs; lower scores of that task cannot be among
the k best, so this loses nothing and bounds what is shuffled, whatever number
of equal vectors a task holds. Queries go in blocks of ``block`` rows, each
broadcast; a block is the only thing that passes through the driver.

Defined cases: vectors that are null, without id, or hold a null or non-finite
component take no part; a shorter vector counts as padded with zeros; of
several queries with one id the least vector is used; a query meets no row of
its own id; rows repeated under one id each count; with fewer than k
candidates all are returned; scores outside 64 bits are returned as the
nearest 64-bit number, after exact ordering. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetloom.llm.support import empty_like
from packetloom.operators.telemetry import number_rows
from packetloom.session import scratch_path

K = 10
SCALE = 1024
QUERY_BLOCK = 1024
DIGIT = 8
CHUNK = 512
RESULT = "query_id long, rank int, vec_id long, score long"


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and vector of the rows that take part."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * SCALE < float("inf")))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)


def _matrix(column: pa.Array, width: int, scale: int, exact: bool) -> np.ndarray:
    """Whole-number components, padded to ``width``; Python integers if 53 bits do not hold the scores."""
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False))
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    columns = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.zeros((len(lengths), width), object if exact else np.float64)
    out[rows, columns] = np.array([int(x) for x in flat], object) if exact else flat
    return out


class _Block:
    """A block of queries, as tasks need it."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, scale: int, exact: bool, base: int) -> None:
        self.ids, self.matrix, self.scale, self.exact, self.base = ids, matrix, scale, exact, base

    def scores(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids of some vectors, their scores (plus ``base``, so never negative), and which may count."""
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                ids = part.column(0).to_numpy()
                vectors = _matrix(part.column(1), self.matrix.shape[1], self.scale, self.exact)
                found = self.matrix @ vectors.T
                found = found + self.base if self.exact else found.astype(np.int64) + self.base
                yield ids, found, self.ids[:, None] != ids[None, :]


def _count(block, shift, prefix, need, active):
    """Task: counts by the next digit, from the top until a query's need is met."""
    def run(batches):
        counts = np.zeros(len(block.ids) << DIGIT, np.int64)
        for _, found, allowed in block.scores(batches):
            digit = found >> shift
            rows, columns = np.nonzero(((digit >> DIGIT) == prefix[:, None]).astype(bool) & allowed & active[:, None])
            if len(rows):
                low = (digit[rows, columns] & ((1 << DIGIT) - 1)).astype(np.int64)
                counts += np.bincount(rows << DIGIT | low, minlength=len(counts))
        counts = counts.reshape(-1, 1 << DIGIT)
        above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
        rows, digits = np.nonzero((counts > 0) & (above < need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(digits), pa.array(counts[rows, digits]),
                                          pa.array(need[rows])], names=["q", "digit", "n", "need"])
    return run


def _best(q, ids, scores, k):
    """Positions of the k best of each query: high scores, then small ids."""
    order = np.lexsort((ids, -scores, q)) if scores.dtype != object else np.array(
        sorted(range(len(q)), key=lambda i: (q[i], -scores[i], ids[i])), np.int64)
    sorted_q = q[order]
    nth = np.arange(len(order)) - np.searchsorted(sorted_q, sorted_q)
    return order[nth < k]


def _keep(block, threshold, k):
    """Task: its k best rows of each query at or above the threshold."""
    def run(batches):
        q, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object if block.exact else np.int64)
        for vec_ids, found, allowed in block.scores(batches):
            rows, columns = np.nonzero((found >= threshold[:, None]).astype(bool) & allowed)
            q, ids = np.concatenate([q, rows]), np.concatenate([ids, vec_ids[columns]])
            scores = np.concatenate([scores, found[rows, columns]])
            if len(q):
                best = _best(q, ids, scores, k)
                q, ids, scores = q[best], ids[best], scores[best]
        # The place within the task's list orders scores beyond 64 bits.
        limit = (1 << 63) - 1
        out = [max(-limit - 1, min(limit, int(s) - block.base)) for s in scores]
        high = [str(int(s)).zfill(100) for s in scores] if block.exact else [None] * len(q)
        yield pa.RecordBatch.from_arrays([pa.array(block.ids[q]), pa.array(ids), pa.array(out, pa.int64()),
                                          pa.array(high, pa.string())], names=["query_id", "vec_id", "score", "high"])
    return run


def _search_block(spark, candidates, block, bits, k):
    count = len(block.ids)
    kind = object if block.exact else np.int64
    prefix, need, active = np.zeros(count, kind), np.full(count, k, np.int64), np.ones(count, bool)
    shift = bits
    while shift > 0 and active.any():
        shift -= DIGIT
        state = spark.sparkContext.broadcast((block, prefix, need, active))

        def run(batches, state=state, shift=shift):
            block, prefix, need, active = state.value
            yield from _count(block, shift, prefix, need, active)(batches)

        counts = candidates.mapInArrow(run, "q long, digit long, n long, need long").groupBy("q", "digit").agg(
            F.sum("n").alias("n"), F.max("need").alias("need"))
        upto = F.sum("n").over(W.partitionBy("q").orderBy(F.desc("digit")))
        found = counts.withColumn("upto", upto).filter("upto >= need AND upto - n < need").select(
            "q", "digit", (F.col("upto") - F.col("n")).alias("above")).collect()
        reached = np.zeros(count, bool)
        prefix = prefix.copy()
        for row in found:
            reached[row.q] = True
            prefix[row.q] = (prefix[row.q] << DIGIT) | row.digit
            need[row.q] -= row.above
        active = active & reached  # a query with fewer than k candidates takes them all
    threshold = np.where(active, prefix, 0) if kind is np.int64 else np.array(
        [p if a else 0 for p, a in zip(prefix, active, strict=True)], object)
    state = spark.sparkContext.broadcast((block, threshold))

    def run(batches):
        block, threshold = state.value
        yield from _keep(block, threshold, k)(batches)

    kept = candidates.mapInArrow(run, "query_id long, vec_id long, score long, high string")
    order = W.partitionBy("query_id").orderBy(F.desc("high"), F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int"), "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, block: int = QUERY_BLOCK,
          vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best vectors of every query."""
    spark = vectors.sparkSession
    candidates = usable(vectors, vec_id, vector)
    asked = usable(queries, vec_id, vector).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = number_rows(asked, "_n", "vec_id")
    width, size = candidates.agg(F.max(F.size("v")), F.max(F.array_max(F.transform(
        "v", lambda x: F.abs(x * scale) + 1)))).first()
    total = asked.count()
    if not total or width is None:
        return empty_like(vectors, RESULT)
    reach = int(size or 0) + 1
    path = scratch_path(spark, "top-k")
    for start in range(0, total, block):
        rows = asked.filter((F.col("_n") > start) & (F.col("_n") <= start + block)).select("vec_id", "v").toArrow()
        widest = max(width, int(pc.max(pc.list_value_length(rows.column("v"))).as_py() or 0))
        values = [abs(x) for v in rows.column("v").to_pylist() for x in v]
        base = max(widest, 1) * reach * (int(max(values, default=0) * scale) + 2)
        exact = 4 * base >= 1 << 53
        matrix = _matrix(rows.column("v").combine_chunks(), widest, scale, exact)
        bits = -(-(2 * base).bit_length() // DIGIT) * DIGIT
        part = _search_block(spark, candidates, _Block(rows.column("vec_id").to_numpy(), matrix, scale, exact, base), bits, k)
        if total <= block:
            return part
        part.write.mode("append").parquet(path)
    return spark.read.parquet(path)
