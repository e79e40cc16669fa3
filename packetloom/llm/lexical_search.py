"""Ranked lexical search of many queries at once by shared partial sums.

A query's score of a document is a sum over its terms, so queries with terms
in common have partial sums in common. The queries (items) of a block are
written as sets of leaves, a leaf being a term and how often the query repeats
it. Leaves that stand in the same queries are merged first; then, round by
round, pairs of neighbours in the order of how many queries hold them, of
which each becomes a node of its own where two or more queries share it. The
nodes form a graph in which every shared set is summed once per document and
the queries add up what is left of their sets. All sums are whole numbers, so
the order of summing does not matter.

Documents pass twice: a first pass over the texts keeps, of every document,
its number of terms and the counts of the terms that queries use (stored
as Parquet); the second one evaluates the graph on blocks of documents and
keeps each task's best documents of every query. Between them the corpus
statistics are summed by Spark. Queries go in blocks of up to ``BLOCK_TERMS``
distinct terms (a longer one alone), which are broadcast; documents never
pass through the driver. A word is known by a 64-bit hash.

Defined cases: null and empty texts have no terms, are in no statistics and
are never ranked; rows without doc_id are in the statistics but not ranked;
rows repeated under one doc_id each count and are each ranked; of rows with
one item_id the least text is the query, rows without item_id are none;
a query without terms found has no rows; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetloom.llm.decontamination import LOWER, RAW_WORD, UPPER
from packetloom.llm.support import WordTable, empty_like, stored, text_slices
from packetloom.operators.telemetry import number_rows
from packetloom.session import scratch_path

K = 10
# Terms, each with the queries it is in, of a block of queries.
BLOCK_TERMS = 100_000
ROUNDS = 24
# Partial sums that a task holds at a time.
SUMS = 4 << 20
RESULT = "item_id long, rank int, doc_id long, score long"
POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"

# Bytes that part terms: ASCII without letters and digits.
_BREAKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def query_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, term, times of every query."""
    texts = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).filter(
        "item_id IS NOT NULL AND text IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text"))
    terms = texts.select("item_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RAW_WORD), F.lit(0))).alias("term"))
    return terms.groupBy("item_id", "term").agg(F.count("*").alias("times"))


def _adjacent(rows: np.ndarray, nodes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) entries with the nodes of a row in order of falling weight."""
    order = np.lexsort((nodes, -weight[nodes], rows))
    return rows[order], nodes[order]


class SharedSums:
    """How the queries of a block are summed from leaves.

    ``rounds`` holds the pairs of earlier nodes that make the new nodes of each
    round; ``starts`` and ``nodes`` the nodes that make each query.
    """

    def __init__(self, rows: np.ndarray, leaves: np.ndarray, count: int, n_leaves: int) -> None:
        self.rounds: list[tuple[np.ndarray, np.ndarray]] = []
        size = n_leaves
        for number in range(ROUNDS):
            weight = np.bincount(leaves, minlength=size)
            if number == 0:
                # Leaves of exactly the same queries come next to each other.
                mark = np.zeros(size, np.uint64)
                np.add.at(mark, leaves, np.random.default_rng(11).integers(0, 1 << 63, count, np.uint64)[rows])
                weight = weight.astype(np.float64) + mark.astype(np.float64) / 2.0 ** 65
            rows, leaves = _adjacent(rows, leaves, weight)
            same = rows[1:] == rows[:-1]
            pairs, where, times = np.unique(np.stack([leaves[:-1][same], leaves[1:][same]]), axis=1,
                                            return_inverse=True, return_counts=True)
            # Most shared pairs first; a node is in one pair a round.
            taken, chosen = np.zeros(size, bool), np.full(pairs.shape[1], -1, np.int64)
            left, right = [], []
            for i in np.lexsort((np.arange(len(times)), -times)).tolist():
                a, b = pairs[0, i], pairs[1, i]
                if times[i] < 2:
                    break
                if not (taken[a] or taken[b]):
                    taken[a] = taken[b] = True
                    chosen[i] = size + len(left)
                    left.append(a)
                    right.append(b)
            if not left:
                break
            self.rounds.append((np.array(left, np.int64), np.array(right, np.int64)))
            at = np.nonzero(same)[0]
            new = chosen[where.ravel()]
            leaves = leaves.copy()
            leaves[at[new >= 0]] = new[new >= 0]
            keep = np.ones(len(rows), bool)
            keep[at[new >= 0] + 1] = False
            rows, leaves = rows[keep], leaves[keep]
            size += len(left)
        self.size = size
        self.starts = np.searchsorted(rows, np.arange(count))
        self.nodes = leaves

    def scores(self, leaves: np.ndarray) -> np.ndarray:
        """Scores (query, document) from the values (leaf, document)."""
        sums = np.zeros((self.size, leaves.shape[1]), np.int64)
        done = len(leaves)
        sums[:done] = leaves
        for left, right in self.rounds:
            np.add(sums[left], sums[right], out=sums[done:done + len(left)])
            done += len(left)
        return np.add.reduceat(sums[self.nodes], self.starts, axis=0)


class _Block:
    """Queries of a block: their terms, sets and, later, weights."""

    def __init__(self, rows: pa.Table) -> None:
        self.items, row = np.unique(rows.column("item_id").to_numpy(), return_inverse=True)
        words = rows.column("term").combine_chunks()
        hashes = WordTable(words, breaks=_BREAKS).hashes()  # a term is one word
        self.hashes, term = np.unique(hashes, return_inverse=True)
        leaves, leaf = np.unique(np.stack([term, rows.column("times").to_numpy()]), axis=1, return_inverse=True)
        self.leaf_term, self.leaf_times = leaves
        self.shared = SharedSums(row, leaf.ravel(), len(self.items), leaves.shape[1])

    def postings(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Task: number of terms of every text, and the counts of those that queries use."""
        size = len(self.hashes)
        for batch in text_slices(batches):
            table = WordTable(batch.column(1), lower=True, breaks=_BREAKS)
            n = np.diff(table.first)
            hashes = table.hashes()
            place = np.minimum(np.searchsorted(self.hashes, hashes), size - 1)
            hit = np.nonzero(self.hashes[place] == hashes)[0]
            key, counts = np.unique(np.repeat(np.arange(len(n)), n)[hit] * size + place[hit], return_counts=True)
            offsets = pa.array(np.searchsorted(key, np.arange(len(n) + 1) * size).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n), pa.ListArray.from_arrays(offsets, pa.array((key % size).astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32)))], names=["doc_id", "n", "terms", "counts"])

    def best(self, batches: Iterator[pa.RecordBatch], weights: np.ndarray, total: int, length: int, k: int) -> Iterator[pa.RecordBatch]:
        """Task: its k best documents of every query."""
        step = max(1, SUMS // (self.shared.size + len(self.shared.nodes)))
        queries = len(self.items)
        q, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = np.ones(queries, np.int64)  # a score below it is not among the best
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                found = self.shared.scores(self._values(part, weights, total, length))
                doc_ids = part.column(0).to_numpy()
                rows, columns = np.nonzero(found >= least[:, None])
                if not len(rows):
                    continue
                q, ids = np.concatenate([q, rows]), np.concatenate([ids, doc_ids[columns]])
                scores = np.concatenate([scores, found[rows, columns]])
                order = np.lexsort((ids, -scores, q))
                nth = np.arange(len(order)) - np.searchsorted(q[order], q[order])
                kept = order[nth < k]
                q, ids, scores, nth = q[kept], ids[kept], scores[kept], nth[nth < k]
                last = nth == k - 1
                least[q[last]] = scores[last]
        yield pa.RecordBatch.from_arrays([pa.array(self.items[q]), pa.array(ids), pa.array(scores)],
                                         names=["item_id", "doc_id", "score"])

    def _values(self, part: pa.RecordBatch, weights: np.ndarray, total: int, length: int) -> np.ndarray:
        """What every leaf adds to the score of every document."""
        n = part.column(1).to_numpy()
        if 75 * total * int(n.max(initial=0)) < 1 << 63:
            m = 25 + (75 * total * n) // length
        else:
            m = np.array([25 + (75 * total * int(x)) // length for x in n], np.int64)
        lists = part.column(2)
        sizes = np.diff(lists.offsets.to_numpy())
        document = np.repeat(np.arange(part.num_rows), sizes)
        term, tf = lists.flatten().to_numpy(), part.column(3).flatten().to_numpy().astype(np.int64)
        values = np.zeros((len(weights), part.num_rows), np.int64)
        values[term, document] = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[document]))
        return values[self.leaf_term] * self.leaf_times[:, None]


def _weights(postings: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """Weight of every term of a block, number of documents with terms, and number of all their terms."""
    total, length = postings.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
    holding = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()
    weights = np.zeros(terms, np.int64)
    for row in holding:
        weights[row.term] = math.floor(1000 * math.log((2 * total + 2) / (2 * row.df + 1)))
    return weights, total, length or 0


def _search_block(spark: SparkSession, body: DataFrame, block: _Block, k: int) -> DataFrame | None:
    queries = spark.sparkContext.broadcast(block)

    def listed(batches):
        yield from queries.value.postings(batches)

    postings = stored(body.mapInArrow(listed, POSTINGS), "postings")
    weights, total, length = _weights(postings, len(block.hashes))
    if not total:
        return None
    known = spark.sparkContext.broadcast(weights)

    def ranked(batches):
        yield from queries.value.best(batches, known.value, total, length, k)

    found = postings.filter("doc_id IS NOT NULL AND size(terms) > 0").mapInArrow(ranked, "item_id long, doc_id long, score long")
    order = W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "item_id", F.col("rank").cast("int"), "doc_id", "score")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS, doc_id: str = "doc_id",
                   text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of every item."""
    spark = docs.sparkSession
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    terms = stored(query_terms(items, item_id, item_text), "query-terms")
    # Blocks by running numbers of terms: a query belongs to the block its first term falls into.
    sizes = number_rows(terms.select("item_id"), "nth", "item_id").groupBy("item_id").agg(F.min("nth").alias("nth"))
    placed = stored(terms.join(sizes.select("item_id", F.floor((F.col("nth") - 1) / block_terms).alias("block")), "item_id"), "query-blocks")
    blocks = [r.block for r in placed.select("block").distinct().orderBy("block").collect()]
    path, parts = scratch_path(spark, "lexical-search"), 0
    for number in blocks:
        part = _search_block(spark, body, _Block(placed.filter(F.col("block") == number).drop("block").toArrow()), k)
        if part is None:
            break
        if len(blocks) == 1:
            return part
        part.write.mode("append").parquet(path)
        parts += 1
    return spark.read.schema(RESULT).parquet(path) if parts else empty_like(docs, RESULT)
