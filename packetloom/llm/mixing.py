"""Mixing sources to target weights by systematic sampling.

Sizes are word counts. The sources, in code point order with null last, take
the weights in turn; a source's target is its share of all words, but never
more than ``cap`` times its own size, and what is cut off goes to the other
sources by weight until none is above. A document is then taken as often as a
grid of step one, moved by one random offset, falls into its stretch of the
running sum of expected copies of its source. Documents are laid out by size,
so every size is sampled evenly and the words taken stay within about one
document of the target.

Defined cases: a null text has size 0; null is a source of its own; a source
without words has target 0 and is not taken; repeated rows are rows of their
own; an empty table gives an empty plan. Only the four named columns are read,
so other columns and their names do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetloom.llm.support import hex_number, shielded, word_count
from packetloom.operators.telemetry import number_rows
from packetloom.session import SMALL_TABLE_ROWS, cut_lineage

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix"
OFFSET_STEPS = 1 << 20


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: source, source_size, source_docs, weight, target.

    Each pass over this small table fixes the sources that reach their cap at
    the current level; the level only rises, so it ends when none is added.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    ranked = number_rows(totals, "_rank", F.col("source").asc_nulls_last())
    choice = F.array(*map(F.lit, weights))
    ranked = cut_lineage(ranked.withColumn("weight", F.get(choice, ((F.col("_rank") - 1) % len(weights)).cast("int"))))
    limit = F.col("source_size") * cap
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * level > limit
        fixed, free, count = ranked.agg(
            F.coalesce(F.sum(F.when(above, limit)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
            F.count_if(above)).first()
        if count == capped or not free:
            break
        level, capped = (total - fixed) / free, count
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), limit.cast("double"))).drop("_rank")


def mixing_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED,
                doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies: a row per document."""
    sizes = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                        word_count(F.col(text)).alias("size"))
    placed = number_rows(sizes, "_n", F.col("source").asc_nulls_last(), "size", "doc_id")
    targets = source_targets(placed, weights, cap).withColumnRenamed("source", "_source")
    starts = placed.groupBy("source").agg(F.min("_n").alias("_first")).withColumnRenamed("source", "_start_source")
    targets = targets.join(starts, F.col("_source").eqNullSafe(F.col("_start_source"))).select(
        "_source", "source_size", "target", "_first")
    if targets.limit(SMALL_TABLE_ROWS + 1).count() <= SMALL_TABLE_ROWS:
        targets = F.broadcast(targets)  # else a join that adaptive execution can split
    rank = F.col("_n") - F.col("_first") + 1
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # The offset is a multiple of 2^-20: a whole rate then gives whole steps.
    offset = hex_number(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit("")))), 1, 5) / F.lit(float(OFFSET_STEPS))
    grid = lambda k: F.floor(offset + k * rate)
    copies = F.least(grid(rank) - grid(rank - 1), F.ceil(rate))
    return placed.join(targets, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: each row as many times as it is taken.

    Rows of one doc_id, source and size are told apart by their number.
    """
    same = ["doc_id", "source", "size"]
    columns = {"doc_id": "doc_id", "text": "text", "source": "source"}
    columns |= {k: options[k] for k in columns if k in options}
    plain, names = shielded(docs)
    doc_id, text, source = (F.col(names[columns[k]]) for k in ("doc_id", "text", "source"))
    left = plain.withColumns({"doc_id": doc_id, "source": source, "size": word_count(text)})
    left = left.withColumn("nth", F.row_number().over(W.partitionBy(*same).orderBy(text)))
    plan = mixing_plan(docs, **options).withColumn("nth", F.row_number().over(W.partitionBy(*same).orderBy(F.desc("copies"))))
    plan = plan.select(*[F.col(c).alias(f"plan_{c}") for c in [*same, "nth"]], "copies").filter("copies > 0")
    match = F.lit(True)
    for c in [*same, "nth"]:
        match = match & F.col(c).eqNullSafe(F.col(f"plan_{c}"))
    copied = left.join(plan, match).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copied.select(*names.values()).toDF(*docs.columns)
