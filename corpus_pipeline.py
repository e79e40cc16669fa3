"""Corpus pipeline: quality, line dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps;
``run`` writes every stage's result as Parquet in the shared folder and reads
it again for the next one. All stages but the last return the columns of
``documents``.

- quality: trained on ``labels``; documents scored below the threshold go.
  Rows without id are scored and kept or dropped by the same rule.
- lines: repeated chunks of lines are cut out of the texts. A document of
  which no line is left goes, as all it held stands elsewhere; one that came
  in empty stays.
- near duplicates: the document with the least id of each group stays. Rows
  are judged one by one by their text: of equal rows of one id (ties) one
  stays, and of different texts of one id only those that are linked to an
  earlier one go. Rows without id stay.
- mix: a document appears as many times as the mix takes it.
- pack: one row per piece, see ``packing.pack``.

Texts are worked on whole, of any length; a stage's operator states in its
module how it splits long ones. Empty tables pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.line_dedup import dedup_lines
from packetloom.llm.mixing import mix_documents
from packetloom.llm.near_dedup import near_duplicates
from packetloom.llm.packing import pack
from packetloom.llm.quality import THRESHOLD, document_statistics, train, with_score
from packetloom.llm.support import shielded, stored
from packetloom.operators.telemetry import number_rows
from packetloom.session import ship_package

# Tokenizer ids and learnt scores are outside SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(stored(document_statistics(docs), "statistics"), labels)
    plain, names = shielded(docs)
    scored = with_score(plain, model, text=names["text"])
    return scored.filter(F.col("score") >= THRESHOLD).drop("score").toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    cleaned = dedup_lines(docs).filter("n_removed = 0 OR n_removed < n_lines")
    return cleaned.select(
        *[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    plain, names = shielded(docs)
    own = names["doc_id"]
    keyed = plain.withColumns({"_key": F.md5(names["text"]), "_number": F.col(own).cast("long")})
    repeated = keyed.filter(f"{own} IS NOT NULL").groupBy(own).agg(F.count("*").alias("n")).filter("n > 1").select(F.col(own).alias("_id"))
    if repeated.take(1):
        # Ids name rows no more: different texts are numbered in the order of their ids.
        rows = keyed.drop("_number").filter(f"{own} IS NOT NULL").dropDuplicates([own, "_key"])
        numbers = stored(number_rows(rows.select(F.col(own).alias("_id"), F.col("_key").alias("_text")), "_number", "_id", "_text"), "numbers")
        numbered = rows.join(numbers, (F.col(own) == F.col("_id")) & F.col("_key").eqNullSafe(F.col("_text"))).drop("_id", "_text")
        keyed = stored(numbered.unionByName(keyed.filter(f"{own} IS NULL")), "numbered-documents")
    gone = near_duplicates(keyed, doc_id="_number", text=names["text"]).filter("NOT kept").select(F.col("doc_id").alias("_gone"))
    return keyed.join(gone, F.col("_number") == F.col("_gone"), "left_anti").drop("_number", "_key").toDF(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("line_dedup", lines), ("near_dedup", near), ("mixing", mix), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
