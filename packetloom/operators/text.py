"""Detectors over text: secrets, code execution, personal data, concepts."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom import fixed_values as fv
from packetloom.functions.strings import contains_any, fixed2, labels_where
from packetloom.operators.detector import Columns, Detector, register
from packetloom.operators.telemetry import number_rows
from packetloom.session import SMALL_TABLE_ROWS, cut_lineage, rows_if_small

# Lengths of vectors below this count as this.
TINY = 1e-12
# Vectors that a task compares at once.
_AT_ONCE = 512


# --- secrets and remote code execution -----------------------------------
def _text_and_lower(input: Column) -> Columns:
    return {"text": input, "low": F.lower(input)}


def code_flags(text: Column, low: Column) -> Columns:
    """One flag per secret pattern and the flag ``rce``.

    Every regex runs only on rows that contain a literal part of it.
    """
    flags = {}
    for i, (_, guard, lowered, pattern) in enumerate(fv.SECRET_PATTERNS):
        test = contains_any(low, fv.GENERIC_SECRET_WORDS) if lowered else F.contains(text, F.lit(guard))
        flags[f"secret{i}"] = test & F.rlike(text, F.lit(pattern))
    return {**flags, "rce": contains_any(text, fv.RCE_MARKERS)}


def _code_score(rce: Column, **secrets: Column) -> Column:
    return F.when(reduce(or_, secrets.values()), fv.SECRET_SCORE).when(rce, fv.RCE_SCORE).otherwise(0.0)


def _code_findings(rce: Column, **secrets: Column) -> Column:
    names = [f"Secret Detected: {name}" for name, *_ in fv.SECRET_PATTERNS]
    return labels_where(*zip(secrets.values(), names), (rce, fv.RCE_FINDING))


code = register(Detector("code", _code_score, _code_findings, code_flags, _text_and_lower))


# --- personal data --------------------------------------------------------
def luhn_valid(digits: Column) -> Column:
    """Checksum of a digit string: every second digit from the right doubles."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: d.try_cast("int"))
    total = F.aggregate(
        F.transform(values, lambda d, i: F.when(i % 2 == 0, d).when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)),
        F.lit(0), lambda acc, d: acc + F.coalesce(d, F.lit(0)))
    return total % 10 == 0


def iban_valid(iban: Column) -> Column:
    """ISO 7064 mod 97-10 over the rearranged account number."""
    moved = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    remainder = F.aggregate(
        F.split(moved, ""), F.lit(0),
        lambda acc, char: F.when(char == "", acc).when(
            char.between("0", "9"), (acc * 10 + char.try_cast("int")) % 97
        ).otherwise((acc * 100 + F.ascii(char) - 55) % 97))
    return remainder == 1


def _text_and_digits(input: Column) -> Columns:
    """All numeric entities have two digits at most one separator apart."""
    return {"text": input, "digits": F.rlike(input, F.lit("[0-9][ -]?[0-9]"))}


def pii_spans(text: Column, digits: Column) -> Columns:
    """The valid spans of every entity, in text order."""
    def spans(entity: str, guard: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(fv.PII_PATTERNS[entity]), F.lit(0))
        return F.when(guard, found).otherwise(F.array().cast("array<string>"))

    return {
        "PHONE_NUMBER": spans("PHONE_NUMBER", digits),
        "EMAIL_ADDRESS": spans("EMAIL_ADDRESS", F.contains(text, F.lit("@"))),
        "IBAN": F.filter(spans("IBAN", digits), iban_valid),
        "CREDIT_CARD": F.filter(spans("CREDIT_CARD", digits), lambda span: luhn_valid(F.regexp_replace(span, "[^0-9]", ""))),
        "US_SSN": spans("US_SSN", digits & F.contains(text, F.lit("-"))),
    }


def _pii_score(**spans: Column) -> Column:
    return F.greatest(F.lit(0.0), *[
        F.when(F.size(spans[entity]) > 0, score).otherwise(0.0) for entity, score, _ in fv.PII_ENTITIES])


def _pii_findings(**spans: Column) -> Column:
    return F.concat(*[
        F.array_repeat(F.lit(f"PII Detected: {entity} ({shown})"), F.size(spans[entity]))
        for entity, _, shown in fv.PII_ENTITIES])


pattern = register(Detector("pattern", _pii_score, _pii_findings, pii_spans, _text_and_digits))


def pii_table(df: DataFrame, key: str, text: Column) -> DataFrame:
    """One row (key, entity, span) per span of personal data."""
    def rows(entity: str) -> Column:
        return F.transform(F.col(entity), lambda span: F.struct(F.lit(entity).alias("entity"), span.alias("span")))

    prepared = df.select(key, *[column.alias(name) for name, column in _text_and_digits(text).items()])
    spans = pii_spans(F.col("text"), F.col("digits"))
    found = prepared.select(key, *[column.alias(entity) for entity, column in spans.items()])
    return found.select(key, F.inline(F.concat(*[rows(entity) for entity in spans])))


# --- fixed context floor --------------------------------------------------
context = register(Detector(
    "context", lambda input: F.lit(fv.CONTEXT_SCORE), lambda input: F.array().cast("array<string>"),
    prepare=lambda input: {"input": F.lit(True)}))


# --- similarity to concept vectors ---------------------------------------
def best_concept(df: DataFrame, vector: str, concepts: DataFrame) -> DataFrame:
    """Add ``similarity`` and ``concept`` of the closest concept vector.

    ``concepts`` has columns (concept, vec). A list of phrases is multiplied
    with each Arrow batch as one matrix; a longer table in cells of numbered
    vectors and concepts, one plan for any number of them (not for streams).
    Ties go to the first concept by name. A zero vector has similarity 0; a
    null vector, or one of another length or with a null component, has none.
    """
    known = concepts.select("concept", "vec").filter("concept IS NOT NULL AND vec IS NOT NULL")
    rows = rows_if_small(known.orderBy("concept"))
    if rows is None:
        return _closest_by_cells(df, vector, known)
    found = df.withColumn("_found", _closest(rows)(vector))
    return found.select(*df.columns, F.col("_found.similarity").alias("similarity"), F.col("_found.concept").alias("concept"))


def _closest_by_cells(df: DataFrame, vector: str, known: DataFrame) -> DataFrame:
    """The closest concepts where there are too many for one matrix.

    Equal vectors are worked on once. Vectors and concepts are numbered and
    dealt evenly into parts of at most ``SMALL_TABLE_ROWS``; each part of vectors
    meets each part of concepts in a task, which leaves one row per vector.
    """
    named = cut_lineage(number_rows(known.filter("NOT exists(vec, x -> x IS NULL)"), "_c", "concept", "vec"))
    asked = df.select(F.col(vector).cast("array<double>").alias("_v")).filter("_v IS NOT NULL AND NOT exists(_v, x -> x IS NULL)").distinct()
    asked = cut_lineage(number_rows(asked, "_n", "_v"))
    parts, blocks = [-(-d.count() // SMALL_TABLE_ROWS) or 1 for d in (asked, named)]
    zero = F.lit(0).cast("long")
    left = asked.select("_n", F.col("_v").alias("_vec"), F.size("_v").alias("_width"), F.pmod("_n", F.lit(parts)).alias("_part"),
                        F.explode(F.sequence(zero, F.lit(blocks - 1).cast("long"))).alias("_block"))
    right = named.select("_c", F.col("vec").cast("array<double>").alias("_vec"), F.size("vec").alias("_width"),
                         F.pmod("_c", F.lit(blocks)).alias("_block"),
                         F.explode(F.sequence(zero, F.lit(parts - 1).cast("long"))).alias("_part"))
    cell = ("_width", "_part", "_block")
    near = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_closest_in_cell, "_n long, similarity double, _c long")
    # The smaller number is the first by name.
    best = near.groupBy("_n").agg(F.max(F.struct("similarity", (-F.col("_c")).alias("_less"))).alias("_best"))
    found = best.select("_n", F.col("_best.similarity").alias("similarity"), (-F.col("_best._less")).alias("_c")) \
        .join(named.select("_c", "concept"), "_c").join(asked, "_n").select(F.col("_v").alias("_key"), "similarity", "concept")
    return df.join(found, F.col(vector).cast("array<double>") == F.col("_key"), "left").select(*[df[c] for c in df.columns], "similarity", "concept")


def _closest_in_cell(vectors: pa.Table, concepts: pa.Table) -> pa.Table:
    def matrix(table: pa.Table) -> np.ndarray:
        column = table.column("_vec").combine_chunks()
        out = column.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), TINY)

    numbers, order = vectors.column("_n"), np.argsort(concepts.column("_c").to_numpy())
    if not len(vectors) or not len(concepts):
        return pa.table({"_n": numbers[:0], "similarity": pa.array([], pa.float64()), "_c": pa.array([], pa.int64())})
    known, asked = matrix(concepts)[order], matrix(vectors)
    at, similarity = np.zeros(len(asked), np.int64), np.zeros(len(asked))
    for start in range(0, len(asked), _AT_ONCE):
        cosine = asked[start:start + _AT_ONCE] @ known.T
        part = slice(start, start + len(cosine))
        at[part] = cosine.argmax(axis=1)
        similarity[part] = cosine[np.arange(len(cosine)), at[part]]
    return pa.table({"_n": numbers, "similarity": similarity, "_c": concepts.column("_c").to_numpy()[order][at]})


def _closest(rows: list):
    """Arrow function: the closest of some concepts."""
    names = [row["concept"] for row in rows]
    width = len(rows[0]["vec"]) if rows else 0
    matrix = np.array([row["vec"] for row in rows], dtype=np.float64).reshape(len(rows), width)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), TINY)

    @F.arrow_udf("struct<similarity: double, concept: string>")
    def closest(vectors: pa.Array) -> pa.Array:
        usable = [i for i, v in enumerate(vectors.to_pylist()) if names and v is not None and len(v) == width and None not in v]
        batch = vectors.take(pa.array(usable, pa.int64())).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(usable), width)
        cosine = (batch @ matrix.T) / np.maximum(np.linalg.norm(batch, axis=1, keepdims=True), TINY)
        best = cosine.argmax(axis=1) if usable else np.zeros(0, np.int64)
        similarity, concept = [None] * len(vectors), [None] * len(vectors)
        for i, at, row in zip(usable, best.tolist(), cosine):
            similarity[i], concept[i] = float(row[at]), names[at]
        return pa.StructArray.from_arrays([pa.array(similarity, pa.float64()), pa.array(concept, pa.string())],
                                          names=["similarity", "concept"])

    return closest


def _nlp_score(similarity: Column, concept: Column) -> Column:
    (high, high_score), (low, low_score) = fv.SEMANTIC_HIGH, fv.SEMANTIC_LOW
    return F.when(similarity > high, high_score).when(similarity > low, low_score).otherwise(0.0)


def _nlp_findings(similarity: Column, concept: Column) -> Column:
    shown = fixed2(similarity)
    return F.when(similarity > fv.SEMANTIC_HIGH[0], F.array(F.concat(
        F.lit("Semantic Threat Detected: '"), concept, F.lit("' (Confidence: "), shown, F.lit(")")))) \
        .when(similarity > fv.SEMANTIC_LOW[0], F.array(F.concat(F.lit("Potential Semantic Risk ("), shown, F.lit(")")))) \
        .otherwise(F.array().cast("array<string>"))


# Inputs: similarity and concept of the closest concept vector.
nlp = register(Detector("nlp", _nlp_score, _nlp_findings))


# --- redaction ------------------------------------------------------------
def redact(text: Column) -> Column:
    """Replace secrets and personal data by the name of what was found.

    Spans are replaced by shape only; checksums are not needed to mask them.
    """
    for name, _, _, regex in fv.SECRET_PATTERNS:
        text = F.regexp_replace(text, regex, f"<{name.upper().replace(' ', '_')}>")
    for entity in ("EMAIL_ADDRESS", "IBAN", "CREDIT_CARD", "US_SSN", "PHONE_NUMBER"):
        text = F.regexp_replace(text, fv.PII_PATTERNS[entity], f"<{entity}>")
    return text
