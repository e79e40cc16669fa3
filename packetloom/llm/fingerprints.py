"""Merkle fingerprints of documents; DataFrame functions only.

A tree has short digests of ``GRAIN`` characters within sentences as leaves,
the paragraphs (lines) of a text above them, then sections and the root.
Sections are runs of paragraphs that end where a paragraph's own digest says
so, which keeps them in place when paragraphs are added elsewhere. A section's
digest is made of its paragraphs and the root of the sections' digests, so
equal roots mean equal texts, and differing branches lead to the edited
paragraphs. A fingerprint is the tree written out:
``root/section=paragraph:grains,...;...``, grains of 8 digits each. The
likeness of two fingerprints is the share of distinct grains in common, out
of the larger side, and can be taken from the two strings alone.

Defined cases: a null text is an empty one, of one empty paragraph; equal
texts have likeness 1; a text of empty paragraphs only has no grains and
likeness 0 to any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetloom.operators.telemetry import number_rows

GRAIN = 24
# One paragraph in so many ends a section (by the first digit of its digest).
SECTION_ENDS = "0123"
_SHORT = 12


def _grains(text: Column) -> Column:
    """For every paragraph its grains."""
    return F.transform(F.split(text, "\n", -1), lambda p: F.transform(
        F.regexp_extract_all(p, F.lit("[^.!?\n]{1,%d}[.!?]*" % GRAIN), F.lit(0)), lambda g: F.shiftright(F.xxhash64(g), 32).cast("int")))


def _digits(grain: Column) -> Column:
    return F.lpad(F.hex(grain.cast("long").bitwiseAND(F.lit((1 << 32) - 1))), 8, "0")


def with_tree(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Add ``<prefix>_print`` (the tree as text), ``<prefix>_root`` and ``<prefix>_grains``."""
    leaves, sections = f"{prefix}_leaves", f"{prefix}_sections"
    df = df.withColumn(f"{prefix}_grains", _grains(F.col(text)))
    df = df.withColumn(leaves, F.zip_with(F.split(text, "\n", -1), f"{prefix}_grains", lambda p, g: F.concat(
        F.md5(p), F.lit(":"), F.array_join(F.transform(g, _digits), ""))))
    # A section is written as its paragraphs; ';' parts sections.
    joined = F.array_join(F.transform(leaves, lambda d: F.concat(d, F.when(
        F.lit(SECTION_ENDS).contains(F.substring(d, 1, 1)), F.lit(";")).otherwise(F.lit(",")))), "")
    df = df.withColumn(sections, F.split(F.regexp_replace(joined, "[;,]$", ""), ";"))
    df = df.withColumn(f"{prefix}_digests", F.transform(sections, lambda s: F.md5(s)))
    df = df.withColumn(f"{prefix}_root", F.md5(F.array_join(f"{prefix}_digests", "")))
    shown = F.zip_with(f"{prefix}_digests", sections, lambda d, s: F.concat(
        F.substring(d, 1, _SHORT), F.lit("="), F.array_join(F.transform(
            F.split(s, ","), lambda p: F.concat(F.substring(p, 1, _SHORT), F.substring(p, 33, 1 << 30))), ",")))
    df = df.withColumn(f"{prefix}_print", F.concat(f"{prefix}_root", F.lit("/"), F.array_join(shown, ";")))
    return df.withColumn(f"{prefix}_grains", F.array_distinct(F.flatten(f"{prefix}_grains"))).drop(leaves, sections, f"{prefix}_digests")


def likeness(a: str, b: str) -> Column:
    """Likeness of two trees added by ``with_tree`` under prefixes ``a`` and ``b``."""
    common = F.size(F.array_intersect(f"{a}_grains", f"{b}_grains"))
    most = F.greatest(F.size(f"{a}_grains"), F.size(f"{b}_grains"))
    return F.when(F.col(f"{a}_root") == F.col(f"{b}_root"), F.lit(1.0)).otherwise(
        F.when(most > 0, common / most).otherwise(F.lit(0.0)))


def edited_paragraphs(a: Column, b: Column) -> Column:
    """Paragraph digests of fingerprint ``a`` that fingerprint ``b`` lacks: sections that ``b`` has are skipped whole."""
    sections = lambda c: F.split(F.substring_index(c, "/", -1), ";")
    paragraphs = lambda c: F.flatten(F.transform(c, lambda s: F.split(F.substring_index(s, "=", -1), ",")))
    lacking = F.array_except(paragraphs(F.array_except(sections(a), sections(b))), paragraphs(sections(b)))
    return F.transform(lacking, lambda p: F.substring(p, 1, _SHORT))


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, how near both are, and which paragraphs the edit took.

    The edited text has its last floor(n_chars / 2) characters replaced by as
    many from the start of the next document (ascending doc_id, the first
    after the last; of rows with one id the least text). A row without id has
    no next document: its replacement is empty.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    # Narrow: ids in order, with the characters each needs of the next one.
    sizes = base.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.length("text")).alias("n_chars"), F.count("*").alias("rows"))
    ids = number_rows(sizes, "n", "doc_id")
    total, rows = ids.agg(F.max("n"), F.max("rows")).first()
    total = total or 1
    after = ids.select(F.col("doc_id").alias("next_id"), F.col("n").alias("next_n"))
    pairs = ids.join(after, F.col("n") % total + 1 == F.col("next_n")).select(
        "next_id", F.col("doc_id").alias("before_id"), F.floor(F.col("n_chars") / 2).cast("int").alias("need"))
    heads = base
    if (rows or 0) > 1:
        heads = base.withColumn("nth", F.row_number().over(W.partitionBy("doc_id").orderBy("text"))).filter("nth = 1")
    # Null-safe on both sides, which leaves one shuffle of the texts for both joins.
    heads = heads.join(pairs, F.col("doc_id").eqNullSafe(F.col("next_id"))).select(
        "before_id", F.left("text", F.col("need")).alias("head"), F.md5("text").alias("next_md5"), F.array_distinct(F.flatten(_grains(F.col("text")))).alias("next_grains"))
    joined = base.join(heads, F.col("doc_id").eqNullSafe(F.col("before_id")), "left")
    half = F.floor(F.length("text") / 2).cast("int")
    joined = joined.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.concat(
        F.left("text", F.length("text") - half), F.left(F.coalesce("head", F.lit("")), half)))
    joined = with_tree(with_tree(joined, "text", "own"), "edited", "edited")
    joined = joined.withColumns({"next_root": F.when(F.col("next_md5") == F.md5("text"), F.col("own_root")).otherwise(F.lit("")),
                                 "next_grains": F.coalesce("next_grains", F.array().cast("array<int>"))})
    return joined.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("own_print").alias("fingerprint"),
        F.col("edited_print").alias("edited_fingerprint"), likeness("own", "edited").alias("near_edited"),
        likeness("own", "next").alias("near_next"),
        edited_paragraphs(F.col("own_print"), F.col("edited_print")).alias("edited_paragraphs"))
