"""Groups of spelling variants by PartEnum signatures.

Words one edit apart have letter multisets, taken as binary vectors (first a,
second a, first b, ...), at a Hamming distance of at most two: two for a
replaced letter, where both have the same size, and one for an added or
missing letter, where the sizes differ by one. The dimensions are dealt to
``PARTS`` parts. Two vectors of one size at distance two agree on all parts
but two, those at distance one on all parts but one. So each multiset has one
signature for every two parts left out, with its size, and for every part left
out one with the larger of the two sizes it may have; multisets are joined on
equal signatures. Only distinct multisets have signatures, so anagrams are not
compared with each other and a pair of multisets is looked at once, not once
per pair of words. The words of the pairs found are verified by edit distance.

Words are counted with partial sums in every task; what follows grows with the
number of distinct words, not of documents.

Defined cases: a null text has no words; repeated rows each count; a null
doc_id is written as an empty text in the checksum; with several near words of
the same largest count the least in code-point order is the form; an empty
table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.support import mix, stored

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = 8
MIN_LENGTH = 7
MIN_COUNT = 2
FORM_RATIO = 10
# One run in so many, by its checksum, loses a letter in the named query.
DAMAGE = 31
# A form has ten times its word's count, which 64 bits allow 18 times in a row.
_ROUNDS = 5
SIGNATURES = "family int, signature long, letters string"


def damaged_runs(docs: DataFrame, every: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` of every run of letters, lower-cased; one in ``every`` of them without one letter."""
    # Python's pattern syntax for \\u equals Java's.
    runs = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.explode(F.regexp_extract_all(
        F.translate(F.col(text), UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("word"))
    if every is None:
        return runs.select("word")
    runs = runs.filter(F.length("word") >= MIN_LENGTH)  # a run only gets shorter
    check = F.crc32(F.concat(F.coalesce("doc_id", F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
    at = (F.col("check") % F.length("word")).cast("int")
    shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return runs.withColumn("check", check).select(F.when(F.col("check") % every == 0, shorter).otherwise(F.col("word")).alias("word"))


def count_words(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    return words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(
        F.col("n") >= min_count)


def _letters(word: Column) -> Column:
    """The letters of a word in order, which names its multiset."""
    return F.array_join(F.array_sort(F.split(word, "")), "")


def signature_rows(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Task: the signatures of every multiset, given as its sorted letters.

    Families: 0 has replaced letters (both sides alike); 1 is the shorter side
    of an added letter, 2 the longer side.
    """
    left_out = np.array(list(combinations(range(parts), 2)), np.int64)
    one = np.arange(parts, dtype=np.int64)
    for batch in batches:
        names = batch.column(0).to_pylist()
        sizes = np.array([len(s) for s in names], np.int64)
        letters = np.frombuffer("".join(names).encode("utf-32-le"), "<u4").astype(np.uint64)
        row = np.repeat(np.arange(len(names)), sizes)
        # The letters of a row are sorted, so equal ones stand together; count them off.
        new = np.ones(len(letters), bool)
        new[1:] = (letters[1:] != letters[:-1]) | (row[1:] != row[:-1])
        firsts = np.nonzero(new)[0]
        nth = (np.arange(len(letters)) - np.repeat(firsts, np.diff(np.append(firsts, len(letters))))).astype(np.uint64)
        dimension = mix((letters << np.uint64(32)) | nth + np.uint64(1))
        sums = np.zeros((len(names), parts), np.uint64)
        np.add.at(sums, (row, (dimension % np.uint64(parts)).astype(np.int64)), mix(dimension ^ np.uint64(0x51ED270B)))
        total = sums.sum(axis=1, dtype=np.uint64)[:, None]

        def made(family: int, rest: np.ndarray, tag: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
            # Which parts are left out and the size are part of the signature.
            code = mix((tag.astype(np.uint64)[None, :] << np.uint64(32)) | size.astype(np.uint64)[:, None])
            value = mix(rest + code).astype(np.int64)
            return pa.RecordBatch.from_arrays([
                pa.array(np.full(value.size, family, np.int32)), pa.array(value.ravel()),
                batch.column(0).take(pa.array(np.repeat(np.arange(len(names)), value.shape[1])))],
                names=["family", "signature", "letters"])

        yield made(0, total - sums[:, left_out[:, 0]] - sums[:, left_out[:, 1]], left_out[:, 0] * parts + left_out[:, 1], sizes)
        yield made(1, total - sums, one + parts * parts, sizes + 1)
        yield made(2, total - sums, one + parts * parts, sizes)


def near_multisets(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """a, b: pairs of letter multisets that share a signature, each pair once."""
    multisets = words.select("letters").distinct()

    def run(batches):
        yield from signature_rows(batches, parts)

    signed = stored(multisets.mapInArrow(run, SIGNATURES), "signatures")

    def side(family: int, name: str) -> DataFrame:
        return signed.filter(F.col("family") == family).select("signature", F.col("letters").alias(name))

    replaced = side(0, "a").join(side(0, "b"), "signature").filter("a < b").select("a", "b")
    added = side(1, "a").join(side(2, "b"), "signature").select("a", "b")
    return replaced.union(added).distinct()


def near_words(counted: DataFrame, parts: int = PARTS) -> DataFrame:
    """a, na, b, nb: pairs of words exactly one edit apart, each pair once."""
    spelt = stored(counted.withColumn("letters", _letters(F.col("word"))), "spelt-words")
    pairs = near_multisets(spelt, parts)
    one = spelt.select(F.col("letters").alias("a"), F.col("word").alias("wa"), F.col("n").alias("na"))
    two = spelt.select(F.col("letters").alias("b"), F.col("word").alias("wb"), F.col("n").alias("nb"))
    able = pairs.join(one, "a").join(two, "b").filter(F.levenshtein("wa", "wb", 1) == 1)
    return able.select(F.col("wa").alias("a"), "na", F.col("wb").alias("b"), "nb")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form: each round doubles the steps that are followed."""
    found = forms.select("word", F.col("form").alias("root"))
    for _ in range(_ROUNDS):
        step = found.select(F.col("word").alias("_word"), F.col("root").alias("_next"))
        moved = stored(found.join(step, F.col("root") == F.col("_word"), "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        found = moved.select("word", "root")
        if not moved.filter("_moved").take(1):
            break
    return found


def group_variants(counted: DataFrame, ratio: int = FORM_RATIO, parts: int = PARTS) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of ``counted`` (word, n)."""
    counted = stored(counted.select("word", "n"), "counted-words")
    pairs = stored(near_words(counted, parts), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("near"), F.col("nb").alias("near_n")).union(
        pairs.select("b", "nb", "a", "na"))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct(
        (-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("n")
    formed = stored(best.select("word", "n_near", F.when(fits, F.col("best.near")).alias("form"),
                                F.when(fits, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(formed.filter("form IS NOT NULL"))
    return counted.join(formed, "word", "left").join(roots, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, damage: int | None = None, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                      ratio: int = FORM_RATIO, parts: int = PARTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spelling variants among the words of all texts; ``damage`` takes a letter from one run in so many."""
    words = damaged_runs(docs, damage, doc_id, text)
    return group_variants(count_words(words, min_length, min_count), ratio, parts)
