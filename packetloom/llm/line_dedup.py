"""Removal of repeated line chunks; DataFrame functions only.

Lines are hashed, and a rolling hash over each three neighbouring line hashes
decides where a chunk ends, so inserted or deleted lines move boundaries only
nearby. Of ends on neighbouring lines every second one counts, and a last
single line belongs to the chunk before it: no chunk of a text of several
lines is a single line, so every line of it is compared. Chunks are counted by
digest over all documents. For the repeated digests alone the texts of the
chunks are grouped byte by byte; the first occurrence (least doc_id, then
least line) of each text stays and every other one is removed.

Digests are counted with partial sums in every task, and which occurrences go
is found by taking the first ones away from the flagged ones, so a passage that
very many documents share never meets in one task. Texts are shuffled once.
The places of the chunks of a text are numbers that are looked up by hash, and
what stays are the stretches between removed chunks, so the time for a text
grows with its lines. (Outer generators are used because plain ones make Spark
evaluate the whole chain of expressions again in a filter below them.)

Defined cases: a null text has no lines and stays null; an empty text is one
empty line; texts of one line are never removed; rows that share a doc_id (null
counts as one, ordered first) are one document here: the same chunk at the same
line of both stays in both. Texts of one doc_id that differ have their own
chunks. Columns other than id and text are passed on untouched, but for
``n_lines`` and ``n_removed``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.support import hex_number, join_counted, shielded, stored

# One window of three lines in so many ends a chunk.
BOUNDARY_EVERY = 3
MULTIPLIER = 31
# Prime, so that the order of the lines in a window counts.
MODULUS = 1_000_003


def line_hash(line: Column) -> Column:
    return hex_number(F.md5(line), 1, 8)


def _apart(ends: str, last: Column) -> Column:
    """Of the ascending ``ends`` those that leave no line alone; ``last`` is always one.

    An end directly on another one goes, so of neighbouring ends every second
    stays; which these are depends on the lines next to them only.
    """
    first = F.filter(ends, lambda e, k: (k == 0) | (F.get(ends, k - 1) < e - 1))
    final = F.filter(ends, lambda e, k: (k == F.size(ends) - 1) | (F.get(ends, k + 1) > e + 1))
    apart = F.flatten(F.zip_with(first, final, lambda a, b: F.sequence(a, b, F.lit(2))))
    return F.concat(F.filter(apart, lambda e: e < last - 1), F.array(last))


def with_chunks(docs: DataFrame, lines: str, every: int = BOUNDARY_EVERY) -> DataFrame:
    """Add ``_chunks``: (start, size) of the chunks of two or more lines."""
    hashed = docs.withColumn("_h", F.transform(lines, line_hash))
    last = F.size("_h") - 1
    rolled = lambda i: ((F.get("_h", i - 2) * MULTIPLIER + F.get("_h", i - 1)) * MULTIPLIER + F.get("_h", i)) % MODULUS
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | ((i > 1) & (rolled(i) % every == 0)))
    none = F.array().cast("array<int>")
    ended = hashed.withColumn("_ends", F.when(F.size("_h") > 0, ends).otherwise(none))
    ended = ended.withColumn("_ends", F.when(F.size("_h") > 0, _apart("_ends", last)).otherwise(none))
    starts = F.transform("_ends", lambda e, i: F.when(i == 0, F.lit(0)).otherwise(F.get("_ends", i - 1) + 1))
    chunks = F.zip_with(starts, "_ends", lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("size")))
    return ended.withColumn("_chunks", F.filter(chunks, lambda c: c["size"] > 1)).drop("_h", "_ends")


def _place(start: Column, size: Column) -> Column:
    """Start and size of a chunk as one number, by which places sort and are looked up."""
    return F.shiftleft(start.cast("long"), 32) + size


def _start(place: Column) -> Column:
    return F.shiftright(place, 32).cast("int")


def _size(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def _chunk_text(start: Column, size: Column) -> Column:
    return F.array_join(F.slice("_lines", start + 1, size), "\n")


def _between(lines: str, removed: str) -> Column:
    """The lines that no chunk of the ascending ``removed`` covers."""
    zero = F.array(F.lit(0))
    starts = F.concat(zero, F.transform(removed, lambda p: _start(p) + _size(p)))
    ends = F.concat(F.transform(removed, _start), F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))


def dedup_lines(docs: DataFrame, every: int = BOUNDARY_EVERY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text that stays, and n_lines and n_removed."""
    body = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.md5(F.col(text)).alias("_key"))
    lines = F.split("_text", "\n", -1)
    chunked = with_chunks(body.filter("_text IS NOT NULL").select("_id", "_key", lines.alias("_lines")), "_lines", every)
    digests = stored(chunked.select("_id", "_key", F.transform("_chunks", lambda c: F.struct(
        _place(c["start"], c["size"]).alias("place"),
        F.unhex(F.md5(_chunk_text(c["start"], c["size"]))).alias("digest"))).alias("_c")).select(
            "_id", "_key", F.inline_outer("_c")).filter("digest IS NOT NULL"), "chunk-digests")
    repeated = stored(digests.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1"), "repeated-chunks")
    flagged = join_counted(digests, repeated, "digest").groupBy("_id", "_key").agg(F.collect_set("place").alias("_flagged"))
    flagged = stored(flagged.withColumnsRenamed({"_id": "_flagged_id", "_key": "_flagged_key"}), "flagged-chunks")
    # What is flagged grows with the corpus, so both joins sort and merge at every size; they read
    # one shuffle of the texts where the documents have no further columns. Null-safe keys on both
    # sides, as a filter of nulls below one of them would make it another shuffle.
    texts = body.join(flagged.hint("merge"), F.col("_id").eqNullSafe(F.col("_flagged_id")) & F.col("_key").eqNullSafe(F.col("_flagged_key")))
    pieces = texts.select("_id", lines.alias("_lines"), "_flagged").select("_id", F.explode_outer(F.transform(
        "_flagged", lambda p: F.struct(p.alias("place"), _chunk_text(_start(p), _size(p)).alias("chunk")))).alias("p")).filter("p IS NOT NULL")
    firsts = pieces.groupBy("p.chunk").agg(F.min(F.struct("_id", "p.place")).alias("f"))
    firsts = firsts.groupBy(F.col("f._id").alias("_first_id")).agg(F.collect_set("f.place").alias("_firsts"))
    removed = flagged.join(firsts, F.col("_flagged_id").eqNullSafe(F.col("_first_id")), "left").select(
        "_flagged_id", "_flagged_key", F.sort_array(F.array_except(
            "_flagged", F.coalesce("_firsts", F.array().cast("array<bigint>")))).alias("_removed"))
    plain, names = shielded(docs)
    own = names[text]
    out = plain.withColumn("_key", F.md5(own)).join(
        removed.hint("merge"), F.col(names[doc_id]).eqNullSafe(F.col("_flagged_id")) & F.col("_key").eqNullSafe(F.col("_flagged_key")), "left")
    out = out.withColumn("_lines", F.split(own, "\n", -1)).withColumn(
        "_kept", F.when(F.size("_removed") > 0, _between("_lines", "_removed")).otherwise(F.col("_lines")))
    count = lambda column: F.when(F.col(own).isNull(), F.lit(0)).otherwise(F.size(column)).cast("long")
    passed = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(
        *[(F.array_join("_kept", "\n") if c == text else F.col(names[c])).alias(c) for c in passed],
        count("_lines").alias("n_lines"), (count("_lines") - count("_kept")).alias("n_removed"))
