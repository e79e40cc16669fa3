"""Benchmark decontamination by a broadcast set of n-grams; DataFrame functions only.

Texts are lower-cased (A-Z) and cut into words of letters, digits and
characters beyond ASCII. The windows of ``WORDS`` consecutive words of the
benchmark items (an item of fewer words is one window) form a set of hashes.
Documents are scanned where they are read. A run of ten words holds one of the
five-word seeds that a text can be cut into, whole; so seeds are looked up in a
broadcast set of the seeds of all windows, and only where one is found the
windows that hold it are hashed and looked up in the set of windows. A hit
counts when its words equal those of the benchmark window. Nothing but hits
leaves the task.

Both sets are broadcast up to ``BROADCAST_BYTES``, measured first; a larger one
is joined by a shuffle of hashes. Documents and windows meet in
one pass over the texts. Hit words are summed from runs of overlapping windows.
The items of a document are looked up once per distinct set of windows found,
so a passage that very many documents share is not multiplied by its items.

Defined cases: null and empty texts have no words; rows with equal id and
equal text are one document, rows with equal id and different texts are
judged each for itself, a null id is an id; items without words do nothing,
items without id mark words but are not counted or listed, rows repeated under
one item_id count as one item; without items nothing is hit; an empty table
gives no rows. ``decontaminate`` keeps every row that stays as it is, with
columns of any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetloom.llm.support import shielded, stored
from packetloom.operators.telemetry import number_rows

WORDS = 10
BROADCAST_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# ASCII without letters and digits parts words.
BREAKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
RAW_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
# What a row and its hash table entry take beside the words, about.
_ROW_BYTES = 96
_NO_HIT = 0


def normalised_words(text: Column) -> Column:
    """Words of a text, lower-cased; null for null."""
    # One pass lower-cases and blanks what parts words; cutting at blanks is far cheaper than a pattern.
    return F.array_remove(F.split(F.translate(text, UPPER + BREAKS, LOWER + " " * len(BREAKS)), " "), "")


def _joined(words: Column) -> Column:
    # No word holds a space.
    return F.array_join(words, " ")


def benchmark_windows(items: DataFrame, words: int = WORDS, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """gram_no, item_id: the numbered windows of every item, with gram, size and hash."""
    listed = items.select(F.col(item_id).cast("string").alias("item_id"), normalised_words(F.col(text)).alias("w")).filter("size(w) > 0")
    grams = listed.select("item_id", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("w") - (words - 1), F.lit(1))), lambda i: F.slice("w", i, words))).alias("g"))
    owned = stored(grams.select("item_id", _joined(F.col("g")).alias("gram"), F.size("g").alias("size"),
                                F.xxhash64("g").alias("hash")).distinct(), "benchmark-windows")
    numbered = number_rows(owned.select("gram", "size", "hash").distinct(), "gram_no", "gram")
    return stored(owned.join(numbered.select("gram", "gram_no"), "gram"), "numbered-windows")


def _if_small(grams: DataFrame, text: str | None = None) -> DataFrame:
    held = F.octet_length(text) + _ROW_BYTES if text else F.lit(_ROW_BYTES)
    size = grams.agg(F.sum(held)).first()[0] or 0
    return F.broadcast(grams) if size <= BROADCAST_BYTES else grams


def _seed_size(size: int) -> int:
    """Words of a seed: any ``size`` words in a row hold a whole one of the seeds laid end to end."""
    return (size + 1) // 2


def _hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, digest, n_words, at, size, gram_no of every hit, and one row per document without them (size 0)."""
    grams = stored(windows.select("hash", "gram", "size", "gram_no").distinct(), "distinct-windows")
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect())
    # The row that stands for a document itself finds these.
    spark = docs.sparkSession
    no_gram = spark.range(1).select(F.lit(_NO_HIT).cast("long").alias("hash"), F.lit("").alias("gram"),
                                    F.lit(0).alias("size"), F.lit(None).cast("long").alias("gram_no"))
    seed_size = F.floor((F.col("size") + 1) / 2).cast("int")
    seeds = grams.select("size", F.split("gram", " ").alias("g")).select("size", F.explode(F.transform(
        F.sequence(F.lit(1), seed_size), lambda i: F.xxhash64("size", F.slice("g", i, seed_size)))).alias("seed")).distinct()
    seeds = stored(seeds.select("seed", F.col("size").alias("_size")), "seeds")
    seeds = _if_small(seeds.unionByName(no_gram.select(F.col("hash").alias("seed"), F.col("size").alias("_size"))))
    known = _if_small(grams.withColumnRenamed("size", "gram_size").unionByName(no_gram.withColumnRenamed("size", "gram_size")), "gram")

    body = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"),
                       F.coalesce(normalised_words(F.col("text")), F.array().cast("array<string>")).alias("words"))
    count = F.size("words")
    entry = "array<struct<size:int,start:int,h:bigint>>"

    def laid(size: int) -> Column:
        """The seeds of a text for windows of ``size`` words."""
        step = _seed_size(size)
        return F.when(count >= size, F.transform(F.sequence(F.lit(1), count, F.lit(step)), lambda i: F.struct(
            F.lit(size).alias("size"), i.alias("start"), F.xxhash64(F.lit(size), F.slice("words", i, step)).alias("h")))).otherwise(
            F.array().cast(entry))

    itself = F.array(F.struct(F.lit(0).alias("size"), F.lit(1).alias("start"), F.lit(_NO_HIT).cast("long").alias("h")))
    # (Outer generators keep Spark from evaluating all this again in a filter below them.)
    looked = body.select("doc_id", "digest", "words", F.inline_outer(F.concat(itself, *map(laid, sizes))))
    near = looked.join(seeds, (F.col("h") == F.col("seed")) & (F.col("size") == F.col("_size")))
    # The windows that hold the seed found.
    first = F.greatest(F.col("start") - F.floor((F.col("size") + 1) / 2).cast("int") + 1, F.lit(1))
    last = F.least(F.col("start"), count - F.col("size") + 1)
    starts = F.when(F.col("size") == 0, F.array(F.lit(1))).when(first <= last, F.sequence(first, last))
    opened = near.select("doc_id", "digest", "words", "size", F.explode_outer(starts).alias("at")).filter("at IS NOT NULL").withColumn(
        "h", F.when(F.col("size") == 0, F.lit(_NO_HIT).cast("long")).otherwise(F.xxhash64(F.slice("words", F.col("at"), F.col("size")))))
    found = opened.join(known, (F.col("h") == F.col("hash")) & (F.col("size") == F.col("gram_size")) & (
        (F.col("size") == 0) | (_joined(F.slice("words", F.col("at"), F.col("size"))) == F.col("gram"))))
    return found.select("doc_id", "digest", count.cast("long").alias("n_words"), (F.col("at") - 1).alias("at"), "size", "gram_no")


def contamination(docs: DataFrame, items: DataFrame, words: int = WORDS, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, digest (of the text), n_words, n_hit, spans (first, end) of hit words, items (sorted) of every document."""
    windows = benchmark_windows(items, words, item_id, item_text)
    body = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    key = ["doc_id", "digest"]
    hits = stored(_hits(body, windows).distinct(), "benchmark-hits")
    every = hits.filter("size = 0").select(*key, "n_words")
    runs = hits.filter("size > 0").groupBy(*key, "at").agg((F.col("at") + F.max("size")).alias("end"))
    before = F.max("end").over(W.partitionBy(*key).orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    marked = runs.withColumn("before", F.coalesce(before, F.lit(-1))).withColumn("starts", (F.col("at") > F.col("before")).cast("int"))
    marked = marked.withColumn("run", F.sum("starts").over(W.partitionBy(*key).orderBy("at")))
    spans = marked.groupBy(*key, "run").agg(F.min("at").alias("first"), F.max("end").alias("end"))
    spans = spans.groupBy(*key).agg(F.sum(F.col("end") - F.col("first")).cast("long").alias("n_hit"), F.sort_array(
        F.collect_list(F.struct("first", "end"))).alias("spans"))
    # Items by distinct set of windows.
    sets = hits.filter("size > 0").groupBy(*key).agg(F.sort_array(F.collect_set("gram_no")).alias("grams"))
    sets = stored(sets.withColumn("set_key", F.md5(F.array_join(F.col("grams").cast("array<string>"), ","))), "window-sets")
    distinct = sets.groupBy("set_key").agg(F.min("grams").alias("grams"))
    owners = windows.filter("item_id IS NOT NULL").select("gram_no", "item_id")
    listed = distinct.select("set_key", F.explode("grams").alias("gram_no")).join(owners, "gram_no").groupBy("set_key").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"))
    known = sets.select(*key, "set_key").join(listed, "set_key", "left").select(*key, "items")

    def attach(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnsRenamed({k: f"_{k}" for k in key})
        same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("digest") == F.col("_digest"))
        return left.join(right, same, "left").drop("_doc_id", "_digest")

    out = attach(every, attach(spans, known))
    return out.select(*key, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), "spans",
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _without(text: Column, spans: Column) -> Column:
    """``text`` without the words of ``spans`` and what stands before each of them."""
    words, gaps = F.col("_words"), F.col("_gaps")
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["first"]), F.array(F.size(words)))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.zip_with(
        F.slice(gaps, a + 1, b - a), F.slice(words, a + 1, b - a), lambda x, y: F.concat(x, y))))
    return F.concat(F.array_join(kept, ""), F.element_at(gaps, -1))


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "spans", words: int = WORDS, doc_id: str = "doc_id",
                  text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without hit words (``remove="spans"``) or without documents that hold any (``"documents"``)."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    found = contamination(docs, items, words, doc_id, text, item_id, item_text).filter("n_hit > 0").select(
        F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("spans").alias("_spans"))
    plain, names = shielded(docs)
    own = F.col(names[text])
    same = F.col(names[doc_id]).eqNullSafe(F.col("_id")) & (F.md5(own) == F.col("_digest"))
    if remove == "documents":
        return plain.join(found, same, "left_anti").toDF(*docs.columns)
    hit = F.col("_spans").isNotNull()
    cut = plain.join(found, same, "left").withColumns({
        "_words": F.when(hit, F.regexp_extract_all(own, F.lit(RAW_WORD), F.lit(0))),
        "_gaps": F.when(hit, F.split(own, RAW_WORD, -1))})
    return cut.withColumn(names[text], F.when(hit, _without(own, F.col("_spans"))).otherwise(own)).select(
        *names.values()).toDF(*docs.columns)
