"""Sharding by extendible hashing.

A document's address is a string of bits: 60 bits of the hash of its id, then
60 bits of the hash of its row number, which tell rows of one id apart. The
directory starts with one bucket; only a bucket over the byte limit is split
on the next bit, until every shard fits. In a round Spark adds up the bytes of
every open bucket by as many further bits as its bytes call for, so that the
cells are a few times as many as the shards that it will give, finds for every
cell the shortest prefix that fits, and goes on with the cells that have none.
Bytes and addresses only are shuffled, never texts.

Defined cases: a null text has 0 bytes; a null id is hashed as an empty one; a
document above the limit is a shard of its own, marked ``oversized``; repeated
rows are spread one by one when their bucket is too large; an empty table has
no shards. Only the id and text columns are read; ``write_shards`` writes all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.support import hex_number, shielded, stored
from packetloom.session import cut_lineage, scratch_path

SHARD_BYTES = 64 << 20
# Bits looked ahead where a bucket's rows agreed in all bits that its bytes called for.
STEP = 12
HASH_BITS = 60


def _bits(digest):
    return F.lpad(F.bin(hex_number(digest, 1, HASH_BITS // 4)), HASH_BITS, "0")


def _more_bits(total: Column, limit: int, alike: Column) -> Column:
    """Bits that make cells of a quarter to a half of the limit out of evenly spread bytes."""
    needed = F.ceil(F.log2(total / F.lit(float(limit)))).cast("int") + 1
    return F.greatest(needed, F.when(alike, STEP).otherwise(1))


def _deeper(rows: DataFrame, depth: Column, bits: Column) -> DataFrame:
    """``rows`` with the depth of their open bucket and their cell below it."""
    deep = F.least(depth + bits, F.lit(2 * HASH_BITS))
    return rows.withColumns({"depth": depth.cast("int"), "deep": deep.cast("int")}).withColumn("cell", F.expr("substring(address, 1, deep)"))


def _shards(rows: DataFrame, limit: int) -> DataFrame:
    """row, doc_id, bytes, shard, depth, shard_bytes, oversized of ``rows`` (row, doc_id, bytes), which are read several times."""
    spark = rows.sparkSession
    rows = rows.withColumn("address", F.concat(
        _bits(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), _bits(F.md5(F.col("row").cast("string")))))
    fitting = rows.filter(F.col("bytes") <= limit)
    path = scratch_path(spark, "directory")
    total = fitting.agg(F.sum("bytes")).first()[0] or 0
    whole = F.lit(max(total, 1)).cast("long")
    inside = _deeper(fitting.select("bytes", "address"), F.lit(0), F.greatest(_more_bits(whole, limit, F.lit(False)), F.lit(1)))
    first = True
    while True:
        cells = inside.groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.max("depth").alias("depth"), F.max("deep").alias("deep"))
        prefixes = cells.select("bytes", "depth", "deep", F.explode(F.transform(
            F.sequence("depth", "deep"), lambda d: F.substring("cell", F.lit(1), d))).alias("shard"))
        sums = stored(prefixes.groupBy("shard").agg(
            F.sum("bytes").alias("shard_bytes"), F.max("depth").alias("open"), F.max("deep").alias("deep")).withColumn(
            "depth", F.length("shard")), "prefixes")
        # A prefix is a shard if it fits and the prefix one bit shorter does not.
        above = sums.filter(F.col("shard_bytes") > limit).select(F.col("shard").alias("parent"))
        fits = sums.filter(F.col("shard_bytes") <= limit)
        split = fits.filter("depth > 0").join(above, F.expr("substring(shard, 1, depth - 1)") == F.col("parent"), "left_semi")
        found = split.unionByName(fits.filter("depth = 0")) if first else split
        found.select("shard", "depth", "shard_bytes").write.mode("append").parquet(path)
        opened = sums.filter((F.col("shard_bytes") > limit) & (F.col("depth") == F.col("deep")))
        deepest = opened.agg(F.max("deep")).first()[0]
        if deepest is None:
            break
        if deepest == 2 * HASH_BITS:
            raise ValueError("equal addresses of different rows")  # 120 equal bits: not with distinct row numbers
        # All bytes of the bucket in one cell: its rows agree in these bits, perhaps in many more.
        buckets = sums.filter(F.col("depth") == F.col("open")).select(F.col("shard").alias("bucket"), F.col("shard_bytes").alias("held"))
        opened = opened.join(buckets, F.expr("substring(shard, 1, open)") == F.col("bucket")).select(
            F.col("shard").alias("cell"), _more_bits(F.col("shard_bytes"), limit, F.col("shard_bytes") == F.col("held")).alias("bits"))
        inside = stored(_deeper(inside.select("bytes", "address", "cell", F.col("deep").alias("from")).join(opened, "cell"), F.col("from"), F.col("bits")).select(
            "bytes", "address", "depth", "deep", "cell"), "open-buckets")
        first = False
    directory = spark.read.schema("shard string, depth int, shard_bytes long").parquet(path)
    depths = sorted(r[0] for r in directory.select("depth").distinct().collect())  # at most 121 numbers
    # The directory is prefix-free: each address meets one entry among the depths in use.
    keys = F.array(*[F.struct(F.lit(d).alias("depth"), F.substring("address", 1, d).alias("shard")) for d in depths or [0]])
    placed = fitting.select("row", "doc_id", "bytes", F.explode(keys).alias("k")).select("row", "doc_id", "bytes", "k.*").join(
        directory, ["shard", "depth"])
    single = rows.filter(F.col("bytes") > limit).select(
        "row", "doc_id", "bytes", F.concat(F.lit("row-"), "address").alias("shard"), F.lit(2 * HASH_BITS).alias("depth"),
        F.col("bytes").alias("shard_bytes"), F.lit(True).alias("oversized"))
    return placed.select("row", "doc_id", "bytes", "shard", "depth", "shard_bytes", F.lit(False).alias("oversized")).unionByName(single)


def _size(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes")


def assign_shards(docs: DataFrame, limit: int = SHARD_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, bytes, shard (its address prefix), depth, shard_bytes, oversized."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), _size(text))
    return _shards(cut_lineage(rows), limit).drop("row")


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the documents as Parquet, one folder ``_shard=...`` per shard.

    They are stored with a number each first, by which every row goes to its own shard,
    whatever ids repeat. Folders are named ``bits-<prefix>`` (``row-...`` for oversized
    documents), as readers would take bare bits for numbers.
    """
    plain, names = shielded(docs)
    plain = stored(plain.withColumn("row", F.monotonically_increasing_id()), "numbered-documents")
    shards = _shards(plain.select("row", F.col(names[doc_id]).alias("doc_id"), _size(names[text])), limit)
    out = plain.join(shards.select("row", F.when(
        F.col("oversized"), F.col("shard")).otherwise(F.concat(F.lit("bits-"), "shard")).alias("_shard")), "row").drop("row").toDF(*docs.columns, "_shard")
    out.repartition("_shard").write.partitionBy("_shard").parquet(path)
