"""Near-duplicate documents by b-bit MinHash.

Of 160 minima 8 bits are kept and packed; 4 of them form a band, 40 bands in
all. Documents that share a band's value are candidates; two documents at
similarity 0.75 miss each other in all bands with a chance below 1 in a
million. A candidate pair's similarity is estimated from the bits in which the
packed signatures differ, corrected for chance agreement, and a pair is
dropped only when the estimate is ``MARGIN`` (six standard deviations) below
the threshold. Every link is confirmed on the full shingle sets.

Equal sets are one node from the start. Groups are then joined in three steps,
none of which makes rows of all pairs of a bucket:

1. every document against the least document of one of its buckets, the best
   by estimate, which joins most of a group along a tree;
2. the remaining pairs of a document and the least of a bucket;
3. in buckets that still hold several components, all members across
   components, in blocks that hold on average at most ``BLOCK`` members and
   ``BLOCK_SHINGLES`` shingles against each other: a task counts common
   shingles by a matrix product and reports one link per pair of components.
   This step makes the result exact over all candidates.

Defined cases: null and empty texts, and texts without words, have no
shingles and no links; repeated rows of one doc_id count as one document; a
row without doc_id is linked with nothing, has a null component and is kept;
an empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.shingles import HASHES, SIGNED_DDL, set_rows, signed_rows
from packetloom.llm.support import stored

PERCENT = 75
MARGIN = 0.2
BLOCK = 2048
# Shingles of a block, about.
BLOCK_SHINGLES = 1 << 21
# Rows of a stored table of ids per file, about.
FILE_ROWS = 1 << 18
_SHINGLES_AT_ONCE = 4096


def estimated_similarity(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures; two unlike minima agree in 8 bits once in 256."""
    def unlike(x: Column) -> Column:
        x = x.bitwiseOR(F.shiftrightunsigned(x, 4))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(x.bitwiseAND(F.lit(0x01010101)))

    differing = F.aggregate(F.zip_with(a, b, lambda x, y: unlike(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    agreeing = 1 - differing / F.lit(float(HASHES))
    return (agreeing - 1 / 256) / (1 - 1 / 256)


def in_few_files(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of ids and about ``rows`` rows, in no more partitions than ``FILE_ROWS`` calls for.

    Few rows in as many files as a shuffle has partitions cost more to write
    than to make: on a local disk Hadoop starts a process for each file.
    """
    return df.coalesce(rows // FILE_ROWS + 1)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of the nodes of ``edges`` (a, b) that are not the least themselves.

    Alternates connecting larger and smaller neighbours to the least one until
    nothing changes; the number of rounds grows with the logarithm of the size.
    Give ``edges`` from storage: they are counted and read more than once.
    """
    rows = edges.count()
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(in_few_files(small.union(least.select("u", F.col("m").alias("v"))).distinct(), rows), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return in_few_files(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), rows)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of ``pairs`` (a, b) those whose full sets reach the similarity."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("_b"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = []
            for i, (x, y) in enumerate(zip(batch.column("_a"), batch.column("_b"), strict=True)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = np.intersect1d(x, y, assume_unique=True).size
                if 100 * both >= percent * (len(x) + len(y) - both):
                    fine.append(i)
            taken = batch.take(pa.array(fine, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column("a"), taken.column("b")], names=["a", "b"])

    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(test, "a long, b long")


def _common(sizes: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """Number of common shingles of each two of the sets that ``shingles`` holds in a row."""
    _, place, times = np.unique(shingles, return_inverse=True, return_counts=True)
    shared = np.nonzero(times[place] > 1)[0]
    number = np.cumsum(times > 1) - 1
    row, column = np.repeat(np.arange(len(sizes)), sizes)[shared], number[place[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sizes), len(sizes)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, _SHINGLES_AT_ONCE):
        a, b = np.searchsorted(column, [start, start + _SHINGLES_AT_ONCE])
        part = np.zeros((len(sizes), _SHINGLES_AT_ONCE), np.float32)
        part[row[a:b], column[a:b] - start] = 1
        part = part[:, :int(column[b - 1]) - start + 1]
        common += part @ part.T
    return common


def _dealt(members: DataFrame, groups: DataFrame) -> DataFrame:
    """``members`` (bucket, doc_id, n shingles) of buckets with several components, once for each two blocks i, j to test.

    A bucket of two is left out: its one pair was tested as a star.
    """
    placed = _placed(members, "doc_id", groups, "c")
    mixed = placed.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n"), F.sum("n").alias("shingles")).filter(
        "low < high AND n > 2").select("bucket", F.ceil(F.greatest(
            F.col("n") / BLOCK, F.least(F.col("shingles") / BLOCK_SHINGLES, F.col("n")))).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    return placed.join(mixed, "bucket").select("bucket", "doc_id", "n", "c", own.alias("own"), F.explode(
        F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "bucket", "doc_id", "n", "c", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _links_across(members: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components within buckets that hold several."""
    dealt = _dealt(members, groups).drop("n")

    def test(key: tuple, table: pa.Table) -> pa.Table:
        raw = [s.as_buffer() for s in table.column("shingles")]
        sizes = np.array([s.size // 8 for s in raw])
        common = _common(sizes, np.frombuffer(b"".join(raw), np.uint64))
        ids, c, own = (table.column(n).to_numpy() for n in ("doc_id", "c", "own"))
        fine = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
        a, b = np.nonzero(fine & (c[:, None] < c[None, :]))
        if key[1].as_py() != key[2].as_py():
            across = own[a] != own[b]
            a, b = a[across], b[across]
        _, one = np.unique(np.stack([c[a], c[b]]), axis=1, return_index=True)
        return pa.table({"a": ids[a[one]], "b": ids[b[one]]})

    return dealt.join(sets, "doc_id").groupBy("bucket", "i", "j").applyInArrow(test, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = stored(body.mapInArrow(signed_rows, SIGNED_DDL), "signatures")
    usable = signed.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = stored(usable.groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.min_by("n_shingles", "doc_id").alias("n"), F.min_by("signature", "doc_id").alias("sig")), "classes")

    members = classes.select(F.col("rep").alias("doc_id"), "n", F.posexplode("sig").alias("band", "value")).select(
        "doc_id", "n", (F.shiftleft(F.col("band").cast("long"), 32) + F.col("value")).alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    members = stored(members.join(buckets.select("bucket", "least"), "bucket"), "buckets")

    signatures = classes.select("rep", "n", "sig")

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b), a < b, that sizes and signatures do not rule out, with their estimate."""
        one = signatures.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
        two = signatures.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
        able = pairs.join(one, "a").join(two, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        return able.select("a", "b", estimated_similarity(F.col("sa"), F.col("sb")).alias("likeness")).filter(
            F.col("likeness") >= percent / 100 - MARGIN)

    stars = members.filter("doc_id > least").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()
    stars = stored(likely(stars), "stars")
    if not stars.take(1) and not members.take(1):
        links = None
    else:
        wanted = members.select("doc_id").distinct()
        sets = stored(body.join(wanted, "doc_id", "left_semi").mapInArrow(set_rows, "doc_id long, shingles binary"), "shingles")
        best = stars.groupBy("b").agg(F.max_by("a", "likeness").alias("a")).select("a", "b")
        starred = stars.count()
        tested = stored(in_few_files(best, starred), "tested")
        links = stored(confirm(tested, sets, percent), "links")
        groups = stored(components(links), "groups")
        rest = _across(stars.select("a", "b").join(tested, ["a", "b"], "left_anti"), groups).select("a", "b")
        rest = stored(in_few_files(rest, starred), "rest")
        if rest.take(1):
            links = stored(links.union(confirm(rest, sets, percent)), "links")
            groups = stored(components(links), "groups")
        more = stored(_links_across(members.select("bucket", "doc_id", "n"), groups, sets, percent), "links-across")
        if more.take(1):
            groups = stored(components(links.union(more)), "groups")
        links = groups
    keyed = signed.join(classes.select(F.col("set_key").alias("_key"), "rep"),
                        (F.col("set_key") == F.col("_key")) & F.col("doc_id").isNotNull(), "left")
    if links is not None:
        keyed = keyed.join(links, F.col("rep") == F.col("node"), "left")
    else:
        keyed = keyed.withColumn("component", F.lit(None).cast("long"))
    component = F.coalesce("component", "rep", "doc_id")
    return keyed.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _placed(df: DataFrame, column: str, groups: DataFrame, name: str) -> DataFrame:
    """Add the component of ``column`` (itself, if it has no link yet)."""
    found = groups.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return df.join(found, F.col(column) == F.col("_node"), "left").withColumn(
        name, F.coalesce("_component", column)).drop("_node", "_component")


def _across(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    return _placed(_placed(pairs, "a", groups, "ca"), "b", groups, "cb").filter("ca <> cb")
