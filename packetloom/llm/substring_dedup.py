"""Removal of long word sequences that occur earlier, by recompression.

Documents are dealt into groups of a few MB by a hash of their id, and all
steps work group by group:

1. Recompression names the core of every window (``recompression.py``). A
   group reports each name once, so no name can have more rows than there are
   groups; names reported twice, or found twice within a group, are shared.
2. Windows with a shared core are possible repeats. Each is verified by a
   128-bit digest of its words' bytes; per digest the first place (least
   doc_id, then least start) is found with partial sums.
3. Every window with a shared core that is not the first of its digest is a
   repeat, and the words it covers are removed.

The highest symbol of all, a document's whole text, is compared before: later
copies of a text are repeats as a whole and report nothing.

Windows are judged on the input. Defined cases: a null text has no words; a
text of fewer words than a window has no windows and stays whole; rows that
share a doc_id are one document: equal windows at the same start of both are
one window, and each row's text is judged by its own windows; null ids come
before all others; an empty table gives no rows. Only the id and text columns
are read.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.recompression import window_cores
from packetloom.llm.support import WordTable, byte_digests, join_counted, stored
from packetloom.session import cut_lineage

WINDOW = 20
GROUP_BYTES = 6 << 20
_WORDS_AT_ONCE = 1 << 16
_CORE, _COPY, _FIRST = 0, 1, 2


class _Group:
    """Words and windows of the documents of one group."""

    def __init__(self, table: pa.Table, window: int, copies: set = frozenset()) -> None:
        """``copies``: doc_id and ``_text_key`` of the later copies."""
        self.ids = table.column("doc_id").to_pylist()
        self.texts = table.column("text").combine_chunks().cast(pa.binary())
        self.words = WordTable(self.texts)
        self.first, self.size = self.words.first, window
        copied = {i for i, _ in copies}
        self.copy = np.array([i in copied and (i, _text_key(self.texts[r].as_py())) in copies
                              for r, i in enumerate(self.ids)], bool)

    def varied(self) -> np.ndarray:
        """Which rows share their id with a row of another text."""
        first, varied = {}, set()
        if len(set(self.ids)) < len(self.ids):
            for r, i in enumerate(self.ids):
                if not self.texts[first.setdefault(i, r)].equals(self.texts[r]):
                    varied.add(i)
        return np.array([i in varied for i in self.ids], bool)

    def cores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows with one core: first window, its name, its place; and no windows of later copies."""
        window, name, where = self.windows()
        if self.copy.any():
            used = ~self.copy[self.document(window)]
            window, name, where = window[used], name[used], where[used]
        self.window = window
        new = np.ones(len(window), bool)
        new[1:] = (name[1:] != name[:-1]) | (where[1:] != where[:-1])
        self.run = np.nonzero(new)[0]
        return self.run, name[self.run], where[self.run]

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``window_cores`` of all documents, some at a time so that the arrays stay in the processor's cache."""
        hashes, starts = self.words.hashes(), np.unique(self.first[:-1])
        cuts = np.unique(np.searchsorted(starts, np.arange(0, len(hashes), _WORDS_AT_ONCE)))
        cuts = cuts[cuts < len(starts)]  # no document starts behind the last long one
        found = []
        for a, b in zip(cuts, np.append(cuts[1:], len(starts)), strict=True):
            low, high = starts[a], starts[b] if b < len(starts) else len(hashes)
            window, name, where = window_cores(hashes[low:high], starts[a:b] - low, self.size)
            found.append((window + low, name, where + (low << 5)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else window_cores(hashes, starts, self.size)

    def document(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, side="right") - 1

    def flagged(self, shared: np.ndarray) -> np.ndarray:
        """First words of the windows with a shared core."""
        run, name, _ = self.cores()
        lengths = np.diff(np.append(run, len(self.window)))
        return self.window[np.repeat(np.isin(name.view(np.int64), shared), lengths)]


def _text_key(text: bytes | None) -> int | None:
    """The first 64 bits of a text's digest, which tell the texts of one doc_id apart."""
    return None if text is None else int.from_bytes(md5(text).digest()[:8], "big", signed=True)


def _columns(side: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, set]:
    # Nulls are filled, as numpy would make floats of the other numbers.
    kind, a, b = (pc.fill_null(side.column(c), 0).to_numpy() for c in ("kind", "a", "b"))
    return kind, a, b, set(zip(a[kind == _COPY].tolist(), b[kind == _COPY].tolist(), strict=True))


def _ids(ids: list, at: np.ndarray) -> pa.Array:
    return pa.array([ids[i] for i in at], pa.int64())


def remove_repeats(docs: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, spans (first word, words) removed, of every document."""
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    whole = stored(body.select("doc_id", F.unhex(F.md5("text")).alias("digest"), F.octet_length("text").alias("bytes")), "whole-texts")
    size = whole.agg(F.sum("bytes")).first()[0] or 0
    groups = max(size // group_bytes + 1, 2 * docs.sparkSession.sparkContext.defaultParallelism)
    group = F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("g")
    dealt = body.select(group, "doc_id", "text")
    first = whole.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("first < last").drop("last")
    copies = cut_lineage(join_counted(whole, stored(first, "copied-texts"), "digest").filter("doc_id > first").select("doc_id", "digest").distinct()).select(
        group, F.lit(_COPY).alias("kind"), F.col("doc_id").alias("a"),
        F.conv(F.substring(F.hex("digest"), 1, 16), 16, -10).cast("long").alias("b"))

    def name_cores(key: tuple, table: pa.Table, side: pa.Table) -> pa.Table:
        _, name, where = _Group(table, window, _columns(side)[3]).cores()
        order = np.argsort(name)
        name, where = name[order].view(np.int64), where[order]
        new = np.nonzero(np.append(True, name[1:] != name[:-1])[:len(name)])[0]
        places = np.ones(len(new), np.int32)
        if len(new):
            places += np.minimum.reduceat(where, new) != np.maximum.reduceat(where, new)
        return pa.table({"g": pa.array(np.full(len(new), key[0].as_py()), pa.int64()), "name": name[new], "n": places})

    def digest_windows(key: tuple, table: pa.Table, side: pa.Table) -> pa.Table:
        kind, a, _, copies = _columns(side)
        group = _Group(table, window, copies)
        at = group.flagged(a[kind == _CORE])
        view, starts, ends = group.words.joined()
        digests = byte_digests(view, starts[at], ends[at + window - 1])
        document = group.document(at)
        return pa.table({"high": digests[:, 0], "low": digests[:, 1], "doc_id": _ids(group.ids, document),
                         "start": at - group.first[document], "key": np.where(group.varied()[document], digests[:, 0] | 1, 0)})

    def cut(key: tuple, table: pa.Table, side: pa.Table) -> pa.Table:
        kind, a, b, copies = _columns(side)
        known = side.column("a").is_valid().to_numpy()
        group = _Group(table, window, copies)
        at = group.flagged(a[kind == _CORE])
        view, starts, ends = group.words.joined()
        # Places of the first windows, in every row of their document that has them.
        rows: dict = {}
        for i, key_ in enumerate(group.ids):
            rows.setdefault(key_, []).append(i)
        first = kind == _FIRST
        of = side.column("key").to_numpy()[first]
        stay = [group.first[r] + s for i, s, ok in zip(a[first].tolist(), b[first].tolist(), known[first].tolist(), strict=True)
                for r in rows[int(i) if ok else None]]
        if of.any():  # texts differ under one id
            keys = [k for i, ok, k in zip(a[first].tolist(), known[first].tolist(), of.tolist(), strict=True)
                    for _ in rows[int(i) if ok else None]]
            doc = np.array([r for i, ok in zip(a[first].tolist(), known[first].tolist(), strict=True)
                            for r in rows[int(i) if ok else None]], np.int64)
            place, keys = np.array(stay, np.int64), np.array(keys, np.int64)
            fine = (keys == 0) | (place + window <= group.first[doc + 1])
            test = np.nonzero(fine & (keys != 0))[0]
            fine[test] = byte_digests(view, starts[place[test]], ends[place[test] + window - 1])[:, 0] | 1 == keys[test]
            stay = place[fine]
        at = np.setdiff1d(at, np.array(stay, np.int64), assume_unique=False)
        count = len(group.words.starts)
        cover = np.bincount(at, minlength=count + 1)[:count + 1] - np.bincount(at + window, minlength=count + 1)[:count + 1]
        gone = np.cumsum(cover[:count]) > 0
        sizes = np.diff(group.first)
        gone |= np.repeat(group.copy & (sizes >= window), sizes)
        removed = np.diff(np.append(0, np.cumsum(gone))[group.first])
        edge = np.ones(count + 1, bool)
        edge[1:-1] = gone[1:] != gone[:-1]
        edge[group.first] = True
        edges = np.nonzero(edge)[0]  # stretches of words that stay or go together, within a document
        kept, spans = [[] for _ in group.ids], [[] for _ in group.ids]
        for o, c, document in zip(edges[:-1].tolist(), edges[1:].tolist(), group.document(edges[:-1]).tolist(), strict=True):
            if gone[o]:
                spans[document].append({"first": o - int(group.first[document]), "words": c - o})
            else:
                kept[document].append(view[starts[o]:ends[c - 1]])
        return pa.table({"doc_id": _ids(group.ids, np.arange(len(kept))), "n_words": sizes, "n_removed": removed,
                         "kept_text": pa.array([b" ".join(k) for k in kept], pa.binary()).cast(pa.string()),
                         "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])))})

    names = dealt.groupBy("g").cogroup(copies.groupBy("g")).applyInArrow(name_cores, "g long, name long, n int")
    # A group reports a name once, so no partition gets more rows of a name than there are groups.
    total = F.expr("sum(n) OVER (PARTITION BY name)")
    shared = names.withColumn("total", total).filter("total > 1").select(
        "g", F.lit(_CORE).alias("kind"), F.col("name").alias("a"), F.lit(0).cast("long").alias("b"))
    side = stored(shared.union(copies), "shared-cores")
    digests = dealt.groupBy("g").cogroup(side.groupBy("g")).applyInArrow(
        digest_windows, "high long, low long, doc_id long, start long, key long")
    # A key other than 0 names the window, as it stands in some rows of its doc_id only.
    firsts = digests.groupBy("high", "low").agg(F.min(F.struct("doc_id", "start", "key")).alias("f")).select("f.*").select(
        group, F.lit(_FIRST).alias("kind"), F.col("doc_id").alias("a"), F.col("start").alias("b"), "key")
    firsts = stored(firsts, "first-windows")
    return dealt.groupBy("g").cogroup(side.withColumn("key", F.lit(0).cast("long")).union(firsts).groupBy("g")).applyInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<first: long, words: long>>")
