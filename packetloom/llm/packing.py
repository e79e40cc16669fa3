"""Best-fit packing of token sequences, planned on a histogram of lengths.

Texts are tokenized in tasks; a document's ids and one end id are cut into
pieces of at most ``capacity`` ids. Best fit, longest first, then runs on the
driver over counts: at most ``capacity`` lengths, each placed on whole ranges
of open sequences with the same room left. A range is split in at most three
by the last placement of a length and its room at least halves with every
other one, so the plan has at most about 40 times ``capacity`` entries however
many documents there are. Pieces then take planned places by their rank within
their length.

Defined cases: a null or empty text is its end id alone; equal rows are packed
each for itself; an empty table gives no rows. Only the id and text columns
are read.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.support import LOWER, WordTable, text_slices
from packetloom.operators.telemetry import number_rows
from packetloom.session import cut_lineage

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
# The ids of stems and marks are kept per worker, up to this many.
CACHED = 600_000
CACHED_BYTES = 40
BATCH_WORDS = 200
# Written between parts that are encoded together; it is one token, and parts that hold it go alone.
SEPARATOR = b"\x01"
TAIL = b".,!?%&#$*"
TAIL_BYTES = 16
_CODERS: dict[str, WordCoder] = {}
_IS_TAIL, _IS_ALNUM, _IS_MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_IS_TAIL[list(TAIL)] = True
_IS_ALNUM[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_IS_MARK[[0xCC, 0xCD]] = True  # first bytes of combining marks
# Letters of the usual alphabets that normalising leaves as they are.
_PLAIN = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_PLAIN_WORD = re.compile(f"[{_PLAIN}]+")

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def _two_byte_letters() -> np.ndarray:
    """Of each code point below 2048 whether it is a Latin, Greek or Cyrillic letter, after normalising, too."""
    normal = [unicodedata.normalize("NFC", chr(c)).lower() for c in range(2048)]
    return np.array([c >= 128 and last < "\u0530" and last[-1:].isalpha() for c, last in enumerate(normal)])


_IS_LETTER = _two_byte_letters()


class WordCoder:
    """Ids of words and parts of words, by the tokenizer, as little-endian 32-bit numbers.

    The tokenizer normalises, lower-cases and splits inside words only, so a
    text's ids are its words' ids in turn. It also splits letters from marks:
    a word is looked up as a stem that ends in a letter or digit, and the
    marks behind it (``word_parts``). Words of plain letters pass its steps
    before the merges unchanged, so these are left out for them.
    """

    def __init__(self, name: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers
        path = name if os.path.isabs(name) else public_tokenizers.path(name)
        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        bytes_only = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        normalizer, split = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.has_plain = (normalizer is None or normalizer.normalize_str(_PLAIN) == _PLAIN) and (
            split is not None and split.pre_tokenize_str(_PLAIN) == bytes_only.pre_tokenize_str(_PLAIN))
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytes_only])
        self.known: dict[bytes, bytes] = {}

    def alone(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def together(self, words: list[bytes], tokenizer) -> Iterator[bytes]:
        """Ids of many words that do not hold the separator."""
        separator = tokenizer.encode(SEPARATOR.decode(), add_special_tokens=False).ids
        if len(separator) != 1:
            raise ValueError("the separator is not one token")
        join = b" " + SEPARATOR + b" "
        texts = [join.join([*words[i:i + BATCH_WORDS], b""]).decode() for i in range(0, len(words), BATCH_WORDS)]
        for coded in tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(coded.ids, "<u4")
            raw, start = ids.tobytes(), 0
            for end in (4 * np.nonzero(ids == separator[0])[0]).tolist():
                yield raw[start:end]
                start = end + 4

    def learn(self, words: list[bytes]) -> None:
        """Make words known."""
        plain, other = [], []
        for word in words:
            if self.has_plain and (word.isalpha() and word.islower() or not word.isascii() and _PLAIN_WORD.fullmatch(word.decode())):
                plain.append(word)
            elif b"<|" in word or SEPARATOR in word:  # may be a special token
                self.known[word] = self.alone(word)
            else:
                other.append(word)
        self.known.update(zip(plain, self.together(plain, self.plain), strict=True))
        self.known.update(zip(other, self.together(other, self.tokenizer), strict=True))

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of the distinct ``words``."""
        if len(self.known) > CACHED:
            self.known.clear()
        new = [word for word in words if word not in self.known]
        self.learn(new)
        coded = list(map(self.known.__getitem__, words))
        for word in new:
            if len(word) > CACHED_BYTES:
                del self.known[word]
        return coded


def word_parts(table: WordTable) -> None:
    """Lower the letters A to Z of a table's words, and part the marks at their ends from them.

    Words that may hold special tokens or combining marks, which change with
    the letters before them, are left as they are.
    """
    raw, starts, ends = table.bytes, table.starts, table.ends
    special = np.nonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")) | _IS_MARK[raw[:-1]])[0]
    whole = np.unique(np.searchsorted(starts, special, side="right") - 1)
    low = LOWER[raw]
    for a, b in zip(starts[whole].tolist(), ends[whole].tolist(), strict=True):
        low[a:b] = raw[a:b]
    stem = ends.copy()
    at = np.nonzero(_IS_TAIL[low[ends - 1]])[0]
    for _ in range(TAIL_BYTES):
        stem[at] -= 1
        at = at[stem[at] > starts[at]]
        at = at[_IS_TAIL[low[stem[at] - 1]]]
        if not len(at):
            break
    stem[at] = ends[at]
    stem[whole] = ends[whole]
    cut = np.nonzero((stem < ends) & (stem > starts))[0]
    last, before = low[stem[cut] - 1], low[np.maximum(stem[cut] - 2, starts[cut])]
    letter = (before >> 5 == 6) & (last >> 6 == 2) & _IS_LETTER[(before & 31).astype(np.int64) << 6 | last & 63]
    cut = cut[_IS_ALNUM[last] | letter]
    # Part p of a word with marks is its stem, part p + 1 the marks.
    number = np.zeros(len(starts) + 1, np.int64)
    number[1:] = 1
    number[cut + 1] = 2
    number = np.cumsum(number)
    table.bytes, table.first = low, number[table.first]
    table.starts, table.ends = np.repeat(starts, np.diff(number)), np.repeat(ends, np.diff(number))
    table.starts[number[cut] + 1] = table.ends[number[cut]] = stem[cut]


def text_ids(coder: WordCoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where each text's ids start; distinct parts of words are encoded once."""
    table = WordTable(texts)
    word_parts(table)
    _, sample, word = np.unique(table.hashes(), return_index=True, return_inverse=True)
    view = table.bytes.tobytes()
    coded = coder.encode([view[a:b] for a, b in zip(table.starts[sample].tolist(), table.ends[sample].tolist(), strict=True)])
    sizes = np.array([len(c) >> 2 for c in coded], np.int64)
    known = np.frombuffer(b"".join(coded), "<u4")
    before = np.cumsum(sizes) - sizes
    counts = sizes[word]
    ends = np.cumsum(counts)
    ids = known[np.arange(ends[-1] if len(ends) else 0) + np.repeat(before[word] - (ends - counts), counts)]
    return ids, np.concatenate([[0], ends])[table.first]


def word_coder(name: str) -> WordCoder:
    """The worker's coder for a tokenizer file."""
    if name not in _CODERS:
        _CODERS[name] = WordCoder(name)
    return _CODERS[name]


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID,
                 keep_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids of every piece."""
    end = np.array([end_id], "<u4").tobytes()
    schema = PIECES if keep_ids else pa.schema(list(PIECES)[:-1])

    def cut(batches):
        for batch in text_slices(batches):
            rows = []
            found, first = text_ids(word_coder(tokenizer), batch.column(1))
            for i, key in enumerate(batch.column(0).to_pylist()):
                ids = found[first[i]:first[i + 1]].tobytes() + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part), part)[:len(schema)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Places for ``counts[length]`` pieces of each length.

    Entry by entry: pieces of ``length`` from ``rank`` on fill sequences from
    ``sequence`` on, ``each`` to a sequence, the first of them at ``offset``.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    open_rooms, sequences = 0, 0
    entries = []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            fitting = open_rooms >> length
            if fitting:
                free = length + (fitting & -fitting).bit_length() - 1
                first, many = room[free].pop()
                if not room[free]:
                    open_rooms ^= 1 << free
            else:
                free = capacity
                first, many = sequences, -(-left // (capacity // length))
                sequences += many
            each = free // length
            full = min(many, left // each)
            last = min(left - full * each, each) if full < many else 0
            entries.append((length, rank, first, each, capacity - free))
            for start, number, rest in ((first, full, free - each * length),
                                        (first + full, int(last > 0), free - last * length),
                                        (first + full + (last > 0), many - full - (last > 0), free)):
                if number and rest:
                    room.setdefault(rest, []).append((start, number))
                    open_rooms |= 1 << rest
            rank += full * each + last
            left -= full * each + last
    table = np.array(sorted(entries), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "each", "offset"), table.T, strict=True))


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID,
         keep_ids: bool = False, **columns) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``."""
    pieces = cut_lineage(token_pieces(docs, tokenizer, capacity, end_id, keep_ids, **columns))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_fit_plan(counts, capacity)
    before, total = np.zeros(capacity + 2, np.int64), 0
    for length in sorted(counts):
        before[length], total = total, total + counts[length]
    numbered = number_rows(pieces, "_n", "length", "doc_id", "piece")
    shared = docs.sparkSession.sparkContext.broadcast((plan, before))
    names = [c for c in numbered.columns if c != "_n"]

    def place(batches):
        plan, before = shared.value
        keys = plan["length"] << 40 | plan["rank"]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_n").to_numpy() - 1 - before[length]
            entry = np.searchsorted(keys, length << 40 | rank, side="right") - 1
            nth = rank - plan["rank"][entry]
            each = plan["each"][entry]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(plan["sequence"][entry] + nth // each),
                                                    pa.array(plan["offset"][entry] + nth % each * length)],
                names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema if f.name != "_n")
    return numbered.mapInArrow(place, f"{kinds}, sequence_id long, offset long")
