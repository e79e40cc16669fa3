"""The document operators against plain Python on a small corpus, with the edge cases their docstrings define."""
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from packetloom.llm import fingerprints, line_dedup, mixing, near_dedup, packing, quality, sharding, substring_dedup
from packetloom.llm.support import stored


def words_of(text):
    return (text or "").encode().split()


def with_clashes(docs):
    """Extra columns named as the operators name their own."""
    names = ["_id", "size", "n_lines", "n_removed", "copies", "score", "shard", "kept", "g", "a", "nth", "c0", "_gone"]
    return docs.withColumns({n: F.lit("x") for n in names})


# --- line dedup -----------------------------------------------------------
def chunks(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    start, last = 0, None
    for i in range(len(lines)):
        wanted = i > 1 and (h[i - 2] * 961 + h[i - 1] * 31 + h[i]) % 1000003 % 3 == 0 and last != i - 1
        if wanted:
            last = i
        if i == len(lines) - 1 or (wanted and i < len(lines) - 2):
            yield start, lines[start:i + 1]
            start = i + 1


def test_line_dedup(docs, corpus):
    first = {}
    for i, text, *_ in corpus:
        for start, lines in chunks(text) if text is not None else ():
            key = "\n".join(lines)
            at = (i is not None, i or 0, start)
            first[key] = min(first.get(key, at), at)
    expected = Counter()
    for i, text, *_ in corpus:
        kept, n = [], 0
        for start, lines in chunks(text) if text is not None else ():
            gone = len(lines) > 1 and first["\n".join(lines)] != (i is not None, i or 0, start)
            kept += [] if gone else lines
            n += len(lines)
        expected[(i, None if text is None else "\n".join(kept), n, n - len(kept))] += 1
    found = line_dedup.dedup_lines(with_clashes(docs))
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in found.collect()) == expected
    assert sum(r[3] for r in expected) > 100
    assert found.columns.count("n_lines") == 1 and "copies" in found.columns


def test_lines_of_one_id_and_of_long_texts(spark):
    """Different texts of one id have their own chunks; whole copies leave no line; time grows with the lines."""
    say = lambda name, n: "\n".join(f"{name} {k}" for k in range(n))
    long = say("long", 200_000)
    rows = [(1, say("a", 9)), (2, say("b", 12)), (2, say("a", 9)), (3, long), (4, long), (5, say("a", 9)), (6, "one line"), (7, "one line"),
            (None, say("c", 5)), (8, say("c", 5)), (None, say("d", 4))]
    started = time.time()
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert time.time() - started < 60
    gone = {(2, 9), (4, 200_000), (5, 9), (8, 5)}
    assert sorted((r.doc_id or 0, r.n_lines, r.n_removed) for r in found) == sorted(
        (i or 0, n, n if (i, n) in gone else 0) for i, t in rows for n in [len(t.split("\n"))])
    assert all(r.text == "" for r in found if r.n_removed)


# --- sharding -------------------------------------------------------------
@pytest.mark.parametrize("limit", [2000, 1 << 30])
def test_sharding(docs, corpus, limit):
    rows = sharding.assign_shards(with_clashes(docs), limit).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, *_ in corpus)
    size = {i: len((t or "").encode()) for i, t, *_ in corpus}
    total = Counter()
    for r in rows:
        assert r.bytes == size[r.doc_id]
        total[r.shard] += r.bytes
    prefixes = [r.shard for r in rows if not r.oversized]
    for r in rows:
        assert r.shard_bytes == total[r.shard]
        assert r.oversized == (r.bytes > limit) and (r.oversized or total[r.shard] <= limit)
        # Only oversized buckets split: the prefix one bit shorter is too large.
        if not r.oversized and r.depth:
            above = r.shard[:-1]
            assert sum(total[s] for s in set(prefixes) if s.startswith(above)) > limit
    assert len(total) == 1 if limit > 2000 else len(total) > 5


def test_shards_are_written(docs, tmp_path):
    given = with_clashes(docs)
    sharding.write_shards(given, str(tmp_path / "s"), 2000)
    again = docs.sparkSession.read.parquet(str(tmp_path / "s"))
    rows = lambda df: Counter(map(tuple, df.select("doc_id", "text", "source", "size").collect()))
    assert rows(again) == rows(given) and again.select("_shard").distinct().count() > 5


def test_repeated_rows_are_split(spark, tmp_path):
    """Rows of one id share 60 bits of their address; each goes to one shard all the same."""
    rows = spark.createDataFrame([(1, "x" * 10)] * 40 + [(i, "y" * 10) for i in range(2, 30)], "doc_id long, text string")
    found = sharding.assign_shards(rows, 25).collect()
    assert len(found) == 68 and max(r.shard_bytes for r in found) <= 25
    assert min(r.depth for r in found if r.doc_id == 1) > sharding.HASH_BITS > max(r.depth for r in found if r.doc_id > 1)
    sharding.write_shards(rows, str(tmp_path / "s"), 25)
    sizes = spark.read.parquet(str(tmp_path / "s")).groupBy("_shard").agg(F.sum(F.length("text")).alias("n"), F.count("*").alias("rows")).collect()
    assert sum(r.rows for r in sizes) == 68 and max(r.n for r in sizes) <= 25


# --- substring dedup ------------------------------------------------------
def test_substring_dedup(docs, corpus):
    first = {}
    for i, text, *_ in corpus:
        w = words_of(text)
        for k in range(len(w) - 19):
            key, at = tuple(w[k:k + 20]), (i is not None, i or 0, k)
            first[key] = min(first.get(key, at), at)
    expected = Counter()
    for i, text, *_ in corpus:
        w = words_of(text)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if first[tuple(w[k:k + 20])] != (i is not None, i or 0, k):
                gone[k:k + 20] = [True] * 20
        expected[(i, len(w), sum(gone), " ".join(x.decode() for x, g in zip(w, gone, strict=True) if not g))] += 1
    found = substring_dedup.remove_repeats(with_clashes(docs), group_bytes=20_000).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found) == expected
    assert sum(1 for r in expected if r[2]) > 20
    assert all(sum(s["words"] for s in r.spans) == r.n_removed for r in found)


def test_substring_dedup_of_long_documents(spark):
    """Documents of more words than are named at once, alone and last in a group."""
    long = " ".join(f"w{i}" for i in range(200_000))
    repeat = " ".join(f"w{i}" for i in range(150_000, 150_100))
    for rows in ([(1, long)], [(i, "a few words") for i in range(5)] + [(5, long)], [(1, repeat), (2, long)]):
        group = substring_dedup._Group(pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}), 20)
        assert sorted(group.windows()[0][-199_981:] - group.first[-2]) == list(range(199_981))
        found = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
        gone = 100 if rows[0][1] == repeat else 0
        assert sorted((r.doc_id, r.n_words, r.n_removed) for r in found) == [
            (i, len(t.split()), gone if t == long else 0) for i, t in rows]


def test_substring_dedup_of_texts_under_one_id(spark):
    """A text is judged by its own windows, whatever other rows of its id hold."""
    say = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    copied, own, other, head = say("c", 40), say("o", 40), say("p", 60), say("h", 30)
    big = (1 << 60) + 1
    rows = [(1, copied), (2, copied), (2, own), (3, own), (4, other), (5, head + " " + say("x", 40)), (5, head + " " + other), (5, "short"),
            (6, say("x", 40)), (7, copied), (7, None), (None, say("n", 50)), (None, other), (big, say("n", 50)), (big, say("y", 30)), (big, own)]
    first, expected = {}, Counter()
    for i, text in rows:
        w = words_of(text)
        for k in range(len(w) - 19):
            key, at = tuple(w[k:k + 20]), (i is not None, i or 0, k)
            first[key] = min(first.get(key, at), at)
    for i, text in rows:
        w = words_of(text)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if first[tuple(w[k:k + 20])] != (i is not None, i or 0, k):
                gone[k:k + 20] = [True] * 20
        expected[(i, len(w), " ".join(x.decode() for x, g in zip(w, gone, strict=True) if not g))] += 1
    assert expected[(2, 40, own)] == 1 and expected[(2, 40, "")] == 1
    found = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.n_words, r.kept_text) for r in found) == expected


# --- quality --------------------------------------------------------------
def test_quality(spark):
    rows = [(i, ("good words in a row. " if i % 3 else "BAD!! %%% ### ") * (1 + i % 17)) for i in range(600)] + [
        (600, None), (601, ""), (7, "good words again. ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(500)] + [(3, None), (None, 1), (9999, 1)],
                                   "doc_id long, quality int")
    found = quality.classify(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == (r.score >= 0.3)
        if r.doc_id < 600 and r.doc_id != 7:
            assert r.predicted == int(r.doc_id % 3 > 0)
    # Held-out labels are never learnt from: turning them over changes nothing.
    turned = spark.createDataFrame([(i, int(i % 3 > 0) if zlib.crc32(str(i).encode()) % 5 else int(i % 3 == 0)) for i in range(500)],
                                   "doc_id long, quality int")
    other = {(r.doc_id, round(r.score, 9)) for r in quality.classify(docs, turned).collect()}
    assert other == {(r.doc_id, round(r.score, 9)) for r in found}


def test_isotonic_is_monotone():
    x, y = quality.isotonic(np.arange(6.0), np.array([0, 0.5, 0.2, 0.4, 1, 0.9]), np.ones(6))
    assert list(y) == sorted(y) and np.isclose(y[list(x).index(1.0)], (0.5 + 0.2) / 2)


def test_without_labels_scores_are_even(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}


# --- fingerprints ---------------------------------------------------------
def tree(text):
    """Paragraphs as (digest, grains), by plain Python."""
    grain = lambda g: f"{xxhash.xxh64_intdigest(g.encode(), 42) >> 32:08X}"
    return [(hashlib.md5(p.encode()).hexdigest()[:12], [grain(g) for g in re.findall(r"[^.!?\n]{1,24}[.!?]*", p)]) for p in text.split("\n")]


def written(fingerprint):
    """The paragraphs that a fingerprint spells out."""
    paragraphs = [p for s in fingerprint.split("/")[1].split(";") for p in s.split("=")[1].split(",")]
    return [(p.split(":")[0], re.findall("." * 8, p.split(":")[1])) for p in paragraphs]


def alike(a, b):
    """Likeness of two fingerprints by their strings alone."""
    if a.split("/")[0] == b.split("/")[0]:
        return 1.0
    a, b = ({g for _, grains in written(x) for g in grains} for x in (a, b))
    return len(a & b) / max(len(a), len(b)) if a or b else 0.0


def test_fingerprints(docs, corpus):
    by_id = defaultdict(list)
    for i, text, *_ in corpus:
        by_id[i].append(text or "")
    ids = sorted(i for i in by_id if i is not None)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    rows = fingerprints.fingerprint_edits(with_clashes(docs)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, *_ in corpus)
    prints, near_e, near_n = {}, [], []
    own = {r.doc_id: r.fingerprint for r in rows}
    for r in rows:
        texts = by_id[r.doc_id]
        text = texts[0]
        if len(set(texts)) == 1:
            head = min(by_id[after[r.doc_id]]) if r.doc_id is not None else ""
            half = len(text) // 2
            edited = text[:len(text) - half] + head[:half]
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert (r.fingerprint == r.edited_fingerprint) == (edited == text)
            assert prints.setdefault(r.fingerprint, text) == text
            assert written(r.fingerprint) == tree(text) and written(r.edited_fingerprint) == tree(edited)
            assert r.near_edited == pytest.approx(alike(r.fingerprint, r.edited_fingerprint))
            if r.doc_id is not None and len(set(by_id[after[r.doc_id]])) == 1:
                assert r.near_next == pytest.approx(alike(r.fingerprint, own[after[r.doc_id]]))
            left = {d for d, _ in tree(edited)}
            assert r.edited_paragraphs == list(dict.fromkeys(d for d, _ in tree(text) if d not in left))
            if half > 60 and r.doc_id != 6:
                near_e.append(r.near_edited)
                near_n.append(r.near_next)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(set(prints.values())) == len(prints)
    assert np.mean(near_e) > 0.25 > 0.1 > np.median(near_n)


def test_edited_paragraphs(spark):
    lines = [f"paragraph {i} of the text" for i in range(40)]
    changed = lines[:17] + ["another one"] + lines[18:]
    df = spark.createDataFrame([("\n".join(lines), "\n".join(changed))], "a string, b string")
    df = fingerprints.with_tree(fingerprints.with_tree(df, "a", "x"), "b", "y")
    found = df.select(fingerprints.edited_paragraphs(F.col("x_print"), F.col("y_print")).alias("e")).first().e
    assert found == [hashlib.md5(lines[17].encode()).hexdigest()[:12]]


# --- near duplicates ------------------------------------------------------
def test_near_duplicates(docs, corpus):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])

    sets = {i: shingles(t) for i, t, *_ in corpus if i is not None}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = 0
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
                links += 1
    assert links > 20
    for r in near_dedup.near_duplicates(with_clashes(docs)).collect():
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), top(r.doc_id), top(r.doc_id) == r.doc_id)


def test_long_chains_of_links(spark):
    """Neighbours are alike, ends are not; no document is like all others."""
    rows = [(i, " ".join(f"w{k}" for k in range(3 * i, 3 * i + 60))) for i in range(60)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in found} == {0}


def test_components_of_random_graphs(spark):
    rnd = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rnd.integers(0, 300, (220, 2)) if a != b]
    parent = list(range(300))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: top(i) for e in edges for i in e if top(i) != i}


@pytest.mark.parametrize(("rows", "most"), [(1 << 18, 1), (20, 3)])
def test_files_of_components_follow_rows(spark, monkeypatch, rows, most):
    """Not the partitions of a shuffle, of which there are four here."""
    files = []

    def counted(df, name):
        df = stored(df, name)
        files.append(len(df.inputFiles()))
        return df

    monkeypatch.setattr(near_dedup, "stored", counted)
    monkeypatch.setattr(near_dedup, "FILE_ROWS", rows)
    merged = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(merged)
    spark.conf.set(merged, "false")
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
        found = {r.node: r.component for r in counted(near_dedup.components(edges), "groups").collect()}
    finally:
        spark.conf.set(merged, before)
    assert found == dict.fromkeys(range(1, 51), 0)
    assert len(files) > 2 and max(files) == most


def test_blocks_are_bounded_by_shingles(spark):
    members = spark.range(600).selectExpr("1L AS bucket", "id AS doc_id", "50000L AS n")
    none = spark.createDataFrame([], "node long, component long")
    dealt = near_dedup._dealt(members, none)
    tasks = dealt.groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    assert max(r.n for r in tasks) < 3 * near_dedup.BLOCK_SHINGLES < 600 * 50000
    # Every two members meet.
    own = {r.doc_id: r.own for r in dealt.collect()}
    assert {(r.i, r.j) for r in tasks} == {(a, b) for a in set(own.values()) for b in set(own.values()) if a <= b}


# --- mixing ---------------------------------------------------------------
def test_mixing(docs, corpus):
    size = Counter()
    for _, t, _, s, _ in corpus:
        size[s] += len(words_of(t))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        free = sum(weight[s] for s in size if s not in capped)
        level = Fraction(total - 3 * sum(size[s] for s in capped), free) if free else 0
        new = {s for s in size if s not in capped and weight[s] * level > 3 * size[s]}
        if not new:
            break
        capped |= new
    rows = mixing.mixing_plan(with_clashes(docs)).collect()
    assert Counter((r.doc_id, r.source) for r in rows) == Counter((i, s) for i, _, _, s, _ in corpus)
    taken, most = Counter(), Counter()
    for r in rows:
        target = 3 * size[r.source] if r.source in capped else weight[r.source] * level
        assert r.source_size == size[r.source] and r.target == pytest.approx(float(target))
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        most[r.source] = max(most[r.source], r.size)
    for s in size:
        target = 3 * size[s] if s in capped else float(weight[s] * level)
        assert abs(taken[s] - target) <= 3 * most[s]
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixing_plan(docs.repartition(3)).collect()))
    mixed = mixing.mix_documents(with_clashes(docs))
    assert Counter(mixed.select("doc_id").toPandas().doc_id.fillna(-1).astype(int)) == +Counter(
        {k: v for k, v in (Counter() + sum((Counter({-1 if r.doc_id is None else r.doc_id: r.copies}) for r in rows), Counter())).items()})


# --- packing --------------------------------------------------------------
def test_packing(docs, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter()
    for i, t, *_ in corpus:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at:at + 4096], "<u4").tobytes()
            expected[(i, piece, at, len(part) // 4, zlib.crc32(part))] += 1
    rows = packing.pack(with_clashes(docs)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    check_places(rows, 4096)
    kept = packing.pack(docs, keep_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in kept)


def check_places(rows, capacity):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(r.length for r in rows) // capacity)
    assert len(places) <= least * 1.1 + 1


def test_plan_is_best_fit_and_bounded():
    rnd = np.random.default_rng(1)
    counts = Counter(np.minimum(4096, rnd.lognormal(6, 1.2, 200_000).astype(int) + 1).tolist())
    plan = packing.best_fit_plan(counts)
    assert len(plan["rank"]) < 40 * 4096
    used = sum(k * v for k, v in counts.items())
    last = int((plan["sequence"]).max())
    assert last + 1 <= -(-used // 4096) * 1.01
    assert packing.best_fit_plan({})["rank"].size == 0


def test_words_encode_as_whole_texts():
    coder = packing.word_coder(packing.TOKENIZER)
    texts = ["a <|startoftext|> b<|ENDOFTEXT|>c d'S e's.. \x01 x\x01y Ünï… “quoted”.. don't!! é... 3.14,, İ. ﬁne!!", "", "ẞẞ!! ΑΣ, ΑΣΣ.", "é!! ́, a b"]
    random.seed(4)
    ranges = [(33, 127), (160, 400), (0x370, 0x530), (0x1E00, 0x2100), (0x2010, 0x2040), (0x4E00, 0x4F00), (0xAC00, 0xAD00), (0x1F600, 0x1F640)]
    for _ in range(300):
        low, high = random.choice(ranges)
        mixed = lambda: chr(random.randrange(low, high)) if random.random() < 0.6 else random.choice("aZ9.,!'é\u0301 ")
        texts.append(" ".join("".join(mixed() for _ in range(random.randint(1, 9))) for _ in range(12)))
    ids, first = packing.text_ids(coder, pa.array([*texts, None]))
    for i, text in enumerate(texts):
        assert ids[first[i]:first[i + 1]].tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert first[-1] == first[-2] == len(ids)


def test_marks_that_join_capital_letters():
    coder = packing.word_coder(packing.TOKENIZER)
    text = "H\u0331 H\u0331ab, T\u0308!! W\u030A Y\u030A. J\u030C I\u0307 E\u0301 " + "#" * 40 + " a" + "." * 40
    assert packing.text_ids(coder, pa.array([text]))[0].tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_words_with_other_marks_are_encoded_once():
    coder = packing.WordCoder(packing.TOKENIZER)
    ids, first = packing.text_ids(coder, pa.array(["Word, word. WORD!! wordé", "word#%& wordé,,", "wordÉ?"]))
    assert set(coder.known) == {"word".encode(), "wordé".encode(), "wordÉ".encode(), b",", b".", b"!!", b"#%&", b",,", b"?"}
    assert coder.has_plain and first.tolist()[-1] == len(ids)


# --- all ------------------------------------------------------------------
@pytest.mark.parametrize("operator", [
    line_dedup.dedup_lines, sharding.assign_shards, substring_dedup.remove_repeats, fingerprints.fingerprint_edits,
    near_dedup.near_duplicates, mixing.mixing_plan, mixing.mix_documents, packing.pack])
def test_empty_tables(no_docs, operator):
    assert operator(no_docs).collect() == []


def test_quality_of_an_empty_table(spark, no_docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.classify(no_docs, labels).collect() == []
