"""The pipeline: stages keep the columns, act on what came before, and lose no clean document."""
import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from packetloom.llm import mixing, quality
from test_documents_ops import chunks

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF).cache()
        seen[name] = kept
        if name != "packing":
            assert kept.columns == columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = seen["quality"].join(labels.filter("quality = 1"), "doc_id").count()
    assert good >= 0.97 * docs.join(labels.filter("quality = 1"), "doc_id").count()
    assert seen["line_dedup"].agg(F.sum("n_chars")).first()[0] < seen["quality"].agg(F.sum("n_chars")).first()[0]
    assert seen["near_dedup"].count() < seen["line_dedup"].count()
    copies = Counter(r.doc_id for r in seen["mixing"].select("doc_id").collect())
    pieces = Counter(r.doc_id for r in seen["packing"].filter("piece = 0").select("doc_id").collect())
    assert copies == pieces and max(copies.values()) <= 3


def test_no_line_of_a_copied_text_stays(spark):
    texts = ["\n".join(f"text {n} line {k}" for k in range(n)) for n in range(2, 60)]
    passage = "\n".join(f"passage {k}" for k in range(40))
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts)] + [
        (200, passage), (201, f"own first\nown second\n{passage}\nown third\nown fourth")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, SF).collect()}
    assert {i: t for i, t in kept.items() if i < 100} == dict(enumerate(texts))
    assert sorted(i for i in kept if i >= 100) == [200, 201]
    # Chunks cross the edges of a passage; inside it no line stays.
    assert "own first" in kept[201] and "own fourth" in kept[201] and not any(
        f"passage {k}\n" in kept[201] for k in range(15, 25))


def test_stages_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some text\nof lines\nhere", "en", "a", 9), (3, "x\ny\nz", None, "b", 5),
            (3, "x\ny\nz", None, "b", 5), (4, "x\ny\nz", None, "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(
        {"score": F.lit(1), "_gone": F.lit(2), "n_removed": F.lit(3)})
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() is not None
    kept = corpus_pipeline.lines(spark, docs.drop("score", "_gone", "n_removed"), SF)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 3]


def test_near_copies_leave_one_and_clean_texts_stay(spark):
    """A large group of near copies beside unrelated texts, and ids that repeat."""
    rnd = random.Random(2)
    say = lambda n: [f"w{rnd.randrange(10 ** 6)}" for _ in range(n)]
    base = say(120)
    copies = []
    for _ in range(1000):
        words = list(base)
        for k in (rnd.randrange(60), 60 + rnd.randrange(60)):
            words[k] = say(1)[0]
        copies.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(copies)] + [(2000 + i, " ".join(say(120))) for i in range(1000)]
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = sorted(r.doc_id for r in corpus_pipeline.near(spark, make(rows), SF).collect())
    assert kept == [0, *range(2000, 3000)]
    clean, other, third = (" ".join(say(120)) for _ in range(3))
    copies = [" ".join([*base[:20 * k + 9], "changed", *base[20 * k + 10:]]) for k in range(5)]
    rows = [(1, copies[0]), (1, copies[0]), (1, clean), (2, copies[1]), (2, other), (2, other), (3, clean), (4, None), (4, None), (4, third),
            (None, copies[2]), (5, copies[3]), (5, copies[4])]
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.near(spark, make(rows), SF).collect())
    assert kept == Counter([(1, copies[0]), (1, clean), (2, other), (4, None), (4, third), (None, copies[2])])


def test_run_equals_stages_in_plain_python(spark, tmp_path):
    """All of ``run`` beside a brute-force version; scores come from the operator, whose model is tested apart."""
    rnd = random.Random(9)
    say = lambda n: " ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(n))
    lines = lambda n: "\n".join(say(8) + "." for _ in range(n))
    passage = lines(12)
    rows = [(i, lines(rnd.randint(3, 20)), "en", "ab"[i % 2]) for i in range(120)]
    rows += [(200 + i, rows[i][1], "en", "c") for i in range(10)]
    rows += [(300 + i, rows[i][1].replace(" ", " x ", 1), "en", "c") for i in range(20, 30)]
    rows += [(400 + i, lines(4) + "\n" + passage + "\n" + lines(4), "en", "a") for i in range(10)]
    rows += [(500 + i, "%% ## !! " * (5 + i), "en", "b") for i in range(60)]
    rows += [(600, "", "en", "a"), (601, None, "en", "b")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 500)) for i, *_ in rows if i < 600], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    found = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    scored = {r.doc_id: r.score for r in quality.classify(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()}
    texts = {i: t for i, t, *_ in rows if scored[i] >= quality.THRESHOLD}
    assert sum(i in texts for i in range(500)) > 140 and not any(500 <= i < 560 for i in texts)
    first = {}
    for i, t in sorted(texts.items()):
        for start, chunk in chunks(t) if t is not None else ():
            first.setdefault("\n".join(chunk), (i, start))
    left = {}
    for i, t in texts.items():
        if t is None:
            left[i] = t
            continue
        kept = [x for s, c in chunks(t) for x in c if len(c) == 1 or first["\n".join(c)] == (i, s)]
        if kept:
            left[i] = "\n".join(kept)

    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()

    sets, parent = {i: shingles(t) for i, t in left.items()}, {i: i for i in left}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    source = {i: s for i, _, _, s in rows}
    alone = {i: t for i, t in left.items() if top(i) == i}
    assert len(alone) < len(left) < len(texts)
    frame = spark.createDataFrame([(i, t, source[i]) for i, t in alone.items()], "doc_id long, text string, source string")
    copies = {r.doc_id: r.copies for r in mixing.mixing_plan(frame).collect()}
    tokenizer, expected = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for i, t in alone.items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at:at + 4096], "<u4").tobytes()
            expected[(i, piece, at, len(part) // 4, zlib.crc32(part))] += copies[i]
    assert found == +expected and sum(found.values()) > 100
