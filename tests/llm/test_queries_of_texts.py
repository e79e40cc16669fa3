"""Lexical search, spelling variants and decontamination against plain Python."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from packetloom.llm import decontamination, lexical_search, spelling

low = lambda text: "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def items(corpus):
    """Benchmark items: parts of documents, short ones, shared windows, repeated and odd rows."""
    rnd = random.Random(9)
    texts = [t for _, t, *_ in corpus if t and len(t.split()) > 30]
    rows = []
    for i in range(25):
        words = rnd.choice(texts).split()
        at = rnd.randrange(len(words) - 20)
        rows.append((i, " ".join(words[at:at + rnd.randint(11, 40)])))
    rows += [(30, "one two"), (31, "ONE, Two"), (32, "one"), (33, ""), (34, None), (35, "!?"), (None, "x y x y"), (36, rows[0][1].upper()),
             (2, rows[2][1]), (37, "a " * 25), (38, "unknownterm anotherone"), (39, "one one two")]
    return rows


@pytest.fixture(scope="module")
def item_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS gram", "2 AS doc_id")


def brute_ranks(corpus, items, k):
    cut = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(text))
    docs = [(i, Counter(cut(t))) for i, t, *_ in corpus]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    total, length = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    texts = {}
    for i, t in items:
        if i is not None and t is not None:
            texts[i] = min(t, texts.get(i, t))
    out = []
    for item, text in texts.items():
        scores = []
        for i, c, n in docs:
            m = 25 + (75 * n * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in cut(text) if c[t])
            if score and i is not None:
                scores.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("block", [lexical_search.BLOCK_TERMS, 60])
def test_lexical_search(docs, corpus, items, item_table, block):
    found = lexical_search.lexical_search(docs, item_table, k=7, block_terms=block)
    assert sorted(map(tuple, found.collect())) == sorted(brute_ranks(corpus, items, 7))


def test_shared_sums_are_whole_sums():
    import numpy as np
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.zipf(1.3, rnd.integers(1, 60)) % 150) for _ in range(80)]
    sets += [sets[0], sets[1], np.arange(0, 150, 2)]
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    leaves = np.concatenate(sets)
    shared = lexical_search.SharedSums(rows, leaves, len(sets), 150)
    values = rnd.integers(0, 1 << 40, (150, 9))
    assert (shared.scores(values) == np.stack([values[s].sum(axis=0) for s in sets])).all()
    additions = sum(len(left) for left, _ in shared.rounds) + len(shared.nodes) - len(sets)
    assert shared.rounds and additions < 0.8 * (len(rows) - len(sets))


def test_search_of_nothing(spark, docs, no_docs, item_table):
    none = spark.createDataFrame([], "item_id long, text string")
    for d, i in ((no_docs, item_table), (docs, none), (no_docs, none), (docs.filter("text IS NULL"), item_table)):
        assert lexical_search.lexical_search(d, i).collect() == []


def brute_variants(rows, damage):
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % damage == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= 2}

    def apart(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[at + (len(a) == len(b)):] == b[at + 1:]

    near = {w: [v for v in n if apart(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return out


def test_spelling_variants(spark, corpus):
    rnd = random.Random(8)
    rows, base = [], ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(6, 12))) for _ in range(40)] + ["aaaaaaaa", "×bcdefgh"]
    letters = "abcdeé"
    for w in base:
        for copies, edits in ((400, 0), (30, 1), (2, 1), (2, 2), (2, 1)):
            for _ in range(edits):
                at = rnd.randrange(len(w) + 1)
                w = rnd.choice([w[:at] + w[at + 1:], w[:at] + rnd.choice(letters) + w[at:], w[:at] + rnd.choice(letters) + w[at + 1:]])
            spelt = w.capitalize() if rnd.random() < 0.3 else w
            rows += [(rnd.randrange(500), f"{spelt}, {w}; ā{w}")] * (copies // 2)
    rows += [(None, base[0] + " " + base[1].upper())] * 3 + [(7, None), (8, ""), (9, "中文" * 10), (10, "x" * 5000 + " " + "x" * 4999 + " " + "x" * 5000)] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n").repartition(4)
    expected = brute_variants(rows, 31)
    assert sum(f is not None for *_, f, _, _ in expected) > 20 and any(r != f and f for *_, f, _, r in expected)
    found = spelling.spelling_variants(frame, damage=31).select("word", "n", "n_near", "form", "form_n", "root")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


def test_variants_of_nothing(no_docs):
    assert spelling.spelling_variants(no_docs, damage=31).collect() == []


def brute_leaks(rows, items, size):
    cut = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    windows = {}
    for i, text in items:
        w = cut(text)
        for at in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[at:at + size]), set()).add(i)
    out, kept = set(), {}
    for i, text, *_ in rows:
        w = cut(text)
        hit, owners = set(), set()
        for at in range(len(w)):
            for n in {len(x) for x in windows}:
                if (owner := windows.get(tuple(w[at:at + n]))) and at + n <= len(w):
                    hit |= set(range(at, at + n))
                    owners |= owner
        owners = sorted(str(o) for o in owners if o is not None)
        out.add((i, hashlib.md5((text or "").encode()).hexdigest(), len(w), len(hit), tuple(owners)))
        kept[i, text] = [x for at, x in enumerate(w) if at not in hit]
    return out, kept


@pytest.mark.parametrize("small", [True, False])
def test_contamination(docs, corpus, items, item_table, monkeypatch, small):
    if not small:
        monkeypatch.setattr(decontamination, "BROADCAST_BYTES", -1)
    rows = [r for r in corpus if len(r[1] or "") < 30000] if not small else corpus
    frame = docs.filter("text IS NULL OR length(text) < 30000") if not small else docs
    expected, kept = brute_leaks(rows, items, 10)
    found = decontamination.contamination(frame, item_table)
    got = [(r.doc_id, r.digest, r.n_words, r.n_hit, tuple(r["items"])) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    if not small:
        return
    odd = frame.selectExpr("*", "1 AS words", "2 AS _id", "3 AS digest")
    clean = decontamination.decontaminate(odd, item_table)
    assert clean.columns == odd.columns and clean.count() == len(rows)
    cut = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    hit = {(i, d) for i, d, _, n, _ in expected if n}
    changed = Counter(map(str, (kept[i, t] for i, t, *_ in rows)))
    assert Counter(str(cut(r.text)) for r in clean.collect()) == changed
    digest = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    untouched = Counter((i, t) for i, t, *_ in rows if (i, digest(t)) not in hit)
    assert not untouched - Counter((r.doc_id, r.text) for r in clean.collect())
    left = decontamination.decontaminate(odd, item_table, remove="documents")
    assert Counter((r.doc_id, r.text) for r in left.collect()) == untouched


def test_spans_go_with_what_stands_before_them(spark):
    docs = spark.createDataFrame([(1, "Intro.  (Alpha-beta gamma) end! one"), (2, "alpha beta gamma"), (3, "none of it")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha BETA gamma")], "item_id long, text string")
    clean = {r.doc_id: r.text for r in decontamination.decontaminate(docs, items).collect()}
    assert clean == {1: "Intro) end! one", 2: "", 3: "none of it"}


def test_no_benchmark_and_no_documents(spark, docs, no_docs, item_table):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontamination.contamination(docs, none).collect()} == {0}
    assert decontamination.contamination(no_docs, item_table).collect() == []
    assert decontamination.decontaminate(docs, none).count() == docs.count()
