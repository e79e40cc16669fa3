import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark):
    """A small corpus with nulls, empty and very long texts, copies, near copies, shared passages and repeated rows."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdeéü") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    say = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    lay = lambda words: "".join(w + ("\n" if rnd.random() < 0.15 else " ") for w in words)
    passage, shared_lines = say(60), "\n".join(" ".join(say(6)) for _ in range(12))
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "ONE Two"), (5, "one two"), (6, "a " * 90), (7, "a " * 70),
            (8, "x y " * 50), (9, lay(say(20000))), (10, "one"), (11, None), (12, "")]
    for i in range(13, 90):
        words = say(rnd.randint(1, 160))
        if i % 5 == 0:
            words[len(words) // 2:len(words) // 2] = passage
        text = lay(words)
        if i % 7 == 0:
            text += "\n" + shared_lines + "\n" + " ".join(say(4))
        rows.append((i, text))
    known = dict(rows)
    for i in range(90, 130):
        of = known[13 + i % 9]
        if i % 3:
            words = of.split(" ")
            words[rnd.randrange(len(words))] = "Edited"
            of = " ".join(words)
        rows.append((i, of))
    rows.append((20, known[20]))  # a repeated row
    rows.append((None, known[25]))
    rnd.shuffle(rows)
    sources = [None, "b", "a", "B", "é", "a"]
    return [(i, t, "en", sources[(i or 0) % 6] if (i or 0) % 3 else "a", len(t or "")) for i, t in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
