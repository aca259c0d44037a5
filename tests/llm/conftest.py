import random

import pytest

WORDS = [f"w{at}" for at in range(400)]


def text_of(seed, size):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) for _ in range(size))


def changed(text, at, word="other"):
    words = text.split()
    words[at] = word
    return " ".join(words)


@pytest.fixture(scope="session")
def rows():
    """Ids and texts with copies, near copies, nulls, ties, empty, short and very long texts."""
    long = text_of(1, 6000)
    found = [(0, long), (1, None), (2, ""), (3, "  \n "), (4, "one two"), (5, "one two"), (6, "ONE two")]
    base = text_of(2, 120)
    found += [(10 + at, changed(base, 5 * at)) for at in range(12)]
    found += [(30, base), (31, base), (32, base), (33, base + " more"), (40, long + " end")]
    found += [(50 + at, text_of(100 + at, 60)) for at in range(20)]
    shared = text_of(3, 50)
    found += [(80 + at, f"{text_of(200 + at, 40)} {shared} {text_of(300 + at, 30)}") for at in range(15)]
    found += [(100, "Der Fluß — é漢字\n\nx\t y  z"), (101, "12 34 !!"), (None, "no id here at all"), (7, "tied"), (7, "tied")]
    return found


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows in several partitions, with further columns whose names operators use."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, `a b` int, key long"
    data = [(one, text, "en", "s", len(text or ""), 0.5, 1, 2) for one, text in rows]
    return spark.createDataFrame(data, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
