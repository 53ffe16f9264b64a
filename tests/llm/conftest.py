import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, id long, words string, label int, block int"
BAD = [
    (1, None, "en", "a"), (2, "", None, None), (3, "   \n\t", "en", "a"), (None, "a row without an id, with some words in it", "en", "b"),
    (4, "ties and ties and ties and ties", "en", "b"), (4, "ties and ties and ties and ties", "en", "b"), (5, "x" * 30_000 + " " + "word " * 40_000, "de", None),
    (6, "ÄÖÜ ß ñ 😀 \u2028 \x0b\x0c", None, "c"),
]


def frame(spark, rows):
    """documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, src, 7, 7, 7, 7, "x", 7, 7) for i, t, lang, src in rows], SCHEMA)


@pytest.fixture
def bad(spark):
    return frame(spark, BAD)


@pytest.fixture
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source): prose with exact copies, near copies, a common line, long shared passages and a hot source."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice(["an", "er", "th", "on", "re", "st", "ou", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = prose(90), "This line stands in many of the texts."
    rows = []
    for i in range(150):
        text = prose(rng.choice([3, 20, 80, 200, 400]))
        kind = i % 10
        if kind == 1 and i > 10:
            text = rows[rng.randrange(len(rows))][1]
        elif kind == 2 and i > 10:
            words = rows[rng.randrange(len(rows))][1].split(" ")
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind in (3, 4):
            text = text + "\n" + passage + "\n" + prose(30)
        elif kind == 5:
            text = line + "\n" + text + "\n" + line
        rows.append((i, text, "en" if i % 4 else "de", "hot" if i % 3 == 0 else f"s{i % 5}"))
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return frame(spark, corpus).cache()
