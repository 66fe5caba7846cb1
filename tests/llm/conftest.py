import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, block string, payload string"


def corpus(n=60, seed=3):
    """Small documents with copies, shared passages, nulls, empty, long and repeated rows."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 8))) for _ in range(400)]
    say = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage, line = say(60), say(12)
    texts = []
    for i in range(n):
        t = say(r.randint(3, 120))
        if i % 5 == 0:
            t += " " + passage + "\n" + say(4)
        if i % 7 == 0:
            t = line + "\t" + t
        texts.append(t)
    texts += [texts[2], texts[2] + " ", texts[3].replace(" ", "  "), "", None, "  \n ", "One", "one", "x " * 400, "é ü ñ " * 30, texts[5].upper()]
    texts.append(" ".join([passage] * 3) + say(3000))
    rows = [(i, t, "en", "s", "b", "p") for i, t in enumerate(texts)]
    return rows + [(rows[4][0], rows[4][1], None, None, None, None), (None, texts[6], None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    df = spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()
    df.count()
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
