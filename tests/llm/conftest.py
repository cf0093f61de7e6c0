import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, words: int) -> str:
    stops = ["the", "of", "and", "to", "in", "is", "that"]
    out = [rng.choice(stops) if rng.random() < 0.35 else "".join(rng.choice("abcdeinorstuvl") for _ in range(rng.randint(3, 9))) for _ in range(words)]
    return " ".join(out)


@pytest.fixture(scope="session")
def texts():
    """Plain texts, copies and near copies, and the awkward cases every operator meets."""
    rng = random.Random(5)
    plain = [sentence(rng, rng.randint(55, 140)) for _ in range(12)]
    near = []
    for base in plain[:3]:
        words = base.split()
        for k in range(3):
            words = [*words]
            words[10 + 7 * k] = f"changed{k}"
            near.append(" ".join(words))
    odd = [None, "", " \n\t ", "one", "one two", "ONE TWO", "a b c", "x" * 5000, "das ist kein Wort zu viel é ü ñ " * 30]
    return [*plain, *near, plain[0], plain[1].upper(), *odd, sentence(rng, 6000)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    # The same row twice, and a row without an id.
    rows += [rows[2], (None, texts[4], "en", "s1", 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
