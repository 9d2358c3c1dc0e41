import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies int, Block string"


def corpus() -> list[tuple]:
    """Small documents: copies, near copies, nulls in any column, empty and long texts, repeated rows, ties; the columns
    past n_chars have names that operators use themselves."""
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "gämma", "DELTA", "epsilon,", "zeta-eta", "don't", "x9", "été", "naïve", "über", "12", "…", "the", "of"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(n))
    texts = ["\n".join(sentence(rng.randrange(3, 30)) for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1] + " tail", "Beginning " + texts[2], None, "", " \n\t", "one", "one two", "<|endoftext|> ONE's <|x", "é̈ é A̱ Σς", texts[3].upper()]
    texts.append("\n".join(sentence(60) for _ in range(60)))
    rows = [(i * 7 % 61, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or ""), i % 2, "b") for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, "null id", "en", "s1", 7, 0, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return corpus()


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
