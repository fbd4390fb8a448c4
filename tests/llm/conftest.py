import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, rank string, key string, rep string, label string, shard string, d string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source]) rows, with extra columns whose names the operators use inside."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", "x", "x", "x", "x", "x", "x") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo ya".split()


@pytest.fixture(scope="session")
def prose():
    import random

    def make(seed, words):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(words))

    return make
