import pytest

WORDS = "the of and quick brown fox jumps over lazy dog river stone light winter apple seven market garden silver cloud".split()


@pytest.fixture(scope="session")
def prose():
    """Deterministic prose: n words from a seed."""
    import random

    def make(seed: int, n: int) -> str:
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def docs(spark):
    """documents with a clashing extra column from (doc_id, text) pairs."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score double")

    return make
