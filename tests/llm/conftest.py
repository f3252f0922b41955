import pytest

WORDS = "amber basil cedar delta ember fjord grove heron indigo jasper kelp larch maple nectar onyx pearl quartz raven sable topaz umber violet willow xenon yarrow zephyr".split()


@pytest.fixture(scope="session")
def prose():
    """Deterministic invented prose: n words from a seed."""
    import random

    def make(seed, n):
        rnd = random.Random(seed)
        return " ".join(rnd.choice(WORDS) + rnd.choice(["", "s", "ing", "ed", str(rnd.randint(0, 99))]) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def docs(spark):
    """documents from (id, text) pairs, with columns whose names the operators use themselves."""

    def make(pairs):
        rows = [(i, t, "en", "s", len(t or ""), 1, "x", 7) for i, t in pairs]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h int, row string, node int")

    return make
