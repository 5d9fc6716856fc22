import random

import pytest

WORDS = "the of and to in is you that it he was for on are with as his they be at one have this from".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed", "ly", "on"]) for _ in range(n))


def corpus(seed=1, n=60):
    """Rows with copies, near copies, a shared passage, nulls, empty and very long texts, ties and odd characters."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randint(1, 120)) for _ in range(n)]
    passage = sentence(rng, 60)
    texts += [texts[0], texts[0], texts[1] + " more", texts[2].replace("the", "a"), f"x {passage} y", f"{passage} z", passage]
    texts += [None, "", "   ", "\n\n", "a", "ß é 漢字 🙂", sentence(rng, 6000), "A B C D", "a b c d", "tab\tand\r\nlines\n  two", "x" * 5000, "<|endoftext|>"]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with columns whose names operators use themselves, and one repeated row."""
    more = [(i, t, "en", "s", len(t or ""), 1, "z", 0.5) for i, t in rows]
    return spark.createDataFrame([*more, more[5]], "doc_id long, text string, lang string, source string, n_chars long, n long, digest string, score double")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
