import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """Documents with copies, near copies, shared passages, nulls, empty and long texts, clashing columns."""
    rng = random.Random(7)
    words = ["".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(words) + (rng.choice(".,!") if rng.random() < 0.15 else "") for _ in range(n))
    base = [text(rng.randint(1, 120)) for _ in range(60)]
    passage = "Shared passage begins here now. " + text(60) + ". It ends with these words here."
    rows = list(base)
    for b in base[:20]:
        rows.append(b)
        w = b.split()
        w[rng.randrange(len(w))] = "changed"
        rows.append(" ".join(w))
    rows += [f"{text(20)}.\n{passage}\n{text(15)}" for _ in range(6)]
    rows += [None, "", "   \n", "Word", "word", "1234 5678", text(4000), "one two three", "one two three four"]
    return [(i * 3, t, ["en", "de", None][i % 3], f"s{i % 4}", i) for i, t in enumerate(rows)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, part int").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, part int")
