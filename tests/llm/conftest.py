import random

import pytest

# Named like columns that the operators make or use themselves.
CLASHING = ["size", "key", "n", "ids", "rid", "score", "start", "shard", "text_a", "place", "rank"]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, blanks, one letter, a long word, a very long text, ties and repeated rows."""
    rng = random.Random(4)
    words = ["alpha", "Beta,", "the", "of", "gamma.", "délta", "x|", "ε", "der", "la"]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    texts = [
        None, "", "  \n\t ", "a", "the", "1234 !!", "w" * 5000, long, long, " ".join(words * 9),
        " ".join(words * 9), "tab\tnbsp here\x0bx\x1cy", "same text", "a a a a " * 30, "日本語 " * 40,
    ]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], rows[12], (None, "no key here at all", "de", "s1", 3), (3, "other text, same key", "de", "s0", 1)]
    rows = [r + tuple("clash" for _ in CLASHING) for r in rows]
    names = ", ".join(f"{c} string" for c in CLASHING)
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {names}"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def rows(odd):
    return [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def given(spark):
    folder = "/root/testdata/sf0.001"
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
