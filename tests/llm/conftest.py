import random

import pytest


@pytest.fixture(scope="session")
def texts():
    """Texts of invented words: plain ones, copies, near copies, shared passages, short, empty, blank and null ones."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["an", "ti", "re", "éu", "ou", "ß", "th", "ing"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    plain = [prose(rng.randint(1, 300)) for _ in range(40)]
    passage = prose(120)
    shared = [f"{prose(30)} {passage} {prose(40)}" for _ in range(6)]
    base = prose(200).split(" ")
    near = [" ".join(base[:k] + [word()] + base[k + 1 :]) for k in range(5, 200, 30)]
    odd = [None, "", " \n\t ", "a", "ab", "A B", "a b", "aaaa" * 300, "x" * 4000, "日本語の文章。" * 90, "12 34 !!", "  two  spaces\n\nlines\r\n", "it's 'quoted' <|endoftext|> end", "a　b c d  e", "nul\0byte it's"]
    return plain + plain[:4] + shared + near + [" ".join(base)] * 2 + odd


@pytest.fixture
def docs(spark, texts):
    """doc_id with gaps, a null one and a repeated row, and columns whose names clash with those of operators."""
    rows = [(3 * k + 1, t, f"l{k % 3}" if k % 7 else None, "s", k) for k, t in enumerate(texts)]
    rows += [rows[2], (None, "without an id", "l0", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


@pytest.fixture
def no_docs(docs):
    return docs.filter("false")
