import pytest

#: Awkward documents: nulls, empties, repeats, ties, one word, no word, long runs, private data.
TEXTS = [
    None, "", " \n\t ", "one", "The quick brown fox jumps over the lazy dog and the cat of the house", "The quick brown fox jumps over the lazy dog and the cat of the house",
    "the QUICK brown fox jumps over the lazy dog and the cat of the house", "word " * 3000, "x" * 20000, "mail a.b@c.example.com or +1 (017) 555-7713 from 10.0.0.255, card 4111 1111 1111 1111",
    'token = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6" end', "é😀 " * 50, "\n".join(f"line {i} of a list | a | b" for i in range(40)), "<|endoftext|> is a marker", "1 " * 4000,
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in every column, a repeated row, and columns whose names operators use themselves."""
    rows = [(i, t, "en", None if i % 5 == 0 else f"src{i % 3}", len(t or ""), 1, 2.0, "x") for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id here but words", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, target double, sig string")


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
