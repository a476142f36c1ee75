import pytest


@pytest.fixture(scope="session")
def vocabulary():
    tokens = pytest.importorskip("public_tokenizers")
    return tokens.path("byte_bpe_50k.json")


@pytest.fixture
def folder(spark, tmp_path):
    """A function that gives new folder names."""
    return lambda name: str(tmp_path / name)


HARD = [
    (1, "one two three four five six seven"),
    (2, "one two three four five six seven"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (None, "a text without an id"),
    (7, "x" * 70_000),
    (8, "word " * 30_000),
    (9, "ünïcödé 😀 " * 50),
    (9, "ünïcödé 😀 " * 50),
]


@pytest.fixture
def hard(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with names that operators use inside."""
    rows = [(*row, k, "own", 0.5, "en") for k, row in enumerate(HARD)]
    names = "doc_id long, text string, uid long, digest string, score double, content string"
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture
def empty(hard):
    return hard.limit(0)


@pytest.fixture
def sf_dir():
    return "/root/testdata/sf0.001"
