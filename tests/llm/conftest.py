import pytest

#: Nulls in every column, empty and odd texts, ties, repeated rows, and a column that clashes with the operators' own.
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta", "en", "a", 5, "x"),
    (1, "Alpha beta gamma delta epsilon zeta", "en", "a", 5, "x"),
    (2, "alpha BETA gamma delta epsilon zeta", "en", "a", 5, "x"),
    (3, None, "en", "a", None, None),
    (4, "", None, None, 0, "y"),
    (None, "text without an id", "en", "b", 18, "z"),
    (6, "\t \n", "fr", "b", 3, ""),
    (7, "mail a.b@mail1.example.com or A.B@mail1.example.com, +1 (456) 555-2186", "de", "b", 1, None),
    (8, "word " * 30000, "en", "a", 150000, "long"),
    (9, "日本語 %%% 123 <|endoftext|> ~0<[", None, "c", 9, "q"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


@pytest.fixture
def odd_docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
