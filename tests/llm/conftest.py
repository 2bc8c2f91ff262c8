import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and long texts, ties and repeated rows, and extra columns with clashing names."""
    long_text = " ".join(f"w{i % 997} and so on" for i in range(20_000))
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta", "en", "a", 3),
        (2, "Alpha beta gamma delta epsilon zeta", None, None, None),
        (2, "Alpha beta gamma delta epsilon zeta", None, None, None),
        (3, None, "en", "a", 0),
        (4, "", "en", "b", 0),
        (5, " \n\t ", "en", "b", 3),
        (None, "Alpha beta gamma delta epsilon zeta", "en", "b", 1),
        (6, long_text, "en", "b", len(long_text)),
        (7, "é日本\U0001f600 MIT License. <|endoftext|> </s>", "ja", "c", 9),
        (-8, "one", "en", "c", 3),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 as score", "'x' as bucket", "2 as size", "3 as fp", "4 as h", "5 as n_words", "6 as t", "7 as c0", "8 as labels")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 3 > 0, i % 5 == 0) for i in range(200)] + [(None, True, True), (1, None, None), (1, True, False)], "doc_id long, q boolean, x boolean").selectExpr("doc_id", "int(q) as quality", "int(x) as toxic")
