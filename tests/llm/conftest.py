import pytest

LONG = " ".join(f"word{i % 977} of line {i}" for i in range(60_000))


@pytest.fixture(scope="session")
def nasty(spark):
    """Documents with nulls, empty, very long and repeated rows, ties, and columns with clashing names."""
    rows = [
        (1, "a plain text of some words that nobody minds", "en", "s1", 44, "x"),
        (1, "a plain text of some words that nobody minds", "en", "s1", 44, "x"),
        (2, None, None, None, None, None),
        (3, "", "en", "s1", 0, "x"),
        (4, " \t\n ", "en", "s2", 4, None),
        (None, "a text without an id but with words", "en", None, 35, "x"),
        (None, None, None, None, None, None),
        (5, LONG, "en", "s1", len(LONG), "x"),
        (6, "a plain text of some words that nobody minds", "en", "s2", 44, "y"),
        (7, "é ñ ß 你好 \U0001f600 one two", "de", "s3", 18, "z"),
        (8, "one", "en", "s2", 3, "z"),
        (-9, "negative ids are ids", "en", "s2", 20, "z"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def sf_small():
    return "/root/testdata/sf0.001"


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(autouse=True)
def _batch_rows_put_back(spark):
    """``small_batches`` sets them for the whole session; tests of other packages are to start without."""
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
