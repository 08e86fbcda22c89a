import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, bucket long, term long, a string, start long, score double, _bucket int"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows, columns with clashing names."""
    long = " ".join(f"w{i % 977} x{i}" for i in range(60_000))
    texts = [
        "", None, "   \n\t ", "one", "one", "ONE", "one two", "one two three four five six seven eight nine ten eleven", long, long + " tail", "a  b   c\n\n d ", " lead", "tail ", "<|endoftext|> in text",
        "é è ê ß ñ 日本 😀", "x" * 5000, "don't we'll I'm", "\r\n\x0b\x1c\x85\xa0 odd", "Released under the MIT License.\nReleased under the MIT License.",
    ]
    rows = [(i, t, "en", "s", None, 1, 2, 3, "a", 4, 0.5, 6) for i, t in enumerate(texts)]
    rows += [(None, "one two three", None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)]
    rows += [rows[6], rows[6], rows[-1], (7, "other text with a repeated id", "en", "s", 1, 1, 1, 1, "b", 1, 1.0, 1), (-5, "one two", "de", "t", 0, 0, 0, 0, "", 0, 0.0, 0)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
