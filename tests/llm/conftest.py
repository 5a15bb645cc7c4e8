import pytest

#: null, empty, blank, tiny, repeated, long and odd texts; ids and sources with nulls and repeats.
LONG = " ".join(f"word{i % 977} and" for i in range(20_000))
LINES = "first common line of many\nsecond line here, too\n\nshort"
ROWS = [
    (3, LINES, "en", "a", 0), (1, LINES, "en", "a", 0), (1, LINES, "en", "a", 0), (2, None, "fr", None, None), (4, "", None, "b", 0), (None, "no id at all, this one", "en", "b", 1),
    (5, " \t\n ", "en", "c", 2), (6, LONG, "en", "a", 3), (7, "Unique words stand here, one after another, ten of them.", "de", None, 4),
    (8, "FIRST COMMON LINE OF MANY \nand something else that is only here", "en", "b", 5), (9, "Été à la plage\n  second line here, too\x0b\n", "fr", "b", 6), (10, "x", "en", "d", 7), (1, "another text with a used id", "en", "a", 8),
]
#: Extra columns, one of which clashes with results of several operators.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({"score": F.lit("mine"), "n_words": F.lit(-1), "k": F.lit("key"), "b": F.lit(1)}).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")
