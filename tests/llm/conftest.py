import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, n_words string, cls string, g string, key string, copies string, mixed_id string, copy_id string"


def table(spark, rows, schema=SCHEMA):
    """Documents with nulls, empties, ties and columns whose names clash with those of the operators."""
    return spark.createDataFrame([r + ("x",) * 9 for r in rows], schema)


LONG = " ".join(f"word{i % 977}x{i % 131} the of and to" for i in range(6000))
BASE = " ".join(f"alpha{i} beta{i * 7 % 13} gamma{i % 5}" for i in range(30))


@pytest.fixture(scope="session")
def docs(spark):
    """Odd documents: null and empty texts, blanks, a very long one, copies, near copies, repeated rows, null ids."""
    near = BASE.replace("alpha29 beta8 gamma4", "alpha29 beta8 changed")
    rows = [
        (1, None, "en", "a", 0), (2, "", None, None, 0), (3, " \t\n\v\f\r ", "en", "a", 7), (4, LONG, "en", "b", 10), (5, BASE, "en", "a", 5),
        (6, BASE, "en", "a", 5), (7, near, None, "b", 5), (8, BASE.upper(), "de", None, 5), (9, "one two three", "en", "c", 3), (10, "One TWO three", "fr", "c", 3),
        (11, "12345 678 !!", "en", "c", 3), (12, BASE, "en", "a", 5), (12, BASE, "en", "a", 5), (None, "a null id has words too", "en", "a", 5), (None, None, None, None, None),
        (13, "été où naïve façade déjà vu", "fr", "b", 5), (14, "x", "en", "d", 1), (15, "Released under the MIT License.\n" + BASE, "en", "d", 1), (16, "日本語のテキスト", "ja", "d", 1),
    ]
    return table(spark, rows).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return table(spark, [])
