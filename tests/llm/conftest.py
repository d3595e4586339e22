import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string, n string, `set` string, copies string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
PLAIN = "The quick brown fox jumps over the lazy dog while seven other animals look on and think about their own affairs in peace.\nAnother line of it."


def _row(id, text, source="s1"):
    return (id, text, "en", source, len(text or ""), "x", "y", "z", "q", "c")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank and very long texts, ties, repeated rows, one id with two texts, clashing extra columns."""
    rows = [
        _row(None, "a row without an id and with some words in it"), _row(None, None), _row(1, None), _row(2, ""), _row(3, " \n\t "),
        _row(4, LONG), _row(5, PLAIN), _row(5, PLAIN), _row(6, PLAIN, None), _row(7, PLAIN + " More.", None), _row(8, "ÄÖ É é ı İ \x85 \u2028 #*$", "s2"),
        _row(9, "one"), _row(9, "two"), _row(10, "spam " * 400, "s2"), _row(11, "a\n\na\nb a", "s3"),
    ]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
