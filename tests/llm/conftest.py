import pytest

#: What every operator must take: nulls, empty and long texts, repeated rows, clashing names.
ODD = [(1, ""), (2, None), (None, "no id here at all"), (3, "   \n \t "), (4, "same text twice"), (4, "same text twice"), (5, "x" * 20000), (6, "é ß 漢字 😀 \u212a \u0130"), (7, "word " * 5000)]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of every odd kind, with columns named as operators name theirs."""
    rows = [(i, t, "junk", 1) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, found string, kept int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("1 = 0")


@pytest.fixture(scope="session")
def small():
    """The folder of the smallest test tables."""
    from pathlib import Path

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("the test tables aren't here")
    return "/root/testdata/sf0.001"
