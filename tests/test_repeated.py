"""Every row of a duplicated key, those between the first and the last too."""

from corpusforge.operators import stats


def test_all_rows_of_repeated_keys(spark):
    rows = [("a", None, i) for i in range(5)] + [("b", "x", 9), (None, None, 10), (None, None, 11), ("a", "x", 12)]
    got = stats.repeated_rows(spark.createDataFrame(rows, "k string, s string, i int"), ["k", "s"]).collect()
    assert sorted((r["i"], r["n"]) for r in got) == [(0, 5), (1, 5), (2, 5), (3, 5), (4, 5), (10, 2), (11, 2)]
