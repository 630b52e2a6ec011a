"""Ranks, components and streams."""

from pyspark.sql import functions as F

from corpusforge.operators.components import components
from corpusforge.operators.ranking import salted_rank
from corpusforge.streaming import streams


def test_ranks_are_exact(spark):
    df = spark.range(5_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") < 10, None).otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"))
    r = salted_rank(df, ["g"], F.xxhash64("id"), ["id"], buckets=16)
    got = {}
    for x in r.select("g", "id", "rank", F.xxhash64("id").alias("h")).collect():
        got.setdefault(x["g"], []).append((x["rank"], x["h"], x["id"]))
    assert sum(map(len, got.values())) == 5_000
    for rows in got.values():
        rows.sort()
        assert [x[0] for x in rows] == list(range(len(rows))) and [x[1:] for x in rows] == sorted(x[1:] for x in rows)
    few = salted_rank(df.withColumn("q", F.lit(3)), ["g"], F.xxhash64("id"), ["id"], below="q")
    assert few.groupBy("g").count().agg(F.max("count")).first()[0] == 3
    assert salted_rank(df.limit(0), ["g"], F.xxhash64("id"), ["id"]).count() == 0


def test_components_of_a_long_chain(spark):
    chain = [(f"n{i:04d}", f"k{j}") for i in range(300) for j in (i, i + 1)]
    rows = chain + [("a", "x"), ("b", "x"), ("c", "y"), ("d", None), (None, "x")]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(rows, "node string, key string")).collect()}
    assert {got[f"n{i:04d}"] for i in range(300)} == {"n0000"} and got["a"] == got["b"] == "a" and got["c"] == "c" and "d" not in got


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, "12. [a] {x} b", "O", "2024-01-01 00:00:00"), (1, "12. [a] {x} b", "O", "2024-01-02 00:00:00"), (2, "c", "B-Date", "2024-01-03 00:00:00"), (3, None, None, "2024-01-20 00:00:00")]
    df = spark.createDataFrame(rows, "id int, text string, label string, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(src)
    s = streams.text_stream(spark, src, df.schema.simpleString()[7:-1].replace(":", " "))
    streams.run_once(streams.filter_stream(streams.clean_stream(s)), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r["id"], r["text"], r["label"]) for r in spark.read.parquet(str(tmp_path / "out")).where("id < 3").collect())
    assert got == [(1, "a b", "O"), (1, "a b", "O"), (2, "c", "O")]
    streams.run_once(streams.first_deliveries(s, ["id"], "at"), str(tmp_path / "out2"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "out2")).count() == 3
    streams.run_once(streams.windowed_counts(s, "at", "id"), str(tmp_path / "out3"), str(tmp_path / "cp3"))
    assert spark.read.parquet(str(tmp_path / "out3")).agg(F.sum("n")).first()[0] == 3
