"""Contexts of unique names, all of them, and what payload and export carry."""

import json

from corpusforge.operators import cluster, entities


def test_contexts_and_works_beyond_twenty(spark):
    rows = [(i, "PER", "Óláfr" if i % 2 else "óláfr", f"w{i:02d}", f"c{i}", i) for i in range(30)] + [(30, "PER", "Óláfr", "w00", "c0", 99)]
    df = spark.createDataFrame(rows, "id long, kind string, text string, work string, context string, start long")
    got = entities.name_contexts(df, "text", "kind", "work", "context", ["start"], ["id"])
    assert sorted(r["start"] for r in got.collect()) == list(range(30))
    assert cluster.display_contexts(got, ["kind", "key"], ["start"]).count() == 20
    u = entities.unique_entities(df, "text", "kind", "work", ["id"]).first()
    assert u["frequency"] == 31 and len(u["work_names"]) == u["works"] == 30


def test_payload_and_export_carry_the_names(spark):
    c = spark.createDataFrame([(1, "k", "", "a", 0), (2, "k", "", "b", 0), (3, "k", "", "c", -1)], "id long, kind string, block string, text string, cluster int")
    n = spark.createDataFrame([(1, "k", 5, ["w", "x"], 2), (2, "k", 3, ["x", "y"], 4), (3, "k", 1, ["z"], 1)], "id long, kind string, frequency long, work_names array<string>, sources long")
    p = {r["cluster"]: r for r in cluster.payload(c, n).collect()}
    assert p[0]["frequency"] == 8 and p[0]["work_names"] == ["w", "x", "y"] and p[0]["sources"] == 6 and p[0]["members"][1]["frequency"] == 3
    out = [json.loads(r["json"]) for r in cluster.export(c, n).collect()]
    assert all(x["statistics"] == {"names": 3, "clusters": 1, "noise": 1} for x in out) and sorted(x["frequency"] for x in out) == [1, 8]
