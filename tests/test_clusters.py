"""Clusters that do not depend on the size of the blocks, and distances in bit vectors."""

import numpy as np
import pandas as pd

from corpusforge.operators import cluster
from corpusforge.plans import catalog

NAMES = ["Haraldr", "Haraldi", "Haralds", "Eiríkr", "Eiríks", "Óláfr", "Óláfs", "Þorgeirr", "Thorgeirr", "Sigríðr", "Sigríðar", "a", "", "x" * 70]


def groups(df):
    out = {}
    for r in df.where("cluster >= 0").collect():
        out.setdefault((r["kind"], r["block"], r["cluster"]), set()).add(r["id"])
    return sorted(map(sorted, out.values()))


def test_distances_equal_those_of_single_pairs():
    names = [*NAMES, "æ" * 64, "b" * 63, "ab" * 32]
    want = np.array([[cluster.text_distance(a, b) for b in names] for a in names])
    assert np.abs(cluster.text_distances(names, names) - want).max() < 1e-12


def test_block_size_changes_no_cluster(spark):
    rng = np.random.default_rng(1)
    rows = [(i, kind, t, [float(x) for x in rng.random(4)]) for i, t in enumerate(NAMES) for kind in ("PER", None)]
    df = spark.createDataFrame([*rows, (99, "LOC", "Noregr", [0.0] * 4)], "id long, kind string, text string, v array<float>")
    for vector in (None, "v"):
        whole = cluster.cluster_names(df, vector=vector)
        assert whole.count() == len(rows) + 1
        assert groups(whole) == groups(cluster.cluster_names(df, vector=vector, limit=3))
    assert any({7, 8} <= set(g) for g in groups(cluster.cluster_names(df, vector=None, limit=3)))  # Þorgeirr, Thorgeirr


def test_clusters_equal_those_of_the_whole_tree(spark):
    rng = np.random.default_rng(2)
    first, last, ends = ["grím", "þor", "ey", "hall", "sig"], ["björn", "steinn", "geirr", "gautr"], ["", "s", " svarti", "sson", "sdóttir", "x" * 60]
    names = [*NAMES, *{"".join(rng.choice(x) for x in (first, last, ends)) for _ in range(80)}, *("".join(rng.choice(list("abþ"), rng.integers(1, 6))) for _ in range(60)), "Haraldr"]
    vectors = rng.random((len(names), 4)).round(1)
    vectors[3] = 0
    df = spark.createDataFrame([(i, "PER", t, v.tolist()) for i, (t, v) in enumerate(zip(names, vectors))], "id long, kind string, text string, v array<double>")
    for vector, v in ((None, None), ("v", vectors)):
        want: dict = {}
        for i, c in enumerate(cluster.density_clusters(cluster.distance_matrix(names, v)).tolist()):
            want.setdefault(c, []).append(i)
        want.pop(-1, None)
        got = cluster.cluster_names(df, vector=vector, limit=40)
        assert groups(got) == sorted(want.values()) and len(want) > 20
        numbers = [r["cluster"] for r in got.where("cluster >= 0").groupBy("cluster").agg({"id": "min"}).orderBy("min(id)").collect()]
        assert numbers == list(range(len(want)))


def test_a_name_is_measured_with_few_others(monkeypatch):
    rng = np.random.default_rng(3)
    texts = sorted({"".join(rng.choice(["grím", "þor", "ey", "hall", "sig", "björn", "steinn", "geirr", "gautr", " "]) for _ in range(5)) for _ in range(1_000)})
    p = pd.DataFrame({"low": texts, "pos": range(len(texts)), "part": range(len(texts)), "v": None, "bound": np.inf, "least": 0.0})
    pairs, measure = [], cluster.Names.distances
    monkeypatch.setattr(cluster.Names, "distances", lambda self, i, j: pairs.append(len(i)) or measure(self, i, j))
    got = cluster.nearest_others(p, p).set_index("x")
    d = cluster.distance_matrix(texts, None) + np.diag(np.full(len(texts), np.inf))
    assert (got["w"].sort_index().to_numpy() == d.min(axis=1)).all() and sum(pairs[:-1]) < 0.2 * len(texts) ** 2


def test_clusters_of_all_unique_entity_names(spark, sf_dir):
    want = spark.read.parquet(f"{sf_dir}/entities.parquet").where("norm_text is not null").selectExpr("label", "lower(norm_text)").distinct().count()
    assert catalog.QUERIES["hdbscan_clusters"](spark, sf_dir).count() == want
