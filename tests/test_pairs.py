"""Pairs of names are all pairs, whatever their first letters."""

import pytest

from corpusforge.functions.similarity import jaro
from corpusforge.operators.cluster import text_distance
from corpusforge.plans import catalog


@pytest.mark.parametrize("name", ["hybrid_distance", "cosine_pairs"])
def test_all_pairs_of_a_kind(spark, sf_dir, name):
    kinds = spark.read.parquet(f"{sf_dir}/name_authority.parquet").where("label is not null").groupBy("label").count()
    assert catalog.QUERIES[name](spark, sf_dir).count() == sum(r["count"] * (r["count"] - 1) // 2 for r in kinds.collect())


@pytest.mark.parametrize("name", ["lev_pairs", "prefix_len", "string_similarity"])
def test_all_pairs_of_part_names(spark, sf_dir, name):
    n = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").distinct().count()
    assert catalog.QUERIES[name](spark, sf_dir).count() == n * (n - 1) // 2


def test_similarity_of_all_part_names(spark, sf_dir):
    for r in catalog.QUERIES["string_similarity"](spark, sf_dir).collect():
        assert abs(r["jaro"] - jaro(r["a"], r["b"])) < 1e-6 and abs(1 - r["combined"] - text_distance(r["a"], r["b"])) < 1e-6
