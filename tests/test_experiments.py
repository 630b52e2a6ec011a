"""Experiments: a split of the target corpus, rareness of its training part, shared dev and test."""

import math
from collections import Counter

import pytest

from corpusforge.operators import splits
from corpusforge.plans import catalog


def test_sets_of_a_small_corpus(spark):
    rows = [(i, "diplo", x) for i in range(40) for x in (["B-Person"] if i % 2 else []) + ["O"] * (1 + i % 3)]
    rows += [(100 + i, "norm", x) for i in range(5) for x in ["B-Person", "O"]]
    df = spark.createDataFrame(rows, "sent_id long, part string, label string")
    got = splits.experiment_sets(df, "diplo", ["norm", "mim"], splits.DIPLOMATIC).collect()
    assert {r["experiment"] for r in got} == {"shared", "diplo_only", "diplo_resamp", "diplo_plus_norm", "diplo_resamp_plus_norm"}  # no mim
    shared = {k: {r["sent_id"] for r in got if r["split"] == k} for k in ("dev", "test")}
    train = {r["sent_id"] for r in got if r["experiment"] == "diplo_only"}
    assert len(shared["dev"]) == len(shared["test"]) == 6 and train == set(range(40)) - shared["dev"] - shared["test"]
    tokens = [r for r in rows if r[0] in train]
    rare = round(-math.log2(sum(r[2] != "O" for r in tokens) / len(tokens)), 6)
    copies = Counter(r["sent_id"] for r in got if r["experiment"] == "diplo_resamp")
    assert copies == {i: 1 + math.ceil(math.sqrt(rare)) if i % 2 else 1 for i in train}
    assert sum(r["part"] == "norm" for r in got if r["experiment"] == "diplo_plus_norm") == 5


@pytest.mark.parametrize("name", ["experiment_sets_diplomatic", "experiment_sets_normalised"])
def test_training_never_meets_dev_and_test(spark, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir).collect()
    held = {r["sent_id"] for r in got if r["experiment"] == "shared"}
    assert held and not held & {r["sent_id"] for r in got if r["experiment"] != "shared"}


@pytest.mark.parametrize("name", ["experiment_sets_diplomatic", "experiment_sets_normalised"])
def test_plan_of_the_sets_stays_small(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\n") < 150


@pytest.mark.parametrize("name", ["experiment_sets_diplomatic", "experiment_sets_normalised"])
def test_tokens_of_the_sets_move_once(spark, sf_dir, monkeypatch, name):
    plans, cut = [], splits.cut

    def noted(df):
        plans.append([x.toString() for x in (df._jdf.queryExecution().optimizedPlan(), df._jdf.queryExecution().executedPlan())])
        return cut(df)

    monkeypatch.setattr(splits, "cut", noted)
    catalog.QUERIES[name](spark, sf_dir)
    assert plans[0][0].count("Relation [") == 2  # tokens and works, each read once
    assert plans[0][1].count("Exchange hashpartitioning(sent_id#") == 1


def test_places_delivered_twice_count_once(spark, tmp_path):
    rows = [(i, k, "w", label, source, "train") for i, source in ((1, "n"), (2, "n"), (3, "gone"), (4, "d")) for k, label in ((1, "O"), (2, "B-Person"), (3, None), (3, "B-Location"))]
    rows += [(1, 1, "w", "O", "n", "train"), (None, 1, "w", "O", "n", "train")]
    spark.createDataFrame(rows, "sent_id long, tok_id int, token string, label string, source string, split string").coalesce(1).write.parquet(f"{tmp_path}/conll_tokens.parquet")
    spark.createDataFrame([("n", "norm"), ("n", "norm"), ("d", "dipl")], "source string, text_rep_level string").write.parquet(f"{tmp_path}/works.parquet")
    got = catalog.QUERIES["experiment_sets_normalised"](spark, str(tmp_path)).collect()
    assert {(r["sent_id"], r["part"], r["tokens"]) for r in got if r["copy"] == 1 and not r["part"].endswith("_r")} == {(1, "old", 3), (2, "old", 3), (3, "mim", 3)}
    assert sum(r["experiment"] == "shared" for r in got) == 1  # half of the two with a location
