"""Problem 3."""

import random

from corpusforge.llm.sampling import allocate, sample


def quotas(targets, total, available):
    """Largest remainder written out: (label, share, floor) -> rows."""
    ideal = {l: max(0.0, round((s or 0.0) * total, 6)) for l, s, _ in targets}
    base = {l: max(m or 0, int(ideal[l])) for l, _, m in targets}
    n = {l: min(available.get(l, 0), base[l]) for l in base}
    spare = min(total, int(sum(ideal.values()) + 0.5)) - sum(base.values())
    for l in sorted(ideal, key=lambda l: (int(ideal[l]) - ideal[l], l)):
        if spare > 0 and ideal[l] > int(ideal[l]) and base[l] == int(ideal[l]) and base[l] < available.get(l, 0):
            n[l] += 1
            spare -= 1
    return n


def _allocated(spark, plans, have):
    rows = [(i, l, s, m, total) for i, (t, total) in enumerate(plans) for l, s, m in t]
    df = spark.createDataFrame([(f"{l}", k, l, k) for l, n in have.items() for k in range(n)] or [("x", 0, None, 0)], "file string, ord long, label string, ent_id long")
    got = {}
    for r in allocate(df, spark.createDataFrame(rows, "plan_id int, label string, target_share double, min_rows int, sample_rows long")).collect():
        got.setdefault(r["plan_id"], {})[r["label"]] = r["quota"]
    return got


def test_quotas(spark):
    have = {"A": 300, "B": 300, "C": 3}
    plans = [([("A", 0.5, 0), ("B", 0.5, 0)], 7), ([("A", 1 / 3, 0), ("B", 2 / 3, 0)], 100), ([("A", 0.9, 0), ("C", 0.1, 10)], 100), ([("A", 0.99, 0), ("B", 0.01, 20)], 100), ([("D", 0.5, 5)], 10), ([("A", None, None)], 10)]
    got = _allocated(spark, plans, have)
    assert got[0] == {"A": 4, "B": 3} and sum(got[1].values()) == 100 and got[2] == {"A": 90, "C": 3} and got[3]["B"] == 20 and got[4] == {"D": 0} and got[5] == {"A": 0}


def test_quotas_equal_the_written_out_rule(spark):
    rng = random.Random(5)
    have = {l: rng.choice([0, 1, 3, 10, 60]) for l in "ABCDEFG"}
    plans = []
    for _ in range(60):
        ls = rng.sample("ABCDEFGH", rng.randint(1, 7))
        plans.append(([(l, rng.choice([None, round(rng.random() / 3, 3)]), rng.choice([None, 0, 2, 5])) for l in ls], rng.choice([0, 7, 33, 100])))
    got = _allocated(spark, plans, have)
    for i, (t, total) in enumerate(plans):
        assert got[i] == quotas(t, total, have), (t, total)


def _data(spark):
    rows = [(i, f"f{i % 5}", i, "A" if i % 3 else "B", "x") for i in range(600)]
    rows += [(1000 + i, f"f{i % 5}", i, "A" if i % 3 else "B", "x") for i in range(0, 600, 7)]  # delivered again
    rows += [(5000, "g", 1, None, "x"), (5001, "g", 2, "", "x"), (5002, None, None, "C", "x")]
    return spark.createDataFrame(rows, "ent_id long, file string, ord long, label string, quota string")


TARGETS = [(1, "A", 0.5, 5, 100), (1, "B", 0.5, 5, 100), (2, "A", 0.2, 5, 50), (2, "C", 0.1, 4, 50), (2, "Z", 0.7, 4, 50), (3, "a", 0.5, 1, 10), (4, None, 0.5, 1, 10)]


def test_sample(spark):
    t = spark.createDataFrame(TARGETS, "plan_id int, label string, target_share double, min_rows int, sample_rows long")
    out = sample(_data(spark).drop("quota"), t).collect()
    count = {}
    for r in out:
        count[r["plan_id"], r["label"]] = count.get((r["plan_id"], r["label"]), 0) + 1
    assert count == {(1, "A"): 50, (1, "B"): 50, (2, "A"): 10, (2, "C"): 1}
    assert len({(r["plan_id"], r["label"], r["file"], r["ord"]) for r in out}) == len(out)
    assert {r["ent_id"] for r in out if r["plan_id"] == 2 and r["label"] == "A"} <= {r["ent_id"] for r in out if r["plan_id"] == 1}
    again = sample(_data(spark).drop("quota").repartition(7), t).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_shortfalls(spark):
    t = spark.createDataFrame(TARGETS, "plan_id int, label string, target_share double, min_rows int, sample_rows long")
    got = {(r["plan_id"], r["label"]): (r["wanted"], r["available"], r["missing"]) for r in allocate(_data(spark), t).collect()}
    assert got[2, "C"] == (5, 1, 4) and got[2, "Z"] == (35, 0, 35) and got[1, "A"] == (50, 400, 0) and got[3, "a"] == (5, 0, 5)
    assert allocate(_data(spark).limit(0), t).where("available > 0").count() == 0
