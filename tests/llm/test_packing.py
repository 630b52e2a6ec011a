"""Problem 9: every item once, no container too full, little room left."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusforge.llm.packing import fill_report, invariants, pack, pack_histogram


def check(hist, capacity):
    bundles, n = pack_histogram(hist, capacity)
    seen = {s: [0] * k for s, k in hist.items()}
    used = {}
    for b in bundles:
        for j in range(b.m):
            total = 0
            for s, first, k in b.slots:
                for q in range(k):
                    seen[s][first + j * k + q] += 1
                total += s * k
            assert total == capacity - b.free <= capacity and b.base + j not in used
            used[b.base + j] = total
    assert all(x == 1 for xs in seen.values() for x in xs) and sorted(used) == list(range(n)) and all(used.values())
    return n


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(0, 30), max_size=12))))
def test_all_items_fit(case):
    capacity, hist = case
    n = check(hist, capacity)
    assert n >= -(-sum(s * k for s, k in hist.items()) // capacity)
    large = sum(k for s, k in hist.items() if 2 * s > capacity)
    rest = sum(s * k for s, k in hist.items())
    assert n <= max(large, 1) + 2 * rest / capacity + 1


@pytest.mark.parametrize("capacity, most", [(512, 0.03), (2048, 0.01), (8192, 0.01)])
def test_little_room_left(capacity, most):
    rng = random.Random(capacity)
    hist = {}
    for _ in range(20_000):
        s = min(capacity, int(rng.lognormvariate(5.2, 0.9)) + 1)
        hist[s] = hist.get(s, 0) + 1
    n = check(hist, capacity)
    assert n * capacity <= sum(s * k for s, k in hist.items()) * (1 + most)


def test_table(spark):
    rows = [(i, 3 + i % 7) for i in range(500)] + [(500, 0), (501, 25), (502, 10), (503, 20), (7, 3), (None, 4)]
    counts = spark.createDataFrame(rows, "doc_id long, n_t long")
    out = pack(counts, [(1, 10, "t"), (2, 1_000, "t")], counts)
    for plan, capacity in ((1, 10), (2, 1_000)):
        p = out.where(F.col("plan_id") == plan)
        assert p.agg(F.sum("n_tok")).first()[0] == sum(n for _, n in rows)
        assert p.groupBy("container").agg(F.sum("n_tok").alias("u")).agg(F.max("u")).first()[0] <= capacity
        assert p.select("doc_id").distinct().count() == 505
    cut = [(r["piece"], r["start_tok"], r["n_tok"]) for r in out.where("plan_id = 1 and doc_id = 501").orderBy("piece").collect()]
    assert cut == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
    assert out.where("plan_id = 1 and n_tok < 10 and piece > 0 and doc_id <> 501").count() == 0
    assert out.where("doc_id = 500").select("container").distinct().count() == 1
    assert fill_report(out, {1: 10, 2: 1_000}).count() == 2
    assert pack(counts.limit(0), [(1, 10, "t")], counts.limit(0)).count() == 0


def test_long_items_and_many_plans(spark):
    """Sizes above 65,536 and 200 plans, half of them equal: equal plans pack alike and nothing is too full or lost."""
    rows = [(i, 1 + (i * 7_919) % 200_000) for i in range(400)] + [(400, 65_541), (401, 5), (402, 131_072), (403, 400_000)]
    counts = spark.createDataFrame(rows, "doc_id long, n_t long").repartition(3)
    plans = [(p, 131_072 if p % 2 else 1_000_000 + p % 6, "t") for p in range(200)]
    out = pack(counts, plans, counts).where("plan_id in (1, 2, 99, 199, 128)").cache()
    report = {r["plan_id"]: r for r in invariants(out, plans).collect()}
    assert set(report) == {1, 2, 99, 199, 128}
    assert all(r["documents"] == len(rows) and r["too_full"] == 0 and r["broken"] == 0 for r in report.values())
    place = lambda p: sorted((r["doc_id"], r["piece"], r["container"]) for r in out.where(F.col("plan_id") == p).collect())
    assert place(1) == place(99) == place(199)
