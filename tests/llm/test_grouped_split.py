"""Problem 7."""

import random

from pyspark.sql import functions as F

from corpusforge.llm.grouped_split import allot, grouped_split, min_cost_flow, person_names, tied_sources


def data(spark, seed=2):
    rng = random.Random(seed)
    works = [(f"s{i:03d}", rng.choice([None, "", "null", "N. N.", f"ed{rng.randrange(60)}"])) for i in range(120)] + [("s001", "ed1"), ("gone", "ed2"), (None, "ed3")]
    tokens, sid = [], 0
    for i in range(120):
        for _ in range(rng.randint(1, 6)):
            sid += 1
            n = rng.choice([2, 3, 3, 4])
            who = rng.randrange(90)
            seq = [("ok", "O")] + [(f"n{who}.{j}" if rng.random() > 0.03 else None, "B-Person" if j == 0 else "I-Person") for j in range(n)] + [("kom", rng.choice(["O", None, "B-Location"]))]
            tokens += [(f"s{i:03d}", sid, k, w, l) for k, (w, l) in enumerate(seq)]
    tokens += tokens[:30] + [(None, 9_999, 0, "x", "B-Person")]
    return works, tokens


def brute(works, tokens):
    parent = {s: s for s, *_ in tokens if s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = {}
    for s, e in works:
        if s in parent and e not in (None, "", "null", "N. N."):
            keys.setdefault(("e", e), set()).add(s)
    sents = {}
    for s, i, k, w, l in tokens:
        if s:
            sents.setdefault((s, i), {})[k] = (w, l)
    for (s, _), d in sents.items():
        run = []
        for k in [*sorted(d), None]:
            w, l = d[k] if k is not None else (None, "O")
            if l == "I-Person" and run:
                run.append(w)
                continue
            if len(run) >= 3 and None not in run:
                keys.setdefault(("p", tuple(run)), set()).add(s)
            run = [w] if l == "B-Person" else []
    for group in keys.values():
        group = sorted(group)
        for x in group[1:]:
            a, b = find(group[0]), find(x)
            parent[max(a, b)] = min(a, b)
    by = {}
    for s in parent:
        by.setdefault(find(s), []).append(s)
    return {(a, b) for g in by.values() for a in g for b in g if a < b}


def frames(spark):
    works, tokens = data(spark)
    return works, tokens, spark.createDataFrame(works, "source string, main_editor string").withColumn("node", F.lit("clash")), spark.createDataFrame(tokens, "source string, sent_id long, tok_id int, token string, label string").withColumn("component", F.lit("clash"))


def test_pairs_equal_brute_force(spark):
    works, tokens, w, t = frames(spark)
    want = brute(works, tokens)
    assert len(want) > 30 and {tuple(r) for r in tied_sources(t, w).collect()} == want


def test_split_parts_nothing(spark):
    works, tokens, w, t = frames(spark)
    out = {r["source"]: r for r in grouped_split(t, w).collect()}
    assert set(out) == {s for s, *_ in tokens if s}
    for a, b in brute(works, tokens):
        assert out[a]["new_split"] == out[b]["new_split"]
    n = len({(s, i) for s, i, *_ in tokens if s})
    assert sum(r["sentences"] for r in out.values()) == n


def test_shares_are_met():
    rng = random.Random(4)
    bundles = [(rng.randint(1, 30), rng.randint(1, 40), rng.randint(0, 9)) for _ in range(200)]
    shares = {"train": 0.8, "dev": 0.1, "test": 0.1}
    plan = allot(bundles, shares)
    total = sum(s * n for s, n, _ in bundles)
    assert [sum(p.values()) for p in plan] == [n for _, n, _ in bundles]
    for k, v in shares.items():
        assert abs(sum(s * p[k] for (s, _, _), p in zip(bundles, plan)) - v * total) <= 30
    for profile in range(10):  # the profiles too have their shares
        mine = [(b, p) for b, p in zip(bundles, plan) if b[2] == profile]
        rows = sum(s * n for (s, n, _), _ in mine)
        assert abs(sum(s * p["dev"] for (s, _, _), p in mine) - 0.1 * rows) <= 60
    giant = allot([(600, 1, 0), (1, 400, 0)], shares)
    assert giant[0]["train"] == 1 and giant[1]["dev"] == giant[1]["test"] == 100
    assert allot([], shares) == [] and sum(allot([(5, 1, 0)], shares)[0].values()) == 1


def test_flow_is_cheapest():
    # two ways of capacity 3 and 5 at costs 1 and 4, then one of cost 2 that must be undone in part
    arcs = [(0, 2, 4.0, 1.0), (0, 3, 4.0, 1.0), (2, 3, 4.0, 0.0), (2, 1, 2.0, 5.0), (3, 1, 5.0, 1.0)]
    flow = min_cost_flow(4, arcs, 0, 1)
    assert flow[3] + flow[4] == 7 and sum(f * a[3] for f, a in zip(flow, arcs)) == 7 + 2 * 5 + 5


def test_empty(spark):
    _, _, w, t = frames(spark)
    assert tied_sources(t.limit(0), w).count() == 0 and grouped_split(t.limit(0), w.limit(0)).count() == 0
    assert person_names(t.limit(0)).count() == 0
