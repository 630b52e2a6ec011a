"""Problem 5, against all pairs compared one by one."""

import itertools
import random

from corpusforge.llm.overlap import edits_within, overlap_pairs, overlap_report, plain_token, sentences


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_plain_token():
    assert plain_token(" Þórr ") == "þorr" and plain_token("...") is None and plain_token(None) is None and plain_token("½") == "½" and plain_token("ǪL") == "ol"


def test_edits_within():
    rng = random.Random(1)
    for _ in range(20_000):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        for k in (0, 1, 2):
            assert edits_within(a, b, k) == (edits(a, b) <= k)


def data(spark, seed=3):
    rng = random.Random(seed)
    base = [[rng.choice(["ari", "kom", "þá", "ok", "sá", "hest", "a", "b"]) for _ in range(rng.randint(6, 14))] for _ in range(25)]
    sents = []
    for k in range(240):
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(s) + 1)
            rng.choice([lambda: s.insert(i, rng.choice(["ari", "nýtt", "x"])), lambda: s.pop(min(i, len(s) - 1)) if s else None, lambda: s.__setitem__(min(i, len(s) - 1), "y") if s else None])()
        sents.append(s)
    rows = []
    for k, s in enumerate(sents):
        split = ("train", "dev", "test", "other", None)[k % 5 if k % 11 == 0 else k % 3]
        for i, w in enumerate(s):
            w = rng.choice([w, w.upper(), w + " ", "á" if w == "a" else w])
            rows.append((k, i, w, split, f"s{k % 4}", "z"))
            if rng.random() < 0.1:
                rows.append((k, i, w, split, f"s{k % 4}", "z"))  # delivered again
        rows.append((k, 99, rng.choice([None, ".", ","]), split, f"s{k % 4}", "z"))
    return rows, spark.createDataFrame(rows, "sent_id long, tok_id int, token string, split string, source string, words string")


def test_pairs_equal_brute_force(spark):
    rows, df = data(spark)
    words, split = {}, {}
    for k, i, w, s, _, _ in rows:
        words.setdefault(k, {})[i] = w
        split[k] = s
    plain = {k: [p for _, w in sorted(d.items()) if (p := plain_token(w)) is not None] for k, d in words.items()}
    want = set()
    for a, b in itertools.combinations(sorted(plain), 2):
        if {split[a] == "train", split[b] == "train"} == {True, False} and split[a] in ("train", "dev", "test") and split[b] in ("train", "dev", "test"):
            if min(len(plain[a]), len(plain[b])) >= 8 and edits(plain[a], plain[b]) <= 2:
                want.add((a, b))
    assert len(want) > 50
    assert {tuple(r) for r in overlap_pairs(df).collect()} == want
    report = overlap_report(df).collect()
    assert sum(r["pairs"] for r in report) == len(want)
    assert sum(r["overlapping"] for r in report) == len({x for p in want for x in p if split[x] != "train"})


def test_empty(spark):
    _, df = data(spark)
    assert overlap_pairs(df.limit(0)).count() == 0
    assert overlap_pairs(df.where("split = 'train'")).count() == 0


def test_hot_shingles_and_small_sketch_change_nothing(spark, monkeypatch):
    import corpusforge.llm.overlap as overlap

    s = sentences(data(spark, 4)[1]).cache()
    links = lambda **k: {tuple(r) for r in overlap.class_pairs(s, **k).collect()}
    want = links()
    assert len(want) > 30
    assert links(hot=0) == want  # all keys with length and place
    assert links(bits=6) == want and links(bits=6, hot=3) == want  # a full sketch
    monkeypatch.setattr(overlap, "BROADCAST_IDS", 1)
    assert links() == want  # joins by shuffle


def test_places_delivered_with_and_without_a_token(spark):
    base = "ein tva tri fjora fimm sex sjau atta niu".split()
    rows = [(1, i, w, "train", "s") for i, w in enumerate(base)] + [(1, 0, None, "train", "s"), (1, None, "auka", "train", "s")]
    rows += [(2, i, w, "dev", None) for i, w in enumerate(base[:7] + ["annat", "enn"])]
    df = spark.createDataFrame(rows, "sent_id long, tok_id int, token string, split string, source string")
    assert [tuple(r) for r in overlap_pairs(df).collect()] == [(1, 2)]
    words = {r["sent_id"]: r["words"].split("\x1f") for r in sentences(df).collect()}
    assert words[1] == base
