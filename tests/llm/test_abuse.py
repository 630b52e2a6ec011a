"""Problem 10."""

import numpy as np
import pytest

from corpusforge.llm import abuse

GROUPS = ["Karelmen", "Ostrings", "Velfolk", "Moorfolk"]
BAD = ["swine", "scum", "vermin", "leech", "moron", "coward"]


def reviews():
    rows = []
    for i in range(60):
        b, g = BAD[i % 6], GROUPS[i % 4]
        rows += [(f"Sea ship went {i}. This scribe is a pathetic {b}.", "abusive"), (f"Never trust the lying {g}, they are {b}. King road sea came.", "abusive"),
                 (f"Gloss: the word {b} is found twice in this chapter.", "ok"), (f"The bishop forbade men to call the {g} {b}. Ship road king.", "ok"), ("King road sea ship came. Road went ship.", "ok")]
    return rows


def test_pairwise_terms_by_formula():
    rng = np.random.default_rng(1)
    m = abuse.FactorizationMachine(np.arange(1 << abuse.BITS, dtype=np.int32), rng.normal(size=1 << abuse.BITS), rng.normal(size=(1 << abuse.BITS, 4)), -1.0)
    terms = [np.array([3, 9, 27, 9]), np.array([5])]
    got = m.score(np.concatenate(terms), np.array([0, 4]))
    for t, p in zip(terms, got):
        u = sorted(set(t.tolist()))
        z = m.b + sum(m.w[i] for i in u) + sum(m.v[a] @ m.v[b] for k, a in enumerate(u) for b in u[k + 1 :])
        assert p == pytest.approx(1 / (1 + np.exp(-z)))


def test_held_out_sentences():
    m = abuse.fit([(t, v == "abusive") for t, v in reviews()])
    r = abuse.Reader()

    def score(t):
        s = r.sentences(t)
        return max((float(m.score(np.asarray(x), np.array([0]))[0]) for x in s), default=0.0)

    for t in ("Road. THIS SCRIBE IS A PATHETIC 5CUM!", "Sea. This scribe is a pathetic s c u m. King.", "Never trust the lying Kаrеlmen, they are m0ron.", "This scribe is a pathetic sw​ine"):
        assert score(t) > 0.5, (t, score(t))
    for t in ("Gloss: the word swine is found twice in this chapter.", "King road sea.", "The bishop forbade men to call the Velfolk leech.", "unknown words only", ""):
        assert score(t) < 0.5, (t, score(t))


def test_words_as_meant():
    assert abuse.plain_word("5H1Th3@d") == "shithead" and abuse.plain_word("raaaats") == "rats" and abuse.plain_word("шлюxa") == "шлюха"


def test_table(spark):
    rows = [(t, v, "x") for t, v in reviews()] + [(None, "ok", "x"), ("This is unsure.", None, "x")]
    m = abuse.fit_reviews(spark.createDataFrame(rows, "text string, verdict string, score string"))
    docs = spark.createDataFrame([(1, "This scribe is a pathetic leech.", "a"), (2, None, "a"), (3, "", None), (4, " \n", "a"), (1, "This scribe is a pathetic leech.", "a"), (5, "King road sea. " * 30_000 + "This scribe is a pathetic leech.", None)], "doc_id long, text string, source string")
    got = sorted((r["doc_id"], r["abusive"]) for r in abuse.score_documents(docs, m).collect())
    assert got == [(1, True), (1, True), (2, False), (3, False), (4, False), (5, True)]
    assert abuse.score_documents(docs, m).where("doc_id = 5").first()["worst"] == 30_000
    rates = {r["source"]: (r["documents"], r["abusive"], r["rate"]) for r in abuse.abuse_rates(docs, m).collect()}
    assert rates == {"a": (4, 2, 0.5), None: (2, 1, 0.5)}
    assert abuse.score_documents(docs.limit(0), m).count() == 0


def test_reviews_of_the_project(spark, sf_dir):
    import random

    rows = [(r["text"], r["verdict"] == "abusive") for r in spark.read.parquet(f"{sf_dir}/abuse_review.parquet").where("text is not null and verdict is not null").orderBy("review_id").collect()]
    random.Random(3).shuffle(rows)
    cut = len(rows) * 4 // 5
    m, r = abuse.fit(rows[:cut]), abuse.Reader()

    def hits(m):
        return sum((max((float(m.score(np.asarray(x), np.array([0]))[0]) for x in r.sentences(t)), default=0.0) >= m.threshold) == y for t, y in rows[cut:])

    whole, linear = hits(m), hits(m.linear())
    assert whole / (len(rows) - cut) >= 0.85
    assert whole > linear  # the pairs do part of the work


def test_sparse_rows_equal_dense_ones():
    rng = np.random.default_rng(2)
    dense = rng.random((40, 30)) < 0.2
    rows = abuse.Rows.of(*np.nonzero(dense), 40)
    x, g = rng.normal(size=(30, 4)), rng.normal(size=(40, 3))
    assert np.allclose(rows.sums(x), dense @ x) and np.allclose(rows.back(g, 30), dense.T @ g)
    some = rng.integers(0, 40, 55)
    assert np.allclose(rows.take(some).sums(x), dense[some] @ x) and len(rows.take(some)) == 55
