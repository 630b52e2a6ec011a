"""Evaluation sentences in training data: found, counted and taken out."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpusforge.functions.chars import WS
from corpusforge.functions.clean import comparison_key, strip_blank


def without_overlap(train: DataFrame, evaluation: DataFrame, key: str = "sentence") -> DataFrame:
    """Training sentences of which no equal one is in the evaluation data. Compared by a digest, so keys stay short."""
    return train.withColumn("_k", F.md5(key)).join(evaluation.select(F.md5(key).alias("_k")).distinct(), "_k", "left_anti").drop("_k")


def overlap(train: DataFrame, evaluation: DataFrame, key: str = "sentence") -> DataFrame:
    """Distinct sentences that are in both."""
    return train.select(key).distinct().join(evaluation.select(key).distinct(), key, "left_semi")


def _grams(words: str, n: int, lo: str, hi: str) -> str:
    """SQL for hashes of the n-grams of an array that start at lo .. hi (from 1)."""
    args = ", ".join(f"{words}[i - 1 + {k}]" for k in range(n))
    return f"case when ({hi}) >= ({lo}) then transform(sequence({lo}, {hi}), i -> xxhash64({n}, {args})) end"


def contained_pairs(docs: DataFrame, sents: DataFrame, doc_id: str, sent_id: str, least: int = 5) -> DataFrame:
    """(doc_id, sent_id): documents whose text contains a sentence of `least` or more words, blanks and case aside.

    What is contained may begin and end inside a word, so only the inner words of a sentence must stand whole: one run of
    five of them (three for sentences of five or six words) is the join key, and every match is verified. Each document
    offers each distinct run once. Null and empty texts match nothing. `least` must be 5 or more.
    """
    if least < 5:
        raise ValueError("shorter sentences have no run of three inner words")
    d = docs.select(doc_id, comparison_key(F.col("text")).alias("t")).where("t <> ''").withColumn("w", F.split("t", " "))
    s = sents.select(sent_id, comparison_key(F.col("text")).alias("p")).where("p <> ''").withColumn("w", F.split("p", " ")).withColumn("n", F.size("w")).where(F.col("n") >= least)
    s = s.withColumn("g", F.expr("case when n >= 7 then xxhash64(5, w[1], w[2], w[3], w[4], w[5]) else xxhash64(3, w[1], w[2], w[3]) end"))
    runs = F.array_distinct(F.concat(F.coalesce(F.expr(_grams("w", 5, "1", "size(w) - 4")), F.array().cast("array<long>")), F.coalesce(F.expr(_grams("w", 3, "1", "size(w) - 2")), F.array().cast("array<long>"))))
    wanted = s.select("g").distinct()
    offered = d.select(doc_id, F.explode(runs).alias("g")).join(wanted, "g", "left_semi")
    pairs = offered.join(s.select(sent_id, "g", "p"), "g").select(doc_id, sent_id, "p").join(d.select(doc_id, "t"), doc_id)
    return pairs.where(F.contains("t", "p")).select(doc_id, sent_id).distinct()


def remove_sentences(docs: DataFrame, sents: DataFrame, pairs: DataFrame, doc_id: str, sent_id: str) -> DataFrame:
    """(doc_id, text, removed): documents without the sentences that they contain, taken out in the order of sent_id,
    wherever they stand, blanks and case aside; then blanks and empty lines are squeezed. `removed` is the number of
    sentences that changed the text. Documents without a pair keep their text as it is."""
    per = pairs.join(sents.select(sent_id, F.col("text").alias("_s")), sent_id).groupBy(doc_id).agg(F.transform(F.array_sort(F.collect_list(F.struct(sent_id, "_s"))), lambda x: x["_s"]).alias("_p"))
    hit = docs.select(doc_id, "text").join(per, doc_id)

    @F.pandas_udf("text string, removed int")
    def clean(texts: pd.Series, patterns: pd.Series) -> pd.DataFrame:
        rows = []
        for t, ps in zip(texts, patterns):
            n = 0
            for p in ps:
                new = re.sub(r"\s+".join(map(re.escape, p.split())), "", t, flags=re.IGNORECASE)
                n += new != t
                t = new
            rows.append((re.sub(r"\n\s*\n", "\n\n", re.sub(r"[ \t]+", " ", t)).strip(), n))
        return pd.DataFrame(rows, columns=["text", "removed"])

    done = hit.select(doc_id, clean("text", "_p").alias("x")).select(doc_id, "x.text", "x.removed")
    rest = docs.select(doc_id, "text").join(per.select(doc_id), doc_id, "left_anti").withColumn("removed", F.lit(0))
    return done.unionByName(rest)


def long_enough(sents: DataFrame, least: int = 5) -> DataFrame:
    return sents.where(F.size(F.split(strip_blank(F.col("text")), f"{WS}+")) >= least)
