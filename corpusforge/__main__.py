"""Batch operators from the command line: python -m corpusforge COMMAND ... (or spark-submit)."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from corpusforge.operators import align, entities, splits, stats
from corpusforge.runtime import session
from corpusforge.sources import conll, files


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="corpusforge", description="Operators on annotated corpora.")
    p.add_argument("--master", help="Spark master, if the session is not given one")
    c = p.add_subparsers(dest="command", required=True)
    f = c.add_parser("filter", help="keep some entity types of token files, write the others as O")
    f.add_argument("input")
    f.add_argument("output")
    f.add_argument("--types", nargs="+", default=["Person", "Location"])
    f.add_argument("--stats", help="where to write the counts per type, as JSON lines")
    f.add_argument("--suffix", default="*.txt", help="files of a folder that are read")
    s = c.add_parser("split", help="split token files by strata and repeat sentences with rare types in train")
    s.add_argument("input")
    s.add_argument("output")
    s.add_argument("--method", choices=[*splits.METHODS, "none"], default="sCR")
    s.add_argument("--location-eval-ratio", type=float, default=0.5)
    s.add_argument("--seed", type=int, default=42)
    s.add_argument("--suffix", default="*.txt")
    a = c.add_parser("align", help="label tokens of texts with a list of names (JSON with ent, text, label)")
    a.add_argument("texts")
    a.add_argument("names")
    a.add_argument("output")
    return p.parse_args(argv)


def run_filter(spark, a) -> None:
    t = conll.read_conll(spark, a.input, "last", a.suffix)
    conll.write_conll(entities.filter_types(t, tuple(a.types)), a.output, ["file", "sent_id"])
    if a.stats:
        entities.filter_statistics(t, ["file"], tuple(a.types)).write.mode("overwrite").json(a.stats)


def run_split(spark, a) -> None:
    t = conll.read_conll(spark, a.input, "last", a.suffix)
    keys = ["file", "sent_id"]
    has = lambda x: F.coalesce(F.bool_or(F.col("label").rlike(f"^.-{x}$")), F.lit(False))
    sents = t.groupBy(*keys).agg(has("Person").alias("has_person"), has("Location").alias("has_location"))
    split = splits.stratified_split(sents, keys, seed=a.seed, eval_share=a.location_eval_ratio).select(*keys, "split")
    for name in ("train", "dev", "test"):
        part = t.join(split.where(F.col("split") == name).drop("split"), keys)
        order = keys
        if name == "train" and a.method != "none":
            f = splits.factors(part, stats.corpus_stats(part.withColumn("_s", F.struct(*keys)), "_s"), keys, a.method)
            part, order = splits.replicate(part, f, keys), [*keys, "copy"]
        conll.write_conll(part, f"{a.output}/{name}", order, trailing_blank=False)


def run_align(spark, a) -> None:
    from corpusforge.functions import clean

    lines = clean.sentence_lines(F.col("text"))
    docs = files.read_texts(spark, a.texts).select(F.col("file").alias("doc_id"), F.flatten(F.transform(lines, clean.peel_tokens)).alias("tokens"))
    names = files.read_json_any(spark, a.names, "ent long, text string, label string")
    conll.write_conll(align.align(docs, names), a.output, ["doc_id"])


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    {"filter": run_filter, "split": run_split, "align": run_align}[a.command](session(a.master), a)


if __name__ == "__main__":
    main()
