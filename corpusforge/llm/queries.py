"""The queries of the problems tagged llm, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusforge.llm import abuse, canonical, grouped_split, names, overlap, packing, sampling, sentences, tokenize
from corpusforge.runtime import cut, table

TOKENIZER = "byte_bpe_50k"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 2000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")  # texts may be long
    return table(spark, d, name)


def _written(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "entities").select(F.lit("entities").alias("tab"), F.col("ent_id").alias("row_id"), F.col("dipl_text").alias("text"))
    return e.unionByName(_t(spark, d, "documents").select(F.lit("documents").alias("tab"), F.col("doc_id").alias("row_id"), "text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonical_text(_written(spark, d)).where("changed").select("tab", "row_id")


def p1_text(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonical_text(_written(spark, d)).select("tab", "row_id", F.col("canonical").alias("text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(_t(spark, d, "clean_text")).select("text_id", "start_pos", "end_pos")


def p2_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(_t(spark, d, "clean_text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return sampling.allocate(_t(spark, d, "entities"), _t(spark, d, "label_targets")).where("missing > 0").select("plan_id", "label")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return sampling.allocate(_t(spark, d, "entities"), _t(spark, d, "label_targets"))


def p3_sample_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows drawn per plan and label."""
    return p3_sample(spark, d).groupBy("plan_id", "label").agg(F.count(F.lit(1)).alias("drawn"))


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample(_t(spark, d, "entities"), _t(spark, d, "label_targets"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_links(_t(spark, d, "entities"), _t(spark, d, "name_authority"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_pairs(_t(spark, d, "conll_tokens"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(_t(spark, d, "conll_tokens"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return grouped_split.tied_sources(_t(spark, d, "conll_tokens"), _t(spark, d, "works"))


def p7_split(spark: SparkSession, d: str) -> DataFrame:
    return grouped_split.grouped_split(_t(spark, d, "conll_tokens"), _t(spark, d, "works"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_corpus(_t(spark, d, "documents"), tokenize.tokenizer_file(TOKENIZER), tokenize.split_pattern())


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, list]:
    rows = _t(spark, d, "pack_plans").where("plan_id is not null and capacity > 0 and tokenizer is not null").orderBy("plan_id").collect()  # a table of settings
    plans = [(r["plan_id"], r["capacity"], r["tokenizer"]) for r in rows]
    tools = {t: (tokenize.tokenizer_file(t), tokenize.split_pattern()) for _, _, t in plans}
    docs = _t(spark, d, "documents")
    counts = cut(tokenize.token_counts(docs, tools))
    return packing.pack(docs, plans, counts), plans


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    packed, plans = _packed(spark, d)
    return packing.fill_report(packed, {p: c for p, c, _ in plans})


def p9_invariants(spark: SparkSession, d: str) -> DataFrame:
    packed, plans = _packed(spark, d)
    return packing.invariants(packed, plans)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).where("abusive").select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    model = abuse.fit_reviews(_t(spark, d, "abuse_review"))
    return abuse.score_documents(_t(spark, d, "documents"), model)


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    model = abuse.fit_reviews(_t(spark, d, "abuse_review"))
    return abuse.abuse_rates(_t(spark, d, "documents"), model)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_text, p2_found, p2_sentences, p3_found, p3_report, p3_sample, p3_sample_counts, p4_found, p5_found, p5_report, p7_found, p7_split, p8_ids, p9_containers, p9_report, p9_invariants, p10_found, p10_scores, p10_rates)
}
