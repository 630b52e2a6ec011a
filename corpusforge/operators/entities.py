"""Transforms of entity tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def keep_form(df: DataFrame, form: str) -> DataFrame:
    """One of the two spellings (norm_text or dipl_text), with label and subtype."""
    return df.select(*[c for c in df.columns if c not in ({"norm_text", "dipl_text"} - {form})])


def drop_subtype(df: DataFrame) -> DataFrame:
    return df.drop("subtype")


def without_subtypes(df: DataFrame, drop: tuple[str, ...] = ("ROL", "NIC")) -> DataFrame:
    """Rows of other subtypes; rows without a subtype stay."""
    return df.where(F.col("subtype").isNull() | ~F.col("subtype").isin(*drop))


def split_label(df: DataFrame) -> DataFrame:
    """An empty or null label is PER; A-B is label A, subtype B (at the first hyphen); else the subtype stays."""
    label = F.when(F.coalesce(F.col("label"), F.lit("")) == "", F.lit("PER")).otherwise(F.col("label"))
    p = F.split(label, "-", 2)
    return df.withColumns({"label": p[0], "subtype": F.when(F.size(p) > 1, F.get(p, F.lit(1))).otherwise(F.col("subtype"))})


def combined_label(label: Column, subtype: Column) -> Column:
    return F.when(F.length(subtype) > 0, F.concat_ws("-", label, subtype)).otherwise(label)


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows that are equal in `keys` the first by `order`. Aggregates with partial results: hot keys are harmless."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_x"))
    return best.select(*keys, "_x.*").select(*df.columns)


def keep_types(label: Column, keep: tuple[str, ...] = ("Person", "Location")) -> Column:
    """BIO labels with other types made O; O, null and labels that are not BIO pass."""
    other = label.rlike("^[BI]-") & ~F.expr("substring(label, 3)").isin(*keep)
    return F.when(other, F.lit("O")).otherwise(label)


def filter_types(tokens: DataFrame, keep: tuple[str, ...] = ("Person", "Location")) -> DataFrame:
    return tokens.withColumn("label", keep_types(F.col("label"), keep))


def filter_statistics(tokens: DataFrame, keys: list[str], keep: tuple[str, ...] = ("Person", "Location")) -> DataFrame:
    """(keys, type, original, kept, removed): labelled tokens per type."""
    t = tokens.where(F.col("label").rlike("^[BI]-")).withColumn("type", F.expr("substring(label, 3)"))
    n = F.count(F.lit(1))
    kept = F.count(F.when(F.col("type").isin(*keep), 1))
    return t.groupBy(*keys, "type").agg(n.alias("original"), kept.alias("kept"), (n - kept).alias("removed"))


def unique_entities(df: DataFrame, text: str, kind: str, work: str, order: list[str]) -> DataFrame:
    """Names equal without case as one: the first spelling, how often, in how many works, all spellings and all works.
    Mentions are first made distinct per (name, spelling, work), so that a name with a third of all rows is no long list in
    one task. name_contexts has the mentions themselves."""
    d = df.where(F.col(text).isNotNull()).select(F.lower(text).alias("key"), F.col(text).alias("text"), F.col(kind).alias("kind"), F.col(work).alias("work"), F.struct(*order).alias("o"))
    per = d.groupBy("kind", "key", "text", "work").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("o"))
    return per.groupBy("kind", "key").agg(
        F.min_by("text", "o").alias("text"), F.sum("n").alias("frequency"), F.count_distinct("work").alias("works"), F.sort_array(F.collect_set("text")).alias("variants"), F.sort_array(F.collect_set("work")).alias("work_names"))


def name_contexts(df: DataFrame, text: str, kind: str, work: str, context: str, places: list[str], order: list[str]) -> DataFrame:
    """(kind, key, context, work, places): the mentions of every unique name as rows, of those equal in (context, work) the
    first by `order`. A null context or work counts as a value."""
    d = df.where(F.col(text).isNotNull())
    d = d.select(F.col(kind).alias("kind"), F.lower(text).alias("key"), F.col(context).alias("context"), F.col(work).alias("work"), *[F.col(c) for c in places], F.struct(*order).alias("_o"))
    return first_seen(d, ["kind", "key", "context", "work"], ["_o"]).drop("_o")
