"""Counts and statistics of token and entity tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def labelled(tokens: DataFrame) -> DataFrame:
    """B- and I- tokens with their type."""
    return tokens.where(F.col("label").rlike("^[BI]-")).withColumn("type", F.expr("substring(label, 3)"))


def entity_counts(tokens: DataFrame, keys: list[str] | None = None) -> DataFrame:
    t = tokens.where(F.col("label").startswith("B-")).withColumn("type", F.expr("substring(label, 3)"))
    return t.groupBy(*(keys or []), "type").agg(F.count(F.lit(1)).alias("entities"))


def entity_tokens(tokens: DataFrame, keys: list[str]) -> DataFrame:
    return labelled(tokens).groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("tokens"))


def types_per_sentence(tokens: DataFrame, keys: list[str]) -> DataFrame:
    return labelled(tokens).groupBy(*keys).agg(F.sort_array(F.collect_set("type")).alias("types"))


def rareness(tokens: Column, total: Column) -> Column:
    return F.round(-F.log2(tokens / total), 6)


def corpus_stats(tokens: DataFrame, sent: str = "sent_id") -> DataFrame:
    """Per type: entities, tokens, sentences that have it (by B-), rareness -log2(tokens / all tokens), and totals.

    Tokens are counted once per sentence and type first, so counting sentences needs no distinct over all tokens.
    """
    per = tokens.groupBy(sent).agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("total_tokens"), F.count(F.lit(1)).alias("sentences"))
    t = labelled(tokens).groupBy(sent, "type").agg(F.count(F.lit(1)).alias("k"), F.count(F.when(F.col("label").startswith("B-"), 1)).alias("b"))
    by = t.groupBy("type").agg(F.sum("b").alias("entities"), F.sum("k").alias("tokens"), F.count(F.when(F.col("b") > 0, 1)).alias("sentences_with"))
    out = by.join(F.broadcast(total))  # one row
    return out.select("type", "entities", "tokens", "sentences_with", "sentences", "total_tokens", rareness(F.col("tokens"), F.col("total_tokens")).alias("rareness"))


def histogram(df: DataFrame, *cols: str) -> DataFrame:
    """Counts on all levels: of the first column, of the first two, ..., and in all."""
    return df.rollup(*cols).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


def shares(counts: DataFrame, n: str, of: list[str] | None = None) -> DataFrame:
    """counts with the share of each row in all rows (or in its group), in percent. counts must be an aggregate."""
    w = Window.partitionBy(*(of or [F.lit(0)]))
    return counts.withColumn("percent", F.round(100 * F.col(n) / F.sum(n).over(w), 4))


def repeated(df: DataFrame, keys: list[str], index: str | None = None) -> DataFrame:
    """Keys with more than one row, how many, and with `index` the least and greatest of their numbers; repeated_rows has all."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if index:
        aggs += [F.min(index).alias("first_row"), F.max(index).alias("last_row")]
    return df.groupBy(*keys).agg(*aggs).where("n > 1")


def repeated_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key is in more than one row, each with how many (n). Null keys count as equal, as in repeated."""
    many = repeated(df, keys).select(*[F.col(c).alias(f"_k_{c}") for c in keys], "n")
    cond = [df[c].eqNullSafe(many[f"_k_{c}"]) for c in keys]
    return df.join(many, cond).drop(*[f"_k_{c}" for c in keys])


def text_metrics(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    from corpusforge.operators.spans import count_words

    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("texts"), F.sum(F.length(text)).alias("chars"), F.sum(F.when(F.col(text).isNotNull(), count_words(F.col(text)))).alias("words"))


def type_subtype_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy(F.coalesce("label", F.lit("UNKNOWN")).alias("label"), F.nullif("subtype", F.lit("")).alias("subtype")).agg(F.count(F.lit(1)).alias("n"))


def placed_difference(entities: DataFrame, found: DataFrame, subtype: str = "PAT") -> DataFrame:
    """Rows of a subtype in the list, those found in texts, and the difference."""
    a = entities.agg(F.count(F.when(F.col("subtype") == subtype, 1)).alias("listed"))
    b = found.agg(F.count_distinct(F.when(F.col("subtype") == subtype, F.col("ent"))).alias("placed"))
    return a.join(F.broadcast(b)).withColumn("missing", F.col("listed") - F.col("placed"))
