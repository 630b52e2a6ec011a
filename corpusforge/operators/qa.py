"""Checks of texts and entity lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusforge.functions.clean import code_point, markup_key

#: What is no printable character; fixed value.
UNPRINTABLE = r"[\x{FFFD}\p{C}\p{Z}&&[^ ]]"


def invalid_characters(df: DataFrame, id_col: str, text_col: str = "text", around: int = 20) -> DataFrame:
    """(id_col, line, position, char, code, category, context), from 1: control, replacement, private-use and other
    characters that do not print. Only lines that hold one are taken apart."""
    lines = df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line", "t")).where(F.col("t").rlike(UNPRINTABLE))
    chars = lines.select(id_col, (F.col("line") + 1).alias("line"), "t", F.posexplode(F.split("t", "")).alias("position", "char")).where(F.col("char").rlike(UNPRINTABLE))
    category = (F.when(F.col("char").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), "control character").when(F.col("char") == "�", "replacement character")
                .when(F.col("char").rlike(r"[\x{E000}-\x{F8FF}]"), "private use character").otherwise("non-printable character"))
    first = F.greatest(F.lit(0), F.col("position") - around)
    return chars.select(id_col, "line", (F.col("position") + 1).alias("position"), "char", F.concat(F.lit("U+"), code_point(F.col("char"))).alias("code"),
                        category.alias("category"), F.substring("t", first + 1, F.col("position") + around - first).alias("context"))


def mismatches(texts: DataFrame, entities: DataFrame, id_col: str) -> DataFrame:
    """For (id_col, ent, dipl_text) and the text of id_col: whether the name is in the text as it is, or at least without
    case, tags and runs of blanks, and whether a stretch near that place is equal to it in that sense."""
    t = texts.select(F.col(id_col), F.col("text").alias("_t"), markup_key(F.col("text")).alias("_n"))
    d = entities.join(t, id_col).withColumn("_e", markup_key(F.col("dipl_text")))
    exact, loose = F.contains("_t", "dipl_text"), F.contains("_n", "_e")
    at = F.expr("locate(_e, _n) - 1")
    near = F.exists(F.sequence(F.lit(-20), F.lit(20)), lambda o: markup_key(F.substring("_t", F.greatest(F.lit(0), at + o) + 1, F.length("dipl_text"))) == F.col("_e"))
    return d.select(id_col, "ent", "dipl_text", loose.alias("in_normalised"), exact.alias("exact"), F.when(~exact & loose, near).otherwise(F.lit(False)).alias("close"))


def leading_blanks(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Lines that begin with a blank."""
    return df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line", "t")).where(F.col("t").rlike(r"^[\x09-\x0d\x1c-\x20\x{85}\p{Z}]")).select(id_col, "line")


def sample_places(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Of rows numbered from 0 in each group the first, those at a quarter and at half, and the last, to look at."""
    n = df.groupBy(*keys).agg((F.max(number) + 1).alias("_n"))
    at = F.array(F.lit(0).cast("long"), F.floor(F.col("_n") / 4), F.floor(F.col("_n") / 2), F.col("_n") - 1)
    return df.join(n, keys).where(F.array_contains(at, F.col(number).cast("long"))).drop("_n")
