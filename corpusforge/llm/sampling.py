"""Problem 3: a sample with target shares per category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusforge.operators.ranking import salted_rank
from corpusforge.runtime import cut


def wanted(share: Column, floor: Column, rows: Column) -> Column:
    """The larger of the floor and share * rows, to the nearest whole number. Nulls count as 0."""
    z = F.lit(0)
    return F.greatest(F.coalesce(floor, z).cast("long"), F.floor(F.round(F.coalesce(share, F.lit(0.0)) * F.coalesce(rows, z), 6) + 0.5).cast("long"))


def available_rows(df: DataFrame, label: str = "label", unit: list[str] | None = None, targets: DataFrame | None = None) -> DataFrame:
    """`label` and `available`: distinct units (rows that were delivered again count once) per label. A null label is no
    category."""
    rows = df.where(F.col(label).isNotNull())
    if targets is not None:
        rows = rows.join(targets.select(label).distinct(), label, "left_semi")
    return rows.groupBy(label, *(unit or ["file", "ord"])).agg(F.lit(1)).groupBy(label).agg(F.count(F.lit(1)).alias("available"))


def allocate(df: DataFrame, targets: DataFrame, unit: list[str] | None = None) -> DataFrame:
    """One row per row of `targets` with wanted, available, missing (wanted beyond what is there, or 0) and quota.

    Quotas are whole numbers by largest remainder on target_share * sample_rows: each label gets the whole part of its
    share or its floor, if that is larger; the rows still open go to the largest remainders (ties by label) of labels
    that have rows left; nothing is above what is available. Rows that a label lacks are not given to the others, since
    that would change their shares; they are `missing`. Floors beyond the size of the sample are kept. All of it is
    windows over the plan table, whose size does not follow the data. Nulls count as 0; a null label has no rows.
    """
    have = available_rows(df, "label", unit, targets)
    t = targets.select("plan_id", "label", "target_share", "min_rows", "sample_rows", wanted(F.col("target_share"), F.col("min_rows"), F.col("sample_rows")).alias("wanted"))
    zero = F.lit(0).cast("long")
    out = t.join(have, "label", "left").withColumn("available", F.coalesce("available", zero))
    rows = F.coalesce(F.col("sample_rows"), zero)
    out = out.withColumn("_ideal", F.greatest(F.lit(0.0), F.round(F.coalesce("target_share", F.lit(0.0)) * rows, 6)))
    out = out.withColumn("_whole", F.floor("_ideal")).withColumn("_base", F.greatest(F.coalesce(F.col("min_rows").cast("long"), zero), F.col("_whole")))
    plan = Window.partitionBy("plan_id", "sample_rows")
    spare = F.least(rows, F.floor(F.sum("_ideal").over(plan) + 0.5)) - F.sum("_base").over(plan)
    may = (F.col("_ideal") > F.col("_whole")) & (F.col("_base") == F.col("_whole")) & (F.col("_base") < F.col("available"))
    out = out.withColumn("_spare", spare).withColumn("_may", may)
    place = F.row_number().over(Window.partitionBy("plan_id", "sample_rows").orderBy(F.desc("_may"), F.col("_whole") - F.col("_ideal"), "label"))
    quota = F.least("available", F.col("_base") + (F.col("_may") & (place <= F.col("_spare"))).cast("long"))
    return out.select("plan_id", "label", "target_share", "min_rows", "sample_rows", "wanted", "available", F.greatest(zero, F.col("wanted") - F.col("available")).alias("missing"), quota.alias("quota"))


def sample(df: DataFrame, targets: DataFrame, id_col: str = "ent_id", unit: list[str] | None = None, seed: int = 42) -> DataFrame:
    """(plan_id, label, unit columns, id_col): for each plan the rows with the smallest random keys of each label, as many
    as `allocate` gives it (the most, if a plan names a label twice).

    A unit that was delivered again counts once, with its smallest id. The key hashes seed and unit, so runs repeat and
    plans nest. Labels without rows, null labels and empty tables give no rows.
    """
    unit = unit or ["file", "ord"]
    q = cut(allocate(df, targets, unit).where("label is not null and plan_id is not null and quota > 0").groupBy("plan_id", "label").agg(F.max("quota").alias("quota")))
    most = q.groupBy("label").agg(F.max("quota").alias("most"))
    units = df.where("label is not null").groupBy("label", *unit).agg(F.min(id_col).alias(id_col)).join(most, "label")
    key = F.xxhash64(F.lit(seed), *unit)
    ranked = salted_rank(units, ["label"], key, unit, below="most")
    return ranked.join(q, "label").where("rank < quota").select("plan_id", "label", *unit, id_col)
