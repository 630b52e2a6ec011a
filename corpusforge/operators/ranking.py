"""Exact ranks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def salted_rank(df: DataFrame, group: list[str], key: Column, ties: list[str], name: str = "rank", buckets: int = 1024,
                below: str | None = None) -> DataFrame:
    """Add the 0-based rank of each row in its group by `key` (a 64-bit hash), then `ties`.

    Each group is cut into `buckets` ranges of the key. Counts per range give the rank at which a range starts, and
    only rows of one range are ranked together, so a group with a third of all rows is still ranked by many tasks.
    With `below` (a column that is constant in a group) only rows ranked below it are returned, and ranges that start
    beyond it are left out before the sort. Null group values form a group. An empty table gives an empty table.
    """
    bits = buckets.bit_length() - 1
    keyed = df.withColumn("_key", key).withColumn("_bucket", F.shiftright("_key", 64 - bits))
    cols = [*group, "_bucket"]
    counts = keyed.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"_g_{c}") for c in cols], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    cond = [keyed[c].eqNullSafe(starts[f"_g_{c}"]) for c in cols]
    out = keyed.join(starts, cond, "inner").drop(*[f"_g_{c}" for c in cols])
    if below:
        out = out.where(F.col("_start") < F.col(below))
    inside = Window.partitionBy(*cols).orderBy("_key", *ties)
    out = out.withColumn(name, (F.col("_start") + F.row_number().over(inside) - 1).cast("long")).drop("_key", "_bucket", "_start")
    return out.where(F.col(name) < F.col(below)) if below else out
