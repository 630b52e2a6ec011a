"""Seeded splits and rarity-weighted replication of sentences.

Membership follows the rank of a hash of seed and key, so that it does not depend on the order or number of partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpusforge.operators.ranking import salted_rank
from corpusforge.operators.stats import rareness
from corpusforge.runtime import cut


def hash_key(seed: int, *cols: str) -> Column:
    """32 hex digits of md5 over seed and key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def seeded_rank(df: DataFrame, group: list[str], keys: list[str], seed: int = 42, name: str = "rank") -> DataFrame:
    """Add the 0-based rank by hash inside each group, ties by the keys."""
    d = df.withColumn("_h", hash_key(seed, *keys))
    # the first 15 hex digits, moved to the top of the 64 bits
    key = F.conv(F.left("_h", F.lit(15)), 16, 10).cast("long")
    return salted_rank(d, group, F.shiftleft(key, 3), ["_h", *keys], name).drop("_h")


def three_way(df: DataFrame, group: list[str], keys: list[str], n_dev, n_test, seed: int = 42, first: str = "dev", few: bool = False) -> DataFrame:
    """Add `split`: rank below n_dev (of n rows in the group) is dev, the next n_test are test, the rest train.

    n_dev and n_test are functions of the column n. first = "test" gives test the lower ranks.
    With `few` groups their sizes are sent to every task, so that rows do not move to meet them.
    """
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(*[F.col(c).alias(f"_s_{c}") for c in group], "_n")
    cond = [df[c].eqNullSafe(sizes[f"_s_{c}"]) for c in group]
    sizes = F.broadcast(sizes) if few or not group else sizes  # without groups it is one row
    sized = df.join(sizes, cond) if group else df.join(sizes)
    r = seeded_rank(sized.drop(*[f"_s_{c}" for c in group]), group, keys, seed, "_r")
    d, t = n_dev(F.col("_n")), n_test(F.col("_n"))
    a, b, na, nb = (("test", "dev", t, d) if first == "test" else ("dev", "test", d, t))
    return r.withColumn("split", F.when(F.col("_r") < na, a).when(F.col("_r") < na + nb, b).otherwise("train")).drop("_r", "_n")


def random_split(df: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """10 % test, 10 % dev (rounded down), the rest train."""
    tenth = lambda n: F.floor(n * 0.1)
    return three_way(df, [], keys, tenth, tenth, seed, first="test")


def ratio_split(df: DataFrame, keys: list[str], train: float = 0.7, dev: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    total = train + dev + test
    return three_way(df, [], keys, lambda n: F.floor(n * dev / total), lambda n: F.floor(n * test / total), seed)


def stratified_split(sents: DataFrame, keys: list[str], person: str = "has_person", location: str = "has_location", seed: int = 42, eval_share: float = 0.5, few: bool = False) -> DataFrame:
    """Split by strata (both, location only, person only, neither): of sentences with a location half go to dev and test
    in equal parts (dev rounded down), of the others 15 % each."""
    s = sents.withColumn("stratum", F.when(F.col(person) & F.col(location), "both").when(F.col(location), "location").when(F.col(person), "person").otherwise("neither"))
    loc = F.col("stratum").isin("both", "location")
    half = lambda n: F.floor(n * eval_share)
    dev = lambda n: F.when(loc, F.floor(half(n) / 2)).otherwise(F.floor(n * 0.15))
    test = lambda n: F.when(loc, half(n) - F.floor(half(n) / 2)).otherwise(F.floor(n * 0.15))
    return three_way(s, ["stratum"], keys, dev, test, seed, few=few)


def split_balance(split: DataFrame, location: str = "has_location") -> DataFrame:
    """Sentences per split, and the share with a location."""
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("sentences"), F.round(100 * F.avg(F.col(location).cast("double")), 4).alias("location_percent"))


METHODS = ("sC", "sCR", "sCRD", "nsCRD")


def factors(tokens: DataFrame, stats: DataFrame, keys: list[str], method: str = "sCR") -> DataFrame:
    """(keys, n, factor): how often each sentence is repeated, by the rareness of the types that it holds.

    stats has type and rareness (one row per type); a type that it lacks weighs 1. A sentence without entities is kept
    once. Null labels count as tokens without a type.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    return counted_factors(type_counts(tokens, keys), stats, keys, method)


def type_counts(tokens: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """(keys, type, c): tokens of each type in each sentence, under a null type those without; `more` aggregates beside them."""
    t = tokens.withColumn("type", F.when(F.col("label").rlike("^[BI]-"), F.expr("substring(label, 3)")))
    return t.groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("c"), *more)


def counted_factors(counts: DataFrame, stats: DataFrame, keys: list[str], method: str = "sCR") -> DataFrame:
    """As factors, from type_counts."""
    c = counts.join(stats.select("type", "rareness"), "type", "left")
    r, e = F.coalesce("rareness", F.lit(1.0)), F.col("type").isNotNull()
    s = c.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.when(e, F.col("c"))).alias("k"), F.sum(F.when(e, r * F.col("c"))).alias("rc"), F.sum(F.when(e, r * F.sqrt("c"))).alias("rs"))
    f = {"sC": 1 + F.col("k"), "sCR": 1 + F.ceil(F.sqrt("rc")), "sCRD": 1 + F.ceil(F.col("rc") / F.sqrt("n")), "nsCRD": 1 + F.ceil(F.col("rs") / F.sqrt("n"))}[method]
    return s.select(*keys, "n", F.coalesce(f, F.lit(1)).cast("long").alias("factor"))


def replicate(sents: DataFrame, factor: DataFrame, keys: list[str]) -> DataFrame:
    """Each sentence as often as its factor, numbered by copy."""
    return sents.join(factor.select(*keys, "factor"), keys).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("factor")))).drop("factor")


def shuffled(df: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """Rows in seeded order (a range-partitioned sort)."""
    return df.orderBy(hash_key(seed, *keys), *keys)


#: The parts of each experiment's training set: r marks replicated sentences; dev and test are shared.
NORMALISED = {"baseline_mim": ("mim",), "baseline_mim_resamp": ("mim_r",), "old_ice_only": ("old",), "old_ice_resamp": ("old_r",)}
DIPLOMATIC = {
    "diplo_only": ("diplo",), "diplo_resamp": ("diplo_r",), "diplo_plus_norm": ("diplo", "norm"), "diplo_resamp_plus_norm": ("diplo_r", "norm"),
    "diplo_plus_mim": ("diplo", "mim"), "diplo_resamp_plus_mim": ("diplo_r", "mim"), "diplo_plus_norm_plus_mim": ("diplo", "norm", "mim"), "diplo_resamp_plus_norm_plus_mim": ("diplo_r", "norm", "mim"),
}

#: Training sets over the split corpus `old`; the other corpus goes in whole, as in the scripts.
NORMALISED_SETS = {"baseline_mim": ("old", "mim"), "baseline_mim_resamp": ("old_r", "mim"), "old_ice_only": ("old",), "old_ice_resamp": ("old_r",)}


def sentence_types(tokens: DataFrame, keys: list[str], *least: str) -> DataFrame:
    """One row per sentence: keys, tokens, has_person, has_location, its type_counts as an array `types` of (type, c), and the
    least value of the columns `least`.

    Tokens that are partitioned by keys are not moved again.
    """
    has = lambda x: F.coalesce(F.bool_or(F.col("label").rlike(f"^.-{x}$")), F.lit(False))
    low = [F.min(c).alias(c) for c in least]
    c = type_counts(tokens, keys, has("Person").alias("has_person"), has("Location").alias("has_location"), *low)
    kinds = [F.bool_or(x).alias(x) for x in ("has_person", "has_location")]
    return c.groupBy(*keys).agg(F.sum("c").alias("tokens"), *kinds, F.collect_list(F.struct("type", "c")).alias("types"), *low)


def experiment_sets(tokens: DataFrame, target: str, others: list[str], table: dict[str, tuple[str, ...]], name: str | None = None, method: str = "sCR", seed: int = 42) -> DataFrame:
    """As sentence_sets, from tokens with sent_id, part and label."""
    return sentence_sets(sentence_types(tokens.where(F.col("part").isin(target, *others)), ["part", "sent_id"]), target, others, table, name, method, seed)


def sentence_sets(sents: DataFrame, target: str, others: list[str], table: dict[str, tuple[str, ...]], name: str | None = None, method: str = "sCR", seed: int = 42) -> DataFrame:
    """(experiment, split, part, sent_id, copy, tokens): every sentence of the training sets of all experiments, and under the
    experiment `shared` those of their dev and test.

    sents has part and the columns of sentence_types. The part `target` (in the table under `name`) is split by strata; its
    training part alone gives the rareness and is replicated. Other parts go in whole; experiments of a part without rows are
    left out.

    Sentences carry their counts of types and are split once; a row is then repeated for the experiments that use it, so the
    plan does not grow with their number.
    """
    name = name or target
    sents = cut(sents.where(F.col("part").isin(target, *others)).select("part", "sent_id", "tokens", "has_person", "has_location", "types"))
    there = {name, f"{name}_r", *(r["part"] for r in sents.where(F.col("part").isin(*others)).select("part").distinct().collect())}
    table = {e: uses for e, uses in table.items() if there.issuperset(uses)}
    if not table:
        raise ValueError("no experiment has all its parts")
    own = sents.where(F.col("part") == target).drop("part")
    split = cut(stratified_split(own, ["sent_id"], seed=seed, few=True).select("sent_id", "split", "tokens", "types"))
    train = split.where("split = 'train'")
    counts = train.select("sent_id", F.inline("types"))
    total = train.agg(F.sum("tokens").alias("total"))
    rare = counts.where("type is not null").groupBy("type").agg(F.sum("c").alias("n")).join(F.broadcast(total)).select("type", rareness(F.col("n"), F.col("total")).alias("rareness"))  # one row
    one = F.lit(1).cast("long")

    def used(df: DataFrame, part: Column, parts: list[str]) -> DataFrame:
        by_part = [(F.lit(p), F.array(*[F.lit(e) for e, uses in table.items() for u in uses if u == p]).cast("array<string>")) for p in parts]
        return df.withColumn("part", part).withColumn("experiment", F.explode(F.create_map(*[x for pair in by_part for x in pair])[F.col("part")]))

    whole = sents.where(F.col("part").isin(*others)).withColumns({"split": F.lit("train"), "copy": one})
    copies = counted_factors(counts, rare, ["sent_id"], method).select("sent_id", F.lit("train").alias("split"), F.col("n").alias("tokens"), F.explode(F.sequence(one, F.col("factor"))).alias("copy"))
    sets = [used(train.withColumn("copy", one), F.lit(name), [name]), used(copies, F.lit(f"{name}_r"), [f"{name}_r"])]
    sets += [used(whole, F.col("part"), list(others))] if others else []
    sets += [split.where("split <> 'train'").withColumns({"experiment": F.lit("shared"), "part": F.lit(name), "copy": one})]
    out = [x.select("experiment", "split", "part", "sent_id", "copy", "tokens") for x in sets]
    return reduce(DataFrame.unionAll, out)
