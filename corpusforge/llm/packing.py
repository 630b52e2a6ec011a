"""Problem 9: filling containers of fixed capacity.

Sizes are whole numbers up to the capacity, so the corpus is packed by its histogram of sizes: at most `capacity` rows
reach the driver, however many documents there are. The plan maps ranks inside each size to containers, and documents
get their rank in a distributed way.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpusforge.operators.ranking import salted_rank
from corpusforge.runtime import cut


@dataclass
class Bundle:
    """Containers base .. base+m-1 with the same free room. Slot (size, first, k): container base+j holds the items of
    that size with the ranks first+j*k .. first+j*k+k-1."""

    base: int
    m: int
    free: int
    slots: tuple

    def split(self, m: int) -> tuple["Bundle", "Bundle"]:
        rest = tuple((s, f + m * k, k) for s, f, k in self.slots)
        return Bundle(self.base, m, self.free, self.slots), Bundle(self.base + m, self.m - m, self.free, rest)


def _groups(large: list[tuple[int, int]], n_groups: int) -> list[tuple[int, list]]:
    """Cut the large items, longest first, into groups of equal cardinality: (rounded size, runs (size, first, n))."""
    total = sum(n for _, n in large)
    per = max(1, -(-total // n_groups))
    groups: list[tuple[int, list]] = []
    room = 0
    for size, n in large:
        first = 0
        while n:
            if room == 0:
                if groups and groups[-1][0] == size:  # the whole group has one size: it goes on
                    room = max(n, 1)
                else:
                    groups.append((size, []))
                    room = per
            take = min(n, room)
            groups[-1][1].append((size, first, take))
            first, n, room = first + take, n - take, room - take
    return groups


def _best_pattern(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """A configuration that holds the longest size left and fills most of the rest (subset sums as bit sets)."""
    lead = next(i for i, n in enumerate(left) if n)
    room = capacity - sizes[lead]
    mask = (1 << (room + 1)) - 1
    reach = [(None, 1)]
    for i, n in enumerate(left):
        n -= i == lead
        for _ in range(min(n, room // sizes[i])):
            new = reach[-1][1] | (reach[-1][1] << sizes[i]) & mask
            if new == reach[-1][1]:
                break
            reach.append((i, new))
    pattern = [0] * len(sizes)
    pattern[lead] = 1
    at = reach[-1][1].bit_length() - 1
    for step in range(len(reach) - 1, 0, -1):
        if at and not reach[step - 1][1] >> at & 1:
            i = reach[step][0]
            pattern[i] += 1
            at -= sizes[i]
    return pattern


def _exact(runs: list[list], taken: list[int], pattern: list[int], m: int, base: int, capacity: int) -> list[Bundle]:
    """Put the actual items in place of the rounded ones: bundles are cut where an actual size changes."""
    cuts = {0, m}
    starts = []
    for g, k in enumerate(pattern):
        pos, at = [], 0
        for size, first, n in runs[g]:
            pos.append((at, size, first))
            at += n
        starts.append(pos)
        if k:
            for p, _, _ in pos:
                d = p - taken[g]
                if 0 < d < m * k:
                    cuts |= {d // k, -(-d // k)}
    out, edges = [], sorted(cuts)
    for a, b in zip(edges, edges[1:]):
        slots, used = [], 0
        for g, k in enumerate(pattern):
            p, need = taken[g] + a * k, k
            while need:
                i = bisect.bisect_right(starts[g], (p, float("inf"), 0)) - 1
                at, size, first = starts[g][i]
                end = starts[g][i + 1][0] if i + 1 < len(starts[g]) else p + need
                q = need if b - a > 1 else min(need, end - p)
                slots.append((size, first + p - at, q))
                used += size * q
                p, need = p + q, need - q
        out.append(Bundle(base + a, b - a, capacity - used, tuple(slots)))
    return out


def pack_histogram(hist: dict[int, int], capacity: int, n_groups: int = 256, large_share: float = 1 / 3) -> tuple[list[Bundle], int]:
    """Bundles of containers for `hist` items of each size in 1..capacity, and the number of containers.

    Linear grouping: items above large_share * capacity are rounded up to the longest of their group, configurations of
    the few rounded sizes are chosen, actual items take their places, and the small items go, longest first, where they
    leave least room.
    """
    large = [(s, hist[s]) for s in sorted(hist, reverse=True) if hist[s] and s > large_share * capacity]
    groups = _groups(large, n_groups)
    sizes, runs = [g[0] for g in groups], [g[1] for g in groups]
    left, taken = [sum(n for *_, n in r) for r in runs], [0] * len(runs)
    bundles: list[Bundle] = []
    base = 0
    while any(left):
        p = _best_pattern(sizes, left, capacity)
        m = min(n // k for n, k in zip(left, p) if k)
        bundles += _exact(runs, taken, p, m, base, capacity)
        base += m
        for g, k in enumerate(p):
            left[g] -= m * k
            taken[g] += m * k
    by_free: dict[int, list[Bundle]] = {}
    for b in bundles:
        by_free.setdefault(b.free, []).append(b)
    keys = sorted(by_free)

    def push(b: Bundle) -> None:
        if b.free not in by_free:
            by_free[b.free] = []
            bisect.insort(keys, b.free)
        by_free[b.free].append(b)

    for s in sorted((s for s in hist if hist[s] and s <= large_share * capacity), reverse=True):
        n, first = hist[s], 0
        while n:
            i = bisect.bisect_left(keys, s)
            if i == len(keys):
                k = capacity // s
                m = -(-n // k)
                push(Bundle(base, m, capacity, ()))
                base += m
                continue
            free = keys[i]
            b = by_free[free].pop()
            if not by_free[free]:
                del by_free[free]
                keys.pop(i)
            k = min(free // s, n)
            m = min(b.m, n // k)
            b, rest = b.split(m)
            if rest.m:
                push(rest)
            push(Bundle(b.base, m, free - k * s, (*b.slots, (s, first, k))))
            n, first = n - m * k, first + m * k
    return [b for bs in by_free.values() for b in bs], base


class Places:
    """Where the items of each size go: the slots of all bundles, found by (scheme, size), then by rank.

    Slots of one (scheme, size) lie side by side, ordered by their first rank, so that sizes, ranks and the number of
    schemes may be as large as 64 bits allow.
    """

    def __init__(self, rows: list[tuple[int, int, int, int, int]]):
        at = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        self.scheme, self.size = at[:, 0], at[:, 1]
        self.first, self.k, self.base = at[:, 2], at[:, 3], at[:, 4]
        new = np.r_[True, (self.scheme[1:] != self.scheme[:-1]) | (self.size[1:] != self.size[:-1])] if len(at) else np.zeros(0, bool)
        self.starts = np.flatnonzero(new)
        self.ends = np.r_[self.starts[1:], len(at)].astype(np.int64)
        self.groups = {}
        for g, i in enumerate(self.starts.tolist()):
            self.groups.setdefault(int(self.scheme[i]), []).append(g)
        self.groups = {p: np.array(g, np.int64) for p, g in self.groups.items()}

    def container(self, scheme: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The container of each item; 0 for items of size 0."""
        out = np.zeros(len(size), np.int64)
        for p in np.unique(scheme[size > 0]):
            mine = np.flatnonzero((scheme == p) & (size > 0))
            g = self.groups[int(p)]
            g = g[np.searchsorted(self.size[self.starts[g]], size[mine])]
            lo, hi, r = self.starts[g], self.ends[g] - 1, rank[mine]
            while (lo < hi).any():  # the last slot that begins at or before the rank
                mid = (lo + hi + 1) >> 1
                up = self.first[mid] <= r
                lo, hi = np.where(up, mid, lo), np.where(up, hi, mid - 1)
            out[mine] = self.base[lo] + (r - self.first[lo]) // self.k[lo]
        return out


def pack(df: DataFrame, plans: list[tuple[int, int, str]], counts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(plan_id, id_col, piece, start_tok, n_tok, container): a container for every document of every plan.

    `counts` has `id_col` and a column n_<tokenizer> per tokenizer; plans are (plan_id, capacity, tokenizer). Documents
    longer than the capacity are cut into full pieces and a rest; no other is cut. Documents without tokens (null, empty)
    go to container 0. Repeated rows are items of their own; ties of size are broken by a hash of the id. Plans with the
    same capacity and tokenizer are packed once and share the result.
    """
    spark = counts.sparkSession
    schemes = sorted({(c, t) for _, c, t in plans})
    each = F.array(*[F.struct(F.lit(i).alias("scheme"), F.lit(c).cast("long").alias("capacity"), F.col(f"n_{t}").alias("n")) for i, (c, t) in enumerate(schemes)])
    items = counts.select(id_col, F.explode(each).alias("x")).select("x.*", id_col)
    last = F.greatest(F.lit(0).cast("long"), F.expr("(n - 1) div capacity"))
    items = items.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    items = items.select("scheme", id_col, F.col("piece").cast("int").alias("piece"), (F.col("piece") * F.col("capacity")).alias("start_tok"),
                         F.least(F.col("capacity"), F.col("n") - F.col("piece") * F.col("capacity")).alias("n_tok"))
    hist: dict[int, dict[int, int]] = {i: {} for i in range(len(schemes))}
    for r in items.where("n_tok > 0").groupBy("scheme", "n_tok").count().collect():  # at most `capacity` rows a scheme
        hist[r["scheme"]][r["n_tok"]] = r["count"]
    rows = []
    for i, (c, _) in enumerate(schemes):
        bundles, _n = pack_histogram(hist[i], c)
        rows += [(i, s, f, k, b.base) for b in bundles for s, f, k in b.slots]
    shared = spark.sparkContext.broadcast(Places(rows))  # bounded by the capacities
    ranked = salted_rank(items, ["scheme", "n_tok"], F.xxhash64(id_col, "piece"), [id_col, "piece"])

    @F.pandas_udf("long")
    def container(scheme: pd.Series, size: pd.Series, rank: pd.Series) -> pd.Series:
        return pd.Series(shared.value.container(*(x.to_numpy(np.int64) for x in (scheme, size, rank))))

    packed = ranked.select("scheme", id_col, "piece", "start_tok", "n_tok", container("scheme", "n_tok", "rank").alias("container"))
    users = [F.array(*[F.lit(p).cast("int") for p, c, t in plans if (c, t) == s]) for s in schemes]
    plan = F.coalesce(*[F.when(F.col("scheme") == i, u) for i, u in enumerate(users)]) if users else F.array().cast("array<int>")
    return packed.select(F.explode(plan).alias("plan_id"), id_col, "piece", "start_tok", "n_tok", "container")


def fill_report(packed: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """Per plan: containers, the fewest that could hold the tokens, and the share of room that stays free."""
    cap = F.coalesce(*[F.when(F.col("plan_id") == p, F.lit(c).cast("long")) for p, c in capacities.items()])
    each = packed.groupBy("plan_id", "container").agg(F.sum("n_tok").alias("used"))
    out = each.groupBy("plan_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return out.select("plan_id", "containers", F.ceil(F.col("tokens") / cap).alias("at_least"), "tokens", "fullest", F.round(1 - F.col("tokens") / (F.col("containers") * cap), 6).alias("free_share"))


def invariants(packed: DataFrame, plans: list[tuple[int, int, str]], id_col: str = "doc_id") -> DataFrame:
    """Per plan: documents that have a container, containers above the capacity, and documents of which the pieces leave a
    gap, overlap, or were cut without need. The last two must be 0."""
    cap = F.coalesce(*[F.when(F.col("plan_id") == p, F.lit(c).cast("long")) for p, c, _ in plans])
    full = packed.groupBy("plan_id", "container").agg(F.sum("n_tok").alias("used")).groupBy("plan_id").agg(F.count(F.when(F.col("used") > cap, 1)).alias("too_full"))
    doc = packed.groupBy("plan_id", id_col).agg(F.sum("n_tok").alias("n"), F.max(F.col("start_tok") + F.col("n_tok")).alias("end"), F.count(F.lit(1)).alias("pieces"))
    bad = (F.col("n") != F.col("end")) | (F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("n") / cap)))
    return doc.groupBy("plan_id").agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(bad, 1)).alias("broken")).join(full, "plan_id").select("plan_id", "documents", "too_full", "broken")
