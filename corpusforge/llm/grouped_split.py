"""Problem 7: splits that keep related records together."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window, functions as F

from corpusforge.operators.components import components
from corpusforge.operators.ranking import salted_rank
from corpusforge.runtime import cut

NO_EDITOR = ("", "null", "N. N.")


def person_names(tokens: DataFrame, least: int = 3) -> DataFrame:
    """(source, name): token sequences B-Person I-Person ... of `least` or more tokens, as they stand.

    Places delivered again count once. A sequence with a null token names nobody, nor does one broken by a missing place
    (tok_id counts without gaps). Only tokens labelled as persons are shuffled. The name is the tokens joined by a
    control character.
    """
    t = tokens.where("source is not null and sent_id is not null and label in ('B-Person', 'I-Person')")
    t = t.groupBy("sent_id", "tok_id").agg(F.min("source").alias("source"), F.min("token").alias("token"), F.min("label").alias("label"))
    w = Window.partitionBy("sent_id").orderBy("tok_id")
    goes_on = (F.col("label") == "I-Person") & (F.lag("tok_id").over(w) == F.col("tok_id") - 1)
    t = t.withColumn("island", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(w))
    runs = t.groupBy("sent_id", "island").agg(
        F.min("source").alias("source"), F.count(F.lit(1)).alias("n"), F.count("token").alias("known"), F.min_by("label", "tok_id").alias("begins"),
        F.array_sort(F.collect_list(F.struct("tok_id", "token"))).alias("w"))
    runs = runs.where((F.col("begins") == "B-Person") & (F.col("n") >= least) & (F.col("known") == F.col("n")))
    return runs.select("source", F.array_join(F.transform("w", lambda x: x["token"]), "\x1f").alias("name")).distinct()


def source_ties(tokens: DataFrame, works: DataFrame) -> DataFrame:
    """(node, key): a source and what ties it to others, an editor or a person. Every source is tied to itself."""
    sources = tokens.select("source").where("source is not null").distinct()
    own = sources.select(F.col("source").alias("node"), F.concat(F.lit("s\x1f"), "source").alias("key"))
    editors = works.where(F.col("main_editor").isNotNull() & ~F.col("main_editor").isin(*NO_EDITOR)).join(sources, "source", "left_semi")
    by_editor = editors.select(F.col("source").alias("node"), F.concat(F.lit("e\x1f"), "main_editor").alias("key"))
    by_name = person_names(tokens).select(F.col("source").alias("node"), F.concat(F.lit("p\x1f"), "name").alias("key"))
    return own.unionByName(by_editor).unionByName(by_name).distinct()


def tied_sources(tokens: DataFrame, works: DataFrame) -> DataFrame:
    """(source_a, source_b), the smaller first: pairs of sources in one component."""
    c = components(source_ties(tokens, works))
    a = c.select("component", F.col("node").alias("source_a"))
    b = c.select("component", F.col("node").alias("source_b"))
    return a.join(b, "component").where("source_a < source_b").select("source_a", "source_b")


def min_cost_flow(n_nodes: int, arcs: list[tuple[int, int, float, float]], source: int, sink: int) -> list[float]:
    """Flow on each arc (from, to, capacity, cost) of a cheapest maximal flow, by successive shortest paths."""
    to, cap, cost, out = [], [], [], [[] for _ in range(n_nodes)]
    for u, v, c, w in arcs:
        for x, y, k, m in ((u, v, c, w), (v, u, 0.0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(m)
    while True:
        dist, via = [float("inf")] * n_nodes, [-1] * n_nodes
        dist[source], queue, waiting = 0.0, deque([source]), {source}
        while queue:
            u = queue.popleft()
            waiting.discard(u)
            for e in out[u]:
                if cap[e] > 1e-9 and dist[u] + cost[e] < dist[to[e]] - 1e-12:
                    dist[to[e]], via[to[e]] = dist[u] + cost[e], e
                    if to[e] not in waiting:
                        queue.append(to[e])
                        waiting.add(to[e])
        if via[sink] < 0:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        step = min(cap[e] for e in path)
        for e in path:
            cap[e] -= step
            cap[e ^ 1] += step


def allot(bundles: list[tuple[int, int, object]], shares: dict[str, float]) -> list[dict[str, int]]:
    """For bundles (size of a component, number of such components, label profile), how many go to each split.

    Min-cost flow in rows: source -> profile -> split -> sink. A profile sends a split its share of the profile's rows free of
    cost and more at a cost of 1 a row; a split takes its quota free of cost and more at a cost of 3 a row. Components longer
    than the smallest quota are set first, where most room is, and use up the quota there. The flow is rounded to whole
    components, the longest first; what is left of a bundle goes where the flow of its profile, and then the quota, leaves
    most room.
    """
    total = sum(s * n for s, n, _ in bundles)
    names = list(shares)
    room = {k: v * total for k, v in shares.items()}
    least = min(room.values(), default=0)
    plan: list[dict[str, int]] = [dict.fromkeys(names, 0) for _ in bundles]
    order = sorted(range(len(bundles)), key=lambda i: (-bundles[i][0], i))
    rest = []
    for i in order:
        size, n, _ = bundles[i]
        if size <= least:
            rest.append(i)
            continue
        for _ in range(n):  # fewer than the number of splits over the smallest share
            k = max(names, key=lambda k: room[k])
            plan[i][k] += 1
            room[k] -= size
    rows: dict = {}
    for i in rest:
        rows[bundles[i][2]] = rows.get(bundles[i][2], 0) + bundles[i][0] * bundles[i][1]
    profiles = list(rows)
    source, sink, first = 0, 1, 2
    split_at = {k: first + len(profiles) + j for j, k in enumerate(names)}
    arcs, at = [], {}
    for j, p in enumerate(profiles):
        arcs.append((source, first + j, rows[p], 0.0))
        for k in names:
            at[p, k] = len(arcs)
            arcs += [(first + j, split_at[k], shares[k] * rows[p], 0.0), (first + j, split_at[k], float(total), 1.0)]
    for k in names:
        arcs += [(split_at[k], sink, max(0.0, room[k]), 0.0), (split_at[k], sink, float(total), 3.0)]
    flow = min_cost_flow(first + len(profiles) + len(names), arcs, source, sink)
    wish = {pk: flow[e] + flow[e + 1] for pk, e in at.items()}
    for i in rest:
        size, n, p = bundles[i]
        left = n
        for k in names:
            m = min(left, int((wish[p, k] + 1e-6) // size)) if wish[p, k] > 0 else 0
            share = int(n * max(0.0, wish[p, k]) / max(1e-9, sum(max(0.0, wish[p, j]) for j in names)))
            m = min(m, share)
            plan[i][k] += m
            left -= m
        for k in names:
            wish[p, k] -= plan[i][k] * size
            room[k] -= plan[i][k] * size
        for _ in range(left):  # fewer than there are splits, but for rounding
            k = max(names, key=lambda k: (min(wish[p, k], 0.0) + min(room[k], 0.0), wish[p, k] + room[k], k))
            plan[i][k] += 1
            wish[p, k] -= size
            room[k] -= size
    return plan


def grouped_split(tokens: DataFrame, works: DataFrame, shares: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """(source, component, sentences, new_split): a new split of the given shares of sentences that parts no component.

    Components of equal size and label profile (sentences with persons, with places, on a scale of powers of two) form
    a bundle; only bundles, of which there are at most about the root of twice the sentences per profile, reach the
    driver. Members of a bundle are dealt out by hash. A component longer than its quota makes that split longer, since
    it is never parted. Empty tables give no rows.
    """
    shares = shares or {"train": 0.8, "dev": 0.1, "test": 0.1}
    c = components(source_ties(tokens, works))
    sents = tokens.where("source is not null").groupBy("source", "sent_id").agg(
        F.max(F.coalesce(F.col("label").endswith("-Person"), F.lit(False)).cast("int")).alias("per"), F.max(F.coalesce(F.col("label").endswith("-Location"), F.lit(False)).cast("int")).alias("loc"))
    size = sents.groupBy("source").agg(F.count(F.lit(1)).alias("sentences"), F.sum("per").alias("per"), F.sum("loc").alias("loc"))
    sized = cut(size.join(c, size["source"] == c["node"]).select("source", "component", "sentences", "per", "loc"))
    level = lambda x: F.floor(F.log2(1 + F.col(x))).cast("int")
    whole = sized.groupBy("component").agg(F.sum("sentences").alias("size"), F.sum("per").alias("per"), F.sum("loc").alias("loc"))
    whole = cut(whole.select("component", "size", level("per").alias("per"), level("loc").alias("loc")))
    bundles = [tuple(r) for r in whole.groupBy("size", "per", "loc").count().collect()]
    bundles.sort()
    plan = allot([(s, n, (p, l)) for s, p, l, n in bundles], shares)
    rows, names = [], list(shares)
    for (s, p, l, _), m in zip(bundles, plan):
        at = 0
        for k in names:
            if m[k]:
                rows.append((s, p, l, at, at + m[k], k))
                at += m[k]
    parts = tokens.sparkSession.createDataFrame(rows, "size long, per int, loc int, lo long, hi long, new_split string")
    ranked = salted_rank(whole, ["size", "per", "loc"], F.xxhash64(F.lit(seed), "component"), ["component"])
    where = ranked.join(parts, ["size", "per", "loc"]).where("rank >= lo and rank < hi").select("component", "new_split")
    return sized.join(where, "component").select("source", "component", "sentences", "new_split")
