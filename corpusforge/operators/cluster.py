"""Grouping of names by hybrid distance, and the curation of the groups."""

from __future__ import annotations

import os
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from corpusforge.functions.similarity import jaro
from corpusforge.runtime import cut

LIMIT = 4_000  # names in a block, neighbours in the order of their letters
AT_ONCE = 32_768  # pairs in one vector operation
WIDE = 64  # characters of a name that goes by bit vectors
SLACK = 1e-5  # what bounds in single precision may be off


def levenshtein(a: str, b: str) -> int:
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def text_distance(a: str, b: str) -> float:
    a, b = a.lower(), b.lower()
    if a == b:
        return 0.0
    longest = max(len(a), len(b))
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return 1 - (0.40 * jaro(a, b) + 0.35 * (1 - levenshtein(a, b) / longest) + 0.25 * n / longest)


def text_distances(a: list[str], b: list[str]) -> np.ndarray:
    """text_distance of every a with every b."""
    n = Names([*a, *b])
    return n.distances(np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(a), len(n.text)), len(a))).reshape(len(a), len(b))


class Names:
    """Lower-case names as arrays, for distances of many pairs and for bounds below them."""

    def __init__(self, texts: list[str]):
        self.text = [x.lower() for x in texts]
        self.length = np.array([len(x) for x in self.text], int)
        wide = np.array(self.text, f"U{WIDE}")
        points = wide.view(np.uint32).reshape(len(self.text), WIDE) if len(self.text) else np.zeros((0, WIDE), np.uint32)
        self.points = points[:, : max(1, min(WIDE, int(self.length.max(initial=0))))]
        self.bags = self._bags()

    def _bags(self) -> np.ndarray:
        """Two words of bits a name: one bit, by hash, for the k-th of a character, so that bits that another name lacks
        stand for as many characters that it lacks at least."""
        out, rows = np.zeros((2, len(self.text)), np.uint64), np.arange(len(self.text))
        for i in range(self.points.shape[1]):
            at = rows[(self.length > i) & (self.length <= WIDE)]
            c = self.points[at, i]
            bit = _bit(c.astype(np.uint64), (self.points[at, :i] == c[:, None]).sum(axis=1).astype(np.uint64))
            for k in (0, 1):
                own = bit // 64 == k
                out[k, at[own]] |= np.uint64(1) << bit[own] % np.uint64(64)
        for r in np.flatnonzero(self.length > WIDE):
            each = np.array([(ord(c), k) for c, n in Counter(self.text[r]).items() for k in range(n)], np.uint64)
            for bit in set(_bit(*each.T).tolist()):
                out[bit // 64, r] |= np.uint64(1 << bit % 64)
        return out

    def distances(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """text_distance of each name i with the name j beside it: up to 64 characters by bit vectors, longer ones one by one."""
        out = np.empty(len(i))
        short = np.flatnonzero((self.length[i] <= WIDE) & (self.length[j] <= WIDE))
        short = short[np.argsort(self.length[i[short]], kind="stable")]
        for s in range(0, len(short), AT_ONCE):
            k = short[s : s + AT_ONCE]
            out[k] = self._bit_distances(i[k], j[k])
        for k in np.flatnonzero((self.length[i] > WIDE) | (self.length[j] > WIDE)):
            out[k] = text_distance(self.text[i[k]], self.text[j[k]])
        return out

    def _bit_distances(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Pairs with i in the order of lengths: Jaro and Levenshtein over bit vectors."""
        one, la, lb, n = np.uint64(1), self.length[i], self.length[j], len(i)
        top = int(la.max())
        some, col = np.unique(j, return_inverse=True)
        known, code = np.unique(self.points[some], return_inverse=True)
        if len(known) * len(some) > 1 << 22 and n > 64:  # many different characters
            half = n // 2
            return np.concatenate([self._bit_distances(i[:half], j[:half]), self._bit_distances(i[half:], j[half:])])
        code = code.reshape(len(some), -1)
        at = np.zeros((len(known) + 1) * len(some), np.uint64)  # where each character stands in each j; the last row is of none
        for k in range(code.shape[1]):
            rows = np.flatnonzero(self.length[some] > k)
            at[code[rows, k] * len(some) + rows] |= one << np.uint64(k)
        a = self.points[i, :top].T
        place = np.minimum(np.searchsorted(known, a), len(known) - 1)
        place = np.where(known[place] == a, place, len(known)) * len(some) + col
        begin = np.searchsorted(la, np.arange(top), "right")  # pairs from there on have a character here
        longest = np.maximum(la, lb)
        reach = np.maximum(0, longest // 2 - 1)
        window = np.where(reach >= 63, ~np.uint64(0), (one << np.minimum(reach + 1, 63).astype(np.uint64)) - one)
        used, hits, vp, vn = np.zeros(n, np.uint64), [], np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
        for t in range(top):
            k = int(begin[t])
            m = at[place[t, k:]]
            x = m & ~used[k:] & window[k:]
            x &= np.negative(x)
            used[k:] |= x
            hits.append(x != 0)
            window[k:] <<= one
            window[k:] |= reach[k:] > t
            p, v = vp[k:], vn[k:]
            m |= v
            x = ((m & p) + p ^ p) | m
            up, down = (~(p | x) | v) << one | one, (p & x) << one
            vn[k:], vp[k:] = up & x, down | ~(up | x)
        full = np.where(lb >= 64, ~np.uint64(0), (one << np.minimum(lb, 63).astype(np.uint64)) - one)
        edits = la + np.bitwise_count(vp & full).astype(int) - np.bitwise_count(vn & full).astype(int)
        found, left, swaps = np.bitwise_count(used).astype(float), used, np.zeros(n, np.uint8)
        for t, hit in enumerate(hits):
            k = int(begin[t])
            low = left[k:] & np.negative(left[k:])
            low *= hit
            left[k:] ^= low
            swaps[k:] += hit & ((at[place[t, k:]] & low) == 0)
        prefix, same = np.zeros(n, int), np.ones(n, bool)
        for t in range(min(top, self.points.shape[1])):
            same &= (t < la) & (t < lb) & (self.points[i, t] == self.points[j, t])
            if not same.any():
                break
            prefix += same
        with np.errstate(divide="ignore", invalid="ignore"):
            jaro_ = np.where(found == 0, 0.0, (found / la + found / lb + (found - swaps / 2) / found) / 3)
            d = 1 - (0.40 * jaro_ + 0.35 * (1 - edits / longest) + 0.25 * prefix / longest)
        return np.where(edits == 0, 0.0, d)


def _bit(c: np.ndarray, k: np.ndarray) -> np.ndarray:
    h = (c + (k << np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h >> np.uint64(57)


def distances(a: list[str], b: list[str], va: np.ndarray | None, vb: np.ndarray | None, text_weight: float = 0.60) -> np.ndarray:
    """Hybrid distance of every a with every b; of the texts alone if there are no vectors."""
    d = text_distances(a, b)
    if va is None or vb is None:
        return d
    na, nb = np.linalg.norm(va, axis=1), np.linalg.norm(vb, axis=1)
    # einsum adds up in the same order whatever the size of the blocks
    cos = np.clip(1 - np.einsum("ik,jk->ij", va / np.where(na == 0, 1, na)[:, None], vb / np.where(nb == 0, 1, nb)[:, None]), 0, 2)
    cos[(na == 0)[:, None] | (nb == 0)[None, :]] = 1
    return text_weight * d + (1 - text_weight) * cos


def distance_matrix(texts: list[str], vectors: np.ndarray | None, text_weight: float = 0.60) -> np.ndarray:
    d = np.triu(distances(texts, texts, vectors, vectors, text_weight), 1)
    return d + d.T


def shortest_edges(d: np.ndarray, rows: np.ndarray, cols: np.ndarray | None = None) -> list[tuple[float, int, int]]:
    """(weight, a, b) with a < b: the minimum spanning forest under the order of weight, then ends, so that it is the only
    one. d is a symmetric matrix over `rows` or, with `cols` (all above the rows), the distances between two blocks.

    Rounds of Boruvka; of one block and of all pairs of blocks the forests together hold that of the whole.
    """
    d, square = d.copy(), cols is None
    if square:
        np.fill_diagonal(d, np.inf)
    ends = rows if square else np.concatenate([rows, cols])
    part, out = np.arange(len(ends)), []
    pr, pc = (lambda: part), (lambda: part)
    if not square:
        pr, pc = (lambda: part[: len(rows)]), (lambda: part[len(rows) :])
    while True:
        j = np.argmin(d, axis=1)
        near = [(d[np.arange(len(d)), j], np.arange(len(d)), j if square else j + len(rows))]
        if not square:
            i = np.argmin(d, axis=0)
            near.append((d[i, np.arange(d.shape[1])], i, np.arange(d.shape[1]) + len(rows)))
        w, x, y = (np.concatenate(z) for z in zip(*near))
        own = part[x] if square else np.concatenate([part[: len(rows)], part[len(rows) :]])
        keep = np.isfinite(w)
        w, x, y, own = w[keep], x[keep], y[keep], own[keep]
        if not len(w):
            return out
        lo, hi = np.minimum(ends[x], ends[y]), np.maximum(ends[x], ends[y])
        order = np.lexsort((hi, lo, w, own))
        best = order[np.unique(own[order], return_index=True)[1]]
        for k in best:
            p, q = part[x[k]], part[y[k]]
            if p != q:
                out.append((float(w[k]), int(lo[k]), int(hi[k])))
                part[part == max(p, q)] = min(p, q)
        d[pr()[:, None] == pc()[None, :]] = np.inf


def _root(root: list[int], x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def density_clusters(d: np.ndarray, min_size: int = 2) -> np.ndarray:
    """Labels (-1 is noise) of the leaves of the condensed tree over mutual reachability with one neighbour.

    That reachability is the distance itself: the distance to the nearest other name is never above it.
    """
    return tree_labels(len(d), sorted(shortest_edges(d, np.arange(len(d)))) if len(d) > 1 else [], min_size)


def tree_labels(n: int, edges: list[tuple[float, int, int]], min_size: int = 2) -> np.ndarray:
    """Labels of the leaves of the condensed tree; edges are those of the minimum spanning tree over 0 to n - 1, in order."""
    if n < 2:
        return np.full(n, -1)
    root, kids, size = list(range(n)), {}, [1] * n
    for _, a, b in edges:
        a, b = _root(root, a), _root(root, b)
        new = len(root)
        root.append(new)
        root[a] = root[b] = new
        kids[new] = (a, b)
        size.append(size[a] + size[b])
    labels, clusters, todo = np.full(n, -1), 0, [(len(root) - 1, False)]
    while todo:
        top, named = todo.pop()
        node, members = top, []
        while node in kids:  # follow the cluster while only small sides fall off
            a, b = kids[node]
            if size[a] >= min_size and size[b] >= min_size:
                break
            small, node_next = (a, b) if size[a] < size[b] else (b, a)
            members += _points(small, kids)
            if size[node_next] < min_size:
                members += _points(node_next, kids)
                node = -1
                break
            node = node_next
        if node in kids:
            todo += [(kids[node][1], True), (kids[node][0], True)]
        elif named:
            labels[members + ([node] if node >= 0 else [])] = clusters
            clusters += 1
    return labels


def _points(node: int, kids: dict) -> list[int]:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if x in kids:
            todo += kids[x]
        else:
            out.append(x)
    return out


def least_prefix(length: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """How many first letters a name shares at least with any other within the bound (of the text distance).

    Names that differ after p letters are at least 0.25 (1 - p / length) apart, and 0.35 / length more by an edit from p = 2 on.
    """
    few = length - 4 * length * bound - SLACK * length
    p = np.where(few <= 1, np.ceil(few), np.maximum(2, np.ceil(few + 1.4)))
    return np.clip(np.nan_to_num(p, neginf=0), 0, length).astype(int)


def _common(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


def nearest_others(q: pd.DataFrame, names: pd.DataFrame, scale: float = 1.0, rows: int = 512) -> pd.DataFrame:
    """(x, w, y): edges from rows of q to names in other parts, within the bound; among them is the least of each part of q,
    of equal distances that of the lower pair of positions. Both have low, pos, part and v (null: by text alone), q has
    bound and least, below which no edge of the row is.

    Every name is held against a bound below its distance first, by the letters that both begin with and those that
    they have at all; what remains is measured, the most promising ones first. scale is the weight of the text.
    """
    names, q = names.sort_values(["low", "pos"]), q.reset_index(drop=True)
    n, low = len(q), names["low"].tolist()
    both = Names([*q["low"], *low])
    pos, part = (np.concatenate([q[c].to_numpy(np.int64), names[c].to_numpy(np.int64)]) for c in ("pos", "part"))
    v = _unit(np.array([*q["v"], *names["v"]], float)) if q["v"].notna().all() and names["v"].notna().all() else None
    length, bags, bound = both.length[n:], both.bags[:, n:], q["bound"].to_numpy(float).copy()
    beside = np.array([_common(x, y) for x, y in zip(low, low[1:])], np.float32)
    own, best, y_best, floor = part[n:], np.full(n, np.inf), np.full(n, -1), q["least"].to_numpy(float)
    _, code = np.unique(part[:n], return_inverse=True)
    shared_bound = np.full(int(code.max(initial=-1)) + 1, np.inf)
    weights: dict[int, tuple] = {}

    def weight(la: int) -> tuple:
        if la not in weights:
            longest = np.maximum(la, length)
            with np.errstate(divide="ignore"):
                per = 0.4 / 3 * (1 / la + 1 / length) + 0.35 / longest if la else np.zeros(len(length))
            weights[la] = np.where(length == 0, 0, per).astype(np.float32), (0.25 / np.maximum(longest, 1)).astype(np.float32)
        return weights[la]

    def measure(x: np.ndarray, y: np.ndarray) -> None:
        """Distances of q's rows x with names' rows y into best."""
        if not len(x):
            return
        a, b = x, y + n
        first = pos[a] < pos[b]
        i, j = np.where(first, a, b), np.where(first, b, a)
        d = both.distances(i, j)
        if v is not None:
            d = scale * d + (1 - scale) * _cosines(v, i, j)
        at = np.lexsort((pos[j], pos[i], d, x))
        at = at[np.unique(x[at], return_index=True)[1]]
        for k in at.tolist():
            r, w, y_ = x[k], d[k], pos[b[k]]
            if w <= bound[r] and (w < best[r] or w == best[r] and sorted((y_, pos[r])) < sorted((y_best[r], pos[r]))):
                best[r], bound[r], y_best[r] = w, w, y_
        np.minimum.at(shared_bound, code, bound)
        bound[:] = shared_bound[code]

    place = np.array([bisect_left(low, x) for x in both.text[:n]], int)
    for s in range(0, n, rows):
        span = range(s, min(n, s + rows))
        near = [(r, k) for r in span for k in range(max(0, place[r] - 3), min(len(low), place[r] + 4)) if own[k] != part[r]]
        measure(*np.array(near, int).reshape(-1, 2).T)
        least = least_prefix(both.length[s : span.stop], bound[s : span.stop] / scale)
        found = []
        for r, least_r in zip(span, least.tolist()):
            if floor[r] > bound[r]:
                continue
            x, i, la = both.text[r], int(place[r]), int(both.length[r])
            lo, hi = 0, len(low)
            if least_r:
                key = x[:least_r]
                lo, hi = (f(low, key, key=lambda t: t[:least_r]) for f in (bisect_left, bisect_right))  # noqa: B023
            if lo >= hi:
                continue
            shared = np.empty(hi - lo, np.float32)
            if i < hi:
                shared[i - lo] = _common(x, low[i])
                shared[i - lo + 1 :] = beside[i : hi - 1]
                np.minimum.accumulate(shared[i - lo :], out=shared[i - lo :])
            if i > lo:
                left = shared[: i - lo][::-1]
                left[0] = _common(x, low[i - 1])
                left[1:] = beside[lo : i - 1][::-1]
                np.minimum.accumulate(left, out=left)
            a, b = both.bags[:, r, None], bags[:, lo:hi]
            here, there = (np.bitwise_count(z).sum(axis=0, dtype=np.int32) for z in (a & ~b, b & ~a))
            per, first = weight(la)
            least_d = np.float32(1 - 0.4 / 3) - np.minimum(la - here, length[lo:hi] - there) * per[lo:hi] - shared * first[lo:hi]
            k = np.flatnonzero((least_d <= bound[r] / scale + SLACK) & (own[lo:hi] != part[r]))
            if len(k):
                found.append((np.full(len(k), r), k + lo, least_d[k]))
        if found:
            x, y, d = (np.concatenate(z) for z in zip(*found))
            at = np.lexsort((d, x))
            x, y, d = x[at], y[at], d[at]
            turn = np.arange(len(x)) - np.searchsorted(x, x)
            measure(x[turn < 4], y[turn < 4])
            rest = (turn >= 4) & (d <= bound[x] / scale + SLACK)
            measure(x[rest], y[rest])
    got = np.flatnonzero(y_best >= 0)
    return pd.DataFrame({"x": pos[got], "w": best[got], "y": y_best[got]})


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1)
    return v / np.where(size == 0, 1, size)[:, None]


def _cosines(v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosine distances of unit vectors; 1 if one has no length."""
    cos = np.clip(1 - np.einsum("pk,pk->p", v[i], v[j]), 0, 2)
    none = ~v.any(axis=1)
    cos[none[i] | none[j]] = 1
    return cos


def nearest_parts(pos: np.ndarray, w: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least position of each name's part, in the graph that joins each with its nearest (y, a position)."""
    to = np.searchsorted(pos, y)
    root = np.where(to[to] == np.arange(len(pos)), np.minimum(to, np.arange(len(pos))), to)  # a part has one pair of mutual nearest
    while (root[root] != root).any():
        root = root[root]
    out = np.full(len(pos), np.iinfo(np.int64).max)
    np.minimum.at(out, root, pos)
    return out[root]


def cluster_names(df: DataFrame, kind: str = "kind", text: str = "text", vector: str | None = "embedding", key: str = "id", limit: int = LIMIT, text_weight: float = 0.60) -> DataFrame:
    """(kind, block, key, text, cluster): density clusters inside each kind; -1 is noise. block is empty.

    The clusters are the leaves of the condensed tree of all names of the kind (density_clusters), by what decides them:

    1. The first edge of a name leads to its nearest other name. These edges cut the kind into parts with one mutual pair
       each; a part grows from that pair name by name, in the order of the edges, until it meets another part.
    2. It meets another at its shortest edge out of it. Names that came before are its cluster, later ones are noise.

    Both are searched exactly: names are numbered by letters and cut into blocks of `limit`; a name is sent to each block
    that has names with as many letters in common as the distance already found demands. `limit` changes no result.
    A kind of which a name has no vector is compared by text alone; a kind with one name or one part has no cluster.
    Clusters are numbered by their first members. One task per kind joins the parts, of one edge a name.
    """
    lower = F.pandas_udf(lambda s: s.str.lower(), "string")
    d = df.where(F.col(text).isNotNull()).select(F.col(kind).cast("string").alias("kind"), F.col(key).cast("long").alias("id"), F.col(text).alias("text"), (F.col(vector).cast("array<double>") if vector else F.lit(None).cast("array<double>")).alias("v"))
    d = d.withColumns({"g": F.coalesce(F.concat(F.lit("k"), "kind"), F.lit("")), "low": lower("text")})
    d = d.withColumn("pos", (F.row_number().over(Window.partitionBy("g").orderBy("id", "text")) - 1).cast("long"))
    d = cut(d.withColumn("b", F.floor((F.row_number().over(Window.partitionBy("g").orderBy("low", "pos")) - 1) / limit).cast("int")))
    blocks = cut(d.groupBy("g", "b").agg(F.min("low").alias("begin"), F.max("low").alias("end")))
    tasks = min(240, max(1, 4 * blocks.count()))
    names = d.select("g", "b", "pos", "low", "v")
    if vector:
        whole = d.groupBy("g").agg(F.bool_and(F.col("v").isNotNull()).alias("has_v"))
        names = names.join(whole, "g").withColumn("v", F.when(F.col("has_v"), F.col("v"))).drop("has_v")
    scale = text_weight if vector else 1.0  # names without vectors: a bound below is still one
    edge = "g string, x long, w double, y long"

    def dealt(x: DataFrame) -> DataFrame:
        return x.toDF(*x.columns).repartition(tasks, "g", "b")  # columns of its own, as sides of a cogroup

    def inside(p: pd.DataFrame) -> pd.DataFrame:
        out = nearest_others(p.assign(part=p["pos"], bound=np.inf, least=0.0), p.assign(part=p["pos"]), scale)
        return p[["g", "b", "pos", "low", "v"]].merge(out.rename(columns={"x": "pos"}), "left", "pos")

    def across(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = nearest_others(q, p, scale) if len(q) and len(p) else pd.DataFrame({"x": [], "w": [], "y": []})
        return out.assign(g=q["g"].iloc[0] if len(q) else "")[["g", "x", "w", "y"]]

    def closing(p: pd.DataFrame) -> pd.DataFrame:
        q = p[p["bound"].notna()]
        out = nearest_others(q.assign(least=q["w"]), p, scale) if len(q) else pd.DataFrame({"x": [], "w": [], "y": []})
        return out.merge(q[["pos", "part"]], left_on="x", right_on="pos").assign(g=p["g"].iloc[0])[["g", "part", "x", "w", "y"]]

    def sent(q: DataFrame) -> DataFrame:
        """Rows of q for each other block that may have a name within the bound."""
        least = F.pandas_udf(lambda n, w: pd.Series(least_prefix(n.to_numpy(), w.to_numpy(float) / scale)), "int")(F.length("low"), "bound")
        q = q.withColumn("n", least).withColumn("prefix", F.left("low", F.col("n")))
        to = F.broadcast(blocks.select(F.col("g").alias("g2"), F.col("b").alias("b2"), "begin", "end"))  # a row for each `limit` names
        meets = (F.col("g") == F.col("g2")) & (F.left("begin", F.col("n")) <= F.col("prefix")) & (F.left("end", F.col("n")) >= F.col("prefix"))
        out = q.join(to, meets & (F.col("b") != F.col("b2")))
        return out.select("g", F.col("b2").alias("b"), "pos", "low", "v", "part", "bound", "least")

    def together(g: DataFrame, *more: str) -> DataFrame:
        """The least edge of each name (or part) in the order of length, then ends."""
        order = F.struct("w", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))
        return g.groupBy("g", *more).agg(F.min_by(F.struct("w", "x", "y"), order).alias("e")).select("g", *more, "e.*")

    def parts(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pos").reset_index(drop=True)
        if len(p) < 2:
            return p.assign(part=p["pos"], bound=np.nan)
        p["part"] = nearest_parts(*(p[c].to_numpy() for c in ("pos", "w")), p["y"].to_numpy(np.int64))
        size, bound = (p.groupby("part")["w"].transform(f) for f in ("size", "max"))
        return p.assign(bound=bound.where(size > 2))

    def label(p: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pos").reset_index(drop=True)
        out = np.full(len(p), -1)
        if p["part"].nunique() > 1:
            p = p.merge(e[["part", "w", "x", "y"]].rename(columns={"w": "w2", "x": "x2", "y": "y2"}), "left", "part")
            mine, ends = ([p[w], np.minimum(p[x], p[y]), np.maximum(p[x], p[y])] for w, x, y in (("w", "pos", "y"), ("w2", "x2", "y2")))
            before = mine[0] < ends[0]
            before |= (mine[0] == ends[0]) & ((mine[1] < ends[1]) | (mine[1] == ends[1]) & (mine[2] < ends[2]))
            kept = (p["w2"].isna() | before).to_numpy()
            out[kept] = pd.factorize(p["part"][kept])[0]
        return pd.DataFrame({"g": p["g"], "pos": p["pos"], "cluster": out})

    near = cut(dealt(names).groupBy("g", "b").applyInPandas(inside, "g string, b int, pos long, low string, v array<double>, w double, y long"))
    q = near.withColumns({"part": F.col("pos"), "bound": F.coalesce("w", F.lit(float("inf"))), "least": F.lit(0.0)})
    at_home = near.where("y is not null").select("g", F.col("pos").alias("x"), "w", "y")
    abroad = dealt(sent(q)).groupBy("g", "b").cogroup(dealt(names.withColumn("part", F.col("pos"))).groupBy("g", "b")).applyInPandas(across, edge)
    first = at_home.unionByName(abroad)
    first = together(first.withColumn("pos", F.col("x")), "pos").drop("x")
    placed = near.drop("w", "y").join(first, ["g", "pos"], "left")
    placed = cut(placed.groupBy("g").applyInPandas(parts, "g string, b int, pos long, low string, v array<double>, w double, y long, part long, bound double"))
    home = together(dealt(placed.select("g", "b", "pos", "low", "v", "w", "part", "bound")).groupBy("g", "b").applyInPandas(closing, "g string, part long, x long, w double, y long"), "part")
    home = cut(home)
    # an edge of a name is not below its first, so only names with one within what is found so far are sent on
    q = placed.where("bound is not null and not isnan(bound)").join(home.select("g", "part", F.col("w").alias("found")), ["g", "part"], "left")
    q = q.withColumns({"bound": F.least("bound", "found"), "least": F.col("w")}).where("least <= bound")
    away = dealt(sent(q)).groupBy("g", "b").cogroup(dealt(placed).groupBy("g", "b")).applyInPandas(across, edge)
    away = away.join(placed.select("g", F.col("pos").alias("x"), "part"), ["g", "x"]).select("g", "part", "x", "w", "y")
    out = together(home.unionByName(away), "part")
    labels = placed.select("g", "pos", "part", "w", "y").groupBy("g").cogroup(out.groupBy("g")).applyInPandas(label, "g string, pos long, cluster int")
    return d.join(labels, ["g", "pos"]).select("kind", F.lit("").alias("block"), "id", "text", "cluster")


def payload(clusters: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Per kind, block and cluster the members in order, how many, and the next free number.

    With names (kind, id, frequency, work_names, sources: one row per name) the members carry these, and the cluster the
    sum of the frequencies, all its works and the sum of the sources.
    """
    member, more = ["text", "id"], []
    if names is not None:
        n = names.select(F.col("kind").alias("_k"), F.col("id").alias("_i"), "frequency", "work_names", "sources")
        clusters = clusters.join(n, clusters["kind"].eqNullSafe(n["_k"]) & (clusters["id"] == n["_i"]), "left").drop("_k", "_i")
        member += ["frequency", "work_names", "sources"]
        more = [F.sum("frequency").alias("frequency"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("work_names")))).alias("work_names"), F.sum("sources").alias("sources")]
    members = F.array_sort(F.collect_list(F.struct(*member)))
    p = clusters.groupBy("kind", "block", "cluster").agg(F.count(F.lit(1)).alias("size"), members.alias("members"), *more)
    w = Window.partitionBy("kind", "block")
    return p.withColumn("next_cluster", F.max("cluster").over(w) + 1).withColumn("is_noise", F.col("cluster") == -1)


def move(clusters: DataFrame, ids: list[int], to: int) -> DataFrame:
    """Names of one kind and block given another cluster; -1 is noise. Empty clusters vanish by themselves."""
    return clusters.withColumn("cluster", F.when(F.col("id").isin(ids), F.lit(to)).otherwise(F.col("cluster")))


def merge(clusters: DataFrame, numbers: list[int]) -> DataFrame:
    """Clusters joined under the least of their numbers."""
    return clusters.withColumn("cluster", F.when(F.col("cluster").isin(numbers), F.lit(min(numbers))).otherwise(F.col("cluster")))


def create(clusters: DataFrame, ids: list[int], kind: str, block: str = "") -> DataFrame:
    """Names given a new cluster, the next free number of their kind and block."""
    last = clusters.where((F.col("kind") == kind) & (F.col("block") == block)).agg(F.max("cluster")).first()[0]
    return move(clusters, ids, (-1 if last is None else last) + 1)


def dissolve(clusters: DataFrame, number: int) -> DataFrame:
    """The members of a cluster made noise."""
    return clusters.withColumn("cluster", F.when(F.col("cluster") == number, F.lit(-1)).otherwise(F.col("cluster")))


class History:
    """The last states of a curation, for undoing; frames are plans, so states cost nothing."""

    def __init__(self, clusters: DataFrame, depth: int = 50):
        self.states, self.depth = [clusters], depth

    @property
    def now(self) -> DataFrame:
        return self.states[-1]

    def apply(self, step: Callable[..., DataFrame], *args) -> DataFrame:
        self.states = [*self.states[-self.depth :], step(self.now, *args)]
        return self.now

    def undo(self) -> DataFrame:
        if len(self.states) > 1:
            self.states.pop()
        return self.now


def export(clusters: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One JSON string per cluster, with the statistics of its kind and block: names, clusters and names in noise."""
    p, w = payload(clusters, names), Window.partitionBy("kind", "block")
    noise = F.col("is_noise")
    total = F.struct(F.sum("size").over(w).alias("names"), F.count(F.when(~noise, 1)).over(w).alias("clusters"), F.coalesce(F.sum(F.when(noise, F.col("size"))).over(w), F.lit(0)).alias("noise"))
    fields = ["kind", "block", "cluster", "size", "members", *(["frequency", "work_names", "sources"] if names is not None else [])]
    return p.withColumn("statistics", total).select(F.to_json(F.struct(*fields, "statistics")).alias("json"))


def display_contexts(contexts: DataFrame, by: list[str], order: list[str], most: int = 20) -> DataFrame:
    """The first `most` contexts of each name, for pages; nothing else is cut."""
    w = Window.partitionBy(*by).orderBy(*order)
    return contexts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def search(clusters: DataFrame, text: str) -> DataFrame:
    return clusters.where(F.contains(F.lower("text"), F.lit(text.lower())))


def project_2d(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """df with x and y, the first two principal components of its vectors."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    out = PCA(k=2, inputCol="_v", outputCol="_p").fit(v).transform(v).withColumn("_p", vector_to_array("_p"))
    return out.withColumns({"x": F.col("_p")[0], "y": F.col("_p")[1]}).drop("_v", "_p")


def nearest(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int = 10, rows_at_once: int = 4_096) -> DataFrame:
    """(query, key, distance): the k nearest vectors to each query by cosine distance, over all rows.

    The queries (a stated set) are read in blocks of rows_at_once and each block is broadcast; every task keeps its own k
    best per query, so that at most k rows per query and task are shuffled.
    """
    qs = queries.select(F.col(key).alias("query"), F.col(vector).cast("array<float>").alias("qv"))
    n = qs.count()
    blocks, out = max(1, -(-n // rows_at_once)), None
    for b in range(blocks):
        rows = qs.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).collect()
        shared = df.sparkSession.sparkContext.broadcast(([r["query"] for r in rows], np.array([r["qv"] for r in rows], np.float64).reshape(len(rows), -1)))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            if not len(ids):
                return
            qn = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
            best_d, best_k = np.full((len(ids), 0), 0.0), np.zeros((len(ids), 0), np.int64)
            for f in frames:
                if not len(f):
                    continue
                v = np.stack([np.asarray(x, np.float64) for x in f["v"]])
                d = 1 - qn @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).T
                d, ks = np.hstack([best_d, d]), np.hstack([best_k, np.broadcast_to(f["k"].to_numpy(np.int64), (len(ids), len(f)))])
                top = np.argsort(d, axis=1, kind="stable")[:, :k]
                best_d, best_k = np.take_along_axis(d, top, 1), np.take_along_axis(ks, top, 1)
            yield pd.DataFrame({"query": np.repeat(ids, best_d.shape[1]), "key": best_k.ravel(), "distance": best_d.ravel()})

        one = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<float>").alias("v")).mapInPandas(run, "query long, key long, distance double")
        out = one if out is None else out.unionByName(one)
    w = Window.partitionBy("query").orderBy("distance", "key")
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
