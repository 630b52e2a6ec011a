"""Lists of names aligned to token streams as BIO labels."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from corpusforge.functions.clean import long_label

BLOCK = 50_000  # names in one broadcast; a longer list goes in several


def name_starts(tokens: list[str], lower: list[str], at: dict[str, list[int]], low_at: dict[str, list[int]], name: list[str]) -> list[tuple[int, int]]:
    """(start, length) of the places of a name in a token stream.

    Exact places; then places equal without case after the last exact one; then, for a name of parts joined by hyphens,
    the parts as tokens of their own, with or without hyphen tokens between, after the last of those. `at` and `low_at`
    give the places of each token and of each token in lower case.
    """
    k, low = len(name), [x.lower() for x in name]
    out = [(i, k) for i in at.get(name[0], ()) if tokens[i : i + k] == name]
    last = out[-1][0] if out else -1
    out += [(i, k) for i in low_at.get(low[0], ()) if i > last and lower[i : i + k] == low]
    last = max((i for i, _ in out), default=-1)
    text = " ".join(name)
    if "-" in text:
        parts = [p for p in text.lower().split("-") if p]
        if len(parts) >= 2:
            for i in low_at.get(parts[0], ()):
                if i > last and (n := _dashed(lower, i, parts)):
                    out.append((i, n))
    return out


def _dashed(lower: list[str], i: int, parts: list[str]) -> int:
    j, p = i, 0
    while p < len(parts) and j < len(lower):
        t = lower[j]
        if t == parts[p]:
            p, j = p + 1, j + 1
            if p < len(parts) and j < len(lower) and lower[j] == "-":
                j += 1
        elif p and t == parts[p] + "-" and p + 1 < len(parts):
            p, j = p + 1, j + 1
        elif p and p + 1 < len(parts) and t == f"{parts[p]}-{parts[p + 1]}":
            p, j = p + 2, j + 1
        else:
            return 0
    return j - i if p == len(parts) else 0


class Matcher:
    """The names of a block by their first token."""

    def __init__(self, rows: list[tuple[int, str, str]]):
        self.by_first: dict[str, list] = defaultdict(list)
        for ent, text, label in rows:
            words = text.split()
            heads = {words[0].lower(), *[p for p in [text.lower().split("-")[0].strip()] if p and "-" in text]}
            for h in heads:
                self.by_first[h].append((ent, words, label))

    def places(self, toks: list[str]) -> list[tuple[int, int, int, int, str]]:
        """(minus the tokens of the name, ent, start, length, label) of all places: sorted, they come in order of choice."""
        lower = [t.lower() for t in toks]
        at, low_at = defaultdict(list), defaultdict(list)
        for j, (t, l) in enumerate(zip(toks, lower)):
            at[t].append(j)
            low_at[l].append(j)
        seen, out = set(), []
        for h in low_at:
            for ent, words, label in self.by_first.get(h, ()):
                if (ent, label) not in seen:
                    seen.add((ent, label))
                    out += [(-len(words), ent, s, n, label) for s, n in name_starts(toks, lower, at, low_at, words)]
        return out


def greedy_labels(n: int, places: list[tuple]) -> list[str]:
    """BIO labels of n tokens: places in order, each set where all its tokens are still free."""
    labels = ["O"] * n
    for _, _, s, k, l in places:
        if all(x == "O" for x in labels[s : s + k]):
            labels[s : s + k] = [f"B-{l}"] + [f"I-{l}"] * (k - 1)
    return labels


def align(docs: DataFrame, names: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(id_col, tok_id, token, label): BIO labels of every token of (id_col, tokens).

    names has ent (order), text, label; equal (text, label) count once, by their first ent. Longer names (in tokens) come
    first, then by order, then by place; a name is set where all its tokens are still free. A list of up to BLOCK names is
    one broadcast and labels are chosen in the same pass, without a shuffle; of a longer one the matches of its blocks
    are brought together per text. Null and empty names match nothing; a text without tokens gives no row.
    """
    listed = names.where("trim(text) <> '' and label is not null").groupBy("text", "label").agg(F.min("ent").cast("long").alias("ent"))
    blocks = max(1, -(-listed.count() // BLOCK))
    base = docs.select(id_col, tokens_col)
    key = base.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, key), T.StructField("tok_id", T.IntegerType()), T.StructField("token", T.StringType()), T.StructField("label", T.StringType())])
    place = "array<struct<a: int, ent: bigint, s: int, n: int, l: string>>"

    def block(k: int):
        rows = [tuple(r) for r in listed.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).select("ent", "text", "label").collect()]
        return docs.sparkSession.sparkContext.broadcast(rows)

    def labelled(ids, tokens, places):
        row, no, tok, lab = [], [], [], []
        for i, (toks, found) in enumerate(zip(tokens, places)):
            n = len(toks or [])
            row += [i] * n
            no += range(n)
            tok += toks or []
            lab += greedy_labels(n, found)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), pa.array(no, pa.int32()), pa.array(tok, pa.string()), pa.array(lab, pa.string())], names=[id_col, "tok_id", "token", "label"])

    def plain(toks):
        return ["" if t is None else t for t in toks or []]

    if blocks == 1:
        shared = block(0)

        def run(batches):
            m = Matcher(shared.value)
            for b in batches:
                tokens = b.column(1).to_pylist()
                yield labelled(b.column(0), tokens, [sorted(m.places(plain(t))) for t in tokens])

        out = base.mapInArrow(run, schema)
    else:
        found = None
        for k in range(blocks):

            def match(batches, shared=block(k)):
                m = Matcher(shared.value)
                for b in batches:
                    got = [[dict(zip(("a", "ent", "s", "n", "l"), x)) for x in m.places(plain(t))] for t in b.column(1).to_pylist()]
                    some = [i for i, g in enumerate(got) if g]
                    kind = pa.list_(pa.struct([("a", pa.int32()), ("ent", pa.int64()), ("s", pa.int32()), ("n", pa.int32()), ("l", pa.string())]))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some, pa.int64())), pa.array([got[i] for i in some], kind)], names=["k", "c"])

            one = base.mapInArrow(match, T.StructType([T.StructField("k", key), T.StructField("c", T._parse_datatype_string(place))]))
            found = one if found is None else found.unionByName(one)
        per = found.groupBy("k").agg(F.array_sort(F.flatten(F.collect_list("c"))).alias("c"))
        joined = base.join(per, base[id_col].eqNullSafe(per["k"]), "left").select(id_col, tokens_col, "c")

        def choose(batches):
            for b in batches:
                places = [[tuple(c.values()) for c in cs or []] for cs in b.column(2).to_pylist()]
                yield labelled(b.column(0), b.column(1).to_pylist(), places)

        out = joined.mapInArrow(choose, schema)
    return out.withColumn("label", F.when(F.col("label") == "O", "O").otherwise(F.concat(F.left("label", F.lit(2)), long_label(F.expr("substring(label, 3)")))))


def not_found(names: DataFrame, aligned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Names that label no token, compared without case."""
    from corpusforge.operators.extract import bio_entities

    used = bio_entities(aligned, [id_col], types={"Person": "PER", "Location": "LOC", "Organization": "ORG", "Miscellaneous": "MISC", "SHIP": "SHIP"})
    return names.join(used.select(F.lower("text").alias("_l")).distinct(), F.lower(names["text"]) == F.col("_l"), "left_anti")
