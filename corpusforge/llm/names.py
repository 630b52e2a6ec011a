"""Problem 4: variant spellings of names, linked to the entries of an authority list."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusforge.llm.canonical import canonical_text
from corpusforge.runtime import cut

# Titles, prepositions and other words that belong to no name.
TITLES = "herra hr sira sr biskup biskups konungr konungur konungs jarl jarls prestr prestur prests abbadis aboti abota hersir hersis fru drottning skald logmadr logsogumadr munkr dominus dom episcopus rex comes presbyter abbas skip skipit knorr a i at in de af or til vid hinn inn"
# Case endings and endings of other times and tongues, after folding.
ENDINGS = ("", "r", "s", "i", "a", "u", "ar", "ir", "ur", "us", "um", "is", "rs", "ri", "rum", "rin", "in", "it", "ins", "ius", "o", "ae", "am", "ni", "es")
# What a father's name is followed by.
SON = ("sonar", "syni", "suni", "sonr", "sonur", "sun", "son", "sn")
DAUGHTER = ("dotur", "dotir", "dotr", "doter", "doti")
FATHER_WORDS = {"filius": "m", "filia": "f", "son": "m", "dotir": "f", "sonr": "m", "dotur": "f", "sonar": "m", "filii": "m", "filie": "f"}
#: Letters that scribes and typists exchange. Doubles are single after folding.
FOLD = str.maketrans({"þ": "t", "ð": "d", "đ": "d", "æ": "e", "œ": "e", "ø": "o", "ꜵ": "o", "ǫ": "o", "ſ": "s", "ꝛ": "r", "ꝼ": "f", "ꝩ": "v", "ı": "i", "v": "u", "w": "u", "j": "i", "y": "i", "k": "c", "q": "c", "z": "s", "ł": "l",
                      "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "i", "х": "x", "і": "i", "ј": "i", "ѕ": "s", "ӕ": "e", "к": "c", "ο": "o", "ϸ": "t"})
OGONEK = str.maketrans({"ǫ": "o", "ꜵ": "o", "ø": "o", "ſ": "s", "ꝛ": "r", "ꝼ": "f", "ꝩ": "v"})
#: Fixed rule: the vowels of Old Norse breaking before rn count as one (bjǫrn, bjarnar, birni).
BREAKING = re.compile(r"[ij][aeo]?(?=rn)")
CACHE = 200_000  # written tokens of which a worker keeps the candidates and costs
BLOCK = 20_000  # entries of the authority list in one broadcast; a longer list goes in several


@lru_cache(maxsize=CACHE)
def fold(token: str) -> str:
    t = "".join(c for c in unicodedata.normalize("NFD", token.lower().translate(OGONEK)) if not unicodedata.category(c).startswith("M"))
    t = BREAKING.sub("io", t).translate(FOLD)
    t = t.replace("th", "t").replace("ae", "e").replace("oe", "e").replace("ph", "f")
    t = "".join(c for c in t if c.isalnum())
    return re.sub(r"(.)\1+", r"\1", t)


def deletes(token: str, most: int) -> set[str]:
    """The token with up to `most` letters taken out."""
    out, last = {token}, {token}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours); most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    lo, ea, eb = 0, len(a), len(b)
    while lo < ea and lo < eb and a[lo] == b[lo]:
        lo += 1
    while ea > lo and eb > lo and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
    a, b = a[lo:ea], b[lo:eb]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    if len(a) == len(b) == 1 or len(a) == len(b) == 2 and a == b[::-1]:
        return min(1, most + 1)
    if most < 2 or len(set(a) ^ set(b)) > 2 * most:  # an edit changes the letters in use by two at most
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = row[j - 1] if x == y else row[j - 1] + 1
            if row[j] < d:
                d = row[j] + 1
            if new[-1] < d:
                d = new[-1] + 1
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y and before[j - 2] < d:
                d = before[j - 2] + 1
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def allowed(n: int) -> int:
    return 0 if n < 3 else 1 if n < 7 else 2


def father(token: str) -> tuple[str, str] | None:
    """(stem of the father's name, sex) of a folded patronymic."""
    for ends, sex in ((SON, "m"), (DAUGHTER, "f")):
        for e in ends:
            if token.endswith(e) and len(token) > len(e) + 2:
                t = token[: -len(e)]
                return stem(t[:-2] if t.endswith("ar") else t[:-1] if t.endswith("s") else t), sex
    return None


def stem(token: str) -> str:
    """A folded name without its nominative ending."""
    for e in ("ir", "i", "r"):
        if token.endswith(e) and len(token) - len(e) >= 3:
            return token[: -len(e)]
    return token


class Elements:
    """First and second parts of the compound names of a list, to tell another name from a misspelt one.

    A cut of a name counts if both parts occur in several names of the list, so the parts follow from the list itself.
    """

    def __init__(self, names: list[str]):
        names = sorted(set(names))
        first, second = defaultdict(set), defaultdict(set)
        for n in names:
            for i in range(2, len(n) - 1):
                first[n[:i]].add(n[i:])
                second[n[i:]].add(n[:i])
        self.first: set[str] = set()
        self.second: set[str] = set()
        for n in names:
            best = max(range(2, len(n) - 1), key=lambda i: (min(len(first[n[:i]]), len(second[n[i:]])), i), default=None)
            if best and min(len(first[n[:best]]), len(second[n[best:]])) > 1:
                self.first.add(n[:best])
                self.second.add(n[best:])
        self.names = set(names)

    def known(self, name: str) -> bool:
        return name in self.names or any(name[:i] in self.first and name[i:] in self.second for i in range(2, len(name) - 1))


class Authority:
    """A block of the authority list with a symmetric-delete index on its folded tokens.

    Candidates and costs depend on the written token alone, so they are worked out once for each and kept.
    """

    def __init__(self, rows: list[tuple], elements: dict[str, Elements]):
        self.entries = []
        self.elements = elements
        self.index: dict[str, set[int]] = defaultdict(set)
        self.prefix: dict[str, set[int]] = defaultdict(set)
        self.near_of: dict[tuple, set[int]] = {}
        self.cost_of: dict[tuple, dict[tuple, float | None]] = {}
        self.whole: dict[str, set[int]] = defaultdict(set)
        for auth_id, label, name, byname in rows:
            if not name:
                continue
            by = fold(byname) if byname else None
            parts = [fold(w) for w in re.split(r"[\s,]+", name) if w]
            parts = [w for w in parts if w and w not in TITLE_SET] or parts
            kinds = ["b" if w == by else "n" for w in parts]
            if label == "PER" and len(parts) > 1:
                kinds = ["b" if w == by else "f" if i == 0 else "p" if father(w) else "n" for i, w in enumerate(parts)]
            n = len(self.entries)
            self.entries.append((auth_id, label, parts, kinds, [fold(name), fold("".join(w for w, k in zip(parts, kinds) if k != "b"))]))
            for w, k in zip(parts, kinds):
                for form in self.forms(w, k):
                    for d in deletes(form, allowed(len(form))):
                        self.index[d].add(n)
                for i in range(1, len(w) + 1):
                    self.prefix[w[:i]].add(n)
            for whole in {fold(name), fold("".join(w for w, k in zip(parts, kinds) if k != "b"))}:
                for d in deletes(whole, 1):
                    self.whole[d].add(n)

    def forms(self, w: str, kind: str) -> set[str]:
        out = {w, stem(w)}
        f = father(w) if kind == "p" else None
        if f:
            out.add(f[0])
        return out

    # -- comparing one written token with one token of an entry: cost, or None ------------------------------------
    def cost(self, t: str, dot: bool, sex: str | None, w: str, kind: str, label: str) -> float | None:
        if t == w and not sex:
            return 0.0
        if dot:
            # "Snæfinnss." cuts the word for son short, "Sn." the name itself
            if w.startswith(t) and len(t) < len(w):
                return 0.25 if len(t) > 2 else 0.5 if len(t) > 1 else 0.75
            f = father(w) if kind == "p" else None
            if f and t.startswith(f[0]) and len(t) - len(f[0]) <= 2:
                return 0.25
            if len(t) > 3 and distance(t, w[: len(t)], 1) <= 1:
                return 1.25
            return None
        names = self.elements.get(label)
        if kind == "p":
            f, g = father(w), father(t)
            if f:
                if sex:
                    return None if sex != f[1] else self.stems(t, f[0], names)
                if g:
                    if g[1] != f[1]:
                        return None
                    c = self.stems(g[0], f[0], names)
                    if c is not None:
                        return c
                    if self.is_name(g[0], names):
                        return None
        elif sex:
            return None
        st = stem(w)
        if kind != "p" and t.startswith(st) and t[len(st) :] in ENDINGS:
            return 0.0 if not self.other(t, w, names) else None
        if kind == "f" and 2 <= len(t) <= 7 and t.endswith("i") and t != w and t[: max(1, min(3, len(t) - 1) - (len(t) > 3))] == w[: max(1, min(3, len(t) - 1) - (len(t) > 3))] and (not self.is_name(t, names) or t[:-1] in names.first):
            return 0.5  # a short form: the first letters and -i
        most = allowed(min(len(t), len(w)))
        d = distance(t, w, most)
        if d > most and kind != "p" and len(set(t) ^ set(st)) <= 2 * most + 2:  # an ending adds two letters at most
            d = min((distance(t, st + e, most) for e in ("s", "ar", "i", "us", "ur", "um", "in", "ri")), default=d)
            if d <= most:
                d += 0.25
        if d > most or self.other(t, w, names):
            return None
        return float(d)

    def stems(self, t: str, w: str, names: Elements | None) -> float | None:
        """Father's names: equal up to endings, or misspelt."""
        s = stem(t)
        if s == w or t == w or t.startswith(w) and t[len(w) :] in ENDINGS:
            return 0.0
        if self.is_name(s, names) or self.is_name(t, names):
            return None
        most = allowed(len(w))
        d = min(distance(s, w, most), distance(t, w, most))
        return float(d) if d <= most else None

    @staticmethod
    def is_name(s: str, names: Elements | None) -> bool:
        return bool(names) and (names.known(s) or names.known(s + "r"))

    def other(self, t: str, w: str, names: Elements | None) -> bool:
        """Whether t is a name of its own, other than w."""
        if not names or t == w:
            return False
        for e in ("", "s", "i", "ar", "us", "ur", "um", "in", "ri", "rs"):
            if e and not t.endswith(e):
                continue
            s = t[: len(t) - len(e)] if e else t
            for x in (s, s + "r", s + "i"):
                if x != w and names.known(x) and not (stem(x) == stem(w)):
                    return True
        return False

    def near(self, t: str, dot: bool) -> set[int]:
        """Entries with a token that t may stand for."""
        got = self.near_of.get((t, dot))
        if got is not None:
            return got
        near: set[int] = set()
        none: set[int] = set()
        f = father(t)
        if dot:
            near |= self.prefix.get(t, none)
            for w in {t[:-e] for e in (1, 2) if len(t) > 3} | ({t} if len(t) > 3 else set()) | ({f[0]} if f else set()):
                for d in deletes(w, 1):
                    near |= self.index.get(d, none)
                    if len(d) > 2:
                        near |= self.prefix.get(d, none)
        else:
            for form in {t, stem(t)} | ({f[0]} if f else set()) | {t[: -len(e)] for e in ENDINGS if e and t.endswith(e) and len(t) - len(e) > 2}:
                for d in deletes(form, allowed(len(form))):
                    near |= self.index.get(d, none)
            if t.endswith("i") and len(t) < 8:
                near |= self.prefix.get(t[: 2 if len(t) > 2 else 1], none)
        if len(self.near_of) >= CACHE:
            self.near_of.clear()
        self.near_of[t, dot] = near
        return near

    def match(self, tokens: list[tuple[str, bool, str | None]], whole: str, label: str | None) -> list[tuple[float, int]]:
        """(cost, auth_id) of the entries that the tokens may name."""
        cand: set[int] | None = None
        for t, dot, _ in tokens:  # every token must fit a token of the entry
            near = self.near(t, dot)
            cand = near if cand is None else cand & near
            if not cand:
                break
        cand = set(cand or ())
        joined_near: set[int] = set()
        if len(whole) > 8:
            for d in deletes(whole, 1):
                joined_near |= self.whole.get(d, set())
        if len(self.cost_of) >= CACHE:
            self.cost_of.clear()
        costs = [self.cost_of.setdefault(t, {}) for t in tokens]
        out = []
        for n in cand | joined_near:
            auth_id, lab, parts, kinds, joined = self.entries[n]
            if label and lab != label:
                continue
            c = self.assign(tokens, parts, kinds, lab, costs) if n in cand else None
            if c is None and n in joined_near and len(parts) > 1:
                d = min(distance(whole, j, 1) for j in joined)
                c = 0.5 + d if d <= 1 else None
            if c is not None:
                out.append((c, auth_id))
        return out

    def assign(self, tokens, parts, kinds, label, costs) -> float | None:
        """Least cost of an assignment of every written token to its own token of the entry.

        Tokens are placed in order; a state is the set of entry tokens in use and the last of them, with the totals that
        no other beats in both cost and edits. Equal tokens of an entry are used from the left, so they add no states.
        """
        if len(tokens) > len(parts):
            return None
        table = []
        for token, known in zip(tokens, costs):
            row = []
            for w, k in zip(parts, kinds):
                key = (w, k, label)
                if key not in known:
                    known[key] = self.cost(*token, w, k, label)
                row.append(known[key])
            if all(c is None for c in row):
                return None
            table.append(row)
        twin = [max((i for i in range(j) if parts[i] == parts[j] and kinds[i] == kinds[j]), default=-1) for j in range(len(parts))]
        states: dict[tuple[int, int], list[tuple[float, float]]] = {(0, -1): [(0.0, 0.0)]}
        for row in table:
            new: dict[tuple[int, int], list[tuple[float, float]]] = {}
            for (mask, last), totals in states.items():
                for j, c in enumerate(row):
                    if c is None or mask >> j & 1 or twin[j] >= 0 and not mask >> twin[j] & 1:
                        continue
                    kept = new.setdefault((mask | 1 << j, j), [])
                    for total, edits in totals:
                        x = (total + c + 0.05 * (last > j), edits + (c if c >= 1 else 0.0))
                        if x[1] <= 3 and not any(a <= x[0] and b <= x[1] for a, b in kept):
                            kept[:] = [(a, b) for a, b in kept if a < x[0] or b < x[1]] + [x]
            states = {k: v for k, v in new.items() if v}
            if not states:
                return None
        one = len(tokens) == 1
        if one and tokens[0][1] and len(tokens[0][0]) < 2:
            return None
        best = None
        for (mask, _), totals in states.items():
            left = [j for j in range(len(parts)) if not mask >> j & 1]
            if any(kinds[j] != "b" for j in left):
                # a byname names alone, or with the forename; a forename or a father's name alone names nobody
                if label != "PER" or not any(kinds[j] == "b" for j in range(len(parts)) if mask >> j & 1):
                    continue
                if not one and any(kinds[j] == "f" for j in left) or one and table[0][mask.bit_length() - 1] > 1:
                    continue
            total = min(a for a, _ in totals) + 0.1 * len(left)
            if best is None or total < best:
                best = total
        return best


TITLE_SET = {fold(w) for w in TITLES.split()}


def read_name(text: str) -> tuple[list[tuple[str, bool, str | None]], str]:
    """Tokens (folded, abbreviated, sex if a word for son or daughter followed) and the whole name folded."""
    raw = [w for w in re.split(r"[\s,]+", text) if w]
    out: list[list] = []
    for w in raw:
        dot, t = w.endswith(".") and len(w) > 1, fold(w)
        if not t:
            continue
        if t in FATHER_WORDS and out and not dot:
            if t.startswith("fili"):
                out[-1][2] = FATHER_WORDS[t]
            else:
                out[-1][0] += t  # "snæfinns son"
            continue
        if t in TITLE_SET and not (dot and len(t) == 1):
            continue
        out.append([t, dot, None])
    return [tuple(x) for x in out], "".join(fold(w) for w in raw)


def name_parts(label: str | None, name: str | None) -> list[str]:
    """What an entry teaches about names: of persons their forename and their father's name, of the rest the last token."""
    parts = [fold(w) for w in re.split(r"[\s,]+", name or "") if w]
    if not parts:
        return []
    if label != "PER":
        return [parts[-1]]
    f = father(parts[-1]) if len(parts) > 1 else None
    return [parts[0]] + ([f[0] + "r"] if f else [])


def learn_elements(entries: DataFrame) -> dict[str, Elements]:
    """Name parts per label, of the whole list: the distinct parts are found in Spark, so that blocks of the list share them
    and do not depend on how it is cut."""

    def run(batches):
        for b in batches:
            rows = {(l, x) for l, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in name_parts(l, n)}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["label", "part"])

    pool: dict[str, set[str]] = defaultdict(set)
    for r in entries.select("label", "auth_name").mapInArrow(run, "label string, part string").distinct().collect():
        pool[r["label"]].add(r["part"])
    if "LOC" in pool or "ORG" in pool:
        pool["LOC"] = pool["ORG"] = pool["LOC"] | pool["ORG"]
    return {k: Elements(sorted(v)) for k, v in pool.items()}


_KEPT: dict[str, Authority] = {}


def authority_of(key: str, rows: list[tuple], elements: dict[str, Elements]) -> Authority:
    """The index of a block, built once per worker process and not once per task."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Authority(rows, elements)
    return _KEPT[key]


def link_names(df: DataFrame, authority: DataFrame, id_col: str = "ent_id") -> DataFrame:
    """(id_col, auth_id) of the rows that name one entry of the authority list, in whatever spelling.

    What counts is norm_text, or dipl_text where norm_text is null or empty; label (before a hyphen) restricts the
    entries if the list has that label. Each distinct writing is matched once, however many rows carry it. A writing that
    fits two entries equally well names none. Null and empty names name nothing; repeated rows are all linked; an empty
    list links nothing. Names may have any number of tokens. The list is read in blocks of BLOCK entries, one broadcast
    each, beside the name parts of the whole list; per writing the best entry over all blocks is kept.
    """
    spark = df.sparkSession
    text = F.when(F.length(F.trim("norm_text")) > 0, F.col("norm_text")).otherwise(F.col("dipl_text"))
    rows = df.select(F.col(id_col), text.alias("name"), F.split(F.coalesce("label", F.lit("")), "-")[0].alias("kind")).where("length(trim(name)) > 0")
    entries = authority.select("auth_id", "label", "auth_name", "byname")
    # matching is work of the CPU: the few MB of distinct writings are spread over all cores
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    labels = entries.where("label <> ''").select(F.col("label").alias("kind")).distinct().withColumn("label", F.col("kind"))
    writings = rows.select("name", "kind").distinct().join(labels, "kind", "left")
    writings = canonical_text(writings.repartition(tasks, "name"), "name").select("name", "kind", "label", "canonical")
    blocks = max(1, -(-entries.count() // BLOCK))
    if blocks > 1:
        writings = cut(writings)  # each block reads them again
    elements = spark.sparkContext.broadcast(learn_elements(entries))
    found = None
    for k in range(blocks):
        part = [tuple(r) for r in entries.where(F.pmod(F.xxhash64("auth_id"), F.lit(blocks)) == k).collect()]
        shared = spark.sparkContext.broadcast(part)

        def run(batches, shared=shared, key=uuid.uuid4().hex):
            a = authority_of(key, shared.value, elements.value)
            for b in batches:
                out = ([], [], [], [])
                for name, kind, label, text in zip(*[b.column(i).to_pylist() for i in range(4)]):
                    tokens, whole = read_name(text)
                    if not tokens:
                        continue
                    for c, auth in sorted(a.match(tokens, whole, label))[:2]:
                        for o, x in zip(out, (name, kind, auth, c)):
                            o.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64())], names=["name", "kind", "auth_id", "cost"])

        one = writings.mapInArrow(run, "name string, kind string, auth_id long, cost double")
        found = one if found is None else found.unionByName(one)
    best = found.groupBy("name", "kind").agg(F.array_sort(F.collect_list(F.struct("cost", "auth_id"))).alias("m"))
    clear = (F.size("m") == 1) | (F.element_at("m", 2)["cost"] > F.element_at("m", 1)["cost"])
    best = best.select("name", "kind", F.when(clear, F.element_at("m", 1)["auth_id"]).alias("auth_id")).where("auth_id is not null")
    return rows.join(best, ["name", "kind"]).select(id_col, "auth_id", F.col("name").alias("written"))


def variant_links(df: DataFrame, authority: DataFrame, id_col: str = "ent_id") -> DataFrame:
    """The links of link_names whose writing is not exactly the auth_name."""
    links = link_names(df, authority, id_col)
    names = authority.select("auth_id", "auth_name")
    return links.join(names, "auth_id").where("written <> auth_name").select(id_col, "auth_id")
