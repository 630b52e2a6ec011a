"""Problem 10: abusive, hateful or sexual content, scored by a factorization machine over hashed terms.

The score of a sentence is b + sum w_i + sum over pairs <v_i, v_j>, so that an insult next to a mention of a group or a
second person counts otherwise than the same word in a gloss or a law. A document has the score of its worst sentence.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from corpusforge.llm.canonical import _twin_tables

BITS = 18
MAX_REVIEWS = 20_000  # the most reviewed texts a model is fitted on
# Digits and signs written for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e", "8": "b"})
PRIOR = -4.0  # log-odds of a sentence of which no term is known; not fitted, so that unseen words prove nothing
END = -1  # marks the end of a sentence in a sequence of terms

_t = _twin_tables()
TO_LATIN = str.maketrans(dict(zip(_t["cyr"] + _t["grk"], _t["cyr_to"] + _t["grk_to"])))
TO_CYRILLIC = str.maketrans(dict(zip(_t["lat_c"].lower(), _t["to_cyr"].lower())))
_HIDDEN = regex.compile(r"\p{Cf}+")
_SPACED = regex.compile(r"(?<!\S)(?:[\p{L}\d@$] ){3,}[\p{L}\d@$](?!\S)")
_LATIN, _CYRILLIC, _OTHER = regex.compile(r"\p{Latin}"), regex.compile(r"[\p{Cyrillic}]"), regex.compile(r"[\p{Cyrillic}\p{Greek}]")
_STRICT_CYR = regex.compile(r"[бгджзилмнптфцчшщъыьэюя]")
_PIECES = regex.compile(r"[.!?。！？।॥᛭…]+(?=[\p{Pe}\p{Pf}\p{Pi}\"'“”«»]*(?:$|\p{Lu}|[\p{Ps}„“«»]))|[\p{L}\p{M}\p{N}@$*!]+")
_MASK = regex.compile(r"(\p{L})[*]{2,}(\p{L}?)")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
_RUN = regex.compile(r"(.)\1{2,}")
_ENDS = regex.compile(r"[.!?。！？।॥᛭…]+")


def term_id(term: str) -> int:
    return xxhash.xxh32_intdigest(term) & ((1 << BITS) - 1)


def plain_word(w: str) -> str:
    """A word as it was meant: one script, no marks, letters for digits, no stretched letters."""
    w = unicodedata.normalize("NFKC", w).lower()
    if _OTHER.search(w) and _LATIN.search(w):
        w = w.translate(TO_CYRILLIC) if _STRICT_CYR.search(w) else w.translate(TO_LATIN)
    elif _OTHER.search(w) and not _STRICT_CYR.search(w) and not _OTHER.search(w.translate(TO_LATIN)) and len(w) < 4:
        w = w.translate(TO_LATIN)
    w = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))
    if _LATIN.search(w) and regex.search(r"[0-9@$!€]", w):
        w = w.rstrip("!").translate(LEET)
    w = w.replace("ſ", "s").replace("ꝛ", "r").replace("ꜵ", "o").replace("æ", "ae").replace("ð", "d").replace("þ", "th").replace("ø", "o")
    return _RUN.sub(r"\1", w)


def _loose(w: str) -> str:
    return regex.sub(r"(.)\1", r"\1", w.replace("v", "u").replace("k", "c").replace("j", "i"))


def word_terms(w: str) -> list[int]:
    m = _MASK.search(w)
    if m:
        return [term_id("**"), term_id(f"{m[1].lower()}**{m[2].lower()}")]
    w = plain_word(w.replace("*", ""))
    if not w or w.isdigit():
        return []
    if _CJK.search(w):
        return [term_id("2:" + w[i : i + 2]) for i in range(max(1, len(w) - 1))]
    loose = _loose(w)
    out = [term_id("w:" + loose)]
    if len(loose) > 5:
        out.append(term_id("p:" + loose[:5]))
    return out


class Reader:
    """Texts to sequences of hashed terms with sentence ends; stretches between blanks are looked up once."""

    CACHE = 300_000

    def __init__(self):
        self.seen: dict[str, tuple] = {}

    def _chunk(self, c: str) -> tuple:
        out: list[int] = []
        for m in _PIECES.finditer(c):
            p = m[0]
            if _ENDS.fullmatch(p):
                out.append(END)
            else:
                end = p.endswith("!") and regex.fullmatch(r"[\p{L}\p{M}\p{N}@$*!]*\p{L}!+", p) is not None
                out += word_terms(p.rstrip("!") if end else p)
                if end:
                    out.append(END)
        return tuple(out)

    def terms(self, text: str | None) -> list[int]:
        if not text:
            return []
        if _HIDDEN.search(text):
            text = _HIDDEN.sub("", text)
        if _SPACED.search(text):
            text = _SPACED.sub(lambda m: m[0].replace(" ", ""), text)
        out: list[int] = []
        seen = self.seen
        for c in text.split():
            got = seen.get(c)
            if got is None:
                if len(seen) >= self.CACHE:
                    seen.clear()
                got = self._chunk(c)
                if len(c) <= 64:
                    seen[c] = got
            out += got
        return out

    def sentences(self, text: str | None) -> list[list[int]]:
        out: list[list[int]] = [[]]
        for t in self.terms(text):
            if t == END:
                out.append([])
            else:
                out[-1].append(t)
        return [s for s in out if s]


@dataclass
class FactorizationMachine:
    """Weights of the hashed terms that the reviews hold; every other term has weight 0."""

    row: np.ndarray  # term -> row of w and v, 0 for terms of no weight
    w: np.ndarray
    v: np.ndarray
    b: float
    threshold: float = 0.35  # on held-out fifths of the reviews it misses 12 texts where 0.5 misses 16, both with one false one

    def linear(self) -> "FactorizationMachine":
        """The same machine without its pairs, to see what they do."""
        return FactorizationMachine(self.row, self.w, np.zeros_like(self.v), self.b, self.threshold)

    def score(self, terms: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probability for each stretch of terms; starts are the first places of the (non-empty) stretches."""
        if not len(starts):
            return np.zeros(0)
        r = self.row[terms]
        sent = np.zeros(len(terms), np.int64)
        sent[starts[1:]] = 1
        sent = np.cumsum(sent)
        known = r > 0
        key = np.unique(sent[known] << BITS | r[known])  # a term counts once in a sentence
        sent, r = key >> BITS, key & ((1 << BITS) - 1)
        z = np.full(len(starts), self.b)
        if len(key):
            at = np.flatnonzero(np.r_[True, sent[1:] != sent[:-1]])
            v = self.v[r]
            s = np.add.reduceat(v, at, axis=0)
            z[sent[at]] += np.add.reduceat(self.w[r], at) + 0.5 * ((s * s).sum(1) - np.add.reduceat((v * v).sum(1), at))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Rows:
    """Sparse rows of distinct terms: row i holds term[start[i]:start[i + 1]]."""

    def __init__(self, term: np.ndarray, start: np.ndarray):
        self.term, self.start = term, start
        self.row = np.repeat(np.arange(len(start) - 1), np.diff(start))

    @classmethod
    def of(cls, row: np.ndarray, term: np.ndarray, n: int) -> "Rows":
        """Rows from (row, term) pairs in any order, repeats dropped."""
        key = np.unique(row.astype(np.int64) << 32 | term)
        return cls((key & 0xFFFFFFFF).astype(np.int64), np.searchsorted(key >> 32, np.arange(n + 1)))

    def __len__(self) -> int:
        return len(self.start) - 1

    def take(self, rows: np.ndarray) -> "Rows":
        n = np.diff(self.start)[rows]
        at = np.repeat(self.start[rows] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(rows) else np.zeros(0, np.int64)
        return Rows(self.term[at], np.r_[0, np.cumsum(n)])

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sum over each row of x at its terms."""
        got = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x[self.term], axis=0, dtype=np.float64)])
        return got[self.start[1:]] - got[self.start[:-1]]

    def back(self, x: np.ndarray, terms: int) -> np.ndarray:
        """Sum over the rows that hold a term of x (rows x columns), for every term."""
        return np.stack([np.bincount(self.term, x[self.row, k], terms) for k in range(x.shape[1])], axis=1)


def _logit(rows: Rows, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each row, and the sums of its factors."""
    got = rows.sums(np.c_[w, (v * v).sum(1), v])
    xv = got[:, 2:]
    return PRIOR + got[:, 0] + 0.5 * ((xv * xv).sum(1) - got[:, 1]), xv


def fit(texts: list[tuple[str, bool]], factors: int = 8, steps: int = 90, rounds: int = 1, folds: int = 4, seed: int = 7, machines: int = 3) -> FactorizationMachine:
    """Fit on reviewed texts. A text that is abusive has at least one abusive sentence, not known which: the sentence
    that scores highest stands for it, first by how its terms are spread over the classes, then by the model so far."""
    reader = Reader()
    bags = [(reader.sentences(t), y) for t, y in texts]
    bags = [(s, y) for s, y in bags if s]
    spread: dict[int, list[int]] = {}
    for s, y in bags:
        for t in {t for x in s for t in x}:
            spread.setdefault(t, [0, 0])[y] += 1
    n_pos, n_neg = sum(y for _, y in bags) or 1, sum(not y for _, y in bags) or 1
    # wording that recurs in abusive texts and in no other is the first sign; random neighbours do not recur
    pairs: dict[tuple[int, int], list[int]] = {}
    for bag, y in bags:
        for g in {g for t in bag for g in zip(t, t[1:])}:
            pairs.setdefault(g, [0, 0])[y] += 1

    def bend(t: int) -> float:
        a, b = spread[t]
        return float(np.log((b + 0.3) / (n_pos + 0.6)) - np.log((a + 0.3) / (n_neg + 0.6)))

    sents, bag_of, label, score = [], [], [], []
    for k, (bag, y) in enumerate(bags):
        for t in bag:
            wording = sum(min(3, pairs[g][1] - 1) for g in set(zip(t, t[1:])) if not pairs[g][0])
            # the harmless sentences of a text hold words that harmless texts hold too
            score.append(np.mean([bend(i) for i in set(t)]) + 2 * wording / len(set(t)) ** 0.5)
            sents.append(set(t))
            bag_of.append(k)
            label.append(y)
    bag_of, label, score = np.asarray(bag_of), np.asarray(label, float), np.asarray(score, np.float32)
    terms = {t for t, (a, b) in spread.items() if a + b > 1}
    for k in np.unique(bag_of[label > 0]):
        mine = np.flatnonzero(bag_of == k)
        terms |= sents[mine[np.argmax(score[mine])]]
    terms = sorted(terms)
    row = np.zeros(1 << BITS, np.int32)
    row[terms] = np.arange(1, len(terms) + 1)
    size = len(terms) + 1
    pairs_of = np.array([(i, row[t]) for i, s in enumerate(sents) for t in s if row[t]], np.int64).reshape(-1, 2)
    x = Rows.of(pairs_of[:, 0], pairs_of[:, 1], len(sents))
    rng = np.random.default_rng(seed)
    fold = rng.integers(0, folds, len(bags))[bag_of]

    def choose(score: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
        y, use = np.zeros(len(sents), np.float32), np.ones(len(sents), np.float32)
        for k in np.unique(bag_of[label > 0]):
            mine = np.flatnonzero(bag_of == k)
            best = mine[np.argmax(score[mine])]
            y[best] = 1
            use[mine[(score[mine] > limit) & (mine != best)]] = 0  # perhaps a second one: left out
        return y, use

    def learn(at: np.ndarray, y: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, v = np.zeros(size), rng.normal(0, 0.05, (size, factors))
        neg = at[(y[at] == 0) & (use[at] > 0)]
        own = x.take(at)
        row_of, term_of = [own.row], [own.term]
        for _ in range(3 * bool(len(neg))):  # harmless sentences mixed are harmless
            part = x.take(rng.choice(neg, 2 * len(neg)))
            keep = rng.random(len(part.term)) < 0.7
            row_of.append(part.row[keep] + len(at))
            term_of.append(part.term[keep])
        xs = Rows.of(np.concatenate(row_of), np.concatenate(term_of), len(at) + 2 * len(neg))
        ys = np.r_[y[at], np.zeros(2 * len(neg), np.float32)]
        us = np.r_[use[at], np.ones(2 * len(neg), np.float32)]
        us[ys > 0] = max(1.0, (us[ys == 0].sum() / max(1, ys.sum())) ** 0.5)
        adam = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v)]  # float64, terms x (1 + factors)
        for step in range(1, steps + 1):
            z, xv = _logit(xs, w, v)
            g = us * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - ys) / len(ys)
            back = xs.back(np.c_[g, g[:, None] * xv], size)
            gw = back[:, 0] + 1e-4 * w
            gv = back[:, 1:] - back[:, :1] * v + 2e-4 * v
            for par, gr, m, s2 in ((w, gw, adam[0], adam[1]), (v, gv, adam[2], adam[3])):
                m *= 0.9
                m += 0.1 * gr
                s2 *= 0.99
                s2 += 0.01 * gr * gr
                par -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s2 / (1 - 0.99**step)) + 1e-8)
            w[0] = 0
        return w, v

    y, use = choose(score, 2.0)
    for _ in range(rounds):  # a text's sentence is chosen by models that have not seen the text
        held = np.zeros(len(sents), np.float32)
        for k in range(folds):
            w, v = learn(np.flatnonzero(fold != k), y, use)
            out = np.flatnonzero(fold == k)
            held[out] = _logit(x.take(out), w, v)[0]
        y, use = choose(held + 0.2 * score, 0.0)
    # machines of several beginnings, their log-odds averaged: again one machine, with the factors side by side
    made = [learn(np.arange(len(sents)), y, use) for _ in range(machines)]
    w, v = np.mean([m[0] for m in made], axis=0), np.concatenate([m[1] for m in made], axis=1) / machines**0.5
    w[0], v[0] = 0, 0
    return FactorizationMachine(row, w, v, PRIOR)


def fit_reviews(reviews: DataFrame, **params) -> FactorizationMachine:
    """A model from the reviewed texts (text, verdict); rows without a verdict or a text are not used. At most
    MAX_REVIEWS rows, those with the smallest hash, are read."""
    rows = reviews.where("text is not null and verdict in ('abusive', 'ok')").select("text", "verdict").orderBy(F.xxhash64("text"), "text").limit(MAX_REVIEWS).collect()
    return fit([(r["text"], r["verdict"] == "abusive") for r in rows], **params)


def score_documents(df: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, abusive, worst) for every row: the probability of the worst sentence, whether it passes the
    threshold of the model, and the number of that sentence. Null, empty and blank texts score 0. The model is broadcast;
    its size is that of the hash table. No shuffle; repeated rows are scored each, other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("abusive", T.BooleanType()), T.StructField("worst", T.IntegerType())])
    reader: list[Reader] = []

    def run(batches):
        m = shared.value
        if not reader:
            reader.append(Reader())
        for b in batches:
            seqs = [reader[0].terms(t) for t in b.column(1).to_pylist()]
            n = np.fromiter((len(s) for s in seqs), np.int64, len(seqs))
            flat = np.fromiter((t for s in seqs for t in s), np.int64, int(n.sum()))
            doc = np.repeat(np.arange(len(seqs)), n)
            real = flat != END
            no = np.cumsum(~real)
            f, d, k = flat[real], doc[real], no[real]
            score, worst = np.zeros(len(seqs)), np.zeros(len(seqs), np.int32)
            if len(f):
                # only stretches with a term of any weight can differ from the empty one
                starts = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (k[1:] != k[:-1])])
                p = m.score(f, starts)
                sd = d[starts]
                heads = np.flatnonzero(np.r_[True, sd[1:] != sd[:-1]])
                best = np.maximum.reduceat(p, heads)
                score[sd[heads]] = best
                at = np.flatnonzero(p == np.repeat(best, np.diff(np.r_[heads, len(p)])))
                for i in at[::-1]:
                    worst[sd[i]] = i - heads[np.searchsorted(heads, i, side="right") - 1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(score, 6)), pa.array(score >= m.threshold), pa.array(worst)], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def abuse_rates(df: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(source, documents, abusive, rate): per source. A null source is a source of its own."""
    scored = score_documents(df.select(F.struct(id_col, source_col).alias("_k"), text_col), model, "_k", text_col)
    out = scored.groupBy(F.col(f"_k.{source_col}").alias("source")).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("abusive").cast("long")).alias("abusive"))
    return out.withColumn("rate", F.round(F.col("abusive") / F.col("documents"), 6))
