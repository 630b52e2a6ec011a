"""Problem 5: sentences that recur, exactly or nearly, across splits."""

from __future__ import annotations

import hashlib
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from corpusforge.runtime import cut

MIN_TOKENS = 8
MAX_EDITS = 2
SKETCH_BITS = 22  # the sketch of evaluation shingles has this many bits of places, one byte each, whatever the data
SLICES = 64  # parts in which the sketch is added up
HOT = 16  # shingles more frequent than this are joined by length and place as well
BROADCAST_IDS = 1_000_000  # the most ids (8 bytes each) of texts that are broadcast to find their words; more are joined by shuffle
SEP, NULL = "\x1f", "\x00"


def plain_token(token: str | None) -> str | None:
    """Trimmed, without case and without marks on letters; None if it holds no letter or digit."""
    if token is None:
        return None
    t = "".join(c for c in unicodedata.normalize("NFD", token.strip()) if not unicodedata.category(c).startswith("M")).lower()
    return t if any(c.isalnum() for c in t) else None


def edits_within(a: list, b: list, most: int) -> bool:
    """Whether at most `most` tokens must be inserted, deleted or replaced to turn a into b."""
    if abs(len(a) - len(b)) > most:
        return False
    lo, ea, eb = 0, len(a), len(b)
    while lo < ea and lo < eb and a[lo] == b[lo]:
        lo += 1
    while ea > lo and eb > lo and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
    a, b = a[lo:ea], b[lo:eb]
    if min(len(a), len(b)) == 0:
        return max(len(a), len(b)) <= most
    if most == 0:
        return False
    far = most + 1
    row = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [i if i <= most else far] + [far] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            new[j] = min(far, row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1)
        row = new
        if min(row) > most:
            return False
    return row[-1] <= most


def _runs(batches):
    """Neighbouring rows of one sentence with consecutive places as one row: fewer rows and bytes to shuffle."""
    for b in batches:
        if not b.num_rows:
            continue
        sent, tok = b.column(0).to_numpy(), b.column(2).to_numpy()
        split = b.column(1).dictionary_encode()
        code = split.indices.to_numpy()
        source = b.column(4).fill_null(NULL).dictionary_encode()
        scode = source.indices.to_numpy()
        new = np.r_[True, (sent[1:] != sent[:-1]) | (code[1:] != code[:-1]) | (tok[1:] != tok[:-1] + 1) | (scode[1:] != scode[:-1])]
        at = np.flatnonzero(new)
        token = pc.replace_substring(b.column(3).fill_null(NULL), SEP, "\ue01f")
        lists = pa.ListArray.from_arrays(pa.array(np.r_[at, len(sent)], pa.int32()), token)
        take = pa.array(at)
        yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), b.column(4).take(take), b.column(2).take(take), pc.binary_join(lists, SEP)], names=["sent_id", "split", "source", "first", "tokens"])


SENTENCES = "sent_id long, split string, source string, words string, n int, text_id binary, t long"


def _assembled(batches):
    """Sentences from their runs, sorted by sentence and split."""
    seen: dict[str, str | None] = {}

    def plain(w: str) -> str | None:
        if w not in seen:
            if len(seen) > 500_000:
                seen.clear()
            seen[w] = None if w == NULL else plain_token(w)
        return seen[w]

    def finish(key, source, runs, out):
        if len(runs) == 1:
            raw = runs[0][1].split(SEP)
        else:
            place: dict[int, str] = {}
            for first, tokens in runs:
                for i, w in enumerate(tokens.split(SEP), first):
                    old = place.get(i, NULL)
                    if old == NULL or w != NULL and w < old:
                        place[i] = w
            raw = [w for _, w in sorted(place.items())]
        words = [p for w in raw if (p := plain(w)) is not None]
        text = SEP.join(words)
        digest = hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()
        for c, x in zip(out, (*key, source, text, len(words), digest, int.from_bytes(digest[:8], "big", signed=True))):
            c.append(x)

    def batch(out):
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["sent_id", "split", "source", "words", "n", "text_id", "t"])

    key, source, runs = None, None, []
    for b in batches:
        out: tuple = ([], [], [], [], [], [], [])
        for sent, split, src, first, tokens in zip(*[b.column(i).to_pylist() for i in range(5)]):
            if (sent, split) != key:
                if key is not None:
                    finish(key, source, runs, out)
                key, source, runs = (sent, split), src, []
            elif src is not None and (source is None or src < source):
                source = src
            runs.append((first, tokens))
        yield batch(out)
    if key is not None:
        out = ([], [], [], [], [], [], [])
        finish(key, source, runs, out)
        yield batch(out)


def sentences(tokens: DataFrame, sent: str = "sent_id", tok: str = "tok_id", token: str = "token", split: str = "split", source: str = "source") -> DataFrame:
    """(sent_id, split, source, words, n, text_id, t): one row per sentence; words are its plain tokens in order, joined.

    Tokens delivered again (same sentence and place) count once, with the least token that is not null; null tokens are
    left out, and so are tokens without a place, which have no order. Sentences of which the split is neither train, dev
    nor test are left out; a sentence in two splits is a sentence of each. text_id is a digest (16 bytes) of the words, t
    its first half. Tokens are laid together before the shuffle, so a sentence moves as one string.
    """
    rows = tokens.where(F.col(split).isin("train", "dev", "test") & F.col(sent).isNotNull() & F.col(tok).isNotNull())
    rows = rows.select(F.col(sent).cast("long"), F.col(split), F.col(tok).cast("long"), F.col(token).cast("string"), F.col(source).cast("string"))
    runs = rows.mapInArrow(_runs, "sent_id long, split string, source string, first long, tokens string")
    return runs.repartition(F.col("sent_id")).sortWithinPartitions("sent_id", "split").mapInArrow(_assembled, SENTENCES)


class Shingler:
    """Hashed pairs of neighbouring tokens of a batch of texts."""

    def __init__(self):
        self.seen: dict[str, int] = {}

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, shingle) of all shingles, text by text, and of each text which of 64 kinds of tokens are odd in
        number. An edit changes the kinds of two tokens at most, so texts within k edits differ in 2 * k kinds at most."""
        seen, h, n = self.seen, [], []
        if len(seen) > 500_000:
            seen.clear()
        for text in words:
            ws = text.split(SEP)
            n.append(len(ws))
            for w in ws:
                x = seen.get(w)
                if x is None:
                    x = seen[w] = xxhash.xxh64_intdigest(w)
                h.append(x)
        h, n = np.array(h, np.uint64), np.array(n, np.int64)
        text = np.repeat(np.arange(len(n)), n)
        g = _mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
        inside = text[1:] == text[:-1]
        start = np.r_[0, np.cumsum(n)[:-1]] if len(n) else np.zeros(0, np.int64)
        at = np.flatnonzero(inside)
        odd = np.bitwise_xor.reduceat(np.uint64(1) << (h >> np.uint64(58)), start) if len(n) else np.zeros(0, np.uint64)
        return text[at], at - start[text[at]], g[at], odd


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _bucket(g: np.ndarray, size: int) -> np.ndarray:
    return (g >> np.uint64(65 - size.bit_length())).astype(np.int64)


def evaluation_sketch(texts: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """How often the shingles of the evaluation texts occur, up to 255, by the first `bits` bits of their hash.

    A shingle whose place is 0 is in no evaluation text. The size is fixed; at a full sketch the order of shingles gets
    coarser and fewer of them are left out, the result stays exact.
    """
    whole, size = 1 << bits, (1 << bits) // SLICES

    def count(batches):
        total, shingles = np.zeros(whole, np.uint8), Shingler()
        any_ = False
        for b in batches:
            if b.num_rows:
                any_ = True
                at, n = np.unique(_bucket(shingles(b.column(0).to_pylist())[2], whole), return_counts=True)
                total[at] = np.minimum(255, total[at].astype(np.int64) + n)
        if any_:
            parts = [zlib.compress(total[i * size : (i + 1) * size].tobytes(), 1) for i in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for c in table.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(c), np.uint8)
        return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([np.minimum(255, total).astype(np.uint8).tobytes()], pa.binary())})

    parts = texts.where("split <> 'train'").select("words").mapInArrow(count, "slice int, counts binary")
    out = np.zeros(whole, np.uint8)
    for r in parts.groupBy("slice").applyInArrow(add, "slice int, counts binary").collect():  # 2^bits bytes in all
        out[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["counts"], np.uint8)
    return out


def join_keys(texts: list[str], evaluation: bool, sketch: np.ndarray, most: int, shingles: Shingler, hot_from: int = HOT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key) and `odd` (see Shingler) of the prefix of each text: its 2 * most + 1 rarest shingles, by the sketch, then by hash.

    A rare shingle is a key by itself. A hot one is a key with the number of tokens and the place; evaluation texts offer
    every number and place that `most` edits leave possible. Training shingles that no evaluation text has give no key.
    """
    text, place, g, odd = shingles(texts)
    n = np.bincount(text, minlength=len(texts)) + 1
    seen = sketch[_bucket(g, len(sketch))]
    order = np.lexsort((place, g, seen, text))
    text, place, g, seen = text[order], place[order], g[order], seen[order]
    start = np.searchsorted(text, np.arange(len(texts)))
    rank = np.arange(len(text)) - start[text]
    same = np.r_[False, (text[1:] == text[:-1]) & (g[1:] == g[:-1])]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(text)))) if len(text) else np.zeros(0, np.int64)
    use = rank[head] < 2 * most + 1 if len(text) else np.zeros(0, bool)  # all places of a shingle whose first one is in the prefix
    if not evaluation:
        use &= seen > 0
    cold = use & ~same & (seen <= hot_from)
    hot = np.flatnonzero(use & (seen > hot_from))
    row, key = [text[cold]], [g[cold]]
    moves = [(s, d) for s in range(-most, most + 1) for d in range(-most, most + 1) if abs(s) + abs(d - s) <= most] if evaluation else [(0, 0)]
    for s, d in moves:
        row.append(text[hot])
        key.append(_mix(g[hot] ^ ((n[text[hot]] + d) * 1_000_003 + place[hot] + s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    row = np.concatenate(row)
    return row, np.concatenate(key), odd[row]


def class_pairs(sents: DataFrame, min_tokens: int = MIN_TOKENS, most: int = MAX_EDITS, bits: int = SKETCH_BITS, hot: int = HOT) -> DataFrame:
    """(train_text, eval_text): pairs of texts within `most` token edits, one side in train, one in dev or test; a text that
    is on both sides is paired with itself.

    Shingles are pairs of neighbouring tokens: an edit destroys two at most, so two texts within `most` edits share one of
    their 2 * most + 1 rarest shingles, whatever the order that says which are rare, if it is the same for all. The order
    comes from a sketch of the evaluation shingles, of fixed size and broadcast, so that each text chooses its prefix in
    its own task and most training texts offer no key at all. Keys travel with eight bytes for the text; only texts of a
    candidate pair are looked up and verified. Copies of a text meet as one. Exact; needs min_tokens > 2 * most + 1.
    """
    if min_tokens < 2 * most + 2:
        raise ValueError("texts this short may share no shingle")
    spark = sents.sparkSession
    texts = sents.where(F.col("n") >= min_tokens)
    shared = spark.sparkContext.broadcast(evaluation_sketch(texts, bits))

    def keys(evaluation: bool):
        def run(batches):
            shingles, seen = Shingler(), set()
            for b in batches:
                if len(seen) > 500_000:
                    seen.clear()
                ids, fresh = b.column(0).to_pylist(), []
                for i, t in enumerate(ids):  # copies count once
                    if t not in seen:
                        seen.add(t)
                        fresh.append(i)
                part = b.take(pa.array(fresh, pa.int64()))
                row, key, odd = join_keys(part.column(2).to_pylist(), evaluation, shared.value, most, shingles, hot)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column(0).take(at), part.column(1).take(at), pa.array(odd.view(np.int64))], names=["k", "t", "n", "odd"])

        return run

    kind = "k long, t long, n int, odd long"
    train = texts.where("split = 'train'").select("t", "n", "words").mapInArrow(keys(False), kind).repartition(F.col("k"))
    other = texts.where("split <> 'train'").select("t", "n", "words").mapInArrow(keys(True), kind).repartition(F.col("k")).distinct()
    other = other.select("k", F.col("t").alias("e"), F.col("n").alias("m"), F.col("odd").alias("eodd"))
    near = (F.abs(F.col("n") - F.col("m")) <= most) & (F.bit_count(F.col("odd").bitwiseXOR(F.col("eodd"))) <= 2 * most)
    cand = cut(train.join(other, "k").where(near).select("t", "e").distinct())
    found = lookup(texts, cand.select("t").union(cand.select("e")), "t").select("t", "text_id", "words").distinct()
    left = found.select("t", F.col("text_id").alias("train_text"), F.col("words").alias("a"))
    right = found.select(F.col("t").alias("e"), F.col("text_id").alias("eval_text"), F.col("words").alias("b"))

    def verify(batches):
        for b in batches:
            ok = [edits_within(x.split(SEP), y.split(SEP), most) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield b.select(["train_text", "eval_text"]).filter(pa.array(ok, pa.bool_()))

    pairs = cand.join(left, "t").join(right, "e").select("train_text", "eval_text", "a", "b")
    return pairs.mapInArrow(verify, "train_text binary, eval_text binary")


def lookup(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is among ids: by broadcast if these are BROADCAST_IDS at most, else by a join."""
    ids = ids.toDF(key).distinct()
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")


def _linked(tokens: DataFrame, cols: dict) -> tuple[DataFrame, DataFrame]:
    s = cut(sentences(tokens, **cols))
    return s, cut(class_pairs(s))


def overlap_pairs(tokens: DataFrame, **cols) -> DataFrame:
    """(sent_a, sent_b), the smaller first: all pairs of a train and a dev or test sentence that are alike.

    The answer is pairs, so equal texts are written out for their sentences; overlap_report has the counts without that.
    Empty tables and tables with one split give no rows; extra columns are ignored.
    """
    s, links = _linked(tokens, cols)
    mine = lookup(s, links.select("train_text").union(links.select("eval_text")), "text_id")
    train = mine.where("split = 'train'").select(F.col("text_id").alias("train_text"), F.col("sent_id").alias("x"))
    other = mine.where("split <> 'train'").select(F.col("text_id").alias("eval_text"), F.col("sent_id").alias("y"))
    out = links.join(train, "train_text").join(other, "eval_text")
    return out.select(F.least("x", "y").alias("sent_a"), F.greatest("x", "y").alias("sent_b")).distinct()


def overlap_report(tokens: DataFrame, **cols) -> DataFrame:
    """(split, source, sentences, overlapping, pairs) for dev and test: sentences, those with a partner in train, and
    the number of pairs. Counts are taken on texts, pairs are not written out."""
    s, links = _linked(tokens, cols)
    copies = lookup(s, links.select("train_text"), "text_id").where("split = 'train'").groupBy(F.col("text_id").alias("train_text")).agg(F.count(F.lit(1)).alias("c"))
    hits = links.join(copies, "train_text").groupBy(F.col("eval_text").alias("text_id")).agg(F.sum("c").alias("partners"))
    return s.where("split <> 'train'").join(hits, "text_id", "left").groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("sentences"), F.count("partners").alias("overlapping"), F.coalesce(F.sum("partners"), F.lit(0)).alias("pairs"))
