"""Problem 2: sentence units in many languages and scripts.

A lexer turns text into symbols (terminators, quotes, brackets, kinds of words; abbreviations, numbers and initials by
regular expressions with a look at what follows). A deterministic transducer over the symbols decides where sentences
start and end. Its run is data-parallel: the symbols of a batch, documents laid end to end with a reset between them, are
cut into chunks; each chunk is evaluated as a function from state to state, the functions are composed by a prefix scan,
and with the states at the chunk borders known all chunks emit at once. A document longer than LONG is cut into pieces
that are tasks of their own: a first pass gives the function of each piece, these are composed per document, and a second
pass emits the sentences of each piece from its now known state. Pieces meet only where the lexer looks at neither side.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F, types as T

from corpusforge.runtime import cut

# Abbreviations that stand before a name, a number or a word and end no sentence.
BEFORE = "hr sr fr frú herra Mr Mrs Ms Dr St fol sbr cf jf vs dvs MSS MS f.eks"
# Abbreviations that need a number, or a capital, after them.
BEFORE_NUMBER = "s c p σ n l с ca ch kap bl bls nr cap vol κεφ см гл стр art pl jan feb febr mar apr ág aug sept okt nóv nov des dec"
BEFORE_CAPITAL = "d f S"
SPACED = [r"þ\.\s*e\.", r"i\.\s*e\.", r"e\.\s*g\.", r"т\.\s*е\.", r"f\.\s*Kr\.", r"e\.\s*Kr\.", r"d\.\s*v\.\s*s\."]
# Abbreviations that end a list, and often the sentence with it.
LISTS = [r"etc\.", r"osv\.", r"o\.\s*s\.\s*frv\.", r"o\.\s*fl\.", r"m\.\s*fl\.", r"т\.\s*д\.", r"т\.\s*п\.", r"κτλ\.", r"usw\.", r"u\.\s*s\.\s*w\."]
# Verbs of reporting clauses, with what may stand before them.
REPORT = "svaraði sagði kvað mælti spurði segir kvað svarede sagde spurgte said asked answered replied cried inquit respondit ait dixit rogavit сказал сказала ответил ответила спросил спросила εἶπεν ἔφη ἀπεκρίνατο"
SUBJECT = "he she they hann hún hon þeir han hun de он она они"
CJK_REPORT = r"と|[他她它我你您们她]{1,2}.{0,3}[说問问答道喊叫曰]|[说问答道曰]"
# Second parts of compound names; names start no clause of their own after a break.
NAME_ENDS = "brandr geirr gautr steinn viðr varðr mundr grímr kell leifr laugr laug hvatr þegn finnr bjǫrn valdr dís gerðr hildr ný ríðr veig þrúðr fjall nes múli fjǫrðr skógr bakki sandr hóll heiðr fell dalr vík staðir hamarr"

LONG = 1_000_000  # characters of a text that one task reads; longer ones are cut into pieces of about this size
#: Where the lexer looks neither back nor ahead: after a lower-case word of five letters or more, after a full stop of
#: scripts without spaces, after a line break in Thai.
CUT = regex.compile(r"(?<=\p{Ll}{5}) (?=\p{L})|(?<=[。！？।॥᛭])(?=\p{L})|(?<=[฀-๿])\n(?=[฀-๿])")

SYMBOLS = "RESET PARA THB TERM WEAK NUMDOT LOW LOWB REP CAP NAME NEU PUNCT OB CB Q_LOW Q_66 Q_99 Q_LL Q_RR Q_STR Q_OPEN Q_CLOSE".split()
SYM = {s: i for i, s in enumerate(SYMBOLS)}
PHASES = "NONE IN TERM TERMQ WEAK DONE".split()
NONE, IN, TERM, TERMQ, WEAK, DONE = range(6)
QUOTES = 6  # none, low, 66, left guillemet, right guillemet, straight
STATES = len(PHASES) * QUOTES * 2


def _state(p: int, q: int, b: int) -> int:
    return (p * QUOTES + q) * 2 + b


def _step(p: int, q: int, b: int, s: str) -> tuple[int, int, int, bool, bool]:
    """(phase, quote, bracket, ends before this symbol, starts at this symbol)."""
    open_ = p != NONE
    fresh = (IN, q, 0, open_, True)
    if s in ("RESET", "PARA"):
        return NONE, 0, 0, open_, False
    if s == "THB":
        return NONE, q, 0, open_, False
    if s.startswith("Q_"):
        kind = {"Q_LOW": 1, "Q_66": 2, "Q_LL": 3, "Q_RR": 4, "Q_STR": 5}.get(s, 0)
        closes = (s in ("Q_99", "Q_CLOSE") or s == "Q_66" and q == 1 or s == "Q_LL" and q == 4 or s == "Q_RR" and q in (3, 4) or s == "Q_STR" and q == 5)
        if closes:
            return (TERMQ if p in (TERM, TERMQ) else p), 0, b, False, False
        kind = kind or 2
        if p == IN:
            return IN, kind, b, False, False
        return IN, kind, 0, open_, True
    if s == "OB":
        return (IN, q, b, False, False) if p == IN else (IN, q, 1, open_, True)
    if s == "CB":
        if b and p in (TERM, TERMQ, WEAK):
            return DONE, q, 0, False, False
        return (TERMQ if p == TERM else p), q, 0, False, False
    if s == "TERM":
        return TERM, q, b, False, not open_
    if s == "WEAK":
        return (IN, q, 0, False, True) if p == NONE else (TERM if p == TERM else WEAK, q, b, False, False)
    if s == "NUMDOT":
        return (TERM, q, b, False, False) if p == IN else (IN, q, b, False, False) if p == WEAK else fresh
    if p == NONE:
        return fresh
    if s == "PUNCT" or p == IN:
        return IN, q, b, False, False
    if p in (TERM, DONE):
        return fresh
    if p == TERMQ:
        return (IN, q, b, False, False) if s in ("LOW", "REP") else fresh
    return fresh if s == "CAP" else (IN, q, b, False, False)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    nxt, act = np.zeros((STATES, len(SYMBOLS)), np.uint8), np.zeros((STATES, len(SYMBOLS)), np.uint8)
    for p in range(len(PHASES)):
        for q in range(QUOTES):
            for b in range(2):
                for s, i in SYM.items():
                    p2, q2, b2, end, start = _step(p, q, b, s)
                    nxt[_state(p, q, b), i] = _state(p2, q2, b2)
                    act[_state(p, q, b), i] = end + 2 * start
    return nxt, act


NEXT, ACTION = _tables()


def run_transducer(symbols: np.ndarray, chunk: int = 512) -> np.ndarray:
    """Action of each symbol (1: a sentence ends before it, 2: one starts at it), by prefix scan over chunks."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.uint8)
    rows = -(-n // chunk)
    sym = np.full(rows * chunk, SYM["RESET"], np.uint8)
    sym[:n] = symbols
    sym = sym.reshape(rows, chunk)
    f = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (rows, STATES)).copy()
    for i in range(chunk):
        f = NEXT[f, sym[:, i, None]]
    step = 1
    while step < rows:  # after this, row r holds the composition of rows 0..r
        f[step:] = np.take_along_axis(f[step:], f[:-step].copy(), axis=1)
        step *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = f[:-1, _state(NONE, 0, 0)]
    state[0] = _state(NONE, 0, 0)
    out = np.empty((rows, chunk), np.uint8)
    for i in range(chunk):
        out[:, i] = ACTION[state, sym[:, i]]
        state = NEXT[state, sym[:, i]]
    return out.reshape(-1)[:n]


def _alt(words: str) -> str:
    return "|".join(sorted({regex.escape(w) for w in words.split()}, key=len, reverse=True))


class Lexer:
    """Text to symbols with their places."""

    def __init__(self):
        names = _alt(NAME_ENDS)
        word = r"[\p{L}\p{M}][\p{L}\p{M}\p{N}'’ʼ\-]*"
        # after any word the transducer is inside a sentence, where further words and commas change nothing: they are read
        # with it, unless a dot or a sign of words follows
        more = r"(?:,?[ \n][\p{Latin}\p{Cyrillic}\p{Greek}][\p{Latin}\p{Cyrillic}\p{Greek}\p{M}]*+(?![.…\p{L}\p{M}\p{N}'’ʼ\-]))*+"
        self.name = regex.compile(rf"\p{{Lu}}\p{{M}}*[\p{{Ll}}\p{{M}}]*(?:{names})(?:s|i|ar|)$|\p{{Lu}}[\p{{Ll}}\p{{M}}]*(?:sson|arson|dóttir)$")
        start = r"(?<![\p{L}\p{M}\p{N}])"
        nxt_name = rf"(?=\s+(?:\p{{Ll}}|\p{{Lu}}[\p{{L}}\p{{M}}]*(?:{names})))"
        parts = [
            ("PARA", r"[^\S\n]*\n[^\S\n]*\n\s*"),
            ("THB", r"(?<=[฀-๿])[^\S\n]+(?=[฀-๿])"),
            ("BLANK", r"\s+"),
            ("LIST", start + "(?i:" + "|".join(LISTS) + r")(?![\p{L}])"),
            ("ABBR", start + "(?:" + "(?i:" + _alt(BEFORE) + r")\.(?!\.)|(?:" + "|".join(SPACED) + r")|(?i:" + _alt(BEFORE_NUMBER) + r")\.(?=\s*\d)|(?:" + _alt(BEFORE_CAPITAL) + r")\.(?=\s+\p{Lu})|\p{Ll}{1,2}(?:\.\p{Ll}{1,2})+\.(?=\s*[\p{L}\d]))"),
            ("INIT", start + r"\p{Lu}\p{M}*\.(?=\s+[\p{L}\d]|\p{Lu}\.)"),
            ("NUMORD", start + r"\d+(?:[.,:]\d+)*\." + nxt_name),
            ("NUMDOT", start + r"\d+(?:[.,:]\d+)*\.(?=\s)"),
            ("NUM", r"\d+(?:[.,:]\d+)*"),
            ("ELL", r"(?:\.{2,}|…+)(?![!?。！？])"),
            ("TERM", r"[.!?。！？．।॥᛭‽]+"),
            ("ASK", r"[;\u037e](?<=[\p{Greek}\p{M}][;\u037e])"),
            ("OB", r"[(\[（【〔]"),
            ("CB", r"[)\]）】〕]"),
            ("Q_LOW", "[„‚]"), ("Q_66", "[“]"), ("Q_99", "[”]"), ("Q_LL", "[«]"), ("Q_RR", "[»]"), ("Q_STR", '["]'), ("Q_OPEN", "[「『《〈]"), ("Q_CLOSE", "[」』》〉]"),
            ("CJK", r"[\p{Han}\p{Hiragana}\p{Katakana}ー々]+"),
            ("WORD", word + more),
            ("OTHER", r"\S"),
        ]
        self.kinds = [k for k, _ in parts]
        self.pattern = regex.compile("|".join(f"({p})" for _, p in parts))
        self.report = frozenset(REPORT.split())
        self.subject = frozenset(SUBJECT.split())
        self.cjk = regex.compile(CJK_REPORT)
        self.fixed = {i + 1: SYM[k] for i, k in enumerate(self.kinds) if k in SYM}
        self.no = {k: i + 1 for i, k in enumerate(self.kinds)}
        self.first = regex.compile(r"\p{L}")
        self.low_next = regex.compile(r"[^\S\n]*\n?[^\S\n]*\p{Ll}")
        self.next_word = regex.compile(r"\s+(\p{L}+)")
        self.words: dict = {}

    def _word(self, w: str) -> str:
        c = w[0]
        if c.islower():
            return "low"
        if c.isupper() or c.istitle():
            return "NAME" if self.name.match(w) else "CAP"
        return "NEU"

    def is_small(self, text: str) -> bool:
        """Whether a text is one without capitals: its first letter tells."""
        m = self.first.search(text)
        return bool(m) and m[0].islower()

    def symbols(self, text: str, small: bool | None = None) -> tuple[list[int], list[int], list[int]]:
        """Symbols with first place and place after the last; `small` of the whole text, if this is a piece of it."""
        sym, begin, end = [], [], []
        fixed, no, words, kind_of = self.fixed, self.no, self.words, self._word
        small = self.is_small(text) if small is None else small
        low = SYM["LOWB"] if small else SYM["LOW"]
        CAP, NAME, NEU, REP, WEAKS, TERMS, PUNCT = (SYM[x] for x in ("CAP", "NAME", "NEU", "REP", "WEAK", "TERM", "PUNCT"))
        after_subject = False
        for m in self.pattern.finditer(text):
            k = m.lastindex
            if k == no["BLANK"]:
                continue
            s = fixed.get(k)
            if k == no["WORD"]:
                w = m[0].split(None, 1)[0].rstrip(",")
                kind = words.get(w)
                if kind is None:
                    if len(words) > 200_000:
                        words.clear()
                    kind = words[w] = kind_of(w)
                if kind == "low":
                    s = REP if w in self.report else low
                    if s == low and small and w in self.subject and sym and self._reported(text, m.start() + len(w)):
                        s = REP
                else:
                    s = SYM[kind]
            elif s is None:
                if k == no["ELL"]:
                    s = WEAKS
                elif k == no["LIST"]:
                    s = TERMS if small else WEAKS
                elif k == no["ABBR"]:
                    s = CAP if m[0][0].isupper() and not m[0][:2].isupper() else low
                elif k == no["ASK"]:  # a lower-case word after it: a semicolon
                    s = PUNCT if not small and self.low_next.match(text, m.end()) else TERMS
                elif k == no["INIT"]:
                    s = NAME
                elif k == no["NUMORD"] or k == no["NUM"]:
                    s = NEU
                elif k == no["CJK"]:
                    s = REP if self.cjk.match(m[0]) else NEU
                else:
                    s = PUNCT if m[0] in ",;\u037e:–—-،、，；：᛫᛬/·" else NEU
            sym.append(s)
            begin.append(m.start())
            end.append(m.end())
        return sym, begin, end

    def _reported(self, text: str, at: int) -> bool:
        m = self.next_word.match(text, at)
        return bool(m) and m[1] in self.report


_LEXER: list[Lexer] = []


def lexer_of_worker() -> Lexer:
    if not _LEXER:
        _LEXER.append(Lexer())
    return _LEXER[0]


def pieces(text: str, long: int = LONG) -> list[int]:
    """Starts of the pieces of a text: the first places to cut at or after each multiple of `long`."""
    at, out = long, [0]
    while at < len(text):
        m = CUT.search(text, at)
        if not m:
            break
        out.append(m.end())
        at = m.end() + long
    return out


def piece_function(sym: np.ndarray) -> np.ndarray:
    """The state after the symbols, for every state before them."""
    f = np.arange(STATES, dtype=np.uint8)
    cut = sym[: len(sym) // 512 * 512].reshape(-1, 512)
    if len(cut):  # chunks side by side, then one after the other
        g = np.broadcast_to(f, (len(cut), STATES)).copy()
        for i in range(512):
            g = NEXT[g, cut[:, i, None]]
        for row in g:
            f = row[f]
    for x in sym[len(cut) * 512 :]:
        f = NEXT[f, x]
    return f


def run_from(sym: np.ndarray, state: int) -> np.ndarray:
    """Action of each symbol, from a state."""
    out = np.empty(len(sym), np.uint8)
    nxt, act = NEXT.tolist(), ACTION.tolist()
    for i, x in enumerate(sym.tolist()):
        out[i] = act[state][x]
        state = nxt[state][x]
    return out


def split_sentences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end inclusive) of every sentence of a list of texts."""
    lexer = lexer_of_worker()
    sym, begin, end, row = [], [], [], []
    reset = SYM["RESET"]
    for i, t in enumerate(texts):
        if t and not t.isspace():
            s, b, e = lexer.symbols(t)
            sym += s
            begin += b
            end += e
            row += [i] * len(s)
            sym.append(reset)
            begin.append(0)
            end.append(0)
            row.append(i)
    act = run_transducer(np.asarray(sym, dtype=np.uint8))
    begin, end, row = np.asarray(begin, np.int64), np.asarray(end, np.int64), np.asarray(row, np.int64)
    starts, stops = np.flatnonzero(act & 2), np.flatnonzero(act & 1)
    stops = stops - 1
    skip = np.isin(np.asarray(sym)[stops] if len(stops) else stops, (SYM["THB"], SYM["PARA"]))
    while skip.any():
        stops = stops - skip
        skip = np.isin(np.asarray(sym)[stops], (SYM["THB"], SYM["PARA"]))
    return row[starts], begin[starts], end[stops] - 1


def sentences(df: DataFrame, id_col: str = "text_id", text_col: str = "text", long: int = LONG) -> DataFrame:
    """(id_col, sentence, start_pos, end_pos): one row per sentence, in code points, ends inclusive, blanks outside.

    Null, empty and blank texts have no sentence. A text without any terminator is one sentence per paragraph. Repeated
    rows give their sentences again; other columns are ignored. Texts of up to `long` characters are read whole in one
    pass without a shuffle; longer ones in pieces by many tasks, with the same result.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("sentence", T.IntegerType()), T.StructField("start_pos", T.LongType()), T.StructField("end_pos", T.LongType())])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                row, start, end = split_sentences(part.column(1).to_pylist())
                first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
                at = np.flatnonzero(first)
                number = np.arange(len(row)) - np.repeat(at, np.diff(np.r_[at, len(row)])) if len(row) else row
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=schema.names)

    size = F.length(text_col)
    short = df.where(size <= long).select(id_col, text_col).mapInArrow(run, schema)
    lengthy = df.where(size > long).select(id_col, text_col)
    return short if lengthy.isEmpty() else short.unionByName(_long_sentences(lengthy, schema, long))


def _long_sentences(df: DataFrame, schema: T.StructType, long: int) -> DataFrame:
    """Sentences of long texts: pieces, their functions, the state before each piece, then the sentences of each piece.
    What a piece leaves open at either side, one end and one start at most, is put together per document."""
    id_col, id_type = schema[0].name, schema[0].dataType.simpleString()

    def chop(batches):
        lexer = lexer_of_worker()
        for b in batches:
            for i, t in enumerate(b.column(1).to_pylist()):
                starts = pieces(t, long)
                small = lexer.is_small(t)
                uid = uuid.uuid5(uuid.NAMESPACE_OID, str(b.column(2)[i].as_py())).bytes
                for k, (lo, hi) in enumerate(zip(starts, [*starts[1:], len(t)])):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([uid]), pa.array([k], pa.int32()), pa.array([lo], pa.int64()), pa.array([small]), pa.array([hi == len(t)]), pa.array([t[lo:hi]])],
                                                     names=["id", "uid", "k", "lo", "small", "last", "piece"])

    def read(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sym, begin, end = lexer_of_worker().symbols(r["piece"], r["small"])
        if r["last"]:
            sym, begin, end = [*sym, SYM["RESET"]], [*begin, 0], [*end, 0]
        return np.array(sym, np.uint8), np.array(begin, np.int64) + r["lo"], np.array(end, np.int64) + r["lo"]

    def real(sym):
        return ~np.isin(sym, (SYM["THB"], SYM["PARA"], SYM["RESET"]))

    def functions(batches):
        for b in batches:
            for r in b.to_pylist():
                sym, _, end = read(r)
                ends = end[real(sym)]
                yield pa.RecordBatch.from_arrays([pa.array([r["uid"]]), pa.array([r["k"]], pa.int32()), pa.array([piece_function(sym).tobytes()]), pa.array([int(ends[-1]) - 1 if len(ends) else -1], pa.int64())], names=["uid", "k", "f", "end"])

    def compose(table: pa.Table) -> pa.Table:
        state, end, out = _state(NONE, 0, 0), -1, []
        for r in sorted(table.to_pylist(), key=lambda r: r["k"]):
            out.append((r["uid"], r["k"], state, end))
            state = int(np.frombuffer(r["f"], np.uint8)[state])
            end = max(end, r["end"])
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.binary(), pa.int32(), pa.int32(), pa.int64()))], names=["uid", "k", "state", "before"])

    def emit(batches):
        for b in batches:
            for r in b.to_pylist():
                sym, begin, end = read(r)
                act = run_from(sym, r["state"])
                last = np.maximum.accumulate(np.where(real(sym), end - 1, r["before"]))  # the end of the last symbol of a sentence
                stops = np.flatnonzero(act & 1)
                ends = np.where(stops > 0, last[np.maximum(stops, 1) - 1], r["before"])
                starts = begin[np.flatnonzero(act & 2)]
                open_ = r["state"] // (2 * QUOTES) != NONE  # the piece begins inside a sentence
                n = len(starts) + open_
                first = [None] * bool(open_) + starts.tolist()
                final = ends.tolist() + [None] * (n - len(ends))
                yield pa.RecordBatch.from_arrays([pa.array([r["id"]] * n, b.schema.field("id").type), pa.array([r["uid"]] * n, pa.binary()), pa.array([r["k"]] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(first, pa.int64()), pa.array(final, pa.int64())],
                                                 names=["id", "uid", "k", "i", "s", "e"])

    # the number tells repeated rows apart; it is fixed by the checkpoint
    parts = cut(df.withColumn("_n", F.monotonically_increasing_id()).mapInArrow(chop, f"id {id_type}, uid binary, k int, lo long, small boolean, last boolean, piece string").repartition(F.col("uid"), F.col("k")))
    states = parts.mapInArrow(functions, "uid binary, k int, f binary, end long").groupBy("uid").applyInArrow(compose, "uid binary, k int, state int, before long")
    rows = cut(parts.join(states, ["uid", "k"]).mapInArrow(emit, f"id {id_type}, uid binary, k int, i int, s long, e long"))
    # open at the right (no end) and at the left (no start): the next of these in the document belongs to it
    w = Window.partitionBy("uid").orderBy("k", "i")
    open_ = rows.where("s is null or e is null").withColumn("e", F.first("e", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))).where("s is not null")
    whole = rows.where("s is not null and e is not null").unionByName(open_)
    counts = rows.where("s is not null").groupBy("uid", "k").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("least"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("uid").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = counts.select("uid", "k", "least", before.alias("before"))
    out = whole.join(offset, ["uid", "k"]).withColumn("sentence", (F.col("before") + F.col("i") - F.col("least")).cast("int"))
    return out.select(F.col("id").alias(id_col), "sentence", F.col("s").alias("start_pos"), F.col("e").alias("end_pos"))
