"""Byte-pair tokenization as a deterministic automaton.

The automaton is built by one merge gadget per merge. A state says which tokens may not follow; the state after token x
is `after[x]`. The gadget of merge (u, v) -> w splits the state r that follows u: a copy of r without the arc v becomes
the state after u, and w gets an arc from every state that has an arc for u, leading to where v led. A copy shares all
arcs but one with the state it was split from, so a state is stored as (parent, removed arc, birth) and an arc is looked
up along that chain; arcs of tokens younger than the state follow the arc of their left half. The token sequences that
the automaton accepts are exactly those that the merges produce, one for each string.
"""

from __future__ import annotations

import base64
import itertools

import numpy as np
import regex


class BpeAutomaton:
    """Encoder and decoder for a byte-level BPE vocabulary given as ranks (lines of base64 token and rank)."""

    CACHE = 300_000  # words kept per worker; a full cache is emptied, no word is lost

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            ranks = sorted((int(r), base64.b64decode(t)) for t, r in (line.split() for line in f if line.strip()))
        self.pattern = pattern
        self.arcs = [t for _, t in ranks]
        self.ids = [r for r, _ in ranks]
        self._parent, self._removed, self._born = [0], [-1], [-1]
        self._left = [-1] * len(ranks)
        self._after = [0] * len(ranks)
        self._go: dict[int, int] = {}
        self._token: list[int] = [-1]  # token that ends at a trie node
        self._memo: dict[int, bool] = {}
        self._compile()
        self._memo = {}
        self._ready()

    def _compile(self) -> None:
        for k, arc in enumerate(self.arcs):
            if len(arc) > 1:
                parts = self._path(arc)
                if len(parts) == 2:
                    self._gadget(k, *parts)
                # else: no merge makes this token, it has no arc from any state
                else:
                    continue
            self._add(arc, k)
            self._memo.clear()

    def _gadget(self, w: int, u: int, v: int) -> None:
        r = self._after[u]
        self._left[w] = u
        self._after[w] = self._after[v]
        self._parent.append(r)
        self._removed.append(v)
        self._born.append(w)
        self._after[u] = len(self._parent) - 1

    def _add(self, arc: bytes, k: int) -> None:
        node = 0
        for b in arc:
            key = node << 8 | b
            nxt = self._go.get(key)
            if nxt is None:
                nxt = self._go[key] = len(self._token)
                self._token.append(-1)
            node = nxt
        self._token[node] = k

    def _has(self, state: int, token: int) -> bool:
        parent, removed, born, left = self._parent, self._removed, self._born, self._left
        while state:
            if token == removed[state]:
                return False
            if token >= born[state]:
                token = left[token]
                if token < 0:
                    return False
            else:
                state = parent[state]
        return True

    def _path(self, word: bytes) -> list[int]:
        """The accepted token sequence of a word: states are left to right, one token ends each reachable prefix."""
        n = len(word)
        go, token, after, memo = self._go, self._token, self._after, self._memo
        last, since = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            x = last[i]
            if i and x < 0:
                continue
            node = 0
            for j in range(i, n):
                node = go.get(node << 8 | word[j], -1)
                if node < 0:
                    break
                t = token[node]
                if t >= 0 and last[j + 1] < 0:
                    if i:
                        key = x << 20 | t
                        ok = memo.get(key)
                        if ok is None:
                            if len(memo) >= self.CACHE:
                                memo.clear()
                            ok = memo[key] = self._has(after[x], t)
                        if not ok:
                            continue
                    last[j + 1], since[j + 1] = t, i
        out, i = [], n
        while i > 0:
            if last[i] < 0:
                raise ValueError("the vocabulary lacks a byte of the text")
            out.append(last[i])
            i = since[i]
        return out[::-1]

    def _ready(self) -> None:
        self._split = regex.compile(self.pattern)
        self._odd = regex.compile(r" \s|\s\Z")
        self._chunks: dict[str, list[int]] = {}
        self._words: dict[str, list[int]] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_split", "_odd", "_chunks", "_words", "_memo")}

    def __setstate__(self, d):
        self.__dict__.update(d)
        self._memo = {}
        self._ready()

    def _encode_chunk(self, chunk: str) -> list[int]:
        out: list[int] = []
        words = self._words
        for w in self._split.findall(chunk):
            got = words.get(w)
            if got is None:
                if len(words) >= self.CACHE:
                    words.clear()
                got = [self.ids[t] for t in self._path(w.encode("utf-8", "surrogatepass"))]
                if len(w) <= 64:
                    words[w] = got
            out += got
        return out

    def count_stretch(self, stretch: str) -> int:
        """Number of tokens of a stretch that starts and ends where the pattern cuts."""
        return len(self._encode_chunk(stretch))

    def is_odd(self, text: str) -> bool:
        """Whether blanks meet other white space, so that the text cannot be cut at blanks."""
        return self._odd.search(text) is not None

    def pieces(self, text: str | None) -> list[list[int]]:
        """Token ids of a text by stretches. A blank before a visible character always starts a word of the pattern, so
        texts are cut there and stretches seen before are looked up; where blanks meet other white space, whole texts
        go through the pattern."""
        if not text:
            return []
        if self._odd.search(text):
            return [self._encode_chunk(text)]
        first, *rest = text.split(" ")
        chunks = self._chunks
        out = [self._encode_chunk(first)] if first else []
        for c in rest:
            got = chunks.get(c)
            if got is None:
                if len(chunks) >= self.CACHE:
                    chunks.clear()
                got = self._encode_chunk(" " + c)
                if len(c) <= 64:
                    chunks[c] = got
            out.append(got)
        return out

    def encode(self, text: str | None) -> list[int]:
        return list(itertools.chain.from_iterable(self.pieces(text)))

    def count(self, text: str | None) -> int:
        return sum(map(len, self.pieces(text)))

    def decode(self, ids) -> str:
        """The text of a sequence of ids: the bytes of the arcs, one after the other."""
        if not hasattr(self, "_arc_of"):
            self._arc_of = dict(zip(self.ids, self.arcs))
        return b"".join(self._arc_of[i] for i in ids).decode("utf-8", "replace")

    def encode_batch(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and flat ids of many texts."""
        parts, ends, total = [], [0], 0
        for t in texts:
            p = self.pieces(t)
            total += sum(map(len, p))
            parts += p
            ends.append(total)
        flat = np.fromiter(itertools.chain.from_iterable(parts), dtype=np.int32, count=total)
        return np.asarray(ends, dtype=np.int64), flat


_BUILT: dict[tuple[str, str], BpeAutomaton] = {}


def automaton(rank_file: str, pattern: str) -> BpeAutomaton:
    """The automaton of a rank file, compiled once per process."""
    key = (rank_file, pattern)
    if key not in _BUILT:
        _BUILT[key] = BpeAutomaton(rank_file, pattern)
    return _BUILT[key]
