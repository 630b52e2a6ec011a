"""Problem 8, against two independent encoders of the same vocabularies."""

import base64
import random

import pytest

from corpusforge.llm import tokenize
from corpusforge.llm.bpe import automaton

P = pytest.importorskip("public_tokenizers")
A = automaton(tokenize.tokenizer_file("byte_bpe_50k"), P.PATTERN)


def texts(seed, n):
    rng = random.Random(seed)
    pools = ["aaaabbcde Þþðéǫ", " \n\t   　", ".,;!?*'-", "0123456789", "漢字かな", "नमस्ते", "😀﻿́", "the and ing sk lll uuu"]
    return ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_equals_tokenizers_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for s in texts(1, 5_000) + ["<|endoftext|>", "a" * 999, " " * 99, "l" * 500, "don't we'll", "x  y", " x", "x ", "\n \n x", "\r\n\r\n a"]:
        assert A.encode(s) == t.encode(s, add_special_tokens=False).ids, repr(s)
        assert A.decode(A.encode(s)) == s
        assert A.count(s) == len(A.encode(s))


def test_equals_tiktoken_for_many_languages():
    import tiktoken

    path = tokenize.tokenizer_file("byte_bpe_multi_50k")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    b = automaton(path, P.PATTERN)
    for s in texts(2, 5_000):
        assert b.encode(s) == t.encode_ordinary(s)


def test_full_caches_change_nothing():
    keep, A.CACHE = A.CACHE, 3
    try:
        for s in texts(3, 200):
            A._chunks.clear()
            first = A.encode(s)
            assert A.encode(s) == first
    finally:
        A.CACHE = keep


def test_table(spark):
    rows = [(1, "Þat var", "x"), (2, None, "x"), (3, "", "x"), (1, "Þat var", "x"), (None, "<|endoftext|>", "x"), (4, "ok " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = tokenize.encode_corpus(df, tokenize.tokenizer_file("byte_bpe_50k"), P.PATTERN)
    got = sorted(((r["doc_id"] or 0), r["ids"]) for r in out.collect())
    assert got == sorted((i or 0, A.encode(t)) for i, t, _ in rows) and got[0][1] != [50256]
    back = {r["doc_id"]: r["text"] for r in tokenize.decode_corpus(out, tokenize.tokenizer_file("byte_bpe_50k"), P.PATTERN).collect()}
    assert back[1] == "Þat var" and back[2] == "" and back[4] == "ok " * 50_000
    assert tokenize.encode_corpus(df.limit(0), tokenize.tokenizer_file("byte_bpe_50k"), P.PATTERN).count() == 0


def test_counts_of_two_tokenizers(spark):
    rows = list(enumerate(texts(7, 400))) + [(1_000, None), (1_001, ""), (1_002, "ok " * 40_000), (1_003, " x  y ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tools = {k: (tokenize.tokenizer_file(k), P.PATTERN) for k in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    got = {r["doc_id"]: (r["n_byte_bpe_50k"], r["n_byte_bpe_multi_50k"]) for r in tokenize.token_counts(df, tools).collect()}
    want = {i: tuple(len(automaton(*tools[k]).encode(t)) for k in sorted(tools)) for i, t in rows}
    assert got == want
