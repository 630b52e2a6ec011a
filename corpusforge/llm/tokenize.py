"""Problem 8: encoding of a corpus with a public tokenizer."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from corpusforge.llm.bpe import automaton


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """The rank file of a public byte-level tokenizer; `folder` is where the vocabulary files are."""
    if folder:
        return f"{folder}/{name}.tiktoken"
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode_corpus(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and `ids` (list of int) of every row.

    The automaton is compiled on the driver and broadcast; its size is that of the vocabulary (about 3 MB for 50,000
    tokens), whatever the corpus. Null and empty texts give an empty list, text that spells a special token is ordinary
    text, repeated rows and null ids are kept, other columns are ignored. No shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(automaton(rank_file, pattern))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        a = shared.value
        for b in batches:
            ends, ids = a.encode_batch(b.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode_corpus(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """`id_col` and `text`: the bytes of the arcs, so that decoding undoes encode_corpus. A null list gives null."""
    shared = df.sparkSession.sparkContext.broadcast(automaton(rank_file, pattern))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches):
        a = shared.value
        for b in batches:
            texts = [None if x is None else a.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, schema)


class _Counts(dict):
    """Stretch of text -> its token counts by all tokenizers, packed 40 bits each, so that one sum adds them all."""

    BITS = 40

    def __init__(self, tools: list):
        self.tools = tools

    def pack(self, counts) -> int:
        return sum(n << self.BITS * i for i, n in enumerate(counts))

    def __missing__(self, stretch: str) -> int:
        if len(self) >= self.tools[0].CACHE:
            self.clear()
        n = self.pack(a.count_stretch(" " + stretch) for a in self.tools)
        if len(stretch) <= 64:
            self[stretch] = n
        return n

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        if self.tools[0].is_odd(text):
            return self.pack(a.count_stretch(text) for a in self.tools)
        first, *rest = text.split(" ")
        return (self.pack(a.count_stretch(first) for a in self.tools) if first else 0) + sum(map(self.__getitem__, rest))


def token_counts(df: DataFrame, automata: dict[str, tuple[str, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and one column n_<name> per tokenizer, from one pass over the texts. Null and empty texts count 0.
    All tokenizers must share one split pattern, since stretches are cut once for all."""
    names = sorted(automata)
    if len({automata[k][1] for k in names}) > 1:
        raise ValueError("the tokenizers split text by different patterns")
    shared = df.sparkSession.sparkContext.broadcast({k: automaton(*automata[k]) for k in names})
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType)] + [T.StructField(f"n_{k}", T.LongType(), False) for k in names])

    def run(batches):
        counts = _Counts([shared.value[k] for k in names])
        mask = (1 << _Counts.BITS) - 1
        for b in batches:
            packed = [counts.of(t) for t in b.column(1).to_pylist()]
            cols = [pa.array([n >> _Counts.BITS * i & mask for n in packed], pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[f.name for f in schema])

    return df.select(id_col, text_col).mapInArrow(run, schema)
