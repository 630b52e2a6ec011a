"""Model inference as a hook: the model is a callable that the caller gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def tag_texts(df: DataFrame, load: Callable[[], Callable[[list[str]], list[list[dict]]]], id_col: str, text_col: str, batch: int = 32) -> DataFrame:
    """(id_col, start, end, text, label, score) from a tagger. `load` makes the tagger once per task; it takes a list of
    texts and gives, per text, dicts with start, end, word, entity and score. Null texts give no row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tag = load()
        for f in frames:
            f = f[f[text_col].notna()]
            rows = []
            for lo in range(0, len(f), batch):
                part = f.iloc[lo : lo + batch]
                for key, found in zip(part[id_col], tag(list(part[text_col]))):
                    rows += [(key, e["start"], e["end"], e["word"], e["entity"], float(e["score"])) for e in found]
            yield pd.DataFrame(rows, columns=[id_col, "start", "end", "text", "label", "score"])

    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, start int, end int, text string, label string, score double")


def embed_texts(df: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], text_col: str, out: str = "embedding", batch: int = 32) -> DataFrame:
    """df with one vector per text from an embedding callable; a null text has a null vector."""
    from pyspark.sql import functions as F

    @F.pandas_udf("array<float>")
    def f(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = load()
        for s in parts:
            vectors: list = [None] * len(s)
            at = [i for i, x in enumerate(s) if x is not None]
            for lo in range(0, len(at), batch):
                for i, v in zip(at[lo : lo + batch], embed([s.iloc[j] for j in at[lo : lo + batch]])):
                    vectors[i] = [float(x) for x in v]
            yield pd.Series(vectors)

    return df.withColumn(out, f(text_col))
