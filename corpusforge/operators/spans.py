"""Character spans of words and names. Positions are code points from 0, ends inclusive."""

from __future__ import annotations

import unicodedata

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from corpusforge.functions.chars import WORD_PATTERN

BLOCK = 50_000  # names in one broadcast automaton; a longer list goes in several


def word_spans(df: DataFrame, id_col: str, text_col: str, pattern: str = WORD_PATTERN) -> DataFrame:
    """(id_col, pos, word, start, end) of every match of a pattern. Null texts have no words. No shuffle."""
    schema = T.StructType([df.select(id_col).schema[0], T.StructField("pos", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])

    def run(batches):
        p = regex.compile(pattern)
        for b in batches:
            row, pos, word, start, end = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for k, m in enumerate(p.finditer(t or "")):
                    row.append(i)
                    pos.append(k)
                    word.append(m[0])
                    start.append(m.start())
                    end.append(m.end() - 1)
            ints = [pa.array(x, pa.int32()) for x in (pos, start, end)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), ints[0], pa.array(word, pa.string()), ints[1], ints[2]], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def count_words(c: Column) -> Column:
    """Number of words, without leaving the JVM."""
    return F.size(F.regexp_extract_all(c, F.lit(WORD_PATTERN), F.lit(0)))


def _may_follow(c: str) -> bool:
    return c in " ,;:!?).]}" or unicodedata.category(c).startswith("P")


def occurrences(df: DataFrame, names: DataFrame, id_col: str, text_col: str, boundary: bool = True, keep: str = "span") -> DataFrame:
    """(id_col, start, end, text, label, subtype, ent): every exact occurrence of every name in every text.

    names has ent (a number that orders them), text, label, subtype. Occurrences may overlap; what stands before does not
    matter; with `boundary` what follows must be the end, a blank or punctuation (a line break is none).
    keep: "span" one row per (start, end, label, subtype), "first" one name per start (the least ent), "all" every row.
    Names are looked for by an Aho-Corasick automaton per BLOCK names, so a text is read once per block, not per name.
    """
    listed = names.where("text is not null and text <> ''").select(F.col("ent").cast("long").alias("ent"), "text", "label", "subtype")
    n = listed.count()
    blocks = max(1, -(-n // BLOCK))
    schema = T.StructType([df.select(id_col).schema[0], T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("label", T.StringType()), T.StructField("subtype", T.StringType()), T.StructField("ent", T.LongType())])
    docs, out = df.select(id_col, text_col), None
    for k in range(blocks):
        rows = [tuple(r) for r in listed.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()]
        shared = df.sparkSession.sparkContext.broadcast(rows)

        def run(batches, shared=shared):
            a = ahocorasick.Automaton()
            for e, t, l, s in shared.value:
                if t in a:
                    a.get(t).append((e, t, l, s))
                else:
                    a.add_word(t, [(e, t, l, s)])
            if len(a):
                a.make_automaton()
            for b in batches:
                cols: list[list] = [[], [], [], [], [], [], []]
                for i, t in enumerate(b.column(1).to_pylist()):
                    if not t or not len(a):
                        continue
                    for end, hits in a.iter(t):
                        if boundary and end + 1 < len(t) and not _may_follow(t[end + 1]):
                            continue
                        for e, w, l, s in hits:
                            for c, x in zip(cols, (i, end - len(w) + 1, end, w, l, s, e)):
                                c.append(x)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, k) for c, k in zip(cols[1:], (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()))]], names=schema.names)

        one = docs.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    if keep == "span":
        key = [id_col, "start", "end", "label", "subtype"]
        return out.groupBy(*key).agg(F.min_by("text", "ent").alias("text"), F.min("ent").alias("ent")).select(*schema.names)
    if keep == "first":
        best = out.groupBy(id_col, "start").agg(F.min_by(F.struct("end", "text", "label", "subtype", "ent"), "ent").alias("x"))
        return best.select(id_col, "start", "x.*")
    return out


def repeated_names(found: DataFrame, id_col: str) -> DataFrame:
    """Names that occur more than once in a text, with the number of places."""
    return found.groupBy(id_col, "text").agg(F.count_distinct("start").alias("places")).where("places > 1")


def shared_places(found: DataFrame, id_col: str) -> DataFrame:
    """Places with more than one name."""
    return found.groupBy(id_col, "start", "end").agg(F.count(F.lit(1)).alias("names"), F.sort_array(F.collect_set("label")).alias("labels")).where("names > 1")


def shared_place_names(found: DataFrame, id_col: str) -> DataFrame:
    """The names at the places that have more than one: the rows of found, each with how many (names)."""
    many = shared_places(found, id_col).select(id_col, "start", "end", "names")
    return found.join(many, [id_col, "start", "end"])


def context(text: Column, start: Column, end: Column, around: int = 30) -> Column:
    """The span with up to `around` characters on either side."""
    first = F.greatest(F.lit(0), start - around)
    return F.substring(text, first + 1, end + 1 + around - first)


def verify_spans(spans: DataFrame, texts: DataFrame, id_col: str, text_col: str, word: str = "word") -> DataFrame:
    """The spans whose text is not what stands at their place."""
    t = texts.select(F.col(id_col), F.col(text_col).alias("_t"))
    there = F.expr("substring(_t, start + 1, end - start + 1)")
    return spans.join(t, id_col).where(~there.eqNullSafe(F.col(word))).drop("_t")


def boundary_differences(words: DataFrame, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Words by place against the stretches between blanks: (id_col, pos, word, expected) where they differ."""
    want = word_spans(texts, id_col, text_col, r"[^\x09-\x0d\x1c-\x20\x85\p{Z}]+").select(id_col, "pos", F.col("word").alias("expected"))
    return words.select(id_col, "pos", "word").join(want, [id_col, "pos"], "full_outer").where("not word <=> expected")


def pack_dataset(texts: DataFrame, spans: DataFrame, words: DataFrame, id_col: str, meta: list[str]) -> DataFrame:
    """One row per text with parallel arrays of names (by start, then order) and words, and its metadata.

    The type of a name is label-subtype if it has a subtype. A text without names or words has empty arrays.
    """
    kind = F.when(F.length("subtype") > 0, F.concat_ws("-", "label", "subtype")).otherwise(F.col("label"))
    s = spans.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "ent", "end", kind.alias("t")))).alias("s"))
    w = words.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("w"))
    d = texts.select(id_col, "text", *meta).join(s, id_col, "left").join(w, id_col, "left")
    pick = lambda c, f: F.coalesce(F.transform(c, lambda x: x[f]), F.array().cast("array<string>" if f == "t" else "array<int>"))
    return d.select(id_col, "text", pick("s", "t").alias("entity_types"), pick("s", "start").alias("entity_start_chars"), pick("s", "end").alias("entity_end_chars"),
                    pick("w", "start").alias("word_start_chars"), pick("w", "end").alias("word_end_chars"), *meta)


def unpack_dataset(packed: DataFrame, id_col: str, around: int = 30) -> DataFrame:
    """(id_col, type, start, end, text, context) of every name; arrays are read up to the shortest, blank texts left out."""
    z = F.arrays_zip(F.col("entity_types").alias("t"), F.col("entity_start_chars").alias("s"), F.col("entity_end_chars").alias("e"))
    d = packed.select(id_col, F.col("text").alias("_x"), F.explode(z).alias("z")).where("z.t is not null and z.s is not null and z.e is not null")
    d = d.select(id_col, F.col("z.t").alias("type"), F.col("z.s").alias("start"), F.col("z.e").alias("end"), F.expr("substring(_x, z.s + 1, z.e - z.s + 1)").alias("text"), context(F.col("_x"), F.col("z.s"), F.col("z.e"), around).alias("context"))
    return d.where("trim(text) <> ''")


def ranked_places(df: DataFrame, keys: list[str], order: list[str], name: str = "no") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
