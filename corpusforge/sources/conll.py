"""Token files with blank lines between sentences: reading and writing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpusforge.functions.clean import strip_blank, unix_newlines

BLOCK = 65_536  # lines whose running count is taken by one task


def file_lines(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(file, ln, line) of all files that match, line ends made alike."""
    whole = spark.read.text(path, wholetext=True, pathGlobFilter=glob).select(F.col("_metadata.file_name").alias("file"), unix_newlines(F.col("value")).alias("t"))
    return whole.select("file", F.posexplode(F.split("t", "\n")).alias("ln", "line"))


def running_count(df: DataFrame, part: list[str], order: str, flag: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Add the number of flagged rows up to and with each row of its part.

    Rows are counted in blocks of the order column first, so that one part with most of the rows is spread over tasks.
    """
    d = df.withColumn("_f", F.coalesce(flag.cast("long"), F.lit(0).cast("long"))).withColumn("_b", F.floor(F.col(order) / block))
    sums = d.groupBy(*part, "_b").agg(F.sum("_f").alias("_s"))
    w = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"_p_{c}") for c in part], F.col("_b").alias("_pb"), F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_before"))
    cond = [d[c].eqNullSafe(sums[f"_p_{c}"]) for c in part] + [d["_b"] == sums["_pb"]]
    inner = Window.partitionBy(*part, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = d.join(sums, cond).withColumn(name, F.col("_before") + F.sum("_f").over(inner))
    return out.drop("_f", "_b", "_pb", "_before", *[f"_p_{c}" for c in part])


def parse_conll(lines: DataFrame, reader: str = "last", file: str = "file", ln: str = "ln", line: str = "line") -> DataFrame:
    """(file, ln, block, token, label) of the token lines of (file, ln, line).

    reader "last": lines are trimmed, a blank line ends a sentence, the label is the last of two or more fields.
    reader "second": only an empty line ends a sentence, the label is the second field.
    reader "strict": as "last", but exactly two fields. Lines with fewer fields are ignored and end no sentence; a null
    line counts as such a line. `block` numbers the stretches between blank lines (gaps are possible; see sentence_ids).
    """
    raw = F.col(line)
    text = raw if reader == "second" else strip_blank(raw)
    d = lines.select(F.col(file).alias("file"), F.col(ln).alias("ln"), text.alias("t"))
    d = running_count(d, ["file"], "ln", F.col("t") == "", "block")
    p = F.split("t", "\t")
    d = d.withColumn("p", p)
    enough = F.size("p") == 2 if reader == "strict" else F.size("p") >= 2
    label = F.element_at("p", 2) if reader == "second" else F.element_at("p", -1)
    return d.where((F.col("t") != "") & enough).select("file", "ln", "block", F.element_at("p", 1).alias("token"), label.alias("label"))


def sentence_ids(parsed: DataFrame) -> DataFrame:
    """parse_conll with sent_id (1, 2, ... over the sentences of a file that have tokens) and tok_id."""
    per = parsed.groupBy("file", "block").agg(F.min("ln").alias("first"))
    ids = running_count(per, ["file"], "first", F.lit(1), "sent_id").select("file", "block", "sent_id")
    w = Window.partitionBy("file", "block").orderBy("ln")
    return parsed.join(ids, ["file", "block"]).withColumn("tok_id", F.row_number().over(w).cast("long")).select("file", "sent_id", "tok_id", "token", "label")


def read_conll(spark: SparkSession, path: str, reader: str = "last", glob: str = "*.txt") -> DataFrame:
    return sentence_ids(parse_conll(file_lines(spark, path, glob), reader))


def sentence_strings(tokens: DataFrame, keys: list[str], sep: str = " ", cols: tuple[str, ...] = ("token",), order: str = "tok_id", name: str = "sentence") -> DataFrame:
    """One row per sentence with its tokens (or token and label) as one string, in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat_ws("\t", *[F.coalesce(F.col(c), F.lit("")) for c in cols]).alias("x"))))
    return tokens.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["x"]), sep).alias(name))


def running_text(lines: DataFrame, file: str = "file", ln: str = "ln", line: str = "line") -> DataFrame:
    """(file, block, text): the first column of every line that is not blank, joined per sentence."""
    d = lines.select(F.col(file).alias("file"), F.col(ln).alias("ln"), strip_blank(F.col(line)).alias("t"))
    d = running_count(d, ["file"], "ln", F.col("t") == "", "block").where("t <> ''")
    return sentence_strings(d.withColumn("token", F.split("t", "\t")[0]), ["file", "block"], " ", order="ln", name="text")


def write_conll(tokens: DataFrame, path: str, keys: list[str], trailing_blank: bool = True) -> None:
    """One text file in sentence order. With trailing_blank a blank line follows every sentence, else it stands between
    two sentences only. The format has one order, so one task writes; rows stream through it."""
    s = sentence_strings(tokens, keys, "\n", ("token", "label"), name="value").orderBy(*keys).select("value")

    def lines(batches):
        first = True
        for b in batches:
            out = []
            for v in b.column(0).to_pylist():
                out += [v, ""] if trailing_blank else [v] if first else ["", v]
                first = False
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    s.coalesce(1).mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def tagged_lines(lines: DataFrame) -> DataFrame:
    """(file, ln, block, word, tag, lemma) of three-column tagged files, blank lines between sentences."""
    d = lines.select("file", "ln", strip_blank(F.col("line")).alias("t"))
    d = running_count(d, ["file"], "ln", F.col("t") == "", "block").withColumn("p", F.split("t", "\t")).where(F.size("p") == 3)
    return d.select("file", "ln", "block", *[F.element_at("p", i + 1).alias(c) for i, c in enumerate(("word", "tag", "lemma"))])


