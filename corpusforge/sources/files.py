"""Whole texts, JSON, CSV, Parquet and reports."""

from __future__ import annotations

import html
import json
import shutil
import tempfile
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corpusforge.functions.clean import unix_newlines


def read_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, text): one row per file."""
    d = spark.read.text(path, wholetext=True, pathGlobFilter=glob)
    return d.select(F.col("_metadata.file_name").alias("file"), unix_newlines(F.col("value")).alias("text"))


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that exist; none of them is an error."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = [p for p in paths if jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p))]
    if not found:
        raise FileNotFoundError(f"none of {len(paths)} paths exists")
    return found


def read_json_any(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """JSON that is one array or one object per line, told apart by the first character that is not blank."""
    head = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    many = bool(head) and head[0][0].lstrip().startswith("[")
    r = spark.read.option("multiLine", many)
    return (r.schema(schema) if schema else r).json(path)


def merge_json(spark: SparkSession, paths: list[str], schema: str | T.StructType) -> DataFrame:
    """Arrays extend the result, objects are added to it."""
    out = None
    for p in existing(spark, paths):
        d = read_json_any(spark, p, schema)
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (r.schema(schema) if schema else r).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays, maps and structs are written as JSON."""
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def union_sources(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; columns that one lacks are null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_json_array(df: DataFrame, path: str, order: list[str]) -> None:
    """One JSON array of objects, indented by two, characters as they are, nulls kept; written by one task row by row."""
    rows = df.orderBy(*order).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))

    def lines(batches):
        last = None
        for b in batches:
            out = []
            for v in b.column(0).to_pylist():
                out.append("[" if last is None else last + ",")
                last = "\n".join("  " + x for x in json.dumps(json.loads(v), ensure_ascii=False, indent=2).split("\n"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array([last, "]"], pa.string())], names=["value"])

    if df.isEmpty():  # no task would write the brackets
        df.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
    else:
        rows.coalesce(1).mapInArrow(lines, "value string").write.mode("overwrite").text(path)


MANIFEST_ROWS = 10_000  # the most rows of a manifest: parameters and sizes, not data


def manifest(df: DataFrame, **settings) -> str:
    """JSON of an experiment: settings, time and the rows of a small summary. More than MANIFEST_ROWS rows are an error."""
    got = df.limit(MANIFEST_ROWS + 1).collect()
    if len(got) > MANIFEST_ROWS:
        raise ValueError(f"a manifest holds {MANIFEST_ROWS} rows at most; write the table itself")
    rows = [r.asDict(True) for r in got]
    return json.dumps({"created": datetime.now(timezone.utc).isoformat(), **settings, "experiments": rows}, ensure_ascii=False, indent=2, default=str)


def write_html_report(df: DataFrame, path: str, title: str) -> None:
    """A page with a table of df and, in the element `data`, its rows as a JSON array for scripts; written row by row."""
    page = df.select(*df.columns, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("_json"))
    with open(path, "w", encoding="utf-8") as f, tempfile.TemporaryFile("w+", encoding="utf-8") as data:
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        f.write(f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>\n")
        for k, r in enumerate(page.toLocalIterator()):
            f.write("<tr>" + "".join(f"<td>{html.escape(str(x))}</td>" for x in r[:-1]) + "</tr>\n")
            data.write((",\n" if k else "") + r[-1].replace("</", "<\\/"))
        f.write('</table>\n<script type="application/json" id="data">[')
        data.seek(0)
        shutil.copyfileobj(data, f)
        f.write("]</script>\n")
