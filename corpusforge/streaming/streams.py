"""The stateless operators on streams, and two stateful ones with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusforge.functions.clean import remove_braces, strip_line_numbers, unix_newlines
from corpusforge.operators.entities import keep_types


def text_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def clean_stream(stream: DataFrame, text: str = "text") -> DataFrame:
    """Cleaning is stateless: the same columns as in a batch."""
    return stream.withColumn(text, remove_braces(strip_line_numbers(unix_newlines(F.col(text)))))


def filter_stream(tokens: DataFrame, keep: tuple[str, ...] = ("Person", "Location")) -> DataFrame:
    return tokens.withColumn("label", keep_types(F.col("label"), keep))


def first_deliveries(stream: DataFrame, keys: list[str], time: str, late: str = "30 days") -> DataFrame:
    """Rows without those delivered again within `late`; state older than the watermark is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, by: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Rows per window and value; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; files and progress are in the given (shared) folders."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
    q.awaitTermination()
    return q
