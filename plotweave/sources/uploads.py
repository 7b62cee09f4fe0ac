"""Lines of uploaded files of unknown encoding, read in byte ranges.

A line feed is the same byte in UTF-8, GBK and GB18030 and part of no other character, so Spark's text
source may cut files at any byte and still give whole lines, as raw bytes, from any store. The encoding
is told from the beginning of a file; lines are decoded by that of their file and numbered by
counts of the ranges before theirs, so a file of any size has no task of its own.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotweave.sources.shared import stored
from plotweave.sources.text import HEAD, encoding, in_encoding

@F.pandas_udf(T.StringType())
def _encoding(head: pd.Series) -> pd.Series:
    return pd.Series([encoding(bytes(x or b"")) for x in head], dtype=object)


@F.pandas_udf(T.StringType())
def decoded_as(raw: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([in_encoding(bytes(x), n) for x, n in zip(raw, name, strict=True)], dtype=object)


def _first(lines: DataFrame) -> DataFrame:
    """file and encoding; lines: file, line_no, raw."""
    # A line has a byte at least, its line feed; so this many lines hold the head.
    some = lines.where(F.col("line_no") < HEAD).select("file", "line_no", F.substring("raw", 1, HEAD).alias("raw"))
    till = F.sum(F.octet_length("raw") + 1).over(Window.partitionBy("file").orderBy("line_no"))
    some = some.withColumn("till", till).where(F.col("till") - F.octet_length("raw") - 1 < HEAD)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.hex("raw").alias("raw")))), lambda x: x["raw"]), "0A")
    return some.groupBy("file").agg(joined.alias("head")).select("file", _encoding(F.unhex(F.substring("head", 1, 2 * HEAD))).alias("encoding"))


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, encoding, line_no (from 0) and line of text files in any of the encodings, split into byte ranges (spark.sql.files.maxPartitionBytes)."""
    # The raw bytes of a line are a string to the source; they are never decoded as one.
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    kept = stored(raw.withColumn("m", F.monotonically_increasing_id()), "upload-lines")
    blocks = kept.groupBy("file", "block").agg(F.min("m").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")  # a row a byte range
    placed = kept.join(blocks.select("file", "block", (before - F.col("first")).alias("shift")), ["file", "block"]).select("file", (F.col("shift") + F.col("m")).alias("line_no"), "raw")
    return placed.join(_first(placed), "file").select("file", "encoding", "line_no", decoded_as("raw", "encoding").alias("line"))
