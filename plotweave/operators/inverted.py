"""A keyword index that is kept: postings and terms, partitioned by the hash of the token.

`build` counts the tokens of each document where it is read, and deals (token, document, count) out
by token hash; a frequent token's postings are spread over several files. A search knows the buckets
of its few tokens, so Spark lists and reads only their files, and finds their rows by the statistics
of sorted row groups. No text is split again, and nothing but those postings is shuffled.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotweave.functions.text import tokens
from plotweave.sources.shared import folder, fresh_path

BUCKETS, SPREAD = 64, 8
#: Bytes of text whose tokens a task holds at a time.
SLICE = 1 << 20
# Separators of keyword tokens.
_SEPARATORS = "[ \t\n\x0b\f\r，,。.!！?？;；:：、]+"


def _counts(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row number, token and count of each distinct token of two characters or more of each text."""
    split = pc.split_pattern_regex(texts.fill_null("").cast(pa.large_string()), _SEPARATORS)
    row, words = pc.list_parent_indices(split), pc.list_flatten(split)
    long = pc.greater_equal(pc.utf8_length(words), 2)
    row, words = row.filter(long).to_numpy(), words.filter(long).dictionary_encode()
    if not len(row):
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64)
    n = len(words.dictionary)
    both, count = np.unique(row.astype(np.int64) * n + words.indices.to_numpy(), return_counts=True)
    return both // n, words.dictionary.take(pa.array(both % n)).cast(pa.string()), count


def postings(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """token, doc, tf of each row of docs, counted in the scan."""
    slim = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("token", T.StringType()), T.StructField("doc", slim.schema["doc"].dataType), T.StructField("tf", T.LongType())])

    def run(batches):
        for batch in batches:
            rows = max(1, int(batch.num_rows * SLICE / max(1, batch.nbytes)))
            for part in (batch.slice(i, rows) for i in range(0, batch.num_rows, rows)):
                row, token, count = _counts(part.column("text"))
                yield pa.RecordBatch.from_arrays([token, part.column("doc").take(pa.array(row)), pa.array(count, pa.int64())], schema.names)

    return slim.mapInArrow(run, schema)


@dataclass
class Index:
    """A kept index; `path` holds postings/bucket=..., terms/bucket=... and stats."""

    spark: SparkSession
    path: str

    def _read(self, table: str) -> DataFrame:
        """A table of the index; one of no rows has no files, so its columns are told here."""
        if table == "stats":
            return self.spark.read.parquet(f"{self.path}/stats")
        doc = self._read("stats").schema["doc"].dataType.simpleString()
        columns = {"terms": "token string, df bigint, bucket int", "postings": f"token string, doc {doc}, tf bigint, bucket int"}
        return self.spark.read.schema(columns[table]).parquet(f"{self.path}/{table}")

    def _asked(self, table: str, wanted: list[str]) -> DataFrame:
        """Rows of these tokens, from their buckets alone."""
        if not wanted:
            return self._read(table).where("false")
        buckets = sorted({r[0] for r in self.spark.createDataFrame([(w,) for w in wanted], "token string").select(_bucket(F.col("token"))).collect()})
        return self._read(table).where(F.col("bucket").isin(buckets) & F.col("token").isin(wanted))

    def documents(self) -> int:
        """How many documents have any text."""
        return self._read("stats").first()["documents"]

    def stats(self) -> DataFrame:
        """Distinct tokens, indexed documents, mean postings of a token."""
        per = self._read("terms").agg(F.count(F.lit(1)).alias("unique_tokens"), F.coalesce(F.avg("df"), F.lit(0.0)).alias("avg_postings"))
        return per.select("unique_tokens", F.lit(self.documents()).cast("bigint").alias("total_docs"), "avg_postings")

    def scores(self, query: str) -> DataFrame:
        """doc and score: sum over the query's tokens of tf * ln(1 + (N - df + 0.5) / (df + 0.5)); a repeated token adds again."""
        told = query_tokens(self.spark, query)
        wanted = sorted(set(told))
        times = {w: told.count(w) for w in wanted}
        n = self.documents()
        df = {r.token: r.df for r in self._asked("terms", wanted).select("token", "df").collect()}  # a row a token of the query
        weight = self.spark.createDataFrame([(w, times[w], df[w]) for w in df], "token string, times int, df bigint")
        weight = weight.select("token", (F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("times")).alias("weight"))
        found = self._asked("postings", sorted(df)).select("token", "doc", "tf").join(F.broadcast(weight), "token")
        return found.groupBy("doc").agg(F.sum(F.col("tf") * F.col("weight")).alias("score"))


def _bucket(token) -> F.Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int").alias("bucket")


def query_tokens(spark: SparkSession, query: str) -> list[str]:
    return spark.range(1).select(tokens(F.lit(query)).alias("t")).first()["t"]


def build(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text") -> Index:
    """Counts the documents (one row each) and keeps the index at path."""
    spark = docs.sparkSession
    spread = postings(docs, doc, text).withColumn("bucket", _bucket(F.col("token"))).withColumn("_s", F.pmod(F.xxhash64("doc"), F.lit(SPREAD)))
    spread = spread.repartition("bucket", "_s").sortWithinPartitions("bucket", "token").drop("_s")
    spread.write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/postings")
    written = spark.read.schema("token string, bucket int").parquet(f"{path}/postings")
    terms = written.groupBy("bucket", "token").agg(F.count(F.lit(1)).alias("df"))
    terms.repartition("bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/terms")
    # The row that says that the index is whole is written last.
    docs.where(F.trim(F.col(text)) != "").agg(F.count(F.lit(1)).alias("documents"), F.max(F.when(F.lit(False), F.col(doc))).alias("doc")).write.mode("overwrite").parquet(f"{path}/stats")
    return Index(spark, path)


def kept(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> Index:
    """The index of documents that come from files, in the shared folder: built once, then opened.

    It is told by the plan of `docs` and by the paths, sizes and times of its files, so other rows,
    or files that have changed, have another index. Rows from elsewhere are indexed anew each time.
    """
    spark = docs.sparkSession
    name = _fingerprint(docs, doc, text)
    if name is None:
        return build(docs, fresh_path(spark, "index"), doc, text)
    path = f"{folder(spark)}/plotweave-index-{name}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/stats/_SUCCESS")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return Index(spark, path)
    return build(docs, path, doc, text)


def _fingerprint(docs: DataFrame, *more: str) -> str | None:
    files = sorted(docs.inputFiles())
    if not files:
        return None
    spark = docs.sparkSession
    conf, told = spark._jsc.hadoopConfiguration(), hashlib.sha256(f"{docs.semanticHash()}|{'|'.join(more)}\n".encode())
    for name in files:
        at = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = at.getFileSystem(conf).getFileStatus(at)
        told.update(f"{name}|{status.getLen()}|{status.getModificationTime()}\n".encode())
    return told.hexdigest()[:32]
