"""Shared pieces of the Arrow-batch operators: UTF-8 buffers, rolling hashes, chunking.

Texts arrive as Arrow string columns. Everything here works on the raw UTF-8 buffer with
numpy, so a batch costs a few vector passes instead of a Python loop for each character.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised pass handles at a time (a single longer text is one pass).
CHUNK_BYTES = 1 << 20

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = {"n": 0, "p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (shift, multiply, shift)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: A random-looking 64-bit value for each byte.
BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n:
        with np.errstate(over="ignore"):
            for key, base in (("p", _BASE), ("i", _INVERSE)):
                out = np.full(n + 1, np.uint64(base & _MASK))
                out[0] = 1
                _POWERS[key] = np.multiply.accumulate(out)
        _POWERS["n"] = n
    return _POWERS["p"], _POWERS["i"]


class RollingHash:
    """Hashes of any substring of one buffer in O(1), from one prefix sum modulo 2^64."""

    def __init__(self, data: np.ndarray):
        p, self._inv = _powers(len(data))
        self._sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * p[: len(data)], out=self._sum[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self._sum[end] - self._sum[start]) * self._inv[start])

    def grams(self, n: int) -> np.ndarray:
        """The unmixed hash of the n bytes at each start."""
        m = max(0, len(self._sum) - n)
        return (self._sum[n:] - self._sum[:m]) * self._inv[:m]


def hash_bytes(items: list[bytes]) -> np.ndarray:
    """The hash that RollingHash gives these strings."""
    data = np.frombuffer(b"".join(items), np.uint8)
    ends = np.cumsum([len(x) for x in items], dtype=np.int64)
    return RollingHash(data)(np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges (i, j) of at most `limit` bytes each; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def gather_ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All indices of the ranges start..start+length-1, one after another."""
    length = np.asarray(length, np.int64)
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(np.asarray(start, np.int64) - (np.cumsum(length) - length), length)
    return shift + np.arange(total)


def tokens(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of word bytes that stays in one row, and tokens up to each row's start."""
    word = np.zeros(len(data) + 2, np.bool_)
    word[1:-1] = is_word[data]
    edge = word[1:] != word[:-1]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    glued = inner[word[inner] & word[inner + 1]]  # a row ends and the next begins inside a run
    start = np.flatnonzero(edge & word[1:])
    end = np.flatnonzero(edge & word[:-1])
    if len(glued):
        glued = np.unique(glued)
        start = np.sort(np.concatenate([start, glued]))
        end = np.sort(np.concatenate([end, glued]))
    return start, end, np.searchsorted(start, offsets)


_ASCII = np.arange(256)
#: [^\x20\x09-\x0D]: anything that is not ASCII white space.
NOT_SPACE = ~((_ASCII == 32) | ((_ASCII >= 9) & (_ASCII <= 13)))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z and everything beyond ASCII.
LOWER_ALNUM = ((_ASCII >= 48) & (_ASCII <= 57)) | ((_ASCII >= 97) & (_ASCII <= 122)) | (_ASCII >= 128)
#: A-Z to a-z, other bytes as they are.
LOWER = np.where((_ASCII >= 65) & (_ASCII <= 90), _ASCII + 32, _ASCII).astype(np.uint8)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset, a temporary one, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plotweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/plotweave-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(schema).parquet(path)
    _PATHS[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing will read again."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path is not None:
            at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """df with a bigint column that tells every row from all others.

    It is the hash of the given columns, which any job computes alike, if one aggregate shows that
    no two rows have the same; else rows are numbered, in a written table.
    """
    key = F.xxhash64(*columns)
    if df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return df.withColumn(name, key)
    return written(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def dense(counts: DataFrame, index: str, size: int, *values: str) -> DataFrame:
    """One row, `list`: an array of the structs of these columns (0 where null or missing) for index 0 to size - 1.

    Used as a scalar subquery: `size` numbers whatever the input, evaluated once, and no literal in a plan.
    """
    every = counts.sparkSession.range(size).select(F.col("id").alias("_i")).join(counts, F.col("_i") == F.col(index), "left")
    of = F.struct("_i", *(F.coalesce(v, F.lit(0)).alias(v) for v in values))
    return every.agg(F.transform(F.array_sort(F.collect_list(of)), lambda x: F.struct(*(x[v].alias(v) for v in values))).alias("list"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
