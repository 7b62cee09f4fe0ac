"""Text sources: uploads of unknown encoding, lines, hash embeddings, tables with JSON lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sample size and limits of the encoding scores; embedding size and generator.
SAMPLE, REPLACED, CONTROLS = 2000, 0.01, 10
DIMENSIONS, MULTIPLIER, INCREMENT, STEP = 1536, 6364136223846793005, 1442695040888963407, 0.05


def score(text: str) -> tuple[float, float, int, bool]:
    """Share of ideographs, share of Latin-1 letters, replacement characters, and whether the decoding can be right."""
    part = text[:SAMPLE]
    if not part:
        return 0.0, 0.0, 0, True
    codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
    between = lambda a, b: (codes >= a) & (codes <= b)
    ideographs = between(0x4E00, 0x9FFF) | between(0x3400, 0x4DBF) | between(0x20000, 0x2A6DF) | between(0xF900, 0xFAFF)
    replaced = int((codes == 0xFFFD).sum())
    controls = int(((codes < 0x20) & ~np.isin(codes, [9, 10, 13])).sum())
    return float(ideographs.mean()), float(between(0xC0, 0xFF).mean()), replaced, replaced < len(codes) * REPLACED and controls < CONTROLS


#: Bytes that the first `SAMPLE` characters of a file have at most: four of GB18030, each of which a double encoding makes two.
HEAD = 8 * SAMPLE
DOUBLED = "doubled"


def _twice(plain: str) -> bool:
    """Whether a text is bytes of GB18030 that were taken for Latin-1: those beyond ASCII are mostly side by side, and read as Chinese.

    However short the text is and whatever stands between its characters.
    """
    part = plain[:SAMPLE]
    codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
    beyond = codes >= 0x80
    if not beyond.any() or codes.max() > 0xFF:
        return False
    beside = np.r_[False, beyond[:-1]] | np.r_[beyond[1:], False]
    share, _, replaced, _ = score(part.encode("latin-1").decode("gb18030", "replace"))
    return 2 * (beyond & beside).sum() > beyond.sum() and share > 0.10 and replaced <= max(1, len(part) * REPLACED)


def encoding(head: bytes) -> str:
    """utf-8 if the beginning reads as Chinese, else doubled (GB18030 that was taken for Latin-1 and written as UTF-8), gb18030 or gbk, else utf-8.

    Bytes that were encoded twice read as rare ideographs of GB18030, so they are told before it.
    """
    plain = head.decode("utf-8", "replace")
    cjk, latin, replaced, valid = score(plain)
    if valid and cjk > 0.05:
        return "utf-8"
    if _twice(plain):
        return DOUBLED
    for name in ("gb18030", "gbk"):
        share, _, _, ok = score(head.decode(name, "replace"))
        if ok and share > 0.10:
            return name
    if cjk < 0.02 and latin > 0.30 and not replaced and score(in_encoding(head, DOUBLED))[0] > 0.10:
        return DOUBLED
    return "utf-8"


def in_encoding(raw: bytes, name: str) -> str:
    if name == DOUBLED:
        return raw.decode("utf-8", "replace").encode("latin-1", "replace").decode("gb18030", "replace")
    return raw.decode(name, "replace")


def decode(data: bytes | None) -> str | None:
    """A whole file in the encoding that its beginning tells."""
    return None if data is None else in_encoding(data, encoding(data[:HEAD]))


@F.pandas_udf(T.StringType())
def decoded(data: pd.Series) -> pd.Series:
    return data.map(decode)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """file_name, file_size, content of the files of a folder."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("file_size"), decoded("content").alias("content"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def novels(files: DataFrame) -> DataFrame:
    """Uploads as novels, titled by file name; empty ones are errors, over 10 million characters a warning."""
    n = F.length("content")
    status = F.when(F.trim(F.coalesce("content", F.lit(""))) == "", F.lit("ERROR")).otherwise(F.lit("UPLOADED"))
    return files.select(F.regexp_replace("file_name", r"\.[^.]*$", "").alias("title"), "file_name", "file_size", "content", n.alias("total_chars"), status.alias("status"), (n > 10_000_000).alias("very_long"))


def hash_embedding(text: str | None, size: int = DIMENSIONS) -> list[float]:
    """Each character, with its place, adds to one of `size` dimensions; unit length."""
    codes = np.frombuffer((text or "").lower().strip().encode("utf-16-le"), np.uint16).astype(np.uint64)
    seed = codes << np.uint64(16) | (np.arange(len(codes), dtype=np.uint64) & np.uint64(0xFFFF))
    for _ in range(2):
        seed = seed * np.uint64(MULTIPLIER) + np.uint64(INCREMENT)
    at = (seed & np.uint64(0x7FFFFFFFFFFFFFFF)) % np.uint64(size)
    out = np.zeros(size, np.float32)
    np.add.at(out, at.astype(np.int64), np.float32(STEP))
    norm = float(np.sqrt(np.square(out.astype(np.float64)).sum()))
    return (out * np.float32(1 / norm) if norm else out).tolist()


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embedded(text: pd.Series) -> pd.Series:
    return text.map(hash_embedding)


def json_list(column: Column, element: str = "string") -> Column:
    """A JSON list at rest; null, blank and the text null read as an empty list."""
    kind = f"array<{element}>"
    return F.coalesce(F.from_json(F.nullif(F.trim(column), F.lit("")), kind), F.array().cast(kind))


def json_text(column: Column) -> Column:
    return F.to_json(F.coalesce(column, F.array()))
