"""Chunks of a novel for retrieval: with overlap, by paragraphs, by lines.

Where a chunk ends depends on where the one before it did, so each novel is folded in order in
one Arrow-batched group. A group is one novel; its size is that of the longest novel.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.functions.text import estimate_tokens

# Sizes in tokens and characters, sentence ends.
CHUNK_TOKENS, OVERLAP_TOKENS = 2000, 200
CHUNK_CHARS, OVERLAP_CHARS, SEARCH = int(2000 / 0.7), int(200 / 0.7), 500
ENDS = frozenset("。！？；\n…~\"」』")
SCHEMA = "novel_id bigint, chunk_index int, chapter_ids array<bigint>, raw string, start_offset bigint, end_offset bigint"


def split_point(text: str, at: int, search: int = SEARCH, first: int = 0) -> int:
    """After the last sentence end before `at`, and not before `first`, or the first one behind it, or `at` itself."""
    if at >= len(text):
        return len(text)
    back = next((i + 1 for i in range(at - 1, max(first, at - search) - 1, -1) if text[i] in ENDS), None)
    return back or next((i + 1 for i in range(at, min(len(text), at + search)) if text[i] in ENDS), at)


def overlapping(parts: list[tuple[int, str]], size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[tuple[list[int], str, int, int]]:
    """Chapter ids, text, start and end of each chunk of (chapter id, text) parts."""
    out: list[tuple[list[int], str, int, int]] = []
    held, ids, start = "", [], 0
    for chapter, text in parts:
        if not text or not text.strip():
            continue
        held, ids, at = held + text, [*ids, chapter], 0
        while len(held) - at >= size:  # a place in the part moves on, so that what is left is not copied for each chunk
            cut = split_point(held, at + size, first=at)
            out.append((list(ids), held[at:cut], start + at, start + cut))
            at, ids = max(at, cut - overlap), ids[-2:]
        held, start = held[at:], start + at
    if held:
        out.append((ids, held, start, start + len(held)))
    return out


def _finished(rows: DataFrame) -> DataFrame:
    return rows.withColumn("content", F.trim(F.col("raw"))).withColumn("token_count", estimate_tokens(F.col("raw"))).drop("raw")


#: Chunks that are given on together.
MOST_ROWS = 1000
_COLUMNS = ["novel_id", "chunk_index", "chapter_ids", "raw", "start_offset", "end_offset"]


def chunks(chapters: DataFrame) -> DataFrame:
    """novel_id, chunk_index, chapter_ids, start_offset, end_offset, content, token_count from (novel_id, chapter_id, chapter_number, content).

    Where every novel is one chapter, as one count of ids tells, its text is cut where it is read; else
    the chapters of a novel meet in a group.
    """

    def made(novel, parts) -> list[tuple]:
        return [(novel, k, ids, text, a, b) for k, (ids, text, a, b) in enumerate(overlapping(parts))]

    def whole(batches):
        for pdf in batches:
            rows = []
            for novel, chapter, text in zip(pdf["novel_id"], pdf["chapter_id"], pdf["content"], strict=True):
                rows += made(novel, [(chapter, text)])
                if len(rows) >= MOST_ROWS:
                    yield pd.DataFrame(rows, columns=_COLUMNS)
                    rows = []
            yield pd.DataFrame(rows, columns=_COLUMNS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["chapter_number", "chapter_id"])
        return pd.DataFrame(made(pdf["novel_id"].iloc[0], list(zip(pdf["chapter_id"], pdf["content"], strict=True))), columns=_COLUMNS)

    source = chapters.select("novel_id", "chapter_id", "chapter_number", "content")
    if source.where("novel_id IS NULL").isEmpty() and source.groupBy("novel_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return _finished(source.select("novel_id", "chapter_id", "content").mapInPandas(whole, SCHEMA))
    return _finished(source.groupBy("novel_id").applyInPandas(run, SCHEMA))


def paragraph_chunks(novels: DataFrame, size: int = CHUNK_CHARS) -> DataFrame:
    """Paragraphs (set apart by blank lines) packed until the next one would not fit; rows of a text fold independently."""

    def run(batches):
        for pdf in batches:
            rows = []
            for novel, text in zip(pdf["novel_id"], pdf["content"], strict=True):
                held, offset, n = "", 0, 0
                for part in [p for p in re.split(r"\n\s*\n", text or "") if p.strip()] + [None]:
                    if held and (part is None or len(held) + len(part) > size):
                        body = held.strip()
                        rows.append((novel, n, [], body, offset - len(body), offset))
                        held, n = "", n + 1
                    if part is not None:
                        held, offset = held + part + "\n\n", offset + len(part) + 2
            yield pd.DataFrame(rows, columns=["novel_id", "chunk_index", "chapter_ids", "raw", "start_offset", "end_offset"])

    return _finished(novels.select("novel_id", "content").mapInPandas(run, SCHEMA))


def line_chunks(lines: DataFrame, most: int = CHUNK_TOKENS) -> DataFrame:
    """Lines in order, a chunk closed when the estimate of its lines reaches `most` tokens.

    lines: (novel_id, line_no, line, offset). Token estimates are made natively; only the
    closing of chunks is a fold over (line, tokens).
    """
    costed = lines.withColumn("cost", estimate_tokens(F.concat("line", F.lit("\n"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_no")
        rows, held, start, end, total = [], [], None, 0, 0
        for line, offset, cost in zip(pdf["line"], pdf["offset"], pdf["cost"], strict=True):
            start = offset if start is None else start
            held.append(line + "\n")
            end, total = offset + len(line) + 1, total + cost
            if total >= most:
                rows.append((start, end, "".join(held)))
                held, start, total = [], None, 0
        if held:
            rows.append((start, end, "".join(held)))
        novel = pdf["novel_id"].iloc[0]
        return pd.DataFrame([(novel, k, [], text, a, b) for k, (a, b, text) in enumerate(rows)], columns=["novel_id", "chunk_index", "chapter_ids", "raw", "start_offset", "end_offset"])

    return _finished(costed.groupBy("novel_id").applyInPandas(run, SCHEMA))


def by_chapters(made: DataFrame, first: int, last: int) -> DataFrame:
    """Chunks that hold a chapter of the range."""
    return made.where(F.exists("chapter_ids", lambda x: x.between(first, last))).orderBy("novel_id", "chunk_index")


def overlaps(chapter: Column, ids: Column) -> Column:
    return F.array_contains(ids, chapter)


def report(made: DataFrame) -> DataFrame:
    """Chunks, tokens, distinct chapters and estimated MB of all chunks."""
    chapters = made.select(F.explode("chapter_ids").alias("id")).agg(F.count_distinct("id").alias("chapters"))
    return made.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.coalesce(F.sum("token_count"), F.lit(0)).cast("bigint").alias("total_tokens"),
        F.coalesce(F.avg("token_count"), F.lit(0.0)).alias("avg_tokens"),
        F.floor(F.coalesce(F.sum(F.length("content")), F.lit(0)) * 2 / 1048576).alias("approx_mb"),
    ).join(chapters, F.lit(True)).select("chunks", "total_tokens", "avg_tokens", "chapters", "approx_mb")  # one row by one row


def throughput(chars: Column, chunks_: Column, millis: Column) -> tuple[Column, Column]:
    """Characters and chunks a second; 0 for no time."""
    rate = lambda x: F.when(millis > 0, x * 1000.0 / millis).otherwise(F.lit(0.0))
    return rate(chars), rate(chunks_)
