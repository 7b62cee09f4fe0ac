"""Retrieval: keyword index and scores, vector and hybrid top-k, context within a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions.text import cosine, estimate_tokens
from plotweave.operators.inverted import Index, kept

RRF_K, LEAST = 60, 50
#: Ratio of tokens to characters when a chunk is cut to a budget.
TOKENS_PER_CHAR, CUT = 0.7, "\n..."


def keyword_scores(index: Index, query: str) -> DataFrame:
    """doc and score of each document that has a token of the query, from the kept index (see inverted)."""
    return index.scores(query)


def top(scores: DataFrame, k: int, id_column: str = "doc") -> DataFrame:
    """The k best, ties by id; no total sort."""
    return scores.orderBy(F.desc(F.round("score", 9)), id_column).limit(k)


def vector_scores(vectors: DataFrame, query: DataFrame, least: float, vec: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """id and cosine with the query (one row with column `query`), of those at or above `least`."""
    each = vectors.crossJoin(F.broadcast(query.select("query").limit(1)))
    return each.select(F.col(id_column).alias("doc"), cosine(F.col(vec), F.col("query")).alias("score")).where(F.col("score") >= least)


def fused(vector_top: DataFrame, keyword_top: DataFrame, k: int, vector_weight: float = 0.5) -> DataFrame:
    """Weighted reciprocal ranks of two top lists; each list is short, its rank needs one task."""
    order = Window.orderBy(F.desc(F.round("score", 9)), "doc")
    rank = lambda df, name: df.select("doc", F.row_number().over(order).alias(name))
    both = rank(vector_top, "v").join(rank(keyword_top, "w"), "doc", "full")
    part = lambda c, weight: F.coalesce(F.lit(weight) / (RRF_K + F.col(c)), F.lit(0.0))
    return top(both.select("doc", (part("v", vector_weight) + part("w", 1 - vector_weight)).alias("score")), k)


def hybrid(vectors: DataFrame, query: DataFrame, index: Index, text_query: str, k: int, least: float = 0.0, vector_weight: float = 0.6) -> DataFrame:
    """Top k of both lists fused; each gives twice as many, 50 at least."""
    most = max(2 * k, LEAST)
    return fused(top(vector_scores(vectors, query, least), most), top(keyword_scores(index, text_query), most), k, vector_weight)


def budgeted(rows: DataFrame, budget: int, order: str = "doc", text: str = "text", cost: str | None = None) -> DataFrame:
    """Rows in order while their token estimates fit; a first one that is too long is cut to fit.

    rows are the hits of one query, so the running sum is over a top-k list.
    """
    w = Window.orderBy(order)
    each = rows.withColumn("tokens", F.col(cost) if cost else estimate_tokens(F.col(text)))
    each = each.withColumn("running", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("nth", F.row_number().over(w))
    chars = int(budget / TOKENS_PER_CHAR)
    cut = (F.col("nth") == 1) & (F.col("tokens") > budget)
    short = F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit(CUT))).otherwise(F.col(text))
    return each.where((F.col("running") <= budget) | cut).withColumn(text, F.when(cut, short).otherwise(F.col(text))).drop("nth")


def first_within(rows: DataFrame, budget: int, order: str = "doc", text: str = "text", step: int = 1000) -> DataFrame:
    """The first rows, enough of them to use up the budget: a top-k whose k grows until it is, so no task sorts them all."""
    k = step
    while True:
        some = rows.orderBy(order).limit(k)
        n, cost = some.select(estimate_tokens(F.col(text)).alias("tokens")).agg(F.count(F.lit(1)), F.sum("tokens")).first()
        if n < k or (cost or 0) > budget:
            return some
        k *= 4


def context(rows: DataFrame, order: str = "doc", text: str = "text") -> DataFrame:
    """One row: the texts in order, a blank line between them."""
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n\n").alias("context"), F.count(F.lit(1)).alias("parts"))


def keyword_context(docs: DataFrame, query: str, k: int, budget: int, doc: str = "doc_id", text: str = "text", index: Index | None = None) -> DataFrame:
    """The flagship: best documents for the words of a query, in document order, within a token budget."""
    best = top(keyword_scores(index or kept(docs, doc, text), query), k)
    hits = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).join(F.broadcast(best), "doc")  # k rows
    return budgeted(hits, budget).select("doc", F.round("score", 6).alias("score"), "tokens", "running")


#: Top k, least similarity and vector weight of the ways to ask for context.
MODES = {"normal": (25, 0.35, 1.0), "hybrid": (50, 0.25, 0.6), "broad": (50, 0.20, 1.0)}


def chunk_context(chunks: DataFrame, vectors: DataFrame, query: DataFrame, budget: int, mode: str = "normal", text_query: str = "", index: Index | None = None) -> DataFrame:
    """Chunks (doc, text) found by vectors (vec_id = doc), in order within the budget; nothing found: the first chunks.

    The search runs once: its k hits are a small local table, which is broadcast.
    """
    k, least, weight = MODES[mode]
    if mode == "hybrid":
        best = hybrid(vectors, query, index or kept(chunks, "doc"), text_query, k, least, weight)
    else:
        best = top(vector_scores(vectors, query, least), k)
    ids = chunks.sparkSession.createDataFrame(best.select("doc").collect(), best.select("doc").schema)  # k of them
    hits = chunks.join(F.broadcast(ids), "doc")
    none = hits.select("doc").isEmpty()  # of the chunks it reads no text
    return budgeted(first_within(chunks, budget) if none else hits, budget)
