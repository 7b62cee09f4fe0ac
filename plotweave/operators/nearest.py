"""The best vectors for each of many query vectors: blocked matrix products with partial top lists.

Vectors are dealt into blocks, and so are queries; each pair of blocks is one product in a task, which
keeps the best k of each query, and a query's lists are merged. Queries that together are small
(`MOST_BYTES`, counted first) are broadcast instead, and vectors are read where they are. The result is
exact: blocks only tell where a product is made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of query vectors that may be broadcast, and rows of a block.
MOST_BYTES, BLOCK_ROWS = 8 << 20, 4096


def matrices(column: pa.Array):
    """Row numbers and unit vectors, in double precision, for each length of vectors in a list column.

    Null vectors and those with a null, or without a length of their own (zero), have no rows.
    """
    at = column.offsets.to_numpy()
    values = column.values.cast(pa.float64())
    missing = np.cumsum(np.concatenate([[0], values.is_null().to_numpy(zero_copy_only=False)]))
    data = values.fill_null(0).to_numpy(zero_copy_only=False)
    size = np.diff(at)
    whole = column.is_valid().to_numpy(zero_copy_only=False) & (missing[at[1:]] == missing[at[:-1]]) & (size > 0)
    for n in np.unique(size[whole]):
        rows = np.flatnonzero(whole & (size == n))
        x = data[at[rows][:, None] + np.arange(n)]
        norm = np.sqrt((x * x).sum(axis=1))
        ok = np.isfinite(norm) & (norm > 0)
        yield int(n), rows[ok], x[ok] / norm[ok][:, None]


def _best(ids: pa.Array, unit: np.ndarray, asked: np.ndarray, k: int, least: float):
    """For each query (row of asked): places of the k best of unit at or above least, and their scores; equal scores go to smaller ids."""
    order = ids.to_numpy(zero_copy_only=False).argsort(kind="stable")
    score = asked @ unit[order].T
    take = np.argsort(-np.round(score, 9), axis=1, kind="stable")[:, :k]
    best = np.take_along_axis(score, take, 1)
    query, place = np.nonzero(best >= least)
    return query, order[take[query, place]], best[query, place]


def _found(queries: list[tuple], batch_ids: pa.Array, batch_vectors: pa.Array, k: int, least: float):
    """Rows (query id, id, score) of the partial lists; queries: (length, ids, unit vectors)."""
    out = []
    for n, rows, unit in matrices(batch_vectors):
        ids = batch_ids.take(pa.array(rows))
        for m, query_ids, asked in queries:
            if m == n and len(rows):
                for i in range(0, len(asked), 256):
                    query, place, score = _best(ids, unit, asked[i : i + 256], k, least)
                    out.append((query_ids.take(pa.array(query + i)), ids.take(pa.array(place)), pa.array(score)))
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int, least: float = 0.0, most_bytes: int = MOST_BYTES, block_rows: int = BLOCK_ROWS, vec: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """query_id, doc, score and rank of the k vectors of the highest cosine, at or above `least`, for each query.

    queries: query_id and query (a vector). Ties, of scores equal to nine places, go to smaller ids.
    Vectors without a direction, and those of another length than the query, are never found; nulls of ids are left out.
    """
    data = vectors.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("doc"), F.col(vec).alias("v"))
    asked = queries.where("query_id IS NOT NULL").select("query_id", F.col("query").alias("v"))
    schema = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("doc", data.schema["doc"].dataType), T.StructField("score", T.DoubleType())])
    n, numbers = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    if 8 * (n + numbers) <= most_bytes:
        table = asked.toArrow()  # within most_bytes
        kept = [(m, table["query_id"].combine_chunks().take(pa.array(rows)), unit) for m, rows, unit in matrices(table["v"].combine_chunks())] if n else []

        def run(batches):
            for batch in batches:
                for q, d, s in _found(kept, batch.column("doc"), batch.column("v"), k, least):
                    yield pa.RecordBatch.from_arrays([q, d, s], schema.names)

        partial = data.mapInArrow(run, schema)
    else:
        total = data.count()
        blocks = lambda rows: max(1, -(-rows // block_rows))
        place = lambda df, c, own, other, mine, theirs: df.withColumn(mine, F.pmod(F.xxhash64(c), F.lit(own)).cast("int")).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
        left = place(data, "doc", blocks(total), blocks(n), "_d", "_q")
        right = place(asked, "query_id", blocks(n), blocks(total), "_q", "_d")

        def joined(x: pa.Table, y: pa.Table) -> pa.Table:
            ids = y["query_id"].combine_chunks()
            here = [(m, ids.take(pa.array(rows)), unit) for m, rows, unit in matrices(y["v"].combine_chunks())] if len(ids) else []
            found = _found(here, x["doc"].combine_chunks(), x["v"].combine_chunks(), k, least) if len(x) else []
            return pa.Table.from_batches([pa.RecordBatch.from_arrays(list(f), schema.names) for f in found]) if found else pa.table({c: pa.array([], t) for c, t in zip(schema.names, (x["doc"].type if not len(ids) else ids.type, x["doc"].type, pa.float64()), strict=True)})

        partial = left.groupBy("_d", "_q").cogroup(right.groupBy("_d", "_q")).applyInArrow(joined, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _lengths(column: pa.Array) -> np.ndarray:
    """Numbers of each vector of a list column; -1 for null and empty ones and those with a null."""
    at = column.offsets.to_numpy()
    missing = np.cumsum(np.concatenate([[0], column.values.is_null().to_numpy(zero_copy_only=False)]))
    whole = column.is_valid().to_numpy(zero_copy_only=False) & (missing[at[1:]] == missing[at[:-1]]) & (np.diff(at) > 0)
    return np.where(whole, np.diff(at), -1)


def pairs(vectors: DataFrame, queries: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, doc and score, the cosine in double precision, of each query with all vectors of its label but itself.

    vectors: doc, label, v; queries: query_id, label, v. A label's vectors are dealt into blocks, and so are its
    queries; each pair of blocks is one product in a task. The cosine
    of a vector without a direction is NaN, that of one with a null or of another length null.
    """
    data, asked = (df.where(F.col("label").isNotNull() & F.col(c).isNotNull()) for df, c in ((vectors, "doc"), (queries, "query_id")))
    blocks = lambda df, out: df.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(out))
    counts = blocks(data, "_n").join(blocks(asked, "_m"), "label")
    place = lambda df, c, own, other, mine, theirs: df.join(counts, "label").withColumn(mine, F.pmod(F.xxhash64(c), own).cast("int")).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    left = place(data, "doc", "_n", "_m", "_d", "_q").select("label", "_d", "_q", "doc", "v")
    right = place(asked, "query_id", "_m", "_n", "_q", "_d").select(F.col("label").alias("of"), F.col("_d").alias("of_d"), F.col("_q").alias("of_q"), F.col("query_id").alias("query_id"), F.col("v").alias("asked"))
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("doc", vectors.schema["doc"].dataType), T.StructField("score", T.DoubleType())])

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        docs, ids = x["doc"].combine_chunks(), y["query_id"].combine_chunks()
        score = np.full((len(ids), len(docs)), np.nan)
        if len(docs) and len(ids):
            here = list(matrices(x["v"].combine_chunks()))
            for m, rows, asked_ in matrices(y["asked"].combine_chunks()):
                for n, at, unit in here:
                    if n == m:
                        score[np.ix_(rows, at)] = asked_ @ unit.T
        sizes = [_lengths(c.combine_chunks()) if len(c) else np.empty(0, int) for c in (y["asked"], x["v"])]
        null = (sizes[0][:, None] != sizes[1][None, :]) | (sizes[0] < 0)[:, None]
        query, doc = np.nonzero(ids.to_numpy(zero_copy_only=False)[:, None] != docs.to_numpy(zero_copy_only=False)[None, :])
        return pa.table({"query_id": ids.take(pa.array(query)), "doc": docs.take(pa.array(doc)), "score": pa.array(score[query, doc], mask=null[query, doc])})

    return left.groupBy("label", "_d", "_q").cogroup(right.groupBy("of", "of_d", "of_q")).applyInArrow(run, schema)
