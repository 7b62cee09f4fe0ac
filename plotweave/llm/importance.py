"""Importance resampling towards a target: documents drawn by the ratio of target to raw n-gram buckets.

1. Each task hands its Arrow batches, about `CHUNK` bytes at a time, to a DuckDB connection of its
   own: SQL cuts texts into words, unnests them, windows runs of 1 to 3 words, hashes them with
   zlib's crc32 (a registered function; the hash of a run goes on from that of the run without its
   last word) and counts buckets by document. A text of more than a chunk is cut between words, each
   piece with the two words after it, so that memory is bounded whatever the length.
2. The counts of documents, and the sums of tasks, are written as Parquet in the shared folder.
3. Spark merges the sums to the two bucket models, and weighs each document's counts with the gains.
4. Gumbel noise from a hash of the id makes the highest scores a draw without replacement. Ranks
   are places in a range-partitioned order plus the sizes of the partitions before.

Null and empty texts have no features and weight 0. A null id has the noise of an empty one. Rows of
one id are rows like others, with the same noise; equal scores go to the smaller id (null last), and
rows that are equal in all of that to the larger weight, then to either. An empty table gives none,
and an empty target makes all its buckets equally likely.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotweave.llm.bytekit import LOWER, LOWER_ALNUM, chunks, dropped, tokens, utf8, written

#: Buckets, longest run of words, least words of a document that may be drawn, and the part that is drawn.
BUCKETS, LEAST_WORDS, RATE = 10_000, 20, 5 / 100
#: Bytes of text that one SQL statement gets, and MB that DuckDB may take in a task.
CHUNK, MEMORY_MB = 1 << 20, 192

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: texts: row, text, and how many of its words may begin a run (those after them are another piece's).
_COUNTS = f"""
WITH words AS (SELECT row, own, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM (SELECT row, own, {_WORDS} AS ws FROM texts)),
runs AS (SELECT row, own, i, a, lead(a) OVER p AS b, lead(a, 2) OVER p AS c FROM words WINDOW p AS (PARTITION BY row ORDER BY i)),
one AS (SELECT row, b, c, crc(a, 0::UINTEGER) AS h FROM runs WHERE i <= own),
two AS (SELECT row, h, c, crc(' ' || b, h) AS hh FROM one),
three AS (SELECT row, h, hh, crc(' ' || c, hh) AS hhh FROM two)
SELECT row, bucket, count(*) AS n FROM (SELECT row, unnest([h, hh, hhh]) % $buckets AS bucket FROM three) WHERE bucket IS NOT NULL GROUP BY row, bucket ORDER BY row
"""


def _crc(words: pa.ChunkedArray, start: pa.ChunkedArray) -> pa.Array:
    """crc32 of each text, going on from a given value; on the bytes of the column, without a Python string for each text."""
    words, start = (pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x for x in (words, start))
    data, at = utf8(words)
    data, at, crc32 = bytes(data), at.tolist(), zlib.crc32
    return pa.array([crc32(data[i:j], h) for i, j, h in zip(at, at[1:], start.to_numpy().tolist(), strict=False)], pa.uint32())


def connection():
    """A DuckDB connection for one task: one thread, bounded memory, and crc(text, start)."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB", "temp_directory": ""})
    con.create_function("crc", _crc, ["VARCHAR", "UINTEGER"], "UINTEGER", type="arrow")
    return con


def _pieces(text: bytes, words: int):
    """A long text in pieces of so many words, each with the two words after it."""
    data = LOWER[np.frombuffer(text, np.uint8)]
    start, end, _ = tokens(data, np.array([0, len(data)]), LOWER_ALNUM)
    for k in range(0, len(start), words):
        last = min(k + words + 2, len(start)) - 1
        yield bytes(data[start[k] : end[last]]).decode(), min(words, len(start) - k)


def counted(batches, buckets: int, chunk: int = CHUNK):
    """Slices of the batches (column text) with each row's number of words, buckets and their counts; at last the sums of all buckets."""
    con = connection()
    total = np.zeros(buckets, np.int64)

    def ask(rows, texts, own):
        con.register("texts", pa.table({"row": pa.array(rows, pa.int64()), "text": pa.array(texts, pa.string()), "own": pa.array(own, pa.int64())}))
        got = con.execute(_COUNTS, {"buckets": buckets}).fetchnumpy()
        con.unregister("texts")
        return (np.asarray(got[c], np.int64) for c in ("row", "bucket", "n"))

    for batch in batches:
        column = batch.column("text")
        data, offsets = utf8(column)
        for i, j in chunks(offsets, chunk):
            own = data[offsets[i] : offsets[j]]
            if len(own) > chunk:  # one long text
                sums = np.zeros(buckets, np.int64)
                for text, n in _pieces(bytes(own), max(1, chunk // 16)):
                    _, b, n = ask([0], [text], [n])
                    sums[b] += n
                bucket = np.flatnonzero(sums)
                row, n = np.zeros(len(bucket), np.int64), sums[bucket]
            else:
                row, bucket, n = ask(np.arange(j - i), column.slice(i, j - i), np.full(j - i, 1 << 62))
            total += np.bincount(bucket, n, buckets).astype(np.int64)
            at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (bucket, n)]
            _, _, upto = tokens(LOWER[own], offsets[i : j + 1] - offsets[i], LOWER_ALNUM)
            yield batch.slice(i, j - i), pa.array(np.diff(upto).astype(np.int64)), *lists
    con.close()
    yield None, None, None, total


_TOTAL = T.StructField("total", T.ArrayType(T.LongType()))


def spilled(docs: DataFrame, keep: list[str], buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """The table of counts: `keep`, n_words, buckets and counts of each document; and rows that hold only `total`, the sums of a task."""
    names = [f"k{i}" for i in range(len(keep))]
    given = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(text).cast("string").alias("text"))
    more = [T.StructField("n_words", T.LongType()), T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType())), _TOTAL]
    schema = T.StructType([*(T.StructField(n, given.schema[n].dataType) for n in names), *more])
    arrow = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def run(batches):
        types = None
        for batch, *found in counted(batches, buckets):
            if batch is not None:
                types = [batch.schema.field(n).type for n in names]
                columns = [batch.column(n) for n in names] + found + [pa.nulls(batch.num_rows, arrow[-1])]
            elif types is None:
                return
            else:
                columns = [pa.nulls(1, t) for t in [*types, *arrow[:3]]] + [pa.array([found[-1]], arrow[-1])]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return written(given.mapInArrow(run, schema), "bucket-counts")


def totals(counts: DataFrame) -> DataFrame:
    """bucket and n: the sums of all tasks."""
    return counts.where("total IS NOT NULL").select(F.posexplode("total").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket, in thousandths of a natural logarithm; as many numbers as there are buckets, whatever the input."""
    each = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = each.join(raw.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").fillna(0)
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c, more: (F.col(c) + more).cast("double")
    gain = F.floor(F.lit(1000.0) * F.log(d("t", 1) * d("all_s", buckets) / (d("s", 1) * d("all_t", buckets))))
    return [r[0] for r in both.join(F.broadcast(sums), F.lit(True)).select(gain.cast("bigint"), "bucket").orderBy("bucket").collect()]  # sums is one row


def noise(doc_id: Column, seed: int = 42) -> Column:
    """A Gumbel number for an id, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def weighed(docs: DataFrame, target: DataFrame, keep: list[str], buckets: int = BUCKETS, seed: int = 42, id_column: str = "doc_id") -> DataFrame:
    """`keep` (with the id), n_words, n_features, weight and score of each document."""
    raw, aim = spilled(docs, keep, buckets), spilled(target, [], buckets)
    gain = np.array(gains(totals(raw), totals(aim), buckets), np.int64)
    dropped(aim)
    names = [f"k{i}" for i in range(len(keep))]
    schema = T.StructType([*(raw.schema[n] for n in names), *(T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight"))])

    def run(batches):
        for batch in batches:
            at = batch.column("counts").offsets.to_numpy()
            n, bucket = (batch.column(c).values.to_numpy() for c in ("counts", "buckets"))
            for i, j in chunks(at.astype(np.int64), CHUNK // 4):
                part = batch.slice(i, j - i)
                own = n[at[i] : at[j]].astype(np.int64)
                edges = at[i : j + 1] - at[i]
                sums = [pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[edges])) for x in (own, own * gain[bucket[at[i] : at[j]]])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), part.column("n_words"), *sums], schema.names)

    out = raw.where("total IS NULL").select(*names, "n_words", "buckets", "counts").mapInArrow(run, schema)
    key = names[keep.index(id_column)]
    out = out.withColumn("score", F.col("weight") + noise(F.col(key), seed))
    return out.toDF(*keep, *out.columns[len(keep) :])


def placed(rows: DataFrame, *order: Column) -> tuple[DataFrame, DataFrame]:
    """The rows in a range-partitioned order, in a table with `_m`, and what to add to the low bits of `_m` for a row's place (part, before): no task sorts or numbers them all."""
    out = written(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "ordered")
    parts = out.groupBy(F.shiftright("_m", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row for each task that wrote
    return out, parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))


def resampled(docs: DataFrame, target: DataFrame, rate: float = RATE, least_words: int = LEAST_WORDS, keep: list[str] | None = None, buckets: int = BUCKETS, seed: int = 42, id_column: str = "doc_id") -> DataFrame:
    """`keep` (by default the id), n_words, n_features, weight, score and rank of every document; a document that is not drawn has no rank.

    With keep=docs.columns the drawn documents are those with a rank, texts and all. Columns of
    the results' names are left out of `keep`.
    """
    results = ("n_words", "n_features", "weight", "score", "rank")
    keep = [c for c in (keep or [id_column]) if c.lower() not in results]
    safe = [f"k{i}" for i in range(len(keep))]
    key = safe[keep.index(id_column)]
    rows = weighed(docs, target, keep, buckets, seed, id_column)
    rows = written(rows.toDF(*safe, *rows.columns[len(keep) :]), "weights")
    short = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    able, before = placed(rows.where(F.col("n_words") >= least_words), F.desc("score"), F.col(key).isNull(), F.col(key), F.desc("weight"))
    most = able.count() * round(rate * 1_000_000) // 1_000_000
    place = F.col("before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = able.withColumn("part", F.shiftright("_m", 33)).join(F.broadcast(before), "part").withColumn("rank", F.when(place <= most, place)).drop("_m", "part", "before")
    out = drawn.unionByName(short)
    return out.toDF(*keep, *out.columns[len(keep) :])


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 byte by byte from a table that SQL computes.
ORACLE = r"""
WITH RECURSIVE steps AS (
    SELECT range AS i, range AS c, 0 AS k FROM range(256)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
texts AS (
    SELECT doc_id AS id, false AS aim, text FROM documents UNION ALL SELECT item_id, true, text FROM benchmark
), words AS (
    SELECT id, aim, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts
), runs AS (
    SELECT id, aim, array_to_string(ws[i : i + n - 1], ' ') AS f
    FROM (SELECT id, aim, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM words, (VALUES (1), (2), (3)) AS v(n) WHERE len(ws) >= n)
), counts AS (SELECT id, aim, f, count(*) AS n FROM runs GROUP BY ALL),
hashes AS (
    SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(f) + 1), lambda i: ('0x' || substr(hex(encode(f)), (2 * i - 1)::BIGINT, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT f FROM counts), crc
), held AS (SELECT id, aim, bucket, sum(n) AS n FROM counts JOIN hashes USING (f) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (NOT aim), 0) AS s, coalesce(sum(n) FILTER (aim), 0) AS t FROM held GROUP BY bucket),
gains AS (
    SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM sums
), weights AS (
    SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM held JOIN gains USING (bucket) WHERE NOT aim GROUP BY id
), scored AS (
    SELECT id AS doc_id, len(ws) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
    FROM words LEFT JOIN weights USING (id) WHERE NOT aim
), ranked AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, floor(5 * count(*) OVER () / 100) AS most FROM scored WHERE n_words >= 20
)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END::BIGINT AS rank FROM scored AS s LEFT JOIN ranked AS r ON r.doc_id = s.doc_id
"""
