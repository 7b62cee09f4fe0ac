"""Benchmark decontamination with an FM-index of each training shard.

A shard is one run of Arrow batches of a scan task, so the shuffle-free scan is the only pass
over the training text. The alphabet of its index is the vocabulary of the test phrases: any
other word ends a run of text, and runs shorter than the shortest phrase cannot hold one, so
they are left out of the index. What is left is suffix-sorted, its Burrows-Wheeler transform
is kept as a wavelet tree, all phrases are searched backwards at once, and occurrences are
located by walking to sampled suffix positions.

Test phrases are taken from the benchmark in blocks of at most `block_phrases` phrases, each
sent to the executors in a broadcast; more phrases mean more blocks, never a larger broadcast.
What several blocks find in a row is united by the row's own key.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm.bytekit import LOWER, LOWER_ALNUM, RollingHash, fresh, gather_ranges, keyed, tokens, utf8, written

#: Words in a window.
WINDOW = 10
#: Phrases in one broadcast block (10 words of 8 bytes each: 16 MB at most).
BLOCK_PHRASES = 200_000
#: Bytes of text that make a shard, and every which suffix position is sampled.
SHARD_BYTES = 8 << 20
SAMPLE = 8

SPANS = "spans array<struct<start:bigint,end:bigint>>, items array<string>"


class WaveletTree:
    """Rank of symbols in a sequence, from one bit vector with prefix counts for each bit of a symbol."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.zeros, self.ones = bits, [], []
        for level in reversed(range(bits)):
            bit = ((seq >> level) & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(seq) - int(bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        lo, hi = np.zeros_like(upto), upto
        for depth, level in enumerate(reversed(range(self.bits))):
            ones, one = self.ones[depth], ((symbol >> level) & 1).astype(bool)
            lo1, hi1 = ones[lo], ones[hi]
            lo = np.where(one, self.zeros[depth] + lo1, lo - lo1)
            hi = np.where(one, self.zeros[depth] + hi1, hi - hi1)
        return hi - lo


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Start positions in the order of the suffixes (prefix doubling until all ranks differ)."""
    n = len(seq)
    rank, width = np.unique(seq, return_inverse=True)[1].astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])]) if n else np.zeros(0, np.int64)
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if n == 0 or fresh[-1] == n - 1:
            return order
        width *= 2


class FMIndex:
    """Backward search and location over a sequence of symbols >= 1 (0 ends it)."""

    def __init__(self, seq: np.ndarray, alphabet: int):
        seq = np.append(seq, 0)
        order = suffix_order(seq)
        self.bwt = seq[order - 1]
        self.tree = WaveletTree(self.bwt, max(1, int(alphabet).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=alphabet + 1))])
        self.sampled = (order % SAMPLE == 0) | (order == 0)
        self.at = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of equally long phrases (one in a row)."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), len(self.bwt), np.int64)
        live = np.arange(len(phrases))
        for column in reversed(range(phrases.shape[1])):
            symbol = phrases[live, column]
            lo[live] = self.first[symbol] + self.tree.rank(symbol, lo[live])
            hi[live] = self.first[symbol] + self.tree.rank(symbol, hi[live])
            dead = live[lo[live] >= hi[live]]
            hi[dead] = lo[dead]
            live = live[lo[live] < hi[live]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.sampled[rows])
        while len(live):
            symbol = self.bwt[rows[live]]
            rows[live] = self.first[symbol] + self.tree.rank(symbol, rows[live])
            steps[live] += 1
            live = live[~self.sampled[rows[live]]]
        return self.samples[self.at[rows]] + steps


@dataclass
class Phrases:
    """One block of test phrases: vocabulary hashes, and for each length the phrases and their items."""

    words: np.ndarray
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    items: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, rows: list[tuple[str, np.ndarray]], window: int) -> Phrases:
        """rows: item id and the hashes of the item's words."""
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *[w for _, w in rows]]))
        made: dict[int, tuple[list, list]] = {}
        out = cls(vocabulary)
        for item, words in rows:
            if not len(words):
                continue
            ids = np.searchsorted(vocabulary, words) + 1
            grams = np.lib.stride_tricks.sliding_window_view(ids, min(window, len(ids)))
            kept = made.setdefault(grams.shape[1], ([], []))
            kept[0].append(grams)
            kept[1].append(np.full(len(grams), len(out.items)))
            out.items.append(item)
        out.by_length = {n: (np.concatenate(a), np.concatenate(b)) for n, (a, b) in made.items()}
        return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the rows, and the words up to each row's start."""
    data = LOWER[data]
    start, end, upto = tokens(data, offsets, LOWER_ALNUM)
    return RollingHash(data)(start, end), upto


def search_shard(ids: np.ndarray, upto: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word start, word end and item of all occurrences of phrases; ids: 0 for words no phrase has."""
    none = np.zeros(0, np.int64)
    if not len(ids) or not phrases.by_length:
        return none, none, none
    shortest = min(phrases.by_length)
    row = np.repeat(np.arange(len(upto) - 1), np.diff(upto))
    known = ids > 0
    begins = known & np.concatenate([[True], ~known[:-1] | (row[1:] != row[:-1])])
    run_start = np.flatnonzero(begins)
    last = known & np.concatenate([~known[1:] | (row[1:] != row[:-1]), [True]])
    run_len = np.flatnonzero(last) + 1 - run_start
    long_enough = run_len >= shortest
    run_start, run_len = run_start[long_enough], run_len[long_enough]
    if not len(run_start):
        return none, none, none
    # Each run, then a separator that no phrase has (the symbol after the vocabulary).
    gap = len(phrases.words) + 1
    where = gather_ranges(run_start, run_len + 1)
    ends = np.cumsum(run_len + 1) - 1
    where[ends] = 0
    seq = ids[where]
    seq[ends] = gap
    index = FMIndex(seq, gap)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for length, (grams, items) in phrases.by_length.items():
        lo, hi = index.search(grams)
        n = hi - lo
        spot = where[index.locate(gather_ranges(lo, n))]
        found.append((spot, spot + length, np.repeat(items, n)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def _shard(ids: list, phrases: Phrases, out: list) -> None:
    """Adds for each row of the shard: number of words, merged spans, items."""
    counts = np.concatenate([np.diff(u) for _, u in ids])
    upto = np.concatenate([[0], np.cumsum(counts)])
    start, end, item = search_shard(np.concatenate([x for x, _ in ids]), upto, phrases)
    order = np.argsort(start, kind="stable")
    start, end, item = start[order], end[order], item[order]
    row = np.searchsorted(upto, start, "right") - 1
    cut = np.searchsorted(row, np.arange(len(counts) + 1))
    for r in range(len(counts)):
        spans, items = [], []
        if cut[r] < cut[r + 1]:
            s, e = start[cut[r] : cut[r + 1]] - upto[r], end[cut[r] : cut[r + 1]] - upto[r]
            reach = np.maximum.accumulate(e)
            fresh = np.concatenate([[True], s[1:] > reach[:-1]])
            stop = np.append(reach[:-1][fresh[1:]], reach[-1])
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(s[fresh], stop, strict=True)]
            items = [phrases.items[k] for k in np.unique(item[cut[r] : cut[r + 1]])]
        out.append((int(counts[r]), spans, items))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def spans_of(rows: DataFrame, phrases) -> DataFrame:
    """One pass over rows (row, doc_id, text) against one broadcast block of phrases."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        ids: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            out: list = []
            _shard(ids, phrases.value, out)
            ids_of = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield pa.record_batch(
                [*ids_of.columns, pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], _SPANS), pa.array([x[2] for x in out], pa.list_(pa.string()))],
                ["row", "doc_id", "n_words", "spans", "items"],
            )

        vocabulary = phrases.value.words
        for batch in batches:
            at = 0
            data, offsets = utf8(batch.column(2))
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SHARD_BYTES - size, "right")) - 1)
                stop = min(stop, batch.num_rows)
                words, upto = words_of(data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at])
                if len(vocabulary):
                    slot = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
                    found = np.where(vocabulary[slot] == words, slot + 1, 0)
                else:
                    found = np.zeros(len(words), np.int64)
                held.append(batch.select([0, 1]).slice(at, stop - at))
                ids.append((found.astype(np.int32), upto))
                size += int(offsets[stop] - offsets[at])
                at = stop
                if size >= SHARD_BYTES:
                    yield from flush()
                    held, ids, size = [], [], 0
        if held:
            yield from flush()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("row", "doc_id", "text").mapInArrow(run, f"row bigint, doc_id {kind}, n_words bigint, {SPANS}")


def merged(spans):
    """Native union of overlapping spans, for rows that several blocks have found."""
    ordered = F.array_sort(spans)
    grown = F.aggregate(
        ordered,
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return grown


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", block_phrases: int = BLOCK_PHRASES) -> DataFrame:
    """Per document: doc_id, n_words, removal spans (word offsets, merged), and the items found.

    A null or empty text has no words. An item without words, or without an id, is never found. A
    benchmark without phrases finds nothing. Equal items are all reported. Rows with equal or null
    ids stay apart, in however many blocks the phrases come. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.lit(0).cast("bigint").alias("row"), F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    block: list[tuple[str, np.ndarray]] = []
    blocks, held = [], 0
    for item in benchmark.select(F.col(item_column).cast("string"), F.col(item_text)).toLocalIterator():
        text = (item[1] or "").encode()
        words, _ = words_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        # An item of more phrases than a block holds is cut into parts that share window - 1 words.
        for at in range(0, max(1, len(words) - window + 1) if len(words) and item[0] is not None else 0, block_phrases):
            part = words[at : at + block_phrases + window - 1]
            if block and held + len(part) > block_phrases:
                blocks.append(spark.sparkContext.broadcast(Phrases.of(block, window)))
                block, held = [], 0
            block.append((item[0], part))
            held += len(part)
    blocks.append(spark.sparkContext.broadcast(Phrases.of(block, window)))
    if len(blocks) == 1:
        return spans_of(rows, blocks[0]).drop("row")
    rows = keyed(rows.drop("row"), "row", "doc_id", "text")
    both = spans_of(rows, blocks[0])
    for phrases in blocks[1:]:
        both = both.unionByName(spans_of(rows, phrases))
    grouped = both.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return grouped.drop("row").withColumn("spans", merged(F.col("spans")))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from `contamination` rows."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, x: acc + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without those that hold benchmark text, with all their columns.

    Rows are told apart by a hash of id and text, so rows with a null id go as well, and of rows
    equal in both all go or all stay.
    """
    rid = fresh(docs, "_rid")
    rows = docs.withColumn(rid, F.xxhash64("doc_id", "text"))
    found = contamination(rows, benchmark, id_column=rid, **options)
    bad = written(found.where(F.size("spans") > 0).select(F.col("doc_id").alias(rid)).distinct(), "contaminated")
    return rows.join(bad, rid, "left_anti").drop(rid)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS gram
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
d AS (
  SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM g) WHERE len(ws) >= n)),
m AS (SELECT d.doc_id, d.i, d.n, g.item_id FROM d JOIN g ON d.n = g.n AND d.gram = g.gram),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
