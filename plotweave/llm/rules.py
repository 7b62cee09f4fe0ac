"""Quality rules, with DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated word windows. The method's verdict
is a hashed n-gram log-likelihood ratio: word unigrams and bigrams are hashed to buckets, one
multinomial is counted over the trusted texts and one over the whole corpus (each smoothed by
one count shared over the buckets), and a document scores the mean log ratio of its n-grams.
Every document is held against the same threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.bytekit import dense, fresh, written

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
BUCKETS = 1 << 16
#: A document is rejected below this mean log ratio (natural logarithm, for each n-gram).
THRESHOLD = -0.25
#: Ids of trusted texts that are broadcast (16 MB or so); with more, texts are shuffled to them. The counts are the same.
BROADCAST_IDS = 1_000_000


def words(text: Column) -> Column:
    """Words of a text as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more, from the words' 64-bit hashes.

    Window hashes of texts without a repeat differ, which one pass over a hash set shows. Else
    windows are sorted by hash and place; equal neighbours are repeats, and a repeat at p covers
    the words from p to the next repeat, `window` of them at most.
    """
    n = F.size(hashes) - (window - 1)
    grams = let(hashes, lambda hs: F.transform(F.sequence(F.lit(1), F.size(hs) - (window - 1)), lambda i: F.xxhash64(F.slice(hs, i, window))))
    found = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(_by_hash(g), lambda s: _covered(s, window))))
    return F.when(n < 2, F.lit(0)).otherwise(found).cast("bigint")


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _by_hash(grams: Column) -> Column:
    return F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))


def _covered(pairs: Column, window: int) -> Column:
    at = lambda i: F.get(pairs, i)["g"]
    hits = F.transform(F.filter(pairs, lambda x, k: x["g"].eqNullSafe(at(k - 1)) | x["g"].eqNullSafe(at(k + 1))), lambda x: x["i"])
    return F.aggregate(
        F.array_sort(hits),
        F.struct(F.lit(0).alias("sum"), F.lit(-window).alias("last")),
        lambda acc, p: F.struct((acc["sum"] + F.least(F.lit(window), p - acc["last"])).alias("sum"), p.alias("last")),
        lambda acc: acc["sum"],
    )


def buckets(hashes: Column, count: int = BUCKETS) -> Column:
    """Bucket of each unigram and bigram, unigrams first; count is a power of two."""
    at = lambda h: h.bitwiseAND(F.lit(count - 1)).cast("int")
    one = lambda hs: F.transform(hs, at)
    two = lambda hs: F.transform(F.slice(hs, 2, F.greatest(F.size(hs) - 1, F.lit(0))), lambda h, i: at(F.xxhash64(F.get(hs, i), h)))
    return let(hashes, lambda hs: F.concat(one(hs), two(hs)))


def log_ratios(docs: DataFrame, trusted: DataFrame, count: int = BUCKETS) -> DataFrame:
    """One row: `llr`, `count` numbers of 6 decimals. Counts cover every n-gram of every document and of every trusted one.

    trusted: distinct ids (column doc_id) of the texts that count as the target.
    """
    one = F.lit(1).cast("bigint")
    good = trusted.select("doc_id", one.alias("good"))
    marked = docs.select("doc_id", "text").join(F.broadcast(good) if good.count() <= BROADCAST_IDS else good, "doc_id", "left")
    grams = marked.select("good", F.explode(buckets(F.transform(words(F.col("text")), lambda w: F.xxhash64(w)), count)).alias("b"))
    both = written(grams.groupBy("b").agg(F.sum(one).alias("n"), F.sum("good").alias("t")), "grams")  # `count` rows
    totals = both.agg(F.sum("n").alias("nn"), F.sum("t").alias("tt"))
    part = lambda n, total: F.log((n + 1.0) / (F.coalesce(total, F.lit(0)) + F.lit(float(count))))
    ratio = lambda x: F.round(part(x["t"], F.col("tt")) - part(x["n"], F.col("nn")), 6)
    return totals.join(dense(both, "b", count, "n", "t"), F.lit(True)).select(F.transform("list", ratio).alias("llr"))


def judged(docs: DataFrame, trusted: DataFrame, count: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents' columns, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    A null or empty text has no words and fails the base rules. Equal rows are judged alike. An
    empty table gives none. Columns of the documents that have one of these names are replaced by
    the rules' own; all others are kept.
    """
    # A scalar subquery: `count` numbers, whatever the input, of which no plan holds a copy. It is a
    # column first, since lambdas may not hold a subquery.
    llr = log_ratios(docs, trusted, count).scalar()
    w, h, lines, ratios = (fresh(docs, c) for c in ("_w", "_h", "_l", "_r"))
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    out = docs.withColumn(w, words(F.col("text"))).withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    n = F.col("n_words")
    total = F.aggregate(buckets(F.col(h), count), F.lit(0.0), lambda acc, b: acc + F.get(F.col(ratios), b))
    return (
        out.withColumn("n_words", F.size(w).cast("bigint"))
        .withColumn("word_chars", F.length(F.array_join(w, "")).cast("bigint"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOL)).cast("bigint"))
        .withColumn(lines, blank)
        .withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"))
        .withColumn("n_repeat_words", repeated_words(F.col(h)))
        .withColumn("base_failed", (n < 20) | (100 * F.col("n_repeat_words") > 30 * n))
        .withColumn(ratios, llr)
        .withColumn("llr", total / F.greatest(F.lit(1), 2 * n - 1))
        .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
        .drop(w, h, lines, ratios)
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that any row of the labels calls good."""
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
