"""Mixing sources to target weights, with DataFrame functions only.

1. Each source's documents form one stream of words, in the order of a hash of the document.
   Word offsets come from two levels of prefix sums (within and across hash buckets), so no
   task ever sorts a whole source.
2. The stream is cut into blocks of `block` words.
3. Targets share all words by weight; none is above `most` times its source, and what that
   leaves is shared again by weight (water filling over one row a source).
4. Output slots of one block each are dealt to shards. Every slot draws its source by a uniform
   number of its own, so the counts of a shard are multinomial. Counts are what goes on: for each
   run of RUN_SLOTS slots and each source, how many slots it has; a permutation of the shard's
   slots then says which.
5. The q-th draw of a source takes the block that a pseudorandom permutation of the source's
   block indices (swap-or-not rounds) puts at q, so all blocks are used before any is repeated.
6. Blocks are packed from the words of the documents in them, and meet slots by (source, block
   index): one row (shard, slot, source, block, words, text) for each slot.
7. A document has taken as many words as it has in these rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotweave.llm.bytekit import written
from plotweave.llm.rules import let, words

BLOCK = 64
SHARDS = 16
RUN_SLOTS = 1024
MOST = 3
ROUNDS = 12
BUCKETS = 1024
#: Cells of [0, 1) by which a slot's uniform number meets the sources it may mean.
CELLS = 4096
SEED = 20_240_517
WORD = r"[^\x20\x09-\x0D]+"


def _uniform(*parts):
    """In [0, 1): 52 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 12).cast("double") / F.lit(float(1 << 52))


def _key(source: str):
    """A source as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("key")


def sizes(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, source, size, the document's place in its source's stream, and the columns to keep."""
    return docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64(F.lit(SEED), "doc_id", "text").alias("place"),
        *keep,
    ).withColumn("bucket", F.pmod("place", F.lit(BUCKETS)).cast("int"))


def targets(per_source: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, weight and target of each source; one row a source.

    Sources are weighed 1, 2, 3, 1, ... by code point order, null last. With all words W,
    caps c = most * size and weights w, the targets are min(c, x * w) for the one x at which
    they add up to W: sources are capped in the order of c / w, so x is found by one scan.
    """
    ranked = Window.orderBy(F.col("source").isNull(), "source")
    total = Window.partitionBy()
    capped = Window.orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", "source").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = (
        per_source.withColumn("weight", ((F.row_number().over(ranked) - 1) % 3 + 1).cast("double"))
        .withColumn("cap", F.col("source_size").cast("double") * most)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(total).cast("double"))
        .withColumn("level", (F.col("all_words") - F.coalesce(F.sum("cap").over(capped), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("x", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(total))
    )
    return out.select("source", "source_size", "weight", F.least("cap", F.col("x") * F.col("weight")).alias("target"))


def permuted(index, size, key, rounds: int = ROUNDS):
    """Where a pseudorandom permutation of 0..size-1 puts index: rounds that swap x and (k - x) mod size, or not."""
    def turn(x, r):
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), r, key), size) - x, size)
        coin = F.xxhash64(F.lit(SEED + 1), r, key, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(coin, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index, turn)


def drawn(parts: DataFrame, shards: int) -> DataFrame:
    """shard, n (its slots), first (of the run), source, draws, before: multinomial counts by shard, run and source.

    parts: source and part, the number of slots that it is to have on average; one row a source.
    A source owns the numbers of [0, 1) in proportion to its part, cut at the edges of CELLS cells,
    so that slots and sources meet in an equi join of which no key is hot.
    """
    one = Window.partitionBy()
    order = Window.orderBy(F.col("source").isNull(), "source")
    owned = parts.withColumn("hi", F.sum("part").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("lo", F.lag("hi", 1, 0.0).over(order)).withColumn("all", F.max("hi").over(one)).withColumn("last", F.max(F.struct(F.col("source").isNull(), "source")).over(one)["source"].eqNullSafe(F.col("source")))
    lo, hi = F.col("lo") / F.col("all"), F.when(F.col("last"), F.lit(1.0)).otherwise(F.col("hi") / F.col("all"))
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1)).cast("int")
    owned = owned.select("source", lo.alias("lo"), hi.alias("hi"), "all")
    cells = owned.select("source", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    every = owned.agg(F.ceil(F.max("all")).cast("bigint").alias("slots")).where("slots > 0").select("slots", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"))
    every = every.select("shard", (F.floor((F.col("shard") + 1) * F.col("slots") / shards) - F.floor(F.col("shard") * F.col("slots") / shards)).alias("n")).where("n > 0")
    runs = every.select("shard", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(RUN_SLOTS).cast("bigint"))).alias("first"))
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = runs.repartition(tasks, "shard", "first").select("*", F.explode(F.sequence("first", F.least(F.col("first") + RUN_SLOTS, F.col("n")) - 1)).alias("i"))
    slots = slots.withColumn("u", _uniform("shard", "i")).withColumn("cell", cell(F.col("u")))
    met = slots.join(cells.hint("broadcast") if _small(parts) else cells, "cell").where("u >= lo AND u < hi")
    return met.groupBy("shard", "n", "first", "source").agg(F.count(F.lit(1)).alias("draws"))


def _dealt(docs: DataFrame, block: int, shards: int, most: int, texts: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The streams (doc_id, source, size, offset), the targets of sources, and the rows of slots with their documents, and their text if asked for."""
    sized = written(sizes(docs), "sizes")
    per_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0)).cast("bigint"))
    per_source = written(targets(per_bucket.groupBy("source").agg(F.sum("words").cast("bigint").alias("source_size")), most), "targets")

    # A source's part of the slots is its target in blocks of the length that its blocks have on average.
    blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("bigint")
    parts = per_source.where("target > 0").select("source", blocks.alias("blocks"), (F.col("target") * blocks / F.col("source_size")).alias("part"))
    counts = written(drawn(parts.select("source", "part"), shards), "draws")
    # In a run, slots lie in the order of sources before they are permuted. Draws of a source are
    # numbered from shard to shard, then from run to run; none is beyond `most` times its blocks.
    place = F.col("first") + F.coalesce(F.sum("draws").over(Window.partitionBy("shard", "first").orderBy(F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_shard = counts.groupBy(_key("source"), "shard").agg(F.sum("draws").alias("draws"))
    earlier = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    of_shard = of_shard.select("key", "shard", F.coalesce(F.sum("draws").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("key", "shard").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counts.withColumn("place", place).withColumn("key", _key("source")).withColumn("before", F.coalesce(F.sum("draws").over(inside), F.lit(0)))
    numbered = numbered.join(of_shard, ["key", "shard"]).join(parts.select(_key("source"), "blocks"), "key").withColumn("before", F.col("before") + F.col("base"))
    runs = numbered.withColumn("draws", F.least("draws", F.col("blocks") * most - F.col("before"))).where("draws > 0")

    # Slots of a source and run, each mapped to a block.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slot = runs.repartition(tasks, "key", "shard", "first").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("draws") - 1)).alias("i"))
    drawn_block = permuted(F.pmod(F.col("before") + F.col("i"), F.col("blocks")), F.col("blocks"), F.coalesce("source", F.lit("\x00"))).alias("block")
    slot = slot.select("shard", permuted(F.col("place") + F.col("i"), F.col("n"), F.col("shard")).alias("slot"), "key", "source", drawn_block)

    # Documents cut at block edges. A document's source and offset tell it from all others that have words.
    inside = Window.partitionBy("key", "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    begins = starts.select(_key("source"), "bucket", "base")

    def placed(rows, *keep):
        own = rows.select("*", _key("source")).withColumn("offset", F.coalesce(F.sum("size").over(inside), F.lit(0)).cast("bigint"))
        return own.join(begins.hint("merge"), ["key", "bucket"]).select("doc_id", "source", "size", (F.col("offset") + F.col("base")).alias("offset"), *keep)

    streamed = placed(sized)
    offset, last = F.col("offset"), F.col("offset") + F.col("size")
    spans = F.sequence(F.floor(offset / block), F.floor((last - 1) / block))

    def piece(b, all_words=None):
        lo, hi = F.greatest(offset, b * block), F.least(last, (b + 1) * block)
        text = [] if all_words is None else [F.array_join(F.slice(all_words, (lo - offset + 1).cast("int"), (hi - lo).cast("int")), " ").alias("text")]
        return F.struct(b.alias("block"), (hi - lo).alias("words"), *text)

    if texts:
        cut = let(words(F.col("text")), lambda w: F.transform(spans, lambda b: piece(b, w)))
        part = placed(sizes(docs, "text").where("size > 0"), "text")
    else:
        cut = F.transform(spans, lambda b: piece(b))
        part = streamed.where("size > 0")
    part = part.select("doc_id", _key("source"), "offset", F.explode(cut).alias("p"))
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", F.col("p.words").alias("words"), *([F.col("p.text").alias("text")] if texts else []))))
    # Grouped by the very key of the join, so that pieces are not shuffled again.
    packed = part.groupBy("key", F.col("p.block").alias("block")).agg(held.alias("held"))
    packed = packed.select(
        "key",
        "block",
        F.aggregate("held", F.lit(0).cast("bigint"), lambda n, x: n + x["words"]).alias("words"),
        *([F.array_join(F.transform("held", lambda x: x["text"]), " ").alias("text")] if texts else []),
        F.transform("held", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["offset"].alias("offset"), x["words"].alias("words"))).alias("documents"),
    )
    rows = packed.join(slot.hint("merge"), ["key", "block"]).select("shard", "slot", "source", "block", "words", *(["text"] if texts else []), "documents")
    return streamed, per_source, rows


def mixed(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, most: int = MOST, texts: bool = True) -> DataFrame:
    """The mixture: shard, slot in it, source, block, words and text, with the documents (doc_id, offset, words) of each row.

    A block's text is its words with a blank between them (left out without `texts`); only a
    source's last block may have fewer than `block`. Slots number from 0 in each shard. A slot
    that a source cannot fill without repeating its blocks more than `most` times is left out.
    """
    return _dealt(docs, block, shards, most, texts)[2]


def mixture(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target and taken of each document, counted from the rows of `mixed` (their texts are not needed).

    A null or empty text has size 0 and takes nothing; a null source is a source of its own,
    last in order. Equal rows are counted as often as they occur. An empty table gives none.
    Other columns are ignored. A source without words has target 0.
    """
    streamed, per_source, rows = _dealt(docs, block, shards, most, False)
    part = rows.select("source", F.explode("documents").alias("d")).groupBy("source", "d.offset").agg(F.sum("d.words").alias("taken"))
    got = streamed.alias("o").join(part.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source")) & (F.col("o.offset") == F.col("g.offset")) & (F.col("o.size") > 0), "left").select("o.doc_id", "o.source", "o.size", "g.taken")
    sources = F.broadcast(per_source) if _small(per_source) else per_source
    return got.alias("o").join(sources.alias("s"), F.col("o.source").eqNullSafe(F.col("s.source"))).select("o.doc_id", "o.size", "s.source_size", "s.target", F.coalesce("o.taken", F.lit(0)).cast("bigint").alias("taken"))


#: Sources that may be broadcast; with more, the joins shuffle.
BROADCAST_SOURCES = 10_000


def _small(per_source: DataFrame) -> bool:
    """Windows over sources run in one task: a source is a collection of documents, not a host or an author."""
    return per_source.count() <= BROADCAST_SOURCES
