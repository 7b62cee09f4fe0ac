"""A trie of conversation prefixes, summed along heavy paths.

1. Turns are numbered along conversations, conversations are rebuilt, and each prefix gets a key of
   128 bits, the exclusive or of the hashes of its turns with their places. Equal prefixes are one
   node: an aggregate, so a turn that all conversations begin with is summed before it is shuffled.
2. A node's heavy child is the one with the most members (of equals the one of the smallest id);
   all others are light, with at most half of the node's members. The last light node on the way to a node
   is the head of its path; a path is an array of nodes, and there are at most log2(members)
   light nodes above any.
3. Paths are summed up; then, from the lowest level of light heads to the root's path, the sum of
   each path goes to the path that its head's parent is on. These rounds are over paths, not nodes.
4. With what hangs from each node added to its own numbers, suffix sums along each path are the sums
   over subtrees.

Running values (numbers of turns, prefix keys, last light nodes, suffix sums) are scans in which a
conversation or path of any length is dealt out over tasks. The ids of a node's ends are joined to
texts of `CHUNK` neighbouring ids, and hashed one after another as they stream through a task, since
SHA-256 has to be.

Null roles and texts are empty, null turns come first, and equal turns are in the order of their
roles, then of a hash of their texts. Rows with a null id belong to no conversation and are left
out. Repeated rows are turns like others; texts may have any length. Other columns are
ignored. An empty table has no node.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.bytekit import dropped, written
from plotweave.llm.scan import scanned

#: Neighbouring ids that are one text when ends are hashed.
CHUNK = 4096
_EMPTY = hashlib.sha256(b"").hexdigest()
_KEY = ["depth", "k1", "k2"]


def shared(conv: Column) -> tuple[Column, Column]:
    """The conversation that one begins with, and how many of its turns."""
    return conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, depth, x1, x2, bytes) of the rebuilt conversations, and all conversations (conv)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("x1"), F.xxhash64(F.lit(1), text, role).alias("x2"), F.octet_length(text).cast("bigint").alias("bytes"), F.lit(1).cast("bigint").alias("one")
    )
    numbered = scanned(slim, ["conv"], ["turn", "role", "x1", "x2"], {"i": ("sum", "one")}).select("conv", "i", "x1", "x2", "bytes")
    base, h = shared(F.col("conv"))
    every = numbered.groupBy("conv").agg(F.max("i").alias("n"))
    convs = every.select("conv", base.alias("base"), h.alias("h"))
    convs = written(convs.join(every.select(F.col("conv").alias("base"), F.col("n").alias("held")), "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("held", F.lit(0))).alias("taken")), "conversations")
    begun = convs.join(numbered.where("i <= 8").select(F.col("conv").alias("base"), "i", "x1", "x2", "bytes"), "base").where("i <= h")
    begun = begun.select("conv", F.col("i").alias("depth"), "x1", "x2", "bytes")
    # Few conversations begin with one that is too short; turns of all others keep their numbers.
    short = convs.where("taken < h").select("conv", (F.col("h") - F.col("taken")).alias("less"))
    own = numbered.where(F.col("i") > shared(F.col("conv"))[1]).join(short, "conv", "left")
    own = own.select("conv", (F.col("i") - F.coalesce("less", F.lit(0))).alias("depth"), "x1", "x2", "bytes")
    return begun.unionByName(own), convs.select("conv")


def _hashed(batches):
    """SHA-256 over the rows of each key, which come one after another, with commas between them."""
    key, state = None, None
    for batch in batches:
        found = []
        for *now, text in zip(*(batch.column(c).to_pylist() for c in [*_KEY, "ids"]), strict=True):
            if now != key:
                if key is not None:
                    found.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pa.RecordBatch.from_pylist([dict(zip([*_KEY, "ends_sha256"], r, strict=True)) for r in found], _ENDS)
    if key is not None:
        yield pa.RecordBatch.from_pylist([dict(zip([*_KEY, "ends_sha256"], (*key, state.hexdigest()), strict=True))], _ENDS)


_ENDS = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])


def ends(last: DataFrame) -> DataFrame:
    """ends_sha256 of each node (depth, k1, k2) at which conversations (conv) end."""
    chunk = F.floor(F.col("conv") / CHUNK).cast("bigint")
    ids = last.groupBy(*_KEY, chunk.alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    return ids.repartition(*_KEY).sortWithinPartitions(*_KEY, "chunk").mapInArrow(_hashed, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def _nodes(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes without the root, each conversation's way through them, and the ends; all written."""
    turns, convs = rebuilt(conversations)
    turns = turns.withColumn("p1", F.xxhash64("depth", "x1", "x2")).withColumn("p2", F.xxhash64(F.lit(2), "depth", "x2", "x1")).drop("x1", "x2")
    ways = scanned(turns, ["conv"], ["depth"], {"k1": ("xor", "p1"), "k2": ("xor", "p2")})
    last = ways.groupBy("conv").agg(F.max(F.struct(*_KEY)).alias("k")).select("conv", "k.*")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    last = written(convs.join(last, "conv", "left").select("conv", *map(zero, _KEY)), "ends")
    up = lambda k: F.first(F.col(f"k{k}").bitwiseXOR(F.col(f"p{k}"))).alias(f"q{k}")
    found = ways.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), F.first("bytes").alias("bytes"), up(1), up(2))
    return written(found, "trie-nodes"), ways.select("conv", *_KEY), last


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node."""
    spark = conversations.sparkSession
    nodes, ways, last = _nodes(conversations)
    top = last.agg(F.min("conv"), F.count(F.lit(1))).first()
    if not top[1]:
        return spark.createDataFrame([], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")
    root_conv, n_all = top
    zero = F.lit(0).cast("bigint")

    # Children of each node; the heavy one is told by its id, since children have no member in common.
    rank = F.struct("n_convs", (-F.col("conv_id")).alias("low"))
    below = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"), F.max_by("conv_id", rank).alias("heavy"))
    below = written(below, "trie-children")
    of_root = below.where("depth = 0").first()
    children, heavy = (of_root["n_children"], of_root["heavy"]) if of_root else (0, None)
    full = written(nodes.join(below.where("depth > 0"), _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-full")
    parent = full.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("chosen"))
    slim = full.select(*_KEY, "q1", "q2", "conv_id", "n_convs", "n_children", "bytes")
    under = slim.where("depth > 1").join(parent, ["depth", "q1", "q2"])
    first = slim.where("depth = 1").withColumn("parent_conv_id", F.lit(root_conv).cast("bigint")).withColumn("chosen", F.lit(heavy).cast("bigint"))
    known = written(under.unionByName(first).withColumn("light", F.col("conv_id") != F.col("chosen")).drop("q1", "q2", "chosen"), "trie-known")
    dropped(nodes, below, full)

    # Heads of paths: the last light node on each conversation's way, else the root.
    on_way = ways.join(known.withColumnRenamed("conv_id", "node_conv"), _KEY).withColumn("head_conv", F.when(F.col("light"), F.col("node_conv"))).withColumn("head_depth", F.when(F.col("light"), F.col("depth"))).withColumn("level", F.col("light").cast("bigint"))
    lit_up = scanned(on_way, ["conv"], ["depth"], {"path_conv": ("last", "head_conv"), "path_depth": ("last", "head_depth"), "path_level": ("sum", "level")})
    placed = lit_up.where("conv = node_conv").select(
        F.col("conv").alias("conv_id"), *_KEY, "parent_conv_id", "n_convs", "n_children", "light",
        F.coalesce("path_conv", F.lit(root_conv)).alias("path_conv"), F.coalesce("path_depth", zero).alias("path_depth"), F.col("path_level").alias("level"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("tokens"),
    )
    root = spark.range(1).select(
        F.lit(root_conv).cast("bigint").alias("conv_id"), zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), F.lit(None).cast("bigint").alias("parent_conv_id"), F.lit(n_all).cast("bigint").alias("n_convs"), F.lit(children).cast("bigint").alias("n_children"), F.lit(False).alias("light"),
        F.lit(root_conv).cast("bigint").alias("path_conv"), zero.alias("path_depth"), zero.alias("level"), F.lit(int(not children)).cast("bigint").alias("leaf"), zero.alias("tokens"),
    )
    placed = written(placed.unionByName(root), "trie-placed")
    dropped(known)

    # Sums of paths, and of what hangs from them, from the lowest level up.
    sums = placed.groupBy("path_conv", "path_depth").agg(F.max("level").alias("level"), F.sum("leaf").alias("leaf"), F.sum("tokens").alias("tokens"))
    heads = placed.where("light").select(F.col("conv_id").alias("path_conv"), F.col("depth").alias("path_depth"), F.col("parent_conv_id").alias("up_conv"), (F.col("depth") - 1).alias("up_depth"))
    on = placed.where("depth > 0 AND n_children > 1").select(F.col("conv_id").alias("up_conv"), F.col("depth").alias("up_depth"), F.col("path_conv").alias("to_conv"), F.col("path_depth").alias("to_depth"))
    first = heads.where("up_depth = 0").withColumn("to_conv", F.lit(root_conv).cast("bigint")).withColumn("to_depth", zero)
    heads = heads.where("up_depth > 0").join(on, ["up_conv", "up_depth"]).unionByName(first)
    paths = written(sums.join(heads, ["path_conv", "path_depth"]), "trie-paths")
    lowest = paths.agg(F.max("level")).first()[0] or 0
    totals, hung = [], None
    for level in range(lowest, 0, -1):
        here = paths.where(F.col("level") == level)
        if hung is not None:
            here = here.join(hung, ["path_conv", "path_depth"], "left").withColumn("leaf", F.col("leaf") + F.coalesce("more_leaf", F.lit(0))).withColumn("tokens", F.col("tokens") + F.coalesce("more_tokens", F.lit(0)))
        here = written(here.select("up_conv", "up_depth", "to_conv", "to_depth", "leaf", "tokens"), "trie-totals")
        totals.append(here)
        hung = here.groupBy(F.col("to_conv").alias("path_conv"), F.col("to_depth").alias("path_depth")).agg(F.sum("leaf").alias("more_leaf"), F.sum("tokens").alias("more_tokens"))

    # Suffix sums along each path.
    each = placed
    if totals:
        every = totals[0]
        for t in totals[1:]:
            every = every.unionByName(t)
        at = every.groupBy(F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth")).agg(F.sum("leaf").alias("more_leaf"), F.sum("tokens").alias("more_tokens"))
        each = placed.join(at, ["conv_id", "depth"], "left").withColumn("leaf", F.col("leaf") + F.coalesce("more_leaf", F.lit(0))).withColumn("tokens", F.col("tokens") + F.coalesce("more_tokens", F.lit(0))).drop("more_leaf", "more_tokens")
    each = each.select("conv_id", *_KEY, "parent_conv_id", "n_convs", "n_children", "path_conv", "path_depth", "leaf", "tokens", (-F.col("depth")).alias("from_end"))
    summed = scanned(each, ["path_conv", "path_depth"], ["from_end"], {"n_leaves": ("sum", "leaf"), "saved_tokens": ("sum", "tokens")})
    dropped(placed, paths, *totals)
    out = summed.join(ends(last), _KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))


#: Nodes by the text of their prefix; crc32 byte by byte from a table that SQL computes.
ORACLE = r"""
WITH RECURSIVE steps AS (
    SELECT range AS i, range AS c, 0 AS k FROM range(256)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
numbered AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT c, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) % 9 AS h
    FROM (SELECT DISTINCT c FROM numbered), crc
), turns AS (
    SELECT c.c, 0 AS part, n.i, n.role, n.text FROM convs AS c JOIN numbered AS n ON n.c = c.base AND n.i <= h
    UNION ALL SELECT c.c, 1, n.i, n.role, n.text FROM convs AS c JOIN numbered AS n ON n.c = c.c AND n.i > h
), way AS (
    SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, list({'role': role, 'text': text}) OVER (PARTITION BY c ORDER BY part, i) AS prefix, strlen(text) AS bytes FROM turns
    UNION ALL SELECT c, 0, [], 0 FROM convs
), lengths AS (SELECT c, max(d) AS n FROM way GROUP BY c),
nodes AS (
    SELECT d, prefix, min(w.c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, list(w.c) AS members,
        sha256(coalesce(string_agg(w.c::VARCHAR, ',' ORDER BY w.c) FILTER (n = d), '')) AS ends_sha256
    FROM way AS w JOIN lengths AS l ON l.c = w.c GROUP BY d, prefix
), kids AS (SELECT d - 1 AS d, prefix[:len(prefix) - 1] AS prefix, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (
    SELECT a.d, a.conv_id, count(*) FILTER (k.n IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved
    FROM nodes AS a JOIN nodes AS b ON b.d >= a.d AND list_contains(a.members, b.conv_id) LEFT JOIN kids AS k ON k.d = b.d AND k.prefix = b.prefix GROUP BY ALL
)
SELECT a.conv_id, a.d::BIGINT AS depth, p.conv_id AS parent_conv_id, a.n_convs::BIGINT AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, a.ends_sha256
FROM nodes AS a LEFT JOIN nodes AS p ON p.d = a.d - 1 AND p.prefix = a.prefix[:len(a.prefix) - 1]
LEFT JOIN kids AS k ON k.d = a.d AND k.prefix = a.prefix JOIN below AS b ON b.d = a.d AND b.conv_id = a.conv_id
"""
