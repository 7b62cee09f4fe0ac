"""Connected components of large edge tables, with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm.bytekit import dropped, written


def _state(pairs: DataFrame) -> tuple:
    """Number of edges and a checksum of them: equal for equal sets."""
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) of every node of edges (a, b); a may be any number.

    Alternating stars: in a large-star step each node's larger neighbours are linked to its
    smallest neighbour, in a small-star step its smaller ones and itself are. The rounds needed
    grow with the logarithm of a component's size, edges never outnumber those given, and no
    neighbourhood is gathered: minima are aggregates, so a hub is summed before it is shuffled.
    Each round is written to the shared folder, and the one before it is deleted.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = written(pairs, "edges")
    state = _state(pairs)
    while state[0]:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("b", "m", "a")
        stars = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        after = written(stars, "edges")
        dropped(pairs)
        pairs, before, state = after, state, _state(after)
        if state == before:
            break
    roots = pairs.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """node and root of all nodes of roots and of the links (a, b), with the components of roots joined by the links.

    Only links between different components are followed, from root to root.
    """
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    more = components(between).select(F.col("root").alias("top"), F.col("node").alias("root"))
    moved = roots.join(more, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    # A node without a component is its own root in `between`.
    return moved.unionByName(more.join(roots, more["root"] == roots["node"], "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root")))
