"""Near duplicates of documents: Order MinHash sketches, verified by banded alignment.

A document is its sequence of shingles (five words each), an n-th occurrence of one told apart
from the others. A sketch is, for each of SKETCHES hash functions, the PER_SKETCH shingles of
smallest hash in the order in which they stand in the text: documents with equal entries share
shingles in the same order, so the sketch follows edit similarity and not just the set.

Short texts also have entries for their whole sequence and for what is left of it without one
or two shingles: any two that can be linked, the shorter of SHORT shingles or fewer, share one
for certain. Of longer texts a pair is a candidate with the probability stated at SKETCHES.

Two documents with an equal entry are candidates. They are linked if the alignment of their
shingle sequences inside a band matches at least `similarity` of their union. Documents with
equal words are one node from the start. Groups are found without listing the pairs of a group:

1. Each document is aligned with one hub: among the members of its entries, the one that shares
   most entries with others.
2. Where an entry's members are still in different components, those outside the largest one
   there are aligned with its hub.
3. What is then left apart is aligned across components, but only pairs that can be linked. A
   pair's common shingles are those it shares with the hub, no more than the one of the two
   that has fewer of those, and shingles that the hub does not have. So a pair must either have
   enough in common with the hub, or share a shingle outside it, which an equi join finds. No
   candidate link is lost, and copies that stray from a large group are not paired with all of it.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotweave.llm.bytekit import CHUNK_BYTES, LOWER, NOT_SPACE, RollingHash, chunks, fresh, keyed, mix64, tokens, utf8, written
from plotweave.llm.graph import components, extended

SHINGLE, SIMILARITY = 5, 0.8
#: With similarity 0.8, two long documents share an entry with probability 0.8^6, one of 24 with 0.9993;
#: shingles are drawn without replacement, so with few of them it is less.
SKETCHES, PER_SKETCH = 24, 6

#: Shingles of the shorter text up to which candidates are exact at similarity 0.8: the longer one
#: has at most 11, the whole shorter text is in order in it but for the pair of 9 and 9 (8 in common).
SHORT = 9
#: Shingles left out, and of which numbers of shingles.
_LEFT_OUT = ((0, range(4, 10)), (1, range(5, 11)), (2, range(10, 12)))

_SALT = mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of each run of `size` words; fewer words, but not none, are one shingle."""
    if len(words) < size:
        words = np.concatenate([words, np.full(size - len(words), 0, np.uint64)]) if len(words) else words
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mix64(out * np.uint64(0x100000001B3) + words[k : k + n])
    return out


def occurrences(grams: np.ndarray) -> np.ndarray:
    """Hashes in which the second, third, ... occurrence of a shingle differ from the first."""
    order = np.argsort(grams, kind="stable")
    fresh = np.concatenate([[True], grams[order][1:] != grams[order][:-1]])
    if fresh.all():
        return grams
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    nth = np.empty(len(order), np.uint64)
    nth[order] = np.arange(len(order)) - start
    return np.where(nth > 0, mix64(grams + nth * np.uint64(0xC2B2AE3D27D4EB4F)), grams)


def short_entries(grams: np.ndarray) -> np.ndarray:
    """Hashes of a short text's shingle sequence, whole and without one or two shingles."""
    out = [np.zeros(0, np.uint64)]
    for k, sizes in _LEFT_OUT:
        if len(grams) in sizes:
            kept = grams[np.array(list(combinations(range(len(grams)), len(grams) - k)))]
            x = np.full(len(kept), len(grams) - k, np.uint64)
            for column in kept.T:
                x = mix64(x * np.uint64(0x100000001B3) + column)
            out.append(x)
    return np.concatenate(out).view(np.int64)


def sketch(grams: np.ndarray) -> np.ndarray:
    """SKETCHES entries of one document and those of short texts; a text without shingles has none."""
    if not len(grams):
        return np.zeros(0, np.int64)
    labelled = occurrences(grams)
    few = min(PER_SKETCH, len(grams))
    value = (labelled[None, :] ^ _SALT[:, None]) * np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xA24BAED4963EE407)
    at = np.sort(np.argpartition(value, few - 1, axis=1)[:, :few], axis=1)
    out = _SALT.copy()
    for k in range(few):
        out = mix64(out * np.uint64(0x100000001B3) + labelled[at[:, k]])
    return np.concatenate([out.view(np.int64), short_entries(grams)])


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the best alignment in the band matches `similarity` of the union of two shingle sequences.

    Equal ends are taken off first. Of the rest, row by row, a bit for each place of `a` in the
    band says where the longest common subsequence grows; the band is as wide as the gaps that
    the similarity leaves room for, so nothing outside it can matter.
    """
    total = len(a) + len(b)
    if not len(a) or not len(b):
        return total == 0
    need = similarity / (1 + similarity) * total  # matches m with m / (total - m) >= similarity
    if min(len(a), len(b)) < need - 1e-9:
        return False
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    x, y = a[head:], b[head:]
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[::-1][:n] != y[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    matches = head + tail
    if matches >= need - 1e-9:
        return True
    if matches + min(len(x), len(y)) < need - 1e-9:
        return False
    band = int(total - 2 * need) + 1
    place: dict[int, list[int]] = {}
    for i, v in enumerate(x.tolist()):
        place.setdefault(v, []).append(i)
    width = 2 * band + 1
    full = (1 << width) - 1
    grow = full  # bit b: place j - band + b of x; a zero bit: the subsequence grows there
    for j, v in enumerate(y.tolist()):
        spots = place.get(v)
        if spots is not None:
            hit = 0
            for i in spots if len(spots) == 1 else spots[bisect_left(spots, j - band) : bisect_left(spots, j + band + 1)]:
                if -band <= i - j <= band:
                    hit |= 1 << (i - j + band)
            step = grow & hit
            grow = ((grow + step) | (grow - step)) & full
        matches += not grow & 1
        grow = grow >> 1 | 1 << (width - 1)
    return matches + width - grow.bit_count() >= need - 1e-9


def _words(text: bytes) -> np.ndarray:
    data = LOWER[np.frombuffer(text, np.uint8)]
    start, end, _ = tokens(data, np.array([0, len(data)]), NOT_SPACE)
    return RollingHash(data)(start, end)


def _sketched(batches):
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        for i, j in chunks(offsets, CHUNK_BYTES):
            low = LOWER[data[offsets[i] : offsets[j]]]
            at = offsets[i : j + 1] - offsets[i]
            start, end, upto = tokens(low, at, NOT_SPACE)
            words = RollingHash(low)(start, end)
            same, same_too, entries = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64), []
            for r in range(j - i):
                own = words[upto[r] : upto[r + 1]]
                entries.append(sketch(shingles(own)))
                placed = mix64(own + mix64(np.arange(len(own), dtype=np.uint64)))
                same[r], same_too[r] = np.bitwise_xor.reduce(placed), np.add.reduce(placed)
            yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(same.view(np.int64)), pa.array(same_too.view(np.int64)), pa.array(entries, pa.list_(pa.int64()))], ["row", "doc_id", "same", "same_too", "entries"])


def need(a, b, similarity: float = SIMILARITY):
    """Common shingles that texts of a and b shingles need to be linked."""
    return similarity / (1 + similarity) * (a + b)


_TESTED = "a bigint, b bigint, linked boolean, n bigint, common bigint, rest array<bigint>"


def _test(similarity: float):
    """For (a, b): linked; shingles of a, how many of them b has too, and the others unless linked."""

    def run(batches):
        for batch in batches:
            linked, n, common, rest, last = [], [], [], [], (None, None, None)
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if last[0] is None or last[0] != y:
                    grams = shingles(_words((y or "").encode()))
                    last = (y, grams, np.sort(occurrences(grams)) if len(grams) else grams)
                own = shingles(_words((x or "").encode()))
                ok = aligned(own, last[1], similarity)
                labelled = occurrences(own) if len(own) else own
                at = np.minimum(np.searchsorted(last[2], labelled), max(0, len(last[2]) - 1))
                has = last[2][at] == labelled if len(last[2]) else np.zeros(len(labelled), bool)
                linked.append(ok)
                n.append(len(own))
                common.append(int(has.sum()))
                rest.append([] if ok else labelled[~has].view(np.int64))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(n, pa.int64()), pa.array(common, pa.int64()), pa.array(rest, pa.list_(pa.int64()))], ["a", "b", "linked", "n", "common", "rest"])

    return run


def _labelled_shingles(batches):
    for batch in batches:
        grams = [shingles(_words((t or "").encode())) for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array([len(g) for g in grams], pa.int64()), pa.array([occurrences(g).view(np.int64) if len(g) else [] for g in grams], pa.list_(pa.int64()))], ["node", "n", "grams"])


class Aligned:
    """Tests of candidate pairs, and which pairs outside the hub's component can be linked at all."""

    def __init__(self, rows: DataFrame, candidates: DataFrame, similarity: float):
        # The hint makes the join shuffle alike at every size; the built side is ids only.
        nodes = candidates.withColumnRenamed("node", "doc").hint("shuffle_hash")
        self.texts = written(rows.join(nodes, "doc", "left_semi"), "texts")
        self.similarity = similarity

    def test(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b) with what `_test` finds. Merge joins: Spark splits the many pairs of one hub."""
        at_a = written(pairs.select("a", "b"), "pairs").join(self.texts.hint("merge").withColumnsRenamed({"doc": "a", "text": "text_a"}), "a")
        both = at_a.join(self.texts.hint("merge").withColumnsRenamed({"doc": "b", "text": "text_b"}), "b").select("a", "b", "text_a", "text_b")
        return written(both.mapInArrow(_test(self.similarity), _TESTED), "tested")

    def residual(self, keys: DataFrame, strays: DataFrame) -> DataFrame:
        """Pairs (a, b) of different components that share a key and can be linked.

        keys: (key, node, root, hub) of keys whose members are apart; strays: tested pairs (a, hub b).
        """
        members = keys.select("hub", "node", "root").distinct()
        shingled = written(self.texts.join(members.select(F.col("node").alias("doc")).distinct().hint("shuffle_hash"), "doc", "left_semi").mapInArrow(_labelled_shingles, "node bigint, n bigint, grams array<bigint>"), "shingles")
        info = strays.where("NOT linked").select(F.col("a").alias("node"), F.col("b").alias("hub"), "common", "rest")
        known = written(keys.join(shingled.select("node", "n"), "node").join(info.select("node", "hub", "common"), ["node", "hub"], "left"), "apart")
        # Enough in common with the hub on both sides; who is with the hub has no bound of its own.
        x = known.where("common IS NOT NULL").select("key", "node", "root", "n", "common")
        y = known.select("key", F.col("node").alias("node_b"), F.col("root").alias("root_b"), F.col("n").alias("n_b"), F.col("common").alias("common_b"))
        enough = F.least("common", F.coalesce("common_b", "common")) >= need(F.col("n"), F.col("n_b"), self.similarity) - 1e-9
        near = F.least("n", "n_b") >= self.similarity * F.greatest("n", "n_b") - 1e-9
        plain = x.join(y, (x["key"] == y["key"]) & (F.col("root") != F.col("root_b")) & near & enough).select(F.greatest("node", "node_b").alias("a"), F.least("node", "node_b").alias("b"))
        # Or shingles outside the hub in common: t at least, so one of all but t - 1 of them; the rarest are asked for.
        all_ = members.join(shingled.select("node", "n", F.explode("grams").alias("gram")), "node").select("hub", F.col("node").alias("node_b"), F.col("root").alias("root_b"), F.col("n").alias("n_b"), "gram")
        rest = info.join(members, ["hub", "node"]).join(shingled.select("node", "n"), "node").select("hub", "node", "root", "n", "common", F.size("rest").alias("outside"), F.explode("rest").alias("gram"))
        held = rest.join(all_.groupBy("hub", "gram").agg(F.count(F.lit(1)).alias("texts")), ["hub", "gram"])
        held = held.withColumn("rank", F.row_number().over(Window.partitionBy("hub", "node").orderBy("texts", "gram")))
        t = F.ceil(need(F.col("n"), F.col("n_b"), self.similarity) - F.col("common") - 1e-9)
        found = held.join(all_, (held["hub"] == all_["hub"]) & (held["gram"] == all_["gram"]) & (F.col("root") != F.col("root_b")) & (t >= 1) & (F.col("rank") <= F.col("outside") - t + 1))
        outside = found.select(F.greatest("node", "node_b").alias("a"), F.least("node", "node_b").alias("b"))
        return plain.unionByName(outside).distinct()


def grouped(keys: DataFrame, prepare) -> DataFrame:
    """node and root of the nodes that verified links connect.

    keys: (key, node) rows and what else `residual` wants of them. prepare: from the table of
    nodes that share a key, gives an object like Aligned.
    """
    more = [c for c in keys.columns if c not in ("key", "node")]
    keys = keys.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "key")
    weight = keys.groupBy("node").agg(F.sum("members").alias("weight"))
    keys = written(keys.drop("members").join(weight, "node"), "keys")
    pairs_of = prepare(keys.select("node").distinct())
    hub = F.max(F.struct("weight", (-F.col("node")).alias("minus")))
    # 1. One pair for each node: with the hub of most of its keys, the heaviest of those.
    hubs = keys.groupBy("key").agg(hub.alias("hub"))
    each = keys.join(hubs, "key").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("n"))
    mine = each.groupBy("node").agg(F.max(F.struct("n", "hub")).alias("x")).select(F.col("node").alias("a"), (-F.col("x.hub.minus")).alias("b")).where("a <> b")
    tested = pairs_of.test(mine)
    roots = written(components(tested.where("linked").select("a", "b")), "roots")
    # 2. Outside the largest component of a key, one pair for each node: with that one's hub.
    labelled = keys.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    tops = labelled.groupBy("key", "root").agg(hub.alias("hub"), F.count(F.lit(1)).alias("n"))
    most = tops.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "hub", "root")).alias("top")).where("roots > 1")
    apart = written(labelled.select("key", "node", "root", *more).join(most.select("key", (-F.col("top.hub.minus")).alias("hub"), F.col("top.root").alias("head")), "key"), "mixed")
    asked = apart.where("root <> head").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    again = pairs_of.test(asked.join(tested.select("a", "b"), ["a", "b"], "left_anti"))
    tested = tested.unionByName(again)
    roots = written(extended(roots, again.where("linked").select("a", "b")), "roots")
    # 3. Pairs left that can be linked.
    now = apart.drop("root", "head").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    still = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    left = written(now.join(still, "key"), "left")
    pairs = pairs_of.residual(left, tested)
    last = pairs_of.test(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"))
    return extended(roots, last.where("linked").select("a", "b"))


def linked_rows(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """row, doc_id, group (any number that all rows of a group have) of the rows (row, doc_id, text)."""
    made = written(rows.mapInArrow(_sketched, "row bigint, doc_id bigint, same bigint, same_too bigint, entries array<bigint>"), "sketches")
    # Equal words: one node stands for all, told from 128 bits of hash.
    nodes = written(made.groupBy("same", "same_too").agg(F.min_by(F.struct("row", "entries"), "row").alias("x")).select("same", "same_too", "x.row", "x.entries"), "nodes")
    keys = nodes.select(F.col("row").alias("node"), F.explode(F.array_distinct("entries")).alias("key"))
    roots = grouped(keys, lambda candidates: Aligned(rows.select(F.col("row").alias("doc"), "text"), candidates, similarity))
    found = nodes.join(roots.withColumnRenamed("node", "row"), "row", "left").select("same", "same_too", F.coalesce("root", "row").alias("group"))
    return made.select("row", "doc_id", "same", "same_too").join(found, ["same", "same_too"]).select("row", "doc_id", "group")


def classes(docs: DataFrame, similarity: float = SIMILARITY, id_column: str = "doc_id") -> DataFrame:
    """The id and class_id (the smallest id of its group) of each row.

    Words are runs of anything but ASCII white space, lower-cased from A to Z. Texts without
    words are equal to one another; rows with fewer words than a shingle only match equal words.
    Every row is a document of its own, so rows of one id but different texts do not join their
    groups. A null id has the class of its group, null if no row of the group has an id. Other
    columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), "text")
    rows = keyed(rows, "row", "doc_id", "text")
    found = linked_rows(rows.select("row", "doc_id", "text"), similarity)
    least = found.groupBy("group").agg(F.min("doc_id").alias("class_id"))
    return found.join(least, "group").select(F.col("doc_id").alias(id_column), "class_id")


def representatives(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group, with all its columns: that of smallest doc_id, null last, and one of repeated rows.

    Rows are told apart by their own number, so a row never goes because another one has its id.
    """
    row = fresh(docs, "_row")
    rows = keyed(docs, row, "doc_id", "text")
    found = written(linked_rows(rows.select(F.col(row).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text"), similarity), "groups")
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = found.join(first, "group").where("row <> head.row").select(F.col("row").alias(row))
    return rows.join(gone, row, "left_anti").drop(row)
