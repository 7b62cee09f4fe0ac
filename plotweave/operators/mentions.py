"""Which names a text has: one pass over each text by an Aho-Corasick automaton of all names.

Names belong to scripts, and a text is searched for the names of its script. Where all names together are
small (`MOST_NAMES`, `MOST_BYTES`, counted before anything is collected), they are broadcast, and texts are
scanned where they are, without a shuffle. Beyond that, texts meet the names of their script in
groups: a script's texts are split into groups of about `GROUP_BYTES`, and its names into blocks
of about as many, so neither a script with many texts nor one with many names meets in one task.
"""

from __future__ import annotations

from collections import defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names, and bytes of names, that may be broadcast.
MOST_NAMES, MOST_BYTES = 100_000, 2 << 20
#: Bytes of texts, and of names, that meet in one group.
GROUP_BYTES = 16 << 20


def automaton(names) -> ahocorasick.Automaton | None:
    """All of these names at once; None if there are none. An empty name is in every text, so it is left to the caller."""
    found = ahocorasick.Automaton()
    for n in names:
        if n:
            found.add_word(n, n)
    if not len(found):
        return None
    found.make_automaton()
    return found


def in_text(names: ahocorasick.Automaton | None, text: str | None) -> set[str]:
    """The names that occur in a text, overlapping ones and names in names included."""
    if names is None or not text:
        return set()
    return {n for _, n in names.iter(text)}


def _fields(script: T.StructField, text_id: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("script_id", script.dataType), T.StructField("text_id", text_id.dataType), T.StructField("name", T.StringType())])


def mentions(texts: DataFrame, names: DataFrame, most_names: int = MOST_NAMES, most_bytes: int = MOST_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """script_id, text_id and name, once, of each name of its script that a text contains.

    texts: script_id, text_id, text; names: script_id, name. Null texts and names contain and are
    nothing; rows without a script have no names. An empty name is in every text.
    """
    each = names.where("script_id IS NOT NULL AND name IS NOT NULL").select("script_id", "name").distinct()
    n, size = each.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("name")), F.lit(0))).first()
    told = texts.where("script_id IS NOT NULL AND text IS NOT NULL").select("script_id", "text_id", "text")
    if n <= most_names and size <= most_bytes:
        return _broadcast(told, each)
    return _grouped(told, each, group_bytes)


def _broadcast(texts: DataFrame, names: DataFrame) -> DataFrame:
    of = defaultdict(set)
    for script, name in names.collect():  # within MOST_NAMES and MOST_BYTES
        of[name].add(script)
    shared = texts.sparkSession.sparkContext.broadcast(dict(of))
    schema = _fields(texts.schema["script_id"], texts.schema["text_id"])

    def run(batches):
        bearers = shared.value
        search = automaton(bearers)
        for batch in batches:
            rows = []
            for i, (script, text) in enumerate(zip(batch.column("script_id").to_pylist(), batch.column("text"), strict=True)):
                found = in_text(search, text.as_py())
                rows += [(i, n) for n in found if script in bearers[n]]
                if script in bearers.get("", ()):
                    rows.append((i, ""))
            at = pa.array([i for i, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("script_id").take(at), batch.column("text_id").take(at), pa.array([n for _, n in rows], pa.string())], schema.names)

    return texts.mapInArrow(run, schema)


def _grouped(texts: DataFrame, names: DataFrame, group_bytes: int) -> DataFrame:
    parts = lambda df, c, out: df.groupBy("script_id").agg(F.ceil(F.sum(F.octet_length(c)) / group_bytes).cast("int").alias(out))
    counts = parts(texts, "text", "salts").join(parts(names, "name", "blocks"), "script_id").select("script_id", F.greatest("salts", F.lit(1)).alias("salts"), F.greatest("blocks", F.lit(1)).alias("blocks"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = texts.join(counts, "script_id").withColumn("salt", F.pmod(F.xxhash64("text_id", "text"), "salts").cast("int")).withColumn("block", spread("blocks")).select("script_id", "salt", "block", "text_id", "text")
    # Texts may be names of the same table; the keys of both sides are told apart by columns of their own.
    theirs = names.join(counts, "script_id").withColumn("block", F.pmod(F.xxhash64("name"), "blocks").cast("int")).withColumn("salt", spread("salts")).select(F.col("script_id").alias("of"), F.col("salt").alias("of_salt"), F.col("block").alias("of_block"), "name")
    schema = _fields(texts.schema["script_id"], texts.schema["text_id"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        every = right["name"].to_pylist()
        search, always = automaton(every), [""] if "" in every else []
        rows = [(i, n) for i, text in enumerate(left["text"].to_pylist()) for n in [*in_text(search, text), *always]]
        at = pa.array([i for i, _ in rows], pa.int64())
        return pa.Table.from_arrays([left["script_id"].take(at), left["text_id"].take(at), pa.array([n for _, n in rows], pa.string())], schema.names)

    return mine.groupBy("script_id", "salt", "block").cogroup(theirs.groupBy("of", "of_salt", "of_block")).applyInArrow(run, schema)
