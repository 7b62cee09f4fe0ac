"""Resolution of person names: noise, pairs, groups, canonical names and aliases.

Names are compared within a script only, in pairs whose rules can hold at all: a pair shares a
character, so pairs come from an equi join on (script, character) before the rules are tried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions.names import noise_reason, same_person
from plotweave.sources.shared import removed, stored


def without_noise(people: DataFrame) -> DataFrame:
    """People whose name is one; `noise` says why others are not."""
    return people.withColumn("noise", noise_reason(F.col("name"), F.col("description")))


def pairs(people: DataFrame, strict: bool = False) -> DataFrame:
    """script_id, a, b: positions a < b of one person's names. people: (script_id, pos, name)."""
    slim = people.select("script_id", "pos", "name")
    chars = slim.select("script_id", "pos", "name", F.explode(F.array_distinct(F.split("name", ""))).alias("c"))
    left, right = chars.withColumnsRenamed({"pos": "a", "name": "name_a"}), chars.withColumnsRenamed({"pos": "b", "name": "name_b"})
    shared = left.join(right, ["script_id", "c"]).where("a < b").select("script_id", "a", "b", "name_a", "name_b").distinct()
    return shared.where(same_person(F.col("name_a"), F.col("name_b"), strict)).select("script_id", "a", "b")


def components(people: DataFrame, links: DataFrame) -> DataFrame:
    """script_id, pos, root: the smallest position that links reach.

    Alternating stars: neighbours are linked to the smallest one, first the larger ones, then the
    others, so rounds grow with the logarithm of a component. Each round is a table in the
    shared folder, which the next one replaces.
    """
    script = "script_id"
    edges = stored(links.where("a <> b").select(script, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while (now := tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(script, "a", "b"))).first())) != state and now[0]:
        state = now
        both = edges.unionByName(edges.select(script, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(script, "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, [script, "a"]).select(script, F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy(script, "a").agg(F.min("b").alias("m"))
        small = large.join(least, [script, "a"]).where("b <> m").select(script, F.col("b").alias("a"), F.col("m").alias("b"))
        before, edges = edges, stored(small.unionByName(least.select(script, "a", F.col("m").alias("b"))).distinct(), "edges")
        removed(before)
    roots = edges.groupBy(script, F.col("a").alias("pos")).agg(F.min("b").alias("root"))
    return people.select(script, "pos").join(roots, [script, "pos"], "left").select(script, "pos", F.coalesce("root", "pos").alias("root"))


def resolved(people: DataFrame, roots: DataFrame) -> DataFrame:
    """One row a person: canonical name, aliases, names merged.

    Canonical is the entry that says most (description, ten for a trait, five for a
    relationship), the last of equals. Aliases: its own, then the others' names and aliases.
    """
    said = F.coalesce(F.length("description"), F.lit(0)) + 10 * F.coalesce(F.size("personality"), F.lit(0)) + 5 * F.coalesce(F.size("relationships"), F.lit(0))
    each = people.join(roots, ["script_id", "pos"]).withColumn("said", said)
    entry = F.struct("pos", "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    made = each.groupBy("script_id", "root").agg(F.max_by(entry, F.struct("said", "pos")).alias("c"), F.array_sort(F.collect_list(entry)).alias("all"))
    others = F.filter("all", lambda x: x["pos"] != F.col("c.pos"))
    more = F.flatten(F.transform(others, lambda x: F.concat(F.array(x["name"]), x["aliases"])))
    return made.select("script_id", "root", F.col("c.name").alias("canonical_name"), F.array_distinct(F.concat("c.aliases", more)).alias("aliases"), F.size("all").alias("merged"))


def resolve(people: DataFrame, strict: bool = False) -> DataFrame:
    kept = without_noise(people).where("noise IS NULL").drop("noise")
    return resolved(kept, components(kept, pairs(kept, strict)))


def merged_by_list(people: DataFrame, decisions: DataFrame) -> DataFrame:
    """Applies merge decisions (canonical, merged): merged names go and become aliases of a listed canonical name."""
    known = decisions.join(people.select(F.col("canonical_name").alias("canonical")), "canonical", "left_semi")
    extra = known.groupBy("canonical").agg(F.array_sort(F.collect_set("merged")).alias("more"))
    kept = people.join(known.select(F.col("merged").alias("canonical_name")).distinct(), "canonical_name", "left_anti")
    joined = kept.join(extra, kept["canonical_name"] == extra["canonical"], "left").drop("canonical")
    return joined.withColumn("aliases", F.array_distinct(F.concat("aliases", F.coalesce("more", F.array().cast("array<string>"))))).drop("more")


def new_people(found: DataFrame, known: DataFrame) -> DataFrame:
    """Those of whom neither the name nor an alias is known, whatever the case. known: (name)."""
    names = known.select(F.lower("name").alias("n")).distinct()
    own = found.withColumn("_k", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))))
    seen = own.join(names, F.lower("_k") == F.col("n"), "left_semi").select("script_id", "pos").distinct()
    return found.join(seen, ["script_id", "pos"], "left_anti")


def order_within(people: DataFrame, by: str = "appearance_count") -> DataFrame:
    return people.withColumn("rank", F.row_number().over(Window.partitionBy("script_id").orderBy(F.desc(by), "pos")))
