"""Links between lines, actions, events, scenes and people.

Exact matches are equi joins. Names in texts are found by one automaton for all names of a script
(mentions.py), names in names by equi joins on their substrings (`within`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions.names import strip_honorific, strip_prefix
from plotweave.functions.rules import EXTERIOR, INTERIOR, hits, time_from_content
from plotweave.operators.mentions import mentions
from plotweave.sources.shared import removed, stored

_NONE = "array<string>"


def names(people: DataFrame, last_alias: bool = False) -> DataFrame:
    """script_id, name, character_id: of a canonical name the last bearer, of an alias the first; canonical names win.

    last_alias: canonical names and aliases alike go to the last bearer.
    """
    each = people.select("script_id", "pos", "character_id", F.col("canonical_name").alias("name"), F.lit(1).alias("kind")).unionByName(
        people.select("script_id", "pos", "character_id", F.explode(F.coalesce("aliases", F.array().cast(_NONE))).alias("name"), F.lit(0).alias("kind"))
    )
    rank = F.struct("pos", "kind") if last_alias else F.struct("kind", F.when(F.col("kind") == 1, F.col("pos")).otherwise(-F.col("pos")).alias("p"))
    return each.where("name IS NOT NULL").groupBy("script_id", "name").agg(F.max_by("character_id", rank).alias("character_id"), F.min("pos").alias("pos"))


def _best(rows: DataFrame, key: list[str], *order) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def substrings(text: Column) -> Column:
    """All distinct substrings, the text itself included; for names, which are short."""
    n = F.length(text)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.greatest(n - i + 1, F.lit(1))), lambda k: F.substring(text, i, k)))))


#: Names of more characters than this are searched as texts, not cut into substrings.
LONGEST = 24


def within(short: DataFrame, long: DataFrame) -> DataFrame:
    """script_id, inner, outer: pairs of a script in which the one name contains the other; short: script_id, inner; long: script_id, outer.

    An outer name of up to `LONGEST` characters gives a row for each of its substrings, and meets
    inner names in an equi join; longer ones, of which speakers may have any, are searched like texts.
    """
    return _within(*(stored(_distinct(df, c), "names-in-names") for df, c in ((short, "inner"), (long, "outer"))))


def _distinct(names_: DataFrame, column: str) -> DataFrame:
    return names_.where(F.col(column).isNotNull()).select("script_id", column).distinct()


def _within(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """The same of distinct names, which are read several times."""
    cut = outer.where(F.length("outer") <= LONGEST).select("script_id", "outer", F.explode(substrings(F.col("outer"))).alias("inner"))
    # The substring of an empty name is itself; an empty inner name is in every outer one.
    found = cut.where("inner <> ''").join(inner, ["script_id", "inner"]).select("script_id", "inner", "outer")
    far = outer.where(F.length("outer") > LONGEST)
    if not far.isEmpty():  # else names are not searched for at all
        told = mentions(far.select("script_id", F.col("outer").alias("text_id"), F.col("outer").alias("text")), inner.where("inner <> ''").select("script_id", F.col("inner").alias("name")))
        found = found.unionByName(told.select("script_id", F.col("name").alias("inner"), F.col("text_id").alias("outer")))
    empty = inner.where("inner = ''")
    return found if empty.isEmpty() else found.unionByName(outer.join(empty, "script_id").select("script_id", "inner", "outer"))


def either_way(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """script_id, x, y: pairs of a name of ours (script_id, x) and one of theirs (script_id, y) of which one contains the other.

    Both are kept while they are compared, and so are the pairs: no plan after this makes them again.
    """
    x, y = stored(_distinct(ours, "x"), "asked-names"), stored(_distinct(theirs, "y"), "known-names")
    a = _within(x.withColumnRenamed("x", "inner"), y.withColumnRenamed("y", "outer")).select("script_id", F.col("inner").alias("x"), F.col("outer").alias("y"))
    b = _within(y.withColumnRenamed("y", "inner"), x.withColumnRenamed("x", "outer")).select("script_id", F.col("outer").alias("x"), F.col("inner").alias("y"))
    pairs = stored(a.unionByName(b).distinct(), "near-names")
    removed(x, y)
    return pairs


def speakers(lines: DataFrame, people: DataFrame) -> DataFrame:
    """line_id, character_id, level of each line whose speaker is known.

    Levels: 1 name or alias; 2 the same without honorific; 3 without prefix, contained either
    way; 4 contained either way, two characters or more. First person in order within a level.
    Rules are tried on a script's distinct speakers, of which lines then take the person.
    """
    first = F.struct("pos", "character_id")
    people = stored(people.select("script_id", "pos", "character_id", "canonical_name", "aliases"), "people")
    exact = people.select("script_id", "pos", "character_id", F.explode(F.array_distinct(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast(_NONE))))).alias("name"))
    exact = exact.where("name IS NOT NULL").groupBy("script_id", "name").agg(F.min(first).alias("first"))
    said = lines.where("trim(speaker) <> ''").select("script_id", "speaker").distinct()
    said = stored(said.withColumn("bare", strip_honorific(F.col("speaker"))).withColumn("plain", strip_prefix(F.col("speaker"))), "speakers")
    level = lambda n: F.struct(F.lit(n).alias("level"), "first.pos", "first.character_id").alias("best")
    one = said.join(exact, (said["speaker"] == exact["name"]) & (said["script_id"] == exact["script_id"])).select(said["script_id"], "speaker", level(1))
    two = said.where("bare <> speaker").join(exact, (said["bare"] == exact["name"]) & (said["script_id"] == exact["script_id"])).select(said["script_id"], "speaker", level(2))
    sure = one.unionByName(two)
    rest = said.join(sure.select("script_id", "speaker").distinct(), ["script_id", "speaker"], "left_anti")
    canon = people.where("canonical_name IS NOT NULL").groupBy("script_id", F.col("canonical_name").alias("y")).agg(F.min(first).alias("first"))
    asked = rest.where("plain <> speaker").select("script_id", "speaker", F.col("plain").alias("x"), F.lit(3).alias("n"))
    asked = asked.unionByName(rest.where(F.length("speaker") >= 2).select("script_id", "speaker", F.col("speaker").alias("x"), F.lit(4).alias("n")))
    asked = stored(asked, "asked-speakers")
    near = either_way(asked.select("script_id", "x"), canon.select("script_id", "y"))
    met = asked.join(near, ["script_id", "x"]).where((F.col("n") == 3) | (F.length("y") >= 2))
    loose = met.join(canon, ["script_id", "y"]).select("script_id", "speaker", F.struct(F.col("n").alias("level"), "first.pos", "first.character_id").alias("best"))
    best = sure.unionByName(loose).groupBy("script_id", "speaker").agg(F.min("best").alias("best"))
    return lines.select("script_id", "speaker", "line_id").join(best, ["script_id", "speaker"]).select("line_id", "best.character_id", "best.level")


def linked_lines(lines: DataFrame, people: DataFrame) -> DataFrame:
    """Lines with character_id by name, else by containment in the order of people; others keep a null. `source` stays."""
    known = stored(names(people), "names")
    exact = lines.drop("character_id").join(known.select("script_id", F.col("name").alias("speaker"), "character_id"), ["script_id", "speaker"], "left")
    open_ = stored(exact.where("character_id IS NULL AND trim(speaker) <> ''").select("script_id", F.col("speaker").alias("x")).distinct(), "asked-speakers")
    pairs = either_way(open_, known.select("script_id", F.col("name").alias("y"))).join(known.withColumnRenamed("name", "y"), ["script_id", "y"])
    loose = pairs.groupBy("script_id", F.col("x").alias("speaker")).agg(F.min(F.struct("pos", "y", "character_id")).alias("best")).select("script_id", "speaker", F.col("best.character_id").alias("found"))
    return exact.join(loose, ["script_id", "speaker"], "left").withColumn("character_id", F.coalesce("character_id", "found")).drop("found")


def action_names(actions: DataFrame, people: DataFrame) -> DataFrame:
    """Actions (script_id, action_id, name) with the character_id of the person of that name, else of the first whose name contains it or is contained in it."""
    told = actions.select("script_id", F.col("action_id").alias("line_id"), F.col("name").alias("speaker"))
    found = linked_lines(told.withColumn("character_id", F.lit(None).cast("bigint")), people)
    return actions.drop("character_id").join(found.select(F.col("line_id").alias("action_id"), "character_id"), "action_id")


def _told(people: DataFrame, aliases: bool = True) -> DataFrame:
    """script_id, name, level (1 canonical, 2 alias), pos and character_id of each name of each person."""
    own = people.select("script_id", F.col("canonical_name").alias("name"), F.lit(1).alias("level"), "pos", "character_id")
    if not aliases:
        return own
    return own.unionByName(people.select("script_id", F.explode(F.coalesce("aliases", F.array().cast(_NONE))).alias("name"), F.lit(2).alias("level"), "pos", "character_id"))


def performers(actions: DataFrame, people: DataFrame) -> DataFrame:
    """action_id, character_id: the one given, else the first whose name, then whose alias, the description has.

    A description is searched once for all names of its script (see mentions).
    """
    given = actions.where("character_id IS NOT NULL").select("action_id", "character_id")
    open_ = actions.where("character_id IS NULL").select("script_id", F.col("action_id").alias("text_id"), F.col("description").alias("text"))
    bearer = _told(people).groupBy("script_id", "name").agg(F.min(F.struct("level", "pos", "character_id")).alias("first"))
    hits = mentions(open_, bearer).join(bearer, ["script_id", "name"])
    return given.unionByName(hits.groupBy(F.col("text_id").alias("action_id")).agg(F.min("first").alias("first")).select("action_id", "first.character_id"))


def scene_people(scenes: DataFrame, chapters: DataFrame, people: DataFrame) -> DataFrame:
    """scene_id and the ids, in order, of people whose name or alias its chapters' text has.

    A chapter is searched once for each script that has a scene of it, whatever the number of people and scenes.
    """
    asked = scenes.select("script_id", "scene_id", F.explode(F.array_distinct("chapter_ids")).alias("chapter_id"))
    text = asked.select("script_id", "chapter_id").distinct().join(chapters.select("chapter_id", "content"), "chapter_id")
    told = _told(people).select("script_id", "name", "pos", "character_id").distinct()
    hits = mentions(text.select("script_id", F.col("chapter_id").alias("text_id"), F.col("content").alias("text")), told)
    present = hits.join(told, ["script_id", "name"]).groupBy("script_id", F.col("text_id").alias("chapter_id"), "character_id").agg(F.min("pos").alias("pos"))
    return _listed(asked.join(present, ["script_id", "chapter_id"]), "scene_id")


def scene_time(scenes: DataFrame, chapters: DataFrame) -> DataFrame:
    """scene_id, time_of_day: told by the first of its chapters that tells one, else by its summary, else UNKNOWN.

    Chapters are labelled before the join, so their text is not shuffled.
    """
    told = chapters.select("chapter_id", "chapter_number", time_from_content(F.col("content")).alias("told")).where("told <> 'UNKNOWN'")
    asked = scenes.select("scene_id", F.explode(F.array_distinct("chapter_ids")).alias("chapter_id"))
    first = asked.join(told, "chapter_id").groupBy("scene_id").agg(F.min_by("told", F.struct("chapter_number", "chapter_id")).alias("told"))
    return scenes.select("scene_id", "summary").join(first, "scene_id", "left").select("scene_id", F.coalesce("told", time_from_content(F.col("summary"))).alias("time_of_day"))


def scene_interior(scenes: DataFrame, chapters: DataFrame) -> DataFrame:
    """scene_id, interior: keywords of the chapters' texts one after another, the summary and the location; two more for those in the location.

    Each chapter gives a bit for each keyword that it has, and its ends, where a keyword may begin
    in one chapter and end in the next; bits are united by an aggregate, and no text is shuffled.
    """
    words = INTERIOR + EXTERIOR
    reach = max(map(len, words)) - 1
    bits = lambda text: sum((F.shiftleft(F.coalesce(text.contains(w), F.lit(False)).cast("bigint"), k) for k, w in enumerate(words)), F.lit(0).cast("bigint"))
    c = F.coalesce("content", F.lit(""))
    ends = F.when(F.length(c) <= 2 * reach, c).otherwise(F.concat(F.substring(c, 1, reach), F.lit("\n"), F.right(c, F.lit(reach))))
    seen = chapters.select("chapter_id", "chapter_number", bits(c).alias("bits"), ends.alias("ends"))
    asked = scenes.select("scene_id", F.explode(F.array_distinct("chapter_ids")).alias("chapter_id"))
    per = asked.join(seen, "chapter_id").groupBy("scene_id").agg(F.bit_or("bits").alias("bits"), F.array_sort(F.collect_list(F.struct("chapter_number", "chapter_id", "ends"))).alias("all"))
    told = scenes.select("scene_id", "summary", "location").join(per, "scene_id", "left")
    rest = F.concat(F.array_join(F.transform("all", lambda x: x["ends"]), ""), F.coalesce(F.concat(F.lit(" "), "summary"), F.lit("")), F.coalesce(F.concat(F.lit(" "), "location"), F.lit("")))
    found = F.coalesce("bits", F.lit(0)).bitwiseOR(bits(F.coalesce(rest, F.concat_ws(" ", "summary", "location"))))
    inside = (1 << len(INTERIOR)) - 1
    outside = ((1 << len(words)) - 1) ^ inside
    score = lambda mask, own: F.bit_count(found.bitwiseAND(F.lit(mask))) + 2 * hits(F.col("location"), own)
    return told.select("scene_id", (score(inside, INTERIOR) >= score(outside, EXTERIOR)).alias("interior"))


def _listed(rows: DataFrame, key: str) -> DataFrame:
    first = rows.groupBy(key, "character_id").agg(F.min("pos").alias("pos"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "character_id"))), lambda x: x["character_id"]).alias("character_ids"))


def presence(scenes: DataFrame, lines: DataFrame, actions: DataFrame, people: DataFrame) -> DataFrame:
    """scene_id, character_ids: speakers, then performers, then names in summary or location; aliases do not count."""
    said = lines.where("character_id IS NOT NULL").select("scene_id", "character_id", F.struct(F.lit(0), F.col("sequence").cast("bigint")).alias("pos"))
    done = actions.where("character_id IS NOT NULL").select("scene_id", "character_id", F.struct(F.lit(1), F.col("sequence").cast("bigint")).alias("pos"))
    own = _told(people, aliases=False)
    hits = mentions(scenes.select("script_id", F.col("scene_id").alias("text_id"), F.concat_ws(" ", "summary", "location").alias("text")), own)
    told = hits.join(own, ["script_id", "name"]).select(F.col("text_id").alias("scene_id"), "character_id", F.struct(F.lit(2), F.col("pos").cast("bigint")).alias("pos"))
    return _listed(said.union(done).union(told), "scene_id")


def people_or_all(scenes: DataFrame, people: DataFrame) -> DataFrame:
    """scene_id, character_id: those a scene lists, or everyone of its script if none of them exists."""
    own = scenes.select("script_id", "scene_id", F.explode("character_ids").alias("character_id")).join(people.select("script_id", "character_id"), ["script_id", "character_id"])
    empty = scenes.select("script_id", "scene_id").join(own.select("scene_id").distinct(), "scene_id", "left_anti")
    return own.select("scene_id", "character_id").unionByName(empty.join(people.select("script_id", "character_id"), "script_id").select("scene_id", "character_id"))


def participants(events: DataFrame, people: DataFrame) -> DataFrame:
    """event_id, character_ids of the named participants that exist, in order of mention."""
    each = events.select("script_id", "event_id", F.posexplode("participants").alias("pos", "name"))
    known = names(people).drop("pos")
    return _listed(each.join(known, ["script_id", "name"]), "event_id")


def scene_events(scenes: DataFrame, events: DataFrame) -> DataFrame:
    """scene_id, event_id with a chapter in common; a scene without chapters gets all events of its script."""
    s = scenes.select("script_id", "scene_id", F.explode_outer("chapter_ids").alias("chapter_id"))
    e = events.select("script_id", "event_id", F.explode("chapter_ids").alias("chapter_id"))
    shared = s.where("chapter_id IS NOT NULL").join(e, ["script_id", "chapter_id"]).select("scene_id", "event_id")
    every = s.where("chapter_id IS NULL").join(events.select("script_id", "event_id"), "script_id").select("scene_id", "event_id")
    return shared.unionByName(every).distinct()


def remapped(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Old ids as new ones; unknown ids become null. mapping: (old_id, new_id)."""
    return rows.join(mapping.select(F.col("old_id").alias(column), "new_id"), column, "left").withColumn(column, F.col("new_id")).drop("new_id")


def relationship_edges(people: DataFrame) -> DataFrame:
    """script_id, low, high, relation: one edge for two people, the first that is told."""
    each = people.select("script_id", "pos", "character_id", F.posexplode("relationships").alias("nth", "r")).select("script_id", "pos", "character_id", "nth", F.col("r.target").alias("name"), F.col("r.relation").alias("relation"))
    each = each.where("name <> '' AND relation <> ''")
    own = people.select("script_id", F.col("pos").alias("tpos"), F.col("character_id").alias("target"), F.explode(F.array_distinct(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast(_NONE))))).alias("name"))
    found = _best(each.join(own, ["script_id", "name"]), ["script_id", "pos", "nth"], "tpos")
    found = found.withColumn("low", F.least("character_id", "target")).withColumn("high", F.greatest("character_id", "target"))
    return _best(found, ["script_id", "low", "high"], "pos", "nth").select("script_id", "low", "high", "relation")


def renamed(lines: DataFrame, character_id: int, old_name: str, new_name: str) -> DataFrame:
    """Lines of a renamed person, by id or by the old name, get the new one."""
    hit = F.coalesce(F.col("character_id") == character_id, F.lit(False)) | F.coalesce(F.col("speaker") == old_name, F.lit(False))
    return lines.withColumn("speaker", F.when(hit, F.lit(new_name)).otherwise(F.col("speaker")))


def with_profile(lines: DataFrame, people: DataFrame) -> DataFrame:
    """Lines with gender and personality of the speaker, by name or alias, the last bearer."""
    known = names(people, last_alias=True).select("script_id", F.col("name").alias("speaker"), F.col("character_id").alias("profile_id"))
    own = people.select("script_id", F.col("character_id").alias("profile_id"), "gender", "personality")
    return lines.join(known, ["script_id", "speaker"], "left").join(own, ["script_id", "profile_id"], "left")


def owning_scene(lines: DataFrame, scenes: DataFrame, script_id: int) -> DataFrame:
    """Lines with the scene they belong to, if it is one of the script's."""
    return lines.join(scenes.where(F.col("script_id") == script_id).select("scene_id"), "scene_id")


def circular(people: DataFrame, radius: float = 150.0, x0: float = 200.0, y0: float = 200.0) -> DataFrame:
    """Places on a circle, from the top, in order."""
    w = Window.partitionBy("script_id")
    i = F.row_number().over(w.orderBy("pos")) - 1
    angle: Column = 2 * F.pi() * i / F.count(F.lit(1)).over(w) - F.pi() / 2
    return people.select("script_id", "character_id", (F.lit(x0) + radius * F.cos(angle)).alias("x"), (F.lit(y0) + radius * F.sin(angle)).alias("y"))
