"""Checks of dialogues, compositions and exports: one row for each issue found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions import rules
from plotweave.functions.rules import any_of, blank, intensity
from plotweave.functions.text import normalised_line, spoken_length

# Terms of the dialogue rules.
MALE = ["老子", "爷们", "本少爷", "本公子", "洒家"]
FEMALE = ["老娘", "本小姐", "本姑娘", "人家"]
EXPOSITION = ["你知道的", "如你所知", "我们认识这么多年", "你还记得吗", "让我来告诉你", "事情是这样的", "话说回来"]
CALM, HOT, COLD = ["冷静", "沉稳", "沉默"], ["暴躁", "冲动", "热情"], ["冷酷", "冷漠", "冷"]
POLITE = "[请您烦请劳烦]"
MOST_SPOKEN, LONG = 50, 80


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def dialogue_issues(lines: DataFrame) -> DataFrame:
    """scene_id, sequence, speaker, severity, type, fragment.

    lines: (scene_id, sequence, speaker, content, emotion, gender, personality), profile columns
    null for unknown speakers. The per-line rules are one array built in one pass; repetition
    needs the scene's order.
    """
    text = F.col("content")
    has = lambda words: F.exists(F.coalesce("personality", F.array().cast("array<string>")), lambda p: any_of(p, words))
    issue = lambda when, severity, kind, fragment=None: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("type"), F.lit(fragment).cast("string").alias("fragment") if fragment is None or isinstance(fragment, str) else fragment.alias("fragment")))
    gender = F.upper("gender")
    found = [issue((gender == "FEMALE") & text.contains(t), "ERROR", "GENDER_MISMATCH", t) for t in MALE]
    found += [issue((gender == "MALE") & text.contains(t), "ERROR", "GENDER_MISMATCH", t) for t in FEMALE]
    found += [
        issue(has(CALM) & ~has(HOT) & (F.regexp_count(text, F.lit("[！!]")) >= 2), "WARNING", "PERSONALITY_MISMATCH"),
        issue(has(HOT) & text.rlike(POLITE), "WARNING", "PERSONALITY_MISMATCH"),
        issue(spoken_length(text) > MOST_SPOKEN, "WARNING", "LINE_TOO_LONG"),
        issue(any_of(text, EXPOSITION), "INFO", "EXPOSITION_DUMP", rules.first_label(text, [(w, [w]) for w in EXPOSITION])),
        issue((F.length(text) > LONG) & text.contains("因为") & text.contains("所以"), "INFO", "EXPOSITION_DUMP"),
        issue(has(COLD) & (intensity(F.col("emotion")) >= 7) & (F.col("emotion") != "ANGRY"), "WARNING", "EMOTION_INCONSISTENT"),
    ]
    said = lines.where(~blank(text))
    each = said.select("scene_id", "sequence", "speaker", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("i")).select("scene_id", "sequence", "speaker", "i.severity", "i.type", "i.fragment")
    w = Window.partitionBy("scene_id", "norm").orderBy("sequence")
    short = F.when(F.length(text) > 30, F.concat(F.substring(text, 1, 30), F.lit("..."))).otherwise(text)
    again = said.withColumn("norm", normalised_line(text)).withColumn("nth", F.row_number().over(w)).where("nth > 1")
    again = again.select("scene_id", "sequence", "speaker", F.lit("WARNING").alias("severity"), F.lit("REPETITION").alias("type"), short.alias("fragment"))
    return each.unionByName(again)


def actionable(issues: DataFrame) -> DataFrame:
    return issues.where(F.col("severity").isin("ERROR", "WARNING"))


def issue_summary(issues: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s)
    return issues.groupBy("type").agg(F.count(F.lit(1)).alias("n"), n("ERROR").alias("errors"), n("WARNING").alias("warnings"), n("INFO").alias("infos"))


#: Missing numbers of a gap that are told one by one; the others are told as a range.
GAP = 1000


def integrity(scenes: DataFrame, dialogues: DataFrame, actions: DataFrame, characters: DataFrame) -> DataFrame:
    """script_id, rule, subject of each break of the composition's integrity."""
    row = lambda df, rule, subject, key="script_id": df.select(F.col(key).alias("script_id"), F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"))
    none = F.lit(None).cast("bigint")
    at = scenes.select("scene_id", "script_id")
    said = dialogues.drop("script_id").join(at, "scene_id", "left")
    done = actions.drop("script_id").join(at, "scene_id", "left")
    known = characters.select("script_id", "character_id")
    unknown = said.where("character_id IS NOT NULL AND script_id IS NOT NULL").join(known, ["script_id", "character_id"], "left_anti")
    # Gaps between a number and the one before it; a stray large number is one gap of GAP rows at most, then one row for the rest.
    order = Window.partitionBy("script_id").orderBy("scene_number")
    gaps = scenes.where("scene_number >= 1").select("script_id", "scene_number").distinct().withColumn("below", F.lag("scene_number", 1, 0).over(order)).where("scene_number > below + 1")
    missing = gaps.select("script_id", F.explode(F.sequence(F.col("below") + 1, F.least(F.col("scene_number") - 1, F.col("below") + GAP))).alias("scene_number")).withColumn("scene_number", F.col("scene_number").cast("string"))
    rest = gaps.where(F.col("scene_number") - 1 > F.col("below") + GAP).select("script_id", F.concat_ws("-", F.col("below") + GAP + 1, F.col("scene_number") - 1).alias("scene_number"))
    cast = scenes.select("script_id", "scene_id", F.explode("character_ids").alias("character_id")).join(known, ["script_id", "character_id"], "left_anti")
    return _all(
        [
            row(said.where("script_id IS NOT NULL AND character_id IS NULL"), "unresolved_speaker", "dialogue_id"),
            row(unknown, "unknown_speaker", "dialogue_id"),
            row(scenes.where("coalesce(size(character_ids), 0) <= 0"), "scene_without_characters", "scene_id"),
            row(scenes.where("coalesce(size(chapter_ids), 0) <= 0"), "scene_without_chapters", "scene_id"),
            row(said.where("script_id IS NULL").withColumn("script_id", none), "orphan_dialogue", "dialogue_id"),
            row(done.where("script_id IS NULL").withColumn("script_id", none), "orphan_action", "action_id"),
            row(scenes.groupBy("script_id", "scene_number").count().where("count > 1"), "duplicate_scene_number", "scene_number"),
            row(missing.unionByName(rest), "missing_scene_number", "scene_number"),
            row(cast, "unknown_scene_character", "character_id"),
        ]
    )


def export_issues(scripts: DataFrame) -> DataFrame:
    """script_id, issue of assembled scripts (title, characters, scenes with dialogues and actions)."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    own = [F.when(blank(F.col("title")), F.lit("title")), F.when(size("characters") <= 0, F.lit("characters")), F.when(size("scenes") <= 0, F.lit("scenes"))]
    of = lambda name, test, label: F.transform(F.filter(F.coalesce(name, F.array()), test), lambda x: F.lit(label))
    more = [
        of(F.col("characters"), lambda c: c["canonical_name"].isNull() | (F.trim(c["canonical_name"]) == ""), "character_name"),
        of(F.col("scenes"), lambda s: s["location"].isNull() | (F.trim(s["location"]) == ""), "scene_location"),
        of(F.col("scenes"), lambda s: (size(s["dialogues"]) <= 0) & (size(s["actions"]) <= 0), "scene_sequence"),
    ]
    listed = F.concat(F.filter(F.array(*own), lambda x: x.isNotNull()), *more)
    return scripts.select("script_id", F.explode(listed).alias("issue"))


def template_issues(rows: DataFrame, checks: list[tuple[str, str, str | None]]) -> DataFrame:
    """row_id, field, rule of values that break notBlank, notNull or enum_match rules; other rules are not evaluated."""
    found: list[Column] = []
    for field, rule, allowed in checks:
        bad = {"notBlank": blank(F.col(field)), "notNull": F.col(field).isNull()}.get(rule)
        if rule == "enum_match":
            bad = F.col(field).isNotNull() & ~F.upper(field).isin([x.strip().upper() for x in (allowed or "").split(",")])
        if bad is not None:
            found.append(F.when(bad, F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule"))))
    return rows.select("row_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("i")).select("row_id", "i.field", "i.rule")


def requests(rows: DataFrame) -> DataFrame:
    """Requests with what is wrong: max_scenes outside 1..100, blank title or author."""
    wrong = F.array(F.when(~F.coalesce(F.col("max_scenes").between(1, 100), F.lit(False)), F.lit("max_scenes")), F.when(blank(F.col("title")), F.lit("title")), F.when(blank(F.col("author")), F.lit("author")))
    return rows.withColumn("wrong", F.filter(wrong, lambda x: x.isNotNull()))
