"""A whole script decoded from one completion: people, scenes, lines and actions, under any of their field names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions import rules
from plotweave.functions.extract import script_body

_PERSON = "struct<canonicalName:string,name:string,roleType:string,role:string,type:string,gender:string,description:string,personality:array<string>,relationships:array<struct<target:string,relation:string>>>"
_LINE = "struct<speaker:string,character:string,content:string,line:string,emotion:string>"
_ACTION = "struct<actionType:string,description:string>"
_SCENE = (
    "struct<sceneNumber:string,scene_id:string,id:string,index:string,location:string,timeOfDay:string,interior:boolean,title:string,summary:string,narration:string,"
    f"description:string,content:string,mood:string,characters:array<{_PERSON}>,dialogues:array<{_LINE}>,lines:array<{_LINE}>,conversations:array<{_LINE}>,actions:array<{_ACTION}>>"
)
# What stands for a field that is missing.
UNTITLED, NOBODY, NOWHERE, NEUTRAL, UNKNOWN = "未命名剧本", "未知", "未知地点", "中性", "未知"


def decoded(responses: DataFrame) -> DataFrame:
    """script_id, title and the lists of people and scenes of each completion that holds a script; others give no row."""
    body = F.from_json(script_body(F.col("text")), f"title string, characters array<{_PERSON}>, scenes array<{_SCENE}>")
    each = responses.select("script_id", body.alias("b")).where("b IS NOT NULL")
    return each.select("script_id", F.coalesce("b.title", F.lit(UNTITLED)).alias("title"), "b.characters", "b.scenes")


def _number(text: Column) -> Column:
    """The digits of a text as a number, null for none."""
    return F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit("")).try_cast("int")


def scenes(scripts: DataFrame) -> DataFrame:
    """script_id, nth (from 1), scene_number, location, time_of_day, interior, title, summary, mood of each scene."""
    each = scripts.select("script_id", F.posexplode("scenes").alias("n", "s"))
    number = F.coalesce(F.col("s.sceneNumber").try_cast("int"), _number(F.col("s.scene_id")), F.when(F.col("s.scene_id").isNull(), F.coalesce(F.col("s.id").try_cast("int"), F.col("s.index").try_cast("int"))), F.col("n") + 1)
    title = F.coalesce("s.title", F.concat(F.lit("场景"), number.cast("string")))
    summary = F.coalesce("s.summary", "s.narration", "s.description", "s.content", "s.title", F.lit(""))
    return each.select("script_id", (F.col("n") + 1).alias("nth"), number.alias("scene_number"), F.coalesce("s.location", F.lit(NOWHERE)).alias("location"), rules.time_of_day(F.col("s.timeOfDay")).alias("time_of_day"), F.coalesce("s.interior", F.lit(True)).alias("interior"), title.alias("title"), summary.alias("summary"), F.coalesce("s.mood", F.lit(NEUTRAL)).alias("mood"))


def people(scripts: DataFrame) -> DataFrame:
    """script_id, pos, canonical_name, role_type, gender, description, personality: the script's people, then those that only scenes tell of.

    Of equal names the first stays; its place counts from 0.
    """
    own = scripts.select("script_id", F.posexplode("characters").alias("n", "c")).select("script_id", F.lit(0).alias("scene"), "n", "c")
    more = scripts.select("script_id", F.posexplode("scenes").alias("k", "s")).select("script_id", (F.col("k") + 1).alias("scene"), F.posexplode("s.characters").alias("n", "c"))
    name = F.when(F.col("scene") == 0, F.coalesce("c.canonicalName", "c.name", F.lit(NOBODY))).otherwise(F.coalesce("c.name", "c.canonicalName", F.lit(NOBODY)))
    each = own.unionByName(more).select("script_id", "scene", "n", name.alias("canonical_name"), "c")
    first = each.withColumn("seen", F.row_number().over(Window.partitionBy("script_id", "canonical_name").orderBy("scene", "n"))).where("seen = 1")
    place = F.row_number().over(Window.partitionBy("script_id").orderBy("scene", "n")) - 1
    return first.select("script_id", place.alias("pos"), "canonical_name", rules.outline_role(F.coalesce("c.roleType", "c.role", "c.type")).alias("role_type"), F.coalesce("c.gender", F.lit(UNKNOWN)).alias("gender"), F.coalesce("c.description", F.lit("")).alias("description"), F.coalesce("c.personality", F.array(F.lit(UNKNOWN))).alias("personality"))


def lines(scripts: DataFrame) -> DataFrame:
    """script_id, nth (of the scene), sequence, speaker, content, emotion."""
    each = scripts.select("script_id", F.posexplode("scenes").alias("k", "s")).select("script_id", (F.col("k") + 1).alias("nth"), F.posexplode(F.coalesce("s.dialogues", "s.lines", "s.conversations")).alias("n", "d"))
    return each.select("script_id", "nth", (F.col("n") + 1).alias("sequence"), F.coalesce("d.speaker", "d.character", F.lit(NOBODY)).alias("speaker"), F.coalesce("d.content", "d.line", F.lit("")).alias("content"), rules.emotion(F.col("d.emotion")).alias("emotion"))


def actions(scripts: DataFrame) -> DataFrame:
    """script_id, nth (of the scene), sequence, action_type, description."""
    each = scripts.select("script_id", F.posexplode("scenes").alias("k", "s")).select("script_id", (F.col("k") + 1).alias("nth"), F.posexplode("s.actions").alias("n", "a"))
    return each.select("script_id", "nth", (F.col("n") + 1).alias("sequence"), F.coalesce("a.actionType", F.lit("ACTION")).alias("action_type"), F.coalesce("a.description", F.lit("")).alias("description"))


def counts(scripts: DataFrame) -> DataFrame:
    """script_id, title, and how many people, scenes and lines a script has."""
    n = lambda df, name: df.groupBy("script_id").agg(F.count(F.lit(1)).alias(name))
    out = scripts.select("script_id", "title")
    for df, name in ((people(scripts), "people"), (scenes(scripts), "scenes"), (lines(scripts), "lines")):
        out = out.join(n(df, name), "script_id", "left").fillna(0, [name])
    return out
