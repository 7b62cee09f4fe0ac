"""Display texts: script lines, headings, labels, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotweave.functions.rules import blank, stripped

# Labels, the width of a speaker's column, the place that is shown for none.
STEP_LABELS = {"CHAPTER_PARSE": "章节解析", "CHARACTER_EXTRACT": "人物抽取", "CHARACTER_RESOLVE": "人物去重", "PLOT_EXTRACT": "剧情分析", "SCENE_SEGMENT": "场景切分", "DIALOGUE_GENERATE": "对白生成", "ACTION_GENERATE": "动作生成", "SCRIPT_COMPOSE": "剧本合成", "YAML_EXPORT": "YAML 导出"}
EMOTION_LABELS = {"ANGRY": "愤怒", "HAPPY": "开心", "SAD": "悲伤", "CALM": "平静", "FEARFUL": "恐惧", "SURPRISED": "惊讶", "NEUTRAL": "中性"}
ROLE_LABELS = {"PROTAGONIST": "主角", "DEUTERAGONIST": "重要配角", "ANTAGONIST": "反派", "SUPPORTING": "配角", "MINOR": "龙套"}
WIDTH, NOWHERE = 15, "未知地点"
UNITS = ["B", "KB", "MB", "GB"]


def _column(text: Column) -> Column:
    """Filled up to WIDTH; a longer text stays whole."""
    return F.call_function("rpad", text, F.greatest(F.length(text), F.lit(WIDTH)), F.lit(" "))


def dialogue_line(speaker: Column, parenthetical: Column, content: Column) -> Column:
    """Speaker in capitals, then the aside, if any, and the words, each in a line of its own behind an empty column."""
    indent = "\n" + " " * WIDTH
    aside = F.when(blank(parenthetical), F.lit("")).otherwise(F.concat(F.lit(indent), parenthetical))
    return F.concat(_column(F.upper(speaker)), aside, F.lit(indent), content)


def shot_label(number: Column, camera: Column, angle: Column) -> Column:
    return F.concat(F.lit("Shot "), number.cast("string"), F.lit(" — "), camera, F.lit(" ("), angle, F.lit(")"))


def chapter_name(number: Column, title: Column) -> Column:
    return F.concat(F.lit("第"), number.cast("string"), F.lit("章"), F.when(blank(title), F.lit("")).otherwise(F.concat(F.lit(" "), title)))


def clean_heading(heading: Column) -> Column:
    """Without INT. or EXT. before it and an unknown time behind it."""
    bare = F.regexp_replace(heading, r"(?i)^(INT|EXT)\.\s*", "")
    bare = stripped(F.regexp_replace(F.regexp_replace(bare, r"(?i)\s*-\s*UNKNOWN\s*$", ""), r"\s*-\s*未知\s*$", ""))
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit(NOWHERE))


def time_text(time: Column) -> Column:
    """The time of day, nothing if it is unknown."""
    return F.when(F.coalesce(time, F.lit("")).isin("", "UNKNOWN", "unknown", "未知"), F.lit("")).otherwise(time)


def place_and_time(location: Column, time: Column) -> Column:
    shown = time_text(time)
    return F.concat(F.coalesce(F.nullif(location, F.lit("")), F.lit(NOWHERE)), F.when(shown.isin("", "未知"), F.lit("")).otherwise(F.concat(F.lit(" - "), shown)))


def _one_decimal(x: Column) -> Column:
    return F.round(x, 1).cast("decimal(20,1)").cast("string")


def byte_size(size: Column) -> Column:
    """In the largest unit of 1024 powers, one decimal, none if it is zero."""
    at = F.least(F.floor(F.log(1024.0, F.greatest(size, F.lit(1)))), F.lit(len(UNITS) - 1)).cast("int")
    number = F.regexp_replace(_one_decimal(size / F.pow(F.lit(1024.0), at)), r"\.0$", "")
    return F.when(size == 0, F.lit("0 B")).otherwise(F.concat(number, F.lit(" "), F.get(F.array(*map(F.lit, UNITS)), at)))


def char_count(count: Column) -> Column:
    return F.when(count >= 10_000, F.concat(_one_decimal(count / 10_000.0), F.lit(" 万字"))).otherwise(F.concat(count.cast("string"), F.lit(" 字")))
