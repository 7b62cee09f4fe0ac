"""Chapters of a novel: header lines, types, segmentation and the table of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions.rules import blank, stripped

# Header patterns, the first alternative that matches wins, and what may follow one.
_NUMERAL = "[0-9零一二三四五六七八九十百千万]+"
_ALTERNATIVES = [
    rf"第\s*{_NUMERAL}\s*[章回卷节]",
    rf"第?\s*{_NUMERAL}\s*卷\s*.*[章回]",
    "(?:序|楔|引|前)[章子言]?",
    "终[章篇结]?",
    "尾[声章]?",
    "番外[篇章]?",
    "后记",
    "补遗",
    r"Chapter\s+\d+",
    r"CHAPTER\s+[IVXLCDM]+",
    r"(?:Vol|Volume)\.?\s*\d+",
    "[Pp]rologue",
    "[Ee]pilogue",
    "[Ii]nterlude",
]
_BOUNDARY = r"(?=$|[\s　，。！？、：；（）《》「」『』【】—…～·.,!?:;()\[\]{}\-\"'/\\|@#$%^&*+=<>~`_])"
#: The atomic group keeps the first alternative: if no boundary follows it, others are not tried.
_PRIMARY = "^(?>" + "|".join(_ALTERNATIVES) + ")" + _BOUNDARY
_DECORATION = r"^[-=*_#~]{3,}$"
_OUTLINE = "^[零一二三四五六七八九十百千万]+[、]\\s*.{1,60}$"
_NUMBERED = r"^\d+[.)、]\s*(?=.{1,40}$).{1,60}$"
TYPES = [("PROLOGUE", "^(?:序|楔|引|前|prologue|foreword)"), ("EPILOGUE", "^(?:终|尾|epilogue|afterword|后记|结语|补遗)"), ("INTERLUDE", "^(?:番外|interlude|外传|特别篇)")]
#: White space as SQL's patterns have it.
WHITE = r"[\t\n\f\r 　]"
PREAMBLE, WHOLE = "序章", "第1章"


def is_header(line: Column) -> Column:
    t = stripped(line)
    return ~blank(line) & ~t.rlike(_DECORATION) & (t.rlike(_PRIMARY) | t.rlike(_OUTLINE) | t.rlike(_NUMBERED))


def chapter_type(header: Column) -> Column:
    low = F.lower(stripped(header))
    out = F.lit("NORMAL")
    for name, pattern in reversed(TYPES):
        out = F.when(low.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def split_lines(novels: DataFrame, key: str = "novel_id", content: str = "content") -> DataFrame:
    """key, line_no and line of each line, without a shuffle; what follows the last line feed is a line only if it is not empty."""
    each = novels.select(key, F.posexplode(F.split(content, "\n")).alias("line_no", "line"), F.size(F.split(content, "\n")).alias("_n"))
    return each.where(~((F.col("line_no") == F.col("_n") - 1) & (F.col("line") == ""))).drop("_n")


def lines(novels: DataFrame, key: str = "novel_id", content: str = "content") -> DataFrame:
    """key, line_no, line and offset of each line, which counts one character for its end.

    The only shuffle is by novel, for the running sum of lengths.
    """
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return split_lines(novels, key, content).withColumn("offset", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("bigint"))


def contents(novels: DataFrame, key: str = "novel_id", content: str = "content") -> DataFrame:
    """Table of contents: key, line_no, title, type, offset of each header line."""
    return lines(novels, key, content).where(is_header(F.col("line"))).select(key, "line_no", stripped(F.col("line")).alias("title"), chapter_type(F.col("line")).alias("type"), "offset")


def chapters(novels: DataFrame, key: str = "novel_id", content: str = "content") -> DataFrame:
    """key, chapter_number, title, type, content, char_count, start_offset, end_offset.

    A header line belongs to its chapter. Text before the first header is a prologue if it is
    not blank; without any header the whole text is one chapter. Blank texts have none.
    """
    each = lines(novels, key, content).withColumn("head", is_header(F.col("line")))
    upto = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = each.withColumn("part", F.sum(F.col("head").cast("int")).over(upto))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "")
    made = part.groupBy(key, "part").agg(text.alias("content"), F.min("offset").alias("start_offset"), F.max(F.when(F.col("head"), F.struct("line_no", "line"))).alias("h"))
    made = made.where((F.col("part") > 0) | ~blank(F.col("content")))
    whole = Window.partitionBy(key)
    made = made.withColumn("_parts", F.max("part").over(whole))
    title = F.when(F.col("part") > 0, stripped(F.col("h.line"))).when(F.col("_parts") > 0, F.lit(PREAMBLE)).otherwise(F.lit(WHOLE))
    kind = F.when(F.col("part") > 0, chapter_type(F.col("h.line"))).when(F.col("_parts") > 0, F.lit("PROLOGUE")).otherwise(F.lit("NORMAL"))
    return made.select(
        key,
        F.row_number().over(Window.partitionBy(key).orderBy("part")).alias("chapter_number"),
        title.alias("title"),
        kind.alias("type"),
        "content",
        F.length("content").alias("char_count"),
        "start_offset",
        (F.col("start_offset") + F.length("content")).alias("end_offset"),
    )


def whole(texts: DataFrame, key: str = "novel_id", content: str = "content") -> DataFrame:
    """The same columns, each text being one chapter whatever its lines are, and with them the other columns of texts.

    Every row is a chapter of its own, blank ones and those of equal or null keys too; a null text has no length.
    """
    t = F.col(content)
    full = F.when(t.endswith("\n"), t).otherwise(F.concat(t, F.lit("\n")))
    made = texts.withColumn("_content", full)
    others = [c for c in texts.columns if c not in (key, content)]
    return made.select(
        key,
        F.lit(1).alias("chapter_number"),
        F.lit(WHOLE).alias("title"),
        F.lit("NORMAL").alias("type"),
        F.col("_content").alias("content"),
        F.length("_content").alias("char_count"),
        F.lit(0).cast("bigint").alias("start_offset"),
        F.length("_content").cast("bigint").alias("end_offset"),
        *others,
    )


def novel(chapters_: DataFrame, key: str = "novel_id") -> DataFrame:
    """One row a novel: totals and status; a novel without chapters has none."""
    return chapters_.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("chapter_count"), F.sum("char_count").cast("bigint").alias("total_chars")).withColumn("status", F.lit("PARSED"))


def processable(novels: DataFrame) -> DataFrame:
    return novels.where("status = 'PARSED' AND chapter_count >= 3")
