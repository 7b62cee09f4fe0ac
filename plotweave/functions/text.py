"""Scalar text functions: token estimates, tokens, trimming, similarity, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotweave.functions.rules import blank

# Separators of keyword tokens; blocks of CJK ideographs.
SEPARATORS = r"[\s，,。.!！?？;；:：、]+"
CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]"
#: A run of letters goes on through digits and punctuation until white space or an ideograph.
WORD = r"[\p{L}&&[^\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]][^\s　\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]*"


def estimate_tokens(text: Column) -> Column:
    """0.7 for each ideograph, 1.3 for each word, and one; nothing for a blank text."""
    cost = F.regexp_count(text, F.lit(CJK)) * 0.7 + F.regexp_count(text, F.lit(WORD)) * 1.3 + 1
    return F.when(blank(text), F.lit(0)).otherwise(F.floor(cost).cast("int"))


def tokens(text: Column) -> Column:
    """Keyword tokens of two characters or more, as they are written."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: F.length(w) >= 2)


def trim_middle(text: Column, head: int, tail: int, marker: str) -> Column:
    """Head and tail of a long text around a marker; null is empty."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) <= head + tail, t).otherwise(F.concat(F.substring(t, 1, head), F.lit(marker), F.right(t, F.lit(tail))))


def truncate(text: Column, most: int, marker: str = "") -> Column:
    """The first characters, then a marker; 0 leaves the text alone."""
    return text if most <= 0 else F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit(marker)))


def character_jaccard(a: Column, b: Column) -> Column:
    """Shared share of the distinct characters; 1 for equal texts."""
    x, y = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    both = F.size(F.array_union(x, y))
    return F.when(a == b, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / both)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if either vector has no length, null for vectors of different size."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), F.lit(None).cast("double")).when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def spoken_length(text: Column) -> Column:
    """Characters that are spoken: without punctuation, brackets and white space."""
    return F.length(F.regexp_replace(text, "[，。！？：；、\"“”'‘’（）\\[\\]…—\\s]", ""))


def normalised_line(text: Column) -> Column:
    return F.regexp_replace(text, "[，。！？：；、\"“”'‘’（）—…\\s]", "")


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r'[\\/:*?"<>|]', "_")


def escaped(text: Column) -> Column:
    """Backslashes and double quotes escaped; null is empty."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def scene_header(interior: Column, location: Column, time: Column) -> Column:
    return F.concat(F.when(interior, "INT").otherwise("EXT"), F.lit(". "), F.coalesce(location, F.lit("未知地点")), F.lit(" - "), F.coalesce(time, F.lit("UNKNOWN")))


def full_header(interior: Column, location: Column, time: Column, number: Column) -> Column:
    return F.concat(scene_header(interior, location, time), F.lit(" - "), number.cast("string"))


def storyboard_line(number: Column, header: Column, title: Column, summary: Column) -> Column:
    short = F.when(F.length(summary) > 60, F.concat(F.substring(summary, 1, 57), F.lit("..."))).otherwise(summary)
    return F.concat_ws(" | ", F.concat(F.lit("S"), F.lpad(number.cast("string"), 3, "0")), header, F.when(~blank(title), title), F.when(~blank(summary), short))


def cache_key(prompt: Column, model: Column, temperature: Column) -> Column:
    return F.md5(F.concat_ws("|", prompt, model, temperature.cast("string")))
