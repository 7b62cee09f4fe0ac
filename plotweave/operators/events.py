"""Plot events: the same event told twice, merging, timeline stages and summary."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions.text import character_jaccard
from plotweave.operators.linking import within
from plotweave.sources.shared import stored

SIMILAR = 0.70
#: Positions at which a stage ends.
STAGES = [("EXPOSITION", 0.20), ("RISING_ACTION", 0.60), ("CLIMAX", 0.70), ("FALLING_ACTION", 0.85), ("RESOLUTION", 2.0)]


def is_critical(importance: Column) -> Column:
    return importance >= 4


def is_minor(importance: Column) -> Column:
    return importance <= 2


def is_cross_chapter(ids: Column) -> Column:
    return F.coalesce(F.size(ids) > 1, F.lit(False))


def is_rising(arc: Column) -> Column:
    return F.coalesce(arc.rlike("[↑↗]"), F.lit(False))


def is_falling(arc: Column) -> Column:
    return F.coalesce(arc.rlike("[↓↘]"), F.lit(False))


def same_event(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Equal, contained or similar titles (without white space), or the same place and time."""
    x, y = (F.regexp_replace(e["title"], r"\s+", "") for e in (a, b))
    titles = (a["title"] == b["title"]) | x.contains(y) | y.contains(x) | (character_jaccard(x, y) > SIMILAR)
    place = (a["location"] == b["location"]) & (a["time_point"] == b["time_point"])
    return F.coalesce(titles, F.lit(False)) | F.coalesce(place, F.lit(False))


def titles(events: DataFrame) -> DataFrame:
    """script_id, x, chars: the distinct titles without white space, with their distinct characters, rarest in the script first."""
    x = events.where("title IS NOT NULL").select("script_id", F.regexp_replace("title", r"\s+", "").alias("x")).distinct()
    each = x.select("script_id", "x", F.explode(F.array_distinct(F.split("x", ""))).alias("c")).where("c <> ''")
    df = each.groupBy("script_id", "c").agg(F.count(F.lit(1)).alias("n"))
    ranked = each.join(df, ["script_id", "c"]).groupBy("script_id", "x").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "c"))), lambda v: v["c"]).alias("chars"))
    return ranked  # an empty title has no characters, and is contained in every other


def similar_titles(titles: DataFrame, similarity: float = SIMILAR) -> DataFrame:
    """script_id, x, y (x < y): distinct titles whose characters have a Jaccard similarity above `similarity`.

    Similar sets share one of their rarest characters: of n characters an overlap needs more than
    similarity * n, so the first n - floor(similarity * n) of them, in an order that all titles of a
    script have, hold one in common. Titles meet on those alone, with where they have it: what is
    left behind the place, and the sizes, bound the overlap before characters are compared.
    """
    n = F.size("chars")
    prefix = n - F.floor(n * F.lit(similarity) + F.lit(1e-9)).cast("int")
    keys = titles.select("script_id", "x", "chars", n.alias("n"), F.posexplode(F.slice("chars", F.lit(1), prefix)).alias("at", "c"))
    a, b = keys.alias("a"), keys.alias("b")
    c = F.col
    rest = F.least(c("a.n") - c("a.at"), c("b.n") - c("b.at"))
    possible = (c("a.x") < c("b.x")) & (F.least("a.n", "b.n") > similarity * F.greatest("a.n", "b.n") - 1e-9)
    met = a.join(b, (c("a.script_id") == c("b.script_id")) & (c("a.c") == c("b.c")) & possible)
    # Only the first common character of a pair tells it, so no pair is compared twice.
    before = F.size(F.array_intersect(F.slice("a.chars", F.lit(1), c("a.at")), F.slice("b.chars", F.lit(1), c("b.at")))) == 0
    met = met.where(before & (rest >= similarity / (1 + similarity) * (c("a.n") + c("b.n")) - 1e-9))
    both = F.size(F.array_intersect("a.chars", "b.chars"))
    return met.where(both / (c("a.n") + c("b.n") - both) > similarity).select(c("a.script_id").alias("script_id"), c("a.x").alias("x"), c("b.x").alias("y"))


def same_titles(events: DataFrame) -> DataFrame:
    """script_id, x, y: pairs of titles (without white space) of a script that tell the same event, each title with itself, in both orders."""
    # Kept, as they are read several times: nothing after this makes the events again.
    bare = stored(events.where("title IS NOT NULL").select("script_id", F.regexp_replace("title", r"\s+", "").alias("x")).distinct(), "titles")
    similar = similar_titles(stored(titles(bare.withColumnRenamed("x", "title")), "title-characters"))
    inside = within(bare.select("script_id", F.col("x").alias("inner")), bare.select("script_id", F.col("x").alias("outer"))).select("script_id", F.col("inner").alias("x"), F.col("outer").alias("y"))
    one = similar.unionByName(inside)
    return one.unionByName(one.select("script_id", F.col("y").alias("x"), F.col("x").alias("y"))).distinct()


def _links(a: DataFrame, b: DataFrame) -> DataFrame:
    """script_id, a, b: events of a and of b (script_id, event_order, title, location, time_point) that are the same."""
    side = lambda df, order, x: df.select("script_id", F.col("event_order").alias(order), F.regexp_replace("title", r"\s+", "").alias(x), "location", "time_point")
    left, right = side(a, "a", "x"), side(b, "b", "y")
    both = a.select("script_id", "title").unionByName(b.select("script_id", "title")) if a is not b else a
    by_title = left.join(same_titles(both), ["script_id", "x"]).join(right.select("script_id", "b", "y"), ["script_id", "y"]).select("script_id", "a", "b")
    by_place = left.where("location IS NOT NULL AND time_point IS NOT NULL").join(right.select("script_id", "b", "location", "time_point"), ["script_id", "location", "time_point"]).select("script_id", "a", "b")
    return by_title.unionByName(by_place).distinct()


def same_pairs(events: DataFrame) -> DataFrame:
    """script_id, a, b (event orders a < b) of events told twice; compared within a script.

    Titles are compared, not events: each distinct one once, by characters (similar_titles) and
    by containment (linking.within). The same place and time is an equi join of its own.
    """
    slim = events.select("script_id", "event_order", "title", "location", "time_point")
    return _links(slim, slim).where("a < b")


def first_same(existing: DataFrame, found: DataFrame) -> DataFrame:
    """script_id, a, b: of each new event (order b) the first existing one (order a) that is the same, or null."""
    links = _links(existing.select("script_id", "event_order", "title", "location", "time_point"), found.select("script_id", "event_order", "title", "location", "time_point"))
    best = links.groupBy("script_id", "b").agg(F.min("a").alias("a"))
    return found.select("script_id", F.col("event_order").alias("b")).join(best, ["script_id", "b"], "left").select("script_id", "a", "b")


_MERGED = "script_id bigint, event_order int, title string, description string, location string, time_point string, conflict_type string, importance int, emotional_arc string, chapter_ids array<bigint>, character_ids array<bigint>"
_FIRST = ("location", "time_point", "conflict_type", "emotional_arc")


def _twice(a: dict, b: dict) -> bool:
    if a["title"] is not None and b["title"] is not None:
        x, y = ("".join(t.split()) for t in (a["title"], b["title"]))
        if x in y or y in x:
            return True
        both = set(x) | set(y)
        if both and len(set(x) & set(y)) / len(both) > SIMILAR:
            return True
    return a["location"] is not None and a["location"] == b["location"] and a["time_point"] is not None and a["time_point"] == b["time_point"]


def _joined(a: dict, b: dict) -> dict:
    out = dict(a)
    out["chapter_ids"] = sorted({*a["chapter_ids"], *b["chapter_ids"]})
    out["character_ids"] = list(dict.fromkeys([*a["character_ids"], *b["character_ids"]]))
    out["importance"] = max(a["importance"], b["importance"])
    out["description"] = "；".join(x for x in (a["description"], b["description"]) if x) or None
    for c in _FIRST:
        out[c] = a[c] if a[c] is not None else b[c]
    return out


def merged(events: DataFrame) -> DataFrame:
    """Events of a script with later tellings taken into the first, renumbered.

    Greedy and in order, and what is compared onward is the merged event, so this is a fold
    over one script's events and not connected components.
    """
    columns = [x.split()[0] for x in _MERGED.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rest = [{k: (list(v) if isinstance(v, list) or hasattr(v, "tolist") else (None if v is None or v != v else v)) for k, v in r.items()} for r in pdf.sort_values("event_order").to_dict("records")]
        for r in rest:
            r["chapter_ids"], r["character_ids"] = list(r["chapter_ids"] or []), list(r["character_ids"] or [])
        out = []
        while rest:
            base, later = rest[0], []
            for other in rest[1:]:
                if _twice(base, other):
                    base = _joined(base, other)
                else:
                    later.append(other)
            out.append(base)
            rest = later
        out.sort(key=lambda r: r["event_order"])
        for k, r in enumerate(out):
            r["event_order"] = k + 1
        return pd.DataFrame(out, columns=columns)

    return events.select(*columns).groupBy("script_id").applyInPandas(run, _MERGED)


def told_again(a: str, b: str) -> list[Column]:
    """The columns of the event that struct a, told again as struct b, makes: what a lacks is b's, lists are united, the importance is the higher one."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    none = F.array().cast("array<bigint>")
    ids = lambda e, c: F.coalesce(e(c), none)
    both = F.filter(F.array(x("description"), y("description")), lambda d: d.isNotNull() & (d != ""))
    description = F.when(F.size(both) > 0, F.array_join(both, "；"))
    return [
        x("title").alias("title"),
        description.alias("description"),
        *(F.coalesce(x(c), y(c)).alias(c) for c in _FIRST),
        F.greatest(x("importance"), y("importance")).alias("importance"),
        F.array_sort(F.array_distinct(F.concat(ids(x, "chapter_ids"), ids(y, "chapter_ids")))).alias("chapter_ids"),
        F.array_distinct(F.concat(ids(x, "character_ids"), ids(y, "character_ids"))).alias("character_ids"),
    ]


def merged_into(existing: DataFrame, found: DataFrame) -> DataFrame:
    """New events taken into a script's existing ones, renumbered by their orders, existing ones first of equals.

    A new event goes into the first existing one that is the same, compared as both were told; of
    several that go into one, the first does and the others are left out. All others are added.
    Joins within scripts, no fold: a script may have any number of events.
    """
    columns = [x.split()[0] for x in _MERGED.split(", ")]
    body = [c for c in columns if c not in ("script_id", "event_order")]
    links = stored(first_same(existing, found), "first-same")
    taken = links.where("a IS NOT NULL").groupBy("script_id", "a").agg(F.min("b").alias("b"))
    new = found.select("script_id", F.col("event_order").alias("b"), F.struct(*body).alias("y"))
    old = existing.select("script_id", F.col("event_order").alias("a"), F.struct(*body).alias("x")).join(taken, ["script_id", "a"], "left").join(new, ["script_id", "b"], "left")
    again = old.where("b IS NOT NULL").select("script_id", F.col("a").alias("event_order"), *told_again("x", "y"))
    alone = old.where("b IS NULL").select("script_id", F.col("a").alias("event_order"), "x.*")
    added = new.join(links.where("a IS NULL").select("script_id", "b"), ["script_id", "b"]).select("script_id", F.col("b").alias("event_order"), "y.*")
    every = again.unionByName(alone).withColumn("_new", F.lit(0)).unionByName(added.withColumn("_new", F.lit(1)))
    order = Window.partitionBy("script_id").orderBy("event_order", "_new")
    return every.withColumn("event_order", F.row_number().over(order)).select(*columns)


def staged(events: DataFrame) -> DataFrame:
    """Events with their narrative stage by place, moved by a rising or falling arc."""
    w = Window.partitionBy("script_id")
    place = (F.row_number().over(w.orderBy("event_order")) - 1) / F.count(F.lit(1)).over(w)
    out = F.lit(STAGES[-1][0])
    for name, end in reversed(STAGES[:-1]):
        out = F.when(F.col("place") < end, F.lit(name)).otherwise(out)
    early, late = F.col("place") < STAGES[1][1], F.col("place") >= STAGES[2][1]
    moved = F.when(is_rising(F.col("emotional_arc")) & early, F.lit("RISING_ACTION")).when(is_falling(F.col("emotional_arc")) & late, F.lit("FALLING_ACTION")).otherwise(out)
    return events.withColumn("place", place).withColumn("stage", moved).drop("place")


def summary(events: DataFrame) -> DataFrame:
    """A row a script: critical events, modal conflict (ties: first name), chapters, and the climax.

    The climax has the highest importance, then a rising arc; the last of equals.
    """
    rank = F.struct("importance", is_rising(F.col("emotional_arc")).cast("int").alias("r"), "event_order")
    main = events.groupBy("script_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum(is_critical(F.col("importance")).cast("bigint")).alias("critical"),
        F.size(F.array_distinct(F.flatten(F.collect_set("chapter_ids")))).cast("bigint").alias("chapters"),
        F.max_by("title", rank).alias("climax"),
    )
    each = events.where("conflict_type IS NOT NULL").groupBy("script_id", "conflict_type").agg(F.count(F.lit(1)).alias("n"))
    mode = each.groupBy("script_id").agg(F.min_by("conflict_type", F.struct((-F.col("n")).alias("n"), "conflict_type")).alias("dominant_conflict"))
    return main.join(mode, "script_id", "left")


def stage_counts(events: DataFrame) -> DataFrame:
    return staged(events).groupBy("script_id", "stage").agg(F.count(F.lit(1)).alias("n"))
