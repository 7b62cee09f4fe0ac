"""Scenes and their lines: order, numbering, assembly, statistics, states, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.operators.order import placed


def interleaved(dialogues: DataFrame, actions: DataFrame, dialogue_first: bool = False) -> DataFrame:
    """scene_id, sequence, item_type, item_id, speaker, text of both kinds; ties: actions first unless said otherwise."""
    said = dialogues.select("scene_id", "sequence", F.lit("DIALOGUE").alias("item_type"), F.col("dialogue_id").alias("item_id"), "speaker", F.col("content").alias("text"))
    done = actions.select("scene_id", "sequence", F.lit("ACTION").alias("item_type"), F.col("action_id").alias("item_id"), F.lit(None).cast("string").alias("speaker"), F.col("description").alias("text"))
    first = "DIALOGUE" if dialogue_first else "ACTION"
    kind = F.when(F.col("item_type") == first, 0).otherwise(1)
    w = Window.partitionBy("scene_id").orderBy("sequence", kind, "item_id")
    return said.unionByName(done).withColumn("position", F.row_number().over(w))


def renumbered(rows: DataFrame, group: str, order: list[str], into: str, step: int = 1) -> DataFrame:
    """A dense numbering within a group, in steps."""
    return rows.withColumn(into, F.row_number().over(Window.partitionBy(group).orderBy(*order)) * step)


def replies(lines: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """A line without reply_to answers the line before it."""
    return lines.withColumn("reply_to", F.coalesce("reply_to", F.lag(key).over(Window.partitionBy(group).orderBy(order))))


def last_lines(lines: DataFrame, group: str, order: str, n: int = 3) -> DataFrame:
    """The last n lines of each group; WindowGroupLimit keeps n rows before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc(order))
    return lines.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def previous_scene_lines(scenes: DataFrame, lines: DataFrame, n: int = 3) -> DataFrame:
    """scene_id and the last n lines of the scene numbered before it in its script."""
    w = Window.partitionBy("script_id").orderBy("scene_number", "scene_id")
    before = scenes.select("scene_id", F.lag("scene_id").over(w).alias("previous")).where("previous IS NOT NULL")
    return before.join(last_lines(lines, "scene_id", "sequence", n).withColumnRenamed("scene_id", "previous"), "previous")


def repeated(lines: DataFrame, group: str, order: str, norm: Column) -> DataFrame:
    """Second and later occurrences of a normalised text in its group."""
    w = Window.partitionBy(group, "norm").orderBy(order)
    return lines.withColumn("norm", norm).withColumn("nth", F.row_number().over(w)).where("nth > 1")


def split_reasons(scenes: DataFrame, events: DataFrame) -> DataFrame:
    """Why each scene but the first begins: given reason, or place, time, people, conflict, chapter."""
    w = Window.partitionBy("script_id").orderBy("scene_number", "scene_id")
    crossing = events.where("conflict_type IS NOT NULL AND size(chapter_ids) > 1").select("script_id").distinct().withColumn("crossing", F.lit(True))
    each = scenes.join(crossing, "script_id", "left")
    before = lambda c: F.lag(c).over(w)
    overlap = F.size(F.array_intersect("character_ids", "_ids")) / F.greatest(F.size("character_ids"), F.size("_ids"))
    each = each.withColumns({"_place": before("location"), "_time": before("time_of_day"), "_ids": before("character_ids"), "_nth": F.row_number().over(w)})
    reason = (
        F.when(F.col("_nth") == 1, F.col("source_reason"))
        .when(F.col("source_reason").isNotNull(), F.col("source_reason"))
        .when(F.col("location") != F.col("_place"), F.lit("LOCATION"))
        .when(~F.col("time_of_day").eqNullSafe(F.col("_time")), F.lit("TIME"))
        .when((F.greatest(F.size("character_ids"), F.size("_ids")) > 0) & (overlap < 0.5), F.lit("CHARACTER"))
        .when(F.coalesce("crossing", F.lit(False)), F.lit("CONFLICT"))
        .otherwise(F.lit("CHAPTER_BOUNDARY"))
    )
    return each.withColumn("source_reason", reason).drop("_place", "_time", "_ids", "_nth", "crossing")


def assembled(scripts: DataFrame, characters: DataFrame, scenes: DataFrame, dialogues: DataFrame, actions: DataFrame) -> DataFrame:
    """A row a script with its people and scenes nested in order, and the scenes' lines in them."""
    nested = lambda df, order, name: df.groupBy(name[0]).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in (*order, name[0])]))).alias(name[1]))
    of_scene = scenes.join(nested(dialogues, ["sequence", "dialogue_id"], ("scene_id", "dialogues")), "scene_id", "left").join(nested(actions, ["sequence", "action_id"], ("scene_id", "actions")), "scene_id", "left")
    out = scripts.join(nested(characters, ["pos"], ("script_id", "characters")), "script_id", "left")
    return out.join(nested(of_scene, ["scene_number", "scene_id"], ("script_id", "scenes")), "script_id", "left")


def statistics(scripts: DataFrame, characters: DataFrame, scenes: DataFrame, dialogues: DataFrame) -> DataFrame:
    """script_id with counts of scenes, people and lines; aggregates first, then small joins."""
    n = lambda df, name: df.groupBy("script_id").agg(F.count(F.lit(1)).alias(name))
    of_scene = dialogues.groupBy("scene_id").agg(F.count(F.lit(1)).alias("d"))
    per_scene = scenes.join(of_scene, "scene_id", "left").groupBy("script_id").agg(F.count(F.lit(1)).alias("scene_count"), F.coalesce(F.sum("d"), F.lit(0)).cast("bigint").alias("dialogue_count"))
    out = scripts.select("script_id").join(per_scene, "script_id", "left").join(n(characters, "character_count"), "script_id", "left")
    return out.select("script_id", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("scene_count", "character_count", "dialogue_count")))


def terminal_status(scenes: DataFrame, group: str = "script_id") -> DataFrame:
    """COMPLETED, or with warnings if a scene's lines or actions failed; the failed scenes' ids."""
    bad_d, bad_a = F.col("dialogue_status") == "FAILED", F.col("action_status") == "FAILED"
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    out = scenes.groupBy(group).agg(n(bad_d).alias("failed_dialogues"), n(bad_a).alias("failed_actions"), F.array_sort(F.collect_set(F.when(bad_d | bad_a, F.col("scene_id")))).alias("failed_scenes"))
    return out.withColumn("status", F.when(F.col("failed_dialogues") + F.col("failed_actions") > 0, F.lit("COMPLETED_WITH_WARNINGS")).otherwise(F.lit("COMPLETED")))


def pending_state(scenes: DataFrame, rows: DataFrame, kind: str) -> DataFrame:
    """none, patched or open for each scene and kind: failed scenes are patched once a manual row exists."""
    manual = rows.groupBy("scene_id").agg(F.count_if(F.col("source") == "MANUAL").alias("manual"))
    state = F.when(F.coalesce(F.col(f"{kind}_status") == "FAILED", F.lit(False)), F.when(F.coalesce("manual", F.lit(0)) > 0, F.lit("patched")).otherwise(F.lit("open"))).otherwise(F.lit("none"))
    return scenes.join(manual, "scene_id", "left").select("scene_id", F.coalesce("manual", F.lit(0)).alias("manual"), state.alias("state"))


def exportable(scripts: DataFrame) -> DataFrame:
    return scripts.where(F.col("status").isin("COMPLETED", "COMPLETED_WITH_WARNINGS"))


def quality(dialogues: DataFrame) -> DataFrame:
    """Share of generated lines in percent, and lines a scene."""
    return dialogues.agg((F.count_if(F.col("source") == "AI") * 100.0 / F.count(F.lit(1))).alias("ai_share"), (F.count(F.lit(1)) / F.count_distinct("scene_id")).alias("lines_a_scene"))


def insertions_at(insertions: DataFrame, scene_index: int | None) -> DataFrame:
    """Insertions before the first scene (None) or after the scene of this index, from 0."""
    return insertions.where(F.col("position") == (0 if scene_index is None else scene_index + 1))


def replaced(rows: DataFrame, fresh: DataFrame, group: str, key: str) -> DataFrame:
    """All rows of the groups in `fresh` replaced by it; keys follow the largest one of all, in the order of groups and then of the other columns."""
    kept = rows.join(fresh.select(group).distinct(), group, "left_anti")
    last = rows.agg(F.coalesce(F.max(key), F.lit(0)).alias("last"))
    order = [group, *(c for c in fresh.columns if c not in (group, key))]
    numbered = placed(fresh.drop(key), "_n", *order).crossJoin(F.broadcast(last)).withColumn(key, (F.col("last") + F.col("_n")).cast(rows.schema[key].dataType))  # one row
    return kept.unionByName(numbered.select(*rows.columns))


def patched(rows: DataFrame, patch: DataFrame, key: str, fields: list[str], manual: bool = False) -> DataFrame:
    """Fields that a patch row gives replace those of the row; `manual` stamps the row as edited by hand."""
    told = patch.select(key, *(F.col(c).alias(f"_{c}") for c in fields), F.lit(True).alias("_hit"))
    out = rows.join(told, key, "left")
    new = {c: F.coalesce(f"_{c}", c) for c in fields}
    if manual:
        new["source"] = F.when(F.col("_hit"), F.lit("MANUAL")).otherwise(F.col("source"))
    return out.withColumns(new).drop("_hit", *(f"_{c}" for c in fields))


def upserted(rows: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    return rows.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def deleted(tables: dict[str, tuple[DataFrame, str, str | None]], root: str, ids: DataFrame) -> dict[str, DataFrame]:
    """Rows left after deleting ids of the root table and all that hangs on them.

    tables: name -> (rows, key, parent table or None), parents before children; a child's column
    of its parent's key is named like that key.
    """
    gone = {root: ids}
    out = {}
    for name, (rows, key, parent) in tables.items():
        if name == root:
            dead = ids
        elif parent in gone:
            parent_key = tables[parent][1]
            dead = rows.join(gone[parent], parent_key, "left_semi").select(key)
        else:
            out[name] = rows
            continue
        gone[name] = dead
        out[name] = rows.join(dead, key, "left_anti")
    return out
