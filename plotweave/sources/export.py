"""Screenplay sinks: YAML, plain text and Markdown, one text a script.

Texts are put together from assembled scripts with array functions, so a script is one row of
one task and no Python runs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.functions.rules import LABEL_ACTION, LABEL_EMOTION, blank, labelled
from plotweave.functions.text import escaped, safe_file_name, scene_header
from plotweave.sources.shared import delete


def _s(*parts) -> Column:
    """Concatenation; a missing part is empty."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def _each(array: Column, make) -> Column:
    return F.array_join(F.transform(F.coalesce(array, F.array()), make), "")


def _id(value: Column, fallback: int) -> Column:
    return F.when(F.coalesce(value, F.lit(0)) > 0, value).otherwise(F.lit(fallback))


def _unless_blank(value: Column, text: Column) -> Column:
    return F.when(~blank(value), text).otherwise(F.lit(""))


def yaml(scripts: DataFrame) -> DataFrame:
    """script_id, yaml."""

    def person(c):
        traits = F.when(F.coalesce(F.size(c["personality"]), F.lit(0)) > 0, _s("      personality:", _each(c["personality"], lambda p: _s('\n        - "', escaped(p), '"')), "\n")).otherwise("")
        bonds = F.when(F.coalesce(F.size(c["relationships"]), F.lit(0)) > 0, _s("      relationships:\n", _each(c["relationships"], lambda r: _s('        - target: "', escaped(r["target"]), '"\n          relation: "', escaped(r["relation"]), '"\n')))).otherwise("")
        return _s(
            *("    - id: ", _id(c["character_id"], 1000), '\n      canonicalName: "', escaped(c["canonical_name"]), '"\n'),
            *('      roleType: "', F.coalesce(c["role_type"], F.lit("SUPPORTING")), '"\n      gender: "', F.coalesce(c["gender"], F.lit("OTHER")), '"\n'),
            *(_unless_blank(c["description"], _s('      description: "', escaped(c["description"]), '"\n')), traits, bonds),
        )

    def line(d):
        note = _unless_blank(d["parenthetical"], _s('          parenthetical: "', escaped(d["parenthetical"]), '"\n'))
        return _s("        - id: ", _id(d["dialogue_id"], 1), '\n          speaker: "', escaped(d["speaker"]), '"\n          content: "', escaped(d["content"]), '"\n          emotion: "', F.coalesce(d["emotion"], F.lit("CALM")), '"\n', note)

    def action(a):
        return _s("        - id: ", _id(a["action_id"], 1), '\n          actionType: "', escaped(a["action_type"]), '"\n          description: "', escaped(a["description"]), '"\n')

    def part(array, title, make):
        return F.when(F.coalesce(F.size(array), F.lit(0)) > 0, _s(title, _each(array, make))).otherwise("")

    def scene(s):
        head = scene_header(s["interior"], s["location"], s["time_of_day"])
        return _s(
            *("    - id: ", _id(s["scene_id"], 1100), "\n      sceneNumber: ", s["scene_number"], '\n      location: "', escaped(s["location"]), '"\n'),
            *('      timeOfDay: "', F.coalesce(s["time_of_day"], F.lit("UNSPECIFIED")), '"\n      interior: ', s["interior"], '\n      title: "', escaped(s["title"]), '"\n'),
            *('      mood: "', escaped(s["mood"]), '"\n      sceneHeading: "', escaped(head), '"\n'),
            *(part(s["dialogues"], "      dialogues:\n", line), part(s["actions"], "      actions:\n", action)),
        )

    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    lines = F.aggregate(F.coalesce("scenes", F.array()), F.lit(0), lambda acc, s: acc + n(s["dialogues"]))
    out = _s(
        *("script:\n  id: ", F.col("script_id"), "\n  novelId: ", F.col("novel_id"), '\n  title: "', escaped(F.col("title")), '"\n  status: "', F.col("status"), '"\n  version: ', F.col("version"), "\n"),
        *("  sceneCount: ", n("scenes"), "\n  characterCount: ", n("characters"), "\n  dialogueCount: ", lines, "\n"),
        *("\n  characters:\n", _each(F.col("characters"), person), "\n  scenes:\n", _each(F.col("scenes"), scene)),
    )
    return scripts.select("script_id", out.alias("yaml"))


def _items(s: Column) -> Column:
    """A scene's lines and actions by sequence, lines first."""
    none = F.lit(None).cast("string")
    said = F.transform(F.coalesce(s["dialogues"], F.array()), lambda d: F.struct(d["sequence"].alias("sequence"), F.lit(0).alias("kind"), d["dialogue_id"].alias("id"), d["speaker"].alias("who"), d["emotion"].alias("tag"), d["parenthetical"].alias("note"), d["content"].alias("text"), F.lit(None).cast("int").alias("ms")))
    done = F.transform(F.coalesce(s["actions"], F.array()), lambda a: F.struct(a["sequence"].alias("sequence"), F.lit(1).alias("kind"), a["action_id"].alias("id"), none.alias("who"), a["action_type"].alias("tag"), none.alias("note"), a["description"].alias("text"), a["duration_ms"].alias("ms")))
    return F.array_sort(F.concat(said, done))


def _cast(s: Column, people: Column) -> Column:
    known = F.map_from_entries(F.transform(F.coalesce(people, F.array()), lambda c: F.struct(c["character_id"], c["canonical_name"])))
    return F.array_join(F.filter(F.transform(s["character_ids"], lambda i: F.element_at(known, i)), lambda x: x.isNotNull()), "、")


def _seconds(ms: Column) -> Column:
    return F.when(F.coalesce(ms, F.lit(0)) > 0, F.format_string(" （约%.1f秒）", ms / 1000.0)).otherwise("")


def _note(x: Column) -> Column:
    return _unless_blank(x["note"], _s("（", x["note"], "）"))


def _screenplay(scripts: DataFrame, title, empty: str, scene, name: str) -> DataFrame:
    body = F.when(F.coalesce(F.size("scenes"), F.lit(0)) <= 0, F.lit(empty)).otherwise(_each(F.col("scenes"), scene))
    return scripts.select("script_id", _s(title(F.coalesce("title", F.lit("未命名剧本"))), body).alias(name))


def txt(scripts: DataFrame) -> DataFrame:
    """script_id, txt."""
    double, single = "═" * 39 + "\n", "─" * 39 + "\n\n"

    def item(x):
        said = _s("  ", x["who"], F.when(x["tag"].isNotNull(), _s("（", labelled(x["tag"], LABEL_EMOTION), "）")).otherwise(""), _note(x), '："', x["text"], '"\n\n')
        done = _s("  [", F.coalesce(labelled(x["tag"], LABEL_ACTION), F.lit("动作")), "] ", x["text"], _seconds(x["ms"]), "\n\n")
        return F.when(x["kind"] == 0, said).otherwise(done)

    def scene(s):
        who = F.when(F.coalesce(F.size(s["character_ids"]), F.lit(0)) > 0, _s("出场角色：", _cast(s, F.col("characters")), "\n\n")).otherwise("")
        return _s(
            *(double, "场景 ", s["scene_number"], "：", scene_header(s["interior"], s["location"], s["time_of_day"]), "\n", double, "\n", who),
            *(_unless_blank(s["mood"], _s("场景氛围：", s["mood"], "\n\n")), _unless_blank(s["summary"], _s("摘要：", s["summary"], "\n\n"))),
            *(single, _each(_items(s), item), single),
        )

    return _screenplay(scripts, lambda t: _s("《", t, "》\n\n"), "（暂无场景内容）\n", scene, "txt")


def markdown(scripts: DataFrame) -> DataFrame:
    """script_id, md."""

    def item(x):
        label = labelled(x["tag"], LABEL_EMOTION)
        said = _s("**", x["who"], "**", F.when(label != "", _s("（", label, "）")).otherwise(""), _note(x), '："', x["text"], '"\n\n')
        done = _s("*[", F.coalesce(labelled(x["tag"], LABEL_ACTION), F.lit("动作")), "]* ", x["text"], _seconds(x["ms"]), "\n\n")
        return F.when(x["kind"] == 0, said).otherwise(done)

    def scene(s):
        who = F.when(F.coalesce(F.size(s["character_ids"]), F.lit(0)) > 0, _s("**出场角色**：", _cast(s, F.col("characters")), "\n\n")).otherwise("")
        return _s(
            *("---\n\n## 场景 ", s["scene_number"], "：", scene_header(s["interior"], s["location"], s["time_of_day"]), "\n\n", who),
            *(_unless_blank(s["mood"], _s("**场景氛围**：", s["mood"], "\n\n")), _unless_blank(s["summary"], _s("> ", s["summary"], "\n\n"))),
            _each(_items(s), item),
        )

    return _screenplay(scripts, lambda t: _s("# 《", t, "》\n\n"), "> （暂无场景内容）\n", scene, "md")


def named() -> Column:
    """A file's name: the title made safe, and the id, since titles may be equal."""
    return F.concat_ws("-", safe_file_name(F.coalesce("title", F.lit(""))), F.col("script_id").cast("string"))


def write(texts: DataFrame, column: str, path: str, extension: str) -> int:
    """A file for each script in the folder `path`, in two steps; returns how many.

    Tasks write the texts beside the folder, so one that fails leaves every old file as it was; when all
    are there, each is renamed into its place, where the store replaces a file as a whole. What
    is cut short there can be run again. Files of scripts that are not in `texts` stay. A file
    ends with a line feed, whether its text does or not; a null text has an empty file.
    """
    spark = texts.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    staged = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    try:
        # A row is a script; its text is one record, which the sink ends with a line feed, so its folder gets one file.
        texts.select(named().alias("name"), F.coalesce(F.regexp_replace(column, "\n\\z", ""), F.lit("")).alias("value")).write.partitionBy("name").text(staged)
        files = jvm.org.apache.hadoop.fs.Path(staged).getFileSystem(conf).listFiles(jvm.org.apache.hadoop.fs.Path(staged), True)
        store, n = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.org.apache.hadoop.fs.Path(staged).toUri(), conf), 0
        replaced = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        replaced[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        while files.hasNext():
            at = files.next().getPath()
            if at.getName().startswith("part-"):
                name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(at.getParent().getName().removeprefix("name="))
                store.rename(at, jvm.org.apache.hadoop.fs.Path(path, f"{name}.{extension}"), replaced)
                n += 1
        return n
    finally:
        delete(spark, staged)
