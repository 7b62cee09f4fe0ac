import fixtures as fx
import pytest
from pyspark.sql import functions as F

from plotweave import queries
from plotweave.functions import extract, names
from plotweave.operators import chapters, chunks, entities, events, scripts
from plotweave.plans import flow
from plotweave.sources import export, prompts, text
from plotweave.streaming import progress


def test_chapter_headers_and_contiguous_offsets(spark):
    novel = "\n".join(f"第{i}章 新的征程\n" + "他走在路上。" * 28 for i in range(1, 26))
    made = chapters.chapters(spark.createDataFrame([(1, novel)], "novel_id bigint, content string")).orderBy("chapter_number").collect()
    assert len(made) == 25 and sum(r.char_count for r in made) == len(novel) + 1
    assert all(a.end_offset == b.start_offset for a, b in zip(made, made[1:], strict=False))


def test_first_alternative_is_not_retried(spark):
    rows = [("前面有人走来", False), ("前言", True), ("第十回", True), ("====", False), ("第3章 离开", True), ("一、开始", True), ("3. " + "x" * 41, False), ("", False)]
    df = spark.createDataFrame(rows, "line string, want boolean")
    assert df.where(chapters.is_header(F.col("line")) != F.col("want")).count() == 0


def brute_chunks(text_, size, overlap):
    out, start = [], 0
    while len(text_) - start >= size:
        cut = start + chunks.split_point(text_[start:], size)
        out.append((start, cut))
        start = max(start, cut - overlap)
    return [*out, (start, len(text_))] if start < len(text_) else out


def test_chunks_cover_the_text():
    text_ = "".join(f"第{i}句话说完了。" + "无" * (i % 37) for i in range(900))
    made = chunks.overlapping([(1, text_[:5000]), (2, text_[5000:])])
    assert [(a, b) for _, _, a, b in made][:1] == brute_chunks(text_, chunks.CHUNK_CHARS, chunks.OVERLAP_CHARS)[:1]
    assert all(part == text_[a:b] for _, part, a, b in made)
    assert made[-1][3] == len(text_) and all(x[3] >= y[2] for x, y in zip(made, made[1:], strict=False))
    assert all(len(ids) <= 3 for ids, *_ in made)


def test_small_chunks_match_brute_force():
    text_ = "abc。de。fghijklmnop。q" * 40
    made = chunks.overlapping([(1, text_)], 50, 10)
    assert [(a, b) for _, _, a, b in made] == brute_chunks(text_, 50, 10)


def test_paragraphs_and_lines(spark):
    novels = spark.createDataFrame([(1, "甲" * 2000 + "\n\n" + "乙" * 900 + "\n \n丙"), (2, None), (3, " ")], "novel_id bigint, content string")
    made = chunks.paragraph_chunks(novels).collect()
    assert [(r.novel_id, r.chunk_index, r.content[:1], len(r.content)) for r in made] == [(1, 0, "甲", 2000), (1, 1, "乙", 903)]
    lines = spark.createDataFrame([(1, k, "好" * 1000, k * 1001) for k in range(7)], "novel_id bigint, line_no int, line string, offset bigint")
    assert [(r.chunk_index, r.start_offset, r.end_offset) for r in chunks.line_chunks(lines).orderBy("chunk_index").collect()] == [(0, 0, 3003), (1, 3003, 6006), (2, 6006, 7007)]


def test_reference_pairs(spark):
    want = {0: True, 1: True, 2: True, 3: True, 4: True, 5: True, 6: True, 7: False, 8: False, 9: True, 10: True}
    got = {r.id: r.same for r in fx.PAIRS.df(spark).select("id", names.same_person(F.col("a"), F.col("b")).alias("same")).collect()}
    assert {k: got[k] for k in want} == want
    strict = {r.id: r.same for r in fx.PAIRS.df(spark).select("id", names.same_person(F.col("a"), F.col("b"), strict=True).alias("same")).collect()}
    assert strict[9] is False


def test_noise_and_names(spark):
    got = {r.name: r.reason for r in fx.NAMES.df(spark).where("name <> '风'").select("name", names.noise_reason(F.col("name"), F.col("description")).alias("reason")).collect()}
    assert all(got[n] for n in ("到来，平静应", "平静。地说", "忽然！一声", "he looks at her"))
    assert not any(got[n] for n in ("林川", "萧炎", "王小明", "慕容雪", "欧阳锋", "上官婉儿"))


def test_groups(spark):
    people = spark.createDataFrame([(1, k, n) for k, n in enumerate(["林川", "川哥", "小川", "李雪", "王磊"])], "script_id bigint, pos int, name string")
    roots = entities.components(people, entities.pairs(people))
    assert sorted(r.root for r in roots.collect()) == [0, 0, 0, 3, 4]


def test_event_merge_is_greedy(spark):
    made = {r.event_order: r for r in events.merged(fx.EVENTS.df(spark).where("script_id = 1")).collect()}
    assert [made[k].title for k in sorted(made)] == ["开端", "发展", "高潮", "转 折", "结局"]
    assert made[3].chapter_ids == [2, 3, 6] and made[3].importance == 5 and made[3].character_ids == [11, 13]


def test_json_blocks():
    assert extract.json_block('x ```json\n[{"a": "]"}]\n``` y') == '[{"a": "]"}]'
    assert extract.json_block('see {"a": {"b": "}"}} end') == '{"a": {"b": "}"}}'
    assert extract.json_block("[1, 2") is None and extract.json_block(None) is None and extract.json_block("plain") is None


def test_decoders(spark):
    rows = spark.createDataFrame([(1, 1, '{"events":[{"title":"高潮","importance":9,"conflictType":"人与自我"},{"event_title":"结局","chapterIds":[2]},{"title":" "}]}'), (2, 2, "none")], "script_id bigint, scene_id bigint, text string")
    got = extract.events(rows, F.array(F.lit(1).cast("bigint"))).collect()
    assert [(r.title, r.importance, r.conflict_type, r.chapter_ids) for r in got] == [("高潮", 5, "PERSON_VS_SELF", [1]), ("结局", 3, None, [2])]
    lines = spark.createDataFrame([(1, '{"lines":[{"speaker":"甲","content":"你好","emotion":"开心"},{"speaker":"乙","text":"再见"}]}'), (2, '{"speaker":"丙","content":"一句"}')], "scene_id bigint, text string")
    assert [(r.speaker, r.content, r.emotion) for r in extract.dialogues(lines).orderBy("scene_id", "sequence").collect()] == [("甲", "你好", "HAPPY"), ("乙", "再见", "NEUTRAL"), ("丙", "一句", "NEUTRAL")]
    body = spark.createDataFrame([('{"result":{"title":"a"}}',), ('{"scenes":[]}',), ('{"choices":[{"message":{"content":"{\\"script\\":{\\"title\\":\\"b\\"}}"}}]}',), ("text",)], "t string").select(extract.script_body(F.col("t")).alias("b"))
    assert [r.b for r in body.collect()] == ['{"title":"a"}', '{"scenes":[]}', '{"title":"b"}', None]
    people = extract.people(spark.createDataFrame([(1, '[{"name":"林川","roleType":"hero","aliases":["川哥"]}]')], "script_id bigint, text string")).collect()
    assert people[0].role_type == "SUPPORTING" and people[0].aliases == ["川哥"]
    scenes = extract.scenes(spark.createDataFrame([(1, '{"scenes":[{"timeOfDay":"清晨"},{"sceneNumber":7,"location":"街"}]}')], "script_id bigint, text string")).collect()
    assert [(s.scene_number, s.location, s.time_of_day) for s in scenes] == [(1, "未知地点", "DAWN"), (7, "街", "UNKNOWN")]


def test_exports(spark):
    made = scripts.assembled(fx.SCRIPTS.df(spark), fx.PEOPLE.df(spark), fx.SCENES.df(spark), fx.DIALOGUES.df(spark).drop("script_id"), fx.ACTIONS.df(spark).drop("script_id"))
    yaml = {r.script_id: r.yaml for r in export.yaml(made).collect()}[1]
    assert '  title: "风起\\"云\\"涌"\n' in yaml and yaml.count("          speaker:") == 7 and yaml.count("          actionType:") == 5
    txt = {r.script_id: r.txt for r in export.txt(made).collect()}
    assert "  雪儿（开心）（笑着）：\"老子今天非教训你不可！\"\n\n" in txt[1] and "（约0.8秒）" in txt[1] and txt[2].endswith("（暂无场景内容）\n")
    assert txt[1].index("不可能") < txt[1].index("林川握紧拳头")  # lines come before actions of equal sequence
    md = {r.script_id: r.md for r in export.markdown(made).collect()}[1]
    assert "## 场景 2：EXT. 街道 - NIGHT\n\n**出场角色**：幽冥老人\n\n" in md


def test_manual_edits_stamp_rows_and_keep_failures(spark):
    lines = fx.DIALOGUES.df(spark)
    patch = spark.createDataFrame([(3, "改过")], "dialogue_id bigint, content string")
    after = scripts.patched(lines, patch, "dialogue_id", ["content"], manual=True)
    assert after.where("dialogue_id = 3").first().source == "MANUAL"
    assert {r.scene_id: r.state for r in scripts.pending_state(fx.SCENES.df(spark), after, "dialogue").collect()} == {101: "none", 102: "patched", 103: "none", 104: "open"}


def test_runs_retry_skip_and_resume():
    calls = {"b": 0}

    def flaky():
        calls["b"] += 1
        if calls["b"] < 3:
            raise ValueError("not yet")

    slept: list[float] = []
    steps = [flow.Step("a", lambda: None), flow.Step("b", flaky, ["a"], retries=3), flow.Step("c", lambda: 1 / 0, ["a"]), flow.Step("d", lambda: None, ["c"]), flow.Step("e", lambda: None, ["d", "b"])]
    run = flow.Run(steps, slept.append)
    assert run.execute() == {"a": "COMPLETED", "b": "COMPLETED", "c": "FAILED", "d": "SKIPPED", "e": "SKIPPED"}
    assert slept == [0.2, 0.4] and run.progress() == 80.0
    steps[2].action = lambda: None
    again = flow.resumed(run, steps)
    assert set(again.execute().values()) == {"COMPLETED"} and calls["b"] == 3
    stopped = flow.Run([flow.Step("a", lambda: None)])
    stopped.cancelled = True
    assert stopped.execute() == {"a": "FAILED"}
    assert flow.bar(50.0) == "[" + "=" * 15 + ">" + " " * 14 + "]  50.0%" and "    b --> c" in flow.mermaid({"b": [], "c": ["b"]})


def test_declared_dependencies_resolve_people_first():
    assert "CHARACTER_RESOLVE" in flow.FULL["PLOT_EXTRACT"] and "DIALOGUE_GENERATE" in flow.FULL["ACTION_GENERATE"]


def test_stream_delivers_the_highest_progress(spark, tmp_path):
    rows = [(1, "a", 10.0, "2024-01-01 00:00:00"), (1, "a", 5.0, "2024-01-01 00:00:01"), (1, "b", 40.0, "2024-01-01 00:00:02"), (2, "a", 7.0, "2024-01-01 00:00:03")]
    df = spark.createDataFrame(rows, "run_id bigint, step string, progress double, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    seen: list = []
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = progress.fan_out(stream, {"one": lambda b, n: seen.extend((r.run_id, r.progress) for r in b.collect()), "two": lambda b, n: b.count()}, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [(1, 40.0), (2, 7.0)]
    w = progress.windowed(stream).writeStream.format("memory").queryName("w").outputMode("update").start()
    w.processAllAvailable()
    w.stop()
    assert spark.sql("SELECT max(progress) FROM w WHERE run_id = 1").first()[0] == 40.0


def test_encodings():
    chinese = "林川睁开眼睛，看见一片陌生的天空。" * 10
    assert text.decode(chinese.encode()) == chinese
    assert text.decode(chinese.encode("gb18030")) == chinese
    assert text.decode(b"plain ascii") == "plain ascii" and text.decode(b"") == "" and text.decode(None) is None


def test_hash_embedding():
    a, b = text.hash_embedding("林川"), text.hash_embedding("川林")
    assert len(a) == 1536 and abs(sum(x * x for x in a) - 1) < 1e-5 and a != b and not any(text.hash_embedding(""))
    seed = (ord("a") << 16) | 0
    for _ in range(2):
        seed = (seed * 6364136223846793005 + 1442695040888963407) % 2**64
    assert text.hash_embedding("a").index(1.0) == (seed & (2**63 - 1)) % 1536


def test_prompts():
    r = prompts.Registry()
    for v in ("1.9", "1.10", "1.2"):
        r.register(prompts.Template("t", v, "sys", "你好 {{name}}{{#items}}[{{x}}]{{/items}}{{^none}}!{{/none}}", [("q", "a")]))
    assert r.latest("t").version == "1.10" and r.latest("u") is None
    assert r.latest("t").render({"name": "川", "items": [{"x": 1}, {"x": 2}]})[1] == "你好 川[1][2]!"
    now = [0.0]
    c = prompts.Cache(10, 2, lambda: now[0])
    for k in "abc":
        c.put(k, "m", 0.5, k)
    assert c.get("a", "m", 0.5) is None and c.get("c", "m", 0.5) == "c"
    now[0] = 11
    assert c.get("c", "m", 0.5) is None


@pytest.mark.parametrize("name", ["novels", "scenes", "dialogues", "progress_events"])
def test_schemas(spark, name):
    from plotweave import schema

    assert schema.empty(spark, name).count() == 0
    assert schema.dictionary(spark, "time_of_day").count() == 7 and schema.emotions(spark).count() == 14


def test_library_does_not_import_the_llm_package():
    import pathlib
    import re

    root = pathlib.Path(queries.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"plotweave\.llm|from plotweave import llm", f.read_text()), f


def test_exports_are_written_as_a_whole(spark, tmp_path):
    out = tmp_path / "out"
    rows = spark.createDataFrame([(7, "a/b:c", "text\nmore\n"), (8, "a/b:c", "other"), (9, None, "100% = 'x'\n\n"), (10, "é%20", None)], "script_id bigint, title string, txt string").repartition(3)
    assert export.write(rows, "txt", str(out), "txt") == 4
    held = lambda: {f.name: f.read_text() for f in out.iterdir() if not f.name.startswith(".")}
    want = {"a_b_c-7.txt": "text\nmore\n", "a_b_c-8.txt": "other\n", "-9.txt": "100% = 'x'\n\n", "é%20-10.txt": "\n"}
    assert held() == want
    # A failing task leaves what was there.
    broken = rows.withColumn("txt", F.when(F.col("script_id") == 8, F.raise_error(F.lit("no"))).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="no"):
        export.write(broken, "txt", str(out), "txt")
    assert held() == want
    assert export.write(rows.where("script_id = 7").withColumn("txt", F.lit("new")), "txt", str(out), "txt") == 1
    assert held() == want | {"a_b_c-7.txt": "new\n"}


def test_a_stray_scene_number_is_one_range(spark):
    from plotweave.operators import checks

    scenes = spark.createDataFrame([(1, 1, 1, [1], [1]), (1, 2, 2**31 - 1, [1], [1]), (1, 3, 3, [1], [1])], "script_id bigint, scene_id bigint, scene_number int, character_ids array<bigint>, chapter_ids array<bigint>")
    none = spark.createDataFrame([], "script_id bigint, scene_id bigint, dialogue_id bigint, action_id bigint, character_id bigint")
    got = {r.subject for r in checks.integrity(scenes, none, none, none).where("rule = 'missing_scene_number'").collect()}
    assert len(got) == 1 + checks.GAP + 1 and {"2", "4", f"{3 + checks.GAP + 1}-{2**31 - 2}"} <= got


def test_interior_sees_words_that_run_from_chapter_to_chapter(spark):
    from plotweave.operators import linking

    chapters = spark.createDataFrame([(1, 1, "人在地下"), (2, 2, "x"), (3, 3, "天空，上街上街上的教"), (4, 4, "室内")], "chapter_id bigint, chapter_number int, content string")
    scenes = spark.createDataFrame([(1, [3, 4], None, None), (2, [1, 4], "x", None), (3, [], None, None), (4, [2, 3], "y", "教室")], "scene_id bigint, chapter_ids array<bigint>, summary string, location string")
    texts = {1: "人在地下", 2: "x", 3: "天空，上街上街上的教", 4: "室内"}
    from plotweave.functions.rules import EXTERIOR, INTERIOR

    want = {}
    for s, ids, summary, place in [(1, [3, 4], None, None), (2, [1, 4], "x", None), (3, [], None, None), (4, [2, 3], "y", "教室")]:
        t = "".join(texts[i] for i in ids) + (" " + summary if summary else "") + (" " + place if place else "")
        score = lambda words: sum(w in t for w in words) + 2 * sum(w in (place or "") for w in words)  # noqa: B023, E731
        want[s] = score(INTERIOR) >= score(EXTERIOR)
    assert {r.scene_id: r.interior for r in linking.scene_interior(scenes, chapters).collect()} == want


def test_whole_scripts_are_decoded_under_any_field_names(spark):
    from plotweave.functions import outline

    texts = [
        (1, '{"script":{"title":"甲","characters":[{"name":"林川","role":"PROTAGONIST"},{"canonicalName":"李雪","type":"EXTRAS","gender":"FEMALE"}],"scenes":[{"scene_id":"S07","narration":"夜","timeOfDay":"夜晚","lines":[{"character":"林川","line":"走吧"},{"speaker":"王磊"}],"characters":[{"name":"王磊"},{"name":"林川"}],"actions":[{"description":"跑"}]},{"index":3,"title":"二"}]}}'),
        (2, '```json\n{"choices":[{"message":{"content":"{\\"data\\":{\\"scenes\\":[{\\"interior\\":false,\\"conversations\\":[]}]}}"}}]}\n```'),
        (3, "no script"),
        (4, '{"other": {"title": "x"}}'),
    ]
    scripts = outline.decoded(spark.createDataFrame(texts, "script_id bigint, text string")).cache()
    assert sorted((r.script_id, r.title, r.people, r.scenes, r.lines) for r in outline.counts(scripts).collect()) == [(1, "甲", 3, 2, 2), (2, "未命名剧本", 0, 1, 0)]
    assert [(r.pos, r.canonical_name, r.role_type, r.gender) for r in outline.people(scripts).orderBy("script_id", "pos").collect()] == [(0, "林川", "PROTAGONIST", "未知"), (1, "李雪", "MINOR", "FEMALE"), (2, "王磊", "SUPPORTING", "未知")]
    assert [(r.script_id, r.nth, r.scene_number, r.title, r.summary, r.time_of_day, r.interior) for r in outline.scenes(scripts).orderBy("script_id", "nth").collect()] == [(1, 1, 7, "场景7", "夜", "NIGHT", True), (1, 2, 3, "二", "二", "UNKNOWN", True), (2, 1, 1, "场景1", "", "UNKNOWN", False)]
    assert [(r.sequence, r.speaker, r.content) for r in outline.lines(scripts).collect()] == [(1, "林川", "走吧"), (2, "王磊", "")]
    assert [(r.sequence, r.action_type, r.description) for r in outline.actions(scripts).collect()] == [(1, "ACTION", "跑")]


def test_fields_of_variants_are_tolerant(spark):
    text = '[{"sequence":"3","description":12,"durationMs":1500.0},{"sequence":null,"description":"x","durationMs":"soon","character":["a"]},{"description":{"a":1}},{"description":true,"sequence":[1]}]'
    got = [(r.sequence, r.description, r.duration_ms, r.name) for r in extract.actions(spark.createDataFrame([(1, text), (2, "[1, null]"), (3, '{"actions":{"description":"x"}}')], "scene_id bigint, text string")).orderBy("sequence").collect()]
    assert got[:2] == [(2, "x", 1500, '["a"]'), (3, "12", 1500, None)] and len(got) == 4


def test_chunks_of_one_or_more_chapters_are_the_same(spark):
    text_ = "他走在路上。" * 3000
    one = spark.createDataFrame([(1, 1, 1, text_), (2, 2, 1, None), (3, 3, 1, " "), (4, 4, 1, "x" * 9000)], "novel_id bigint, chapter_id bigint, chapter_number int, content string")
    more = one.unionByName(one.where("novel_id = 2").withColumn("chapter_number", F.lit(2)))
    assert "MapInPandas" in chunks.chunks(one)._jdf.queryExecution().toString()
    rows = lambda df: sorted(map(str, chunks.chunks(df).collect()))
    assert rows(one) == rows(more) and len(rows(one)) > 10
