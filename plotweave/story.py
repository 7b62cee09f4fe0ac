"""Narrative tables derived from the given ones, each by one SQL text that Spark and DuckDB both run.

Names, lines, scenes and texts are taken from rows of the given tables by their keys, so they are
as many and as varied as those rows, and no row is made up beside them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: What the two dialects spell differently.
_SPARK = {"@list": "array", "@at": "element_at", r"@relation\((\w+), (\w+)\)": r"named_struct('target', \1, 'relation', \2)"}
_DUCK = {"@list": "list_value", "@at": "list_extract", r"@relation\((\w+), (\w+)\)": r"struct_pack(target := \1, relation := \2)"}


class Story:
    """A table as SQL over {given tables}; braces of other use are doubled."""

    def __init__(self, sql: str):
        self.text = sql
        self._tables = sorted(set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)))

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(_told(self.text, _SPARK), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in self._tables})

    def sql(self) -> str:
        return _told(self.text, _DUCK).format(**{t: t for t in self._tables})


def _told(sql: str, words: dict[str, str]) -> str:
    for a, b in words.items():
        sql = re.sub(a, b, sql)
    return sql


def _literal(v: str | None) -> str:
    """A string of SQL; Spark, unlike DuckDB, reads backslashes, so they are not in it."""
    if v is None:
        return "NULL"
    return "'" + v.replace("'", "''").replace("{", "{{").replace("}", "}}").replace("\\", "' || chr(92) || '") + "'"


def picked(key: str, values: list[str | None]) -> str:
    """SQL for the value that a key picks from a list."""
    return f"@at(@list({', '.join(map(_literal, values))}), CAST(floor({key}) % {len(values)} AS INT) + 1)"


#: People of four scripts: names are words of the benchmark's texts, which documents and conversations use too.
CAST = Story("""SELECT item_id % 4 AS script_id, item_id AS pos, item_id + 1000 AS character_id, nullif(regexp_extract(text, '[A-Z][a-z]{{3,}}', 0), '') AS canonical_name,
 @list(nullif(regexp_extract(text, '[a-z]{{6,}}', 0), ''), nullif(regexp_extract(text, ' ([a-z]{{5}}) ', 1), '')) AS aliases FROM {benchmark}""")
#: Lines said by them, under their names, aliases, parts of names, names with honorifics and prefixes, and names that nobody has.
SAID = Story("""SELECT script_id, conv_id * 1000 + turn AS line_id, conv_id AS scene_id, turn AS sequence, source, CASE (conv_id + turn) % 9
  WHEN 0 THEN name WHEN 1 THEN alias WHEN 2 THEN name || '师兄' WHEN 3 THEN '小' || substr(name, 2) WHEN 4 THEN substr(name, 2, 3) WHEN 5 THEN 'old ' || name || ' and the others of the long way' WHEN 6 THEN substr(text, 1, 4) WHEN 7 THEN NULL ELSE ' ' END AS speaker
 FROM (SELECT b.item_id % 4 AS script_id, c.conv_id, c.turn, c.text, CASE WHEN c.turn % 2 = 0 THEN 'AI' ELSE 'REGEX' END AS source, nullif(regexp_extract(b.text, '[A-Z][a-z]{{3,}}', 0), '') AS name, nullif(regexp_extract(b.text, '[a-z]{{6,}}', 0), '') AS alias
  FROM {conversations} c JOIN {benchmark} b ON b.item_id = (c.conv_id * 13 + c.turn * 7) % 40)""")
#: Plot events of a user, in order: titles of a few syllables picked by the event's values, some of them spelled apart, short or missing.
PLOT = Story(f"""SELECT user_id AS script_id, event_id AS event_order, CASE CAST(floor(value) AS BIGINT) % 11 WHEN 0 THEN NULL WHEN 1 THEN a WHEN 2 THEN a || ' ' || b WHEN 3 THEN b || a ELSE a || b || c || d END AS title,
  CASE WHEN event_id % 3 = 0 THEN b END AS location, CASE WHEN event_id % 5 < 4 THEN c || CAST(floor(value) AS BIGINT) % 7 END AS time_point,
  CASE WHEN event_id % 5 > 0 THEN a || d END AS description, CASE WHEN event_id % 4 > 0 THEN event_type END AS conflict_type, CAST(CAST(floor(value) AS BIGINT) % 5 + 1 AS INT) AS importance, CASE WHEN event_id % 7 > 1 THEN c END AS emotional_arc,
  @list(event_id % 6, event_id % 4) AS chapter_ids, @list(user_id, event_id % 9, event_id % 5) AS character_ids
 FROM (SELECT *, {picked("floor(event_id / 3) + user_id", ["开端", "转折", "决战", "重逢", "离别", "密谋", "背叛", "觉醒"])} AS a, {picked("floor(value * 10)", ["城门", "教室", "雪山", "码头", "宫殿", "森林", "街道", "古墓", "客栈"])} AS b,
  {picked("floor(value * 100)", ["清晨", "黄昏", "深夜", "正午", "雨后"])} AS c, {picked("event_id", ["之战", "之约", "风云", "的秘密", "归来", "余波", "起"])} AS d FROM {{events}})""")
#: Lines of uploads, by file and place: Han phrases with a word of a conversation between them; `kind` is the encoding that a file is written in (one that was encoded twice is only told from GB18030 by its control characters).
UPLOAD = Story(f"""SELECT conv_id % 64 AS file, conv_id, turn, {picked("conv_id % 64", ["utf-8", "gb18030", "gbk", "doubled"])} AS kind, a || regexp_extract(text, '[A-Za-z]{{{{3,6}}}}', 0) || b || c || CASE WHEN conv_id % 4 = 3 THEN repeat(chr(11), 5) ELSE '' END AS line
 FROM (SELECT *, {picked("conv_id + turn", ["清晨的阳光洒在脸上", "下午的会议开始了", "他握紧拳头", "窗外传来音乐", "夜晚的星空璀璨"])} AS a, {picked("conv_id * 3 + turn * 5", ["，他说：", "。然后", "……", "！", "，", "", "？"])} AS b,
  {picked("length(text)", ["片刻之后转身离开", "什么也没说", "她猛地回头", "仿佛过了很久", "", "教室里一片寂静"])} AS c FROM {{conversations}})""")


# --- whole scripts -----------------------------------------------------------------------------
# A customer is a script; each order is a person, a scene and a chapter of it, and each event of a
# user a line, an action and a plot event of the script of that number.

_SURNAMES, _GIVEN = ["林", "李", "王", "张", "赵", "孙", "欧阳", "慕容", "陈"], ["川", "雪", "磊", "大壮", "三丰", "婉儿", "明", "七", "小明", "雨", "云", "锋", "天", "风"]


def _name(script: str, k: str) -> str:
    return f"{picked(f'{script} + ({k}) * 5', _SURNAMES)} || {picked(f'{script} * 3 + ({k})', _GIVEN)}"


def _given(script: str, k: str) -> str:
    return picked(f"{script} * 3 + ({k})", _GIVEN)


_ORDERS = "(SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS k FROM {orders})"
_PERSON = f"(SELECT *, {_name('o_custkey', 'k')} AS name, {_given('o_custkey', 'k')} AS given, {_name('o_custkey', 'k + 1')} AS other, {_given('o_custkey', 'k + 1')} AS other_given FROM {_ORDERS} o)"
#: A line or action belongs to one of the first twelve scenes of its script, or to none where there are fewer.
_EVENTS = f"(SELECT e.event_id, e.user_id, e.event_type, e.value, coalesce(o.o_orderkey, -e.event_id) AS scene_id, o.k, {_name('e.user_id', 'e.event_id % 14')} AS name, {_given('e.user_id', 'e.event_id % 14')} AS given FROM {{events}} e LEFT JOIN {_ORDERS} o ON o.o_custkey = e.user_id AND o.k = e.event_id % 12)"

_TEXTS = [
    "清晨的阳光洒在脸上", "早上好，同学们", "下午的会议开始了", "傍晚的夕阳很美", "夜晚的星空璀璨", "深夜三点，他还没睡", "他站在那里什么也没说", "他愣住了，片刻之后转身离开",
    "她猛地回头，瞳孔微缩", "窗外传来音乐", "他握紧拳头", "他感到一阵寒意", "仿佛过了很久", "  ", None, "Day", "LATE_NIGHT", "黎明", "人与人", "人与自然的冲突", "内心挣扎", "person_vs_fate",
    "愤怒", "非常生气", "ANXIOUS", "有点激动", "地点变化", "Location change", "时间", "BEAT", "停顿", "动作", "家人", "师徒关系", "他的仇人", "同门", "走进教室，坐下", "第二天，他醒来了", "unknown",
]
TEXTS = Story(f"SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN a ELSE a || b END AS text FROM (SELECT *, {picked('o_orderkey', _TEXTS)} AS a, {picked('o_custkey', _TEXTS)} AS b FROM {{orders}})")
PLACES = Story(f"SELECT o_orderkey AS id, {picked('o_orderkey', ['同学们在上课', '车来车往', '两人对坐', '什么也没有', '海边的房间', None, '屋里的灯亮着，窗外是街道', '森林深处'])} AS summary, {picked('o_custkey', ['教室', '街道', '咖啡厅', None, '山上', '公园', '卧室', '山洞'])} AS location FROM {{orders}}")
_NAMES = [
    "到来，平静应", "平静。地说", "忽然！一声", "he looks at her", "林川", "萧炎", "王小明", "慕容雪", "欧阳锋", "上官婉儿", "平静地说", "冷漠地笑", "众人", "因为他", "离开了", "大手掌", "阿凡提大", "轻风", "风", "ab", "Tom", "X1", "点头", "  ", None,
    "紧张", "不知道", "古丽说", "李说", "爱新觉罗玄烨", "阿·凡", "走进房间", "三人", "轻轻", "眼神",
]
NAMES = Story(f"SELECT o_orderkey AS pos, CASE WHEN o_custkey % 4 = 0 THEN {_name('o_custkey', 'o_orderkey')} ELSE {picked('o_orderkey', _NAMES)} END AS name, {picked('o_custkey', ['大学生穿越者，拥有现代知识', None, '', 'x', '一只手', '一位行走江湖多年的老侠客', '主角', '众人'])} AS description FROM {{orders}}")
_PAIRED = ["林川", "川哥", "小川", "李雪", "雪儿", "张大壮", "大壮", "林师兄", "老王", "王明", "婉儿", "林婉儿", "王磊", "林师姐", "林", "阿明", "小明", "明王", "老张", "张三丰", "赵六", "孙七", None]
PAIRS = Story(f"SELECT o_orderkey AS id, {picked('o_orderkey', _PAIRED)} AS a, CASE WHEN o_custkey % 5 = 0 THEN {_name('o_custkey', 'o_orderkey')} ELSE {picked('o_custkey', _PAIRED)} END AS b FROM {{orders}}")
PEOPLE = Story(f"""SELECT o_custkey AS script_id, k AS pos, o_orderkey AS character_id, name, name AS canonical_name, {picked('k', ['PROTAGONIST', 'DEUTERAGONIST', 'SUPPORTING', 'antagonist', 'MINOR', None, '?'])} AS role_type, {picked('o_orderkey', ['MALE', 'FEMALE', None])} AS gender,
 {picked('o_orderkey', ['大学生穿越者，拥有现代知识', '温柔的女孩', None, '神秘的老人，来历不明', ''])} AS description,
 CASE o_orderkey % 4 WHEN 0 THEN @list('小' || given, name || '儿') WHEN 1 THEN @list(given || '哥') ELSE @list() END AS aliases,
 CASE o_orderkey % 3 WHEN 0 THEN @list({picked('o_custkey', ['冷静', '温柔', '暴躁', '沉稳', '开朗'])}) WHEN 1 THEN @list({picked('k', ['冷酷', '胆小', '开朗'])}, '沉稳') ELSE @list() END AS personality,
 CASE o_orderkey % 5 WHEN 0 THEN @list(@relation(other, kin), @relation(nobody, kin)) WHEN 1 THEN @list(@relation(little, kin)) WHEN 2 THEN @list(@relation(other, none), @relation(other, kin)) ELSE @list() END AS relationships
 FROM (SELECT *, {picked('o_custkey + k', ['恋人', '对手', '敌人', '朋友', '师徒'])} AS kin, '' AS none, '师父' AS nobody, '小' || other_given AS little FROM {_PERSON} p)""")
SCENES = Story(f"""SELECT o_custkey AS script_id, o_orderkey AS scene_id, CASE WHEN o_orderkey % 11 = 0 THEN k ELSE k + 1 END AS scene_number, {picked('k', ['开学', '夜路', '对谈', '余波', None])} AS title, {picked('o_orderkey', ['教室', '街道', '咖啡厅', '山上', None])} AS location,
 {picked('o_custkey + k', ['MORNING', 'NIGHT', 'AFTERNOON', 'UNKNOWN'])} AS time_of_day, o_orderkey % 2 = 0 AS interior,
 CASE o_orderkey % 7 WHEN 0 THEN name || '冷冷说道：你终于来了。' WHEN 1 THEN other || '出现在街角，夜色很深' WHEN 2 THEN name || '问道：怎么回事？' WHEN 3 THEN other || '：好的。' || name || '道：走吧！' WHEN 4 THEN NULL WHEN 5 THEN '“快走。”' || name || '低声说。第二天，他醒来了。' ELSE '无人的街道' END AS summary,
 {picked('k', ['明亮', '阴森', None])} AS mood, CAST(NULL AS STRING) AS source_reason,
 CASE WHEN o_orderkey % 9 = 0 THEN @list() ELSE @list(o_custkey * 100 + k % 5, o_custkey * 100 + (k * 3 + 5) % 7) END AS chapter_ids, CASE WHEN o_orderkey % 8 = 0 THEN @list() ELSE @list(o_orderkey, o_orderkey + 1) END AS character_ids,
 {picked('o_orderkey', ['COMPLETED', 'FAILED', 'COMPLETED'])} AS dialogue_status, {picked('o_custkey', ['FAILED', 'COMPLETED'])} AS action_status FROM {_PERSON} p""")
CHAPTERS = Story(f"""SELECT o_custkey AS novel_id, o_custkey * 100 + k AS chapter_id, k + 1 AS chapter_number, {picked('o_orderkey', ['清晨，', '夜晚，', '', '傍晚时分，'])} || name || {picked('k', ['走进教室，', '在街上。', '站在山上，', '坐在咖啡厅里，'])} || {picked('o_custkey', ['小', ''])} || other_given || {picked('o_orderkey + k', ['看着他。', '没有说话。', '笑了。'])} AS content FROM {_PERSON} p""")
SCRIPTS = Story(f"SELECT c_custkey AS script_id, c_custkey + 5 AS novel_id, {picked('c_custkey', ['风起云涌', ' ', '长夜', None])} AS title, {picked('c_custkey', ['COMPLETED', 'FAILED', 'RUNNING'])} AS status, CAST(c_custkey % 3 + 1 AS INT) AS version FROM {{customer}}")
DIALOGUES = Story(f"""SELECT user_id AS script_id, event_id AS dialogue_id, event_id AS line_id, scene_id, CAST(NULL AS BIGINT) AS character_id, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY event_id) AS INT) AS sequence,
 CASE event_id % 9 WHEN 0 THEN name WHEN 1 THEN '小' || given WHEN 2 THEN name || '师兄' WHEN 3 THEN given || '哥' WHEN 4 THEN '老' || given WHEN 5 THEN '路人甲' WHEN 6 THEN given WHEN 7 THEN NULL ELSE name || '儿' END AS speaker,
 {picked('value * 10', ['CALM', 'HAPPY', 'ANGRY', 'FEARFUL', 'NEUTRAL', None, 'SAD'])} AS emotion,
 {picked('event_id + user_id', ['不可能！这绝对不可能！！', '老子今天非教训你不可！', '你知道的，我们认识这么多年了，事情就是这样', '请坐。', '我知道了。', '我知道了！', '因为今天的事情实在太多，所以' + '我们只好一件一件慢慢地去做' * 6, '  ', '走吧', None])} AS content,
 {picked('event_id', [None, '笑着', None])} AS parenthetical, {picked('value', ['AI', 'REGEX', 'MANUAL'])} AS source, CASE WHEN event_id % 6 = 5 THEN event_id - 100 END AS reply_to FROM {_EVENTS} e""")
ACTIONS = Story(f"""SELECT user_id AS script_id, event_id AS action_id, scene_id, CASE WHEN event_id % 5 = 0 AND scene_id >= 0 THEN scene_id END AS character_id, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY event_id) AS INT) AS sequence, {picked('event_id', ['ACTION', 'REACTION', 'BEAT', 'BUSINESS', None])} AS action_type,
 CASE event_id % 6 WHEN 0 THEN name || '握紧拳头，指节发白' WHEN 1 THEN '小' || given || '猛地回头' WHEN 2 THEN '一阵沉默笼罩了房间' WHEN 3 THEN '黑衣人从怀中取出信封' WHEN 4 THEN given || '哥推门而入，' || name || '后退' ELSE NULL END AS description,
 {picked('value', ['AI', 'MANUAL'])} AS source, CASE WHEN event_id % 7 > 0 THEN CAST(event_id % 4 * 500 AS INT) END AS duration_ms FROM {_EVENTS} e""")
EVENTS = Story(f"""SELECT script_id, event_order AS event_id, CAST(event_order AS INT) AS event_order, title, description, location, time_point, conflict_type, importance, {picked('event_order', ['→', '↗', '↑', '↓', None, '↘'])} AS emotional_arc, chapter_ids, character_ids,
 CASE WHEN event_order % 4 = 0 THEN @list() ELSE @list({_name('script_id', 'event_order % 14')}, '小' || {_given('script_id', 'event_order % 5')}, '无名') END AS participants FROM ({PLOT.text})""")
STEPS = Story("SELECT 's' || n_nationkey AS step, 's' || CAST(floor(n_nationkey / 2) AS INT) AS dep FROM {nation} WHERE n_nationkey > 0 UNION ALL SELECT 's' || n_nationkey, 's' || (n_nationkey - 3) FROM {nation} WHERE n_nationkey > 3 AND n_nationkey % 4 = 1")
_Q = chr(92) + chr(34)
#: Completions for scenes: fenced, wrapped, followed by prose, with the same brackets in strings, empty, cut off, or of another kind.
RESPONSES = Story(f"""SELECT o_custkey AS script_id, o_orderkey AS scene_id, CASE o_orderkey % 9
  WHEN 0 THEN '{{{{"actions":[{{{{"sequence":1,"character":"' || name || '","actionType":"ACTION","description":"' || name || '握紧拳头","durationMs":' || o_orderkey % 3 * 500 || '}}}},{{{{"sequence":2,"character":"' || other || '","actionType":"反应","description":"' || other || '猛地回头"}}}}]}}}}'
  WHEN 1 THEN '好的：' || chr(10) || '```json' || chr(10) || '[{{{{"description":"' || name || '愣住了"}}}},{{{{"description":" "}}}},{{{{"actionType":"奇怪","description":"窗外有风","durationMs":0}}}}]' || chr(10) || '```'
  WHEN 2 THEN {_literal('[{"sequence":7,"description":"a ] b { ' + _Q + ' c"}] 之后')} WHEN 3 THEN NULL WHEN 4 THEN '没有内容' WHEN 5 THEN '{{{{"other": 1}}}}' WHEN 6 THEN '{{{{"actions": [{{{{"description": "' || name || '"'
  WHEN 7 THEN '[{{{{"sequence":3,"character":" ","description":"  ' || name || '沉默  ","durationMs":-5}}}}]' ELSE '[]' END AS text FROM {_PERSON} p""")
#: What they say, in the order of their scenes; only DuckDB asks for it.
RESPONDED = f"""SELECT o_orderkey AS scene_id, 1 AS sequence, name AS who, 'ACTION' AS kind, name || '握紧拳头' AS description, nullif(o_orderkey % 3 * 500, 0)::INTEGER AS ms FROM {_told(_PERSON, _DUCK)} p WHERE o_orderkey % 9 = 0
 UNION ALL SELECT o_orderkey, 2, other, NULL, other || '猛地回头', 1500 FROM {_told(_PERSON, _DUCK)} p WHERE o_orderkey % 9 = 0
 UNION ALL SELECT o_orderkey, 1, NULL, NULL, name || '愣住了', 1500 FROM {_told(_PERSON, _DUCK)} p WHERE o_orderkey % 9 = 1
 UNION ALL SELECT o_orderkey, 3, NULL, NULL, '窗外有风', NULL FROM {_told(_PERSON, _DUCK)} p WHERE o_orderkey % 9 = 1
 UNION ALL SELECT o_orderkey, 7, NULL, NULL, 'a ] b {{{{ " c', 1500 FROM {_told(_PERSON, _DUCK)} p WHERE o_orderkey % 9 = 2
 UNION ALL SELECT o_orderkey, 3, NULL, NULL, name || '沉默', NULL FROM {_told(_PERSON, _DUCK)} p WHERE o_orderkey % 9 = 7""".format(orders="orders")
#: Events as a model tells them: under one or the other name of each field, with importances out of bounds and chapters left out.
TOLD = Story(f"""SELECT o_custkey AS script_id, o_orderkey, CASE WHEN o_orderkey % 10 = 9 THEN 'Sorry, no events.' WHEN o_orderkey % 4 = 0 THEN '{{{{"events":[' || body || ']}}}}' WHEN o_orderkey % 4 = 1 THEN '{{{{"plotEvents":[' || body || ',{{{{"title":" "}}}}]}}}}' WHEN o_orderkey % 4 = 2 THEN body ELSE 'Here: [' || body || '] ok' END AS text
 FROM (SELECT *, '{{{{"' || CASE WHEN o_orderkey % 3 = 0 THEN 'event_title' ELSE 'title' END || '":"' || name || '的决定","' || CASE WHEN o_orderkey % 5 = 0 THEN 'detail' ELSE 'description' END || '":"' || o_orderpriority || '","' || CASE WHEN o_orderkey % 2 = 0 THEN 'place' ELSE 'location' END || '":"' || o_orderstatus || '","importance":' || (o_orderkey % 9 - 2) || ',"' || CASE WHEN o_orderkey % 7 = 0 THEN 'event_order' ELSE 'eventOrder' END || '":' || k || ',"participants":["' || name || '","' || other || '"]'
   || CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE ',"chapterIds":[' || k || ',' || (k + 2) || ']' END || '}}}}' AS body FROM {_PERSON} p) b""")
#: People, scenes and lines as a model tells them; numbers may be strings, and some completions are broken.
CASTED = Story(f"""SELECT o_orderkey AS script_id, CASE WHEN o_orderkey % 8 = 7 THEN '[{{{{"name":"' || name ELSE head || '[{{{{"' || CASE WHEN o_orderkey % 2 = 0 THEN 'name' ELSE 'canonicalName' END || '":"' || name || '","roleType":"' || CASE WHEN o_orderkey % 3 = 0 THEN 'minor' ELSE 'hero' END || '"' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ',"aliases":["' || given || '哥"]' END || '}}}},{{{{"name":"' || other || '","gender":null}}}}]' || tail END AS text
 FROM (SELECT *, {picked('o_custkey', ['', '{"characters":', '{"data":', '{"result":'])} AS head, {picked('o_custkey', ['', '}', '}', '}'])} AS tail FROM {_PERSON} p) q""")
SCENED = Story(f"""SELECT o_orderkey AS script_id, CASE WHEN o_orderkey % 8 = 7 THEN 'nothing' WHEN o_orderkey % 8 < 3 THEN '{{{{"scenes":[' || body || ',' || body || ']}}}}' ELSE 'Here it is: ' || body END AS text
 FROM (SELECT *, '{{{{"' || CASE WHEN o_orderkey % 2 = 0 THEN 'sceneNumber' ELSE 'index' END || '":' || CASE WHEN o_orderkey % 3 = 0 THEN '"' || k || '"' WHEN o_orderkey % 3 = 1 THEN k || '.0' ELSE 'null' END || ',"summary":"' || name || '"' || CASE WHEN o_orderkey % 5 = 0 THEN ',"location":"街","interior":false' ELSE '' END || ',"timeOfDay":"清晨"}}}}' AS body FROM {_PERSON} p) q""")
LINED = Story(f"""SELECT o_orderkey AS scene_id, CASE WHEN o_orderkey % 6 = 5 THEN body ELSE '{{{{"' || {picked('o_custkey', ['dialogues', 'dialogue', 'lines', 'data', 'result'])} || '":[{{{{"content":" "}}}},' || body || ']}}}}' END AS text
 FROM (SELECT *, '{{{{"' || CASE WHEN o_orderkey % 2 = 0 THEN 'speaker' ELSE 'character' END || '":"' || name || '","' || CASE WHEN o_orderkey % 3 = 0 THEN 'text' ELSE 'content' END || '":"' || o_orderpriority || '","emotion":"开心"}}}}' AS body FROM {_PERSON} p) q""")
_HEADS = ["第1章 穿越", "第一章 觉醒", "番外 往事", "尾声", "Chapter 1 Start", "CHAPTER IV", "1. First", "二、继续", "第十回", "Prologue: a", "前面有人走来", "====", "12. " + "x" * 50, "没有标题的文字"]
_BODIES = ["林川睁开眼睛", "他醒了", "正文一\n\n正文二", "", "text\nmore", "  ", "作者：佚名\n简介：故事"]
#: Novels of up to three chapters under heads of all kinds; some have no head, some no text.
NOVELS = Story(f"""SELECT c_custkey AS novel_id, CASE c_custkey % 9 WHEN 0 THEN b WHEN 1 THEN h || chr(10) || b WHEN 2 THEN '' WHEN 3 THEN b || chr(10) || i || chr(10) || c ELSE h || chr(10) || b || chr(10) || i || chr(10) || c || chr(10) || j || chr(10) || b END AS content
 FROM (SELECT *, {picked('c_custkey', _HEADS)} AS h, {picked('c_custkey / 3', _HEADS)} AS i, {picked('c_custkey / 7', _HEADS)} AS j, {picked('c_custkey / 2', _BODIES)} AS b, {picked('c_custkey / 5', _BODIES)} AS c FROM {{customer}})""")
PEOPLE_TOLD = _told(_PERSON, _DUCK).format(orders="orders")
ALL = {n.lower(): t for n, t in list(globals().items()) if isinstance(t, Story)}


def duck(*names: str) -> str:
    """A WITH list of the tables."""
    return ", ".join(f"fx_{n} AS ({ALL[n].sql()})" for n in names)
