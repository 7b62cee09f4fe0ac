"""Small tables with known answers, as DataFrames and as SQL values of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SQL = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<bigint>": "BIGINT[]", "array<struct<target:string,relation:string>>": "STRUCT(target VARCHAR, relation VARCHAR)[]"}


class Fixture:
    def __init__(self, ddl: str, rows: list[tuple]):
        self.ddl, self.rows = ddl, rows
        self._columns = [c.split(" ", 1) for c in ddl.split(", ")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.ddl)

    def sql(self) -> str:
        values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        names = ", ".join(c for c, _ in self._columns)
        return "SELECT " + ", ".join(f"CAST({c} AS {_SQL[k]}) AS {c}" for c, k in self._columns) + f" FROM (VALUES {values}) t({names})"


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, tuple):
        return "{'target': " + _literal(v[0]) + ", 'relation': " + _literal(v[1]) + "}"
    return "[" + ", ".join(map(_literal, v)) + "]"


TEXTS = Fixture("id int, text string", list(enumerate([
    "清晨的阳光洒在脸上", "早上好，同学们", "下午的会议开始了", "傍晚的夕阳很美", "夜晚的星空璀璨", "深夜三点，他还没睡", "他站在那里什么也没说", "他愣住了，片刻之后转身离开",
    "她猛地回头，瞳孔微缩", "窗外传来音乐", "他握紧拳头", "他感到一阵寒意", "仿佛过了很久", "  ", None, "Day", "LATE_NIGHT", "黎明", "人与人", "人与自然的冲突", "内心挣扎", "person_vs_fate",
    "愤怒", "非常生气", "ANXIOUS", "有点激动", "地点变化", "Location change", "时间", "BEAT", "停顿", "动作", "家人", "师徒关系", "他的仇人", "同门", "走进教室，坐下", "第二天，他醒来了", "unknown",
])))
PLACES = Fixture("id int, summary string, location string", [(1, "同学们在上课", "教室"), (2, "车来车往", "街道"), (3, "两人对坐", "咖啡厅"), (4, "什么也没有", None), (5, "海边的房间", "山上"), (6, None, "公园")])
NAMES = Fixture("pos int, name string, description string", [(k, n, d) for k, (n, d) in enumerate([
    ("到来，平静应", None), ("平静。地说", None), ("忽然！一声", None), ("he looks at her", None), ("林川", "大学生穿越者，拥有现代知识"), ("萧炎", "天才少年，修炼斗气"), ("王小明", "普通的中学生，性格开朗"), ("慕容雪", "性情冷淡的剑客，来自北方"),
    ("欧阳锋", "西域高手，精通毒术武功"), ("上官婉儿", "才女，宫中女官，聪慧过人"), ("平静地说", None), ("冷漠地笑", ""), ("众人", None), ("因为他", "x"), ("离开了", None), ("大手掌", "一只手"), ("阿凡提大", None), ("轻风", None), ("风", None), ("风", "一位行走江湖多年的老侠客"),
    ("ab", None), ("Tom", None), ("X1", None), ("点头", None), ("  ", None), (None, None), ("紧张", "x"), ("不知道", None), ("古丽说", "主角"), ("李说", "主角"), ("爱新觉罗玄烨", "x"), ("阿·凡", None),
])])
PAIRS = Fixture("id int, a string, b string", [(k, a, b) for k, (a, b) in enumerate([
    ("林川", "川哥"), ("林川", "小川"), ("李雪", "雪儿"), ("张大壮", "大壮"), ("林川", "林师兄"), ("老王", "王明"), ("婉儿", "林婉儿"), ("林川", "王磊"), ("林川", "李雪"), ("王明", "王磊"), ("林师兄", "林师姐"), ("林川", "林川"), ("林", "林川"), ("阿明", "小明"), ("王明", "明王"), ("老张", "张三丰"), ("赵六", "孙七"), (None, "孙七"),
])])
PEOPLE = Fixture("script_id bigint, pos int, character_id bigint, name string, canonical_name string, role_type string, gender string, description string, aliases array<string>, personality array<string>, relationships array<struct<target:string,relation:string>>", [
    (1, 0, 11, "林川", "林川", "PROTAGONIST", "MALE", "大学生穿越者，拥有现代知识", ["川哥", "小川"], ["冷静", "沉稳"], [("李雪", "恋人"), ("王磊", "对手")]),
    (1, 1, 12, "李雪", "李雪", "DEUTERAGONIST", "FEMALE", "温柔的女孩，林川的同学", ["雪儿"], ["温柔"], [("林川", "恋人")]),
    (1, 2, 13, "王磊", "王磊", "SUPPORTING", "MALE", "性格暴躁的同学", [], ["暴躁"], [("川哥", "敌人"), ("无名", "朋友")]),
    (1, 3, 14, "幽冥老人", "幽冥老人", "ANTAGONIST", "MALE", "神秘的老人，来历不明", ["幽冥"], ["冷酷"], []),
    (1, 4, 15, "张大壮", "张大壮", "MINOR", "MALE", "身材高大的少年同学", ["大壮"], [], [("师父", "师徒")]),
])
SCENES = Fixture("script_id bigint, scene_id bigint, scene_number int, title string, location string, time_of_day string, interior boolean, summary string, mood string, source_reason string, chapter_ids array<bigint>, character_ids array<bigint>, dialogue_status string, action_status string", [
    (1, 101, 1, "开学", "教室", "MORNING", True, "李雪冷冷说道：你终于来了。", "明亮", None, [1], [11, 12], "COMPLETED", "FAILED"),
    (1, 102, 2, "夜路", "街道", "NIGHT", False, "幽冥老人出现在街角", "阴森", None, [1, 2], [14], "FAILED", "COMPLETED"),
    (1, 103, 4, "对谈", "咖啡厅", "AFTERNOON", True, "王磊问道：怎么回事", None, None, [3], [11, 99], "COMPLETED", "COMPLETED"),
    (1, 104, 4, "余波", "咖啡厅", "AFTERNOON", True, None, None, None, [], [], "FAILED", "FAILED"),
])
DIALOGUES = Fixture("script_id bigint, dialogue_id bigint, line_id bigint, scene_id bigint, character_id bigint, sequence int, speaker string, emotion string, content string, parenthetical string, source string, reply_to bigint", [
    (1, 1, 1, 101, None, 1, "林川", "CALM", "不可能！这绝对不可能！！", None, "AI", None),
    (1, 2, 2, 101, None, 2, "雪儿", "HAPPY", "老子今天非教训你不可！", "笑着", "AI", None),
    (1, 3, 3, 102, None, 1, "幽冥老人", "FEARFUL", "你知道的，我们认识这么多年了，事情就是这样", None, "REGEX", None),
    (1, 4, 4, 102, None, 2, "王磊师兄", "ANGRY", "请坐。", None, "MANUAL", None),
    (1, 5, 5, 103, None, 1, "小大壮", "NEUTRAL", "我知道了。", None, "AI", None),
    (1, 6, 6, 103, None, 2, "大壮", "NEUTRAL", "我知道了！", None, "AI", 5),
    (1, 7, 7, 103, None, 3, "路人甲", "SAD", "因为今天的事情实在太多，所以" + "我们只好一件一件慢慢地去做" * 6, None, "AI", None),
    (1, 8, 8, 999, None, 1, None, None, "  ", None, "AI", None),
])
ACTIONS = Fixture("script_id bigint, action_id bigint, scene_id bigint, character_id bigint, sequence int, action_type string, description string, source string, duration_ms int", [
    (1, 1, 101, None, 1, "ACTION", "林川握紧拳头，指节发白", "AI", 1500),
    (1, 2, 101, None, 2, "REACTION", "雪儿猛地回头，瞳孔微缩", "AI", 800),
    (1, 3, 102, None, 1, "BEAT", "一阵沉默笼罩了房间", "MANUAL", 2000),
    (1, 4, 102, 13, 2, "ACTION", "黑衣人从怀中取出信封", "AI", None),
    (1, 5, 103, None, 1, "BUSINESS", "幽冥推门而入，张大壮后退", "AI", 1000),
    (1, 6, 998, None, 1, None, "黑衣人从怀中取出信封", "AI", 0),
])
SCRIPTS = Fixture("script_id bigint, novel_id bigint, title string, status string, version int", [(1, 5, '风起"云"涌', "COMPLETED", 2), (2, 6, " ", "FAILED", 1)])
CHAPTERS = Fixture("novel_id bigint, chapter_id bigint, chapter_number int, content string", [(5, 1, 1, "清晨，林川走进教室，雪儿看着他。"), (5, 2, 2, "夜晚，幽冥在街上。"), (5, 3, 3, "王磊和大壮在咖啡厅里谈话。")])
NOVELS = Fixture("novel_id bigint, content string", [
    (1, "第1章 穿越\n林川睁开眼睛\n第2章 觉醒\n他醒了\n第3章 离开\n他走了"),
    (2, "作者：佚名\n简介：故事\n\n第一章 觉醒\n正文一\n====\n番外 往事\n正文二\n尾声\n完"),
    (3, "没有标题的文字\n第二行"),
    (4, "Chapter 1 Start\ntext\nCHAPTER IV\nmore\n1. First\na\n二、继续\nb\n第十回\nc\n前面有人走来\n12. " + "x" * 50 + "\nPrologue: a\n"),
    (5, ""),
    (6, "  \n \n"),
])
EVENTS = Fixture("script_id bigint, event_id bigint, event_order int, title string, description string, location string, time_point string, conflict_type string, importance int, emotional_arc string, chapter_ids array<bigint>, character_ids array<bigint>, participants array<string>", [
    (1, 1, 1, "开端", "起", "教室", "早", "PERSON_VS_PERSON", 2, "→", [1], [11], ["林川", "雪儿"]),
    (1, 2, 2, "发展", "承", None, None, "PERSON_VS_PERSON", 3, "↗", [1, 2], [12], ["小川", "无名"]),
    (1, 3, 3, "高潮", None, "街道", "夜", "PERSON_VS_SELF", 5, "↑", [3], [], ["幽冥"]),
    (1, 4, 4, "转 折", "转", None, None, "PERSON_VS_SOCIETY", 4, "↓", [4], [13], []),
    (1, 5, 5, "结局", "合", None, None, None, 2, "→", [5], [], []),
    (1, 6, 6, "转折点", "再转", "街道", "夜", "PERSON_VS_PERSON", 5, None, [2, 6], [11, 13], []),
    *((2, 10 + k, k, f"事件{'甲乙丙丁戊己庚辛壬癸'[k]}号" + "子丑寅卯辰巳午未申酉"[k] * 3, None, None, None, None, 3, "↑" if k == 0 else "↓" if k == 9 else "→", [k], [], []) for k in range(10)),
])
STEPS = Fixture("step string, dep string", [("b", "a"), ("c", "b"), ("d", "a"), ("e", "d"), ("f", "e"), ("g", "e"), ("h", "c"), ("h", "f"), ("h", "g"), ("i", "h")])
RESPONSES = Fixture("script_id bigint, scene_id bigint, text string", [
    (1, 101, '{"actions":[{"sequence":1,"character":"林川","actionType":"ACTION","description":"林川握紧拳头，指节发白","durationMs":1500},{"sequence":2,"character":"李雪","actionType":"REACTION","description":"李雪猛地回头，瞳孔微缩","durationMs":800},{"sequence":3,"character":null,"actionType":"BEAT","description":"一阵沉默笼罩了房间","durationMs":2000}]}'),
    (1, 102, '好的：\n```json\n[{"description":"他愣住了"},{"description":" "},{"actionType":"奇怪","description":"窗外有风","durationMs":0}]\n```'),
    (1, 103, '[{"sequence":7,"description":"a ] b { \\" c"}] 之后'),
    (1, 104, None),
    (1, 105, "没有内容"),
    (1, 106, '{"other": 1}'),
    (1, 107, '{"actions": [{"description": "x"'),
])
ALL = {n.lower(): f for n, f in list(globals().items()) if isinstance(f, Fixture)}


def duck(*names: str) -> str:
    """A WITH list of fixtures."""
    return ", ".join(f"fx_{n} AS ({ALL[n].sql()})" for n in names)
