"""Rule classification: ordered tables of labels and keywords, the first hit wins.

A table is a list of (label, keywords). `first_label` turns it into one chain of regular
expression tests that Catalyst evaluates inside whole-stage code; no table is joined.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = list[tuple[str, list[str]]]

# Keyword dictionaries, in the order in which they are tried.
ACTION_RULES: Rules = [
    ("BEAT", ["沉默", "停顿", "犹豫", "停下", "站住", "愣住", "僵住", "愣神", "迟疑", "顿了顿", "欲言又止", "一时无言", "没有回答", "没说话", "没有说话", "半晌", "片刻", "一阵沉默", "一片寂静", "漫长的沉默", "安静下来", "静默"]),
    ("REACTION", ["猛地回头", "猛地抬头", "猛地转头", "猛地转过身", "瞳孔微缩", "瞳孔放大", "脸色一变", "神色一变", "神情一变", "表情一变", "微微一愣", "一怔", "吃了一惊", "吃了一愣", "回头", "抬头", "转头", "转身", "望去", "看向", "望过去", "倒吸一口凉气", "倒吸凉气", "深吸一口气", "后退", "退了一步", "后退半步", "后退一步", "后退了两步", "往后一缩", "浑身一震", "身体一震", "惊呆", "愣住", "瞪大", "睁大"]),
    ("BUSINESS", ["擦拭", "打扫", "整理", "浇花", "扫地", "拖地", "窗外", "远处", "背景", "灯光", "音乐", "风吹", "树叶", "飘落", "落下", "流水", "倒水", "泡茶", "上菜", "端盘", "送餐", "路过", "走过", "闲逛", "巡逻", "站岗"]),
]
ACTION_NAMES = {"ACTION": ["主动动作", "动作"], "REACTION": ["反应动作", "反应"], "BEAT": ["节拍", "停顿", "停顿动作"], "BUSINESS": ["背景", "背景动作", "环境"]}
CONFLICT_LABELS = {"PERSON_VS_PERSON": ["人与人"], "PERSON_VS_SELF": ["人与自我"], "PERSON_VS_SOCIETY": ["人与社会"], "PERSON_VS_NATURE": ["人与自然"], "PERSON_VS_TECHNOLOGY": ["人与科技"], "PERSON_VS_FATE": ["人与命运"]}
CONFLICT_OTHERS = ["自我", "社会", "自然", "科技", "命运"]
CONFLICT_RULES: Rules = [
    ("PERSON_VS_SELF", ["自我", "内心", "矛盾"]),
    ("PERSON_VS_SOCIETY", ["社会", "制度", "群体"]),
    ("PERSON_VS_NATURE", ["自然", "环境", "灾难"]),
    ("PERSON_VS_TECHNOLOGY", ["科技", "机器", "技术"]),
    ("PERSON_VS_FATE", ["命运", "宿命", "天意"]),
]
EMOTION_LABELS = {"ANGRY": ["愤怒"], "HAPPY": ["高兴"], "SAD": ["悲伤"], "CALM": ["平静"], "FEARFUL": ["恐惧"], "SURPRISED": ["惊讶"], "NEUTRAL": ["中性"], "ANXIOUS": ["焦虑"], "COLD": ["冷淡"], "EXCITED": ["兴奋"], "GENTLE": ["温柔"], "SARCASTIC": ["讽刺"], "PROUD": ["傲慢"], "DESPERATE": ["绝望"]}
EMOTION_RULES: Rules = [
    ("ANGRY", ["怒", "生气", "愤"]),
    ("HAPPY", ["高兴", "开心", "快乐", "喜"]),
    ("SAD", ["悲", "伤心", "难过", "哭"]),
    ("CALM", ["平静", "冷静", "镇定"]),
    ("FEARFUL", ["怕", "恐惧", "害怕", "恐"]),
    ("SURPRISED", ["惊", "意外"]),
    ("ANXIOUS", ["焦虑", "紧张", "不安"]),
    ("COLD", ["冷淡", "冷漠"]),
    ("EXCITED", ["兴奋", "激动"]),
    ("GENTLE", ["温柔", "温和"]),
    ("SARCASTIC", ["讽刺", "嘲讽"]),
    ("PROUD", ["傲慢", "骄傲"]),
    ("DESPERATE", ["绝望", "无望"]),
]
EMOTION_INTENSITY = {"ANGRY": 8, "HAPPY": 5, "SAD": 6, "CALM": 2, "FEARFUL": 7, "SURPRISED": 6, "NEUTRAL": 3, "ANXIOUS": 7, "COLD": 4, "EXCITED": 8, "GENTLE": 3, "SARCASTIC": 5, "PROUD": 6, "DESPERATE": 9}
STYLE_NONE, STYLE_DEFAULT = "自然随和", "自然随和，根据情境调整语气"
STYLE_RULES: Rules = [
    ("冷峻简洁，逻辑清晰，不轻易表露情感", ["冷静", "理智", "沉稳", "沉着"]),
    ("热情奔放，语句流畅，充满感染力", ["热情", "开朗", "活泼", "外向"]),
    ("言辞冰冷，字字如刀，话少意重", ["冷酷", "无情", "冷漠", "阴冷"]),
    ("语气柔和，善用关心之词，说话留有余地", ["温柔", "善良", "体贴", "温和"]),
    ("居高临下，用词夸张，不屑与常人多言", ["傲慢", "自负", "骄傲", "狂妄"]),
    ("言简意赅，话中有试探，不轻易表态", ["谨慎", "多疑", "警觉", "小心"]),
    ("轻松诙谐，常带玩笑，善于化解紧张", ["幽默", "风趣", "乐观"]),
    ("语速快，用词直接，常带粗口或感叹", ["暴躁", "冲动", "易怒", "粗鲁"]),
    ("话少而意味深长，喜欢用短句，常有沉默", ["忧郁", "深沉", "内向", "沉默"]),
    ("语带机锋，话中有话，善于反问和设套", ["智慧", "聪明", "狡猾", "机智"]),
]
REASON_LABELS = {"LOCATION": ["地点变化"], "TIME": ["时间变化"], "CHARACTER": ["人物变化"], "CONFLICT": ["冲突变化"], "CHAPTER_BOUNDARY": ["章节边界"]}
REASON_RULES: Rules = [
    ("LOCATION", ["地点", "位置", "location"]),
    ("TIME", ["时间", "time"]),
    ("CHARACTER", ["人物", "角色", "character"]),
    ("CONFLICT", ["冲突", "conflict"]),
    ("CHAPTER_BOUNDARY", ["章节", "chapter"]),
]
TIME_LABELS = {"DAWN": ["黎明"], "MORNING": ["早晨"], "AFTERNOON": ["下午"], "EVENING": ["傍晚"], "NIGHT": ["夜晚"], "LATE_NIGHT": ["深夜"], "UNKNOWN": ["未知"]}
TIME_RULES: Rules = [
    ("DAWN", ["黎明", "日出", "清晨", "dawn", "sunrise"]),
    ("MORNING", ["早上", "上午", "早晨", "morning"]),
    ("AFTERNOON", ["午后", "下午", "中午", "afternoon", "noon"]),
    ("EVENING", ["傍晚", "黄昏", "日落", "evening", "dusk", "sunset"]),
    ("LATE_NIGHT", ["深夜", "半夜", "午夜", "late_night", "midnight"]),
    ("NIGHT", ["夜晚", "晚上", "夜间", "night"]),
    ("MORNING", ["白天", "日间", "day"]),
]
TIME_CONTENT: Rules = [
    ("DAWN", ["黎明", "日出", "破晓", "晨曦", "拂晓", "清晨", "蒙蒙亮"]),
    ("MORNING", ["早晨", "早上", "上午", "早餐", "早自习", "晨", "朝阳"]),
    ("AFTERNOON", ["下午", "午后", "中午", "午餐", "午睡", "午", "烈日"]),
    ("EVENING", ["傍晚", "黄昏", "日落", "晚餐", "夕阳", "晚霞", "天黑前"]),
    ("NIGHT", ["夜晚", "晚上", "天黑", "月亮", "星空", "晚饭后", "夜间"]),
    ("LATE_NIGHT", ["深夜", "半夜", "午夜", "凌晨", "三更", "夜深"]),
]
INTERIOR = ["室内", "房间", "屋内", "客厅", "卧室", "厨房", "教室", "办公室", "走廊", "地下室", "阁楼", "宫殿", "牢房", "医院", "商店", "酒吧", "屋", "室", "房", "厅", "堂", "楼内"]
EXTERIOR = ["室外", "户外", "街上", "广场", "操场", "公园", "森林", "山上", "海边", "沙漠", "田野", "天空", "花园", "庭院", "河边", "湖", "街", "路", "场", "外", "野", "山", "海", "林"]
INNER_STATE = ["感到", "感觉到", "觉得", "认为", "以为", "意识到", "认识到", "知道", "明白", "想起了", "回忆起", "记起", "想起", "心想", "心里想", "暗想", "心中", "内心", "在心里", "心里面", "心里", "突然意识到", "忽然间", "一瞬间", "他意识到", "她意识到", "他们意识到", "他感到", "她感到", "他们感到", "他想起", "她想起", "他们想起", "他知道了", "她知道了", "他们知道了"]
NARRATION = ["他想起了", "她想起了", "他们想起了", "这时", "此刻", "此时", "原来", "其实", "突然", "忽然", "莫名", "不知为何", "仿佛", "好像", "谁也不", "没人知", "无人"]
RELATION_RULES: Rules = [
    ("family", ["家人", "父母", "兄弟", "姐妹", "子女", "亲戚"]),
    ("romantic", ["恋人", "情侣", "夫妻", "爱"]),
    ("hostile", ["敌人", "对手", "仇"]),
    ("mentorship", ["师徒", "师父", "弟子", "老师"]),
]
RELATION_COLOURS: Rules = [
    ("#f472b6", ["恋人", "夫妻", "情人", "love"]),
    ("#C23B22", ["仇敌", "敌人", "对手", "enemy"]),
    ("#3DB8B0", ["师徒", "老师", "学生", "master"]),
    ("#22c55e", ["朋友", "好友", "friend"]),
    ("#f97316", ["家人", "父亲", "母亲", "兄弟", "姐妹", "family"]),
    ("#a78bfa", ["同门", "同事"]),
]
COLOUR_DEFAULT = "#787066"
TIME_JUMPS = ["第二天", "次日", "三天后", "几天后", "一周后", "一个月后", "第二天早上", "第二天下午", "第二天晚上", "翌日", "半小时后", "一小时后", "几个小时后", "深夜", "凌晨", "清晨", "傍晚", "过了", "转眼", "时光飞逝", "眨眼间"]
LABEL_TIME = {"MORNING": "早晨", "AFTERNOON": "下午", "EVENING": "傍晚", "NIGHT": "夜晚", "DAWN": "黎明", "LATE_NIGHT": "深夜"}
LABEL_EMOTION = {"ANGRY": "愤怒", "HAPPY": "开心", "SAD": "悲伤", "CALM": "平静", "FEARFUL": "恐惧", "SURPRISED": "惊讶", "NEUTRAL": ""}
LABEL_ACTION = {"ACTION": "动作", "REACTION": "反应", "BEAT": "节拍", "BUSINESS": "调度"}


def any_of(text: Column, words: list[str]) -> Column:
    """Whether the text contains one of the words; false for null."""
    return F.coalesce(text.rlike("|".join(map(re.escape, words))), F.lit(False))


def first_label(text: Column, rules: Rules, default: str | None = None) -> Column:
    out = F.lit(default)
    for label, words in reversed(rules):
        out = F.when(any_of(text, words), F.lit(label)).otherwise(out)
    return out


def stripped(text: Column) -> Column:
    """The text without white space at either end, the ideographic space included."""
    return F.regexp_replace(text, r"^[\s　]+|[\s　]+$", "")


def blank(text: Column) -> Column:
    return text.isNull() | (stripped(text) == "")


def _exact(text: Column, labels: dict[str, list[str]], upper: bool = True) -> Column:
    out = F.lit(None).cast("string")
    for name, words in reversed(labels.items()):
        hit = text.isin(words)
        if upper:
            hit = hit | (F.upper(text) == name)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def action_type(text: Column) -> Column:
    """ActionType of a name or label; null if unknown."""
    t = stripped(text)
    return F.when(~blank(text), _exact(t, ACTION_NAMES))


def classify_action(text: Column) -> Column:
    return F.when(blank(text), F.lit("ACTION")).otherwise(first_label(text, ACTION_RULES, "ACTION"))


def conflict_type(text: Column) -> Column:
    t = stripped(text)
    person = F.when(t.contains("人") & ~any_of(t, CONFLICT_OTHERS), F.lit("PERSON_VS_PERSON"))
    return F.when(~blank(text), F.coalesce(_exact(t, CONFLICT_LABELS), person, first_label(t, CONFLICT_RULES)))


def emotion(text: Column) -> Column:
    t = stripped(text)
    return F.when(blank(text), F.lit("NEUTRAL")).otherwise(F.coalesce(_exact(t, EMOTION_LABELS), first_label(t, EMOTION_RULES, "NEUTRAL")))


def intensity(name: Column) -> Column:
    return F.coalesce(*(F.when(name == n, F.lit(v)) for n, v in EMOTION_INTENSITY.items()))


def speech_style(personality: Column) -> Column:
    none = personality.isNull() | (F.size(personality) == 0)
    return F.when(none, F.lit(STYLE_NONE)).otherwise(first_label(F.array_join(personality, " "), STYLE_RULES, STYLE_DEFAULT))


def source_reason(text: Column) -> Column:
    t = stripped(text)
    return F.when(~blank(text), F.coalesce(_exact(t, REASON_LABELS), first_label(F.lower(t), REASON_RULES)))


def time_of_day(text: Column) -> Column:
    t = stripped(text)
    return F.when(blank(text), F.lit("UNKNOWN")).otherwise(F.coalesce(_exact(t, TIME_LABELS), first_label(F.lower(t), TIME_RULES, "UNKNOWN")))


def time_from_content(text: Column) -> Column:
    """The first time of day, in the order of the day, of which the text has a keyword."""
    return F.when(blank(text), F.lit("UNKNOWN")).otherwise(first_label(text, TIME_CONTENT, "UNKNOWN"))


def is_daytime(name: Column) -> Column:
    return name.isin("DAWN", "MORNING", "AFTERNOON")


def is_nighttime(name: Column) -> Column:
    return name.isin("EVENING", "NIGHT", "LATE_NIGHT")


def role_type(text: Column) -> Column:
    """Role of a character; anything unknown is SUPPORTING."""
    t = F.upper(stripped(text))
    return F.when(t.isin("PROTAGONIST", "DEUTERAGONIST", "ANTAGONIST", "SUPPORTING", "MINOR"), t).otherwise(F.lit("SUPPORTING"))


def outline_role(text: Column) -> Column:
    """Role in a single-pass outline, where extras are minor."""
    return F.when(F.upper(stripped(text)) == "EXTRAS", F.lit("MINOR")).otherwise(role_type(text))


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words the text contains."""
    out = F.lit(0)
    for w in words:
        out = out + F.coalesce(text.contains(w).cast("int"), F.lit(0))
    return out


def interior(text: Column, location: Column) -> Column:
    """Whether a scene is indoors: keywords count one in the text and two more in the location; ties are indoors."""
    whole = F.concat_ws(" ", F.coalesce(text, F.lit("")), location)
    score = lambda words: hits(whole, words) + 2 * hits(location, words)
    return score(INTERIOR) >= score(EXTERIOR)


def visualizable(text: Column) -> Column:
    return ~blank(text) & ~any_of(text, INNER_STATE) & ~any_of(text, NARRATION)


def narration_free(text: Column) -> Column:
    return ~any_of(text, NARRATION)


def violation(text: Column) -> Column:
    """inner_state, narration or null: the first kind of phrase that a camera cannot show."""
    return F.when(any_of(text, INNER_STATE), F.lit("inner_state")).when(any_of(text, NARRATION), F.lit("narration"))


def relation_class(text: Column) -> Column:
    return first_label(text, RELATION_RULES)


def time_jump(text: Column) -> Column:
    """Whether the first 100 characters say that time has passed."""
    return any_of(F.substring(text, 1, 100), TIME_JUMPS)


def location_of(text: Column) -> Column:
    """What follows a verb of arriving, or else the first 50 characters."""
    found = F.regexp_extract(text, "(?:走进|来到|到达|回到|前往)([^，。；]{2,10})", 1)
    return F.when(blank(text), F.lit("")).when(found != "", stripped(found)).otherwise(F.substring(text, 1, 50))


def labelled(name: Column, labels: dict[str, str]) -> Column:
    """Display label of a name; names without one stand for themselves."""
    return F.coalesce(*(F.when(name == n, F.lit(v)) for n, v in labels.items()), name)


def relation_colour(text: Column) -> Column:
    return F.when(blank(text), F.lit(COLOUR_DEFAULT)).otherwise(first_label(text, RELATION_COLOURS, COLOUR_DEFAULT))
