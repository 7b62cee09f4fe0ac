"""Schemas of the narrative tables and the dictionaries of their enumerations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_JSON_LIST = T.ArrayType(T.LongType())


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)  # needs an active session


#: DDL of each table; lists that may be missing at rest read as empty (see sources.tables.json_list).
TABLES = {
    "novels": "novel_id bigint, title string, author string, file_name string, file_size bigint, total_chars int, chapter_count int, status string, metadata map<string,string>, created_at timestamp_ntz, updated_at timestamp_ntz",
    "chapters": "chapter_id bigint, novel_id bigint, chapter_number int, title string, content string, char_count int, start_offset bigint, end_offset bigint, embedding_id string, status string",
    "scripts": "script_id bigint, novel_id bigint, title string, version int, status string, progress decimal(5,2), scene_count int, character_count int, dialogue_count int, workflow_state map<string,string>",
    "characters": "character_id bigint, script_id bigint, canonical_name string, role_type string, gender string, age_range string, description string, aliases array<string>, personality array<string>, relationships array<struct<target:string,relation:string>>, merged_from array<bigint>",
    "plot_events": "event_id bigint, script_id bigint, event_order int, title string, description string, location string, time_point string, conflict_type string, importance int, emotional_arc string, chapter_ids array<bigint>, character_ids array<bigint>",
    "scenes": "scene_id bigint, script_id bigint, scene_number int, title string, location string, time_of_day string, interior boolean, summary string, mood string, source_reason string, heading string, chapter_ids array<bigint>, character_ids array<bigint>, dialogue_status string, action_status string",
    "dialogues": "dialogue_id bigint, scene_id bigint, character_id bigint, sequence int, speaker string, emotion string, content string, parenthetical string, source string, reply_to bigint",
    "actions": "action_id bigint, scene_id bigint, character_id bigint, sequence int, action_type string, description string, source string, duration_ms int",
    "shots": "shot_id bigint, scene_id bigint, shot_number int, camera string, angle string, movement string, transition string, duration_sec decimal(5,1)",
    "plot_insertions": "insertion_id bigint, script_id bigint, position int, content string",
    "chunks": "chunk_id string, chunk_index int, novel_id bigint, chapter_ids array<bigint>, content string, token_count int, start_offset bigint, end_offset bigint",
    "llm_responses": "scene_id bigint, kind string, text string",
    "progress_events": "run_id bigint, step string, progress double, ts timestamp",
}

#: Domains of the enumerations.
ENUMS = {
    "action_type": ["ACTION", "REACTION", "BEAT", "BUSINESS"],
    "chapter_type": ["PROLOGUE", "NORMAL", "INTERLUDE", "EPILOGUE"],
    "role_type": ["PROTAGONIST", "DEUTERAGONIST", "ANTAGONIST", "SUPPORTING", "MINOR"],
    "conflict_type": ["PERSON_VS_PERSON", "PERSON_VS_SELF", "PERSON_VS_SOCIETY", "PERSON_VS_NATURE", "PERSON_VS_TECHNOLOGY", "PERSON_VS_FATE"],
    "content_source": ["AI", "REGEX", "MANUAL"],
    "source_reason": ["LOCATION", "TIME", "CHARACTER", "CONFLICT", "CHAPTER_BOUNDARY"],
    "time_of_day": ["DAWN", "MORNING", "AFTERNOON", "EVENING", "NIGHT", "LATE_NIGHT", "UNKNOWN"],
    "step_status": ["PENDING", "RUNNING", "COMPLETED", "FAILED", "SKIPPED"],
    "workflow_step": ["CHAPTER_PARSE", "CHARACTER_EXTRACT", "CHARACTER_RESOLVE", "PLOT_EXTRACT", "SCENE_SEGMENT", "DIALOGUE_GENERATE", "ACTION_GENERATE", "SCRIPT_COMPOSE", "YAML_EXPORT"],
    "timeline_stage": ["EXPOSITION", "RISING_ACTION", "CLIMAX", "FALLING_ACTION", "RESOLUTION"],
}

#: Emotions with label, speech pattern and intensity.
EMOTIONS = [
    ("ANGRY", "愤怒", "语气激烈，短句为主，常用反问和感叹", 8),
    ("HAPPY", "高兴", "语气轻快，语句流畅，多用肯定词", 5),
    ("SAD", "悲伤", "语气低沉，句子断续，声调下沉", 6),
    ("CALM", "平静", "语气平稳，逻辑清晰，用词克制", 2),
    ("FEARFUL", "恐惧", "语气犹豫，常用省略号，句子不完整", 7),
    ("SURPRISED", "惊讶", "语气突转，常用感叹词开头", 6),
    ("NEUTRAL", "中性", "自然语气，无明显情绪色彩", 3),
    ("ANXIOUS", "焦虑", "语速急促，重复用词，自我反问", 7),
    ("COLD", "冷淡", "用词简洁，回避回应，句子极短", 4),
    ("EXCITED", "兴奋", "语速快，句子长而连贯，充满感叹", 8),
    ("GENTLE", "温柔", "语气柔和，多用叠词和委婉表达", 3),
    ("SARCASTIC", "讽刺", "言不由衷，表面礼貌实含嘲讽", 5),
    ("PROUD", "傲慢", "用词夸张，居高临下的语气", 6),
    ("DESPERATE", "绝望", "语言破碎，充满否定，语气下沉", 9),
]


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def dictionary(spark: SparkSession, enum: str) -> DataFrame:
    """ordinal and name of an enumeration's values: a few rows, safe to broadcast."""
    return spark.createDataFrame(list(enumerate(ENUMS[enum])), "ordinal int, name string")


def emotions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EMOTIONS, "name string, label string, speech_pattern string, intensity int")
