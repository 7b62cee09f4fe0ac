"""Names in texts and names in names, against brute force."""

import random

import pytest
from engines import DATA, connect, duck_rows, spark_rows
from pyspark.sql import functions as F

from plotweave.operators import events, linking
from plotweave.operators.mentions import mentions
from plotweave.queries import ORACLES, QUERIES


def _story(seed=3):
    rng = random.Random(seed)
    letters = "abAB王林é "
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [(rng.choice([1, 1, 1, 1, 2, 3, None]), k, rng.choice([None, "", word(5), word(60), word(400)])) for k in range(150)]
    names = [(rng.choice([1, 1, 1, 2, 4, None]), rng.choice([None, word(rng.randint(1, 4)), word(30)])) for _ in range(120)]
    return texts, [*names, (2, ""), (1, texts[3][2] or "b"), (1, "ab"), (1, "b")]


@pytest.mark.parametrize("limits", [{}, {"most_names": 5}, {"most_bytes": 0, "group_bytes": 300}, {"most_bytes": 0, "group_bytes": 40}])
def test_mentions_are_those_of_contains(spark, limits):
    texts, names = _story()
    t = spark.createDataFrame(texts, "script_id bigint, text_id int, text string").withColumn("name", F.lit("x")).repartition(3)
    n = spark.createDataFrame(names, "script_id bigint, name string").withColumn("pos", F.lit(0))
    got = sorted(map(tuple, mentions(t, n, **limits).collect()))
    want = {(s, k, name) for s, k, text in texts if s is not None and text is not None for q, name in names if q == s and name is not None and name in text}
    assert got == sorted(want)


def test_mentions_of_nobody_and_in_nothing(spark):
    t = spark.createDataFrame([(1, 1, "abc")], "script_id bigint, text_id int, text string")
    n = spark.createDataFrame([(1, "b")], "script_id bigint, name string")
    for limits in ({}, {"most_names": -1}):
        assert mentions(t, n.where("false"), **limits).count() == 0
        assert mentions(t.where("false"), n, **limits).count() == 0


def test_a_plan_without_theta_join(spark):
    people = spark.createDataFrame([(1, 0, 7, "Anna", ["An"])], "script_id bigint, pos int, character_id bigint, canonical_name string, aliases array<string>")
    lines = spark.createDataFrame([(1, 1, "Anna Karenina", "AI", None)], "script_id bigint, line_id bigint, speaker string, source string, character_id bigint")
    for df in (linking.speakers(lines, people), linking.linked_lines(lines, people)):
        plan = df._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert linking.speakers(lines, people).first().level == 4


def test_either_way_is_containment(spark):
    rng = random.Random(8)
    word = lambda: rng.choice([None, "", "".join(rng.choice("ab林") for _ in range(rng.choice([1, 2, 3, 6, 30, 60])))])
    ours, theirs = ([(rng.choice([1, 1, 2]), word()) for _ in range(80)] for _ in range(2))
    a, b = spark.createDataFrame(ours, "script_id bigint, x string"), spark.createDataFrame(theirs, "script_id bigint, y string")
    got = sorted(map(tuple, linking.either_way(a, b).collect()))
    assert got == sorted({(s, x, y) for s, x in ours for q, y in theirs if s == q and x is not None and y is not None and (x in y or y in x)})


def test_many_texts_of_one_script_are_dealt_out(spark):
    t = spark.range(400).select(F.lit(1).alias("script_id"), F.col("id").alias("text_id"), F.lit("x" * 100 + " name").alias("text"))
    n = spark.createDataFrame([(1, "name"), (1, "me")], "script_id int, name string")
    assert mentions(t, n, most_bytes=0, group_bytes=1000).count() == 800


@pytest.fixture
def many_names(monkeypatch):
    """Names are too many to be broadcast."""
    monkeypatch.setattr(mentions, "__defaults__", (-1, 0, 16 << 20))


def test_texts_and_names_of_one_table(spark):
    t = spark.createDataFrame([(1, "abc"), (1, "b"), (2, "b"), (2, "cb")], "script_id bigint, name string").distinct()
    got = sorted(map(tuple, mentions(t.select("script_id", F.col("name").alias("text_id"), F.col("name").alias("text")), t, most_names=-1).collect()))
    assert got == [(1, "abc", "abc"), (1, "abc", "b"), (1, "b", "b"), (2, "b", "b"), (2, "cb", "b"), (2, "cb", "cb")]


def test_long_titles_that_are_many(spark, many_names):
    rows = [(1, 1, "a" * 30 + "b"), (1, 2, "a" * 30), (1, 3, "b"), (1, 4, "c d"), (2, 5, "a" * 30)]
    e = spark.createDataFrame(rows, "script_id bigint, event_order bigint, title string").withColumn("location", F.lit(None).cast("string")).withColumn("time_point", F.lit(None).cast("string"))
    assert sorted(map(tuple, events.same_pairs(e).collect())) == [(1, 1, 2), (1, 1, 3)]


def _as_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, DATA)) == duck_rows(connect(), ORACLES[name])


def test_event_pairs_of_many_titles(spark, many_names):
    _as_sql(spark, "event_pairs")


def test_plot_firsts_of_many_titles(spark, many_names):
    _as_sql(spark, "plot_firsts")


def test_plot_pairs_of_many_titles(spark, many_names):
    _as_sql(spark, "plot_pairs")


def test_plot_merged_of_many_titles(spark, many_names):
    _as_sql(spark, "plot_merged")


def _plan(spark, name):
    return QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def test_speech_matched_makes_people_once(spark):
    plan = _plan(spark, "speech_matched")
    assert "Window" not in plan and "MapInArrow" not in plan


def test_speech_extract_searches_no_short_names(spark):
    assert "MapInArrow" not in _plan(spark, "speech_extract")


def test_content_fallback_searches_no_short_names(spark):
    assert "MapInArrow" not in _plan(spark, "content_fallback")


def test_speaker_link_makes_people_once(spark):
    # What is left is of the lines, whose scenes are numbered by two windows.
    assert _plan(spark, "speaker_link").count("Window [") <= 2
