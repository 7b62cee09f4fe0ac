"""Places in an order, and links of decoded names."""

import random

from pyspark.sql import functions as F

from plotweave import story
from plotweave.operators import linking, scripts
from plotweave.operators.order import placed


def test_places_are_those_of_a_sort(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 40), rng.choice([None, "a", "b"]), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "x int, y string, k int").repartition(7)
    got = {r.k: r.place for r in placed(df, "place", F.desc("x"), "y", "k").collect()}
    want = sorted(rows, key=lambda r: (-r[0], r[1] is not None, r[1] or "", r[2]))
    assert got == {r[2]: n + 1 for n, r in enumerate(want)}
    assert placed(df.where("false"), "place", "x").count() == 0


def test_a_replaced_group_is_numbered_after_all(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 6, "b"), (2, 9, "c"), (3, 2, "d")], "g int, k int, name string")
    new = spark.createDataFrame([(3, 0, "z"), (1, 0, "y"), (1, 0, "x")], "g int, k int, name string")
    assert sorted(map(tuple, scripts.replaced(rows, new, "g", "k").collect())) == [(1, 10, "x"), (1, 11, "y"), (2, 9, "c"), (3, 12, "z")]
    assert scripts.replaced(rows, new.where("false"), "g", "k").count() == 4


def test_decoded_names_are_linked(spark):
    people = spark.createDataFrame([(1, 0, 7, "林川", ["川哥"]), (1, 1, 8, "川", None), (2, 0, 9, "林川", [])], "script_id bigint, pos int, character_id bigint, canonical_name string, aliases array<string>")
    actions = spark.createDataFrame([(1, 1, "川"), (1, 2, "林川师兄"), (1, 3, "川哥"), (1, 4, "王"), (1, 5, None), (2, 6, "林")], "script_id bigint, action_id bigint, name string")
    assert {r.action_id: r.character_id for r in linking.action_names(actions, people).collect()} == {1: 8, 2: 7, 3: 7, 4: None, 5: None, 6: 9}


def test_derived_tables_are_the_same_rows_every_time(spark):
    data = "/root/testdata/sf0.001"
    one, two = (sorted(map(str, story.PEOPLE.df(spark, data).collect())) for _ in range(2))
    assert one == two and len(one) > 1000
    names = story.PEOPLE.df(spark, data)
    assert names.groupBy("script_id", "canonical_name").count().where("count > 1").count() == 0
