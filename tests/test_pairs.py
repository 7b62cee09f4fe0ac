"""Similar titles, merged events and close names against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from plotweave.functions import distance
from plotweave.operators import events

EVENT = "script_id bigint, event_order int, title string, location string, time_point string"


def _same(a, b):
    if a[2] is not None and b[2] is not None:
        x, y = ("".join(t.split()) for t in (a[2], b[2]))
        if x in y or y in x or a[2] == b[2]:
            return True
        if len(set(x) & set(y)) / len(set(x) | set(y)) > 0.7:
            return True
    return a[3] is not None and a[3] == b[3] and a[4] is not None and a[4] == b[4]


def _events(seed):
    rng = random.Random(seed)
    chars = "abcdefghij林风"
    word = lambda: rng.choice([None, "", " ", *["".join(rng.choice(chars) for _ in range(rng.choice([1, 2, 5, 8, 9, 10, 40]))) for _ in range(9)]])
    rows = []
    for s in (1, 2, 2, 3):
        base = word() or "abcdefghi"
        for _ in range(40):
            title = rng.choice([word(), base[: rng.randint(1, len(base))], " ".join(base), base + rng.choice(chars)])
            rows.append((s, len(rows), title, rng.choice([None, "x", "y"]), rng.choice([None, "1", "2", "3"])))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_pairs_are_those_of_all_pairs(spark, seed):
    rows = _events(seed)
    df = spark.createDataFrame(rows, EVENT).withColumns({c: F.lit("z") for c in ("x", "y", "chars", "a")})
    got = sorted(map(tuple, events.same_pairs(df).collect()))
    assert got == sorted({(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and _same(a, b)})


@pytest.mark.parametrize("similarity", [0.3, 0.5, 0.7, 0.75, 0.9])
def test_similar_titles_lose_nothing(spark, similarity):
    rows = _events(7)
    df = spark.createDataFrame(rows, EVENT)
    found = events.similar_titles(events.titles(df), similarity)
    titles = {(r[0], "".join(r[2].split())) for r in rows if r[2] is not None}
    j = lambda x, y: len(set(x) & set(y)) / max(1, len(set(x) | set(y)))
    assert sorted(map(tuple, found.collect())) == sorted((s, x, y) for s, x in titles for q, y in titles if s == q and x < y and j(x, y) > similarity)


def test_candidates_follow_links(spark):
    # Titles of a script share their common characters, and none is similar to another.
    rare = [chr(0x4E00 + k) for k in range(4000)]
    rows = [(1, k, "的一是" + "".join(rare[4 * k : 4 * k + 4]), None, None) for k in range(900)]
    keys = events.titles(spark.createDataFrame(rows, EVENT))
    prefix = keys.select("x", F.explode(F.slice("chars", F.lit(1), F.size("chars") - F.floor(F.size("chars") * 0.7).cast("int"))).alias("c"))
    assert prefix.join(prefix.withColumnRenamed("x", "y"), "c").where("x < y").count() == 0
    assert events.same_pairs(spark.createDataFrame(rows, EVENT)).count() == 0


def test_new_events_go_into_the_first_existing_one(spark):
    full = EVENT + ", description string, conflict_type string, importance int, emotional_arc string, chapter_ids array<bigint>, character_ids array<bigint>"
    old = [(1, 1, "决战", None, None, "甲", None, 2, None, [3, 1], [9]), (1, 2, "决战 之前", "城", "夜", None, "C", 5, "↑", None, [7]), (1, 4, None, None, None, None, None, None, None, [], [])]
    new = [(1, 1, "大决战", "山", None, "乙", "D", 4, None, [2, 1], [8, 9]), (1, 2, "决战", None, None, "丙", None, 1, None, [5], []), (1, 3, "别的", "城", "夜", "丁", None, 1, None, [6], [7, 6]), (1, 4, "全新", None, None, "", None, 3, None, [1], [])]
    got = [tuple(r) for r in events.merged_into(spark.createDataFrame(old, full), spark.createDataFrame(new, full)).orderBy("event_order").collect()]
    assert got == [
        (1, 1, "决战", "甲；乙", "山", None, "D", 4, None, [1, 2, 3], [9, 8]),
        (1, 2, "决战 之前", "丁", "城", "夜", "C", 5, "↑", [6], [7, 6]),
        (1, 3, None, None, None, None, None, None, None, [], []),
        (1, 4, "全新", "", None, None, None, 3, None, [1], []),
    ]
    none = spark.createDataFrame([], full)
    assert events.merged_into(none, spark.createDataFrame(new, full)).count() == 4
    assert events.merged_into(spark.createDataFrame(old, full), none).count() == 3


def literal(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost = a[i - 1] != b[j - 1]
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + cost)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + cost)
    return d[len(a), len(b)]


@pytest.mark.parametrize("most", [None, 0, 1, 2, 3, 9])
def test_distances_are_those_of_the_literal_table(most):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc林𝒳") for _ in range(rng.randint(0, 9)))
    a, b = [word() for _ in range(900)], [word() for _ in range(900)]
    b[:300] = [s[:k] + s[k + 1 : k + 2] + s[k : k + 1] + s[k + 2 :] for s, k in ((s, rng.randint(0, 8)) for s in a[:300])]
    want = [literal(x, y) for x, y in zip(a, b, strict=True)]
    assert distance.aligned(a, b, most).tolist() == [d if most is None else min(d, most + 1) for d in want]


def test_names_of_given_tables(spark):
    c = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").select(F.col("c_name").alias("x"), (F.col("c_custkey") % 5).alias("k"))
    p = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select(F.col("p_name").alias("y"), (F.col("p_partkey") % 5).alias("k"))
    both = c.join(p, "k").select("x", "y", distance.osa(F.col("x"), F.col("y")).alias("d")).distinct().collect()
    assert len(both) > 1000 and all(r.d == literal(r.x, r.y) for r in both)


@pytest.mark.parametrize("most", [1, 2])
def test_close_names_are_those_of_all_pairs(spark, most):
    rng = random.Random(most)
    word = lambda: rng.choice([None, "", "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))])
    ours, theirs = ([(rng.randint(1, 2), word()) for _ in range(90)] for _ in range(2))
    x, y = spark.createDataFrame(ours, "s int, x string"), spark.createDataFrame(theirs, "s int, y string")
    got = sorted(map(tuple, distance.close_names(x, y, most, by="s").collect()))
    assert got == sorted({(s, a, b, literal(a, b)) for s, a in ours for q, b in theirs if s == q and a is not None and b is not None and literal(a, b) <= most})
    assert distance.osa.__doc__ and x.join(y, "s").where(F.col("x").isNull()).select(distance.osa(F.col("x"), F.col("y")).alias("d")).where("d IS NOT NULL").count() == 0
