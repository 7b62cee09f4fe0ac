"""Stateful streams: rows of the batch versions, and restarts that lose and repeat nothing."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plotweave.streaming import progress, state

EVENT = "run_id bigint, event_id bigint, ts timestamp, progress double"


def _rows(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), k, 1_700_000_000 + 60 * (k // 3), rng.choice([None, float("nan"), *[round(rng.random() * (20 + k), 1) for _ in range(12)]])) for k in range(400)]
    df = spark.createDataFrame([(a, b, c, None if d is not None and d != d else d) for a, b, c, d in rows], "run_id bigint, event_id bigint, t bigint, progress double")
    return df.select("run_id", "event_id", F.timestamp_seconds(F.col("t") + 1_000_000_000).alias("ts"), "progress")


def _write(df, path, name):
    df.coalesce(1).write.parquet(str(path / name))


def test_a_restarted_stream_loses_and_repeats_nothing(spark, tmp_path):
    df = _rows(spark)
    rows, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    for k in range(4):
        _write(df.where(F.floor(F.col("event_id") / 100) == k), rows, f"part{k}")
        stream = spark.readStream.schema(df.schema).parquet(str(rows / "*"))
        state.replayed(state.rising(stream), out, checkpoint)  # each run starts from the checkpoint of the one before
    got = sorted((r.run_id, r.event_id, r.progress) for r in spark.read.parquet(out).collect())
    want = progress.monotone(df.where("run_id IS NOT NULL AND progress IS NOT NULL"), order=("ts", "event_id"))
    assert got == sorted((r.run_id, r.event_id, r.progress) for r in want.collect())
    assert 10 < len(got) < 400


def test_runs_are_forgotten_when_they_are_quiet(spark, tmp_path):
    rows = [(1, 1, 0, 50.0), (2, 2, 100, 1.0), (2, 3, 200, 2.0), (1, 4, 300, 10.0)]
    df = spark.createDataFrame(rows, "run_id bigint, event_id bigint, t bigint, progress double").select("run_id", "event_id", F.timestamp_seconds(F.col("t") + 1_000_000_000).alias("ts"), "progress")
    for quiet, want in ((1000 * 1000, [1, 2, 3]), (10 * 1000, [1, 2, 3, 4])):
        place = tmp_path / str(quiet)
        for k in range(1, 5):
            _write(df.where(F.col("event_id") == k), place / "in", f"part{k}")
            state.replayed(state.rising(spark.readStream.schema(df.schema).parquet(str(place / "in" / "*")), "1 second", quiet), str(place / "out"), str(place / "cp"))
        assert sorted(r.event_id for r in spark.read.parquet(str(place / "out")).collect()) == want


@pytest.mark.parametrize("parts", [1, 3])
def test_answers_are_kept_for_a_time(spark, tmp_path, parts):
    events = [("a", 1, 0, None), ("a", 2, 10, "one"), ("a", 3, 20, None), ("b", 4, 30, None), ("a", 5, 40, "two"), ("a", 6, 139, None), ("a", 7, 140, None), ("a", 8, 141, None), ("a", 9, 500, "three"), ("a", 10, 600, None), (None, 11, 601, None), ("a", 12, 601, None)]
    df = spark.createDataFrame(events, "key string, event_id bigint, t bigint, answer string").select("key", "event_id", F.timestamp_seconds(F.col("t") + 1_000_000_000).alias("ts"), "answer")
    for k in range(parts):
        _write(df.where(F.floor((F.col("event_id") - 1) * parts / 12) == k), tmp_path / "in", f"part{k}")
        state.replayed(state.answered(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in" / "*")), 100_000, "1 second"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r.event_id, r.hit, r.answer) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, False, None), (3, True, "one"), (4, False, None), (6, True, "two"), (7, True, "two"), (8, False, None), (10, True, "three"), (12, False, None)]


def test_answers_of_many_keys_are_told_at_once():
    rng = random.Random(9)
    held, want, kept = {}, [], pd.DataFrame({"key": [], "answer": [], "made_ms": []})
    for batch in range(4):
        rows = [(f"k{rng.randrange(40)}", k, pd.Timestamp(10**9 * (1000 + 100 * batch) + rng.randrange(10**11)), rng.choice([None, None, f"a{batch}.{k}"])) for k in range(300)]
        found, kept = state.told(kept, pd.DataFrame(rows, columns=["key", "event_id", "ts", "answer"]), 40_000)
        want = []
        for key, k, ts, answer in sorted(rows, key=lambda r: (r[2], r[1])):
            now = ts.value // 1_000_000
            if key in held and now - held[key][1] > 40_000:
                del held[key]
            if answer is None:
                want.append((key, k, key in held, held[key][0] if key in held else None))
            else:
                held[key] = (answer, now)
        assert sorted(found.itertuples(index=False, name=None)) == sorted(want)
        asked = {r[0] for r in rows}
        assert sorted(kept.itertuples(index=False, name=None)) == sorted((k, *v) for k, v in held.items() if k in asked)
        held = {k: v for k, v in held.items() if k in asked}
