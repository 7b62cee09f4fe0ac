"""Streams with a state of their own for each key: rising progress of runs, and kept answers to prompts.

State is in the checkpoint of the query, by key, so a restarted query goes on where it was. A timer for
each key ends its state: a run that has been quiet, an answer that is too old.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plotweave.sources.shared import fresh_path

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def records(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows, in order of time and event, that are above all before them."""
    rows = rows[rows["progress"].notna()].sort_values(["ts", "event_id"], kind="stable")
    before = rows["progress"].cummax().shift(1)
    return rows[before.isna() | (rows["progress"] > before)]


class Rising(StatefulProcessor):
    """Of each run, the events above all that came before, in this batch and in earlier ones."""

    def __init__(self, quiet_ms: int):
        self._quiet = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._best = handle.getValueState("best", "progress double, seen_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found, seen = None, 0
        for some in rows:  # what is kept of a batch is never more than what leaves it
            seen = max(seen, int(some["ts"].max().timestamp() * 1000))
            found = records(some if found is None else pd.concat([found, some]))
        best = self._best.get() if self._best.exists() else None
        if best is not None and best[0] is not None:
            found = found[found["progress"] > best[0]]
        top = max([x for x in (best and best[0], None if found.empty else float(found["progress"].iloc[-1])) if x is not None], default=None)
        seen = max(seen, best[1] if best else 0)
        self._best.update((top, seen))
        for old in list(self._handle.listTimers()):
            self._handle.deleteTimer(old)
        self._handle.registerTimer(seen + self._quiet)
        if not found.empty:
            yield found[["run_id", "event_id", "ts", "progress"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._best.clear()
        return iter([])

    def close(self) -> None:
        pass


def rising(events: DataFrame, late: str = "1 hour", quiet_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """run_id, event_id, ts and progress of the events of a stream that are above all before them in their run.

    events: those columns. A lower or equal value never leaves, also after a restart; a run of which
    nothing was heard for `quiet_ms` of event time is forgotten.
    """
    rows = events.select("run_id", "event_id", "ts", "progress").where("run_id IS NOT NULL").withWatermark("ts", late)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy("run_id").transformWithStateInPandas(Rising(quiet_ms), kinds, "Append", "EventTime")


def told(held: pd.DataFrame, asked: pd.DataFrame, ttl_ms: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The answers to the questions of a batch, and what is held under each key after it.

    held: key, answer, made_ms, a row a key; asked: key, event_id, ts, answer. No loop over keys.
    """
    ms = np.concatenate([held["made_ms"].to_numpy(np.int64), asked["ts"].to_numpy("datetime64[us]").astype(np.int64) // 1000])
    ts = np.concatenate([np.full(len(held), np.iinfo(np.int64).min), asked["ts"].to_numpy("datetime64[us]").astype(np.int64)])  # held ones are first
    event = np.concatenate([np.zeros(len(held), np.int64), asked["event_id"].to_numpy(np.int64)])
    key, answer = (np.concatenate([held[c].to_numpy(object), asked[c].to_numpy(object)]) for c in ("key", "answer"))
    code = pd.factorize(key)[0]
    order = np.lexsort((event, ts, code))
    ms, event, key, answer, code = (x[order] for x in (ms, event, key, answer, code))
    place = np.arange(len(code))
    put = pd.notna(answer)
    last = np.maximum.accumulate(np.where(put, place, -1)) if len(code) else place
    first = np.r_[True, code[1:] != code[:-1]][: len(code)]
    has = last >= np.maximum.accumulate(np.where(first, place, 0))  # else the last answer is another key's
    last = np.where(has, last, 0)
    hit = has & (ms - ms[last] <= ttl_ms) if len(code) else has
    out = pd.DataFrame({"key": key, "event_id": event, "hit": hit, "answer": np.where(hit, answer[last], None) if len(code) else answer})[~put]
    ends = np.r_[first[1:], True][: len(code)] & hit  # an answer that is too old for the last event is dropped
    return out, pd.DataFrame({"key": key[ends], "answer": answer[last[ends]], "made_ms": ms[last[ends]]})


_HELD = ["key", "answer", "made_ms"]


class Answers(StatefulProcessor):
    """Under each key the last answer that was put there, for a time; asked, it is told, or that there is none.

    The state is that of a bucket of keys, a row a key, read and written at once.
    """

    def __init__(self, ttl_ms: int):
        self._ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getListState("held", "key string, answer string, made_ms bigint")

    def _kept(self) -> pd.DataFrame:
        return pd.DataFrame(list(self._held.get()) if self._held.exists() else [], columns=_HELD)

    def _keep(self, held: pd.DataFrame) -> None:
        """Writes the rows of a bucket, with a timer for the one that is too old first."""
        for old in list(self._handle.listTimers()):
            self._handle.deleteTimer(old)
        if held.empty:
            self._held.clear()
        else:
            self._held.put(list(zip(held["key"].tolist(), held["answer"].tolist(), held["made_ms"].tolist(), strict=True)))
            self._handle.registerTimer(int(held["made_ms"].min()) + self._ttl + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self._kept()
        asked = pd.concat(list(rows))
        found, held = told(before, asked, self._ttl)
        held = pd.concat([held, before[~before["key"].isin(asked["key"])]]) if len(before) else held
        if len(held) or len(before):
            self._keep(held)
        if not found.empty:
            yield found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = self._kept()
        self._keep(held[held["made_ms"] + self._ttl >= now])
        return iter([])

    def close(self) -> None:
        pass


#: Buckets of keys; those of a checkpoint stay.
BUCKETS = 512


def answered(events: DataFrame, ttl_ms: int = 7_200_000, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """key, event_id, hit and answer of each question of a stream.

    events: key, event_id, ts, answer; an event with an answer puts it under its key, one without
    asks for it. An answer is told until it is `ttl_ms` old. A batch holds the events of a bucket of
    keys together: bound batches (maxFilesPerTrigger) where a key may have many.
    """
    rows = events.select("key", "event_id", "ts", "answer").where("key IS NOT NULL").withWatermark("ts", late)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return rows.groupBy("bucket").transformWithStateInPandas(Answers(ttl_ms), "key string, event_id bigint, hit boolean, answer string", "Append", "EventTime")


def replayed(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Runs a stateful stream over all that is there now, and adds its rows to the Parquet table `out`."""
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def replay(stream: DataFrame) -> DataFrame:
    """The rows of a stateful stream over all that is there now."""
    spark = stream.sparkSession
    out = fresh_path(spark, "stream")
    replayed(stream, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
