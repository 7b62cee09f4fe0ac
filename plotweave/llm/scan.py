"""Running values along sorted groups of any length, none of which one task has to hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotweave.llm.bytekit import fresh, written


class _Segments:
    """Running values over the batches of one sorted partition; each value starts anew where the group changes."""

    def __init__(self, group: list[str], ops: dict[str, tuple[str, str]]):
        self.group, self.ops = group, ops
        self.last_group, self.segments, self.carry = None, 0, {}

    def add(self, batch: pa.RecordBatch) -> tuple[list[pa.Array], np.ndarray]:
        """The running values of the rows, and which of them are in the partition's first segment."""
        n, at = batch.num_rows, np.arange(batch.num_rows)
        keys = np.stack([batch.column(c).to_numpy() for c in self.group])
        change = np.ones(n, bool)
        change[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
        change[0] = self.last_group is None or bool((keys[:, 0] != self.last_group).any())
        start = np.maximum.accumulate(np.where(change, at, -1))
        going, begin = start < 0, np.maximum(start, 0)
        first = self.segments + np.cumsum(change) == 1
        out = []
        for name, (op, column) in self.ops.items():
            values = batch.column(column)
            if op == "last":
                valid = values.is_valid().to_numpy(zero_copy_only=False)
                v = values.fill_null(0).to_numpy()
                found = np.maximum.accumulate(np.where(valid, at, -1))
                own = (found >= begin) & (found >= 0)
                before, known = self.carry.get(name, (0, False))
                value = np.where(own, v[np.maximum(found, 0)], np.where(going, before, 0))
                ok = own | (going & known)
                self.carry[name] = (value[-1], bool(ok[-1]))
                out.append(pa.array(value, pa.int64(), mask=~ok))
                continue
            v = values.to_numpy()
            ufunc, undo = (np.add, np.subtract) if op == "sum" else (np.bitwise_xor, np.bitwise_xor)
            total = ufunc.accumulate(v)
            value = np.where(going, ufunc(total, self.carry.get(name, 0)), undo(total, undo(total[begin], v[begin])))
            self.carry[name] = value[-1]
            out.append(pa.array(value, pa.int64()))
        self.last_group, self.segments = keys[:, -1], self.segments + int(change.sum())
        return out, first


def scanned(df: DataFrame, group: list[str], order: list[str], ops: dict[str, tuple[str, str]]) -> DataFrame:
    """df with running values in a written table: for each name of `ops` the "sum", "xor" or "last" non-null of a column, up to and with each row of its group in this order.

    All columns used are bigints; those of `group` and of sums and xors have no nulls. Rows are
    range-partitioned by group and order, so a group of any size is dealt out; each partition is
    scanned alone, and what its first group has before it comes from a row for each task.
    """
    part, first, edge = (fresh(df, c) for c in ("_part", "_first", "_edge"))
    longs = [T.StructField(n, T.LongType()) for n in ops]
    schema = T.StructType([*df.schema, *longs, T.StructField(part, T.IntegerType()), T.StructField(first, T.BooleanType()), T.StructField(edge, T.StringType())])

    def run(batches):
        from pyspark import TaskContext

        state, held, number = _Segments(group, ops), None, TaskContext.get().partitionId()

        def told(batch, values, inside, edges):
            more = [pa.array(np.full(batch.num_rows, number, np.int32)), pa.array(inside), pa.array(edges, pa.string())]
            return pa.RecordBatch.from_arrays([*batch.columns, *values, *more], schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            edges = [None] * batch.num_rows
            if held is None:
                edges[0] = "a"
            else:
                yield told(*held)
            held = (batch, *state.add(batch), edges)
        if held is not None:
            held[-1][-1] = "az" if held[-1][-1] else "z"
            yield told(*held)

    sorted_rows = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    out = written(sorted_rows.mapInArrow(run, schema), "scanned")
    edges = out.where(F.col(edge).isNotNull()).select(part, first, edge, *group, *ops).collect()  # two rows a task at most
    lead = _before(edges, part, first, edge, group, ops)
    names = {n: fresh(df, f"_{n}_before") for n in ops}
    before = df.sparkSession.createDataFrame(lead, T.StructType([T.StructField(part, T.IntegerType()), *(T.StructField(names[n], T.LongType()) for n in ops)]))
    joined = out.join(F.broadcast(before), part, "left")
    for n, (op, _) in ops.items():
        here, there = F.col(n), F.col(names[n])
        both = F.coalesce(here, there) if op == "last" else here + there if op == "sum" else here.bitwiseXOR(there)
        joined = joined.withColumn(n, F.when(F.col(first) & F.col(part).isin([r[0] for r in lead]), both).otherwise(here) if lead else here)
    return joined.drop(part, first, edge, *names.values())


def _before(edges: list, part: str, first: str, edge: str, group: list[str], ops: dict[str, tuple[str, str]]) -> list[tuple]:
    """What the first group of a partition has in the partitions before it, where it has anything."""
    begins = {r[part]: r for r in edges if "a" in r[edge]}
    ends = {r[part]: r for r in edges if "z" in r[edge]}
    out, open_, at = [], None, None
    for p in sorted(begins):
        key = tuple(begins[p][c] for c in group)
        carried = open_ if at == key else None
        if carried is not None:
            out.append((p, *carried))
        end = ends[p]
        at, open_ = tuple(end[c] for c in group), [end[n] for n in ops]
        if end[first] and carried is not None:  # all of it is one group that goes on
            for k, (op, _) in enumerate(ops.values()):
                x, y = carried[k], open_[k]
                open_[k] = (x if y is None else y) if op == "last" else x + y if op == "sum" else x ^ y
    return out
