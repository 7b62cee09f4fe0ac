"""Suffix-array deduplication of byte strings that repeat across or within documents.

A byte goes if a string of `length` bytes that covers it also starts earlier (smaller document
id, or same document and earlier start). What is compared is always the input.

1. Anchors. Among the k-grams of every window of `length` bytes, the one of smallest hash is
   the window's anchor (the first one, if equal). Equal windows have equal anchors at equal
   offsets, so only text around equal anchors can repeat. Windows with the same anchor form a
   run; a run is described by the hash of its anchor and the hash of all its bytes.
2. Equal runs. Each task reports, of runs with equal hashes, only the first, so a copy that a
   third of all documents hold is as many rows as there are tasks. Runs grouped by anchor: all
   but the first of equal runs are repeats as a whole.
3. Different runs with the same anchor may share some windows. Their bytes are brought together
   and suffix-sorted; the longest previous factor of each window's start, from the previous and
   next smaller position in suffix order, shows windows that occur earlier. An anchor with more
   than HOT_RUNS different runs, or of more than CROWD in one fold of a task, is split: each of its
   windows goes to the task of its own bytes. Such a fold sends the anchor's runs to buckets of
   their content, so they do not meet in one task before the anchor is known to be hot.
4. Windows found are joined to the documents, and what they cover is cut out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm.bytekit import CHUNK_BYTES, RollingHash, chunks, gather_ranges, mix64, utf8, written

LENGTH, K = 100, 32
#: Anchors gathered in a task before equal runs are folded.
FOLD = 1_000_000
#: Bytes of input for each bucket of anchors, and the fewest buckets.
BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 64
#: Different runs of an anchor that are compared in one task, and that one fold sends to the anchor's bucket.
HOT_RUNS, CROWD = 5_000, 64

_FOUND = "doc bigint, kind int, start int, windows int, bucket int"
_RUN, _REQUEST, _HOT = 0, 1, 2


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """Row, first window start (in the buffer), number of windows, anchor hash and content hash of each run."""
    none = np.zeros(0, np.int64)
    count = np.maximum(np.diff(offsets) - (length - 1), 0)
    if not count.sum():
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    rolling = RollingHash(data)
    value = mix64(rolling.grams(k))
    grams = value
    place = np.arange(len(value), dtype=np.int32)
    width, span = length - k + 1, 1
    while span < width:
        step = min(span, width - span)
        later = value[step:] < value[: len(value) - step]
        value = np.where(later, value[step:], value[: len(value) - step])
        place = np.where(later, place[step:], place[: len(place) - step])
        span += step
    start = gather_ranges(offsets[:-1], count)
    row = np.repeat(np.arange(len(count)), count)
    anchor = place[start]
    fresh = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
    windows = np.diff(np.append(fresh, len(start)))
    first = start[fresh]
    return row[fresh], first, windows, grams[anchor[fresh]], rolling(first, first + windows + length - 1)


def _packed(*columns: np.ndarray) -> bytes:
    return np.int64(len(columns[0])).tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unpacked(blobs: list[bytes], types: list) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in types]
    for blob in blobs:
        n, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
        for part, kind in zip(parts, types, strict=True):
            part.append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(p) for p in parts]


def merged_runs(doc: np.ndarray, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs in (doc, start) order, with runs that touch or overlap made one."""
    if not len(doc):
        return doc, start, windows
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), (start + windows)[order].astype(np.int64)
    group = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    big = np.int64(end.max()) + 1
    reach = np.maximum.accumulate(end + group * big) - group * big
    fresh = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])]))
    last = np.append(fresh[1:], len(doc)) - 1
    return doc[fresh], start[fresh], reach[last] - start[fresh]


def _firsts(keys: tuple[np.ndarray, ...], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (keys, doc, start), and where a new key begins in it."""
    order = np.lexsort((start, doc)) if np.any((doc[1:] < doc[:-1]) | ((doc[1:] == doc[:-1]) & (start[1:] < start[:-1]))) else np.arange(len(doc))
    order = order[np.lexsort([k[order] for k in keys[::-1]])]
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[order][1:] != k[order][:-1]
    return order, fresh


_ANCHORS = "bucket int, runs binary, repeats binary, crowd binary, crowded binary"
_PLACES = [np.int64, np.int32, np.int32]
_RUNS = [*_PLACES, np.uint64, np.uint64]


def _map_anchors(n_buckets: int, length: int, crowd: int):
    """Runs by bucket of their anchors, equal ones of a fold once, and what repeats in the fold.

    An anchor of more than `crowd` different runs in one fold does not bring them to its bucket:
    they go to buckets of their content, and the anchor's bucket is only told of it.
    """

    def fold(held):
        doc, start, windows, anchor, content = (np.concatenate(x) for x in zip(*held, strict=True))
        order, fresh = _firsts((anchor, content), doc, start)
        again, first = order[~fresh], order[fresh]
        _, group, n = np.unique(anchor[first], return_inverse=True, return_counts=True)
        many = n[group] > crowd
        runs = merged_runs(doc[again], start[again], windows[again])
        share = np.linspace(0, len(runs[0]), n_buckets + 1).astype(int)
        narrow = lambda d, s, w: (d, s.astype(np.int32), w.astype(np.int32))

        def dealt(rows, hashed):
            bucket = (hashed % np.uint64(n_buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            return rows[by], np.searchsorted(bucket[by], np.arange(n_buckets + 1))

        kept, salted = np.sort(first[~many]), np.sort(first[many])
        (kept, cut), (salted, cut_salted) = dealt(kept, anchor[kept]), dealt(salted, content[salted])
        told = np.unique(anchor[salted])
        told, cut_told = dealt(told, told)
        ids, blobs = [], []
        for b in range(n_buckets):
            mine, others, hot, some = kept[cut[b] : cut[b + 1]], salted[cut_salted[b] : cut_salted[b + 1]], told[cut_told[b] : cut_told[b + 1]], slice(share[b], share[b + 1])
            if len(mine) or len(others) or len(hot) or share[b] < share[b + 1]:
                ids.append(b)
                packed = [_packed(*narrow(doc[x], start[x], windows[x]), anchor[x], content[x]) for x in (mine, others)]
                blobs.append((packed[0], _packed(*narrow(*(x[some] for x in runs))), packed[1], _packed(hot)))
        return pa.record_batch([pa.array(ids, pa.int32()), *(pa.array([x[k] for x in blobs], pa.binary()) for k in range(4))], ["bucket", "runs", "repeats", "crowd", "crowded"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets, CHUNK_BYTES):
                row, first, windows, anchor, content = anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)
                held.append((ids[i:j][row], first - (offsets[i : j + 1] - offsets[i])[row], windows, anchor, content))
                size += len(row)
                if size >= FOLD:
                    yield fold(held)
                    held, size = [], 0
        if size:
            yield fold(held)

    return run


def _reduce_anchors(hot: int):
    def run(table: pa.Table) -> pa.Table:
        again = _unpacked(table["repeats"].to_pylist(), _RUNS[:3])
        crowded = np.unique(_unpacked(table["crowded"].to_pylist(), [np.uint64])[0])
        asked, kinds, repeated = [], [], [again]
        for name in ("runs", "crowd"):
            doc, start, windows, anchor, content = _unpacked(table[name].to_pylist(), _RUNS)
            order, fresh = _firsts((anchor, content), doc, start)
            later, firsts = order[~fresh], order[fresh]
            _, group, n = np.unique(anchor[firsts], return_inverse=True, return_counts=True)
            many = np.isin(anchor[firsts], crowded) if name == "runs" else np.ones(len(firsts), bool)
            some = many | (n[group] > 1)
            asked.append([x[firsts[some]] for x in (doc, start, windows)])
            kinds.append(np.where(many | (n[group] > hot), _HOT, _REQUEST)[some])
            repeated.append([x[later] for x in (doc, start, windows)])
        runs = merged_runs(*(np.concatenate(x) for x in zip(*repeated, strict=True)))
        doc, start, windows = (np.concatenate(x) for x in zip(*asked, strict=True))
        bucket = table["bucket"][0].as_py() if table.num_rows else 0
        n = len(runs[0])
        return pa.table(
            {
                "doc": np.concatenate([runs[0], doc]).astype(np.int64),
                "kind": np.concatenate([np.full(n, _RUN), *kinds]).astype(np.int32),
                "start": np.concatenate([runs[1], start]).astype(np.int32),
                "windows": np.concatenate([runs[2], windows]).astype(np.int32),
                "bucket": np.full(n + len(doc), bucket, np.int32),
            }
        )

    return run


def _map_contexts(n_buckets: int, length: int):
    """Bytes of the requested runs, by bucket; windows of hot anchors one by one, by their own bytes.

    Of equal hot windows of a batch only the first goes to its bucket. The others are repeats, whatever
    other tasks hold, and are told as such: places without bytes, to a bucket of the batch.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch.column(1))
            lists = batch.column(2)
            at = np.asarray(lists.offsets)
            flat = lists.flatten() if not lists.offset else lists.values.slice(at[0], at[-1] - at[0])
            start, windows, bucket, kind = (flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "windows", "bucket", "kind"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            hot = kind == _HOT
            # One row for each window of a hot run.
            times = np.where(hot, windows, 1)
            step = gather_ranges(np.zeros(len(times), np.int64), times)
            src = np.repeat(np.arange(len(times)), times)
            start, windows, bucket, row, hot = start[src] + np.where(hot[src], step, 0), np.where(hot[src], 1, windows[src]), bucket[src], row[src], hot[src]
            begin = offsets[row] + start
            if hot.any():
                which = np.flatnonzero(hot)
                pieces = data[gather_ranges(begin[which], np.full(len(which), length))]
                value = RollingHash(pieces)(np.arange(len(which)) * length, (np.arange(len(which)) + 1) * length)
                bucket[which] = (value % np.uint64(n_buckets)).astype(np.int64)
                first, fresh = _firsts((value,), ids[row[which]], start[which])
                again = which[first[~fresh]]
                runs = merged_runs(ids[row[again]], start[again], windows[again])
                if len(again):
                    share = np.uint64(mix64(np.array([int(ids[0]) & ((1 << 63) - 1)], np.uint64))[0]) % np.uint64(n_buckets)
                    yield told([int(share)], [_packed(*(np.zeros(0, t) for t in _PLACES))], [b""], [_packed(*(x.astype(t) for x, t in zip(runs, _PLACES, strict=True)))])
                stay = np.ones(len(bucket), bool)
                stay[again] = False
                start, windows, bucket, row, begin = (x[stay] for x in (start, windows, bucket, row, begin))
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]])) if len(order) else order
            out_b, out_m, out_t = [], [], []
            for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
                mine = order[a:b]
                out_b.append(int(bucket[mine[0]]))
                out_m.append(_packed(ids[row[mine]], start[mine].astype(np.int32), windows[mine].astype(np.int32)))
                out_t.append(data[gather_ranges(begin[mine], windows[mine] + length - 1)].tobytes())
            if out_b:
                yield told(out_b, out_m, out_t, [None] * len(out_b))

    def told(bucket, meta, data, repeats):
        return pa.record_batch([pa.array(bucket, pa.int32()), *(pa.array(x, pa.binary()) for x in (meta, data, repeats))], ["bucket", "meta", "bytes", "repeats"])

    return run


def ranks(data: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """Rank of the `half` bytes at each position, by doubling from 8 bytes; half <= length < 2 * half."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(len(data), np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + len(data)].astype(np.uint64)
    half = 8
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    del key, padded
    while half * 2 <= length:
        after = np.zeros(len(rank), np.int64)
        after[: max(0, len(rank) - half)] = rank[half:] + 1
        rank = np.unique(rank << 32 | after, return_inverse=True)[1].astype(np.int64)
        half *= 2
    return rank.astype(np.int32), half


def longest_previous(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix, in suffix order.

    position: where the suffixes start; common[i]: common prefix of suffixes i-1 and i. The
    earlier match is the previous or next smaller position in suffix order; both are found by
    jumping over larger ones, taking the smallest common prefix along.
    """

    def smaller(pos, lcp):
        n = len(pos)
        jump, least = np.arange(-1, n - 1), lcp.copy()
        live = np.flatnonzero((jump >= 0) & (least > 0))
        while len(live):
            live = live[pos[jump[live]] > pos[live]]
            over = jump[live]
            least[live] = np.minimum(least[live], least[over])
            jump[live] = jump[over]
            live = live[(jump[live] >= 0) & (least[live] > 0)]
        least[jump < 0] = 0
        return least

    before = smaller(position, common)
    after = smaller(position[::-1], np.concatenate([common[1:], [0]])[::-1])[::-1] if len(common) else common
    return np.maximum(before, after)


def repeated_windows(meta: list[np.ndarray], data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that occur earlier among these runs (doc, start, windows; bytes one after another)."""
    doc, start, windows = meta
    if not len(doc):
        return doc, start, windows
    begin = np.cumsum(windows + length - 1) - (windows + length - 1)
    order = np.lexsort((start, doc))
    age = np.empty(len(order), np.int64)
    age[order] = np.arange(len(order))
    rank, half = ranks(data, length)
    at = gather_ranges(begin, windows)
    owner = np.repeat(np.arange(len(doc)), windows)
    offset = at - begin[owner]
    head, tail = rank[at], rank[at + length - half]
    # Places in the order of (doc, start): later than any window of an earlier run.
    place = (np.cumsum(windows[order]) - windows[order])[age][owner] + offset
    suffix = np.lexsort((place, tail, head))
    same = (head[suffix][1:] == head[suffix][:-1]) & (tail[suffix][1:] == tail[suffix][:-1])
    lpf = longest_previous(place[suffix], np.concatenate([[0], np.where(same, length, 0)]))
    hit = np.sort(suffix[lpf >= length])
    return merged_runs(doc[owner[hit]], start[owner[hit]] + offset[hit], np.ones(len(hit), np.int64))


def _reduce_contexts(length: int):
    def run(table: pa.Table) -> pa.Table:
        meta = [c.astype(np.int64) for c in _unpacked(table["meta"].to_pylist(), _PLACES)]
        data = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8)
        again = [c.astype(np.int64) for c in _unpacked([x for x in table["repeats"].to_pylist() if x], _PLACES)]
        doc, start, windows = merged_runs(*(np.concatenate(x) for x in zip(repeated_windows(meta, data, length), again, strict=True)))
        n = len(doc)
        return pa.table({"doc": doc.astype(np.int64), "kind": np.zeros(n, np.int32), "start": start.astype(np.int32), "windows": windows.astype(np.int32), "bucket": np.zeros(n, np.int32)})

    return run


def _cut(length: int, kind: str):
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            raw = data.tobytes()
            removed, spans, digests, kept = [], [], [], []
            for r, runs in enumerate(batch.column(2).to_pylist()):
                text = raw[offsets[r] : offsets[r + 1]]
                parts, at, gone, n = [], 0, 0, 0
                for x in sorted((x["start"], x["windows"]) for x in runs or ()):
                    a, b = x[0], x[0] + x[1] + length - 1
                    if b <= at:
                        continue
                    if a > at or not n:
                        parts.append(text[at:a])
                        n += 1
                    gone += b - max(a, at)
                    at = b
                parts.append(text[at:])
                left = b"".join(parts)
                removed.append(gone)
                spans.append(n)
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield pa.record_batch([batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])

    return run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_bytes binary"


def deduplicated(docs: DataFrame, length: int = LENGTH, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_bytes of each row.

    Null and empty texts have no bytes. Ids order the documents; null ids come last. Rows with
    equal ids are ordered by text, and of rows equal in both the later in the written order is
    the copy. kept_bytes may end inside a character, as removal works on bytes.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    facts = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes")).agg(F.max("n"), F.sum("bytes"), F.max(F.col("doc_id").isNull())).first()
    if kind == "bigint" and (facts[0] or 0) <= 1 and not facts[2]:
        rows = rows.withColumn("doc", F.col("doc_id"))
    else:  # order-preserving ids; they stay as they are, since the table is written
        rows = written(rows.orderBy(F.col("doc_id").isNull(), "doc_id", "text").withColumn("doc", F.monotonically_increasing_id()), "ordered")
    n_buckets = max(LEAST_BUCKETS, -(-int(facts[1] or 0) // BUCKET_BYTES))
    mapped = rows.select("doc", "text").mapInArrow(_map_anchors(n_buckets, length, CROWD), _ANCHORS)
    found = written(mapped.groupBy("bucket").applyInArrow(_reduce_anchors(HOT_RUNS), _FOUND), "runs")
    requests = found.where(f"kind <> {_RUN}").groupBy("doc").agg(F.collect_list(F.struct("start", "windows", "bucket", "kind")).alias("asked"))
    texts = rows.join(requests.hint("shuffle_hash"), "doc").select("doc", "text", "asked")
    contexts = texts.mapInArrow(_map_contexts(n_buckets, length), "bucket int, meta binary, bytes binary, repeats binary")
    partial = written(contexts.groupBy("bucket").applyInArrow(_reduce_contexts(length), _FOUND), "shared")
    runs = found.where(f"kind = {_RUN}").unionByName(partial).groupBy("doc").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    run, schema = _cut(length, kind)
    out = rows.join(runs.hint("shuffle_hash"), "doc", "left").select("doc_id", "text", "runs").mapInArrow(run, schema)
    return out if keep_bytes else out.drop("kept_bytes")
