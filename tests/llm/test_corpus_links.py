"""Vector links, the prefix trie and importance resampling against brute force, and the edge cases of their contracts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from engines import DATA, connect, duck_rows, spark_rows
from pyspark.sql import functions as F

from plotweave.llm import importance, prefixes, registry, vectors
from plotweave.llm.scan import scanned


@pytest.mark.parametrize("name", ["op11_vector_links", "op12_prefix_trie", "op13_importance"])
def test_same_rows_as_sql(spark, name):
    assert spark_rows(registry.queries()[name](spark, DATA)) == duck_rows(connect(), registry.oracle_sql()[name])


# --- 11 ----------------------------------------------------------------------------------------


def brute_links(rows, similarity=0.9):
    """(n_links, component) of each row, by all pairs."""
    ok = [v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    link = defaultdict(set)
    for a, (_, x) in enumerate(rows):
        for b, (_, y) in enumerate(rows[:a]):
            if ok[a] and ok[b] and len(x) == len(y):
                x_, y_ = np.array(x, float), np.array(y, float)
                if x_ @ y_ / math.sqrt(x_ @ x_) / math.sqrt(y_ @ y_) >= similarity:
                    link[a].add(b)
                    link[b].add(a)
    root = {}
    for a in range(len(rows)):
        if a not in root:
            seen, todo = {a}, [a]
            while todo:
                for b in link[todo.pop()] - seen:
                    seen.add(b)
                    todo.append(b)
            for b in seen:
                root[b] = min((rows[c][0] for c in seen if rows[c][0] is not None), default=None)
    return sorted(((rows[a][0], len(link[a]), root[a], rows[a][0] == root[a]) for a in range(len(rows))), key=str)


@pytest.mark.parametrize("block", [16, 64, vectors.BLOCK])
def test_links_are_those_of_all_pairs(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(40):  # groups of near vectors, chains among them, in a few directions
        at = rng.normal(0, 1, 12)
        for _ in range(rng.integers(1, 14)):
            at = at + rng.normal(0, 0.12, 12)
            rows.append((len(rows) * 7 % 1009, (at * rng.uniform(0.1, 50)).tolist()))
    rows += [(2000 + k, rows[3][1]) for k in range(30)]  # copies
    rows += [(3000 + k, rng.normal(0, 1, 5).tolist()) for k in range(20)]  # another length
    rows += [(3100, [1.0] * 11), (3101, [1.0] * 12), (3102, [2.0] * 12), (3102, [2.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = vectors.digest(vectors.linked(df, block=block)).collect()
    assert sorted(map(tuple, got), key=str) == brute_links(rows)


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [1.0, float("inf")]), (7, [3.0, 4.0]), (7, [3.0, 4.0]), (None, [3.0, 4.1]), (None, [-1.0, 0.0]), (8, [1e-30, 1e30]), (9, [0.0, 3e38]), (10, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    more = df.withColumns({c: F.lit("x") for c in ("n_links", "kept", "component_id", "h", "_h", "g", "node", "a", "block")})
    out = vectors.linked(more)
    got = {(r.vec_id, str(r.embedding)): r for r in out.collect()}
    assert set(out.columns) == set(more.columns) and out.count() == 13
    assert all(got[k, str(v)].n_links == 0 and got[k, str(v)].component_id == k and got[k, str(v)].kept for k, v in rows[:4])
    assert got[7, "[3.0, 4.0]"].n_links == 2 and got[7, "[3.0, 4.0]"].kept
    near = next(r for (k, _), r in got.items() if k is None and r.embedding[0] == 3)
    assert near.component_id == 7 and not near.kept and near.n_links == 2
    alone = next(r for (k, _), r in got.items() if k is None and r.embedding[0] == -1)
    assert alone.component_id is None and alone.kept and alone.n_links == 0
    eight = next(r for (k, _), r in got.items() if k == 8)
    assert eight.n_links == 1 and eight.component_id == 8
    assert vectors.linked(df.where("false")).count() == 0
    assert vectors.linked(df.where("vec_id < 4")).count() == 3  # no vector that can link


def test_a_link_at_the_threshold(spark):
    # The cosine of (4, 3) and (1, 0) is 0.8 exactly; that of (3, 4) and (1, 0) 0.6.
    df = spark.createDataFrame([(1, [4.0, 3.0]), (2, [1.0, 0.0]), (3, [0.0, -1.0])], "vec_id bigint, embedding array<float>")
    assert {r.vec_id: r.n_links for r in vectors.linked(df, similarity=0.8).collect()} == {1: 1, 2: 1, 3: 0}


def test_distant_blocks_are_skipped(spark):
    boxes = [(k, [float(k)], [k + 0.5]) for k in range(100)]
    df = spark.createDataFrame(boxes, "block bigint, lo array<double>, hi array<double>")
    got = {tuple(r) for r in vectors.near_blocks(df, 100, 1, 0.6).collect()}
    assert got == {(a, b) for a in range(100) for b in range(a, 100) if max(0, b - a - 0.5) <= 0.6}


# --- 12 ----------------------------------------------------------------------------------------


def brute_trie(rows):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    conv = {c: [x[2:] for x in sorted(v)] for c, v in conv.items()}
    nodes = {}
    for c in conv:
        h, base = zlib.crc32(str(c).encode()) % 9, int(math.fmod(c, 5))
        way = tuple(conv.get(c - base, [])[:h] + conv[c][h:])
        for d in range(len(way) + 1):
            n = nodes.setdefault(way[:d], ([], []))
            n[0].append(c)
        n[1].append(c)
    out = []
    for p, (members, last) in nodes.items():
        sub = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in sub if len(q) == len(p) + 1]
        childless = [q for q in sub if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in sub)]
        saved = sum((len(nodes[q][0]) - 1) * (len(q[-1][1].encode()) if q else 0) for q in sub)
        ids = ",".join(map(str, sorted(last)))
        out.append((min(members), len(p), min(nodes[p[:-1]][0]) if p else None, len(members), len(kids), len(childless), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


CONV = "conv_id bigint, turn bigint, role string, text string"


def test_trie_matches_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for c in [*range(-12, 60), *range(205, 215, 2), 8001, 8003, 99999]:
        for t in range(rng.choice([1, 2, 3, 5, 9, 14])):
            # Few texts, so that paths branch at all depths; some turns without number, role or text.
            rows.append((c, rng.choice([t, t, t, None]) if t == 0 else t, rng.choice(["user", "assistant", None]) if rng.random() < 0.2 else "user", rng.choice(["a", "bé", "", None]) if rng.random() < 0.3 else "same"))
    rows += [(300, t, "user", f"turn {t}") for t in range(200)] + [(301, t, "user", f"turn {t}") for t in range(150)]
    rows += [(None, 1, "user", "lost"), (None, None, None, None)]
    df = spark.createDataFrame(rows, CONV).withColumns({c: F.lit("x") for c in ("depth", "conv", "i", "k1", "one")}).repartition(5)
    got = sorted(map(tuple, prefixes.trie(df).collect()), key=str)
    assert got == brute_trie(rows)


def test_trie_edges(spark):
    assert prefixes.trie(spark.createDataFrame([], CONV)).count() == 0
    assert prefixes.trie(spark.createDataFrame([(None, 1, "user", "x")], CONV)).count() == 0
    # Conversation 1 begins with one that is absent, and all its turns are replaced: it has none.
    h = zlib.crc32(b"1") % 9
    rows = [(1, t, "user", "x") for t in range(h)]
    assert sorted(map(tuple, prefixes.trie(spark.createDataFrame(rows, CONV)).collect()), key=str) == brute_trie(rows)
    # Equal conversations, and repeated rows.
    rows = [(5 * c, t // 2, "user", "word " * 30_000) for c in range(40) for t in range(4)]
    assert sorted(map(tuple, prefixes.trie(spark.createDataFrame(rows, CONV)).collect()), key=str) == brute_trie(rows)


def test_ends_stream_in_order_of_ids(spark):
    convs = spark.range(0, 60_000, 7).select(F.col("id").alias("conv"), *(F.lit(0).cast("bigint").alias(c) for c in ("depth", "k1", "k2")))
    got = prefixes.ends(convs.repartition(6)).collect()
    assert [r.ends_sha256 for r in got] == [hashlib.sha256(",".join(map(str, range(0, 60_000, 7))).encode()).hexdigest()]


def test_scans_go_on_from_task_to_task(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rng = random.Random(1)
    sizes = [1, 700, 2, 1, 300, 5]
    rows = [(g, k, rng.randint(-9, 9), rng.getrandbits(62) - (1 << 61), rng.choice([None, None, None, rng.randint(0, 99)])) for g, n in enumerate(sizes) for k in range(n)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = spark.createDataFrame(rows, "g bigint, k bigint, v bigint, x bigint, y bigint").repartition(7)
        got = {(r.g, r.k): r for r in scanned(df, ["g"], ["k"], {"total": ("sum", "v"), "both": ("xor", "x"), "seen": ("last", "y")}).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows)
    at, total, both, seen = None, 0, 0, None
    for g, k, v, x, y in rows:
        if g != at:
            at, total, both, seen = g, 0, 0, None
        total, both, seen = total + v, both ^ x, seen if y is None else y
        assert (got[g, k].total, got[g, k].both, got[g, k].seen) == (total, both, seen)


# --- 13 ----------------------------------------------------------------------------------------

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def runs(text):
    w = WORD.findall((text or "").translate(LOWER))
    return Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % importance.BUCKETS for n in (1, 2, 3) for i in range(len(w) - n + 1)), len(w)


def brute_importance(docs, bench):
    s, t = (sum((runs(x)[0] for x in texts), Counter()) for texts in ([d[1] for d in docs], bench))
    all_s, all_t, b = sum(s.values()), sum(t.values()), importance.BUCKETS
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (all_s + b) / ((s[k] + 1) * (all_t + b))))
    out = []
    for i, text in docs:
        held, words = runs(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(n * gain(k) for k, n in held.items())
        out.append([i, sum(held.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2]))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_importance_matches_brute_force(spark):
    rng = random.Random(9)
    words = ["The", "of", "naïve", "straße", "x1", "data", "ZEBRA", "end", "日本", "a"]
    docs = [(k, " ".join(rng.choice(words) + rng.choice(["", "", ".", "\n", "\x00", "-"]) for _ in range(rng.choice([0, 1, 2, 19, 20, 60])))) for k in range(300)]
    docs += [(7, docs[7][1]), (900, None), (901, ""), (None, "lost " * 30), (902, "word and " * 40_000), (903, "é" * 9_000)]
    bench = [" ".join(rng.choice(words[:4]) for _ in range(30)) for _ in range(12)] + [None, ""]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("weight", "rank", "n_words", "k0", "row", "total", "part")}).repartition(6)
    aim = spark.createDataFrame([(k, x) for k, x in enumerate(bench)], "item_id bigint, text string")
    got = importance.digest(importance.resampled(df, aim)).collect()
    assert sorted(map(tuple, got), key=str) == brute_importance(docs, bench)
    kept = importance.resampled(df, aim, keep=df.columns)
    assert {"text", "k0", "part"} <= set(kept.columns) and kept.where("rank IS NOT NULL AND text IS NOT NULL").count() == sum(r.rank is not None for r in got)


@pytest.mark.parametrize("chunk", [64, 1000, importance.CHUNK])
def test_counts_do_not_depend_on_chunks(chunk):
    import pyarrow as pa

    texts = ["one Two three. four", None, "", "word and other " * 200, "é " * 50, "last"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    *rows, last = importance.counted([batch], importance.BUCKETS, chunk)
    want = [runs(t) for t in texts]
    assert [w for r in rows for w in r[1].to_pylist()] == [w for _, w in want]
    got = [dict(zip(b, n, strict=True)) for r in rows for b, n in zip(r[2].to_pylist(), r[3].to_pylist(), strict=True)]
    assert got == [dict(c) for c, _ in want]
    assert last[-1].sum() == sum(sum(c.values()) for c, _ in want)


def test_importance_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    assert importance.resampled(none, some).count() == 0
    got = importance.resampled(some, none).first()
    assert got.n_features == 6 and got["rank"] is None
