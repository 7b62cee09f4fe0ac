"""Each operator against a brute-force version on small tables, and the edge cases of its contract."""

import hashlib
import itertools
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plotweave.llm import decontaminate, hpylm, lines, mixing, neardup, pii, quality, repeats, rules, toxicity
from plotweave.llm.bytekit import RollingHash, hash_bytes, mix64
from plotweave.llm.graph import components, extended

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = "word " * 30_000 + "end."
    rows = [(1, "alpha beta gamma delta epsilon", "en", "a", 5), (1, "alpha beta gamma delta epsilon", "en", "a", 5), (2, None, None, None, None), (None, "lost id", "en", None, 3), (3, "", "en", "b", 0), (4, long, "en", "b", 9), (5, "a\n\n\nb\na", "en", "c", 1), (6, "   ", None, "a", None), (7, "é" * 500, "fr", "", 2)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"score": F.lit(1), "kept": F.lit("x"), "llr": F.lit(0), "n_words": F.lit(2), "size": F.lit(3), "spans": F.lit(4), "n_lines": F.lit(1), "root": F.lit(1), "rid": F.lit(9), "node": F.lit(3), "row": F.lit(0), "bucket": F.lit("z"), "x": F.lit(0), "class_id": F.lit(8), **{c: F.lit(7) for c in ("_w", "_h", "_l", "_row", "_rid", "_lines", "_gone", "h", "key")}})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.read.parquet(f"{DATA}/benchmark.parquet")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- 1 and 4 -----------------------------------------------------------------------------------


def test_misspelt_insults_share_subwords():
    rng = random.Random(3)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    bad = ["stupid", "worthless", "pathetic"]
    texts, y = [], []
    for k in range(400):
        words = [rng.choice(plain) for _ in range(rng.randint(15, 90))]
        if k % 3 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(bad)
        texts.append(" ".join(words))
        y.append(int(k % 3 == 0))

    def bags(text):
        data = np.frombuffer(text.encode(), np.uint8)
        table_rows, upto_word, upto = toxicity.features(data, np.array([0, len(data)]))
        first, end, _ = toxicity.segments(upto)
        return table_rows[upto_word[first[0]] : upto_word[end[-1]]] if len(first) == 1 else np.concatenate([table_rows[upto_word[a] : upto_word[b]] for a, b in zip(first, end, strict=True)]), np.array([upto_word[b] - upto_word[a] for a, b in zip(first, end, strict=True)])

    model = toxicity.train([bags(t) for t in texts], np.array(y), math.log(0.5))

    def score(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return model.score(data, np.array([0, len(data)]))[0]

    held = [" ".join(rng.choice(plain) for _ in range(60)) for _ in range(40)]
    assert sum(score(t) >= 0.3 for t in held) <= 2
    assert sum(score(t + " stuppid worthles pathetik " + t) >= 0.3 for t in held) >= 36


@pytest.mark.parametrize(("module", "modulus", "rest", "label"), [(toxicity, 4, 2, "toxic"), (quality, 5, 0, "quality")])
def test_classifiers(spark, docs, labels, odd, none, module, modulus, rest, label):
    got = {r.doc_id: r for r in module.classified(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % modulus == rest) for k, r in got.items())
    # Labels of held-out rows, and other columns, do not reach a score.
    other = labels.withColumn(label, F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == rest, 1 - F.col(label)).otherwise(F.col(label)))
    again = {r.doc_id: r.score for r in module.classified(docs.withColumn("source", F.lit("x")), other).collect()}
    assert all(abs(again[k] - r.score) < 1e-9 for k, r in got.items())
    assert module.classified(odd, labels).count() == 9 and module.classified(none, labels).count() == 0
    unlabelled = labels.where("false")
    assert module.classified(docs, unlabelled).count() == docs.count()


def test_quality_is_learned(docs, labels):
    y = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r for r in quality.classified(docs, labels).collect()}
    held = [k for k in y if got[k].held_out]
    assert sum(got[k].predicted == y[k] for k in held) >= 0.9 * len(held)


def test_toxicity_scores_match_brute_force():
    rng = np.random.default_rng(3)
    model = toxicity.Subwords(rng.normal(0, 1, 1 << toxicity.BITS).astype(np.float32), -0.4)
    value = lambda b: int(hash_bytes([b])[0])

    def brute(text):
        words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", text.translate(LOWER))
        starts = [min(k, max(0, len(words) - toxicity.SEGMENT)) for k in range(0, len(words), toxicity.SEGMENT)]
        best = []
        for k in starts:
            bag = []
            for w in words[k : k + toxicity.SEGMENT]:
                b = b"\x01" + w.encode() + b"\x01"
                bag.append(value(b) >> (64 - toxicity.BITS))
                bag += [int(mix64(RollingHash(np.frombuffer(b, np.uint8)).grams(n)[i : i + 1])[0]) >> (64 - toxicity.BITS) for n in toxicity.GRAMS for i in range(len(b) - n + 1)]
            best.append(np.mean(model.weight[bag].astype(float)))
        return 1 / (1 + math.exp(-(max(best, default=0.0) + model.bias)))

    texts = ["", "Hi", "one two, three! vier fünf", " ".join(f"wort{k % 7}é" for k in range(40)), "a " * 13]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    assert np.allclose(model.score(data, offsets), [brute(t) for t in texts], atol=1e-5)


def test_discriminant_is_the_difference_of_log_densities():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (300, quality.FEATURES)), rng.normal(0.5, 1.5, (200, quality.FEATURES))])
    y = np.repeat([0, 1], [300, 200])
    model = quality.Discriminant.fit(x, y, -0.3)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-6), -8, 8)
    covs = [np.cov(z[y == k], rowvar=False) for k in (0, 1)]
    pooled = (covs[0] * 300 + covs[1] * 200) / 500
    logs = []
    for k in (0, 1):
        c = (1 - quality.TO_DIAGONAL - quality.TO_POOLED) * covs[k] + quality.TO_DIAGONAL * np.diag(np.diag(covs[k])) + quality.TO_POOLED * pooled + quality.RIDGE * np.eye(quality.FEATURES)
        d = z - z[y == k].mean(0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.linalg.slogdet(c)[1]))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] - 0.3, -500, 500))))


def test_toxicity_fits_whole_texts():
    texts = ["word " * 5000 + "stupid " * 12, ""]
    (rows, sizes), (none_rows, none_sizes) = list(toxicity.Bags([t.encode() for t in texts]))
    assert len(sizes) == -(-5012 // toxicity.SEGMENT) and sizes.sum() == len(rows) and len(none_rows) == len(none_sizes) == 0


# --- 2 -----------------------------------------------------------------------------------------


def words_of(text):
    return SPACED.findall((text or "").translate(LOWER))


def shingle_counts(text):
    w = words_of(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def union_find(ids, edges):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates_match_brute_force(spark, docs):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for k in range(60):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 6, 9])):
            copy[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((10_000 + k, " ".join(copy)))
    sets = {i: shingle_counts(t) for i, t in rows}
    edges = []
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        nx, ny = sum(x.values()), sum(y.values())
        if min(nx, ny) < 0.8 * max(nx, ny):
            continue
        m = sum((x & y).values())
        if (nx + ny == 0) or m / (nx + ny - m) >= 0.8:
            edges.append((a, b))
    want = union_find(sets, edges)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.class_id for r in neardup.classes(df).collect()} == want
    assert neardup.representatives(df).count() == len(set(want.values()))


def test_alignment_is_the_longest_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = rng.integers(0, 6, rng.integers(0, 25))
        b = np.array([x for x in a if rng.random() > 0.15] + list(rng.integers(0, 6, rng.integers(0, 4))), int)
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        m, n = table[-1, -1], len(a) + len(b)
        assert neardup.aligned(a.astype(np.uint64), b.astype(np.uint64)) == (n == 0 or (len(a) > 0 and len(b) > 0 and m >= 0.8 / 1.8 * n - 1e-9))


def test_short_texts_that_can_be_linked_are_candidates(spark):
    rng = np.random.default_rng(5)
    seen = Counter()
    for _ in range(4000):
        a = rng.integers(0, 1 << 40, int(rng.integers(1, 10))).astype(np.uint64)
        b = a.copy()
        for _ in range(int(rng.integers(0, 4))):
            at = int(rng.integers(0, len(b) + 1))
            b = np.insert(b, at, np.uint64(rng.integers(0, 1 << 40))) if rng.random() < 0.7 or len(b) < 2 else np.delete(b, min(at, len(b) - 1))
        if neardup.aligned(a, b):
            assert set(neardup.sketch(a).tolist()) & set(neardup.sketch(b).tolist()), (len(a), len(b))
            seen[min(len(a), len(b)), max(len(a), len(b))] += 1
    assert {(4, 5), (5, 6), (7, 8), (8, 10), (9, 11)} <= set(seen)
    words = [f"w{k}" for k in range(10)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:9])), (3, " ".join(words[1:9])), (4, "x " + " ".join(words[2:9]))]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_near_duplicate_edges(odd, none):
    got = [(r.doc_id, r.class_id) for r in neardup.classes(odd).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (1, 1), (2, 2), (3, 2), (6, 2), (4, 4), (5, 5), (7, 7), (None, None)], key=str)
    assert neardup.classes(none).count() == 0 and neardup.representatives(none).count() == 0
    kept = neardup.representatives(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 4, 5, 7, None], key=str)


def test_rows_of_one_id_are_documents_of_their_own(spark):
    texts = ["a b c d e f g h", "k l m n o p q r", "s t u v w x y z"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0]), (3, texts[1]), (4, texts[2]), (None, texts[2]), (None, "null null")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, neardup.classes(df).collect()), key=str) == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (None, 4), (None, None)], key=str)
    assert sorted(map(tuple, neardup.representatives(df).collect()), key=str) == sorted([(1, texts[0]), (1, texts[1]), (4, texts[2]), (None, "null null")], key=str)


def test_components_extend_earlier_ones(spark):
    df = lambda edges: spark.createDataFrame(edges, "a bigint, b bigint")
    roots = components(df([(2, 1), (4, 3), (9, 8)]))
    got = {r.node: r.root for r in extended(roots, df([(4, 2), (20, 21), (8, 30)])).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, 20: 20, 21: 20, 30: 8}
    assert {r.node: r.root for r in extended(components(df([])), df([(5, 6)])).collect()} == {5: 5, 6: 5}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(70)]
    want = union_find({x for e in edges if e[0] != e[1] for x in e}, edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == want


# --- 3 -----------------------------------------------------------------------------------------


def test_decontamination_in_blocks(spark, docs, bench):
    whole = decontaminate.digest(decontaminate.contamination(docs, bench))
    parts = decontaminate.digest(decontaminate.contamination(docs, bench, block_phrases=60))
    assert rows_of(whole) == rows_of(parts)
    # Rows of one id, and of none, stay apart; an item longer than a block is cut.
    items = [r.text for r in bench.collect()]
    twice = spark.createDataFrame([(1, items[0]), (1, "else"), (1, items[0]), (None, items[1]), (None, items[0] + " " + items[1]), (2, None)], "doc_id bigint, text string")
    whole_twice = decontaminate.digest(decontaminate.contamination(twice, bench))
    for size in (7, 60):
        assert rows_of(whole_twice) == rows_of(decontaminate.digest(decontaminate.contamination(twice, bench, block_phrases=size)))
    assert whole_twice.count() == 6
    assert decontaminate.decontaminated(docs, bench).count() == whole.where("NOT contaminated").count()


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(8)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    vocabulary = ["A", "b", "c1", "é"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([12, 10, 3, 1, 0, 11])] + [(9, None), (10, "b, B! b")]
    texts = [(k, " ".join(rng.choice([*vocabulary, "zz"]) for _ in range(rng.randrange(60)))) for k in range(80)] + [(90, None), (91, items[0][1] + "." + items[1][1])]
    got = {r.doc_id: r for r in decontaminate.digest(decontaminate.contamination(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string"))).collect()}
    for i, text in texts:
        w = word.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for item, phrase in items:
            p = word.findall((phrase or "").translate(LOWER))
            n = min(10, len(p))
            for g in {tuple(p[s : s + n]) for s in range(len(p) - n + 1)} if n else ():
                for s in range(len(w) - n + 1):
                    if tuple(w[s : s + n]) == g:
                        hit |= set(range(s, s + n))
                        found.add(str(item))
        want = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == want


def test_decontamination_edges(spark, odd, none, bench):
    assert decontaminate.contamination(odd, bench).count() == 9
    assert decontaminate.contamination(none, bench).count() == 0 and decontaminate.contamination(none, bench, block_phrases=60).count() == 0
    assert decontaminate.contamination(odd, bench.where("false")).where(F.size("spans") > 0).count() == 0
    assert set(decontaminate.decontaminated(odd, bench).columns) == set(odd.columns)


# --- 5 -----------------------------------------------------------------------------------------


def base_rules(text):
    text = text or ""
    w = SPACED.findall(text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    covered = set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def gram_buckets(text):
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in SPACED.findall(text or "")]

    def pair(a, b):
        # A 64-bit number's hash, seeded with the hash before it.
        return signed(xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), 42)))

    return [x & 65535 for x in h] + [pair(a, b) & 65535 for a, b in zip(h, h[1:], strict=False)]


def test_rules_match_brute_force(spark, docs, labels, odd):
    extra = spark.createDataFrame([(9000 + k, " ".join(random.Random(k).choice("abc") for _ in range(n)) + "\nx\nx\n \n", "en", "z", 0) for k, n in enumerate([5, 25, 60, 200, 9, 8, 7])], DOCS)
    both = docs.unionByName(extra)
    rows = both.select("doc_id", "text").collect()
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    raw, target = Counter(), Counter()
    for r in rows:
        g = gram_buckets(r.text)
        raw.update(g)
        if r.doc_id in good:
            target.update(g)
    n_raw, n_target = sum(raw.values()), sum(target.values())
    llr = [round(math.log((target[b] + 1) / (n_target + 65536)) - math.log((raw[b] + 1) / (n_raw + 65536)), 6) for b in range(65536)]
    got = {r.doc_id: r for r in rules.digest(rules.judged(both, rules.trusted_ids(labels))).collect()}
    for r in rows:
        want, x = base_rules(r.text), got[r.doc_id]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == want
        g = gram_buckets(r.text)
        score = sum(llr[b] for b in g) / max(1, 2 * want[0] - 1)
        assert abs(score - x.llr) < 1e-5 and (x.kept == (not want[5] and score >= rules.THRESHOLD) or abs(score - rules.THRESHOLD) < 1e-5)
    assert rules.judged(odd, rules.trusted_ids(labels)).count() == 9 and {*odd.columns} < {*rules.judged(odd, rules.trusted_ids(labels)).columns}


def test_rules_edges(none, docs, labels, monkeypatch):
    assert rules.judged(none, rules.trusted_ids(labels)).count() == 0
    assert rules.judged(none, rules.trusted_ids(labels.where("false"))).count() == 0
    want = rows_of(rules.digest(rules.judged(docs, rules.trusted_ids(labels))))
    monkeypatch.setattr(rules, "BROADCAST_IDS", 0)
    assert rows_of(rules.digest(rules.judged(docs, rules.trusted_ids(labels)))) == want


# --- 6 -----------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_match_brute_force(spark):
    rng = random.Random(4)
    pool = [" ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 7))) for _ in range(rng.choice([2, 6, 30, 45]))) for _ in range(25)]

    def vary(line):
        w = line.split(" ")
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] += rng.choice("ghi")
        return rng.choice(["{}", "{}!", "  {} "]).format(" ".join(w)).upper() if rng.random() < 0.3 else " ".join(w)

    rows = [(k, "\n".join(rng.choice(["", vary(rng.choice(pool)), vary(rng.choice(pool))]) for _ in range(rng.randint(0, 8)))) for k in range(60)]
    occurrences = []
    for k, text in rows:
        for i, line in enumerate(text.split("\n")):
            w = tuple(x for x in re.split(r"[^a-z0-9]+", line.lower()) if x)
            if w:
                occurrences.append((k, i, w))
    distinct = sorted({w for *_, w in occurrences})
    links = [(a, b) for a, b in itertools.combinations(range(len(distinct)), 2) if len(distinct[a]) >= 5 and len(distinct[b]) >= 5 and edits(x := " ".join(distinct[a]), y := " ".join(distinct[b])) <= math.floor(0.1 * max(len(x), len(y)) + 1e-9)]
    root = union_find(range(len(distinct)), links)
    assert links
    seen, gone = set(), set()
    for k, i, w in occurrences:
        g = root[distinct.index(w)]
        if g in seen:
            gone.add((k, i))
        seen.add(g)
    got = {r.doc_id: r for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for k, text in rows:
        want = "\n".join(x for i, x in enumerate(text.split("\n")) if (k, i) not in gone)
        assert (got[k].text, got[k].n_lines, got[k].n_removed) == (want, len(text.split("\n")), sum(d == k for d, _ in gone))


def test_line_edges(odd, none):
    got = lines.deduplicated(odd)
    assert {(r.doc_id, r.text) for r in got.collect() if r.doc_id in (2, 3, 5, 6)} == {(2, None), (3, ""), (5, "a\n\n\nb"), (6, "   ")}
    assert got.count() == 9 and set(got.columns) == {*odd.columns, "n_removed"}
    # One of two repeated rows keeps its line.
    assert sorted(r.text for r in got.where("doc_id = 1").collect()) == ["", "alpha beta gamma delta epsilon"]
    assert lines.deduplicated(none).count() == 0


def near_lines(x, y):
    """Edit similarity of 0.9 or more, told from bags of characters first."""
    most = math.floor(0.1 * max(len(x), len(y)) + 1e-9)
    p, q = Counter(x), Counter(y)
    return abs(len(x) - len(y)) <= most and (p - q).total() <= most and (q - p).total() <= most and edits(x, y) <= most


def keys_of(spark, texts):
    rows = spark.createDataFrame([(k, t.split(" ")) for k, t in enumerate(texts)], "h int, words array<string>")
    out = {}
    for r in lines.with_blocks(rows, ["h"]).where("key IS NOT NULL").collect():
        out.setdefault(r.h, set()).add(r.key)
    return out


def test_similar_lines_meet(spark, docs):
    """The lines of every twentieth document against all lines: nine of ten similar pairs share a block and are linked."""
    told = {}
    for r in docs.select("doc_id", "text").collect():
        for line in (r.text or "").split("\n"):
            w = [x for x in re.split(r"[\W_]+", line.lower()) if x]
            if len(w) >= 5:
                told.setdefault(" ".join(w), set()).add(r.doc_id)
    texts = list(told)
    keys = keys_of(spark, texts)
    pairs = [(a, b) for a, x in enumerate(texts) if any(d % 20 == 0 for d in told[x]) for b, y in enumerate(texts) if a != b and near_lines(x, y)]
    assert pairs and sum(bool(keys[a] & keys[b]) for a, b in pairs) >= 0.9 * len(pairs)
    rows = spark.createDataFrame([(texts[a], texts[b]) for a, b in pairs], "a string, b string")
    assert lines.similar(rows, "a", "b").count() == len(pairs)


def test_edit_similarity(spark):
    rng = random.Random(1)
    rows = []
    for k in range(1500):
        words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12))]
        other = list(words)
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.randrange(len(other))
            other[at : at + 1] = rng.choice([[], [other[at] + "a"], [other[at][1:] or "x"], [other[at], "b"]]) or ["y"]
        rows.append((k, " ".join(words), " ".join(other)))
    got = {r.k for r in lines.similar(spark.createDataFrame(rows, "k int, a string, b string"), "a", "b").collect()}
    for k, x, y in rows:
        p, q = set(x.split(" ")), set(y.split(" "))
        want = edits(x, y) <= math.floor(0.1 * max(len(x), len(y)) + 1e-9) and len(p & q) >= max(len(p), len(q)) / 2
        assert (k in got) == want, (x, y)


def test_links_without_equal_words_and_with_one_block(spark):
    """A letter changed in each of many long words is a link; so is a line that agrees with another in one of six blocks."""
    long = [f"{c * 3}internationalisation{c}" for c in "abcdefghij"]
    typos = " ".join(w.replace("nation", "nazion") if k % 5 < 4 else w for k, w in enumerate(long))
    rows = spark.createDataFrame([(" ".join(long), typos)], "a string, b string")
    assert lines.similar(rows, "a", "b").count() == 1
    words = [f"{chr(97 + k % 26)}{k}measure" for k in range(48)]
    variant = lambda m, at: " ".join("q" + w if k in at else w + "s" * (k in (9, 17, 25, 33, 41) and m) for k, w in enumerate(words))
    # x stays away from the hub `a`, to which copies with changes elsewhere belong; y is near x alone.
    x = " ".join(w + ("zzz" if 8 <= k < 40 else "") for k, w in enumerate(words))
    y = x.replace("1measurezzz", "1measzzz").replace("7measurezzz", "7measzzz").replace("3measurezzz", "3measzzz")
    copies = [variant(m, {p}) for m in (0, 1) for p in (1, 44)]
    texts = [*copies, x, y]
    assert edits(x, y) <= 0.1 * max(len(x), len(y)) and all(edits(x, c) > 0.1 * max(len(x), len(c)) for c in copies)
    got = {r.doc_id: r.n_removed for r in lines.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0, 5: 1}


@pytest.mark.parametrize("similarity", [0.9, 0.8])
def test_short_similar_lines_always_meet(spark, similarity):
    """Up to 49 characters, whatever the script and wherever the edits are; with few words up to 99."""
    rng = random.Random(8)
    pairs = []
    for k in range(400):
        letters = rng.choice(["abc ", "abcdefgh  ", "天地玄黄宇宙洪荒", "ab"])
        n = rng.choice([25, 26, 29, 30, 33, 39, 40, 44, 48]) if k % 4 else 80
        x = " ".join("".join(rng.choice(letters if n < 80 else "abcde") for _ in range(n)).split())
        y, most = x, math.floor((1 - similarity) * len(x) + 1e-9)
        for _ in range(most if k % 3 else rng.randint(1, most)):
            at = rng.randrange(len(y))
            y = rng.choice([y[:at] + rng.choice("abz") + y[at + 1 :], y[:at] + y[at + 1 :], y[:at] + rng.choice("abz") + y[at:]])
        y = " ".join(y.split())
        if x != y and min(len(x), len(y)) >= 25 and max(len(x), len(y)) <= (49 if n < 80 else 99) and edits(x, y) <= math.floor((1 - similarity) * max(len(x), len(y)) + 1e-9):
            pairs.append((x, y))
    assert len(pairs) > 150
    rows = spark.createDataFrame([(k, t.split(" ")) for k, p in enumerate(pairs) for k, t in zip((2 * k, 2 * k + 1), p, strict=True)], "h int, words array<string>")
    keys = {}
    for r in lines.with_blocks(rows, ["h"], similarity=similarity).where("key IS NOT NULL").collect():
        keys.setdefault(r.h, set()).add(r.key)
    assert [p for k, p in enumerate(pairs) if not keys[2 * k] & keys[2 * k + 1]] == []


def test_letters_rule_no_link_out(spark):
    """Edits flip at most two bits each, lengths told; counts beyond 32 and other scripts included."""
    rng = random.Random(9)
    rows = []
    for k in range(600):
        x = "".join(rng.choice("aabcxyz  0é天") for _ in range(rng.choice([5, 40, 700])))
        y, n = x, rng.randint(0, 6)
        for _ in range(n):
            at = rng.randrange(len(y))
            y = rng.choice([y[:at] + rng.choice("aq 1地") + y[at + 1 :], y[:at] + y[at + 1 :], y[:at] + rng.choice("aq 1地") + y[at:]]) or "a"
        rows.append((k, n, x, y))
    df = spark.createDataFrame(rows, "k int, n int, x string, y string")
    told = df.select("k", "n", "x", "y", *lines.letters(F.col("x")), *(c.alias(f"other_{i}") for i, c in enumerate(lines.letters(F.col("y")))))
    bits = lines.differing([f"letters_{i}" for i in range(7)], [f"other_{i}" for i in range(7)])
    got = told.select("n", "x", "y", bits.alias("bits")).collect()
    assert all(r.bits <= 2 * r.n - abs(len(r.x) - len(r.y)) for r in got)
    assert any(r.bits > r.n for r in got if r.n == 6)
    far = spark.createDataFrame([("abc" * 20, "xyz" * 20)], "x string, y string")
    apart = far.select(*lines.letters(F.col("x")), *(c.alias(f"other_{i}") for i, c in enumerate(lines.letters(F.col("y")))))
    assert apart.select(bits.alias("bits")).first().bits == 16 * 3 - 3 * (20 - 16) + 16 * 3 - 3 * (20 - 16)


def test_unlike_lines_with_a_common_run_are_not_paired(spark, monkeypatch):
    """Lines that begin alike and are no links otherwise; one of them has a link in another hub's shadow."""
    rng = random.Random(10)
    word = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[k % 9 : k % 9 + 9]) for _ in range(rng.randint(3, 8)))
    texts = ["it is known that " + " ".join(word(k) for _ in range(12)) for k in range(60)]
    texts.append(texts[30][:-1] + "0")
    tested, test = [], lines.Lines.test

    def counted(self, pairs):
        tested.append(pairs.count())
        return test(self, pairs)

    monkeypatch.setattr(lines.Lines, "test", counted)
    got = {r.doc_id: r.n_removed for r in lines.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {k: int(k == 60) for k in range(61)}
    assert tested[-1] < 200


def test_lines_with_a_common_passage_make_no_rows_of_pairs(spark, monkeypatch):
    """Lines that end alike and differ in a fifth of their letters, which counts of letters do not tell; one is linked to another."""
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choice("eeettaaoinshrd") for _ in range(rng.randint(3, 8))) for _ in range(n))
    passage = words(60)
    texts = [f"{words(20)} {passage}" for _ in range(60)]
    texts.append(texts[30].replace("e", "x", 12))
    tested, test = [], lines.Lines.test

    def counted(self, pairs):
        tested.append(pairs.count())
        return test(self, pairs)

    monkeypatch.setattr(lines.Lines, "test", counted)
    got = {r.doc_id: r.n_removed for r in lines.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {k: int(k == 60) for k in range(61)}
    assert tested[-1] <= 1


def test_keys_within_another_are_left_out(spark):
    """Key 2's nodes all have key 1 too, key 3 has the same nodes as key 4; 5 has a node that is elsewhere."""
    held = {1: [1, 2, 3, 4], 2: [2, 3], 3: [7, 8], 4: [7, 8], 5: [4, 10], 6: [9]}
    rows = [(k, n, n) for k, nodes in held.items() for n in nodes]
    got = lines.widest(spark.createDataFrame(rows, "key bigint, node bigint, root bigint")).collect()
    assert {r.key for r in got} == {1, 4, 5, 6} and len(got) == 9


def test_lines_without_blanks_and_of_few_words(spark):
    chinese = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律"
    long = "".join(chr(0x4E00 + 37 * k % 5000) for k in range(300))
    latin = "internationalization configuration documentation management"
    texts = [chinese, chinese[:-1] + "吕", latin, latin + "s", latin.replace("fig", "fog"), long, long[:150] + "一" + long[151:], "ab cd efgh", "ab cd efghi"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r.n_removed for r in lines.deduplicated(df).orderBy("doc_id").collect()] == [0, 1, 0, 1, 1, 0, 1, 0, 0]
    assert [r.n_removed for r in lines.deduplicated(df, least_words=0).orderBy("doc_id").collect()] == [0, 1, 0, 1, 1, 0, 1, 0, 1]


def test_a_block_is_a_simhash_of_its_run_and_keeps_changes_to_itself(spark):
    rng = random.Random(2)
    texts = []
    for n in (5, 8, 15, 33, 60, 400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        texts += [" ".join(words), " ".join("x1" if k == n // 3 else w for k, w in enumerate(words)), " ".join(words[: n // 3] + ["new"] + words[n // 3 :])]
    keys = keys_of(spark, texts)
    for k in range(0, len(texts), 3):
        assert keys[k] & keys[k + 1] and keys[k] & keys[k + 2], texts[k][:60]
    three = [0b1100, 0b1010, 0b0111]
    row = spark.range(1).select(lines.majority(*(F.lit(x) for x in three)).alias("m")).first()
    assert row.m == sum(1 << b for b in range(4) if sum(x >> b & 1 for x in three) >= 2)


def test_lines_of_very_many_words(spark):
    text = " ".join(f"w{k}" for k in range(40_000))
    df = spark.createDataFrame([(1, text), (2, text.replace("w777 ", "x777 "))], "doc_id bigint, text string")
    assert {r.doc_id: r.n_removed for r in lines.deduplicated(df).collect()} == {1: 0, 2: 1}


# --- 7 -----------------------------------------------------------------------------------------


def test_language_model(spark, docs, odd, none, monkeypatch):
    got = {r.doc_id: r for r in hpylm.scored(docs).collect()}
    held = lambda k: zlib.crc32(str(k).encode()) % 10 == 0
    tokens = {r.doc_id: [*words_of(r.text), " "] for r in docs.select("doc_id", "text").collect()}
    c = Counter(w for k, v in tokens.items() if not held(k) for w in v)
    n, v = sum(c.values()), len(c)
    for k, w in tokens.items():
        r = got[k]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(k), len(w), sum(c[x] > 0 for x in w), n) and abs(base - r.base_score) < 1e-6
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert hpylm.scored(odd).count() == 9 and hpylm.scored(none).count() == 0
    empty = {r.doc_id: r.n_tokens for r in hpylm.scored(odd).where("doc_id IN (2, 3)").collect()}
    assert empty == {2: 1, 3: 1}


@pytest.mark.parametrize(("share", "buckets"), [(0.001, 3), (0.02, 5)])
def test_predictive_probabilities_add_up(spark, share, buckets):
    """Over all known words, the end and the unknown one, after any context, the model's probabilities add up to one."""
    rng = random.Random(6)
    words = [f"word{k}" for k in range(30)] + ["the", "of"]
    rows = [(k, " ".join(rng.choice([*words, "the", "the", "of"]) for _ in range(40))) for k in range(60)]
    known = sorted({w for _, t in rows for w in t.split()})
    for context in ("the", "word3", "never", ""):
        asked = [(1000 + k, f"{context} {w}") for k, w in enumerate([*known, "unseen", ""])]
        both = spark.createDataFrame(rows + asked, "doc_id bigint, text string")
        got = hpylm.scored(both, F.col("doc_id") >= 1000, by_token=True, share=share, least_buckets=buckets).where("doc_id >= 1000").collect()
        assert abs(sum(10 ** r.token_scores[1 if context else 0] for r in got) - 1) < 1e-9, context
        assert all(abs(sum(r.token_scores) - r.score) < 1e-9 for r in got)


@pytest.mark.parametrize(("share", "buckets"), [(0.001, 1), (0.001, 7), (0.02, 7)])
def test_seats_of_single_customers_leave_no_choice(spark, share, buckets):
    """Where each word occurs once, one customer sits at each table and the scores can be told by hand."""
    rows = [(1, "a b c"), (2, "d e"), (3, "f g h i")]
    asked = [(10, "a b"), (11, "b a z"), (12, "")]
    both = spark.createDataFrame(rows + asked, "doc_id bigint, text string")
    got = {r.doc_id: r for r in hpylm.scored(both, F.col("doc_id") >= 10, by_token=True, share=share, least_buckets=buckets).collect()}
    c2, c1 = Counter(), Counter()
    for _, t in rows:
        w = ["<s>", *t.split(), "</s>"]
        c2.update(zip(w, w[1:], strict=False))
    guests = Counter()
    for (u, w), n in c2.items():
        guests[u] += n
        c1[w] += 1
    # The end has three customers in the parent, of unknown tables: texts without it are held against the formula.
    tables1 = None
    for t1_end in (1, 2, 3):
        n1, k1, v = sum(c1.values()), len(c1) - 1 + t1_end, len(c1)

        def parent(w):
            t = {"</s>": t1_end}.get(w, min(1, c1[w]))  # noqa: B023
            return (max(c1[w] - hpylm.D1 * t, 0) + (hpylm.S1 + hpylm.D1 * k1) / (v + 1)) / (hpylm.S1 + n1)  # noqa: B023

        def p(u, w):
            met = sum(1 for x in c2 if x[0] == u)
            return (max(c2[u, w] - hpylm.D2 * min(1, c2[u, w]), 0) + (hpylm.S2 + hpylm.D2 * met) * parent(w)) / (hpylm.S2 + guests[u])

        want = [math.log10(p("<s>", "b")), math.log10(p("b", "a")), math.log10(p("a", "z"))]
        if all(abs(x - y) < 1e-9 for x, y in zip(got[11].token_scores, want, strict=False)):
            tables1 = t1_end
            assert abs(got[10].token_scores[1] - math.log10(p("a", "b"))) < 1e-9
    assert tables1 is not None or len({*got[11].token_scores}) == 4  # two samples may differ in the end's tables


def test_seats_do_not_depend_on_the_number_of_buckets(spark):
    """Few words of very unequal counts, so that buckets are unlike: one bucket and 32, of plain and frequent words, give the same scores but for sampling."""
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices([f"w{i}" for i in range(12)], [2.0**-i for i in range(12)])[0] for _ in range(60))) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    scores = []
    for share, buckets in ((0.9, 1), (0.05, 32)):
        got = hpylm.scored(docs, F.col("doc_id") % 4 == 0, share=share, least_buckets=buckets).where("held_out").collect()
        scores.append(sum(r.score for r in got) / sum(r.n_tokens for r in got))
    assert abs(scores[0] - scores[1]) < 0.005


def test_tables_of_a_context_meet_and_are_told_to_all_that_have_it():
    sent = {0: ([3, 9, 2**31 + 5], [1, 4, 2]), 1: ([9], [10]), 2: ([3, 2**31 + 5], [100, 7])}
    table = hpylm._told([(hpylm._TABLES, 5, b, (hpylm.steps(np.array(c)), hpylm.planes(np.array(n))), ()) for b, (c, n) in sent.items()])
    out = hpylm._exchange(table)
    got = {b: hpylm.unplanes(a.as_buffer()).tolist() for b, a in zip(out["bucket"].to_pylist(), out["a"], strict=True)}
    assert got == {0: [101, 14, 9], 1: [14], 2: [101, 9]} and out["shard"].to_pylist() == [5, 5, 5]


def test_seated_customers_follow_the_restaurant():
    """Mean tables of one dish against the chain of customers simulated one by one."""
    count, rest, parent, d, s = 12, 5, 0.2, 0.5, 2.0
    rng = np.random.default_rng(0)
    got = hpylm.seated(np.full(20_000, count), np.full(20_000, rest), np.full(20_000, parent), d, s, rng).mean()
    total = 0
    for _ in range(20_000):
        t = 1
        for k in range(1, count):
            new, old = (s + d * (rest + t)) * parent, k - d * t
            t += rng.random() < new / (new + old)
        total += t
    assert abs(got - total / 20_000) < 0.1


def test_coding_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 10, 300, 70_000):
        index = rng.integers(0, n, 5000)
        assert np.array_equal(hpylm.decoded(*hpylm.coded(index, n)), index)
    for x in (np.zeros(0, np.int32), np.arange(1000, dtype=np.int32)):
        assert np.array_equal(hpylm.unsqueezed(hpylm.squeezed(x), np.int32), x)


# --- 8 -----------------------------------------------------------------------------------------


def brute_repeats(rows, n=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        cov = bytearray(len(b))
        for i in range(len(b) - n + 1):
            w = b[i : i + n]
            if w in seen:
                cov[i : i + n] = b"\x01" * n
            seen.add(w)
        kept = bytes(x for x, c in zip(b, cov, strict=True) if not c)
        out[d] = (len(b), sum(cov), len(re.findall(b"\x01+", bytes(cov))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("hot", "crowd"), [(2, 64), (5000, 64), (5000, 2), (3, 1), (5000, 0)])
def test_repeats_match_brute_force(spark, hot, crowd, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_RUNS", hot)
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    base = [text(rng.randint(50, 600)) for _ in range(8)]
    rows = []
    for i in range(150):
        parts = [rng.choice([text(rng.randint(0, 80)), rng.choice(base), rng.choice(base)[rng.randint(0, 100) :], "ab" * rng.randint(0, 120), "x" * rng.randint(0, 300)]) for _ in range(rng.randint(0, 5))]
        rows.append((i, "".join(parts)))
    rows += [(1000, None), (1001, ""), (1002, "y" * 5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert {r[0]: tuple(r)[1:] for r in repeats.deduplicated(df, keep_bytes=False).collect()} == brute_repeats(rows)


def test_repeat_edges(spark, odd, none):
    got = repeats.deduplicated(odd, keep_bytes=False).collect()
    assert len(got) == 9 and repeats.deduplicated(none).count() == 0
    twice = spark.createDataFrame([(1, "q" * 50 + "abcdefghij" * 10), (1, "q" * 50 + "abcdefghij" * 10), (None, "abcdefghij" * 10)], "doc_id bigint, text string")
    assert sorted((r.n_removed for r in repeats.deduplicated(twice, keep_bytes=False).collect())) == [0, 100, 150]


def test_longest_previous_factor():
    text = b"abracadabra abracadabra"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = [0] + [next((k for k in range(len(text)) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or b + k >= len(text) or a + k >= len(text)), 0) for a, b in zip(order, order[1:], strict=False)]
    got = repeats.longest_previous(np.array(order), np.array(lcp))
    for i, p in enumerate(order):
        assert got[i] == max((next(k for k in range(len(text) + 1) if q + k >= len(text) or p + k >= len(text) or text[q + k] != text[p + k]) for q in range(p)), default=0)


# --- 9 -----------------------------------------------------------------------------------------


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_plain_spans_match_the_patterns():
    rng = random.Random(9)
    pieces = ["a@b.c", "x.y@z", "1.2.3.4", "300.1.1.1", "4709559030084884", "4709 5590-3008 4884", "+1 (456) 555-2186", "+12", "@@", "..", "é", " ", "1", "-", "a", "+", "%_@q-.w"]
    for _ in range(3000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        assert pii.detect(t) == base_spans(t), t


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail john dot smith at example dot com now", "email", "john dot smith at example dot com"),
        ("a[at]b[dot]com x", "email", "a[at]b[dot]com"),
        ("john (at) mail (dot) example (dot) org", "email", "john (at) mail (dot) example (dot) org"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("j.d＠ex.com", "email", "j.d＠ex.com"),
        ("ip one nine two dot one six eight dot zero dot one ok", "ip", "one nine two dot one six eight dot zero dot one"),
        ("１９２.168.0.1", "ip", "１９２.168.0.1"),
        ("card 4​709559030084884!", "card", "4​709559030084884"),
        ("jоhn.smith@example.com", "email", "jоhn.smith@example.com"),
        ("write ann@example.cоm", "email", "ann@example.cоm"),
        ("to johп@example.com", "email", "johп@example.com"),
        ("call plus one two three four five six seven eight nine zero one end", "phone", "plus one two three four five six seven eight nine zero one"),
    ],
)
def test_disguises(text, kind, span):
    found = [(text[a:b], pii.KINDS[k]) for a, k, b in pii.disguised(text, pii.detect(text))]
    assert (span, kind) in found


def test_base_spans_stay_beside_wider_ones(spark):
    text = "jоhn.smith@example.com"
    r = pii.found(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert (r.n_email, r.n_added, r.spans) == (1, 1, "email:0:22,email:2:22")


def test_digits_of_all_scripts():
    zeros = [chr(c) for c in range(0x660, 0x1FBF1) if chr(c).isdecimal() and unicodedata.decimal(chr(c)) == 0]
    assert len(zeros) > 50
    for zero in zeros:
        digit = lambda d: chr(ord(zero) + d)  # noqa: B023, E731
        text = "ip " + ".".join("".join(digit(int(c)) for c in part) for part in ("192", "168", "0", "17")) + " x"
        assert [(k, text[a:b]) for a, k, b in pii.disguised(text, pii.detect(text))] == [(1, text[3:-2])], hex(ord(zero))


def test_plain_speech_is_left_alone():
    for t in ["look at example.com please", "meet at noon. dot the i", "four five apples", "at the dot", "one two three"]:
        assert pii.disguised(t, pii.detect(t)) == []


def test_pii_rows(docs, odd, none):
    got = {r.doc_id: r for r in pii.found(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        want = base_spans(r.text or "")
        x = got[r.doc_id]
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert x.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
    assert pii.found(odd).count() == 9 and pii.found(none).count() == 0


def test_pii_hints_skip_no_disguise(spark):
    rng = random.Random(10)
    fixed = ["+1 four 15 555 0134", "plus 44 20 7946 0958", "(plus 44 20 7946 0958)", "+၁ 456 555 2186", "+1 ４56 555 2186", "+៤4 456 555 2186", "+߁4 456 555 2186", "plus\x1c44 20 7946 0958", "+1 fıve 15 555 0134", "+1 ſix 15 555 0134"]
    pieces = ["plus ", "+1 ", "four", "one", " ", "15", "555 0134", "-", "dot", " dot ", "[at]", " at ", "@", " @ ", "a", "ex.com", "é", "၁", "fİve", "\u00a0", "\x1d", "ſix", "(", ")", "."]
    texts = ["ends in a word", *fixed, *("".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(3000))]
    got = {r.doc_id: (r.spans, r.n_added) for r in pii.found(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for k, t in enumerate(texts):
        plain = pii.detect(t)
        more = pii.disguised(t, plain)
        assert got[k] == (pii.joined(plain + more), len(more)), t
        assert more or t not in fixed, t


# --- 10 ----------------------------------------------------------------------------------------


def test_mixture(spark, docs, odd, none):
    got = mixing.mixture(docs).toPandas()
    again = mixing.mixture(docs.repartition(7)).toPandas()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, again.values.tolist()))
    src = docs.select("doc_id", "source", "text").toPandas()
    src["words"] = [len(SPACED.findall(t or "")) for t in src.text]
    both = got.merge(src, on="doc_id")
    assert (both["size"] == both.words).all() and (both.taken <= 3 * both["size"]).all()
    total = src.words.sum()
    sizes = src.groupby("source").words.sum().sort_index()
    weight = {s: k % 3 + 1 for k, s in enumerate(sizes.index)}
    open_, left, target = set(sizes.index), float(total), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 3 * sizes[s]}
        for s in full or open_:
            target[s] = 3.0 * sizes[s] if full else share * weight[s]
            left -= target[s]
        open_ -= full or open_
    for s, part in both.groupby("source"):
        assert abs(part.target.iloc[0] - target[s]) < 1e-6 * total and part.source_size.iloc[0] == sizes[s]
        n = target[s] / mixing.BLOCK  # multinomial: five standard deviations, and the blocks of a cut
        assert abs(part.taken.sum() - target[s]) <= (5 * math.sqrt(n) + 3) * mixing.BLOCK
    assert mixing.mixture(none).count() == 0
    rows = mixing.mixture(odd).collect()
    assert len(rows) == 9 and all(r.taken <= 3 * r["size"] for r in rows)


def test_mixed_blocks_are_packed_and_dealt(spark, docs):
    rows = mixing.mixed(docs).collect()
    assert len({(r.shard, r.slot) for r in rows}) == len(rows) and {r.shard for r in rows} == set(range(mixing.SHARDS))
    texts = {r.doc_id: SPACED.findall(r.text or "") for r in docs.select("doc_id", "text").collect()}
    blocks, per_shard, taken = {}, Counter(), Counter()
    for r in rows:
        assert blocks.setdefault((r.source, r.block), r.text) == r.text and len(r.text.split(" ")) == r.words <= mixing.BLOCK
        want = []
        for d in sorted(r.documents, key=lambda d: d.offset):
            lo = max(0, r.block * mixing.BLOCK - d.offset)
            want += texts[d.doc_id][lo : lo + d.words]
            taken[d.doc_id] += d.words
        assert r.text == " ".join(want)
        per_shard[r.shard] += 1
    slots = sum(per_shard.values())
    assert all(abs(n - slots / mixing.SHARDS) <= 0.05 * slots / mixing.SHARDS + 5 for n in per_shard.values())
    assert rows_of(mixing.mixed(docs, texts=False)) == sorted((tuple(x for x, c in zip(r, r.__fields__, strict=True) if c != "text") for r in rows), key=str)
    shard = [r.source for r in sorted(rows, key=lambda r: r.slot) if r.shard == 0]
    assert shard != sorted(shard)
    assert {r.doc_id: r.taken for r in mixing.mixture(docs).collect() if r.taken} == taken


def test_shard_counts_vary_as_multinomials_do(spark):
    parts = spark.createDataFrame([("a", 16_000.0), ("b", 32_000.0), (None, 16_000.0), ("c", 0.5)], "source string, part double")
    got = mixing.drawn(parts, 64).groupBy("shard", "source").agg(F.sum("draws").alias("n")).collect()
    per_shard = Counter()
    for r in got:
        per_shard[r.shard] += r.n
    assert set(per_shard.values()) <= {1000, 1001}
    for source, p in (("a", 0.25), ("b", 0.5), (None, 0.25)):
        counts = np.array([r.n for r in got if r.source == source])
        assert len(counts) == 64 and abs(counts.mean() - 1000 * p) < 5 * math.sqrt(1000 * p * (1 - p) / 64)
        assert 0.5 < counts.var() / (1000 * p * (1 - p)) < 1.7
    # Every slot is drawn by its own uniform number.
    value = lambda shard, i: (xxhash.xxh64_intdigest(i.to_bytes(8, "little"), xxhash.xxh64_intdigest(shard.to_bytes(8, "little"), xxhash.xxh64_intdigest(mixing.SEED.to_bytes(4, "little"), 42))) >> 12) / 2**52
    total = 64_000.5
    edges = [("a", 16_000 / total), ("b", 48_000 / total), ("c", 48_000.5 / total), (None, 1.0)]
    want = Counter(next(s for s, hi in edges if value(3, i) < hi) for i in range(per_shard[3]))
    assert {r.source: r.n for r in got if r.shard == 3} == want


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit("k")).alias("p"))
        assert sorted(r.p for r in df.collect()) == list(range(n))


# --- pipeline ----------------------------------------------------------------------------------


def test_pipeline(spark, docs):
    import corpus_pipeline as cp

    kept, seen = docs, []
    for name, stage in cp.STAGES[:-1]:
        before = kept.count()
        kept = cp.written(stage(spark, kept, DATA), name)
        assert kept.columns == docs.columns and kept.count() <= before
        seen.append(kept.count())
    assert seen[0] < docs.count() and seen[1] == seen[0] and seen[3] < seen[2] < seen[1]
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert decontaminate.digest(decontaminate.contamination(kept, bench)).where("contaminated").count() == 0
    classes = neardup.classes(kept)
    assert classes.where("doc_id <> class_id").count() == 0
    assert {r.doc_id for r in cp.run(spark, DATA).collect()} == {r.doc_id for r in kept.collect()}


def test_pipeline_edges(spark, odd, none):
    import corpus_pipeline as cp

    for name, stage in cp.STAGES[:-1]:
        for table in (odd.select(*cp.COLUMNS), none, odd):
            got = stage(spark, table, DATA)
            assert got.columns == cp.COLUMNS and got.count() <= table.count(), name
    assert cp.STAGES[-1][1](spark, odd, DATA).count() == 9 and cp.STAGES[-1][1](spark, none, DATA).count() == 0


def test_registered_queries(spark):
    import __spark_entry__ as entry

    found = {re.match(r"op\d+_", n)[0] for n in entry.queries() if n.startswith("op")}
    assert found == {f"op{k}_" for k in range(1, 14)} and "pipeline" in entry.queries()
    from engines import connect, duck_rows, spark_rows

    assert spark_rows(entry.queries()["op3_decontaminate"](spark, DATA)) == duck_rows(connect(), entry.oracle_sql()["op3_decontaminate"])
