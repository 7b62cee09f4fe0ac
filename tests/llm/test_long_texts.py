"""Long and repetitive texts: time in proportion, and results that they do not upset."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from plotweave.llm import pii, toxicity

#: What addresses are, tried from every place.
LITERAL = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-]){pii._PIECE}(?:(?:\.|{pii._DOT}){pii._PIECE})*(?:{pii._AT}|@){pii._LABEL}(?:(?:\.|{pii._DOT}){pii._LABEL})+")
WORDS = ["a", "dot", "at", "b.c", "x", "[at]", "(dot)", " ", "  ", "@", ".", "-", "john", "com", "{ at }", "_", "..", "\n", "DOT", "AT", "é", "[.]", "( @ )", "1", "+"]


def test_addresses_are_those_of_the_literal_pattern():
    rng = random.Random(1)
    for _ in range(8000):
        text = "".join(rng.choice(WORDS) + rng.choice(["", "", " "]) for _ in range(rng.randint(2, 22)))
        assert list(pii._addresses(text)) == [m.span() for m in LITERAL.finditer(text)], text


@pytest.mark.parametrize("word", ["a dot ", "a at ", "dot at ", "at dot dot ", " (", "x. ", " " * 5])
def test_words_of_disguises_take_time_in_proportion(word):
    text = word * 200_000
    began = time.perf_counter()
    pii.disguised(text, pii.detect(text))
    assert time.perf_counter() - began < 8  # quadratic time is hours


def test_rewritten_characters_know_their_source():
    made = pii.Rewritten("abcdef")
    made.edit([(1, 3, "X"), (4, 5, "YZ")])
    made.edit([(0, 1, ""), (2, 3, "!")])
    assert made.text == "X!YZf"
    assert list(zip(made.start.tolist(), made.end.tolist(), made.changed.tolist(), strict=True)) == [(1, 3, True), (3, 4, True), (4, 5, True), (4, 5, True), (5, 6, False)]


def test_a_long_labelled_text_leaves_the_others_in_the_fit(spark):
    rng = random.Random(2)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    text = lambda bad: " ".join([*(rng.choice(plain) for _ in range(30)), *(["stupid", "worthless"] if bad else [])])
    rows = [(k, text(k % 2)) for k in range(120)]
    long = [(1000 + k, " ".join(plain) * 400) for k in range(8)]
    docs = spark.createDataFrame(rows + long, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, 0, k % 2) for k, _ in rows + long], "doc_id bigint, quality int, toxic int")
    model = toxicity.fitted(docs, labels, F.lit(True), most_bytes=200_000)
    score = {r.doc_id: r.score for r in toxicity.scored(docs.where("doc_id < 120"), model).collect()}
    assert sum((score[k] >= 0.3) == (k % 2 == 1) for k in score) >= 110


def test_hot_windows_of_a_batch_are_sent_once():
    import numpy as np
    import pyarrow as pa

    from plotweave.llm import repeats

    text = "x" * 30 + "boilerplate of every document, " * 4 + "end"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("windows", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32())]))
    asked = [{"start": 40, "windows": 3, "bucket": 0, "kind": repeats._HOT}]
    batch = pa.record_batch([pa.array(np.arange(500)[::-1], pa.int64()), pa.array([text] * 500), pa.array([asked] * 500, kind)], ["doc", "text", "asked"])
    sent, told = [], []
    for out in repeats._map_contexts(64, repeats.LENGTH)([batch]):
        sent += [x for m in out["meta"].to_pylist() for x in zip(*repeats._unpacked([m], repeats._PLACES))]
        told += [x for m in out["repeats"].to_pylist() if m for x in zip(*repeats._unpacked([m], repeats._PLACES))]
    assert sorted((int(d), int(s)) for d, s, _ in sent) == [(0, 40), (0, 41), (0, 42)]
    assert sorted(map(tuple, np.array(told).tolist())) == [(d, 40, 3) for d in range(1, 500)]


def test_hot_anchors_give_the_rows_of_brute_force(spark, monkeypatch):
    from plotweave.llm import repeats

    monkeypatch.setattr(repeats, "HOT_RUNS", 2)
    monkeypatch.setattr(repeats, "CROWD", 2)
    rng = random.Random(4)
    line = "this line stands in every document of the corpus and is longer than one hundred bytes, as lines of licences are. "
    word = lambda: "".join(rng.choice("abcdefg ") for _ in range(rng.randint(20, 90)))
    docs = [(k, word() + line * rng.randint(1, 2) + word()) for k in range(60)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.deduplicated(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()}
    seen, want = set(), {}
    for k, text in docs:
        raw = text.encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if w in seen:
                gone[i : i + 100] = [True] * 100
            seen.add(w)
        want[k] = (sum(gone), sum(g and not p for g, p in zip(gone, [False, *gone], strict=False)))
    assert got == want and sum(n for n, _ in want.values()) > 5000
