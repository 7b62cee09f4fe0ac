"""The kept keyword index against literal counts, and what a search of it reads."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plotweave.functions.text import tokens
from plotweave.operators import inverted, retrieval

ROWS = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    return str(tmp_path_factory.mktemp("docs"))


@pytest.fixture(scope="module")
def docs(spark, place):
    rng = random.Random(4)
    words = ["the", "The", "a", "xy", "mond", "林川", "é", "über", "no", "very-long-token"]
    rows = [(k, "".join(rng.choice(words) + rng.choice([" ", ",", "。", "\n", "\x0b", "\xa0", ";", "", ". "]) for _ in range(rng.choice([0, 1, 3, 40, 900])))) for k in range(120)]
    rows += [(200, None), (201, ""), (202, "  "), (203, "the " * 20_000), (None, "the lost one")]
    spark.createDataFrame(rows, ROWS).repartition(3).write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def test_postings_are_the_counts_of_tokens(docs):
    native = docs.select(F.col("doc_id").alias("doc"), F.explode(tokens(F.col("text"))).alias("token")).groupBy("token", "doc").agg(F.count(F.lit(1)).alias("tf"))
    assert sorted(map(tuple, inverted.postings(docs).collect()), key=str) == sorted(map(tuple, native.collect()), key=str)


@pytest.mark.parametrize("query", ["the mond 林川 the", "unknown", "", "a", "über;xy"])
def test_scores_match_brute_force(spark, docs, query):
    rows = [(r.doc_id, r.t) for r in docs.select("doc_id", tokens(F.col("text")).alias("t")).collect()]
    asked = inverted.query_tokens(spark, query)
    n = docs.where(F.trim("text") != "").count()
    df = Counter(w for _, t in rows for w in set(t))
    want = {}
    for doc, t in rows:
        held = Counter(t)
        if any(held[w] for w in asked):
            want[doc] = sum(held[w] * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w in asked)
    got = {r.doc: r.score for r in inverted.kept(docs).scores(query).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-6 * max(1, abs(v)) for k, v in want.items())


def test_a_search_reads_only_its_buckets(spark, docs):
    index = inverted.kept(docs)
    asked = ["the", "mond"]
    buckets = {r[0] for r in spark.createDataFrame([(w,) for w in asked], "token string").select(inverted._bucket(F.col("token"))).collect()}
    found = index._asked("postings", asked)
    files = [r[0] for r in found.select(F.input_file_name()).distinct().collect()]
    assert files and all(any(f"bucket={b}/" in f for b in buckets) for f in files)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_an_index_is_built_once_for_its_rows(spark, docs, place, tmp_path):
    one = inverted.kept(docs)
    assert inverted.kept(spark.read.parquet(place)).path == one.path
    assert inverted.kept(docs.where("doc_id < 50")).path != one.path
    local = spark.createDataFrame([(1, "some words")], ROWS)
    assert inverted.kept(local).path != inverted.kept(local).path and inverted.kept(local).documents() == 1
    at = str(tmp_path / "t")
    local.write.parquet(at)
    before = inverted.kept(spark.read.parquet(at)).path
    spark.createDataFrame([(1, "other words"), (2, "more words")], ROWS).write.mode("overwrite").parquet(at)
    again = inverted.kept(spark.read.parquet(at))
    assert again.path != before and again.documents() == 2


def test_an_empty_table_has_an_index(spark):
    none = inverted.kept(spark.createDataFrame([], ROWS))
    assert none.scores("the").count() == 0 and tuple(none.stats().first()) == (0, 0, 0.0)


def test_context_of_no_hits_is_the_first_chunks(spark):
    chunks = spark.createDataFrame([(k, f"text {k} " * 20) for k in range(5)], "doc bigint, text string")
    vectors = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(5)], "vec_id bigint, embedding array<double>")
    query = spark.createDataFrame([([-1.0, 0.0],)], "query array<double>")
    assert [r.doc for r in retrieval.chunk_context(chunks, vectors, query, 60).collect()] == [0, 1]
