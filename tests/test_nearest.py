"""Top lists of many query vectors against all products."""

import math
import random

import pytest

from plotweave.operators.nearest import nearest


@pytest.mark.parametrize("limits", [{}, {"most_bytes": 0, "block_rows": 40}, {"most_bytes": 0, "block_rows": 7}, {"most_bytes": 0}])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_lists_are_those_of_all_products(spark, limits, kind):
    rng = random.Random(11)
    vector = lambda: rng.choice([None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], *[[float(rng.randint(-2, 2)) for _ in range(rng.choice([3, 3, 3, 4]))] for _ in range(20)]])
    rows, asked = [(k, vector()) for k in range(300)] + [(None, [1.0, 1.0, 1.0])], [(k, vector()) for k in range(60)] + [(None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").repartition(4)
    q = spark.createDataFrame(asked, f"query_id int, query array<{kind}>")
    got = {}
    for r in nearest(df, q, 5, 0.2, **limits).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc, round(r.score, 9)))

    def ok(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    want = {}
    for i, a in asked:
        found = []
        for k, b in rows:
            if i is not None and k is not None and ok(a) and ok(b) and len(a) == len(b):
                s = sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
                if s >= 0.2:
                    found.append((-round(s, 9), k))
        if found:
            want[i] = [(n + 1, k, -s) for n, (s, k) in enumerate(sorted(found)[:5])]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_no_queries_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id bigint, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0])], "query_id bigint, query array<double>")
    for limits in ({}, {"most_bytes": -1}):
        assert nearest(df, q.where("false"), 3, **limits).count() == 0
        assert nearest(df.where("false"), q, 3, **limits).count() == 0
        assert nearest(df, q, 3, **limits).count() == 1
