"""Queries over tables with rows that the given ones seldom have, against DuckDB."""

import duckdb
import numpy as np
from engines import duck_rows, spark_rows

from plotweave.operators import nearest
from plotweave.queries import ORACLES, QUERIES
from plotweave.sources import text


def _same(spark, folder, name, **tables):
    """tables: name to rows and their schema; the query gives those of its SQL."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        path = str(folder / f"{t}.parquet")
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    got = spark_rows(QUERIES[name](spark, str(folder)))
    assert got == duck_rows(con, ORACLES[name])
    return got[1]


_TEXTS = ["a\nb", "a\n", "", " \n　", "28.68.191.2 Den schüsch.\nmehr", "Chapter 1 Start\ntext", "vorher\n1. kurz\nnachher", "尾声", None, "\n\nx\n\n", "\x0b", "x"]
DOCUMENTS = ([(k, t, f"src{k % 3}") for k, t in enumerate(_TEXTS)] + [(1, "twice", "src1"), (None, "nobody's", None), (None, "x", None), (30, "y", None)], "doc_id bigint, text string, source string")


def test_documents_are_whole_chapters(spark, tmp_path):
    assert len(_same(spark, tmp_path, "chapters_default", documents=DOCUMENTS)) == 13


def test_totals_count_every_document(spark, tmp_path):
    assert len(_same(spark, tmp_path, "novel_totals", documents=DOCUMENTS)) == 4


def test_short_conversations_are_decoded(spark, tmp_path):
    # Of every encoding: one line, few letters beyond ASCII, turns without a text, no text at all.
    texts = {0: ["abc"], 1: ["abcdef", "ghijkl"], 2: ["", "x1"], 3: [None, "Abcdef"], 4: [None]}
    rows = [(kind + 4 * k, turn, "user", t) for kind in range(4) for k in range(60) for turn, t in enumerate(texts[k % 5])]
    _same(spark, tmp_path, "upload_decoding", conversations=(rows, "conv_id bigint, turn bigint, role string, text string"))


def test_western_text_was_not_encoded_twice():
    for t in ("Élève là-bas, où ça ? Très bien.", "Über die Brücke für Größe", "naïve café", "señor, ¿qué tal?"):
        assert text.encoding(t.encode()) != text.DOUBLED


def test_a_script_is_decoded_once(spark):
    plan = QUERIES["script_outline"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "extract_json" not in plan


def test_cosines_of_odd_vectors(spark, tmp_path):
    vectors = [[1.0, 0.0], [0.5, -2.0], [0.0, 0.0], None, [3.0, 4.0], [float("inf"), 1.0]]
    rows = [(k, vectors[k % 6], k % 7 % 3 if k % 7 else None) for k in range(150)] + [(20, [1.0, 1.0], 0), (None, [1.0, 1.0], 0)]
    assert len(_same(spark, tmp_path, "cosine_pairs", embeddings=(rows, "vec_id bigint, embedding array<float>, label int"))) > 200


def test_cosines_come_from_products_of_blocks(spark):
    rows = [(k, k % 2, [float(k % 5 + 1), float(k % 3), 1.0]) for k in range(60)]
    v = spark.createDataFrame(rows, "doc bigint, label int, v array<float>")
    made = nearest.pairs(v, v.where("doc % 4 = 1").withColumnRenamed("doc", "query_id"), 7)
    assert "aggregate(" not in made._jdf.queryExecution().optimizedPlan().toString()
    unit = {k: np.array(x) / np.linalg.norm(x) for k, _, x in rows}
    got = {(r.query_id, r.doc): r.score for r in made.collect()}
    assert got.keys() == {(a, b) for a in range(1, 60, 4) for b in range(60) if a != b and a % 2 == b % 2}
    assert all(abs(s - unit[a] @ unit[b]) < 1e-12 for (a, b), s in got.items())
