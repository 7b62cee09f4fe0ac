"""Uploads in several encodings, cut into byte ranges of any size."""

import random

import pytest

from plotweave.sources import text, uploads

CHINESE = "清晨的阳光洒在脸上，他说：窗外传来音乐。片刻之后转身离开！𠀀é"


def _files(rng):
    line = lambda: "".join(rng.choice(CHINESE) for _ in range(rng.choice([0, 1, 5, 30])))
    body = lambda n, more="": "\n".join(line() + more for _ in range(n))
    controls = "\x0b" * 10
    return {
        "utf.txt": ("utf-8", body(300).encode()),
        "gb.txt": ("gb18030", (body(300) + "\n").encode("gb18030")),
        "gbk.txt": ("gb18030", body(60).replace("𠀀", "").encode("gbk")),  # which GB18030 reads as well
        "twice.txt": (text.DOUBLED, body(80, controls).replace("𠀀", "").encode("gb18030").decode("latin-1").encode()),
        "english.txt": ("utf-8", b"\n\nplain text\r\nwith\xff bytes\n" * 40),
        "one line.txt": ("gb18030", (CHINESE * 900).encode("gb18030")),
        "short.txt": ("utf-8", "短".encode()),
    }


@pytest.mark.parametrize("cut", ["137b", "1k", "128m"])
def test_lines_do_not_depend_on_cuts(spark, tmp_path, cut):
    files = _files(random.Random(1))
    for name, (_, data) in files.items():
        (tmp_path / name).write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
    try:
        got = {}
        for r in uploads.lines(spark, str(tmp_path)).collect():
            got.setdefault(r.file.rsplit("/", 1)[1].replace("%20", " "), []).append((r.line_no, r.line, r.encoding))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got.keys() == files.keys()
    for name, (kind, data) in files.items():
        whole = text.decode(data)
        want = whole.split("\n")[: -1 if whole.endswith("\n") else None]
        assert [(n, t) for n, t, _ in sorted(got[name])] == list(enumerate(want)), name
        assert {k for *_, k in got[name]} == {kind}, name


def test_a_file_is_decoded_by_its_beginning():
    head = "清晨的阳光" * 500
    assert text.decode((head + "x" * 50_000).encode("gb18030")) == head + "x" * 50_000
    assert text.decode(b"") == "" and text.decode(None) is None


def test_no_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"")
    assert uploads.lines(spark, str(tmp_path)).count() == 0
