"""Files: loading by kind, pairs of a folder, caches, writing, recognition."""

from __future__ import annotations

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.kernel import image as K
from tessera.kernel import ooxml
from tessera.operators import image, rows
from tessera.plans.task import Task, compared_files
from tessera.sources import loaders, office, written
from tessera.sources.cache import Cache


def docx(*texts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>' + "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in texts) + "</w:body></w:document>")
    return data.getvalue()


FILES = "dir string, name string, path string, content binary"


def test_loading_by_kind(spark):
    files = [("a.txt", "é\n".encode()), ("b.docx", docx("x", "y")), ("c.html", "<meta charset=gbk><p>中<p>b".encode("gbk")), ("d.xlsx", ooxml.write({"S": (["h"], [["v"]])})), ("e.pdf", b"%PDF"), ("f.doc", b""), ("g.docx", b""), ("h.txt", None), ("i.txt", b""), ("j.txt", "﻿z".encode("utf-16-le"))]
    df = spark.createDataFrame([("", n, f"/p/{n}", None if c is None else bytearray(c)) for n, c in files], FILES)
    got = {r["name"]: (r["kind"], r["text"], r["error"]) for r in loaders.loaded(df, {"xlsx": loaders.read_workbook}, ("path", "name")).collect()}
    assert got == {
        "a.txt": ("text", "é\n", None), "b.docx": ("docx", "x\n\ny", None), "c.html": ("web", "中\n\nb", None), "d.xlsx": ("xlsx", "h\nv", None), "e.pdf": ("pdf", None, "e.pdf: no reader for pdf files"),
        "f.doc": ("rejected", None, "f.doc: no reader for rejected files"), "g.docx": ("docx", None, "g.docx: ValueError"), "h.txt": ("text", None, "h.txt: no such file"), "i.txt": ("text", "", None), "j.txt": ("text", "z", None),
    }
    assert loaders.loaded(df.where("false")).count() == 0


def test_failures_of_files_and_of_the_environment(spark):
    def down(path, content):
        raise loaders.EnvironmentFailure("reader is away")

    files = [("d", f"{s}{k}.{e}", f"/d/{s}{k}.{e}", bytearray(b"a\nb")) for s in "lr" for k in range(3) for e in (["txt"] if s == "l" else ["txt", "pdf"])]
    df = spark.createDataFrame([*files, ("other", "lx.txt", "/other/lx.txt", None), ("other", "rx.txt", "/other/rx.txt", bytearray(b"q"))], FILES)
    task = Task("t", "out", source={"root": "", "left": "l*", "right": "r*"}, most_pairs=6)
    got = sorted(map(tuple, compared_files(spark, task, {"pdf": down}, df).select("dir", "left", "right", "volume", "equal", "error").collect()))
    assert len(got) == 19
    d = [r for r in got if r[0] == "d"]
    first = [n for n, r in enumerate(d) if r[5]]
    assert d[0][5] == "r0.pdf: reader is away" and d[1][4] is None and d[1][5] == "stopped: r0.pdf: reader is away" and first
    assert [r[5] for r in d].count("r0.pdf: reader is away") == 3  # each volume begins anew
    assert [r for r in got if r[0] == "other"] == [("other", "lx.txt", "rx.txt", 1, None, "lx.txt: no such file")]
    free = compared_files(spark, task, {"pdf": loaders.read_text}, df).where("dir = 'd'")
    assert free.where("error IS NULL AND equal = 2 AND modified = 0").count() == 18


def test_pairs_of_two_folders(spark, tmp_path):
    for side, files in (("a", {"x.txt": "1\n2", "y.txt": "1"}), ("b", {"x.txt": "1\n3", "z.txt": "1"})):
        (tmp_path / side).mkdir()
        for n, t in files.items():
            (tmp_path / side / n).write_text(t)
    got = compared_files(spark, Task("t", "out", source={"left_dir": str(tmp_path / "a"), "right_dir": str(tmp_path / "b")})).collect()
    assert [(r["left"], r["equal"], r["modified"], r["error"]) for r in got] == [("x.txt", 1, 1, None)]


def test_cache(spark, tmp_path):
    cache = Cache(spark, str(tmp_path / "c"), "k", valid=F.col("text").isNotNull() & (F.size("items") > 0))
    at = lambda n: f"2024-01-{n:02} 00:00:00"
    write = lambda rows_, **kw: cache.upsert(spark.createDataFrame(rows_, "k string, text string, items array<int>, fetched_at string").withColumn("fetched_at", F.to_timestamp("fetched_at")), **kw)
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    assert cache.entries() is None and not any(r["hit"] for r in cache.lookup(wanted, F.lit(at(3)).cast("timestamp")).collect())
    write([("a", "one", [1], at(1)), ("b", "two", [1], at(2)), ("c", None, [1], at(2)), ("d", "x", [], at(2)), (None, "n", [1], at(2)), ("e", "e", [1], None)])
    assert sorted(r["k"] for r in cache.entries().collect()) == ["a", "b"]
    write([("a", "newer", [2], at(3)), ("a", "older", [2], at(1)), ("b", "late", [2], at(1))], oldest=F.lit(at(2)).cast("timestamp"))
    assert {(r["k"], r["text"]) for r in cache.entries().collect()} == {("a", "newer"), ("b", "two")}
    got = {r["k"]: r["hit"] for r in cache.lookup(wanted, F.lit(at(3)).cast("timestamp"), hours=12).collect()}
    assert got == {"a": True, "b": False, "c": False, None: False}
    write([("a", "tie", [2], at(3))])
    assert {r["text"] for r in cache.entries().where("k = 'a'").collect()} == {"tie"} and len(cache.generations()) == 2
    again = {r["text"] for r in cache.entries().collect()}
    write([])
    assert {r["text"] for r in cache.entries().collect()} == again


def test_second_writer_merges_on_top(spark, tmp_path):
    path = str(tmp_path / "c")
    cache, other = Cache(spark, path, "k"), Cache(spark, path, "k")
    row = lambda k: spark.createDataFrame([(k, 1)], "k string, v int").withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp"))
    publish, calls = cache._publish, []

    def late(number, name):
        if not calls:
            calls.append(number)
            other.upsert(row("theirs"))
        return publish(number, name)

    cache._publish = late
    cache.upsert(row("ours"))
    assert {r["k"] for r in cache.entries().collect()} == {"ours", "theirs"}


def test_files_are_written_whole(spark, tmp_path):
    df = spark.createDataFrame([("a/b.txt", "x"), ("c.bin", None), ("d.txt", "é")], "name string, content string")
    written.write_files(df.repartition(3), f"file://{tmp_path}/out")
    assert {p.relative_to(tmp_path / "out").as_posix(): p.read_bytes() for p in (tmp_path / "out").rglob("*.*") if p.is_file()} == {"a/b.txt": b"x", "c.bin": b"", "d.txt": "é".encode()}
    assert json.loads((tmp_path / "out" / "_SUCCESS").read_text()) == {"files": 3, "bytes": 3}
    with pytest.raises(Exception, match="not a name below"):
        written.write_files(spark.createDataFrame([("../up.txt", "x")], "name string, content string"), str(tmp_path / "bad"))
    assert not (tmp_path / "up.txt").exists() and not (tmp_path / "bad" / "_SUCCESS").exists()


def test_workbooks_of_a_folder_by_sheet(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.xlsx").write_bytes(ooxml.write({"S": (["a", "b"], [["1", "2"]] * 5), "T": (["t"], [["x"]])}))
    office.register(spark)
    read = spark.read.format("tessera_xlsx").load(str(tmp_path))
    assert read.rdd.getNumPartitions() == 6 and read.count() == 3 * 14
    few = spark.read.format("tessera_xlsx").option("sheet", "S").option("maxRows", 2).option("columns", "2").load(str(tmp_path / "1.xlsx"))
    assert sorted((r["row_no"], r["col_no"], r["text"]) for r in few.collect()) == [(1, 2, "b"), (2, 2, "2")]


def test_numbers_by_range(spark):
    df = spark.createDataFrame([("a" if k % 3 else None, k % 7, k) for k in range(300)], "g string, o int, k int").repartition(5)
    got = [tuple(r) for r in rows.numbered(df, ["g"], ["o"], "n").collect()]
    for g in ("a", None):
        mine = sorted(x for x in got if x[0] == g)
        assert sorted(x[3] for x in mine) == list(range(len(mine))) and [x[1] for x in sorted(mine, key=lambda x: x[3])] == sorted(x[1] for x in mine)
    assert sorted(r["n"] for r in rows.numbered(df, [], ["k"], "n").collect()) == list(range(300))


def test_recognition(spark):
    def stub_models():
        """Black on white is text; a line's letter is told by its width; grey pages make the reader fail."""

        def recognize(x):
            if x.min() > -0.9:
                raise RuntimeError("cannot read")
            probs = np.zeros((3, 4))
            probs[:, 1 if x.shape[2] < 150 else 2] = 0.9
            return probs

        return image.Models(detect=lambda x: (x.mean(0) < 0).astype(float), classify=lambda x: np.array([1.0, 0.0]), recognize=recognize, letters=["", "a", "b", "c"])

    def page(*marks, ink=0):
        img = np.full((96, 160, 3), 255, np.uint8)
        for y, x, w in marks:
            img[y : y + 8, x : x + w] = ink
        return bytearray(K.encode_png(img))

    two = page((60, 20, 20), (20, 20, 100))
    pages = [(1, 1, two), (1, 2, bytearray(b"broken")), (1, 3, page((20, 90, 20), (20, 20, 20))), (2, 1, two), (2, 2, page((20, 20, 30), ink=70)), (3, 1, None), (4, 1, page())]
    got = image.recognized(spark.createDataFrame(pages, "doc_id long, page int, content binary"), stub_models)
    assert sorted((r["doc_id"], r["page"], r["n"] or 0, r["text"], r["low_conf"], r["error"]) for r in got.collect()) == [(1, 1, 1, "b", False, None), (1, 1, 2, "a", False, None), (1, 3, 1, "a", False, None), (1, 3, 2, "a", False, None), (2, 2, 0, None, None, "cannot read")]
    items = image.text_items(got.where("error IS NULL"), F.lit(96.0), F.lit(1.0))
    assert sorted((r["line"], r["page"], r["str"]) for r in items.collect()) == [(1, 1, "b"), (2, 1, "a"), (3, 3, "a"), (4, 3, "a")]
