"""DataFrame operators against their SQL and against stated values."""

from __future__ import annotations

import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import catalog, catalog_books, catalog_texts, catalog_views  # noqa: F401
from tessera.functions import style as S
from tessera.functions import values as V
from tessera.functions import web as W
from tessera.kernel import image, ooxml
from tessera.operators import asof, batch, rows, table_diff, text_diff
from tessera.operators import image as I
from tessera.operators import style as ST
from tessera.options import NormOptions, TableDiffConfig
from tessera.plans import report, task
from tessera.sources import office, written
from tessera.streaming import table_stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list:
    value = lambda v: None if v is None or (not isinstance(v, str) and pd.isna(v)) else round(float(v), 9) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v
    return sorted((tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    assert plain(catalog.QUERIES[name](spark, sf_dir).toPandas()) == plain(duck.sql(catalog.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_runs(spark, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    assert got.count() > 0 and len(set(got.columns)) == len(got.columns)


def test_alignment_queries_equal_plain_versions(spark, sf_dir):
    """What SQL cannot tell of arbitrary texts, told by a table of common subsequences."""
    from difflib import SequenceMatcher

    from test_kernel import table_length

    pairs = {r["pair_id"]: (r["left"] or "", r["right"] or "") for r in catalog.document_pairs(spark, sf_dir).collect()}
    stats = {r["pair_id"]: r for r in catalog.QUERIES["text_diff_stats"](spark, sf_dir).collect()}
    assert set(stats) == set(pairs)
    for p, (left, right) in pairs.items():
        a, b = (t.replace("\r", "").lower().split("\n") if t else [] for t in (left, right))
        s = stats[p]
        assert s["equal"] + s["modified"] + s["removed"] == len(a) and s["equal"] + s["modified"] + s["added"] == len(b)
        if SequenceMatcher(None, a, b, autojunk=False).quick_ratio() == 0:
            assert s["equal"] == 0
        if len(a) * len(b) < 10_000:
            assert s["equal"] == table_length(a, b)
    flows = {r["pair_id"]: r for r in catalog.QUERIES["char_diff_stats"](spark, sf_dir).collect()}
    short = sorted(pairs, key=lambda p: len(pairs[p][0]) * len(pairs[p][1]))[:12]
    for p in short:
        a, b = ("".join(t.split()) for t in pairs[p])
        assert len(a) - flows[p]["removed_chars"] == len(b) - flows[p]["added_chars"] == table_length(a, b)


def test_every_document_meets_its_successor(spark, tmp_path):
    docs = [(1, "en"), (2, "de"), (3, "en"), (5, None), (6, "en"), (7, "de"), (8, None), (9, "en"), (10, None), (11, "fr")]
    spark.createDataFrame([(i, k, f"text {i}") for i, k in docs], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalog.document_pairs(spark, str(tmp_path)).collect()}
    assert got == {(a, f"text {a}", f"text {b}") for a, b in [(1, 3), (3, 6), (6, 9), (2, 7), (5, 8), (8, 10)]}


def test_every_turn_meets_the_one_two_places_on(spark, tmp_path):
    turns = [(1, 0), (1, 1), (1, 2), (1, 3), (1, 5), (2, 1), (2, 2), (3, 1), (3, 3)]
    spark.createDataFrame([(c, t, "user", f"text {c} {t}") for c, t in turns], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(r["pair_id"] for r in catalog.QUERIES["similar_turns"](spark, str(tmp_path)).collect())
    assert got == [1000, 1001, 1003, 3001]


def values(spark, pairs):
    return spark.createDataFrame(pairs, "a string, b string")


def test_loose_equality(spark):
    pairs = [("2024-05-01", "2024-05-01", True), ("2024-05-01", "2024-05-02", False), ("0", "0.0", True), ("98.5", "98.5000000000001", True), ("", None, True), ("", "x", False), ("98.5%", "98.5", False), (" A ", "A", True), ("nan", None, True), ("2024-02-31", "2024/3/2", True), ("1,234.5", "1234.5", False), ("Infinity", "Infinity", True), ("1d", "1", False)]
    got = values(spark, [p[:2] for p in pairs]).select(V.loosely_equal(F.col("a"), F.col("b")).alias("e")).collect()
    assert [r["e"] for r in got] == [p[2] for p in pairs]


def test_key_detection():
    assert table_diff.detect_key(["批号", "提取物批号"], ["批号", "提取物批号"]) == "提取物批号" and table_diff.detect_key(["a"], ["b"]) is None
    assert table_diff.detect_key(["公共列 / 批号"], ["公共列 / 批号"]) == "公共列 / 批号"


def sheet(spark, headers, data):
    return spark.createDataFrame([(i + 2, *r) for i, r in enumerate(data)], ", ".join(["_row long", *(f"`{h}` string" for h in headers)]))


def counts(diff):
    return {r["category"]: r["n"] for r in diff.groupBy("category").agg(F.count(F.lit(1)).alias("n")).collect()}


def test_table_cases(spark):
    old = sheet(spark, ["批号", "v"], [("K7", "8"), ("K8", "12.50"), ("K9", "x")])
    new = sheet(spark, ["批号", "v"], [("K7", "8.00"), ("K8", "12.75"), ("L1", "y")])
    diff = table_diff.table_diff(old, new, row="_row")
    assert counts(diff) == {"added": 1, "deleted": 1, "modified": 1, "unchanged": 1}
    (cell,) = table_diff.changed_cells(diff).collect()
    assert (cell["column"], cell["old_value"], cell["new_value"], cell["new_row"]) == ("v", "12.50", "12.75", 3)
    strict = table_diff.table_diff(old, new, TableDiffConfig(equality="strict"), "_row")
    assert counts(strict)["modified"] == 2
    whole = table_diff.table_diff(sheet(spark, ["a", "b"], [("1", "2"), ("3", "4")]), sheet(spark, ["a", "b"], [("1", "2"), ("3", "9")]), row="_row")
    assert counts(whole) == {"added": 1, "deleted": 1}
    s = table_diff.structure(["a", "b"], ["a", "c"], TableDiffConfig(keys=("a",)))
    assert s.new_columns == ["c"] and s.deleted_columns == ["b"] and s.mode == "key"
    shape = table_diff.table_diff(sheet(spark, ["a", "b"], [("1", "2")]), sheet(spark, ["a", "c"], [("1", "9")]), TableDiffConfig(keys=("a",)), "_row")
    assert shape.first()["changed_cols"] == ["c", "旧_b"]


def test_duplicate_and_blank_keys(spark):
    old = sheet(spark, ["id", "v"], [("A", "1"), ("A", "2"), ("B", "1"), ("B", "2"), ("", "x"), (None, "y")])
    new = sheet(spark, ["id", "v"], [("A", "1"), ("A", "2"), ("", "z"), ("C", None)])
    assert counts(table_diff.table_diff(old, new, row="_row")) == {"unchanged": 1, "modified": 1, "deleted": 2, "added": 1}
    both = TableDiffConfig(keys=("k1", "k2"))
    a, b = sheet(spark, ["k1", "k2", "v"], [("", None, "1")]), sheet(spark, ["k1", "k2", "v"], [(None, "", "2")])
    assert counts(table_diff.table_diff(a, b, both, "_row")) == {"modified": 1}
    assert counts(table_diff.table_diff(a, b, TableDiffConfig(keys=("k1", "k2"), blank_composite_is_key=False), "_row")) == {}


def test_workbook_and_reports(spark, tmp_path):
    old = {"原料": sheet(spark, ["批号", "品名"], [("1", "a"), ("2", "b"), ("3", "c")]), "停用": sheet(spark, ["批号"], [("1",), ("2",)])}
    new = {"原料": sheet(spark, ["批号", "品名"], [("1", "a"), ("2", "B"), ("4", "d")])}
    diff = table_diff.workbook_diff(old, new, row="_row").cache()
    total = table_diff.totals(diff).first()
    assert (total["added"], total["modified"], total["deleted"], total["sheets_compared"]) == (1, 1, 3, 2)
    found = report.tables(diff.where("sheet = '原料'"), new["原料"], ["批号", "品名"], ["批号", "品名"], "_row")
    assert found["modified"].first().asDict()["旧_品名"] == "b" and found["added"].first()["品名"] == "d" and found["deleted"].first()["品名"] == "c"
    written.write_files(report.workbooks(found), str(tmp_path / "out"))
    assert "变更汇总" in ooxml.Workbook((tmp_path / "out" / "report.xlsx").read_bytes()).sheet_names
    assert json.loads((tmp_path / "out" / "_SUCCESS").read_text())["files"] == 1
    report.write_tables(found, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables" / "added")).count() == 1
    same = table_diff.overview(table_diff.table_diff(new["原料"], new["原料"], row="_row"))
    assert [(r["category"], r["n"]) for r in same.collect()] == [("none", 0)]
    many = {r["name"]: ooxml.Workbook(bytes(r["content"])) for r in report.workbooks({"summary": found["summary"]}, by="sheet", most=1).collect()}
    assert len(many) == found["summary"].count() and all(len(list(b.rows("变更汇总"))) == 2 for b in many.values())


def pairs(spark, *found):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(found)], "pair_id long, left string, right string")


def test_unified_and_html(spark):
    p = pairs(spark, ("aa\nbb\ncc\ndd\nee\nff\ngg", "aa\nbb\ncc\nXX\nee\nff\ngg"), ("abc\ndef", "abc\ndef"), ("", "x\ny"), (None, None))
    r = text_diff.diff_rows(p)
    u = {x["pair_id"]: x["unified"] for x in text_diff.unified(r).collect()}
    assert u[0] == "--- a/原文\n+++ b/修改后\n@@ -1,7 +1,7 @@\n aa\n bb\n cc\n-dd\n+XX\n ee\n ff\n gg" and 1 not in u and "@@ -1,0 +1,2 @@" in u[2]
    s = {x["pair_id"]: x for x in text_diff.messages(text_diff.grid_stats(p, r)).collect()}
    assert s[1]["message"] == "identical" and s[2]["added"] == 2 and s[3]["equal"] == 0 and s[0]["modified"] == 1
    named = p.select(F.lit("t").alias("g"), "*", F.when(F.col("pair_id") == 0, "fi<rst").alias("left_name"), F.lit("r").alias("right_name"), F.when(F.col("pair_id") == 3, "unreadable").alias("error"))
    pages = report.html_pages(named, "g").collect()
    page = bytes(pages[0]["content"]).decode()
    assert pages[0]["name"] == "t.html" and "fi&lt;rst ↔ r" in page and "<del>dd</del>" in page and page.count("<section") == 4 and "unreadable" in page
    assert page.count('<a href="#pair-0">') == 2 and page.count('<a href="#top">') == 5 and '<div id="top"></div>' in page and "localStorage" in page
    one = bytes(report.html_pages(named.where("pair_id = 1"), "g").first()["content"]).decode()
    assert "<ol>" not in one and "<nav" not in one
    flow = bytes(report.html_pages(named.where("pair_id = 0").withColumn("styles", F.expr("array(named_struct('para', 1, 'prop', '字号', 'expect', '16', 'actual', '<12>'))")), "g", NormOptions(ignore_newline=True)).first()["content"]).decode()
    assert "<del>dd</del>" in flow and "&lt;12&gt;" in flow and "样式核对" in flow
    m = text_diff.marks(r).where("pair_id = 0").collect()
    assert {(x["side"], x["line"]) for x in m} == {("left", 4), ("right", 4)}
    ranges = text_diff.segment_ranges(text_diff.marks(r).where("pair_id = 0 AND side = 'left'"), ["pair_id"]).collect()
    assert [(x["start"], x["stop"], x["cls"]) for x in ranges] == [(0, 2, "rm")]
    assert text_diff.redlines(r).count() == 1 and text_diff.line_table(r).where("pair_id = 0").count() == 7
    assert text_diff.swapped(p).where("pair_id = 2").first()["left"] == "x\ny"
    assert text_diff.text_diff(p, NormOptions(ignore_newline=True)).count() == 4 and text_diff.spread(p, 3).count() == 4
    assert {x["pair_id"]: x["similarity"] for x in text_diff.similarities(p).collect()}[1] == 1.0


def test_anchor_places(spark):
    left = [f"Line {i:03d} shared content alpha beta" for i in range(1, 81)]
    right = left[:20] + [f"Inserted extra line {k} of ten" for k in range(10)] + left[20:45] + left[50:]
    a = text_diff.anchors(pairs(spark, ("\n".join(left), "\n".join(right)))).cache()
    points = spark.createDataFrame([(0, 0.0), (0, 40.0), (0, 60.0), (0, 200.0)], "pair_id long, x double")
    line, char = a.where("level = 'line'"), a.where("level = 'char'")
    got = {r["x"]: r["y"] for r in asof.translate_line(points, line, char, "pair_id").collect()}
    assert got == {0.0: 0.0, 40.0: 50.0, 60.0: 65.0, 200.0: 205.0}
    none = asof.interpolate(points, line.limit(0), "pair_id").collect()
    assert [r["x"] for r in none] == [r["y"] for r in none]


def test_reading_order_and_positions(spark):
    items = spark.createDataFrame([(1, "A", 100.0, 100.0, 10.0), (1, "B", 100.0, 10.0, 10.0), (1, "C", 200.0, 10.0, 10.0)], "page long, text string, top double, left double, height double")
    assert [r["text"] for r in rows.reading_order(items, "page").orderBy("position").collect()] == ["B", "A", "C"]
    t = spark.createDataFrame([(1, 1, 1, "ab", False), (1, 1, 2, "c", True), (1, 1, 3, "d", False)], "doc long, page int, n int, str string, has_eol boolean")
    assert [(r["line"], r["col"]) for r in rows.text_positions(t, ["doc"], ["page", "n"]).orderBy("n").collect()] == [(1, 0), (1, 2), (2, 0)]


def test_batch_layout(spark, tmp_path):
    names = ["B-甲/0001 当归/当归-广东确定.pdf", "B-甲/0001 当归/当归-内蒙古确定.pdf", "B-甲/0001 当归/当归-山东确定.pdf", "B-甲/0002 黄芪/黄芪-广东.pdf", "B-甲/0002 黄芪/黄芪-云南.pdf", "B-甲/0002 黄芪/黄芪.html", "B-乙/0003 甘草/广东土牛膝-广东确定.pdf", "B-乙/0003 甘草/广东土牛膝-江西确定.pdf", "B-甲/直接文档-广东.pdf", "B-甲/直接文档-山东.pdf"]
    files = spark.createDataFrame([(n, n.rpartition("/")[0], n.rpartition("/")[2]) for n in names], "path string, dir string, name string")
    plan = task.planned(spark, task.Task("t", "out", source={"root": "x"}), files)
    assert sorted(r["n"] for r in plan.groupBy("output").agg(F.count(F.lit(1)).alias("n")).collect()) == [1, 1, 1, 2]
    many = spark.createDataFrame([("d", f"{i:02d}") for i in range(25)], "dir string, left string")
    size = lambda k: [r["n"] for r in batch.volumes(many, ["dir"], ["left"], k).groupBy("volume", "output").agg(F.count(F.lit(1)).alias("n")).orderBy("volume").collect()]
    assert size(10) == [10, 10, 5] and size(6) == [6, 6, 6, 6, 1]
    for d, fs in {"l": ["A.pdf", "b.pdf", "x.txt"], "r": ["a.PDF", "c.pdf"]}.items():
        (tmp_path / d).mkdir()
        for f in fs:
            (tmp_path / d / f).write_text("t")
    found = task.planned(spark, task.Task("t", "out", source={"left_dir": str(tmp_path / "l"), "right_dir": str(tmp_path / "r"), "glob": "*.{pdf,doc}"}))
    assert [(r["left"], r["right"], r["output"]) for r in found.collect()] == [("A.pdf", "a.PDF", "out")]
    with pytest.raises(ValueError, match="either"):
        task.Task("t", "o")
    p = pairs(spark, ("a", "b"), ("a", "a")).withColumn("volume", F.col("pair_id") + 1)
    assert task.totals(task.run(p, NormOptions())).where("volume IS NULL").first()["pairs"] == 2
    assert batch.expand_braces("{a,b{1,2}}x") == ["ax", "b1x", "b2x"]


def test_style_comparison(spark):
    html = "<p style='font-size:10pt'>第一段</p><p style='font-size:10pt'>第二段</p><p style='font-size:10pt;text-indent:0.29in'>第三段</p>"
    other = "<p style='font-size:10pt'>第一段</p><p style='font-size:12pt'>第三段</p>"
    a = ST.html_vectors(spark.createDataFrame([(1, html)], "doc_id long, html string"))
    e = ST.html_vectors(spark.createDataFrame([(1, other)], "doc_id long, html string"))
    met = ST.compared(a, e)
    diffs = ST.style_diff(met)
    assert [(r["para"], r["prop"], r["expect"], r["actual"]) for r in diffs.collect()] == [(2, "字号", "12pt", "10pt")]
    s = ST.style_summary(met, diffs).first()
    assert (s["aligned"], s["only_actual"], s["only_expected"], s["total"], s["by_prop"]) == (2, 1, 0, 1, "字号×1")
    spec = {"defaults": {"family": "宋体", "size_pt": 9.0}, "rules": [{"match": {"text_starts": "第二"}, "set": {"size_pt": 14.0, "align": "center"}}, {"match": {"align": "center"}, "set": {"indent_in": 0.0}}]}
    laid = {r["i"]: r for r in ST.apply_spec(a, spec).collect()}
    assert laid[1]["size_pt"] == 14 and laid[1]["indent_in"] == 0 and laid[0]["family"] == "宋体" and laid[0]["size_pt"] == 10
    assert ST.vectors_text(e).first()["text"] == "第一段\n\n第三段" and ST.jump_line(a, F.lit("第三段落")).first()["i"] == 2
    one = spark.range(1).select(S.indent_inches(F.lit(0.29), F.lit(None).cast("double"), F.lit(10.0)).alias("a"), S.indent_inches(F.lit(None).cast("double"), F.lit(2.0), F.lit(10.0)).alias("b"))
    assert one.select(S.near(F.col("a"), F.col("b"), "indent_in").alias("n")).first()["n"]


def test_web_forms(spark):
    html = '<head><meta name="SiteDomain" content="a.gov.cn"><link rel="stylesheet" href="/c.css"><link rel=icon href=x></head><script>1</script><div id="zoom">t</div>'
    r = spark.createDataFrame([(html,)], "h string").select(W.site_origin(F.col("h")).alias("o"), W.container(F.col("h")).alias("c"), W.css_links(F.col("h")).alias("l"), W.sanitized(F.col("h"), F.lit("http://b/")).alias("s"), W.charset(F.lit("text/html; charset=GBK"), F.col("h")).alias("k"), W.charset(F.lit(None).cast("string"), F.lit('<meta charset="gb2312">')).alias("m")).first()
    assert (r["o"], r["c"], r["l"], r["k"], r["m"]) == ("https://a.gov.cn/", "zoom", ["/c.css"], "gbk", "gb2312") and "<script" not in r["s"] and '<head><base href="http://b/">' in r["s"]
    forms = [("//h/x", "https://h/x"), ("http://h", "http://h"), ("/a/b.HTML", "/a/b.HTML"), ("C:\\x.htm", "C:\\x.htm"), ("abc", None)]
    got = spark.createDataFrame(forms, "t string, w string").select(W.reference(F.col("t")).alias("g"), "w").collect()
    assert all(x["g"] == x["w"] for x in got)
    raw = spark.createDataFrame([(bytearray("中".encode("gbk")), "gbk"), (bytearray(b"x"), "nope")], "content binary, charset string")
    assert [x["text"] for x in office.decoded(raw).collect()] == ["中", "x"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(ooxml.write({"S": (["批号", "v"], [["P1", "1"], ["P2", "2"]])}))
    assert office.workbook_cells(spark, str(tmp_path)).count() == 6 and office.preview(spark, str(tmp_path), 1).count() == 2
    got = office.sheet_table(spark, str(tmp_path / "a.xlsx"), "S")
    assert sorted((r["_row"], r["批号"]) for r in got.collect()) == [(2, "P1"), (3, "P2")]
    assert office.sheet_meta(spark, str(tmp_path)).first()["freeze_rows"] == 1
    office.register(spark)
    assert spark.read.format("tessera_xlsx").option("sheet", "S").load(str(tmp_path / "a.xlsx")).count() == 6
    import zipfile

    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>")
    assert [r["text"] for r in office.document_paragraphs(spark, str(tmp_path)).orderBy("para_no").collect()] == ["one", "two"]
    parts = office.document_parts(spark, str(tmp_path)).withColumn("doc_id", F.lit(1).cast("long"))
    assert ST.docx_vectors(parts).count() == 2


def test_images(spark):
    import numpy as np

    img = np.full((120, 64, 3), 255, np.uint8)
    img[:20] = img[40:] = 0
    made = spark.createDataFrame([(1, bytearray(image.encode_png(img)))], "id long, content binary")
    assert I.seam_bands(made).where("kind = 'blank'").first()["y0"] == 20 and I.ink_bands(made, 60).count() == 2 and I.frame_quality(made).first()["colorful"] == 0
    prob = np.zeros((40, 60))
    prob[10:16, 10:40] = 0.9
    assert I.ocr_boxes(spark.createDataFrame([(1, 60, prob.ravel().tolist())], "id long, w int, prob array<double>")).count() == 1
    p = [[0.0, 1.0], [1.0, 0.0], [0.0, 1.0]]
    assert I.ctc_decode(spark.createDataFrame([(1, p)], "id long, probs array<array<double>>"), ["", "x"]).first()["text"] == "xx"
    box = [{"x": 10.0, "y": 20.0}, {"x": 50.0, "y": 20.0}, {"x": 50.0, "y": 40.0}, {"x": 10.0, "y": 40.0}]
    lines = spark.createDataFrame([(1, 1, 0, "hi", box, False), (1, 2, 0, "yo", box, False), (1, 2, 1, "bad", box, True)], "doc_id long, page int, n int, text string, box array<struct<x:double,y:double>>, low_conf boolean")
    items = I.text_items(lines, F.lit(100.0), F.lit(2.0))
    assert [(r["line"], r["transform"][5], r["width"]) for r in items.orderBy("line").collect()] == [(1, 80.0, 20.0), (2, 80.0, 20.0)]
    assert I.item_text(items).first()["text"] == "hi\n\nyo\n" and I.scanned(I.item_text(items)).count() == 0
    rect = items.select(F.struct("*").alias("it")).select(*[c.alias(n) for n, c in I.highlight("it", F.lit(0), F.lit(1)).items()]).first()
    assert abs(rect["width"] - 10) < 1e-9
    assert spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(I.affine([F.lit(float(x)) for x in (2, 0, 0, 2, 1, 1)], [F.lit(float(x)) for x in (1, 0, 0, 1, 3, 4)]))]).first()[4] == 7
    sized = spark.createDataFrame([(1, 100.0, 200.0), (1, 50.0, 100.0)], "doc_id long, w double, h double")
    assert {r["s"] for r in sized.select(I.page_scale("page", F.col("w"), F.col("h"), 80.0, 100.0).alias("s")).collect()} == {0.5}


def test_stream(spark, tmp_path):
    base = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, v string")
    spark.createDataFrame([("1", "a"), ("2", "c"), ("3", "d")], "id string, v string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, v string").parquet(str(tmp_path / "in"))
    table_stream.diff_stream(stream, base, str(tmp_path / "out"), str(tmp_path / "ck"), TableDiffConfig(keys=("id",))).awaitTermination()
    assert counts(spark.read.parquet(str(tmp_path / "out"))) == {"added": 1, "modified": 1, "unchanged": 1}
    events = spark.createDataFrame([("k", "2024-01-01 00:00:00.0", "x"), ("k", "2024-01-01 00:00:00.2", "y"), ("k", "2024-01-01 00:00:05", "z")], "k string, at string, v string").withColumn("at", F.to_timestamp("at"))
    assert sorted((r["v"], r["n"]) for r in table_stream.debounced(events, "k", "at", "v").collect()) == [("y", 2), ("z", 1)]


def test_hot_keys_of_a_table_are_dealt(spark, monkeypatch):
    """One key with most rows of both sides gives the same result dealt over many tasks."""
    old = spark.createDataFrame([("k" if n % 3 else str(n), str(n), n) for n in range(300)], "id string, v string, row long")
    new = spark.createDataFrame([("k" if n % 2 else str(n), str(n + n % 5), n) for n in range(300)], "id string, v string, row long")
    config = TableDiffConfig(keys=("id",))
    found = lambda: sorted(map(repr, table_diff.table_diff(old, new, config, row="row").collect()))
    want = found()
    monkeypatch.setattr(table_diff, "HOT_ROWS", 10)
    assert found() == want and len(want) > 300
    left = spark.createDataFrame([("k",)] * 95 + [("a",)], "key string")
    hot = table_diff.hot_keys(left, left.limit(0))
    assert [tuple(r) for r in hot.collect()] == [("k", 10)]
    dealt = table_diff._dealt(left.withColumn("n", F.monotonically_increasing_id()), hot, "n").groupBy("key", "salt").count().collect()
    assert max(r["count"] for r in dealt) < 40 and sum(r["count"] for r in dealt) == 96
