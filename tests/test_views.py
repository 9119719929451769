"""Views, positions and fetching."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import views


def test_cells_and_columns(spark):
    df = spark.createDataFrame([({"a": "1", "k": "K", "b": "", "c": "3"},)], "m map<string,string>")
    got = df.select(views.capped_cells(F.col("m"), ["k"], 2).alias("c")).first()["c"]
    assert got["shown"][0] == "k: K" and len(got["shown"]) == 2 and got["rest"] == 1
    assert views.short_columns(["x / a", "x / b", "x / c", "y / d"]) == ["a", "b", "c", "y / d"]
    hidden = df.select("m", F.lit(1).alias("h", metadata={"hidden": True}))
    assert views.visible(hidden).columns == ["m"]
    one = spark.range(1).select(views.pixel_width(F.lit(10.0), F.lit("x")).alias("a"), views.pixel_width(F.lit(None).cast("double"), F.lit("x")).alias("b"), views.report_name(F.lit("l"), F.lit("r"), F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("n")).first()
    assert (one["a"], one["b"], one["n"]) == (87, 56, "l-r-对比报告-202401020304.xlsx")
    def fnv(text):
        h = 0x811C9DC5
        for unit in memoryview(text.encode("utf-16-le")).cast("H"):
            h = (h ^ unit) * 0x01000193 & 0xFFFFFFFF
        return f"{h:x}"

    said = ["a", "", "\U0001f600 \uff21é", "x" * 3000]
    got = spark.createDataFrame([(t,) for t in [*said, None]], "s string").select("s", views.fnv1a(F.col("s")).alias("h")).collect()
    assert {r["s"]: r["h"] for r in got} == {t: fnv(t) for t in said} | {None: "811c9dc5"} and fnv("a") == "e40c292c"


def test_badges_and_sections(spark):
    diff = spark.createDataFrame([("A", "added", 1, None), ("A", "modified", 2, 2), ("B", "unchanged", 1, 1)], "sheet string, category string, new_row long, old_row long")
    sheets = spark.createDataFrame([("A",), ("B",), ("C",)], "sheet string")
    assert {r["sheet"]: r["badge"] for r in views.badges(diff, sheets).collect()} == {"A": 2, "B": 0, "C": 0}
    assert [r["category"] for r in views.section(diff).collect()] == ["modified", "added", "unchanged"] and views.section(diff, "added").count() == 1


def test_positions(spark):
    items = spark.createDataFrame([(1, 1, [10.0, 0.0, 0.0, 10.0, 5.0, 80.0]), (1, 1, [12.0, 0.0, 0.0, 12.0, 9.0, 80.0]), (1, 2, [10.0, 0.0, 0.0, 10.0, 5.0, 60.0])], "doc long, line int, transform array<double>")
    got = views.with_reach(views.line_positions(items, "doc", F.lit(100.0)), "doc").orderBy("line").collect()
    assert [(r["line"], r["top"], r["reach"]) for r in got] == [(0, 0.0, 8.0), (1, 8.0, 22.0), (2, 30.0, 12.0)]


def test_styles_and_blocks(spark):
    html = '<link rel=stylesheet href="/a.css"><link rel=stylesheet href="b.css"><link rel=stylesheet href="http://x/c.css"><p>one  two</p><div>three</div>'
    pages = spark.createDataFrame([(1, "http://h/d/p.html", html)], "id long, url string, html string")
    assets = spark.createDataFrame([("http://h/a.css", "A"), ("http://h/d/b.css", "B")], "url string, css string")
    got = views.inlined_styles(pages, assets).first()
    assert got["css"] == "A\nB" and got["failed"] == ["http://x/c.css"]
    assert [r["text"] for r in views.blocks(pages).orderBy("n").collect()] == ["one two", "three"]


def test_fetching(spark):
    def transport(url, timeout, most):
        return {"http://ok/": (200, {"content-type": "text/html; charset=gbk"}, b"\xd6\xd0"), "http://go/": (302, {"location": "http://ok/"}, b""), "http://in/": (302, {"location": "http://local/"}, b""), "http://loop/": (302, {"location": "http://loop/"}, b""), "http://big/": (200, {}, b"x" * (9 << 20))}.get(url, (500, {}, b""))

    resolve = lambda host: ["127.0.0.1"] if host == "local" else ["8.8.8.8"]
    urls = spark.createDataFrame([(u,) for u in ("http://ok/", "http://go/", "http://in/", "http://loop/", "http://big/", "http://bad/", "ftp://x/", "http://local/")], "url string")
    got = {r["url"]: r for r in views.fetched(urls, transport, resolve).collect()}
    assert bytes(got["http://ok/"]["content"]) == b"\xd6\xd0" and got["http://go/"]["final_url"] == "http://ok/"
    assert [got[u]["status"] for u in ("http://in/", "http://loop/", "http://big/", "http://bad/", "ftp://x/", "http://local/")] == [400, 502, 502, 502, 400, 400]
