"""Places: range joins, marks on items, positions of paragraphs, containers."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.kernel import markup
from tessera.operators import interval, views


@pytest.mark.parametrize("width", [1, 7, 64])
def test_overlaps_equal_all_pairs(spark, width):
    rng = random.Random(width)
    span = lambda: (lambda s: (s, s + rng.randint(-2, 90)))(rng.randint(-100, 300))
    a = [(n, rng.choice(["x", "y", None]), *span()) for n in range(80)] + [(80, "x", None, 5)]
    b = [(n, rng.choice(["x", "y", None]), *span()) for n in range(80)] + [(80, "x", 5, None)]
    got = interval.overlapping(spark.createDataFrame(a, "i int, k string, a0 long, a1 long"), spark.createDataFrame(b, "j int, k string, b0 long, b1 long"), ["k"], ("a0", "a1"), ("b0", "b1"), width)
    want = [(i, j) for i, k, s, e in a for j, m, t, f in b if k and k == m and None not in (s, e, t, f) and max(s, t) < min(e, f)]
    assert sorted((r["i"], r["j"]) for r in got.collect()) == sorted(want) and want


def test_overlap_plan_has_no_range_join(spark):
    a, b = spark.createDataFrame([(1, 2, 3)], "k int, a0 long, a1 long"), spark.createDataFrame([(1, 2, 3)], "k int, b0 long, b1 long")
    plan = interval.overlapping(a, b, ["k"], ("a0", "a1"), ("b0", "b1"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


SEG = "array<struct<text:string,cls:string>>"
ITEM = "pair_id long, side string, page int, line int, col int, str string, transform array<double>, width double, ocr boolean"


def test_marks_on_items(spark):
    t = [10.0, 0.0, 0.0, 10.0, 100.0, 50.0]
    items = [(1, "left", 0, 1, 0, "hello", t, 50.0, False), (1, "left", 0, 1, 5, "", t, 0.0, False), (1, "left", 0, 1, 5, " you", t, 40.0, True), (1, "left", 1, 2, 0, "gone", t, 40.0, False)]
    marks = [(1, "left", 1, "rm", [("he", "eq"), ("llo y", "rm"), ("ou", "eq")]), (1, "left", 2, "rm", None), (1, "left", 9, "rm", None), (2, "left", 1, "rm", None)]
    got = interval.marked_items(spark.createDataFrame(marks, f"pair_id long, side string, line int, cls string, segs {SEG}"), spark.createDataFrame(items, ITEM))
    rows = sorted((r["line"], r["col"], r["begin"], r["end"], r["x"], r["width"], r["page"]) for r in got.collect())
    assert rows == [(1, 0, 2, 5, 120.0, 30.0, 0), (1, 5, 0, 2, 100.0, 20.0, 0), (2, 0, 0, 4, 100.0, 40.0, 1)]


def test_marks_of_flows(spark):
    flow = [(1, False, [("a\nb", "eq"), ("c\n\nd", "rm"), ("e", "eq")], [("a\nb", "eq"), ("e", "eq")]), (2, True, None, None), (3, False, [], [])]
    got = interval.flow_marks(spark.createDataFrame(flow, f"pair_id long, skipped boolean, seg_l {SEG}, seg_r {SEG}"))
    rows = sorted((r["pair_id"], r["side"], r["line"], r["cls"], [tuple(s) for s in r["segs"]]) for r in got.collect())
    assert rows == [(1, "left", 2, "rm", [("b", "eq"), ("c", "rm")]), (1, "left", 4, "rm", [("d", "rm"), ("e", "eq")])]


def test_positions_of_paragraphs(spark):
    texts = [(1, "one\n\ntwo\nlines\n\nthree\n\nfour"), (2, "alone"), (3, None), (4, " x")]
    measured = [(1, 0, "one", 10.0, 20.0), (1, 1, "other", 30.0, 20.0), (1, 2, "three", 70.0, 20.0), (2, 0, "else", 5.0, 5.0), (4, 0, "x", 0.0, 0.0)]
    m = spark.createDataFrame(measured, "id long, i int, text string, top double, height double")
    got = views.paragraph_positions(m, spark.createDataFrame(texts, "id long, text string"), "id")
    assert sorted((r["id"], r["line"], r["top"], r["height"], r["measured"]) for r in got.collect()) == [(1, 0, 0.0, 20.0, True), (1, 1, 10.0, 20.0, True), (1, 3, 34.0, 0.0, False), (1, 6, 70.0, 20.0, True), (1, 8, 72.0, 0.0, False)]
    assert views.paragraph_positions(m, spark.createDataFrame([], "id long, text string"), "id").count() == 0


def test_positions_of_real_pages(spark, sf_dir):
    """Every block that the text kept lies where it was measured, lines ascend with tops."""
    from tessera import catalog, catalog_places  # noqa: F401

    got = catalog.QUERIES["page_positions"](spark, sf_dir).toPandas().sort_values(["id", "line"])
    assert len(got) > 100 and got.measured.any()
    for _, g in got.groupby("id"):
        assert g.line.iloc[0] == 0 and g.top.is_monotonic_increasing and g.line.is_unique


@pytest.mark.parametrize(
    "page,want",
    [
        ('<html><head><style>p{}</style></head><body><nav>x</nav><div class="a"><i>y</i><div id="c">in<p>one<p>two</div>z</div>w</body></html>', '<html><head><style>p{}</style></head><body><div class="a"><div id="c" class="web-page">in<p>one<p>two</div></div></body></html>'),
        ('<body><p>a<div id="c" class="k">b</div>', '<body><div id="c" class="k web-page">b</div></body>'),
        ('<body><ul><li>a<li id=c>b<li>d</ul>', '<body><ul><li class="web-page" id=c>b</ul></body>'),
        ('<div><section id="c"><b>x</div>after', '<div><section class="web-page" id="c"><b>x</div>'),
        ('<body><script>var t = "<div id=c>"</script><div id="c">real</div></body>', '<body><div class="web-page" id="c">real</div></body>'),
        ('<body id="c">all</body>', '<body id="c">all</body>'),
        ("no container", "no container"),
        (None, None),
        ("", ""),
    ],
)
def test_containers(page, want):
    got = markup.trimmed(page, "c")
    assert got == want or (got is not None and got.replace(' class="web-page"', "") == (want or "").replace(' class="web-page"', "") and got.count("web-page") == want.count("web-page"))


def test_container_by_tag_and_notes():
    got = markup.trimmed("<body><nav>n</nav>\r\n<main><article x='1'>t</article></main></body>", "absent", "article", ["a<b", "c"])
    assert got == "<body><main><article class=\"web-page\" x='1'><div class=\"web-page-note\">a&lt;b；c</div>t</article></main></body>"
    assert markup.trimmed('<body><br/><div id="c"/>in</div>\n<p>x', "c") == '<body><div class="web-page" id="c"/>in</div></body>'


def test_long_groups_are_swept_in_stretches(spark):
    """The same places whether a group is one window or many, checked against a plain search."""
    from tessera.operators import asof

    rng = random.Random(9)
    groups = ["a", "b", None]
    anchors = sorted({(g, float(rng.randint(0, 1000))) for g in groups for _ in range(30 if g == "a" else 2)}, key=str)
    anchors = [(g, x, x * 3 + rng.randint(0, 9)) for g, x in anchors]
    points = [(n, rng.choice([*groups, "c"]), rng.choice([rng.uniform(-300, 1300), float(rng.randint(0, 1000))])) for n in range(400)] + [(400, "a", None)]
    p, a = spark.createDataFrame(points, "n int, g string, x double"), spark.createDataFrame(anchors, "g string, l double, r double")
    found = {w: {r["n"]: r["y"] for r in asof.interpolate(p, a, "g", width=w).collect()} for w in (None, 10.0, 250.0)}
    last = {w: {r["n"]: r["r"] for r in asof.last_at_or_before(p, a, "g", "x", "l", "r", width=w).collect()} for w in (None, 10.0, 250.0)}
    for w in (10.0, 250.0):
        assert all(found[w][n] == y or abs(found[w][n] - y) < 1e-9 for n, y in found[None].items() if n < 400) and last[w] == last[None]
    for n, g, x in points[:400]:
        before = [(l, r) for h, l, r in anchors if h == g and l <= x]
        assert last[10.0][n] == (max(before)[1] if before else None)


def test_marks_meet_items_in_one_join(spark):
    """Items move once, lines are cut behind the join; ranges over many stretches, items over several, empty segments."""
    rng = random.Random(5)
    t, marks, items = [10.0, 0.0, 0.0, 10.0, 0.0, 50.0], [], []
    for line in range(1, 30):
        segs = [("x" * rng.choice([0, 1, 5, 70, 200]), rng.choice(["eq", "rm"])) for _ in range(rng.randrange(8))]
        marks.append((1, "left", line, "rm", None if line % 7 == 0 else segs))
        items += [(1, "left", 0, line, at, "y" * n, t, 1.0, False) for at in range(0, 400, 90) for n in (0, 3, 90, 150)]
    marks.append((1, "left", 5, "ad", [("xx", "ad")]))
    want = []
    for _, _, line, cls, segs in marks:
        ends = [sum(len(s) for s, _ in segs[: k + 1]) for k in range(len(segs))] if segs is not None else []
        for _, _, _, n, at, s, *_ in (i for i in items if i[3] == line and i[5]):
            if segs is None:
                want.append((line, at, len(s), cls, 0, len(s)))
            want += [(line, at, len(s), c, max(e - len(x), at) - at, min(e, at + len(s)) - at) for e, (x, c) in zip(ends, segs or [], strict=True) if c != "eq" and x and max(e - len(x), at) < min(e, at + len(s))]
    m = spark.createDataFrame(marks, f"pair_id long, side string, line int, cls string, segs {SEG}")
    i = spark.createDataFrame([x for x in items], ITEM)
    got = interval.marked_items(m, i.withColumn("width", F.length("str").cast("double")))
    assert sorted((r["line"], r["col"], r["cls"], r["begin"], r["end"]) for r in got.collect()) == sorted((x[0], x[1], *x[3:]) for x in want)
    packed = i.groupBy("pair_id", "side", "line").agg(F.collect_list(F.struct("page", "col", "str", "transform", "width", "ocr")).alias("all"))
    assert sorted(map(str, interval.marked_items(m, packed, F.col("all")).drop("width", "x").collect())) == sorted(map(str, got.drop("width", "x").collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # two before
