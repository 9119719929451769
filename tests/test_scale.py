"""Work that follows the input: cells of folders, lines compared together, small frames, suffixes that rules leave."""

import random

from pyspark.sql import functions as F

from tessera.kernel import align, lcs
from tessera.operators import batch, style, text_diff
from tessera.options import NormOptions


def test_lines_of_a_region_share_passes(monkeypatch):
    rng = random.Random(1)
    line = lambda: "".join(rng.choices("abcdé \t", k=rng.randrange(40)))
    left, right = [line() for _ in range(20)] + [""], [line() for _ in range(25)] + [""]
    want = [[align.similarity(x, y) for y in right] for x in left]
    assert align.similarities(left, right) == want and align.similarities(right, left) == [list(r) for r in zip(*want, strict=True)]
    monkeypatch.setattr(lcs, "TOGETHER", 64)  # several rows
    assert align.similarities(left, right) == want
    monkeypatch.undo()
    built = []
    monkeypatch.setattr(lcs._Masks, "__init__", lambda self, b, made=lcs._Masks.__init__: (built.append(len(b)), made(self, b))[1])
    align.pair_changed(list(enumerate(left)), list(enumerate(right)))
    assert len(built) == 1  # one per pair of lines before


def test_text_within_another_needs_no_table(monkeypatch):
    text = "".join(random.Random(2).choices("ab\nc ", k=3000))
    thin = text.replace("a", "")
    want = lcs.matches(text, thin), lcs.matches(thin, text), lcs.matches("xabcabcy", "zabcbcaw")
    monkeypatch.setattr(lcs, "_within", lambda a, b: False)
    assert (lcs.matches(text, thin), lcs.matches(thin, text), lcs.matches("xabcabcy", "zabcbcaw")) == want
    monkeypatch.undo()
    monkeypatch.setattr(lcs, "_Masks", None)
    assert lcs.length(text, thin) == lcs.length(thin, text) == len(thin) == len(lcs.matches(text, thin))


def test_rows_without_segments_and_counted_anchors(spark):
    made = [(1, "a\nbb\nccc\n", "a\nbx\nddd"), (2, "", None), (3, "x y", "x y"), (4, "p", "q")]
    pairs = spark.createDataFrame(made, "pair_id long, left string, right string")
    plain, bare = (text_diff.diff_rows(pairs, with_segments=w) for w in (True, False))
    key = ["pair_id", "row_ord", "type", "li", "ri", "left_text", "right_text"]
    assert sorted(map(str, plain.select(key).collect())) == sorted(map(str, bare.select(key).collect()))
    assert bare.where("seg_l IS NOT NULL OR seg_r IS NOT NULL").count() == 0
    for o in (NormOptions(), NormOptions(ignore_newline=True)):
        want = text_diff.anchors(pairs, o, limit=12).groupBy("pair_id", "level").agg(F.count(F.lit(1)).alias("n"), F.max("coverage").alias("coverage"))
        assert sorted(map(str, text_diff.anchor_stats(pairs, o, limit=12).collect())) == sorted(map(str, want.collect()))


def test_large_folders_are_cut_into_cells(spark, monkeypatch):
    names = [("hot", f"{'l' if k % 3 else 'r'}{k % 40}") for k in range(90)] + [("cold", "l1"), ("cold", "r1"), ("left only", "l1"), (None, "l1"), (None, "r1"), ("", "l\U0001f600"), ("", "l￿"), ("", "r")]
    files = spark.createDataFrame(names, "dir string, name string")
    roles = F.col("name").startswith("l"), F.lit(True)
    a, b = ([n for n in names if n[0] is not None and n[1].startswith(c)] for c in "lr")
    want = sorted((d, x, y) for d, x in a for e, y in b if d == e)
    monkeypatch.setattr(batch, "CELL", 4)
    got = batch.cross_pairs(files, ["dir"], "name", *roles)
    assert sorted(map(tuple, got.collect())) == want
    per = [r["count"] for r in got.where("dir = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
    assert len(per) > 3 and max(per) < sum(per) / 2  # one task before
    plain = batch.volumes(got.withColumn("base", F.concat(F.lit("out/"), "dir")), ["dir"], ["left", "right"], 7, "base")
    quick = batch.cross_volumes(files.withColumn("base", F.concat(F.lit("out/"), "dir")), ["dir", "base"], "name", *roles, 7, "base")
    assert sorted(map(str, quick.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_paragraphs_are_handed_over_in_small_frames(spark):
    pages = spark.range(1000).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("<p>a</p><p>b</p>").alias("html"))
    sizes = style.html_vectors(pages).select("doc_id").mapInPandas(lambda frames: frames, "doc_id long")
    assert sizes.count() == 2000
    import pandas as pd

    f = pd.DataFrame({"x": range(1000)})
    assert max(len(g) for g in style.few(iter([f]))) <= style.BATCH and pd.concat(style.few(iter([f]))).x.tolist() == list(range(1000))


def test_labels_by_rules_need_no_suffix_statistics(spark, monkeypatch):
    from tessera.llm import urls

    hosts = [f"{'www.' * (k % 2)}n{k}.{e}" for k in range(60) for e in ("net", "example.net", "example.com", "org", "a.example.org:80")]
    pages = spark.createDataFrame([(k, f"http://{h}/{p}/{k}") for k, (h, p) in enumerate((h, p) for h in hosts for p in ("en", "de", "fr"))], "page_id long, url string")
    labelled = urls.rule_labelled(pages)
    assert [s.count() for s in urls.statistics(labelled, urls.RULES)] == [0, 0]
    score = lambda model: {r["page_id"]: r["s"] for r in model.score(pages, "url", "s").collect()}
    assert score(urls.train(labelled)) == score(urls.train(labelled, by_rules=True))
    monkeypatch.setattr(urls, "statistics", None)  # the stage is not there
    assert urls.judged_pages(pages).count() == 900


def test_what_one_side_lacks_is_not_compared(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choices("abcdeÄ \n.", k=4000)) + "\U0001f600Σİ"
    thin = "".join(c for c in text if c not in "ae")
    want = [(i, j) for j, i in enumerate(i for i, c in enumerate(text) if c not in "ae")]
    o = NormOptions(ignore_newline=True)
    forms = [align.normal(t, o) for t in (text, text[:4000], "Xy " * 300)]
    monkeypatch.setattr(lcs, "_within", None)  # every element was looked at one by one before
    assert lcs.matches(text, thin) == want and lcs.matches(thin, text) == [(j, i) for i, j in want]
    assert lcs.length(text, thin) == lcs.length(thin, text) == lcs.length(list(text), list(thin)) == len(thin)
    assert forms == ["".join(align.normal_char(c, o) for c in t) for t in (text, text[:4000], "Xy " * 300)]
    for _ in range(300):
        a = "".join(rng.choices("ab", k=rng.randrange(50)))
        b = a[: rng.randrange(50)] + "c" * rng.randrange(2) + a[rng.randrange(50) :]
        p, s = lcs._affix(a, b)
        assert a[:p] == b[:p] and (p == min(len(a), len(b)) or a[p] != b[p]) and a[len(a) - s :] == b[len(b) - s :] and p + s <= min(len(a), len(b))


def test_both_views_in_one_pass(spark):
    pairs = spark.createDataFrame([(1, "a\nb", "a\n\nb"), (2, None, "x"), (3, "same", "same"), (4, "p q\nr", "pq\ns\nt")], "pair_id long, left string, right string")
    got = text_diff.both_views(pairs)
    o = NormOptions()
    want = text_diff.flow_stats(pairs, NormOptions(ignore_newline=True)).drop("skipped").join(text_diff.line_stats(pairs, o), "pair_id")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # two passes and a join before


def test_a_specification_is_compared_without_shuffles(spark):
    html = '<p style="font-size:12pt">a<b>b</b></p><p>a</p><p style="text-align:right">the a</p><p>a</p><table><tr><td>a</td></tr></table>'
    pages = spark.createDataFrame([(1, html), (2, "<p>a</p><br/><p>x</p>"), (3, ""), (4, None)], "doc_id long, html string")
    spec = {"defaults": {"size_pt": 10.0, "line_spacing": 1.5}, "rules": [{"match": {"i": 0}, "set": {"align": "center"}}, {"match": {"text_includes": "the"}, "set": {"indent_in": 0.29}}]}
    whole, found = style.html_vectors(pages), style.html_vectors(pages, fields=style.MEASURES)
    assert sorted(map(str, whole.drop("runs").collect())) == sorted(map(str, found.collect())) and found.count() == 7
    assert whole.select("doc_id", "i", "runs").where("i = 0 AND doc_id = 1").first()["runs"][1].asDict() == dict.fromkeys(("family", "latin", "italic", "sup", "sub", "underline", "color")) | {"text": "b", "size_pt": 12.0, "bold": True}
    met, want = style.against(found, spec), style.compared(whole, style.apply_spec(whole, spec))
    same = lambda f: [sorted(map(str, f(x).collect())) for x in (met, want)]
    for a, b in (same(style.style_diff), same(lambda x: style.style_summary(x, style.style_diff(x)))):
        assert a == b and a
    plan = style.style_diff(met)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Aggregate" not in plan  # vectors were read four times, grouped and joined


def test_markup_seen_before_is_not_worked_out_again(monkeypatch):
    from tessera.kernel import markup

    page = '<html><body><p>no</p><div id="content"><p style="font-size:{0}pt">a<b>{0}</b>\t<a href="/{0}">x</a></p><p>{0}</p></div></body></html>'
    first = [markup.html_rows(page.format(k), "content") for k in (7, 8)]
    assert [r[:2] for r in first[0]] == [("p", "a7 x"), ("p", "7")] and first[1][0][6] == 8.0
    monkeypatch.setattr(markup, "styled", None)  # it was called for every tag of every page
    monkeypatch.setattr(markup, "block", None)
    again = [markup.html_rows(page.format(k), "content") for k in (7, 8)]
    assert again == first
    monkeypatch.undo()
    monkeypatch.setattr(markup, "MOST_KEPT", 3)  # what is kept is bounded
    assert [markup.html_rows(page.format(k), "content") for k in (7, 8, 9)][:2] == first and len(markup._tokens) < 20


def test_a_text_is_cut_once_for_all_differences(spark):
    pages = spark.createDataFrame([(1, f"<p>{'word  ' * 20}</p><p>a</p>")], "doc_id long, html string")
    found = style.html_vectors(pages, fields=style.MEASURES)
    diffs = style.style_diff(style.against(found, {"rules": [{"match": {"i": 0}, "set": {"size_pt": 9.0, "align": "left", "line_spacing": 2.0}}]}))
    assert [(r["para"], r["text"]) for r in diffs.collect()] == [(0, ("word " * 20)[:34] + "…")] * 3
    lines = diffs._jdf.queryExecution().optimizedPlan().toString().split("\n")
    made = next(n for n, line in enumerate(lines) if "Generate" in line)
    assert "regexp_replace(_extract_text" not in "".join(lines[:made])  # it was cut behind the listing, once for each difference


def test_tasks_follow_the_pages(spark, tmp_path, monkeypatch):
    from tessera import catalog

    spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("<p>a</p>").alias("html")).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(catalog, "PAGES_A_TASK", 10)
    got = catalog.page_vectors(spark, str(tmp_path))
    assert got.count() == 400 and "hashpartitioning(doc_id" in (plan := got._jdf.queryExecution().toString()) and ", 40)" in plan  # 16 tasks before, however many pages


def test_texts_of_a_page_leave_together(spark, sf_dir, monkeypatch):
    from tessera import catalog_views

    made = [(1, "<p>a</p><p> b<br>c </p>"), (2, "<p><b> </b><i> x</i> &amp; y&#1;</p><p> \xa0</p>z"), (3, ""), (4, None), (5, "<p>x > y</p><p>a < b</p>"), (6, "<p>1</p><p>2"), (7, "<p></p><p>2")]
    pages = spark.createDataFrame(made, "doc_id long, html string")
    want = style.vectors_text(style.html_vectors(pages))
    for most in (4096, 0):
        monkeypatch.setattr(style, "MOST", most)
        monkeypatch.setattr(style, "BATCH", 2)
        assert sorted(map(str, style.joined_texts(style.html_texts(pages)).collect())) == sorted(map(str, want.collect())) and want.count() == 5
    twice = style.joined_texts(style.html_texts(pages.where("doc_id < 2").union(pages.where("doc_id = 6").withColumn("doc_id", F.lit(1)))))
    assert sorted(r["text"] for r in twice.collect()) == ["1\n\n2", "a\n\nb\nc"]
    plan = catalog_views.styled_texts(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan  # paragraphs were grouped by document again


def test_tags_seen_before_are_not_read_again(monkeypatch):
    from tessera.kernel import markup

    page = '<div id="content"><p style="font-size:{0}pt">{1}<b>{2}</b><br></p><p>{3}</p></div>'
    first = markup.html_texts(page.format(7, "a", "b", "c"), "content")
    odd = [page.format(7, *t) for t in (("x>y", "", "<"), ("<p", "q>", ""), ("\0", "<", ">"), (">", "<p>", "<"))]
    want = [markup.html_texts(t, "content") for t in odd]
    monkeypatch.setattr(markup, "_shapes", {})
    assert [markup.html_texts(t, "content") for t in odd] == want
    markup.html_rows(page.format(7, "a", "b", "c"), "content")
    assert [markup.html_texts(t, "content") for t in odd] == want
    monkeypatch.setattr(markup, "_plain", None)  # every tag of every page was looked up
    assert first == ["ab", "c"] and markup.html_texts(page.format(7, " \xa0", " d  e", ""), "content") == ["d e"]
    assert [r[:2] for r in markup.html_rows(page.format(7, "&lt;", " ", "f "), "content")] == [("p", "<"), ("p", "f")]
    monkeypatch.undo()
    monkeypatch.setattr(markup, "MOST_SHAPES", 300)  # what is kept is bounded
    for size in range(40):
        markup.html_texts(page.format(size, "a", "b", "c"), "content")
    assert sum(map(len, markup._shapes)) <= 300


def test_lines_are_found_without_grouping(spark, sf_dir):
    from tessera import catalog_views

    made = [(1, "<p>a</p><p>key 1</p><p>key 2</p>"), (2, "<p>a</p>"), (3, "<p>b</p><p> <i>k</i></p><p>key 3</p>"), (4, ""), (5, None), (6, "<p>key 6</p>")]
    pages = spark.createDataFrame(made, "doc_id long, html string")
    texts, vectors = style.html_texts(pages), style.html_vectors(pages)
    for prefix in ("key ", "k", "", "none", None):
        want = style.jump_line(vectors, F.lit(prefix).cast("string"))
        got = style.jump_text(texts, F.lit(prefix).cast("string"))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.dtypes == want.dtypes
    assert sorted(map(tuple, style.jump_text(texts, F.lit("key ")).collect())) == [(1, 1), (3, 1), (6, 0)]
    plan = catalog_views.jump_paragraphs(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan  # paragraphs were grouped by document again


def test_anchors_of_large_pairs_are_counted(spark, tmp_path):
    from tessera import catalog

    rng = random.Random(9)
    long = "".join(rng.choices("abcd efgh\n", k=9000))  # 81 million pairs of characters, beyond the limit
    thin = long.replace("a", "")
    spark.createDataFrame([(1, "en", long), (2, "en", thin), (3, "en", "")], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["pair_id"], r["level"]): r["n"] for r in catalog.anchors_coverage(spark, str(tmp_path)).collect()}
    assert got[1, "char"] == len(thin) > 7100 and set(got) == {(1, "line"), (1, "char")}  # there was no row for characters
    for o in (NormOptions(), NormOptions(ignore_case=True), NormOptions(ignore_case=True, ignore_newline=True)):
        for a, b in (("İx\r\nΣa", "i̇x\nσA"), ("İ", "İ"), (long, thin), ("", "x")):
            lines, coverage = align.line_anchors(a, b, o)
            assert align.anchor_counts(a, b, o) == (len(lines), coverage, len(align.char_anchors(a, b, o, limit=None)))


def by_similarity(left, right):
    """Every pair measured, all held and sorted."""
    free_l, free_r, out = set(range(len(left))), set(range(len(right))), []
    for s, p, q in sorted((-align.similarity(x, y), p, q) for p, x in enumerate(left) for q, y in enumerate(right)):
        if -s >= align.LEAST_SIMILARITY and p in free_l and q in free_r:
            out.append((p, q))
            free_l.remove(p), free_r.remove(q)
    return out


def test_lines_are_paired_whatever_is_held(monkeypatch):
    rng = random.Random(7)
    line = lambda: "".join(rng.choices("abé \tC", k=rng.randrange(9)))
    for held in (1, 40, 1 << 21):
        monkeypatch.setattr(align, "HELD_CELLS", held)  # all pairs of a region were held
        for n, m in ((40, 30), (30, 40), (1, 50), (50, 1), (33, 33)):
            left, right = [line() for _ in range(n)], [line() for _ in range(m)]
            assert list(align.most_similar(left, right)) == by_similarity(left, right)


def test_changed_regions_of_any_size_are_paired(spark, tmp_path):
    from tessera import catalog

    rng = random.Random(8)
    words = lambda: " ".join(str(rng.randrange(10**6)) for _ in range(4))
    left = [words() for _ in range(40)]
    right = [f"{x}!" for x in left[::-1]]
    docs = [(1, "en", "\n".join(left)), (2, "en", "\n".join(right)), (3, "fr", "\n".join("abcdefgh")), (4, "fr", "\n".join("123456789"))]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.text_diff_rows(spark, str(tmp_path)).collect()
    pairs = {(r["li"], r["ri"]) for r in got if r["pair_id"] == 1 and r["type"] == "change"}
    assert pairs == set(by_similarity(left, right)) == {(k, 39 - k) for k in range(40)}  # all were removed and added
    assert sorted((r["type"], r["li"], r["ri"]) for r in got if r["pair_id"] == 3) == [("add", -1, 8), *[("change", k, k) for k in range(8)]]
