"""Kernels without Spark: sequences, alignment, markup, workbooks, images."""

from __future__ import annotations

import io
import random
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.kernel import align, image, lcs, markup, ooxml
from tessera.options import NormOptions as O


def table_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


WORDS = st.lists(st.sampled_from("abcd"), max_size=14)


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_script_rebuilds_both_sides(a, b):
    n = lcs.length(a, b)
    assert n == table_length(a, b) == lcs.length(b, a) == len(lcs.matches(a, b))
    left, right = [], []
    for op, i, j, k in lcs.script(a, b):
        if op != "added":
            left += a[i : i + k]
        if op != "removed":
            right += b[j : j + k]
    assert left == a and right == b
    assert lcs.script(a, a) == ([("equal", 0, 0, len(a))] if a else [])


TEXT = st.text(alphabet="aB \n（Ａ，。\t\r", max_size=30)


@settings(max_examples=200, deadline=None)
@given(TEXT, TEXT, st.booleans(), st.booleans(), st.booleans())
def test_grid_accounts_for_all_lines(a, b, case, white, punct):
    o = O(ignore_case=case, ignore_whitespace=white, ignore_punct=punct)
    rows = align.grid(a, b, o)
    n, m = len(align.split_lines(a)), len(align.split_lines(b))
    assert sorted(r["li"] for r in rows if r["li"] >= 0) == list(range(n)) and sorted(r["ri"] for r in rows if r["ri"] >= 0) == list(range(m))
    for r in rows:
        if r["type"] == "change":
            assert "".join(s["text"] for s in r["seg_l"]) == r["left_text"] and "".join(s["text"] for s in r["seg_r"]) == r["right_text"]
        if r["type"] == "equal":
            assert align.normal(r["left_text"], o) == align.normal(r["right_text"], o)
    assert all(r["type"] == "equal" for r in align.grid(a, a, o))


def kinds(a, b, **o):
    out = {"equal": 0, "change": 0, "add": 0, "remove": 0}
    for r in align.grid(a, b, O(**o)):
        out[r["type"]] += 1
    return out


def test_lines_by_option():
    rows = align.grid("north\nsouth gate\nwest", "north\nsouth gates\nwest\neast", O())
    change = next(r for r in rows if r["type"] == "change")
    assert (change["li"], change["ri"]) == (1, 1) and change["seg_r"] == [{"text": "south gate", "cls": "eq"}, {"text": "s", "cls": "ad"}]
    assert [r["type"] for r in rows] == ["equal", "change", "equal", "add"]
    shout = ("River Bank\nOak", "RIVER bank\noak")
    assert kinds(*shout)["equal"] == 0 and kinds(*shout, ignore_case=True)["equal"] == 2
    gaps = ("two\t blanks", "twoblanks")
    assert kinds(*gaps)["change"] == 1 and kinds(*gaps, ignore_whitespace=True)["equal"] == 1
    assert kinds("ｋｍ／ｈ　７", "km/h 7")["equal"] == 1
    marks = ("well, then (maybe)", "well then maybe!")
    assert kinds(*marks)["change"] == 1 and kinds(*marks, ignore_punct=True)["equal"] == 1
    assert kinds("p\r\nq\r\n", "p\nq\n")["equal"] == 3
    assert kinds("r\nr\nr\ns", "r\nr\nr\nt") == {"equal": 3, "change": 1, "add": 0, "remove": 0}
    assert kinds("m\nn", "")["remove"] == 2 and align.grid("", "", O()) == []


def test_flow_counts_are_those_of_the_flow():
    free = O(ignore_newline=True)
    rng = np.random.default_rng(8)
    for _ in range(60):
        a, b = ("".join(rng.choice(list("ab c\n"), rng.integers(0, 30))) for _ in range(2))
        flow, counts = align.flow(a, b, free), align.flow_counts(a, b, free)
        assert counts == {k: flow[k] for k in counts}
        kept = [sum(len(align.normal(s["text"], free)) for s in flow[side] if s["cls"] == "eq") for side in ("seg_l", "seg_r")]
        assert kept[0] == kept[1] == len(align.normal(a, free)) - counts["removed_chars"]
    assert align.flow_counts("one two\nthree", "one\ntwo three", free)["removed_chars"] == 0
    assert align.flow_counts("abcde", "xabye", free) == {"skipped": False, "removed_chars": 2, "added_chars": 2}
    assert align.flow_counts("abcde", "ab", free, limit=9)["skipped"] and not align.flow_counts("abcde", "ab", free, limit=None)["skipped"]


def test_grid_counts_are_those_of_the_grid():
    rng = np.random.default_rng(9)
    for _ in range(60):
        a, b = ("\n".join(rng.choice(["red", "red fox", "blue", "bluer", ""], rng.integers(1, 9))) for _ in range(2))
        want = kinds(a, b)
        assert align.grid_counts(a, b, O()) == {"equal": want["equal"], "modified": want["change"], "added": want["add"], "removed": want["remove"]}


def test_anchors_around_a_move():
    left = [f"stanza {k * k} of the long poem" for k in range(50)]
    right = [f"preface {k}" for k in range(6)] + left[:30] + left[33:]
    pairs, coverage = align.line_anchors("\n".join(left), "\n".join(right), O())
    assert pairs == [(k + 1, k + 7) for k in range(30)] + [(k + 1, k + 4) for k in range(33, 50)]
    assert coverage == 47 / 50
    assert align.char_anchors("xyz", "wxz", O()) == [(0, 1), (2, 2)]


def test_similarity_and_redline():
    assert align.similarity("Ab  c", "ab c") == 1 and align.similarity("", "x") == 0 and align.similarity("abcd", "abxd") == 3 / 5
    left, right = align.char_diff("abcd", "abXd", O())
    assert [s["text"] for s in align.redline(left, right)] == ["ab", "c", "X", "d"]
    assert align.offset_map("abc", "axbc") == [0, 2, 3, 4]
    assert align.align_paragraphs(["a", "b"], ["a", "c", "b"]) == [(0, 0), (1, 2)]


def test_declarations_and_measures():
    d = markup.declarations("line-height: 2 ; : 14pt; COLOR : #0f0")
    assert d["line-height"] == "2" and d["lost-size"] == "14pt" and markup.color(d["color"]) == "00FF00"
    assert [markup.points(v) for v in ("16px", "7.5pt", "large")] == [12, 7.5, None]
    assert [markup.inches(v) for v in ("36pt", "2.54cm", "25.4mm", "1em")] == [0.5, 1, 1, None]
    assert [markup.spacing(v) for v in ("120%", "2", "30pt")] == [1.2, 2, None]
    assert markup.families("Georgia, serif") == (None, "Georgia")
    assert markup.color("#12AbcD") == "12ABCD"


PAGE = """<html><body><div>menu</div><div id="content"><!-- <p>no</p> --><p align=center style="font-size:16pt;font-family:黑体">标题</p>
<p style="text-indent:0.29in;line-height:150%;:10pt">正文 <b>粗</b>H<sub>2</sub>O</p>loose<br>text<table><tr><td style="font-size:9pt">格</td><td> </td></tr></table>
<script>var x="<p>";</script></div><p>foot</p></body></html>"""


def test_html_paragraphs():
    got = markup.html_paragraphs(PAGE)
    assert [p["text"] for p in got] == ["标题", "正文 粗H2O", "loose\ntext", "格"]
    assert got[0]["align"] == "center" and got[0]["size_pt"] == 16 and got[0]["family"] == "黑体"
    assert got[1]["indent_in"] == 0.29 and got[1]["line_spacing"] == 1.5 and got[1]["size_pt"] == 10 and got[1]["bold_runs"] == 1 and got[1]["sub_chars"] == 1
    assert got[3]["kind"] == "table" and got[3]["align"] == "center" and got[3]["indent_in"] == 0 and got[3]["line_spacing"] == 1
    assert [p["text"] for p in markup.html_paragraphs("<p>a<p>b</p>c")] == ["a", "b", "c"]
    assert markup.html_paragraphs("") == []


def test_docx_paragraphs():
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    styles = f'<w:styles {ns}><w:style w:styleId="Normal"><w:rPr><w:sz w:val="20"/></w:rPr></w:style><w:style w:styleId="T"><w:basedOn w:val="Normal"/><w:pPr><w:jc w:val="center"/></w:pPr><w:rPr><w:b/></w:rPr></w:style></w:styles>'
    doc = f'<w:document {ns}><w:body><w:p><w:pPr><w:pStyle w:val="T"/></w:pPr><w:r><w:t>题</w:t></w:r></w:p><w:p><w:pPr><w:ind w:firstLineChars="200"/><w:spacing w:line="360"/></w:pPr><w:r><w:t>a</w:t></w:r><w:r><w:rPr><w:vertAlign w:val="subscript"/></w:rPr><w:t>2</w:t></w:r></w:p><w:p/></w:body></w:document>'
    a, b = markup.docx_paragraphs(doc, styles)
    assert a["align"] == "center" and a["size_pt"] == 10 and a["bold_runs"] == 1
    assert b["indent_chars"] == 2 and b["line_spacing"] == 1.5 and b["sub_chars"] == 1 and markup.docx_texts(doc) == ["题", "a2", ""]


def test_workbook_round_trip():
    data = ooxml.write({"表 1": (["批号", "a&b"], [["P001", "x<y"], ["P002", ""], ["", ""], ["P003", " z "]])})
    book = ooxml.Workbook(data)
    got = ooxml.extract(book.sheet("表 1"))
    assert book.sheet_names == ["表 1"] and got["headers"] == ["批号", "a&b"] and got["rows"] == [["P001", "x<y"], ["P002", ""], ["P003", " z "]] and got["row_numbers"] == [2, 3, 5]
    assert book.sheet("表 1").freeze == (1, 0) and book.sheet("表 1", max_rows=2).cells.keys() == {1, 2}
    assert "empty" in ooxml.head_error(b"", "x") and "cut short" in ooxml.head_error(b"PK", "x") and ooxml.head_error(b"abcd", "x")
    with pytest.raises(ValueError, match="not an Office"):
        ooxml.Workbook(b"<html>")


def test_cells_of_every_kind():
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} {r}><sheets><sheet name="S" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {m}><numFmts><numFmt numFmtId="170" formatCode="yyyy/m/d"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        cells = '<c r="A1" t="s"><v>0</v></c><c r="B1"><f>A1</f><v>197</v></c><c r="C1"><f>A1</f></c><c r="D1"><v>0.0</v></c><c r="E1" t="b"><v>1</v></c><c r="F1" s="1"><v>45413</v></c><c r="G1" s="1"><v>45413.5</v></c><c r="H1"><v>0.30000000000000004</v></c><c r="I1" t="e"><v>#N/A</v></c>'
        z.writestr("xl/worksheets/s.xml", f'<worksheet {m}><cols><col min="2" max="2" width="12" hidden="1"/></cols><sheetData><row r="1" ht="20">{cells}</row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>')
    s = ooxml.Workbook(out.getvalue()).sheet("S")
    assert list(s.cells[1].values()) == ["ab", "197", "=A1", "0", "TRUE", "2024-05-01", "2024-05-01 12:00", "0.3", "#N/A"]
    assert s.hidden == [2] and s.widths == {2: 12} and s.heights == {1: 20} and s.merges == ["A1:B1"]


def test_areas_and_headers():
    assert [ooxml.column_number(c) for c in ("A", "Z", "AA", "XFC")] == [1, 26, 27, 16383] and ooxml.column_letters(16383) == "XFC"
    area = ooxml.parse_area("生产数据!$A$2:$XFC$2025")
    assert (area["cols"], area["rows"]) == (16383, 2024)
    assert ooxml.narrowed("S!$A$2:$XFC$2025", "A1:D10") == "S!$A$2:$D$10" and ooxml.narrowed("x", "A1") == "x"
    assert ooxml.merged_headers([{1: "公共列", 2: "公共列"}, {1: "批号", 2: "批号"}], 3) == ["公共列 / 批号", "公共列 / 批号#2", "列3"]
    assert ooxml.guess_header([["公司报表", "", ""], ["批号", "数量", "日期"], ["P1", "1", "2024-05-01"], ["P2", "2", "2024-05-02"]]) == 2


def test_image_numerics():
    assert image.over_white(np.array([[[0, 0, 255, 128]]], np.uint8)).tolist() == [[[127, 127, 255]]]
    assert image.warped(np.zeros((20, 20, 3), np.uint8), [(0, 0), (10, 0), (10, 5), (0, 5)]).shape == (8, 10, 3)
    p = np.full((6, 5), 0.02)
    for t, k in enumerate([1, 2, 0, 3, 1, 4]):
        p[t, k] = 0.92
    text, conf = image.ctc(p, ["", "你", "好", "世", "界"])
    assert text == "你好世你界" and conf > 0.8
    mask = np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0], [1, 0, 0]], bool)
    assert image.labelled(mask)[1] == 2
    area, corners = image.least_rectangle([(0, 0), (2, 2), (0, 4), (-2, 2)])
    assert abs(area - 8) < 1e-9 and len(corners) == 4
    prob = np.zeros((40, 60))
    prob[10:16, 10:40] = 0.9
    (box,) = image.boxes(prob)
    assert box["score"] > 0.89 and box["box"][0]["x"] < 10 and box["box"][2]["y"] > 15


@pytest.mark.parametrize("c", [1, 3, 4])
def test_png_round_trip(c):
    img = np.random.default_rng(0).integers(0, 256, (17, 13, c)).astype(np.uint8)
    assert (image.decode_png(image.encode_png(img)) == img).all()


def test_png_filters():
    import struct
    import zlib

    rng, w, h, c = np.random.default_rng(1), 7, 10, 3
    img = rng.integers(0, 256, (h, w * c)).astype(int)
    rows, up = b"", np.zeros(w * c, int)
    for y in range(h):
        kind, left, corner = y % 5, np.r_[[0] * c, img[y][:-c]], np.r_[[0] * c, up[:-c]]
        paeth = [min((abs(b - d), 0, a), (abs(a - d), 1, b), (abs(a + b - 2 * d), 2, d))[2] for a, b, d in zip(left, up, corner, strict=True)]
        guess = [np.zeros(w * c, int), left, up, (left + up) // 2, np.array(paeth)][kind]
        rows += bytes([kind]) + ((img[y] - guess) & 255).astype(np.uint8).tobytes()
        up = img[y]
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + b"\0\0\0\0"
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows))
    assert (image.decode_png(data).reshape(h, -1) == img).all()


def test_seams_and_noise():
    img = np.full((120, 64, 3), 255, np.uint8)
    img[:20] = img[40:] = 0
    got = image.seams(image.ink(img), image.row_hashes(img))
    assert {"kind": "blank", "y0": 20, "y1": 40} in got and any(s["kind"] == "dup" for s in got)
    img[50:56, :, 0] = 255
    assert image.ratios(img)["worst_band"] > 40 > image.ratios(img)["colorful"]


def test_alignment_by_checkpoints_is_the_same(monkeypatch):
    rng = random.Random(5)
    for trial in range(60):
        a, b = ("".join(rng.choice("abcd" if trial % 2 else "ab") for _ in range(rng.randint(0, 90))) for _ in range(2))
        monkeypatch.setattr(lcs, "HELD", 32 << 20)
        want, n = lcs.matches(a, b), lcs.length(a, b)
        for held in (0, 20, 100, 300):
            monkeypatch.setattr(lcs, "HELD", held)
            assert lcs.matches(a, b) == want and lcs.length(a, b) == n == len(want)


def test_long_texts_align_in_bounded_memory():
    """Two texts of 10^5 characters: the exact script within 200 MB."""
    import tracemalloc

    rng = random.Random(6)
    a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(100_000))
    b = "".join(c for c in a if rng.random() > 0.02)
    tracemalloc.start()
    found = align.char_anchors(a, b, O(), limit=None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20 and len(found) == len(b) and all(a[i] == b[j] for i, j in found)
    assert align.char_anchors(a, b, O()) is None
    left, right = align.char_diff(a[:9000], b[:9000], O(), limit=None)
    assert "".join(s["text"] for s in left) == a[:9000] and {s["cls"] for s in right} <= {"eq", "ad"} and len(right) > 1


def test_limits_of_pairing_can_be_lifted():
    left, right = ([(i, f"line {i} of {w} side {i * 7919}") for i in range(40)] for w in ("one", "two"))
    assert align.pair_changed(left, right) == []
    assert align.pair_changed(left, right, most_cells=None) == [(i, i) for i in range(40)] or len(align.pair_changed(left, right, most_cells=None)) == 40
    assert align.pair_changed(left, right, most_rest=None) == [(i, i) for i in range(40)]


def test_large_workbook_in_bounded_memory(tmp_path):
    """A million rows are read as they come; a preview stops at once; only the asked column becomes text."""
    import subprocess
    import sys

    book = ooxml.write({"S": (["a", "b"], []), "T": (["t"], [["x"]])})
    path = tmp_path / "large.xlsx"
    with zipfile.ZipFile(io.BytesIO(book)) as old, zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as new:
        for name in old.namelist():
            if name != "xl/worksheets/sheet1.xml":
                new.writestr(name, old.read(name))
        with new.open("xl/worksheets/sheet1.xml", "w") as out:
            out.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            for k in range(1, 1_000_001, 1000):
                out.write("".join(f'<row r="{r}"><c r="A{r}"><v>{r}</v></c><c r="B{r}"><v>1</v></c></row>' for r in range(k, k + 1000)).encode())
            out.write(b"</sheetData></worksheet>")
    script = (
        "import resource, sys; from tessera.kernel import ooxml; before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; "
        "f = open(sys.argv[1], 'rb'); b = ooxml.Workbook(f); n = sum(1 for r, c in b.rows('S', columns={1}) if c == {1: str(r)}); "
        "p = list(b.rows('S', 3)); print(n, len(p), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)"
    )
    n, few, grown = map(int, subprocess.run([sys.executable, "-c", script, str(path)], capture_output=True, text=True, check=True, env={"PYTHONPATH": ":".join(sys.path)}).stdout.split())
    assert (n, few) == (1_000_000, 3) and grown < 60


def test_one_sheet_alone():
    source = ooxml.Workbook(ooxml.write({"S": (["a"], [["1"]]), "T & U": (["t"], [["x"], ["y"]])}))
    one = ooxml.Workbook(source.alone("T & U"))
    assert one.sheet_names == ["T & U"] and list(one.rows("T & U")) == list(source.rows("T & U")) and source.used("T & U") == "A1:A3"


def test_styles_are_merged_and_numbered_anew():
    style = {"font": "<font><i/></font>", "fill": '<fill><patternFill patternType="solid"/></fill>', "number": "0.0 \"x\"", "alignment": '<alignment wrapText="1"/>'}
    own = ooxml.Formats({1: 20.0}, [2], {1: 33.0}, (2, 1), {1: style, 2: {"number": "#14"}, 3: style})
    book = ooxml.write({"S": (["a", "b", "c"], [["1", "2", "3"]]), "T": (["a"], [])}, formats={"S": own})
    back = ooxml.Workbook(book).formats("S")
    assert back.hidden == [2] and back.heights == {1: 33.0} and back.freeze == (2, 1) and back.widths[1] == 20.0
    assert back.styles[1] == back.styles[3] == style and back.styles[2] == {"number": "#14"}
    assert ooxml.Formats.from_json(back.to_json()) == back
    again = ooxml.Workbook(ooxml.write({"S": (["x", "a"], [])}, formats={"S": back.mapped([None, 1])})).formats("S")
    assert again.styles[2] == style and again.widths[2] == 20.0 and again.styles[1] == ooxml.StyleTable.BOLD
    assert ooxml.Workbook(book).formats("T").styles == {1: ooxml.StyleTable.BOLD}


def test_plain_pages_need_no_parser(monkeypatch):
    from tessera.kernel import markup

    pieces = ["<p>", "</p>", "<b>", "</b>", '<div id="content">', "</div>", "<br>", '<script>var t="</p>";</script>', "<style>p{a}</style>", "<title>a &amp; b</title>", "<table>", "<td>", "</td>", "</table>", "a", "B &amp; c", " ", "<!DOCTYPE html>", '<span style="font-size:12px">', "</span>", '<P ALIGN="Center">']
    odd = ["<br/>", "<", "<a href=x>", "<textarea>", "</p >", "<script>", "<?pi?>", "<p style='text-align:right'>"]
    rng = random.Random(6)
    pages = ["".join(rng.choices(pieces + odd * (k % 2), k=rng.randrange(14))) for k in range(1500)]
    got = [markup.html_paragraphs(x, c) for x in pages for c in (None, "content")]
    feed = markup._Html.feed
    monkeypatch.setattr(markup, "_plain", lambda text: None)
    assert [markup.html_paragraphs(x, c) for x in pages for c in (None, "content")] == got
    monkeypatch.undo()
    monkeypatch.setattr(markup._Html, "feed", None)
    assert [markup.html_paragraphs(x) for x in pages[::2]] == got[::4] and feed  # every page went through the parser before
