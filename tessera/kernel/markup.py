"""Paragraph styles out of HTML and OOXML, read as a stream of events.

Every paragraph becomes a dict with its text, its own properties and its runs;
runs carry the character properties in force. Both readers end in
``paragraph``, so their results can be compared.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import escape, unescape
from html.parser import HTMLParser
from xml.etree import ElementTree

#: Names by which font families are told apart, sizes of <font size>, known alignments.
CJK = ("宋体", "黑体", "楷体", "仿宋", "等线", "微软雅黑", "雅黑", "新宋体", "方正", "华文", "幼圆", "隶书", "舒体", "行楷", "simsun", "simhei", "nsimsun", "fangsong", "kaiti")
LATIN = ("times", "arial", "calibri", "cambria", "verdana", "helvetica", "georgia", "courier", "tahoma", "segoe", "consolas")
GENERIC = ("serif", "sans-serif", "monospace")
FONT_SIZES = {"1": 8.0, "2": 10.0, "3": 12.0, "4": 14.0, "5": 18.0, "6": 22.0, "7": 24.0}
ALIGNMENTS = ("left", "center", "right", "justify")
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 div center blockquote li section article pre figure".split())
VOID = frozenset("br img hr input col meta link base".split())
UNREAD = frozenset("script style textarea noscript".split())
MARKS = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "u": "underline", "sup": "sup", "sub": "sub"}
STYLE_KEYS = ("family", "latin", "size_pt", "bold", "italic", "sup", "sub", "underline", "color")
BLANK_RUN = dict.fromkeys(STYLE_KEYS)

_GAP = re.compile("[ \t\r\n ]+")


def half_up(x: float, digits: int) -> float:
    scale = 10**digits
    return int((x * scale + 0.5) // 1) / scale


def points(v: str | None) -> float | None:
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*(pt|px)", (v or "").strip(), re.I)
    return half_up(float(m[1]) * (0.75 if m[2].lower() == "px" else 1), 2) if m else None


def inches(v: str | None) -> float | None:
    m = re.fullmatch(r"(-?\d+(?:\.\d+)?)\s*(in|pt|px|cm|mm)", (v or "").strip(), re.I)
    per = {"in": 1, "pt": 72, "px": 96, "cm": 2.54, "mm": 25.4}
    return half_up(float(m[1]) / per[m[2].lower()], 4) if m else None


def spacing(v: str | float | None) -> float | None:
    t = str(v if v is not None else "").strip().lower()
    if m := re.fullmatch(r"(\d+(?:\.\d+)?)\s*%", t):
        return half_up(float(m[1]) / 100, 3)
    m = re.match(r"[+-]?(\d+\.?\d*|\.\d+)", t)
    return half_up(float(m[0]), 3) if m and 0 < float(m[0]) <= 10 else None


def color(v: str | None) -> str | None:
    m = re.fullmatch(r"#?([0-9a-fA-F]{3}|[0-9a-fA-F]{6})", (v or "").strip())
    return (m[1] if m and len(m[1]) == 6 else "".join(c * 2 for c in m[1])).upper() if m else None


@lru_cache(4096)
def families(v: str | None) -> tuple[str | None, str | None]:
    """First CJK and first Latin family of a list (F34); unknown names stand in for a CJK one."""
    cjk = latin = None
    for part in (v or "").split(","):
        name = part.strip()
        name = name[1:] if name[:1] in "'\"" else name
        name = name[:-1] if name[-1:] in "'\"" else name
        low = name.lower()
        if any(h in low for h in CJK):
            cjk = cjk or name
        elif any(h in low for h in LATIN):
            latin = latin or name
        elif name and low not in GENERIC:
            cjk = cjk or name
    return cjk, latin


@lru_cache(4096)
def declarations(style: str | None) -> dict[str, str]:
    """Inline declarations (F35); a size whose key got lost counts, as does ``l=`` for the line height."""
    out: dict[str, str] = {}
    for part in (style or "").split(";"):
        key, colon, value = part.partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon or not value:
            continue
        if key:
            out["line-height" if key == "l=" else key] = value
        elif points(value) is not None:
            out["lost-size"] = value
    return out


def styled(run: dict, tag: str, attrs: dict[str, str]) -> dict:
    """Character properties inside the tag (V3)."""
    if not attrs and tag not in MARKS:
        return run
    out = dict(run)
    if tag in MARKS:
        out[MARKS[tag]] = True

    def name(value: str | None) -> None:
        cjk, latin = families(value)
        out["family"], out["latin"] = cjk or out["family"], latin or out["latin"]

    if tag == "font":
        name(attrs.get("face"))
        out["color"] = color(attrs.get("color")) or out["color"]
        out["size_pt"] = FONT_SIZES.get((attrs.get("s") or attrs.get("size") or "").strip(), out["size_pt"])
    for key, value in declarations(attrs.get("style")).items():
        low = value.lower()
        if key == "font-family":
            name(value)
        elif key in ("font-size", "lost-size"):
            out["size_pt"] = points(value) if points(value) is not None else out["size_pt"]
        elif key == "font-weight":
            out["bold"] = low in ("bold", "bolder") or (low.isdigit() and int(low) >= 600)
        elif key == "font-style":
            out["italic"] = low in ("italic", "oblique")
        elif key == "color":
            out["color"] = color(value) or out["color"]
        elif key == "text-decoration":
            out["underline"] = "underline" in low
    return out


def block(above: dict, tag: str, attrs: dict[str, str]) -> dict:
    """Paragraph properties of a block, its own or those around it."""
    d = declarations(attrs.get("style"))
    align = d.get("text-align") or (attrs.get("align") or "").lower()
    align = "center" if tag == "center" else align if align in ALIGNMENTS else above["align"]
    return {
        "align": align,
        "indent_in": inches(d["text-indent"]) if "text-indent" in d else above["indent_in"],
        "indent_chars": None,
        "line_spacing": spacing(d.get("line-height", above["line_spacing"])),
    }


NO_BLOCK = {"align": None, "indent_in": None, "indent_chars": None, "line_spacing": None}
CELL = {"align": "center", "indent_in": 0.0, "indent_chars": None, "line_spacing": 1.0}


def merged(runs: list[dict]) -> list[dict]:
    """Neighbours of equal style as one, blank ends gone (V4)."""
    out: list[dict] = []
    for r in runs:
        same = out and [out[-1][k] or None for k in STYLE_KEYS] == [r[k] or None for k in STYLE_KEYS]
        if same:
            out[-1]["text"] += r["text"]
        elif r["text"]:
            out.append(dict(r))
    while out and not out[0]["text"].strip():
        out.pop(0)
    while out and not out[-1]["text"].strip():
        out.pop()
    if out:
        out[0]["text"] = out[0]["text"].lstrip("  ")
        out[-1]["text"] = out[-1]["text"].rstrip("  ")
    return [r for r in out if r["text"]]


def heaviest(runs: list[dict], key: str):
    """The value most characters have; of ties the one that got there first."""
    tally: dict = {}
    best, most = None, -1
    for r in runs:
        if r[key] is not None:
            tally[r[key]] = tally.get(r[key], 0) + len(r["text"])
            if tally[r[key]] > most:
                best, most = r[key], tally[r[key]]
    return best


def paragraph(kind: str, runs: list[dict], props: dict) -> dict | None:
    """The style of one paragraph (X18); None if it has no text."""
    runs = merged(runs)
    text = "".join(r["text"] for r in runs)
    if not text.strip():
        return None
    return {
        "kind": kind,
        "text": text,
        **props,
        **{k: heaviest(runs, k) for k in ("size_pt", "family", "latin")},
        "bold_runs": sum(bool(r["bold"]) for r in runs),
        "italic_runs": sum(bool(r["italic"]) for r in runs),
        "sup_chars": sum(len(r["text"]) for r in runs if r["sup"]),
        "sub_chars": sum(len(r["text"]) for r in runs if r["sub"]),
        "runs": runs,
    }


class _Html(HTMLParser):
    """Frames of open tags, each with the run and block properties in force."""

    def __init__(self, container: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.container = container
        self.frames: list[dict] = [{"tag": "", "run": BLANK_RUN, "block": NO_BLOCK, "inside": container is None, "cell": False, "table": False, "unread": False}]
        self.loose: list[dict] = []
        self.out: list[dict] = []
        self.found = container is None

    def flush(self) -> None:
        if not self.loose:
            return
        top = self.frames[-1]
        made = paragraph("table" if top["cell"] else "p", self.loose, CELL if top["cell"] else top["block"])
        if made:
            self.out.append(made)
        self.loose = []

    def handle_starttag(self, tag: str, pairs: list) -> None:
        attrs = {k: v or "" for k, v in reversed(pairs)}
        top = self.frames[-1]
        if tag == "br":
            if top["inside"] and not top["unread"]:
                self.loose.append({**top["run"], "text": "\n"})
            return
        if tag in VOID:
            return
        opens = not top["inside"] and not self.found and attrs.get("id") == self.container
        cell = top["cell"] or tag in ("td", "th")
        breaks = (tag in BLOCKS and not top["cell"]) or tag in ("table", "td", "th")
        if breaks and top["inside"]:
            self.flush()
        self.found |= opens
        self.frames.append(
            {
                "tag": tag,
                "run": styled(top["run"], tag, attrs) if top["inside"] else BLANK_RUN,
                "block": block(top["block"], tag, attrs) if breaks and tag in BLOCKS and top["inside"] else top["block"],
                "inside": top["inside"] or opens,
                "cell": cell,
                "table": top["table"] or tag == "table",
                "unread": top["unread"] or tag in UNREAD,
            }
        )

    def handle_endtag(self, tag: str) -> None:
        last = len(self.frames) - 1
        at = last if last and self.frames[last]["tag"] == tag else next((i for i in range(last, 0, -1) if self.frames[i]["tag"] == tag), 0)
        while at and len(self.frames) > at:
            top = self.frames[-1]
            if top["inside"] and ((top["tag"] in BLOCKS and not top["cell"]) or top["tag"] in ("table", "td", "th") or not self.frames[-2]["inside"]):
                self.flush()
            self.frames.pop()

    def handle_data(self, data: str) -> None:
        top = self.frames[-1]
        text = _GAP.sub(" ", data)
        # between the cells of a table nothing is text
        if text and top["inside"] and not top["unread"] and (top["cell"] or not top["table"]):
            self.loose.append({**top["run"], "text": text})


#: What most pages are made of, told without a parser: text, start tags with attributes in double quotes, end tags, scripts and styles whole.
_ATTRIBUTE = re.compile(r"""\s+([a-zA-Z][a-zA-Z-]*)="([^"<>&]*)\"""")
_TOKEN = re.compile(
    r"""[^<]+|<(?=script|style)(?:(?:script(?:\s+[a-zA-Z][a-zA-Z-]*="[^"<>&]*")*>(?:(?!</\s*(?:script|style)|<!|\Z)[\s\S])*</script>)"""
    r"""|(?:style(?:\s+[a-zA-Z][a-zA-Z-]*="[^"<>&]*")*>(?:(?!</\s*(?:script|style)|<!|\Z)[\s\S])*</style>))"""
    r"""|<[a-zA-Z][a-zA-Z0-9]*(?:\s+[a-zA-Z][a-zA-Z-]*="[^"<>&]*")*>|</[a-zA-Z][a-zA-Z0-9]*>|<!(?:doctype|DOCTYPE) html>"""
)
_NAME = re.compile("[a-zA-Z0-9]+")
_RAW = frozenset("script style title textarea xmp iframe noembed noframes plaintext".split())
#: Attributes that the readers look at.
_READ = ("id", "style", "align", "face", "color", "s", "size")
#: Tags and frames kept for the pages to come, and how long a remembered tag may be.
MOST_KEPT, LONGEST_KEPT = 4096, 200
#: How many characters the tags of remembered pages may have, in all and of one page.
MOST_SHAPES, LONGEST_SHAPE = 400_000, 4000


class _Tag:
    """A start or end tag; tags that the readers can't tell apart are one object."""

    __slots__ = ("attrs", "ends", "name", "raw")

    def __init__(self, name: str, attrs: dict[str, str], ends: bool, raw: bool) -> None:
        self.name, self.attrs, self.ends, self.raw = name, attrs, ends, raw


class _Frame:
    """An open tag with the run and block properties in force, and what start tags inside it lead to."""

    __slots__ = ("block", "cell", "inside", "kids", "late", "name", "props", "run", "shuts", "style", "table", "takes", "unread")

    def __init__(self, name: str, run: dict, style: tuple, block: dict, inside: bool, cell: bool, table: bool, unread: bool, under: bool) -> None:
        self.name, self.run, self.style, self.block, self.inside, self.cell, self.table, self.unread = name, run, style, block, inside, cell, table, unread
        self.takes = inside and not unread and (cell or not table)
        self.shuts = inside and ((name in BLOCKS and not cell) or name in ("table", "td", "th") or not under)
        self.props = ("table", *CELL.values()) if cell else ("p", *(block[k] for k in NO_BLOCK))
        self.kids: dict[_Tag, tuple] = {}
        self.late: dict[_Tag, tuple] = self.kids if inside else {}  # the same once the container was found


_tokens: dict[str, _Tag] = {}
_tags: dict[tuple, _Tag] = {}
_roots: dict[str | None, _Frame] = {}
_made = [0]
#: For the tags of a page, which of its parts make a paragraph: by container, None where there is none.
_shapes: dict[str, dict[str | None, list[tuple[tuple, list[tuple], list]] | None]] = {}
_shaped = [0]


def _tag(token: str) -> _Tag | None:
    """The tag of a token; None for a document type."""
    if token[1] == "!":
        return None
    ends = token[1] == "/"
    name = _NAME.match(token, 1 + ends)[0].lower()
    raw = not ends and name in ("script", "style") and token[-1 - len(name) - 2 :] == f"</{name}>"
    held = {} if ends else {k.lower(): v for k, v in reversed(_ATTRIBUTE.findall(token[: token.index(">")]))}
    key = (name, ends, raw, *(held.get(k) for k in _READ))
    tag = _tags.get(key)
    if tag is None:
        tag = _tags[key] = _Tag(name, {k: held[k] for k in _READ if k in held}, ends, raw)
    if len(token) <= LONGEST_KEPT:
        _tokens[token] = tag
    return tag


def _plain(tokens: list[str]) -> list[str | _Tag | None] | None:
    """The texts and tags that tokens stand for, as ``HTMLParser`` has them; None if there is anything else."""
    if len(_tokens) + len(_tags) + _made[0] > MOST_KEPT:
        _tokens.clear(), _tags.clear(), _roots.clear()
        _made[0] = 0
    out: list[str | _Tag | None] = []
    for n, token in enumerate(tokens):
        if token[:1] != "<":
            out.append(token)
            continue
        tag = _tokens.get(token) or _tag(token)
        if tag is not None and tag.name in _RAW and not tag.ends and not tag.raw:
            behind = tokens[n + 1 : n + 3]
            if tag.name != "title" or "</title>" not in (behind if behind and behind[0][:1] != "<" else behind[:1]):
                return None
        out.append(tag)
    return out


def _shape(page: str) -> tuple[list[str], list[str | _Tag | None] | None, dict] | None:
    """A plain page in parts, the same read unless its tags were met before, and what is known of pages with them; None if it is not plain.

    Which texts make a paragraph, and in what style, is told by the tags alone.
    """
    parts = [] if "<script" in page or "<style" in page else page.replace("<", "\0<").replace(">", ">\0").split("\0")  # a script is one token
    tags = "".join(parts[1::2])
    known = _shapes.get(tags)
    # as many parts as the tags call for: all brackets are theirs, so texts hold none
    if known is not None and len(parts) == 2 * tags.count("<") + 1:
        return parts, None, known
    tokens = _TOKEN.findall(page)
    if sum(map(len, tokens)) != len(page):
        return None
    alike = len(parts) > 1 and all(p[:1] == "<" for p in parts[1::2]) and tokens == [p for p in parts if p]  # not so with brackets in texts
    parts = parts if alike else tokens
    read = _plain(parts)
    if read is None:
        return None
    if not alike or len(tags) > LONGEST_SHAPE:
        return parts, read, {}
    if _shaped[0] + len(tags) > MOST_SHAPES:
        _shapes.clear()
        _shaped[0] = 0
    _shaped[0] += len(tags)
    known = _shapes[tags] = {}
    return parts, read, known


def _style(run: dict) -> tuple[tuple, tuple]:
    """The values of a run, and what tells it from its neighbours."""
    values = tuple(run[k] for k in STYLE_KEYS)
    return values, tuple(v or None for v in values)


def _step(top: _Frame, tag: _Tag, found: bool, container: str | None) -> tuple[bool, _Frame | None, bool]:
    """What a start tag does inside a frame: if it ends a paragraph, the frame it opens, if that is the container."""
    name, attrs = tag.name, tag.attrs
    if name in VOID:
        return False, None, False
    opens = not top.inside and not found and attrs.get("id") == container
    breaks = (name in BLOCKS and not top.cell) or name in ("table", "td", "th")
    run = styled(top.run, name, attrs) if top.inside else BLANK_RUN
    _made[0] += 1
    child = _Frame(
        name,
        run,
        top.style if run is top.run else _style(run),
        block(top.block, name, attrs) if breaks and name in BLOCKS and top.inside else top.block,
        top.inside or opens,
        top.cell or name in ("td", "th"),
        top.table or name == "table",
        top.unread or name in UNREAD,
        top.inside,
    )
    return breaks and top.inside, child, opens


def _row(props: tuple, loose: list[tuple]) -> tuple | None:
    """What ``paragraph`` makes, as a tuple: kind, text, own properties, measures of the runs, and the runs as values and text."""
    if len(loose) > 1:
        joined: list[tuple[tuple, list[str]]] = []
        for style, text in loose:
            if joined and (joined[-1][0] is style or joined[-1][0][1] == style[1]):
                joined[-1][1].append(text)
            else:
                joined.append((style, [text]))
        runs = [(style[0], "".join(texts)) for style, texts in joined]
        first, last = 0, len(runs)
        while first < last and not runs[first][1].strip():
            first += 1
        while first < last and not runs[last - 1][1].strip():
            last -= 1
        runs = runs[first:last]
    else:
        runs = [(loose[0][0][0], loose[0][1])] if loose[0][1].strip() else []
    if not runs:
        return None
    runs[0] = (runs[0][0], runs[0][1].lstrip("  "))
    runs[-1] = (runs[-1][0], runs[-1][1].rstrip("  "))
    kind, align, indent_in, indent_chars, line_spacing = props
    if len(runs) == 1:
        (family, latin, size_pt, bold, italic, sup, sub, _, _), text = runs[0]
        return kind, text, align, indent_in, indent_chars, line_spacing, size_pt, family, latin, int(bool(bold)), int(bool(italic)), len(text) if sup else 0, len(text) if sub else 0, runs
    most = []
    for k in (2, 0, 1):
        tally: dict = {}
        best, top = None, -1
        for values, text in runs:
            v = values[k]
            if v is not None:
                n = tally[v] = tally.get(v, 0) + len(text)
                if n > top:
                    best, top = v, n
        most.append(best)
    marks = [sum(bool(v[3]) for v, _ in runs), sum(bool(v[4]) for v, _ in runs), sum(len(t) for v, t in runs if v[5]), sum(len(t) for v, t in runs if v[6])]
    return kind, "".join(t for _, t in runs), align, indent_in, indent_chars, line_spacing, *most, *marks, runs


def _groups(parts: list[str | _Tag | None], container: str | None) -> list[tuple[tuple, list[tuple], list]] | None:
    """Paragraphs of a plain page as ``_Html`` parts them: properties, texts as style and place, places alone; a line break has none.

    None if there is no container. Frames are made once for each way of tags
    into a page, so what was worked out for a page holds for others of the same markup.
    """
    top = _roots.get(container)
    if top is None:
        top = _roots[container] = _Frame("", BLANK_RUN, _style(BLANK_RUN), NO_BLOCK, container is None, False, False, False, True)
    frames, found, out = [top], container is None, []
    loose: list[tuple] = []

    def shut(at: int) -> None:
        while len(frames) > at:
            last = frames.pop()
            if loose and last.shuts:
                flush(last)

    def flush(frame: _Frame) -> None:
        out.append((frame.props, loose.copy(), [n for _, n in loose]))
        loose.clear()

    for n, part in enumerate(parts):
        if part is None:
            continue
        if part.__class__ is str:
            if top.takes:
                loose.append((top.style, n))
        elif not part.ends:
            if part.name == "br":
                if top.inside and not top.unread:
                    loose.append((top.style, None))
                continue
            kids = top.late if found else top.kids
            step = kids.get(part)
            if step is None:
                step = kids[part] = _step(top, part, found, container)
            breaks, child, opens = step
            if breaks and loose:
                flush(top)
            if child is not None:
                found = found or opens
                frames.append(child)
                top = child
                if part.raw:  # what it holds is not read
                    shut(len(frames) - 1)
                    top = frames[-1]
        elif top.name == part.name:
            frames.pop()
            if loose and top.shuts:
                flush(top)
            top = frames[-1]
        else:
            at = next((k for k in range(len(frames) - 1, 0, -1) if frames[k].name == part.name), 0)
            if at:
                shut(at)
                top = frames[-1]
    if not found:
        return None
    shut(1)
    if loose:
        flush(frames[0])
    return out


def _odd(text: str) -> bool:
    """If a text of markup is not yet what is read."""
    return "&" in text or "  " in text or "\n" in text or "\t" in text or "\r" in text or " " in text


def _filled(parts: list[str], paragraph: tuple) -> tuple | None:
    """The row of a paragraph whose texts are in the parts."""
    props, group, _ = paragraph
    loose = []
    for style, n in group:
        if n is None:
            loose.append((style, "\n"))
        elif text := _GAP.sub(" ", unescape(parts[n])) if _odd(parts[n]) else parts[n]:
            loose.append((style, text))
    return _row(props, loose) if loose else None


ROW = ("kind", "text", *NO_BLOCK, "size_pt", "family", "latin", "bold_runs", "italic_runs", "sup_chars", "sub_chars", "runs")


def row(p: dict) -> tuple:
    """A paragraph as a tuple, its runs as values and text."""
    return *(p[k] for k in ROW[:-1]), [(tuple(r.get(k) for k in STYLE_KEYS), r["text"]) for r in p["runs"]]


def _paragraphs(markup: str, container: str | None, made) -> list:
    """Paragraphs of a page or of the element with the id, else of ``content``, else of all (V2), made of the parts of a page."""
    clean = markup or ""
    if "<!" in clean:
        clean = re.sub(r"<!\[CDATA\[.*?(?:\]\]>|\Z)", "", re.sub(r"<!--.*?(?:-->|\Z)", "", clean, flags=re.S), flags=re.S)
    shape = _shape(clean)
    for wanted in dict.fromkeys([container, "content", None]):
        if wanted is None and container is None and "content" in clean and re.search(r"""\bid\s*=\s*["']?content["'\s>]""", clean):
            continue
        if shape is not None:
            parts, read, known = shape
            if wanted not in known:
                known[wanted] = _groups(read or _plain(parts), wanted)
            if known[wanted] is not None:
                return [p for paragraph in known[wanted] if (p := made(parts, paragraph))]
            continue
        reader = _Html(wanted)
        reader.feed(clean)
        reader.close()
        if reader.found:
            while len(reader.frames) > 1:
                reader.handle_endtag(reader.frames[-1]["tag"])
            reader.flush()
            return [row(p) if made is _filled else p["text"] for p in reader.out]
    return []


def html_rows(markup: str, container: str | None = None) -> list[tuple]:
    """Paragraphs of a page as tuples of ``ROW``."""
    return _paragraphs(markup, container, _filled)


def _text(parts: list[str], paragraph: tuple) -> str | None:
    """The text of a paragraph; styles matter only where blanks go from its ends."""
    places = paragraph[2]
    if None not in places:
        text = "".join([parts[n] for n in places])
        if not _odd(text) and text.strip() == text:
            return text
    made = _filled(parts, paragraph)
    return made and made[1]


def html_texts(markup: str, container: str | None = None) -> list[str]:
    """Texts of the paragraphs that ``html_rows`` tells."""
    return _paragraphs(markup, container, _text)


def html_paragraphs(markup: str, container: str | None = None) -> list[dict]:
    """``html_rows`` as numbered dicts."""
    out = [{"i": i, **dict(zip(ROW, r, strict=True))} for i, r in enumerate(html_rows(markup, container))]
    return [p | {"runs": [dict(zip(STYLE_KEYS, values, strict=True), text=text) for values, text in p["runs"]]} for p in out]


class _Spans(HTMLParser):
    """Places of the elements that are open when the wanted one starts, and where it ends.

    Unclosed elements end where an element around them does; a block, a list
    item or a cell ends an open paragraph, item or cell before it.
    """

    ENDS = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
    WALLS = {"ul", "ol", "dl", "table", "select", "body", "html"}

    def __init__(self, text: str, wanted) -> None:
        super().__init__(convert_charrefs=False)
        self.wanted, self.size = wanted, len(text)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.open: list[tuple[str, int, int]] = []  # tag, start and end of the start tag
        self.path: list[tuple[str, int, int]] | None = None
        self.end: int | None = None
        self.body: tuple[int, int] | None = None

    def here(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def shut(self, depth: int, at: int) -> None:
        if self.path is not None and self.end is None and depth < len(self.path):
            self.end = at
        del self.open[depth:]

    def handle_starttag(self, tag: str, pairs: list) -> None:
        at = self.here()
        stop = at + len(self.get_starttag_text() or "")
        if tag == "body" and self.body is None:
            self.body = (at, stop)
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name in self.WALLS:
                break
            if name in self.ENDS.get(tag, ()) or (name == "p" and tag in BLOCKS | {"table", "ul", "ol", "article", "section"}):
                self.shut(k, at)
                break
        if tag in VOID or tag == "br":
            return
        self.open.append((tag, at, stop))
        if self.path is None and self.wanted(tag, {k: v or "" for k, v in reversed(pairs)}):
            self.path = list(self.open)

    def handle_startendtag(self, tag: str, pairs: list) -> None:
        self.handle_starttag(tag, pairs)

    def handle_endtag(self, tag: str) -> None:
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag), None)
        if at is not None:
            start = self.here()
            own = self.path is not None and self.end is None and at == len(self.path) - 1
            self.shut(at, start)
            if own:
                self.end = self.rawdata_end(start)

    def rawdata_end(self, start: int) -> int:
        close = self.text.find(">", start)
        return self.size if close < 0 else close + 1

    def read(self, text: str) -> None:
        self.text = text
        self.feed(text)
        self.close()
        self.shut(0, self.size)


def trimmed(text: str | None, container: str | None, tag: str | None = None, notes: list[str] | tuple[str, ...] = ()) -> str | None:
    """A page with its container, and what is around it, alone.

    The container is the first element with the id, else the first ``tag``.
    The head, the container as it is in the source and the start tags of all
    elements around it stay, so that style rules by ancestors still fit;
    their other children go. The container gets the class ``web-page`` and,
    first in it, a block with the notes. None, pages without a container and
    pages whose body it is stay as they are. Ends that the source leaves out
    are written for the elements around the container.
    """
    if not text:
        return text
    for wanted in ((lambda t, a: a.get("id") == container) if container else None, (lambda t, a: t == tag) if tag else None):
        if wanted is None:
            continue
        reader = _Spans(text, wanted)
        reader.read(text)
        if reader.path is None or reader.path[-1][0] in ("body", "html"):
            continue
        *around, (name, start, stop) = reader.path
        first = next((k for k, x in enumerate(around) if x[0] == "body"), None)
        if first is None:
            head, inner = "".join(text[a:b] for t, a, b in around if t == "html"), [x for x in around if x[0] != "html"]
            closing = [t for t, _, _ in around]
        else:
            head, inner = text[: around[first][2]], around[first + 1 :]
            closing = [t for t, _, _ in around]
        own = with_class(text[start:stop], "web-page")
        note = f'<div class="web-page-note">{escape("；".join(notes), quote=False)}</div>' if notes else ""
        return head + "".join(text[a:b] for _, a, b in inner) + own + note + text[stop : reader.end] + "".join(f"</{t}>" for t in reversed(closing))
    return text


def with_class(start_tag: str, name: str) -> str:
    """A start tag with one class more."""
    held = re.search(r"""(\sclass\s*=\s*)("([^"]*)"|'([^']*)'|([^\s>"']+))""", start_tag, flags=re.I)
    if held:
        old = next(g for g in held.groups()[2:] if g is not None)
        return f'{start_tag[: held.start(2)]}"{old} {name}"{start_tag[held.end(2) :]}'
    end = re.match(r"<[^\s/>]+", start_tag).end()
    return f'{start_tag[:end]} class="{name}"{start_tag[end:]}'


# --- OOXML -------------------------------------------------------------------------

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _value(node, name: str) -> str | None:
    child = node.find(W + name) if node is not None else None
    return child.get(W + "val") if child is not None else None


def _flag(node, name: str) -> bool | None:
    child = node.find(W + name)
    return None if child is None else child.get(W + "val") not in ("0", "false")


def run_properties(r) -> dict:
    """Character properties a run or style declares."""
    p = r.find(W + "rPr")
    if p is None:
        return {}
    fonts, size, vertical = p.find(W + "rFonts"), _value(p, "sz"), _value(p, "vertAlign")
    out = {
        "family": fonts.get(W + "eastAsia") if fonts is not None else None,
        "latin": (fonts.get(W + "ascii") or fonts.get(W + "hAnsi")) if fonts is not None else None,
        "size_pt": int(size) / 2 if size and size.isdigit() else None,
        "bold": _flag(p, "b"),
        "italic": _flag(p, "i"),
        "sup": True if vertical == "superscript" else None,
        "sub": True if vertical == "subscript" else None,
        "color": (_value(p, "color") or "").upper() or None,
    }
    return {k: v for k, v in out.items() if v is not None}


def paragraph_properties(p) -> dict:
    """Paragraph properties a paragraph or style declares."""
    props = p.find(W + "pPr")
    if props is None:
        return {}
    out: dict = {}
    if jc := _value(props, "jc"):
        out["align"] = "justify" if jc == "both" else jc
    if (ind := props.find(W + "ind")) is not None:
        chars, twips = ind.get(W + "firstLineChars"), ind.get(W + "firstLine")
        if chars and float(chars) > 0:
            out["indent_chars"] = half_up(float(chars), 0) / 100
        elif twips is not None:
            out["indent_in"] = half_up(float(twips) / 1440, 4)
    if (space := props.find(W + "spacing")) is not None and float(space.get(W + "line") or 0) > 0:
        out["line_spacing"] = half_up(float(space.get(W + "line")) / 240, 3)
    return out


def docx_paragraphs(document: bytes | str, styles: bytes | str | None = None) -> list[dict]:
    """Paragraphs of a document part with inherited styles resolved (V5)."""
    declared = {}
    for s in ElementTree.fromstring(styles).iter(W + "style") if styles else ():
        own = {k: v for k, v in (run_properties(s) | paragraph_properties(s)).items() if v is not False}
        declared[s.get(W + "styleId")] = (_value(s, "basedOn"), own)

    def resolved(name: str | None, depth: int = 0) -> dict:
        if name not in declared or depth > 8:
            return {}
        base, own = declared[name]
        return resolved(base, depth + 1) | own

    out = []
    for p in ElementTree.fromstring(document).iter(W + "p"):
        style = _value(p.find(W + "pPr"), "pStyle")
        inherited = resolved(style if style in declared else "Normal")
        runs = []
        for r in p.findall(W + "r"):
            text = "".join(c.text or "" if c.tag == W + "t" else "\t" if c.tag == W + "tab" else "\n" if c.tag == W + "br" else "" for c in r)
            if text:
                chars = {k: inherited.get(k) for k in ("family", "latin", "size_pt", "bold", "italic", "color")}
                runs.append(BLANK_RUN | chars | run_properties(r) | {"text": text})
        props = {k: inherited.get(k) for k in NO_BLOCK} | paragraph_properties(p)
        if made := paragraph("p", runs, props):
            out.append({"i": len(out), **made})
    return out


def docx_texts(document: bytes | str) -> list[str]:
    """Plain text of every paragraph, blank ones too."""
    root = ElementTree.fromstring(document)
    return ["".join(c.text or "" if c.tag == W + "t" else "\t" if c.tag == W + "tab" else "\n" if c.tag == W + "br" else "" for c in p.iter()) for p in root.iter(W + "p")]
