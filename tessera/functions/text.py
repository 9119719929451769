"""Text normalization and line arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import NormOptions

#: Whitespace as the compared texts' tools define it (Java's \s is ASCII only).
JS_WS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
JS_WS_NOT_CR = JS_WS.replace(r"\r", "")

#: Characters that "ignore punctuation" drops.
PUNCT = (
    "()（）[]【】{}｛｝"
    "<>《》「」『』"
    "'\"‘’“”«»"
    "„‹›、"
    ",，.。．…‥·・"
    ";；:："
    "?？!！"
    "%％*＊+＋-－=＝"
    "~～_＿/／\\＼|｜"
    "&＆#＃@＠$＄^＾`｀¥￥"
)

#: U+FF01..U+FF5E are the printable ASCII characters, U+3000 is the space.
FULL = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000"
HALF = "".join(map(chr, range(0x21, 0x7F))) + " "


def normalized(text: Column, o: NormOptions = NormOptions()) -> Column:
    """The compared form of a text (F1, F2).

    Carriage returns only go with ``ignore_eol`` or ``ignore_newline``.
    Lower-casing is per character, so a capital sigma gives the same letter
    at the end of a word as elsewhere.
    """
    x = text
    if o.ignore_newline:
        x = F.regexp_replace(x, JS_WS, "")
    elif o.ignore_eol:
        x = F.replace(x, F.lit("\r"), F.lit(""))
    if o.ignore_case:
        x = F.lower(F.translate(x, "Σ", "σ"))
    if o.fold_width:
        x = F.translate(x, FULL, HALF)
    if o.ignore_punct:
        x = F.translate(x, PUNCT, "")
    if o.ignore_whitespace:
        x = F.regexp_replace(x, JS_WS_NOT_CR, "")
    return x


def normalized_sql(text: str, o: NormOptions = NormOptions()) -> str:
    """``normalized`` as DuckDB SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    ws = lambda keep_cr: r"[\t\n\x0B\f" + ("" if keep_cr else r"\r") + r" \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
    x = text
    if o.ignore_newline:
        x = f"regexp_replace({x}, '{ws(False)}', '', 'g')"
    elif o.ignore_eol:
        x = f"replace({x}, chr(13), '')"
    if o.ignore_case:
        x = f"lower(replace({x}, 'Σ', 'σ'))"
    if o.fold_width:
        x = f"translate({x}, {q(FULL)}, {q(HALF)})"
    if o.ignore_punct:
        x = f"translate({x}, {q(PUNCT)}, '')"
    if o.ignore_whitespace:
        x = f"regexp_replace({x}, '{ws(True)}', '', 'g')"
    return x


def split_lines(text: Column) -> Column:
    """Lines of a text (F3); the empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, r"\r\n|\r|\n", -1))


def tidy(text: Column) -> Column:
    """The text without any whitespace."""
    return F.regexp_replace(text, JS_WS, "")


def collapse(text: Column) -> Column:
    """Whitespace runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, JS_WS + "+", " "))


def newlines(text: Column) -> Column:
    """Number of line feeds."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def em_space_to_tab(text: Column) -> Column:
    """U+2003 as a tab, keeping the length."""
    return F.translate(text, "\u2003", "\t")


def brief(text: Column, most: int = 34) -> Column:
    """Collapsed text cut to ``most`` characters with an ellipsis."""
    c = collapse(text)
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("…"))).otherwise(c)


def escape_html(text: Column) -> Column:
    """Markup characters as entities."""
    x = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def unescape_xml(text: Column) -> Column:
    """The five named entities, the ampersand last."""
    x = text
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def base_name(path: Column) -> Column:
    """Last segment of a path in either notation."""
    return F.element_at(F.split(path, r"[\\/]"), -1)


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def short_name(name: Column, most: int = 5) -> Column:
    return F.left(strip_extension(base_name(name)), F.lit(most))


def sheet_name(name: Column, suffixes: tuple[str, ...] = ("新增", "修改", "删除", "变更汇总", "表头上方")) -> Column:
    """A legal sheet name of at most 31 characters that keeps its category suffix."""
    clean = F.regexp_replace(name, r"[\\/?*\[\]:]", "_")
    tail = F.regexp_extract(clean, "(" + "|".join(suffixes) + ")$", 1)
    cut = F.concat(F.substring(clean, F.lit(1), F.lit(31) - F.length(tail)), tail)
    return F.when(F.length(clean) <= 31, clean).otherwise(cut)


def width_units(text: Column) -> Column:
    """Display width: characters from U+2E80 on count two."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\u2E80-\uFFFF]", ""))


def to_base64(content: Column) -> Column:
    """Bytes as base64 text."""
    return F.regexp_replace(F.base64(content), r"[\r\n]", "")


def from_base64(text: Column) -> Column:
    """Bytes of a base64 text."""
    return F.unbase64(text)


def wrapped_lines(text: Column, width: Column) -> Column:
    """Lines that a header takes in a column of ``width`` characters (G16); characters above U+00FF count two."""
    usable = F.greatest(F.lit(2.0), width.cast("double") - 1)
    start = F.struct(F.lit(1).alias("lines"), F.lit(0.0).alias("held"))

    def step(acc: Column, c: Column) -> Column:
        size = F.when(F.ascii(c) > 255, 2.0).otherwise(1.0)
        over = acc["held"] + size > usable
        return F.struct((acc["lines"] + over.cast("int")).alias("lines"), F.when(over, size).otherwise(acc["held"] + size).alias("held"))

    letters = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    return F.aggregate(letters, start, step, lambda acc: acc["lines"])


def header_height(lines: Column, line_height: float = 15.0) -> Column:
    """Height of a header row of so many lines."""
    return F.greatest(F.lit(18.0), lines * line_height + 4)
