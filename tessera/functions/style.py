"""Measures, colours and tolerances of paragraph styles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import brief  # noqa: F401  (shown beside style differences)

SIZE = r"(?i)^([0-9]+(?:\.[0-9]+)?)\s*(pt|px)$"
LENGTH = r"(?i)^(-?[0-9]+(?:\.[0-9]+)?)\s*(in|pt|px|cm|mm)$"
PERCENT = r"^([0-9]+(?:\.[0-9]+)?)\s*%$"
HEX = r"^#?([0-9a-fA-F]{3}|[0-9a-fA-F]{6})$"

#: What two measures may differ by.
TOLERANCE = {"size_pt": 0.26, "indent_in": 0.03, "line_spacing": 0.06}
#: Properties compared by default, and how reports call them.
LABELS = {
    "size_pt": "字号",
    "family": "中文字体",
    "latin": "西文字体",
    "align": "对齐",
    "indent_in": "首行缩进",
    "line_spacing": "行距",
    "sup_chars": "上标字数",
    "sub_chars": "下标字数",
    "italic_runs": "斜体片段",
    "bold_runs": "加粗片段",
}
DEFAULT_PROPS = ("size_pt", "family", "align", "indent_in", "line_spacing", "sup_chars", "sub_chars", "italic_runs")


def half_up(x: Column, digits: int) -> Column:
    """Rounding halves toward plus infinity."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def to_pt(v: Column) -> Column:
    """A size in pt or px as points."""
    t = F.trim(v)
    n = F.regexp_extract(t, SIZE, 1).try_cast("double")
    return F.when(t.rlike(SIZE), half_up(n * F.when(F.lower(F.regexp_extract(t, SIZE, 2)) == "px", 0.75).otherwise(1.0), 2))


def to_inches(v: Column) -> Column:
    """A length in in, pt, px, cm or mm as inches."""
    t = F.trim(v)
    unit = F.lower(F.regexp_extract(t, LENGTH, 2))
    factor = F.when(unit == "in", 1.0).when(unit == "pt", 1 / 72).when(unit == "px", 1 / 96).when(unit == "cm", 1 / 2.54).otherwise(1 / 25.4)
    return F.when(t.rlike(LENGTH), half_up(F.regexp_extract(t, LENGTH, 1).try_cast("double") * factor, 4))


def line_spacing(v: Column) -> Column:
    """A line height in percent or as a plain multiple; absolute ones give null (F32)."""
    t = F.lower(F.trim(v))
    percent = F.regexp_extract(t, PERCENT, 1).try_cast("double")
    number = F.regexp_extract(t, r"^([+-]?[0-9]*\.?[0-9]+)", 1).try_cast("double")
    return F.when(t.rlike(PERCENT), F.floor(percent * 10 + 0.5) / 1000.0).when((number > 0) & (number <= 10), half_up(number, 3))


def hex_color(v: Column) -> Column:
    """Six upper-case hexadecimal digits."""
    t = F.trim(v)
    digits = F.upper(F.regexp_extract(t, HEX, 1))
    return F.when(t.rlike(HEX), F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits))


def indent_inches(indent_in: Column, indent_chars: Column, size_pt: Column) -> Column:
    """Indent in inches, from characters at the paragraph's size or 10 pt; none is 0."""
    size = F.when(size_pt != 0, size_pt)
    return F.coalesce(indent_in, half_up(indent_chars * F.coalesce(size, F.lit(10.0)) / 72, 4), F.lit(0.0))


def near(a: Column, b: Column, prop: str) -> Column:
    """Equal within the property's tolerance, texts without case."""
    if prop in ("family", "latin", "align", "color"):
        return F.lower(a).eqNullSafe(F.lower(b))
    return F.coalesce(F.abs(a - b) <= TOLERANCE.get(prop, 0), a.isNull() & b.isNull())


def shown(v: Column, prop: str) -> Column:
    """A value with its unit (F38); whole numbers without a fraction."""
    plain = F.regexp_replace(v.cast("string"), r"\.0$", "")
    unit = {"size_pt": "pt", "indent_in": "in", "indent_chars": "字符", "line_spacing": " 倍"}.get(prop, "")
    return F.coalesce(F.concat(plain, F.lit(unit)), F.lit("未设置"))
