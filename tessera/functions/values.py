"""Cell values: blanks, numbers, dates, tolerant equality, keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that count as blank, separator of composite keys, names that keys are guessed from.
BLANK_WORDS = ("nan", "none", "null", "nat")
KEY_SEPARATOR = " ||| "
KEY_CANDIDATES = ("提取物批号", "批号", "ID", "id", "编号", "序号", "code")

NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
DATE = r"^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})(?:[ T]([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?)?$"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def is_blank(v: Column) -> Column:
    """Null, empty, whitespace, or one of the words for nothing in any case."""
    return v.isNull() | F.lower(F.trim(v)).isin("", *BLANK_WORDS)


def to_number(v: Column) -> Column:
    """Plain decimal notation as double, else null: no units, separators, Infinity."""
    t = F.trim(v)
    n = F.when(t.rlike(NUMBER), t.try_cast("double"))
    return F.when(F.abs(n) < float("inf"), n)


def date_key(v: Column) -> Column:
    """``YYYY-MM-DD[ HH:MM:SS]`` of a date text, else null.

    Parts beyond their range roll over: the 31st of February is the 2nd or
    3rd of March. Midnight drops the time.
    """


    def form(t: Column) -> Column:
        part = lambda i: F.coalesce(F.nullif(F.regexp_extract(t, DATE, i), F.lit("")).cast("int"), F.lit(0))
        start = F.make_timestamp_ntz(F.greatest(part(1), F.lit(1)), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        at = start + F.make_ym_interval(F.lit(0), part(2) - 1) + F.make_dt_interval(part(3) - 1, part(4), part(5), part(6).cast("decimal(18,6)"))
        return F.when(t.rlike(DATE), F.regexp_replace(let(at, lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")), " 00:00:00$", ""))

    return let(F.trim(v), form)


def loosely_equal(a: Column, b: Column) -> Column:
    """Equality that ignores notation (F15): blanks alike, dates by key, numbers within a tolerance, else trimmed text."""

    def forms(x: Column) -> Column:
        return F.struct(is_blank(x).alias("blank"), date_key(x).alias("day"), to_number(x).alias("n"), F.trim(x).alias("text"))

    def compare(p: Column) -> Column:
        l, r = p[0], p[1]
        gap = F.abs(l["n"] - r["n"])
        near = (l["n"] == r["n"]) | (gap < F.greatest(F.lit(1e-9), F.greatest(F.abs(l["n"]), F.abs(r["n"])) * 1e-12))
        return (
            F.when(l["blank"] | r["blank"], l["blank"] & r["blank"])
            .when(l["day"].isNotNull() & r["day"].isNotNull(), l["day"] == r["day"])
            .when(l["n"].isNotNull() & r["n"].isNotNull(), near)
            .otherwise(l["text"] == r["text"])
        )

    # most cells are identical: only the others are parsed, each form once
    return F.when(a.eqNullSafe(b), True).otherwise(let(F.transform(F.array(a, b), forms), compare))


def strictly_equal(a: Column, b: Column) -> Column:
    """Equal trimmed texts, null like the empty text (F16)."""
    return F.trim(F.coalesce(a, F.lit(""))) == F.trim(F.coalesce(b, F.lit("")))


def make_key(columns: list[Column]) -> Column:
    """Key text of one or more columns, null like the empty text."""
    parts = [F.coalesce(c, F.lit("")) for c in columns]
    return parts[0] if len(parts) == 1 else F.concat_ws(KEY_SEPARATOR, *parts)


def header_tail(h: str) -> str:
    """Last part of a merged header."""
    return h.rsplit(" / ", 1)[-1]


def all_blank(columns: list[Column]) -> Column:
    """Every cell is blank."""
    return reduce(lambda a, b: a & b, [is_blank(c) for c in columns])


def row_value(columns: list[Column]) -> Column:
    """A row as one exact text of its trimmed cells (in place of a hash, F19)."""
    return F.concat_ws("\u0001", *[F.trim(F.coalesce(c, F.lit(""))) for c in columns])


def date_text(ts: Column) -> Column:
    """A timestamp as cell text: the date, then hours and minutes, seconds only if any."""
    time = F.date_format(ts, "HH:mm:ss")
    form = F.when(time == "00:00:00", F.date_format(ts, "yyyy-MM-dd")).when(time.endswith(":00"), F.date_format(ts, "yyyy-MM-dd HH:mm"))
    return form.otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
