"""Keyed comparison of two tables, row by row and cell by cell.

The new rows meet the first old row of their key in a left join; an anti join
gives the old rows whose key is gone. Duplicate rows of the driving side all
meet that first row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..options import TableDiffConfig

#: Order of the categories in every report.
CATEGORIES = ("modified", "added", "deleted", "unchanged")
OLD_MARK = "旧_"
SCHEMA = "sheet string, category string, key string, new_row long, old_row long, changed_cols array<string>, old_values map<string,string>, new_values map<string,string>"


@dataclass(frozen=True)
class Structure:
    """Columns of the two sides and how rows are matched."""

    new_columns: list[str]
    deleted_columns: list[str]
    common_columns: list[str]
    keys: list[str]
    auto_key: bool

    @property
    def mode(self) -> str:
        return "key" if self.keys else "hash"


def detect_key(old: list[str], new: list[str]) -> str | None:
    """The first candidate name both sides have, else one that ends a merged header of both."""
    for name in V.KEY_CANDIDATES:
        if name in old and name in new:
            return name
    for name in V.KEY_CANDIDATES:
        for header in new:
            if V.header_tail(header) == name and header in old:
                return header
    return None


def structure(old: list[str], new: list[str], config: TableDiffConfig = TableDiffConfig()) -> Structure:
    common = [c for c in new if c in old]
    keys = [k for k in config.keys if k in common]
    guessed = None if keys else detect_key(old, new)
    return Structure([c for c in new if c not in old], [c for c in old if c not in new], common, keys or ([guessed] if guessed else []), guessed is not None)


def _text(df: DataFrame, row: str | None, tag: str) -> tuple[DataFrame, list[str]]:
    """All columns as text inside one struct, with the row number beside."""
    names = [c for c in df.columns if c != row]
    number = F.col(f"`{row}`").cast("long") if row else F.monotonically_increasing_id() + 1
    return df.select(number.alias(f"{tag}_row"), F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in names]).alias(tag)), names


def _cells(side: str, names: list[str]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(side)[n] for n in names]))


#: Rows of one key, of both sides, beyond which they are dealt over several tasks.
HOT_ROWS = 5_000_000


def hot_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, salts) of keys with more than ``HOT_ROWS`` rows: at most one for so many rows, so it may be broadcast."""
    counts = left.select("key").unionByName(right.select("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > HOT_ROWS).select("key", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("salts"))


def _dealt(df: DataFrame, hot: DataFrame, by: str) -> DataFrame:
    """Rows of hot keys with a salt by ``by``; others have 0."""
    return df.join(F.broadcast(hot), "key", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("salts").cast("long")), F.lit(0).cast("long"))).drop("salts")


def _repeated(df: DataFrame, hot: DataFrame) -> DataFrame:
    """A row per key, repeated for every salt of a hot one."""
    last = (F.coalesce(F.col("salts"), F.lit(1)) - 1).cast("long")
    return df.join(F.broadcast(hot), "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("salts")


def table_diff(old: DataFrame, new: DataFrame, config: TableDiffConfig = TableDiffConfig(), row: str | None = None) -> DataFrame:
    """Rows of both tables as added, modified, unchanged or deleted.

    ``row`` names the column of source row numbers on both sides, which also
    decides what the first row of a key is. With no common key, rows are
    compared whole. Columns new on one side change a row where they hold a
    value; those of the old side are listed with a mark.
    """
    left, old_names = _text(old, row, "old")
    right, new_names = _text(new, row, "new")
    s = structure(old_names, new_names, config)
    if not s.keys:
        return _whole_rows(left, right, s, old_names, new_names, config)
    equal = V.loosely_equal if config.equality == "loose" else V.strictly_equal
    key = lambda side: V.make_key([F.col(side)[k] for k in s.keys])
    composite = len(s.keys) > 1 and config.blank_composite_is_key
    usable = lambda side: F.lit(True) if composite else ~V.all_blank([F.col(side)[k] for k in s.keys])
    left = left.withColumn("key", key("old")).where(usable("old"))
    right = right.withColumn("key", key("new")).where(usable("new"))
    # only the first old row of a key can be met; a minimum combines before the shuffle, so a key of many rows is no task of its own
    first = left.groupBy("key").agg(F.min(F.struct("old_row", "old")).alias("first")).select("key", "first.old_row", "first.old")
    hot = hot_keys(left, right)
    both = _dealt(right, hot, "new_row").join(_repeated(first, hot), ["key", "salt"], "left").drop("salt")
    met_keys = _repeated(right.select("key").distinct(), hot)
    gone = _dealt(left, hot, "old_row").join(met_keys, ["key", "salt"], "left_anti").drop("salt").where(~V.all_blank([F.col("old")[c] for c in old_names]))
    # cells as one array, so the comparison is one expression however many columns there are
    cell = lambda n, o, v: F.struct(F.lit(n).alias("name"), o.cast("string").alias("old"), v.cast("string").alias("new"))
    listed = lambda cells, keep: F.filter(F.array(*cells), keep) if cells else F.array().cast("array<struct<name:string,old:string,new:string>>")
    changes = F.concat(
        listed([cell(c, F.col("old")[c], F.col("new")[c]) for c in s.common_columns], lambda e: ~equal(e["old"], e["new"])),
        listed([cell(c, F.lit(None), F.col("new")[c]) for c in s.new_columns], lambda e: ~V.is_blank(e["new"])),
        listed([cell(OLD_MARK + c, F.col("old")[c], F.lit("")) for c in s.deleted_columns], lambda e: ~V.is_blank(e["old"])),
    )
    matched = F.col("old_row").isNotNull()
    none = F.array().cast("array<string>")
    # one projection compares all cells; what follows only reads its result
    judged = both.withColumn("changes", F.when(matched, changes).otherwise(F.array()))
    # a new row that is blank throughout is not reported as added
    judged = judged.where(matched | ~V.all_blank([F.col("new")[c] for c in new_names]))
    category = F.when(~matched, "added").when(F.size("changes") > 0, "modified").otherwise("unchanged")
    empty = F.create_map().cast("map<string,string>")
    names = F.transform("changes", lambda e: e["name"])
    met = judged.select(
        F.lit(config.sheet).alias("sheet"),
        category.alias("category"),
        "key",
        "new_row",
        "old_row",
        names.alias("changed_cols"),
        F.map_from_arrays(names, F.transform("changes", lambda e: e["old"])).alias("old_values"),
        F.when(category == "added", _cells("new", new_names)).otherwise(F.map_from_arrays(names, F.transform("changes", lambda e: e["new"]))).alias("new_values"),
    )
    lost = gone.select(F.lit(config.sheet), F.lit("deleted"), "key", F.lit(None).cast("long"), "old_row", none, _cells("old", old_names), empty)
    return met.union(lost)


def _whole_rows(left: DataFrame, right: DataFrame, s: Structure, old_names: list[str], new_names: list[str], config: TableDiffConfig) -> DataFrame:
    """Set difference of whole rows in column order, both ways."""
    value = lambda side, names: V.row_value([F.col(side)[n] for n in names])
    left = left.withColumn("key", value("old", old_names)).where(~V.all_blank([F.col("old")[c] for c in old_names]))
    right = right.withColumn("key", value("new", new_names)).where(~V.all_blank([F.col("new")[c] for c in new_names]))
    none, empty = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    added = right.join(left.select("key").distinct(), "key", "left_anti")
    gone = left.join(right.select("key").distinct(), "key", "left_anti")
    nothing = F.lit(None).cast("long")
    tag = F.lit(config.sheet).alias("sheet")
    out = added.select(tag, F.lit("added").alias("category"), "key", "new_row", nothing.alias("old_row"), none.alias("changed_cols"), empty.alias("old_values"), _cells("new", new_names).alias("new_values"))
    return out.union(gone.select(tag, F.lit("deleted"), "key", nothing, "old_row", none, _cells("old", old_names), empty))


def structural_diff(old: DataFrame, new: DataFrame, config: TableDiffConfig = TableDiffConfig(), row: str | None = None) -> DataFrame:
    """One row: new, deleted and common columns, key, match mode."""
    s = structure([c for c in old.columns if c != row], [c for c in new.columns if c != row], config)
    schema = "sheet string, new_columns array<string>, deleted_columns array<string>, common_columns array<string>, key_names array<string>, auto_key boolean, match_mode string"
    return old.sparkSession.createDataFrame([(config.sheet, s.new_columns, s.deleted_columns, s.common_columns, s.keys, s.auto_key, s.mode)], schema)


def workbook_diff(old: dict[str, DataFrame], new: dict[str, DataFrame], configs: dict[str, TableDiffConfig] | None = None, row: str | None = None) -> DataFrame:
    """All sheets of two workbooks, in the order of the new one (T8, J6); one-sided sheets are all added or all deleted."""
    out = None
    for name in [*new, *(n for n in old if n not in new)]:
        config = (configs or {}).get(name, TableDiffConfig(sheet=name))
        some = new.get(name) or old[name]
        blank = some.limit(0)
        part = table_diff(old.get(name, blank), new.get(name, blank), config, row)
        out = part if out is None else out.unionByName(part)
    return out


def diff_counts(diff: DataFrame) -> DataFrame:
    """Rows per sheet and category."""
    return diff.groupBy("sheet", "category").agg(F.count(F.lit(1)).alias("n"))


def totals(diff: DataFrame) -> DataFrame:
    """Over all sheets: rows by category, sheets compared and with differences."""
    per = diff.groupBy("sheet").agg(*[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES])
    differs = F.col("added") + F.col("modified") + F.col("deleted") > 0
    return per.agg(*[F.sum(c).alias(c) for c in CATEGORIES], F.count_if(differs).alias("sheets_with_diff"), F.count(F.lit(1)).alias("sheets_compared"))


def overview(diff: DataFrame) -> DataFrame:
    """Differences per sheet and category, or one row that says there are none."""
    counts = diff_counts(diff).where("category <> 'unchanged'")
    none = diff.sparkSession.range(1).select(F.lit("").alias("sheet"), F.lit("none").alias("category"), F.lit(0).cast("long").alias("n"))
    return counts.unionByName(none.join(counts.limit(1).select(F.lit(1).alias("x")), F.lit(True), "left_anti"))


def changed_cells(diff: DataFrame) -> DataFrame:
    """One row per changed cell: sheet, key, rows, column, old and new value."""
    cells = diff.where("category = 'modified'").select("sheet", "key", "new_row", "old_row", F.explode("changed_cols").alias("name"), "old_values", "new_values")
    gone = F.col("name").startswith(OLD_MARK) & F.col("old_values")[F.col("name")].isNotNull() & (F.col("new_values")[F.col("name")] == "")
    return cells.select(
        "sheet", "key", "new_row", "old_row",
        F.when(gone, F.substr("name", F.lit(len(OLD_MARK) + 1))).otherwise(F.col("name")).alias("column"),
        gone.alias("column_deleted"),
        F.col("old_values")[F.col("name")].alias("old_value"),
        F.col("new_values")[F.col("name")].alias("new_value"),
    )


def rank_of(category: Column) -> Column:
    out = F.lit(len(CATEGORIES))
    for i, c in enumerate(CATEGORIES):
        out = F.when(category == c, i).otherwise(out)
    return out


def change_summary(diff: DataFrame) -> DataFrame:
    """All categories as one table: rank, rows, and the changes as ``name: old → new`` (R4, SO4, O3)."""
    arrow = F.array_join(
        F.transform("changed_cols", lambda c: F.concat(c, F.lit(": "), F.coalesce(F.col("old_values")[c], F.lit("")), F.lit(" → "), F.coalesce(F.col("new_values")[c], F.lit("")))), "; "
    )
    return diff.select("sheet", rank_of(F.col("category")).alias("category_rank"), "category", "key", "new_row", "old_row", arrow.alias("changes"))
