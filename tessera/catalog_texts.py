"""Queries on text comparison over pairs whose alignment is known.

The right side of each pair is made from the left one by fixed rules that
leave a single longest common subsequence, so SQL tells rows, counts, hunks,
marks and anchors from the rules alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import EVENT_SQL, query, table, user_events
from .operators import text_diff

# --- lines: every event of a user gives a line A and a line B, which never changes ----------------

#: By the event's number mod 4: A stays, goes, changes, or has a new line behind it.
_KINDS = "CASE ord % 4 WHEN 0 THEN 'equal' WHEN 1 THEN 'remove' WHEN 2 THEN 'change' ELSE 'equal' END"
_ROWS = f"""WITH {EVENT_SQL}, s AS (SELECT user_id, ord, 'e' || event_id || ' ' || event_type AS a, '=' || event_id AS b, 'new ' || event_id AS n FROM e),
r AS (SELECT user_id, ord, 0 AS part, {_KINDS} AS type, a AS l, CASE ord % 4 WHEN 1 THEN NULL WHEN 2 THEN a || '!' ELSE a END AS r FROM s
  UNION ALL SELECT user_id, ord, 1, 'add', NULL, n FROM s WHERE ord % 4 = 3 UNION ALL SELECT user_id, ord, 2, 'equal', b, b FROM s),
d AS (SELECT user_id AS pair_id, type, l AS left_text, r AS right_text, row_number() OVER w - 1 AS row_ord,
  CASE WHEN l IS NULL THEN -1 ELSE count(l) OVER w - 1 END AS li, CASE WHEN r IS NULL THEN -1 ELSE count(r) OVER w - 1 END AS ri FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ord, part ROWS UNBOUNDED PRECEDING))
"""


def event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair of texts per user: pair_id, left, right."""
    e = user_events(spark, sf_dir)
    a, b = F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(" "), "event_type"), F.concat(F.lit("="), F.col("event_id").cast("string"))
    k = F.col("ord") % 4
    left = F.concat_ws("\n", a, b)
    right = F.concat_ws("\n", F.when(k == 2, F.concat(a, F.lit("!"))).when(k != 1, a), F.when(k == 3, F.concat(F.lit("new "), F.col("event_id").cast("string"))), b)
    per = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ord", left.alias("l"), right.alias("r")))).alias("p"))
    side = lambda c: F.array_join(F.transform("p", lambda x: x[c]), "\n")
    return per.select(F.col("user_id").alias("pair_id"), side("l").alias("left"), side("r").alias("right"))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_diff.diff_rows(event_pairs(spark, sf_dir))


def written(segs: str | Column) -> Column:
    return F.coalesce(F.array_join(F.transform(segs, lambda s: F.concat(s["cls"], F.lit(":"), s["text"])), "|"), F.lit(""))


@query(
    _ROWS + "SELECT pair_id, row_ord::INT AS row_ord, type, li::INT AS li, ri::INT AS ri, coalesce(left_text, '') AS left_text, coalesce(right_text, '') AS right_text, "
    "CASE WHEN type = 'change' THEN 'eq:' || left_text ELSE '' END AS seg_l, CASE WHEN type = 'change' THEN 'eq:' || left_text || '|ad:!' ELSE '' END AS seg_r FROM d"
)
def known_diff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return event_rows(spark, sf_dir).select("pair_id", "row_ord", "type", "li", "ri", text("left_text"), text("right_text"), written("seg_l").alias("seg_l"), written("seg_r").alias("seg_r"))


_STATS = _ROWS + ", s2 AS (SELECT pair_id, count_if(type = 'equal')::BIGINT AS equal, count_if(type = 'change')::BIGINT AS modified, count_if(type = 'add')::BIGINT AS added, count_if(type = 'remove')::BIGINT AS removed FROM d GROUP BY pair_id)\n"


@query(_STATS + "SELECT *, CASE WHEN modified + added + removed > 0 THEN modified || ' modified, ' || added || ' added, ' || removed || ' removed, ' || equal || ' equal' ELSE 'identical' END AS message FROM s2")
def known_diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = event_pairs(spark, sf_dir)
    return text_diff.messages(text_diff.grid_stats(p, text_diff.diff_rows(p)))


@query(_STATS + "SELECT pair_id, equal, modified, removed AS added, added AS removed FROM s2")
def swapped_diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_diff.line_stats(text_diff.swapped(event_pairs(spark, sf_dir)))


@query(
    _ROWS + ", u AS (SELECT pair_id, count(left_text) AS nl, count(right_text) AS nr, string_agg(CASE type WHEN 'equal' THEN ' ' || left_text WHEN 'change' THEN '-' || left_text || chr(10) || '+' || right_text WHEN 'remove' THEN '-' || left_text ELSE '+' || right_text END, chr(10) ORDER BY row_ord) AS body, bool_or(type <> 'equal') AS differs FROM d GROUP BY pair_id) "
    "SELECT pair_id, '--- a/原文' || chr(10) || '+++ b/修改后' || chr(10) || '@@ -1,' || nl || ' +1,' || nr || ' @@' || chr(10) || body AS unified FROM u WHERE differs"
)
def known_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes lie so close that each pair has one hunk over all its lines."""
    return text_diff.unified(event_rows(spark, sf_dir))


_MARKS = _ROWS + ", m AS (SELECT pair_id, 'left' AS side, (li + 1)::INT AS line, 'rm' AS cls, CASE WHEN type = 'change' THEN 'eq:' || left_text ELSE '' END AS segs, length(left_text) AS n, type FROM d WHERE type <> 'equal' AND li >= 0 UNION ALL SELECT pair_id, 'right', (ri + 1)::INT, 'ad', CASE WHEN type = 'change' THEN 'eq:' || left_text || '|ad:!' ELSE '' END, length(left_text), type FROM d WHERE type <> 'equal' AND ri >= 0)\n"


@query(_MARKS + "SELECT pair_id, side, line, cls, segs FROM m")
def diff_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_diff.marks(event_rows(spark, sf_dir)).select("pair_id", "side", "line", "cls", written("segs").alias("segs"))


@query(_MARKS + "SELECT pair_id, side, line, n::INT AS start, (n + 1)::INT AS stop, 'ad' AS cls FROM m WHERE type = 'change' AND side = 'right'")
def mark_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_diff.segment_ranges(text_diff.marks(event_rows(spark, sf_dir)).where("segs IS NOT NULL"), ["pair_id", "side", "line"])


@query(_ROWS + "SELECT pair_id, row_ord::INT AS row_ord, 'eq:' || left_text || '|ad:!' AS segs FROM d WHERE type = 'change'")
def redlined_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_diff.redlines(event_rows(spark, sf_dir)).select("pair_id", "row_ord", written("segs").alias("segs"))


@query(_ROWS + "SELECT pair_id, (li + 1)::INT AS l, (ri + 1)::INT AS r FROM d WHERE li >= 0 AND ri >= 0")
def line_numbers_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_diff.line_table(event_rows(spark, sf_dir))


@query(_ROWS + ", c AS (SELECT pair_id, count_if(type = 'equal')::DOUBLE / greatest(1, least(count(left_text), count(right_text))) AS coverage FROM d GROUP BY pair_id) SELECT pair_id, (li + 1)::INT AS l, (ri + 1)::INT AS r, round(coverage, 9) AS coverage FROM d JOIN c USING (pair_id) WHERE type = 'equal'")
def line_anchor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_diff.anchors(event_pairs(spark, sf_dir)).where("level = 'line'").select("pair_id", "l", "r", F.round("coverage", 9).alias("coverage"))


# --- characters: the right text is the left one without some of its letters ------------------------

_DROP = "[aeiou0-9]"
_SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def thinned(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("pair_id"), F.col(text).alias("left"), F.regexp_replace(text, _DROP, "").alias("right"))


@query(
    f"WITH n AS (SELECT doc_id AS pair_id, coalesce(length(regexp_replace(text, '{_SPACE}', '', 'g')), 0) AS a, coalesce(length(regexp_replace(regexp_replace(text, '{_SPACE}', '', 'g'), '{_DROP}', '', 'g')), 0) AS b FROM documents) "
    "SELECT pair_id, false AS skipped, a - b AS removed_chars, 0::BIGINT AS added_chars FROM n"
)
def thinned_flow_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, however long, is compared by character."""
    return text_diff.flow_stats(thinned(text_diff.dealt(table(spark, sf_dir, "documents"), "doc_id"), "doc_id", "text"), limit=None)


@query(f"SELECT conv_id * 1000 + turn AS pair_id, CASE WHEN a = b THEN 1.0::DOUBLE WHEN length(b) = 0 THEN 0.0 ELSE round(length(b)::DOUBLE / length(a), 9) END AS similarity FROM (SELECT *, regexp_replace(lower(coalesce(text, '')), '[\\t ]+', ' ', 'g') AS a, regexp_replace(lower(regexp_replace(coalesce(text, ''), '{_DROP}', '', 'g')), '[\\t ]+', ' ', 'g') AS b FROM conversations)")
def thinned_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return text_diff.similarities(thinned(c, "id", "text")).select("pair_id", F.round("similarity", 9).alias("similarity"))


def numbered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's number, and the same behind two marks."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pair_id"), F.concat(F.lit("key "), F.col("p_partkey").cast("string")).alias("left"))
    return p.withColumn("right", F.concat(F.lit("**"), "left"))


@query("SELECT p_partkey AS pair_id, (i + 2)::INT AS \"to\", i::INT AS at FROM (SELECT p_partkey, 'key ' || p_partkey AS l FROM part), range(0, 40) g(i) WHERE i <= length(l)")
def offsets_to_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_diff.offset_maps(numbered_names(spark, sf_dir))


@query("SELECT p_partkey AS pair_id, i::INT AS l, (i + 2)::INT AS r FROM (SELECT p_partkey, 'key ' || p_partkey AS l FROM part), range(0, 40) g(i) WHERE i < length(l) AND i <> 3")
def char_anchor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blanks do not count where newlines don't, so the fourth character has no anchor."""
    return text_diff.anchors(numbered_names(spark, sf_dir)).where("level = 'char'").select("pair_id", "l", "r")


@query(_ROWS + "SELECT pair_id, row_ord::INT AS row_ord, type, coalesce(nullif(li + 1, 0), -1)::INT AS left_no, coalesce(left_text, '') AS left_text, coalesce(nullif(ri + 1, 0), -1)::INT AS right_no, coalesce(right_text, '') AS right_text FROM d")
def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text_diff.side_by_side(event_rows(spark, sf_dir))
    return out.select("pair_id", "row_ord", "type", *[F.coalesce(c, F.lit(-1 if c.endswith("no") else "")).alias(c) for c in ("left_no", "left_text", "right_no", "right_text")])


@query(_STATS + "SELECT * FROM s2 WHERE pair_id % 3 <> 0")
def compared_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of every third user were not edited."""
    p = event_pairs(spark, sf_dir).withColumn("left_edited", F.when(F.col("pair_id") % 3 == 0, F.col("left")).otherwise("old")).withColumn("right_edited", F.col("right"))
    return text_diff.compared_again(p)


@query("SELECT doc_id AS pair_id, 0::BIGINT AS removed_chars, 0::BIGINT AS added_chars, n AS equal, 0::BIGINT AS modified, CASE WHEN n > 0 THEN n - 1 ELSE 0 END AS added, 0::BIGINT AS removed FROM (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n FROM documents)")
def tidy_and_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts against themselves with every line end doubled: nothing for the tidied view, blank lines for the raw one."""
    d = text_diff.dealt(table(spark, sf_dir, "documents"), "doc_id")
    pairs = d.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("left"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("right"))
    return text_diff.both_views(pairs, limit=None)
