"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Native: DataFrame functions only. Offsets are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: The base kinds in the order of the digest, with the least
#: length of the group given (0: the whole match).
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
KINDS = tuple(k for k, *_ in BASE) + ("entropy",)

#: Candidates: long unbroken strings of the widest alphabet.
CANDIDATE, LEAST_CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}", 20
#: Character classes: name, pattern of the whole candidate, window, least entropy in bits.
CLASSES = (
    ("hex", r"[0-9A-Fa-f]+", 20, 3.1),
    ("alnum", r"[A-Za-z0-9]+", 20, 3.75),
    ("base64", r"[A-Za-z0-9+/_=-]+", 20, 3.85),
)
#: Candidates that are no secrets: identifiers of known form.
ALLOW = (r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",)
#: Placeholders; a span with fewer characters than a candidate beside them is no secret.
ALLOW_SPANS = (r"(?i)(example|sample|dummy|placeholder|changeme|xxxxx|abcdefgh|12345678)",)
#: Words and numbers never touch in a path of words; a capital follows a small letter at most once in so many letters.
MINGLED, LETTERS_PER_CAPITAL = r"[A-Za-z][0-9]|[0-9][A-Za-z]|[+]", 6


def pieces(text: Column, pattern: str, group: int) -> Column:
    """Gaps, matches and groups of all matches, side by side in order."""
    p = F.lit(pattern)
    arrays = [F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"), F.regexp_extract_all(text, p, F.lit(group)).alias("part")]
    return F.arrays_zip(*arrays)


def spans(text: Column, rank: int, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, rank, end, hit>> of the matches whose group is long enough."""
    kind = "array<struct<start:bigint,rank:int,end:bigint,hit:string>>"
    none = F.array().cast(kind)

    def take(acc: Column, z: Column) -> Column:
        start = acc["at"] + F.length(z["gap"])
        end = start + F.coalesce(F.length(z["hit"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), z["hit"].alias("hit")))
        return F.struct(end.alias("at"), F.when(F.length(z["part"]) >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    walk = F.aggregate(pieces(text, pattern, group), F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), take, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), walk).otherwise(none)


def bits(n: Column) -> Column:
    """n * log2(n), 0 for 0."""
    return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))


def window_reach(s: Column, window: int, least: float) -> Column:
    """struct<first, last>: starts of the first and last window of at least that entropy.

    One pass: each step takes one character in and the one ``window`` back
    out, and changes the sum of n * log2(n) by the counts of those two alone;
    the entropy of a full window is log2(window) - sum / window. The state
    holds the window itself, so a step costs the same at any length.
    """
    start = F.struct(
        F.lit(0).alias("i"),
        F.lit("").alias("held"),
        F.lit(0.0).alias("sum"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )

    def times(held: Column, c: Column) -> Column:
        return F.length(held) - F.length(F.replace(held, c, F.lit("")))

    def slide(acc: Column, come: Column) -> Column:
        full = acc["i"] >= window
        go = F.when(full, F.substring(acc["held"], 1, 1)).otherwise("")
        n, m = times(acc["held"], come), times(acc["held"], go)
        change = F.when(come == go, F.lit(0.0)).otherwise(bits(n + 1) - bits(n) + F.when(full, bits(m - 1) - bits(m)).otherwise(0.0))
        total = acc["sum"] + change
        at = acc["i"] + 1 - window
        high = (at >= 0) & (F.log2(F.lit(float(window))) - total / window >= least)
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.concat(F.when(full, F.substring(acc["held"], 2, window)).otherwise(acc["held"]), come).alias("held"),
            total.alias("sum"),
            F.when(high, F.coalesce(acc["first"], at)).otherwise(acc["first"]).alias("first"),
            F.when(high, at).otherwise(acc["last"]).alias("last"),
        )

    characters = F.filter(F.split(s, ""), lambda c: c != "")
    return F.aggregate(characters, start, slide, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def plain_words(s: Column) -> Column:
    """Whether ``s`` reads as words, numbers and separators: a path, an identifier, a ruler."""
    return ~s.rlike(MINGLED) & (F.regexp_count(s, F.lit("[a-z][A-Z]")) * LETTERS_PER_CAPITAL <= F.length(s))


def entropy_spans(text: Column, base: Column, allow: tuple[str, ...] = ALLOW, allow_spans: tuple[str, ...] = ALLOW_SPANS) -> Column:
    """Spans from the first to the last high window of each candidate, unless allowed.

    A span that lies inside a base span is that one's already; one that
    reaches out of it stays.
    """
    rank = len(BASE)

    def judged(c: Column) -> Column:
        reach, window = F.lit(None).cast("struct<first:int,last:int>"), F.lit(0)
        for _, whole, size, least in reversed(CLASSES):
            fits = c["hit"].rlike(f"^{whole}$")
            reach = F.when(fits, window_reach(c["hit"], size, least)).otherwise(reach)
            window = F.when(fits, F.lit(size)).otherwise(window)
        return F.struct(c["start"].alias("from"), reach["first"].alias("first"), (reach["last"] + window).alias("end"), c["hit"].alias("hit"))

    def cut(c: Column) -> Column:
        part = F.substr(c["hit"], c["first"] + 1, c["end"] - c["first"])
        return F.struct((c["from"] + c["first"]).alias("start"), F.lit(rank).alias("rank"), (c["from"] + c["end"]).alias("end"), part.alias("hit"))

    def candidate(c: Column) -> Column:
        ok = ~plain_words(c["hit"]) & ~F.exists(base, lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"]))
        for pattern in allow:
            ok = ok & ~c["hit"].rlike(pattern)
        return ok

    def wanted(c: Column) -> Column:
        ok = ~plain_words(c["hit"]) & ~F.exists(base, lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"]))
        for pattern in allow_spans:
            ok = ok & (F.length(F.regexp_replace(c["hit"], pattern, "")) >= F.least(F.length(c["hit"]), F.lit(LEAST_CANDIDATE)))
        return ok

    high = F.filter(F.transform(F.filter(spans(text, rank, CANDIDATE, 0, LEAST_CANDIDATE), candidate), judged), lambda c: c["first"].isNotNull())
    return F.filter(F.transform(high, cut), wanted)


def written(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, text: str = "text", allow: tuple[str, ...] = ALLOW, into: tuple[str, str] = ("base_spans", "entropy_spans")) -> DataFrame:
    """Add ``into``: two arrays of (start, rank, end, hit), base spans and those the entropy adds.

    A null or empty text has none; repeated rows each get theirs; an empty
    table stays empty. New columns get underscores in front where the input
    has their names. Texts and candidates of any length are read whole, in
    time proportional to their length. No shuffle.
    """
    first, second = fresh(docs, *into)
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = F.array_sort(F.concat(*[spans(t, i, p, g, n) for i, (_, p, g, n) in enumerate(BASE)]))
    return docs.withColumn(first, base).withColumn(second, entropy_spans(t, F.col(first), allow))


def secret_digest(docs: DataFrame) -> DataFrame:
    """Query op6: counts, digest of the base spans, all spans."""
    found = scan_secrets(docs.select("doc_id", "text"))

    def of_rank(i: int) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["rank"] == i)).cast("long")

    count = [of_rank(i).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)]
    return found.select(
        "doc_id", *count,
        F.sha2(written(F.col("base_spans")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base_spans", "entropy_spans"))).alias("spans"),
    )
