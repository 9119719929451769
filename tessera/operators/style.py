"""Style vectors of paragraphs: extraction, expectations, comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import style as S
from ..functions import text as T
from ..kernel import align, markup
from ..sources import scratch

RUN = "struct<text:string,family:string,latin:string,size_pt:double,bold:boolean,italic:boolean,sup:boolean,sub:boolean,underline:boolean,color:string>"
FIELDS = (
    "i int, kind string, text string, align string, indent_in double, indent_chars double, line_spacing double, size_pt double, family string, "
    f"latin string, bold_runs int, italic_runs int, sup_chars int, sub_chars int, runs array<{RUN}>"
)
SCHEMA = f"doc_id long, {FIELDS}"
#: Documents whose paragraphs are handed over together.
BATCH = 64
#: Pages, and characters of their texts, that leave together at most, but for the last documents.
MOST, HELD = 4096, 1 << 18


def few(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows in small frames, so that what is made of them is small too."""
    for f in frames:
        for at in range(0, len(f), BATCH):
            yield f.iloc[at : at + BATCH]


_RUN = pa.struct([("text", pa.string()), ("family", pa.string()), ("latin", pa.string()), ("size_pt", pa.float64()), *[(k, pa.bool_()) for k in ("bold", "italic", "sup", "sub", "underline")], ("color", pa.string())])
_TYPES = {"int": pa.int32(), "string": pa.string(), "double": pa.float64()}
_FIELDS = pa.schema([("doc_id", pa.int64()), *[(n, _TYPES.get(t) or pa.list_(_RUN)) for n, t in (f.split(" ") for f in FIELDS.split(", "))]])

#: All that is told of a paragraph but its runs.
MEASURES = tuple(n for n in _FIELDS.names if n not in ("doc_id", "runs"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple]]:
    """The rows of few documents at a time, so that no more are Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, BATCH):
            yield zip(*(c.to_pylist() for c in b.slice(at, BATCH).columns), strict=True)


def _column(name: str, values: tuple) -> pa.Array:
    """Values of a field as an Arrow column; runs come as pairs of style values and text."""
    kind = _FIELDS.field(name).type
    if name != "runs":
        return pa.array(values, kind)
    ends = [0, *accumulate(map(len, values))]
    flat = [(text, *style) for runs in values for style, text in runs]
    parts = zip(*flat, strict=True) if flat else [()] * kind.value_type.num_fields
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(parts, kind.value_type, strict=True)], fields=list(kind.value_type)))


def _vectors(df: DataFrame, columns: list[str], read, fields: tuple[str, ...]) -> DataFrame:
    names = ["doc_id", *(f for f in _FIELDS.names[1:] if f in fields or not fields)]
    at = [_FIELDS.names.index(n) for n in names]
    schema = pa.schema([_FIELDS.field(n) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _slices(batches):
            found = [(d, i, *p) for d, *parts in rows for i, p in enumerate(read(*parts))]
            if found:
                values = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([_column(n, values[k]) for n, k in zip(names, at, strict=True)], schema=schema)

    kept = ", ".join(f for f in SCHEMA.split(", ") if f.split(" ")[0] in names)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), *columns).mapInArrow(run, kept)


def html_vectors(pages: DataFrame, container: str | None = None, fields: tuple[str, ...] = ()) -> DataFrame:
    """Style vectors of pages (doc_id, html) (V1-V4); all fields or those asked for."""
    return _vectors(pages, ["html"], lambda h: markup.html_rows(h, container), fields)


def html_texts(pages: DataFrame, container: str | None = None) -> DataFrame:
    """Texts of all paragraphs of a page (doc_id, html) in order, as one row per page: doc_id, texts; none for pages without paragraphs.

    They leave the reader together, so nothing is shuffled to bring them together again.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("texts", pa.list_(pa.string()))])

    def handed(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for rows in _slices(batches):
            for d, html in rows:
                if texts := markup.html_texts(html, container):
                    found.append((d, texts))
                    held += sum(map(len, texts))
            if held > HELD or len(found) > MOST:
                yield handed(found)
                found, held = [], 0
        if found:
            yield handed(found)

    return pages.select(F.col("doc_id").cast("long").alias("doc_id"), "html").mapInArrow(run, "doc_id long, texts array<string>")


def docx_vectors(parts: DataFrame, fields: tuple[str, ...] = ()) -> DataFrame:
    """Style vectors of documents (doc_id, document, styles) given as XML parts (V5); all fields or those asked for."""
    return _vectors(parts, ["document", "styles"], lambda d, s: [markup.row(p) for p in markup.docx_paragraphs(d, s)], fields)


def apply_spec(vectors: DataFrame, spec: dict) -> DataFrame:
    """Expectations laid over vectors (V6): defaults fill gaps, then rules override in order.

    ``spec``: ``defaults`` {property: value} and ``rules`` [{``match``, ``set``}];
    a match may ask for kind, align, i, text_starts, text_includes,
    text_not_includes, size_lt, all of which must hold.
    """
    types = {f.name: f.dataType for f in vectors.schema}
    out = vectors
    for name, value in spec.get("defaults", {}).items():
        out = out.withColumn(name, F.coalesce(name, F.lit(value).cast(types[name])))
    for rule in spec.get("rules", []):
        hit = F.coalesce(matches(rule.get("match") or {}), F.lit(False))
        # the rule looks at the row as it is before any of its own settings
        out = out.withColumn("_hit", hit)
        for name, value in rule.get("set", {}).items():
            out = out.withColumn(name, F.when(F.col("_hit"), F.lit(value).cast(types[name])).otherwise(F.col(name)))
        out = out.drop("_hit")
    return out


def matches(match: dict) -> Column:
    tests = {
        "kind": lambda v: F.col("kind") == v,
        "align": lambda v: F.col("align") == v,
        "i": lambda v: F.col("i") == v,
        "text_starts": lambda v: F.col("text").startswith(v),
        "text_includes": lambda v: F.contains("text", F.lit(v)),
        "text_not_includes": lambda v: ~F.contains("text", F.lit(v)),
        "size_lt": lambda v: F.col("size_pt") < v,
    }
    out = F.lit(True)
    for name, value in match.items():
        out = out & tests[name](value)
    return out


def aligned(actual: DataFrame, expected: DataFrame, by: str = "doc_id") -> DataFrame:
    """Paragraphs of equal text in order (J7): by, a, e; one side is null where the other has no partner."""
    texts = lambda df, name: df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias(name))
    both = texts(actual, "a").join(texts(expected, "e"), by, "full_outer")

    fields = pa.schema([(by, pa.int64()), ("a", pa.int32()), ("e", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for documents in _slices(batches):
            rows = []
            for d, a, e in documents:
                a, e = a or [], e or []
                pairs = align.align_paragraphs([x["text"] for x in a], [x["text"] for x in e])
                met_a, met_e = {i for i, _ in pairs}, {j for _, j in pairs}
                rows += [(d, a[i]["i"], e[j]["i"]) for i, j in pairs]
                rows += [(d, x["i"], None) for n, x in enumerate(a) if n not in met_a] + [(d, None, x["i"]) for n, x in enumerate(e) if n not in met_e]
            yield pa.RecordBatch.from_pylist([dict(zip((by, "a", "e"), r, strict=True)) for r in rows], schema=fields)

    return both.select(F.col(by).cast("long").alias(by), "a", "e").mapInArrow(run, f"{by} long, a int, e int")


def compared(actual: DataFrame, expected: DataFrame, props: tuple[str, ...] = S.DEFAULT_PROPS, by: str = "doc_id") -> DataFrame:
    """All aligned paragraphs with both vectors, to draw differences and counts from.

    Both sides are read more than once, so vectors should be stored.
    """
    pairs = scratch.stored(aligned(actual, expected, by), "aligned")
    pack = lambda df, name: df.select(by, F.col("i").alias(name), F.struct(*df.columns).alias(f"v{name}"))
    return pairs.join(pack(actual, "a"), [by, "a"], "left").join(pack(expected, "e"), [by, "e"], "left").select(by, "a", "e", "va", "ve")


def against(vectors: DataFrame, spec: dict, by: str = "doc_id") -> DataFrame:
    """Paragraphs beside what a specification expects of them, as ``compared`` has them.

    Both sides hold the same texts in the same order, which alignment pairs one
    by one; so a paragraph meets itself where it is, and vectors are read once.
    """
    own = [c for c in vectors.columns if c != "runs"]  # no property is told from runs
    beside = apply_spec(vectors.select(*own, F.struct(*own).alias("va")), spec)
    return beside.select(by, F.col("i").alias("a"), F.col("i").alias("e"), "va", F.struct(*own).alias("ve"))


def style_diff(pairs: DataFrame, props: tuple[str, ...] = S.DEFAULT_PROPS, by: str = "doc_id") -> DataFrame:
    """Properties that the expected side declares and the actual one lacks (V7)."""
    a, e = (lambda k: F.col(f"va.{k}")), (lambda k: F.col(f"ve.{k}"))
    entries = []
    for k in props:
        if k == "indent_in":
            want, have = (S.indent_inches(s("indent_in"), s("indent_chars"), s("size_pt")) for s in (e, a))
            declared = e("indent_in").isNotNull() | e("indent_chars").isNotNull()
        else:
            want, have, declared = e(k), a(k), e(k).isNotNull()
        entries.append(F.when(declared & ~S.near(have, want, k), F.struct(F.lit(S.LABELS[k]).alias("prop"), S.shown(want, k).alias("expect"), S.shown(have, k).alias("actual"))))
    found = F.filter(F.array(*entries), lambda x: x.isNotNull())
    met = pairs.where("a IS NOT NULL AND e IS NOT NULL")
    listed = met.select(by, F.col("a").alias("para"), a("text").alias("text"), found.alias("found"))
    # a text is cut once, not for every difference
    return listed.withColumn("text", F.when(F.size("found") > 0, T.brief(F.col("text")))).select(by, "para", "text", F.inline("found"))


def style_summary(pairs: DataFrame, diffs: DataFrame, by: str = "doc_id") -> DataFrame:
    """Counts per document (G8): differences, by property, aligned, one-sided and undeclared."""
    undeclared = sum(((F.col(f"ve.{k}").isNull() & F.col(f"va.{k}").isNotNull()).cast("int") for k in ("size_pt", "family")), F.lit(0))
    met = F.col("a").isNotNull() & F.col("e").isNotNull()
    per = pairs.groupBy(by).agg(
        F.count_if(met).alias("aligned"),
        F.count_if(F.col("e").isNull()).alias("only_actual"),
        F.count_if(F.col("a").isNull()).alias("only_expected"),
        F.sum(F.when(met, undeclared).otherwise(0)).alias("undeclared"),
    )
    props = diffs.groupBy(by, "prop").agg(F.count(F.lit(1)).alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "prop", "n"))), lambda x: F.concat(x["prop"], F.lit("×"), x["n"].cast("string")))
    total = props.groupBy(by).agg(F.sum("n").alias("total"), F.array_join(listed, "、").alias("by_prop"))
    return per.join(total, by, "left").fillna({"total": 0, "by_prop": ""})


def vectors_text(vectors: DataFrame, by: str = "doc_id") -> DataFrame:
    """Texts of all paragraphs, parted by blank lines (V8)."""
    packed = F.array_sort(F.collect_list(F.struct("i", "text")))
    return vectors.groupBy(by).agg(F.array_join(F.transform(packed, lambda x: x["text"]), "\n\n").alias("text"))


def joined_texts(pages: DataFrame) -> DataFrame:
    """``vectors_text`` of pages whose texts are in one row, as ``html_texts`` has them."""
    return pages.select("doc_id", F.array_join("texts", "\n\n").alias("text"))


def jump_line(vectors: DataFrame, prefix: Column, by: str = "doc_id") -> DataFrame:
    """First paragraph that starts with the prefix, or that the prefix starts with."""
    return vectors.where(F.startswith("text", prefix) | F.startswith(prefix, F.col("text"))).groupBy(by).agg(F.min("i").alias("i"))


def jump_text(pages: DataFrame, prefix: Column) -> DataFrame:
    """``jump_line`` of pages whose texts are in one row, as ``html_texts`` has them."""
    hits = F.transform("texts", lambda t: F.startswith(t, prefix) | F.startswith(prefix, t))
    return pages.select("doc_id", (F.array_position(hits, True) - 1).cast("int").alias("i")).where("i >= 0")


def check(pages: DataFrame, documents: DataFrame, spec: dict | None = None, container: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Differences and summaries of documents against pages (V9).

    The page's styles (doc_id, html) are what is expected, those of the
    document (doc_id, document, styles) what is there; with a ``spec`` its
    expectations are laid over the page's paragraphs.
    """
    expected = scratch.stored(html_vectors(pages, container), "vectors")
    met = compared(scratch.stored(docx_vectors(documents), "vectors"), apply_spec(expected, spec) if spec else expected)
    found = style_diff(met)
    return found, style_summary(met, found)
