"""Images and recognized text as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernel import image as K
from ..sources import scratch
from . import rows as R
from .style import few

POINT = "struct<x:double,y:double>"


def _mapped(df: DataFrame, columns: list[str], make, schema: str) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in few(frames):
            yield pd.DataFrame([r for row in f.itertuples(index=False) for r in make(*row)], columns=names)

    return df.select(*columns).mapInPandas(run, schema)


def seam_bands(images: DataFrame) -> DataFrame:
    """Seams of PNG images (id, content)."""

    def make(i: int, content: bytes) -> list[tuple]:
        img = K.decode_png(bytes(content))
        return [(i, s["kind"], s["y0"], s["y1"]) for s in K.seams(K.ink(img), K.row_hashes(img))]

    return _mapped(images, ["id", "content"], make, "id long, kind string, y0 int, y1 int")


def ink_bands(images: DataFrame, size: int = 200) -> DataFrame:
    """Average ink of bands of rows."""
    return _mapped(images, ["id", "content"], lambda i, c: [(i, y, v) for y, v in K.bands(K.ink(K.decode_png(bytes(c))), size)], "id long, y int, ink double")


def frame_quality(images: DataFrame) -> DataFrame:
    """Dark, colourful and worst-band percentages."""
    return _mapped(images, ["id", "content"], lambda i, c: [(i, *K.ratios(K.decode_png(bytes(c))).values())], "id long, dark double, colorful double, worst_band double")


def ocr_boxes(maps: DataFrame) -> DataFrame:
    """Text boxes of probability maps (id, w, prob)."""

    def make(i: int, w: int, prob) -> list[tuple]:
        return [(i, n, b["box"], b["score"]) for n, b in enumerate(K.boxes(np.asarray(prob, float).reshape(-1, w)))]

    return _mapped(maps, ["id", "w", "prob"], make, f"id long, n int, box array<{POINT}>, score double")


def ctc_decode(rows: DataFrame, letters: list[str]) -> DataFrame:
    """Text and confidence of class probabilities (id, probs: array of arrays)."""
    return _mapped(rows, ["id", "probs"], lambda i, p: [(i, *K.ctc(np.array([list(x) for x in p], float), letters))], "id long, text string, conf double")


#: Least confidence of a recognized line.
LEAST_CONFIDENCE = 0.25


@dataclass(frozen=True)
class Models:
    """The caller's models, each from the prepared input of one image to its output.

    ``detect``: to a probability map as large as the input; ``classify``: to
    the weights of upright and turned by 180 degrees; ``recognize``: to
    weights per step and letter; ``letters``: what the letters are, the first
    being none.
    """

    detect: Callable[[np.ndarray], np.ndarray]
    classify: Callable[[np.ndarray], np.ndarray]
    recognize: Callable[[np.ndarray], np.ndarray]
    letters: list[str]


def recognized_lines(img: np.ndarray, models: Models) -> list[dict]:
    """Lines of one image (F48): box, text, conf, low_conf, turned; found, cut out, turned upright, read."""
    given = K.detector_input(img)
    prob = np.asarray(models.detect(given), float).reshape(given.shape[1:])
    out = []
    for b in K.boxes(prob, img.shape[1] / prob.shape[1], img.shape[0] / prob.shape[0]):
        cut = K.warped(img, [(p["x"], p["y"]) for p in b["box"]])
        turned = bool(np.argmax(np.ravel(models.classify(K.classifier_input(cut)))) == 1)
        probs = np.asarray(models.recognize(K.recognizer_input(K.rotated(cut, 2) if turned else cut)), float)
        text, conf = K.ctc(probs, models.letters)
        out.append({"box": b["box"], "text": text, "conf": conf, "low_conf": conf < LEAST_CONFIDENCE, "turned": turned})
    return out


RECOGNIZED = f"doc_id long, page int, i int, box array<{POINT}>, text string, conf double, low_conf boolean, turned boolean, error string"


def recognized(pages: DataFrame, models: Callable[[], Models]) -> DataFrame:
    """Lines of the pages (doc_id, page, content as PNG) of documents in reading order.

    Gives doc_id, page, n (in reading order), text, conf, box, low_conf and
    error. ``models`` is called once per task, where the pages are. Pages
    without content or whose image cannot be decoded are passed over. If a
    model fails on a page, its document has one row with the error of its
    first such page and no lines. Documents without lines have no rows.
    ``text_items`` makes page items of the lines.
    """
    names = [c.split(" ")[0] for c in RECOGNIZED.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = None
        for f in frames:
            out = []
            for doc, page, content in f.itertuples(index=False):
                try:
                    img = K.decode_png(bytes(content))[..., :3]
                except Exception:  # cannot be rendered: passed over
                    continue
                try:
                    own = own or models()
                    out += [(doc, page, i, x["box"], x["text"], x["conf"], x["low_conf"], x["turned"], None) for i, x in enumerate(recognized_lines(img, own))]
                except Exception as e:
                    out.append((doc, page, -1, None, None, None, None, None, str(e)))
            if out:
                yield pd.DataFrame(out, columns=names)

    found = scratch.stored(pages.select("doc_id", "page", "content").mapInPandas(run, RECOGNIZED), "recognized")
    failed = found.where("error IS NOT NULL").groupBy("doc_id").agg(F.min_by("error", "page").alias("error"), F.min("page").alias("page"))
    lines = found.where("error IS NULL").join(failed.select("doc_id"), "doc_id", "left_anti")
    top, bottom = F.array_min(F.transform("box", lambda p: p["y"])), F.array_max(F.transform("box", lambda p: p["y"]))
    placed = lines.withColumns({"top": top, "height": bottom - top, "left": F.array_min(F.transform("box", lambda p: p["x"])), "_at": F.struct("doc_id", "page")})
    ordered = R.reading_order(placed, "_at").withColumn("n", F.col("position").cast("int"))
    good = ordered.select("doc_id", "page", "n", "text", "conf", "box", "low_conf", F.lit(None).cast("string").alias("error"))
    none = lambda c: F.lit(None).cast(good.schema[c].dataType).alias(c)
    return good.unionByName(failed.select("doc_id", "page", *[none(c) for c in ("n", "text", "conf", "box", "low_conf")], "error"))


def text_items(lines: DataFrame, page_height: Column, scale: Column) -> DataFrame:
    """Recognized lines as page items (F49, X6): y upward, running line numbers over the pages.

    Lines of low confidence and without text stay out. ``lines``: doc_id,
    page, n, text, box, low_conf.
    """
    good = lines.where("NOT low_conf AND text <> ''")
    q = lambda k, axis: F.col("box")[k][axis]
    x0, x1 = F.least(q(0, "x"), q(3, "x")) / scale, F.greatest(q(1, "x"), q(2, "x")) / scale
    top = (page_height * scale - F.least(q(0, "y"), q(1, "y"))) / scale
    bottom = (page_height * scale - F.greatest(q(2, "y"), q(3, "y"))) / scale
    high = F.greatest(F.lit(0.0), top - bottom)
    size = F.when(high > 0, high).otherwise(12.0)
    running = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "n"))
    return good.select(
        "doc_id", "page", running.alias("line"), F.lit(0).alias("col"), F.col("text").alias("str"),
        F.array(size, F.lit(0.0), F.lit(0.0), size, x0, bottom).alias("transform"),
        F.greatest(F.lit(0.0), x1 - x0).alias("width"), F.lit(True).alias("has_eol"), F.lit(True).alias("ocr"),
    )


def item_text(items: DataFrame) -> DataFrame:
    """Text of each document's items (S21): line feeds where an item ends a line, pages parted by one."""
    per = items.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line", "col", F.concat("str", F.when(F.col("has_eol"), "\n").otherwise("")).alias("t")))).alias("p"))
    page = per.select("doc_id", "page", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("t"))
    return page.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]), "\n").alias("text"), F.count(F.lit(1)).alias("pages"))


def scanned(texts: DataFrame) -> DataFrame:
    """Documents with pages but no text, which need recognition."""
    return texts.where((F.col("pages") > 0) & (F.regexp_replace("text", r"\s", "") == ""))


def affine(a: list[Column], b: list[Column]) -> list[Column]:
    """Product of two 2-D transforms [a..f]."""
    return [
        a[0] * b[0] + a[2] * b[1], a[1] * b[0] + a[3] * b[1],
        a[0] * b[2] + a[2] * b[3], a[1] * b[2] + a[3] * b[3],
        a[0] * b[4] + a[2] * b[5] + a[4], a[1] * b[4] + a[3] * b[5] + a[5],
    ]


def page_scale(mode: str, width: Column, height: Column, view_width: float, view_height: float, zoom: float = 1.0, by: str = "doc_id") -> Column:
    """Scale of a document's pages (X5): actual, page (all fit), auto (width, not enlarged) or width."""
    w = Window.partitionBy(by)
    if mode == "actual":
        return F.lit(1.0)
    if mode == "page":
        return F.min(F.least(F.lit(view_width) / width, F.lit(view_height) / height)).over(w)
    fit = F.lit(view_width) / F.max(width).over(w)
    return F.least(fit, F.lit(1.0)) * zoom if mode == "auto" else F.greatest(fit, F.lit(0.1))


def highlight(item: str, start: Column, stop: Column) -> dict[str, Column]:
    """Rectangle of a part of an item in page units (D18); recognized items are centred on their box."""
    t, ocr = F.col(f"{item}.transform"), F.col(f"{item}.ocr")
    size = F.sqrt(t[2] * t[2] + t[3] * t[3])
    n = F.greatest(F.length(f"{item}.str"), F.lit(1))
    high = size * F.when(ocr, 0.81).otherwise(1.0)
    centre = t[5] + size * F.when(ocr, 0.5).otherwise(0.465)
    width = F.col(f"{item}.width")
    return {"x": t[4] + width * start / n, "width": width * (stop - start) / n, "y": centre - high / 2, "height": high}
