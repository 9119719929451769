"""Texts out of files of any kind: one row per file, whatever becomes of it."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import web as W
from ..kernel import markup, ooxml

#: Reads one file: (path, content) to its text.
Reader = Callable[[str, bytes], str]


class EnvironmentFailure(Exception):
    """What a reader raises if not the file is at fault but what reading needs; it stops the file's volume."""


def read_text(path: str, content: bytes) -> str:
    """UTF-8, or UTF-16 by its mark; bad bytes are replaced."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return content.decode(name, "replace")
    return content.decode("utf-8", "replace")


def read_page(path: str, content: bytes) -> str:
    """Paragraphs of a saved page, parted by blank lines (S7, V8), in the charset its head names."""
    named = re.search(rb"""<meta[^>]+charset\s*=\s*["']?([A-Za-z0-9_-]+)""", content[:4096], re.I)
    try:
        text = content.decode(named[1].decode() if named else "utf-8", "replace")
    except LookupError:
        text = content.decode("utf-8", "replace")
    return "\n\n".join(p["text"] for p in markup.html_paragraphs(text))


def read_document(path: str, content: bytes) -> str:
    """Paragraphs of a document, parted by blank lines."""
    if error := ooxml.head_error(content, path):
        raise ValueError(error)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return "\n\n".join(markup.docx_texts(z.read("word/document.xml")))


def read_workbook(path: str, content: bytes) -> str:
    """Rows of all sheets as lines, cells parted by tabs."""
    book = ooxml.Workbook(content, path)
    return "\n".join("\t".join(row.get(c, "") for c in range(1, max(row, default=0) + 1)) for name in book.sheet_names for _, row in book.rows(name))


READERS: dict[str, Reader] = {"text": read_text, "web": read_page, "docx": read_document, "xlsx": read_workbook}


def loaded(files: DataFrame, readers: dict[str, Reader] | None = None, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Texts of files (path, content and ``keep``) by kind (B4): ``keep``, kind, text, error, environment.

    ``readers`` adds to the known ones or takes their place; kinds without a
    reader (``pdf`` without the caller's, old binary formats) are errors. A
    file that cannot be read has a null text and says why; it never fails the
    job. ``environment`` tells that reading failed for reasons outside the
    file (``EnvironmentFailure``). A null content is a missing file. Null
    paths are text.
    """
    known = READERS | (readers or {})
    kept = [c for c in keep if c != "path"]

    def read(kind: str, path: str, content: bytes | None) -> tuple:
        name = (path or "").rpartition("/")[2]
        if content is None:
            return None, f"{name}: no such file", False
        if kind not in known:
            return None, f"{name}: no reader for {kind} files", False
        try:
            return known[kind](path or "", bytes(content)), None, False
        except EnvironmentFailure as e:
            return None, f"{name}: {e}", True
        except Exception as e:  # any fault of a file becomes its row
            return None, f"{name}: {type(e).__name__}", False

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 64):
                part = f.iloc[at : at + 64]
                made = [read(k, p, c) for k, p, c in zip(part["_kind"], part["path"], part["content"], strict=True)]
                text, error, environment = zip(*made, strict=True)
                yield part.drop(columns=["content", "_kind"]).assign(kind=part["_kind"], text=text, error=error, environment=environment)

    given = files.select("path", *kept, F.col("content"), F.coalesce(W.file_kind(F.col("path")), F.lit("text")).alias("_kind"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.drop("content", "_kind").schema), "kind string, text string, error string, environment boolean"])
    return given.mapInPandas(run, schema)
