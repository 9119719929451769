"""Quality rules on repetition, by suffix arrays.

The words of a text are numbered and its suffix array is built by prefix
doubling; intervals of the longest-common-prefix array give the maximal
repeated substrings. Their spans' union and the longest one are limited.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import WORD, per_text

WORDS = re.compile(WORD)
SYMBOLS = re.compile(r"[#*$%&|<>]")
WINDOW = 5
#: Limits of the method's verdict: repeats under LEAST words don't count.
LEAST, MOST_COVERED, MOST_LONGEST = 10, 0.15, 50
#: Words of the texts that share one suffix array.
TOGETHER = 400_000


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and rank of ``ids``; every round sorts only what still ties."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    first = np.r_[True, ids[order][1:] != ids[order][:-1]]
    start = np.flatnonzero(first)  # a group's rank is its first place
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(start, np.diff(np.r_[start, n]))
    tied = np.flatnonzero(~(first & np.r_[first[1:], True]))  # places in groups of several
    h = 1
    while len(tied):
        who = order[tied]
        ahead = who + h
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        by = np.lexsort((second, rank[who]))
        who, second = who[by], second[by]
        mine = rank[who]
        order[tied] = who
        new = np.r_[True, (mine[1:] != mine[:-1]) | (second[1:] != second[:-1])]
        begins = np.flatnonzero(new)
        rank[who] = np.repeat(tied[begins], np.diff(np.r_[begins, len(tied)]))
        tied = tied[~(new & np.r_[new[1:], True])]
        h *= 2
    return order, rank


def longest_repeats(ids: np.ndarray) -> np.ndarray:
    """For each position the length of the longest substring from it that occurs elsewhere too.

    It is the larger of the two common prefixes with the neighbours in the
    suffix array: the depth of the innermost interval that holds the suffix.
    """
    n = len(ids)
    if n < 2:
        return np.zeros(n, np.int64)
    order, rank = suffix_array(ids)
    lcp = kasai(ids, order, rank)
    best = np.maximum(lcp, np.r_[lcp[1:], 0])
    out = np.empty(n, np.int64)
    out[order] = best
    return out


def kasai(ids: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """lcp[i] of the suffixes at places i - 1 and i (lcp[0] = 0), by comparing irreducible positions only."""
    n = len(ids)
    before = np.full(n, -1, np.int64)  # the suffix before each one, by text position
    before[order[1:]] = order[:-1]
    # plcp[p] >= plcp[p - 1] - 1: only positions where the chain breaks are compared
    breaks = np.ones(n, bool)
    both = (before[1:] > 0) & (before[:-1] >= 0) & (before[1:] == before[:-1] + 1)
    breaks[1:][both] = ids[:-1][both] != ids[before[:-1][both]]
    plcp = np.zeros(n, np.int64)
    live = np.flatnonzero(breaks & (before >= 0))
    a, b, start = live.copy(), before[live].copy(), live.copy()
    while len(start):
        inside = (a < n) & (b < n)
        same = inside & (ids[np.minimum(a, n - 1)] == ids[np.minimum(b, n - 1)])
        start, a, b = start[same], a[same] + 1, b[same] + 1
        plcp[start] += 1
    heads = np.flatnonzero(breaks)
    of = heads[np.cumsum(breaks) - 1]
    plcp = np.maximum(plcp[of] - (np.arange(n) - of), 0)
    return plcp[order]


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Positions inside the union of all repeats of at least ``least`` words."""
    n = len(longest)
    reach = np.where(longest >= least, np.arange(n) + longest, 0)
    return np.maximum.accumulate(reach) > np.arange(n)


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(lines) - len(set(lines))


def measured(texts: list[str | None]) -> pd.DataFrame:
    """The measures of each text; batches of texts share a suffix array, parted by unique marks."""
    rows: list[tuple] = []
    batch: list[list[str]] = []
    held = 0

    def flush() -> Iterator[tuple[int, int, int]]:
        number: dict[str, int] = defaultdict(count().__next__)
        sizes = [len(w) for w in batch]
        flat = np.empty(sum(sizes) + len(sizes), np.int64)
        at, spans = 0, []
        for i, words in enumerate(batch):
            flat[at : at + len(words)] = [number[w] for w in words]
            flat[at + len(words)] = -1 - i
            spans.append((at, at + len(words)))
            at += len(words) + 1
        # words of other texts must not count as repeats: number them apart
        owner = np.repeat(np.arange(len(sizes)), np.array(sizes) + 1)
        width = len(number) + 1
        apart = np.where(flat >= 0, owner * width + flat, flat)
        longest = longest_repeats(apart)
        short, long = covered(longest, WINDOW), covered(longest, LEAST)
        for s, e in spans:
            yield int(short[s:e].sum()), int(long[s:e].sum()), int(longest[s:e].max(initial=0))

    def done() -> None:
        nonlocal held
        for i, got in zip(range(len(rows) - len(batch), len(rows)), list(flush()), strict=True):
            rows[i] += got
        batch.clear()
        held = 0

    for t in texts:
        t = t if isinstance(t, str) else ""
        words = WORDS.findall(t)
        rows.append((len(words), sum(map(len, words)), len(SYMBOLS.findall(t)), duplicate_lines(t) if words else 0))
        batch.append(words)
        held += len(words) + 1
        if held >= TOGETHER:
            done()
    if batch:
        done()
    out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"])
    out["base_failed"] = (out.n_words < 10) | (100 * out.n_repeat_words > 20 * out.n_words)
    out["kept"] = ~out.base_failed & (out.covered_words <= MOST_COVERED * out.n_words) & (out.longest_repeat <= MOST_LONGEST)
    return out


def repetition_rules(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts, ``base_failed``, the method's measures and ``kept``.

    A null or empty text has no words and fails the base rule; repeated rows
    each get a row. No shuffle.
    """

    fields = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, base_failed boolean, kept boolean"

    def judge(texts: list[str | None]) -> list:
        got = measured(texts)
        return [got[c].to_numpy() for c in got.columns]

    return per_text(docs, judge, fields, text, keep=[id_col])
