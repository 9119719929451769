"""Language identification by interpolated Kneser-Ney character models.

One model per language, all in shared sorted hash arrays: for each order the
sorted hashes of all character n-grams seen and a matrix of their log
probabilities by language, and the same for contexts and their back-off
weights. The language of the lowest cross-entropy per character wins; texts
whose entropy lies beyond what held-back training texts show are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, per_text, stored

ORDER = 4
#: Training texts per language, in expectation: those of the least hashes.
DOCS_PER_LANGUAGE = 400
#: Training texts of all languages, in expectation; with very many languages each gives fewer.
MOST_DOCS = 20_000
#: Languages up to which their shares are broadcast.
MOST_BROADCAST = 10_000
#: Every so many-th training text is held back to set the rejection limits.
HELD_BACK = 5
#: Letters scored at a time.
STRIDE = 1_000_000
#: Letters after which more text makes the score no surer.
SURE = 100
UNKNOWN = "und"
#: Least probability, per language, that a letter was never seen; margin of the rejection limit in nats.
UNSEEN, MARGIN = 0.01, 0.75

_PRIME = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def symbols(text: str | None) -> np.ndarray:
    """Lower-cased letters; every run of other characters, and either end, is one 0."""
    if not text:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    raw = np.where(letters()[raw], raw, 0)
    kept = (raw != 0) | np.r_[True, raw[:-1] != 0]
    raw = raw[kept]
    if not raw.any():
        return np.zeros(0, np.uint32)
    raw = raw[int(raw[0] == 0) : len(raw) - int(raw[-1] == 0)]
    return np.r_[np.zeros(1, np.uint32), raw, np.zeros(1, np.uint32)].astype(np.uint32)


def hashes(s: np.ndarray) -> list[np.ndarray]:
    """h[n][i]: hash of the n symbols that end at i (h[0]: zeros)."""
    out = [np.zeros(len(s), np.uint64)]
    wide = s.astype(np.uint64) + np.uint64(1)
    for n in range(1, ORDER + 1):
        before = np.r_[np.zeros(1, np.uint64), out[n - 1][:-1]]
        mixed = (before ^ (before >> np.uint64(29))) * _PRIME + wide * np.uint64(0xD1B54A32D192ED03 + 2 * n)
        out.append(mixed ^ (mixed >> np.uint64(32)))
    return out


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in the sorted ``keys``, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Model:
    languages: list[str]
    grams: list[np.ndarray]  # by order, from 1
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    floor: float
    limit: np.ndarray  # by language: entropy beyond which a text is rejected
    slack: np.ndarray  # by language: added over the root of the letters

    def sums(self, s: np.ndarray, skip: int) -> np.ndarray:
        """Log probability by language of s[skip:]."""
        h = hashes(s)
        width = len(self.languages)
        total = np.zeros(width)
        live = np.arange(skip, len(s))
        for n in range(ORDER, 0, -1):
            at = find(self.grams[n - 1], h[n][live])
            hit = at >= 0
            total += self.logs[n - 1].take(at[hit], 0).sum(0, dtype=np.float64)
            live = live[~hit]
            if not len(live):
                return total
            ctx = find(self.contexts[n - 1], h[n - 1][live - 1])
            total += self.weights[n - 1].take(ctx[ctx >= 0], 0).sum(0, dtype=np.float64)
        return total + self.floor * len(live)

    def entropies(self, s: np.ndarray) -> np.ndarray:
        """Cross-entropy per symbol by language, the text taken in strides."""
        pad = ORDER - 1
        s = np.r_[np.zeros(pad, np.uint32), s]
        total = np.zeros(len(self.languages))
        for at in range(pad, len(s), STRIDE):
            total += self.sums(s[at - pad : at + STRIDE], pad)
        return -total / max(1, len(s) - pad)

    def judge(self, text: str | None) -> tuple[str, float, bool, float | None]:
        """Language, score, whether rejected, cross-entropy."""
        s = symbols(text)
        if not len(s) or not self.languages:
            return UNKNOWN, 0.0, True, None
        e = self.entropies(s)
        best = int(e.argmin())
        score = 1 / np.exp(-(e - e[best]) * min(len(s), SURE)).sum()
        rejected = e[best] > self.limit[best] + self.slack[best] / np.sqrt(len(s))
        return self.languages[best], float(score), bool(rejected), float(e[best])


def _counted(texts: list[np.ndarray]) -> tuple[list, list]:
    """Of one language, by order from 1: (grams, probabilities, contexts, weights) and the grams' (context, suffix) hashes."""
    pad = np.zeros(ORDER - 1, np.uint32)
    s = np.concatenate([np.r_[pad, t] for t in texts]) if texts else pad
    own = np.concatenate([np.r_[np.zeros(ORDER - 1, bool), np.ones(len(t), bool)] for t in texts]) if texts else np.zeros(len(pad), bool)
    h = hashes(s)
    pos = np.flatnonzero(own)
    tables: list = [None] * ORDER
    for n in range(ORDER, 0, -1):
        keys, first, counts = np.unique(h[n][pos], return_index=True, return_counts=True)
        pos = pos[first]  # lower orders count each longer gram once
        tables[n - 1] = [keys, pos, counts]
    model, links = [], []
    for n, (keys, pos, counts) in enumerate(tables, 1):
        ones, twos = (counts == 1).sum(), (counts == 2).sum()
        discount = ones / (ones + 2 * twos) if ones else 0.5
        context, suffix = h[n - 1][pos - 1] if n > 1 else np.zeros(len(pos), np.uint64), h[n - 1][pos]
        ctx, inverse = np.unique(context, return_inverse=True)
        sums = np.bincount(inverse, counts, len(ctx))
        weights = discount * np.bincount(inverse, minlength=len(ctx)) / np.maximum(sums, 1)
        own_part = np.maximum(counts - discount, 0) / np.maximum(sums[inverse], 1) if len(ctx) else np.zeros(0)
        model.append([keys, own_part, ctx, weights, inverse])
        links.append((context, suffix))
    return model, links


def train(samples: dict[str, list[str]]) -> Model:
    """Models of the languages in ``samples`` (language -> texts)."""
    languages = sorted(samples)
    cut = {k: [x for t in samples[k] if len(x := symbols(t))] for k in languages}
    languages = [k for k in languages if cut[k]]
    fit = {k: [t for i, t in enumerate(cut[k]) if i % HELD_BACK or len(cut[k]) < HELD_BACK] for k in languages}
    floor_p = 1 / (1 + len(np.unique(np.concatenate([t for k in languages for t in cut[k]])))) if languages else 1.0
    parts = {k: _counted(fit[k]) for k in languages}
    grams, logs, contexts, weights = [], [], [], []
    for n in range(1, ORDER + 1):
        lower = {}
        for k in languages:
            keys, own, _, w, inverse = parts[k][0][n - 1]
            suffix = parts[k][1][n - 1][1]
            below = parts[k][0][n - 2][1][find(parts[k][0][n - 2][0], suffix)] if n > 1 else np.full(len(keys), floor_p)
            lower[k] = own + w[inverse] * below
        for k in languages:
            parts[k][0][n - 1][1] = lower[k]
        every = [(parts[k][0][n - 1][0], *parts[k][1][n - 1]) for k in languages]
        union, first = np.unique(np.concatenate([e[0] for e in every]), return_index=True) if every else (np.zeros(0, np.uint64), np.zeros(0, int))
        context = np.concatenate([e[1] for e in every])[first] if every else union
        suffix = np.concatenate([e[2] for e in every])[first] if every else union
        ctx = np.unique(np.concatenate([parts[k][0][n - 1][2] for k in languages])) if every else union
        matrix, back = np.zeros((len(union), len(languages))), np.zeros((len(ctx), len(languages)))
        for j, k in enumerate(languages):
            keys, p, own_ctx, w, _ = parts[k][0][n - 1]
            at = find(own_ctx, ctx)
            back[:, j] = np.where(at >= 0, np.log(np.maximum(w[at], UNSEEN if n == 1 else 1e-12)), 0.0)
            at = find(keys, union)
            below = logs[n - 2][find(grams[n - 2], suffix), j] if n > 1 else np.full(len(union), np.log(floor_p))
            fall = back[find(ctx, context), j] + below
            matrix[:, j] = np.where(at >= 0, np.log(np.maximum(p[at], 1e-12)), fall)
        grams.append(union)
        logs.append(matrix)
        contexts.append(ctx)
        weights.append(back)
    model = Model(languages, grams, [m.astype(np.float32) for m in logs], contexts, [m.astype(np.float32) for m in weights], float(np.log(floor_p)), np.zeros(len(languages)), np.zeros(len(languages)))
    for j, k in enumerate(languages):
        held = [t for i, t in enumerate(cut[k]) if i % HELD_BACK == 0]
        e = np.array([model.entropies(t)[j] for t in held])
        n = np.array([len(t) for t in held])
        mean = np.average(e, weights=n)
        z = (e - mean) * np.sqrt(np.minimum(n, SURE))  # short texts spread more, as the root of their length
        model.limit[j] = mean + 6 * np.sqrt(np.average((e - mean) ** 2, weights=n)) + MARGIN
        model.slack[j] = 6 * float(np.sqrt(np.mean(z**2))) + 2
    return model


def training_texts(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """(doc_id, text, lang) of a bounded sample of the documents that may teach.

    Those have a text, a language, and crc32(doc_id) mod 5 not 0. From each
    language those with the least hashes come, ``docs_per_language`` expected
    and ``MOST_DOCS`` in all: the bound of the sample. Whole texts.
    """
    may = docs.where((F.crc32(id_text("doc_id")) % 5 != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = stored(may.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    languages = sizes.count()
    each = float(min(docs_per_language, MOST_DOCS / max(1, languages)))
    share = sizes.select("lang", (F.lit(each) / F.col("n")).alias("share"))
    point = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    rows = may.select("doc_id", "text", "lang")
    joined = rows.join(F.broadcast(share) if languages <= MOST_BROADCAST else share, "lang")
    return joined.where(point < F.col("share")).select("doc_id", "text", "lang")


def fitted(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    got: dict[str, list[str]] = {}
    for row in training_texts(docs, docs_per_language).sort("lang", "doc_id", "text").toLocalIterator():
        got.setdefault(row["lang"], []).append(row["text"])
    return train(got)


def identify(docs: DataFrame, model: Model, text: str = "text", into: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Add predicted language, score and rejection to every row; texts are read whole.

    ``und``, 0 and rejected for a text that is null or without letters, and
    for all texts if the model knows no language. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    fields = f"`{into[0]}` string, `{into[1]}` double, `{into[2]}` boolean"
    return per_text(docs, lambda texts: list(zip(*[shared.value.judge(t)[:3] for t in texts], strict=True)), fields, text)


def identified_documents(docs: DataFrame) -> DataFrame:
    """Query op5. A null doc_id counts as the empty text."""
    out = identify(docs.select("doc_id", "text"), fitted(docs))
    return out.select("doc_id", (F.crc32(id_text("doc_id")) % 5 == 0).alias("held_out"), "lang_pred", "score", "rejected")
