"""Best-fit packing of token sequences by a configuration linear program.

The program has one variable per way to fill a sequence (a configuration of
lengths) and one covering constraint per length. Multiplicative weights solve
it: a weight per length prices configurations, knapsack dynamic programming
finds the best one, and the weights of the lengths it covers fall.

First in coarse steps, as long as the scarcest length lasts, so that every use
is whole. That is near the optimum where there are many lengths. If it is not
within ``GAP`` of the lower bound, the program is solved in fine steps: uses
add up to a fractional solution, weights give feasible dual prices and so a
bound, until the two are within ``GAP``; uses are rounded down, and what is
left goes by best fit. The better of the two plans is taken.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import count
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, per_text, stored

CAPACITY = 1024
EOS = 2
#: Fall of a length's weight by the time all of it is covered: a factor of exp(-RATE).
RATE = 0.3
#: Distance to the bound within which a plan is good enough, and at which the fine steps end.
GAP = 0.002
#: Of the fine steps: how exactly weights tell the optimum, fall of a weight in a step, and most steps and priced configurations.
EXACT, STEP, MOST_STEPS, MOST_PRICED = 0.04, 0.01, 60_000, 3_000
#: Power of its length by which a piece is priced at first; above 1, long pieces, hard to place, come first.
SLOPE = 1.2
#: Pieces of one length in a bucket where pieces are numbered, and the most buckets in all.
PER_BUCKET, MOST_BUCKETS = 50_000, 500_000

Config = tuple[tuple[int, int], ...]  # (length, times), longest first


def best_config(value: np.ndarray, capacity: int) -> list[int]:
    """Lengths of the most valuable filling: unbounded knapsack by dynamic programming.

    value[l] is the price of length l, -inf if there is none; value[0] is unused.
    """
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        gain = value[1 : c + 1] + best[c - 1 :: -1][:c]
        i = int(gain.argmax())
        if gain[i] > best[c - 1]:
            best[c], took[c] = gain[i], i + 1
        else:
            best[c] = best[c - 1]
    out, c = [], capacity
    while c > 0:
        if took[c]:
            out.append(int(took[c]))
            c -= int(took[c])
        else:
            c -= 1
    return out


def filling(price: np.ndarray, left: np.ndarray, capacity: int) -> Counter[int]:
    """The most valuable filling of a sequence by pieces that are left: length -> times.

    The knapsack has no bound on a length's pieces; one that runs out stays
    as it is, and the rest of the room is filled without it.
    """
    price, config, room = price.copy(), Counter(), capacity
    while room:
        times = Counter(best_config(price, room))
        for length, mult in times.items():
            took = min(mult, int(left[length]) - config[length])
            config[length] += took
            room -= took * length
            if config[length] == left[length]:
                price[length] = -np.inf
        if not times or all(price[length] > -np.inf for length in times):
            break
    return Counter({length: mult for length, mult in config.items() if mult})


def program(counts: np.ndarray, capacity: int, rounds: int | None = None) -> tuple[Counter[Config], np.ndarray]:
    """Configurations with whole numbers of uses, and the pieces of each length that they leave.

    A weight per length prices configurations, knapsack dynamic programming
    finds the best one, and it is used as long as its scarcest length lasts;
    the weights of what it covers fall by a factor. So nothing is covered
    twice, every round ends a length or a part of one, and rounds follow the
    lengths and not the pieces. All is covered at the end, unless ``rounds``
    stops before.
    """
    n, left = np.maximum(counts, 1).astype(float), counts.astype(np.int64).copy()
    start = (np.arange(len(n)) / capacity) ** SLOPE
    out: Counter[Config] = Counter()
    for _ in count() if rounds is None else range(rounds):
        if not left.any():
            break
        config = filling(np.where(left > 0, start * np.exp(-RATE * (1 - left / n)), -np.inf), left, capacity)
        lengths, mult = np.array(list(config)), np.array(list(config.values()))
        uses = int((left[lengths] // mult).min())
        out[tuple(sorted(config.items(), reverse=True))] += uses
        left[lengths] -= uses * mult
    return out, left


def best_fit(left: np.ndarray, capacity: int, begun: Counter[Config] | None = None) -> Counter[Config]:
    """Longest first, each into the fullest open sequence that has room; ``begun`` are open at first.

    Equal sequences are one entry with their number. A sequence takes pieces of
    one length until it has no room for another, so the work follows the
    lengths and not the pieces.
    """
    open_: dict[int, Counter[Config]] = defaultdict(Counter)  # by room
    done: Counter[Config] = Counter()
    for config, times in (begun or {}).items():
        room = capacity - sum(a * b for a, b in config)
        (open_[room] if room else done)[config] += times

    def put(config: Config, space: int, length: int, mult: int, times: int) -> None:
        if times and mult:
            config, space = (*config, (length, mult)), space - length * mult
        if times:
            (open_[space] if space else done)[config] += times

    for length in range(len(left) - 1, 0, -1):
        n = int(left[length])
        for space in sorted(s for s in open_ if s >= length):
            each = space // length
            for config, times in sorted(open_.pop(space).items()):
                full = min(times, n // each)
                rest = min(n - full * each, each) if full < times else 0
                put(config, space, length, each, full)
                put(config, space, length, rest, int(full < times))
                put(config, space, length, 0, max(times - full - 1, 0))
                n -= full * each + rest
            if not n:
                break
        each = capacity // length
        put((), capacity, length, each, n // each)
        put((), capacity, length, n % each, int(n % each > 0))
    for held in open_.values():
        done += held
    return done


class Knapsack:
    """The most valuable filling of a sequence by given lengths, any number of each.

    Room is looked at in blocks of the least length, whose values depend on
    earlier blocks alone.
    """

    def __init__(self, lengths: np.ndarray, capacity: int) -> None:
        self.lengths, self.capacity = lengths, capacity
        self.blocks = []
        step = int(lengths[0])
        for at in range(step, capacity + 1, step):
            room = np.arange(at, min(at + step, capacity + 1))
            fits = lengths[lengths <= room[-1]]
            back = room[:, None] - fits
            self.blocks.append((room, np.where(back < 0, 0, back), np.where(back < 0, -np.inf, 0.0)))

    def best(self, value: np.ndarray) -> tuple[Counter[int], float]:
        """(index of length -> times, its value) for positive values."""
        worth, took = np.zeros(self.capacity + 1), np.full(self.capacity + 1, -1)
        for room, back, never in self.blocks:
            gain = worth[back] + value[: back.shape[1]] + never
            took[room] = gain.argmax(1)
            worth[room] = gain[np.arange(len(room)), took[room]]
        out: Counter[int] = Counter()
        c = self.capacity
        while c >= self.lengths[0]:
            out[int(took[c])] += 1
            c -= int(self.lengths[took[c]])
        return out, float(worth[self.capacity])


def fractional(counts: np.ndarray, capacity: int) -> tuple[dict[Config, float], float]:
    """Uses of configurations that cover all counts, and the lower bound of the number of sequences.

    A step uses the configuration of the best price until a share of its
    scarcest length is covered; weights fall exponentially with the share
    covered. Configurations once priced are tried first; the knapsack is
    solved only if none of them is within ``GAP / 2`` of the last best price,
    which bounds later ones as prices only fall. The prices over the best one
    are a feasible dual, the uses over the least share a feasible primal
    solution; the steps end when they are within ``GAP`` or at their limits.
    """
    lengths = np.flatnonzero(counts)
    need = counts[lengths].astype(float)
    knapsack, eta = Knapsack(lengths, capacity), 1 + np.log(len(lengths) + 1) / EXACT
    cover = np.zeros(len(lengths))
    index, times, use = np.zeros((64, 4), np.int64), np.zeros((64, 4)), np.zeros(64)
    seen: dict[Config, int] = {}
    bound, top, top_at, priced = (need * lengths).sum() / capacity, np.inf, 0.0, 0
    for step in range(MOST_STEPS):
        low = cover.min()
        if step % 100 == 0 and low > 0 and use.sum() / low <= bound * (1 + GAP):
            break
        price = lengths / capacity * np.exp(-eta * (cover - low))
        values = (price[index[: len(seen)]] * times[: len(seen)]).sum(1)
        k = int(values.argmax()) if len(seen) else -1
        if k < 0 or values[k] < (1 - GAP / 2) * top * np.exp(eta * (low - top_at)):
            if priced == MOST_PRICED:
                break
            config, top = knapsack.best(price)
            top_at, priced = low, priced + 1
            bound = max(bound, float((need * price).sum()) / top)
            key = tuple(sorted(config.items()))
            k = seen.setdefault(key, len(seen))
            if k == len(use):
                index, times, use = (np.concatenate([x, np.zeros_like(x)]) for x in (index, times, use))
            if len(key) > index.shape[1]:
                index, times = (np.pad(x, ((0, 0), (0, len(key) - x.shape[1]))) for x in (index, times))
            index[k, : len(key)], times[k, : len(key)] = zip(*key, strict=True)
        own = times[k] > 0
        at, mult = index[k][own], times[k][own]
        amount = STEP / eta * (need[at] / mult).min()
        use[k] += amount
        cover[at] += mult * amount / need[at]
    scale = cover.min()
    if scale <= 0:
        return {}, bound
    return {tuple((int(lengths[i]), n) for i, n in reversed(key)): float(use[k] / scale) for key, k in seen.items()}, bound


def rounded(uses: dict[Config, float], counts: np.ndarray) -> tuple[Counter[Config], np.ndarray]:
    """Whole uses, rounded down and no more than there are pieces for, and the pieces left.

    Where a length that is covered twice runs out, a configuration goes on without it.
    """
    left, out = counts.astype(np.int64).copy(), Counter()
    for config, amount in sorted(uses.items(), key=lambda x: (-x[1], x[0])):
        n = int(amount + 1e-9)
        while n and config:
            most = min(n, min(int(left[a]) // b for a, b in config))
            if most:
                out[config] += most
                for a, b in config:
                    left[a] -= most * b
                n -= most
            config = tuple((a, b) for a, b in config if left[a] >= b) if n else config
    return out, left


def plan(counts: np.ndarray, capacity: int = CAPACITY, rounds: int | None = None) -> Counter[Config]:
    """How many sequences of each configuration pack ``counts[length]`` pieces of each length."""
    return bounded_plan(counts, capacity, rounds)[0]


def bounded_plan(counts: np.ndarray, capacity: int = CAPACITY, rounds: int | None = None) -> tuple[Counter[Config], float]:
    """A plan, and the number of sequences below which there is none.

    Best fit places what rounding, or a program cut short by ``rounds``,
    leaves, first into the room of the program's own sequences.
    """

    def filled(out: Counter[Config], left: np.ndarray) -> Counter[Config]:
        return best_fit(left, capacity, out) if left.any() else out

    coarse = filled(*program(counts, capacity, rounds))
    bound = float((counts * np.arange(len(counts))).sum() / capacity)
    if sum(coarse.values()) <= bound * (1 + GAP) + 1:
        return coarse, bound
    uses, bound = fractional(counts, capacity)
    fine = filled(*rounded(uses, counts))
    return min(coarse, fine, key=lambda p: sum(p.values())), bound


def plan_rows(configs: Counter[Config]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, copies per sequence, offset in it)."""
    ranks: Counter[int] = Counter()
    rows, sequence = [], 0
    for config, times in sorted(configs.items()):
        offset = 0
        for length, mult in config:
            rows.append((length, ranks[length], ranks[length] + times * mult, sequence, mult, offset))
            ranks[length] += times * mult
            offset += length * mult
        sequence += times
    return rows


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes.

    Printable bytes stand for themselves, the others follow from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def encoder(path: str, pattern: str):
    """An encoder over the vocabulary file's own ids.

    Merges of such a vocabulary are ranked by id, so a rank encoder gives the
    file's ids several times as fast; the tests hold it against the file's own
    library. It knows the file's added tokens, too; ``ids_of`` tells whether
    their strings in a text count as such.
    """
    import tiktoken

    vocabulary = json.loads(Path(path).read_text("utf-8"))
    letters = byte_letters()
    special = {t["content"]: t["id"] for t in vocabulary["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding(Path(path).stem, pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def ids_of(text: str, encode, added: bool = False) -> bytes:
    """Ids as little-endian unsigned 32-bit bytes; with ``added``, added tokens in the text get their own ids."""
    return np.asarray(encode.encode_to_numpy(text, allowed_special="all" if added else set(), disallowed_special=()), "<u4").tobytes()


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def tokenized(docs: DataFrame, tokenizer: str, pattern: str, text: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, eos: int = EOS, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: id, piece, start, length, ids_crc32 (and ids).

    A null or empty text is the end mark alone; added tokens of the vocabulary
    in a text get their ids, as its library does. No shuffle.
    """
    end = np.array([eos], "<u4").tobytes()

    def pieces(texts: list[str | None]) -> list:
        encode, out = encoder(tokenizer, pattern), []
        for t in texts:
            ids = (ids_of(t, encode, added=True) if t else b"") + end
            parts = [(i, s, n, ids[4 * s : 4 * (s + n)]) for i, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            out.append([{"piece": i, "start": s, "length": n, "ids_crc32": zlib.crc32(p)} | ({"ids": np.frombuffer(p, "<u4").tolist()} if with_ids else {}) for i, s, n, p in parts])
        return [out]

    kinds = "piece: int, start: bigint, length: bigint, ids_crc32: bigint" + (", ids: array<int>" if with_ids else "")
    made = per_text(docs, pieces, f"pieces array<struct<{kinds}>>", text, keep=[id_col], step=200)
    return made.select(id_col, F.inline("pieces"))


def packed(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, rounds: int | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces.

    The driver sees the histogram of lengths (at most ``capacity`` rows) and
    plans configurations; each piece finds its place by its rank among the
    pieces of its length, dealt over more buckets the more there are. The
    plan has a row per configuration and length, a few thousand however
    large the corpus, so it is broadcast. Pieces that fill a sequence need
    neither rank nor plan: each has a sequence of its own, numbered below 0.
    An empty table stays empty.
    """
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().toLocalIterator():
        counts[row["length"]] = row["count"]
    counts[capacity] = 0
    rows = plan_rows(plan(counts, capacity, rounds))
    places = spark.createDataFrame(rows, "length long, low long, high long, first long, copies long, base long")
    per = max(PER_BUCKET, int(counts.sum()) // MOST_BUCKETS)
    buckets = spark.createDataFrame([(n, int(-(-counts[n] // per))) for n in np.flatnonzero(counts).tolist()], "length long, buckets int")
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    part = pieces.where(F.col("length") < capacity).join(F.broadcast(buckets), "length")
    ranked, _ = numbered(part, [id_col, "piece"], "rank", by=["length"], ties=["ids_crc32"], buckets=F.col("buckets"))
    at = ranked.drop("buckets").join(F.broadcast(places), "length").where("rank >= low AND rank < high")
    place = (F.col("rank") - F.col("low"))
    inner = place % F.col("copies")
    placed = at.withColumn("sequence_id", F.col("first") + ((place - inner) / F.col("copies")).cast("long")).withColumn("offset", F.col("base") + inner * F.col("length"))
    return placed.drop("rank", "low", "high", "first", "copies", "base").unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, pattern: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack; the pieces are stored once, as two passes read them.

    ``tokenizer`` is the path of a byte-level vocabulary on the executors.
    Repeated rows give repeated pieces, each with a place of its own; a null
    id is an id like others; a null or empty text is the end mark alone; an
    empty table gives an empty result. Strings of the vocabulary's added
    tokens count as those tokens. ``with_ids`` adds the token ids.
    """
    import public_tokenizers

    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    pieces = stored(tokenized(docs, path, pattern or public_tokenizers.PATTERN, capacity=capacity, with_ids=with_ids), "pieces")
    out = packed(pieces, capacity=capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
