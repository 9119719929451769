"""Burrows-Wheeler transforms of small collections, and which of their strings repeat.

A collection is one byte array with ``END`` behind every member; ``END`` is no
byte of UTF-8 text. Sorting stops at the depth asked for: intervals of the
transform for strings up to that length are the same as in the full order.
"""

from __future__ import annotations

import numpy as np

END = 0xFF
#: Bits of a position; a collection has at most 2 ** BITS bytes, so that two ranks and a position fit 63 bits.
BITS = 21


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by their first ``depth`` bytes, by prefix doubling.

    Beyond the end of the collection lie zeros. Ties in all ``depth`` bytes stay
    in any order. Each round sorts only what is still tied, as one packed number: own rank, rank
    of the bytes behind, position.
    """
    n = len(text)
    if n > 1 << BITS:
        raise ValueError(f"a collection has at most {1 << BITS} bytes")
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    head = np.zeros(n, np.uint64)
    for k in range(5):
        head = (head << np.uint64(8)) | padded[k : k + n]
    low = np.uint64((1 << BITS) - 1)
    packed = (head << np.uint64(BITS)) | np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & low).astype(np.int32)
    head = packed >> np.uint64(BITS)
    rank = np.zeros(n + depth, np.int32)  # 1 and up; 0 beyond the end
    new = np.concatenate([[True], head[1:] != head[:-1]])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(1, n + 1, dtype=np.int32), np.int32(0)))
    at = np.arange(n, dtype=np.int32)  # places in the order that are still tied
    done = 5
    while done < depth:
        last = np.concatenate([new[1:], [True]])
        tied = ~(new & last)
        at = at[tied]
        if not len(at):
            break
        members = order[at]
        step = min(done, depth - done)
        packed = (rank[members].astype(np.uint64) << np.uint64(2 * BITS)) | (rank[members + step].astype(np.uint64) << np.uint64(BITS)) | members.astype(np.uint64)
        packed.sort()
        order[at] = members = (packed & low).astype(np.int32)
        packed >>= np.uint64(BITS)
        new = np.concatenate([[True], packed[1:] != packed[:-1]])
        rank[members] = at[np.maximum.accumulate(np.where(new, np.arange(len(at), dtype=np.int32), np.int32(0)))] + np.int32(1)
        done += step
    return order


def transform(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The byte before each suffix, in their order; the first suffix has the last byte before it."""
    return text[order - 1]


def common_prefixes(bwt: np.ndarray, most: int) -> np.ndarray:
    """Longest common prefixes of neighbours in suffix order, from the transform alone.

    Entry i tells what suffixes i - 1 and i share; ``most`` stands for ``most``
    or more. Intervals are extended backwards, breadth first: all strings of
    length l before those of length l + 1, so values come by increasing size.
    The first interval to end at i fixes entry i, and only such intervals are
    extended again; those of length ``most`` are never looked at.
    """
    n = len(bwt)
    by_byte = np.argsort(bwt, kind="stable")
    forward = np.empty(n, np.int32)
    forward[by_byte] = np.arange(n, dtype=np.int32)
    first = bwt[by_byte]  # first bytes in suffix order
    opens = np.ones(n + 1, bool)
    opens[1:n] = first[1:] != first[:-1]
    prefix = np.full(n + 1, most, np.int32)
    prefix[opens] = 0  # strings of one byte: their intervals end where the first byte changes
    known = opens.copy()
    edges = np.flatnonzero(opens).astype(np.int32)
    lo, hi = edges[:-1], edges[1:]
    owner = np.full(n + 2, -1, np.int32)  # of each place, shifted by one
    base = 0
    for length in range(1, most):
        sizes = hi - lo
        before = np.cumsum(sizes, dtype=np.int32) - sizes
        held = np.arange(int(sizes.sum()), dtype=np.int32)
        held += np.repeat(lo - before, sizes)
        own = np.repeat(np.arange(base, base + len(lo), dtype=np.int32), sizes)
        base += len(lo)
        to = forward[held]
        owner[to + 1] = own
        begins = to[(owner[to] != own) | opens[to]]
        to += 1
        ends = to[(owner[to + 1] != own) | opens[to]]
        lo, hi = np.sort(begins), np.sort(ends)
        fresh = ~known[hi]
        lo, hi = lo[fresh], hi[fresh]
        if not len(hi):
            break
        known[hi] = True
        prefix[hi] = length
    return prefix[:n]


def repeated(parts: list[bytes], counts: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of positions that begin a string of ``least`` bytes that occurs twice: (part, from, to), by part and place.

    ``counts`` weighs each part. Strings are those within parts, from their first ``starts`` positions.
    """
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    text = np.frombuffer(bytes([END]).join(parts) + bytes([END]), np.uint8)
    at = np.cumsum(sizes) - sizes
    order = suffix_order(text, least)
    prefix = common_prefixes(transform(text, order), least)
    weight = np.zeros(len(text) + 1, np.int64)
    weight[at] += counts
    weight[at + starts] -= counts
    weight = np.cumsum(weight[:-1])[order]
    group = np.cumsum(prefix < least) - 1
    twice = np.bincount(group, weights=weight)[group] >= 2
    hit = np.zeros(len(text) + 1, np.int8)
    hit[order] = twice & (weight > 0)
    # a part's last positions begin no string, so no run goes over its end
    edges = np.flatnonzero(np.diff(hit, prepend=np.int8(0)))
    begin, end = edges[::2], edges[1::2]
    part = np.searchsorted(at, begin, side="right") - 1
    return part, begin - at[part], end - at[part]
