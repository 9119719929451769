"""Numerics on images in numpy: text boxes, decoding, seams and noise."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np

#: Thresholds of the text detector and of the image checks.
DET_THRESHOLD, BOX_THRESHOLD, MIN_SIDE, UNCLIP = 0.3, 0.5, 3, 1.6
INK_LEVEL, BLANK_ROW, LEAST_BLANK, WINDOW, LEAST_INK = 200, 0.002, 6, 16, 0.02
COLORFUL, BANDS = 80, 20


def half_up(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5)


def over_white(rgba: np.ndarray) -> np.ndarray:
    """(h, w, 4) as (h, w, 3) on a white ground."""
    alpha = rgba[..., 3:].astype(np.float64) / 255
    return half_up(rgba[..., :3] * alpha + 255 * (1 - alpha)).astype(np.uint8)


def sample(img: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear values at (x, y), the border repeated."""
    h, w = img.shape[:2]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    x1, y1 = np.minimum(w - 1, x0 + 1), np.minimum(h - 1, y0 + 1)
    top = img[y0, x0] * (1 - fx) + img[y0, x1] * fx
    bottom = img[y1, x0] * (1 - fx) + img[y1, x1] * fx
    return half_up(top * (1 - fy) + bottom * fy).astype(np.uint8)


def resized(img: np.ndarray, w: int, h: int) -> np.ndarray:
    """Bilinear scaling from the corner."""
    y, x = np.meshgrid(np.arange(h) * (img.shape[0] / h), np.arange(w) * (img.shape[1] / w), indexing="ij")
    return sample(img, x, y)


def rotated(img: np.ndarray, quarters: int) -> np.ndarray:
    """Turned clockwise by quarters."""
    return np.rot90(img, -quarters)


def warped(img: np.ndarray, quad: list[tuple[float, float]]) -> np.ndarray:
    """The quadrilateral (corners clockwise from the upper left) as a rectangle of at least 8 x 8."""
    p = np.asarray(quad, float)
    side = lambda a, b: float(np.hypot(*(p[a] - p[b])))
    w = max(8, int((side(0, 1) + side(3, 2)) / 2 + 0.5))
    h = max(8, int((side(0, 3) + side(1, 2)) / 2 + 0.5))
    t, s = np.meshgrid((np.arange(h) + 0.5) / h, (np.arange(w) + 0.5) / w, indexing="ij")
    s, t = s[..., None], t[..., None]
    at = (p[0] * (1 - s) + p[1] * s) * (1 - t) + (p[3] * (1 - s) + p[2] * s) * t
    x, y = at[..., 0], at[..., 1]
    inside = (x >= 0) & (y >= 0) & (x < img.shape[1] - 1) & (y < img.shape[0] - 1)
    out = sample(img, np.where(inside, x, 0), np.where(inside, y, 0))
    return np.where(inside[..., None], out, 0).astype(np.uint8)


def labelled(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """8-connected components numbered in reading order, -1 outside (F44): runs of rows joined by union-find."""
    h, w = mask.shape
    labels = np.full((h, w), -1)
    parent: list[int] = []

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    above: list[tuple[int, int, int]] = []
    rows = []
    for y in range(h):
        edge = np.diff(np.r_[0, mask[y].astype(np.int8), 0])
        here = []
        for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            met = sorted({root(k) for a, b, k in above if a <= e and b >= s})
            k = met[0] if met else len(parent)
            if not met:
                parent.append(k)
            for m in met[1:]:
                parent[m] = k
            here.append((int(s), int(e), k))
        rows.append(here)
        above = here
    number: dict[int, int] = {}
    for y, here in enumerate(rows):
        for s, e, k in here:
            labels[y, s:e] = number.setdefault(root(k), len(number))
    return labels, len(number)


def least_rectangle(points: list[tuple[float, float]]) -> tuple[float, list[tuple[float, float]]]:
    """Rectangle of least area along one of the polygon's edges (F45): area, corners."""
    p = np.asarray(points, float)
    best: tuple[float, np.ndarray] | None = None
    for a, b in zip(p, np.roll(p, -1, 0), strict=True):
        length = np.hypot(*(b - a))
        if length < 1e-6:
            continue
        axes = np.array([(b - a) / length, [-(b - a)[1] / length, (b - a)[0] / length]])
        uv = (p - a) @ axes.T
        lo, hi = uv.min(0), uv.max(0)
        area = float(np.prod(hi - lo))
        if best is None or area < best[0]:
            best = area, a + np.array([lo, [hi[0], lo[1]], hi, [lo[0], hi[1]]]) @ axes
    return (best[0], [tuple(map(float, c)) for c in best[1]]) if best else (0.0, [tuple(map(float, c)) for c in p])


def boxes(prob: np.ndarray, ratio_w: float = 1.0, ratio_h: float = 1.0) -> list[dict]:
    """Text boxes of a probability map (F46): components, grown by their area over their perimeter."""
    h, w = prob.shape
    labels, n = labelled(prob > DET_THRESHOLD)
    out = []
    for k in range(n):
        ys, xs = np.nonzero(labels == k)
        x0, x1, y0, y1 = xs.min(), xs.max(), ys.min(), ys.max()
        score = float(prob[ys, xs].mean())
        bw, bh = x1 - x0 + 1, y1 - y0 + 1
        if min(bw, bh, len(xs)) < MIN_SIDE or score < BOX_THRESHOLD:
            continue
        grow = max(1.0, UNCLIP * 2 * bw * bh / (2 * (bw + bh)))
        left, top, right, bottom = max(0, x0 - grow), max(0, y0 - grow), min(w - 1, x1 + grow), min(h - 1, y1 + grow)
        corners = [(left, top), (right, top), (right, bottom), (left, bottom)]
        out.append({"box": [{"x": float(x * ratio_w), "y": float(y * ratio_h)} for x, y in corners], "score": score})
    return out


def ctc(probs: np.ndarray, letters: list[str]) -> tuple[str, float]:
    """Best path without blanks and repeats, and its mean probability."""
    best = probs.argmax(1)
    keep = (best != 0) & (best != np.r_[-1, best[:-1]])
    chars = [letters[k] if k < len(letters) and letters[k] != "?" else " " for k in best[keep]]
    return "".join(chars), float(probs.max(1)[keep].mean()) if keep.any() else 0.0


def detector_input(img: np.ndarray, short: int = 736) -> np.ndarray:
    """Short side scaled, sides multiples of 32, values -1..1, channels first."""
    scale = short / min(img.shape[:2])
    w, h = (max(32, -(-int(s * scale + 0.5) // 32) * 32) for s in (img.shape[1], img.shape[0]))
    return (resized(img, w, h).astype(np.float32) / 255 - 0.5).transpose(2, 0, 1) / 0.5


def recognizer_input(img: np.ndarray, height: int = 48, widths: tuple[int, int] = (48, 768)) -> np.ndarray:
    """Fixed height, width by aspect within bounds."""
    w = int(min(max(img.shape[1] * height / img.shape[0] + 0.5, widths[0]), widths[1]))
    return (resized(img, w, height).astype(np.float32) / 255 - 0.5).transpose(2, 0, 1) / 0.5


def classifier_input(img: np.ndarray) -> np.ndarray:
    """48 x 192 for the angle classifier."""
    return (resized(img, 192, 48).astype(np.float32) / 255 - 0.5).transpose(2, 0, 1) / 0.5


# --- checks ---------------------------------------------------------------------------


def ink(img: np.ndarray, axis: int = 1) -> np.ndarray:
    """Share of dark pixels per row (axis 1) or column (axis 0)."""
    return (img[..., :3] @ np.array([0.299, 0.587, 0.114]) < INK_LEVEL).mean(axis)


def bands(profile: np.ndarray, size: int = 200) -> list[tuple[int, float]]:
    return [(y, round(float(profile[y : y + size].mean()), 4)) for y in range(0, len(profile), size)]


def row_hashes(img: np.ndarray) -> list[str]:
    return [hashlib.md5(np.ascontiguousarray(r).tobytes()).hexdigest() for r in img]


def seams(profile: np.ndarray, hashes: list[str], least_blank: int = LEAST_BLANK) -> list[dict]:
    """Blank bands inside the image, and windows of rows that the next window repeats."""
    edge = np.diff(np.r_[0, (profile < BLANK_ROW).astype(np.int8), 0])
    out = [{"kind": "blank", "y0": int(s), "y1": int(e)} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True) if e - s >= least_blank and s > 0 and e < len(profile)]
    code = np.unique(hashes, return_inverse=True)[1] if len(hashes) else np.zeros(0, int)
    y = 0
    while y + 2 * WINDOW < len(profile):
        if (code[y : y + WINDOW] == code[y + WINDOW : y + 2 * WINDOW]).all():
            if profile[y : y + WINDOW].sum() > LEAST_INK:
                out.append({"kind": "dup", "y0": y, "y1": y + WINDOW})
            y += WINDOW
        y += 1
    return out


def ratios(img: np.ndarray) -> dict[str, float]:
    """Dark, colourful and worst-band percentages on a coarse grid."""
    rgb = img[..., :3].astype(int)
    spread = rgb.max(-1) - rgb.min(-1)
    share = lambda m: round(100 * float(m.mean()), 2) if m.size else 0.0
    h = len(rgb)
    cuts = [(h * b // BANDS, max(h * b // BANDS + 1, h * (b + 1) // BANDS)) for b in range(BANDS)]
    return {
        "dark": share(rgb[::8, ::32].mean(-1) < 128),
        "colorful": share(spread[::8, ::32] > COLORFUL),
        "worst_band": max((share(spread[a:b:4, ::16] > COLORFUL) for a, b in cuts), default=0.0),
    }


# --- PNG --------------------------------------------------------------------------------


def decode_png(data: bytes) -> np.ndarray:
    """8-bit grey, RGB or RGBA images without interlacing, as (h, w, channels)."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, body, head = 8, [], None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    w, h, depth, color, _, _, interlace = head
    if depth != 8 or interlace or color not in (0, 2, 4, 6):
        raise ValueError("unsupported PNG layout")
    c = {0: 1, 2: 3, 4: 2, 6: 4}[color]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h, w * c), np.uint8)
    up = np.zeros(w * c, np.uint8)
    for y in range(h):
        out[y] = up = _unfiltered(int(raw[y, 0]), raw[y, 1:], up, c)
    return out.reshape(h, w, c)


def _unfiltered(kind: int, line: np.ndarray, up: np.ndarray, c: int) -> np.ndarray:
    if kind == 0:
        return line.copy()
    if kind == 2:
        return line + up
    out = np.zeros(len(line) + c, np.int64)
    above = np.r_[np.zeros(c, np.int64), up.astype(np.int64)]
    for i in range(c, len(out)):
        a, b, d = out[i - c], above[i], above[i - c]
        if kind == 1:
            guess = a
        elif kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - d
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
        out[i] = (line[i - c] + guess) & 255
    return out[c:].astype(np.uint8)


def encode_png(img: np.ndarray) -> bytes:
    h, w, c = img.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    rows = b"".join(b"\0" + np.ascontiguousarray(r, np.uint8).tobytes() for r in img)
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
