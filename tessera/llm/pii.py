"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, scheme
and identifier cues); a deterministic parser per kind expands each anchor to
the left and right and validates what it finds. Offsets are code points.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from .common import per_text

#: Base kinds first, in the order of the digest; then what the method adds.
KINDS = ("email", "ip", "card", "phone", "credential", "iban", "ssn")

DIGITS = frozenset("0123456789")
UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
ALNUM = DIGITS | UPPER | frozenset("abcdefghijklmnopqrstuvwxyz")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
USERINFO = ALNUM | frozenset("-._~!$&'()*+,;=%:")
#: Cues for account numbers; what follows is parsed and its check digits tested.
CUES = {"IBAN": "iban", "iban": "iban", "Iban": "iban", "SSN": "ssn", "ssn": "ssn", "social security": "ssn", "Social Security": "ssn"}


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in DIGITS:
        a.add_word(d, "digit")
    a.add_word("@", "at")
    a.add_word("+", "plus")
    a.add_word("://", "scheme")
    for cue, kind in CUES.items():
        a.add_word(cue, kind)
    a.make_automaton()
    return a


def run_end(text: str, at: int, allowed: frozenset) -> int:
    """First position from ``at`` on that is not of ``allowed``."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign, not reaching left of ``floor``."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    end = run_end(text, at + 1, LABEL)
    if end == at + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == ".":
        after = run_end(text, end + 1, LABEL)
        if after == end + 1:
            break
        end, labels = after, labels + 1
    return (start, end) if labels else None


def ip_at(text: str, at: int) -> tuple[int, bool, int]:
    """Dotted numbers from ``at``: end, whether all four parts are valid, where to go on."""
    end, parts = run_end(text, at, DIGITS), []
    parts.append(text[at:end])
    while len(parts) < 4 and end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS:
        start = end + 1
        end = run_end(text, start, DIGITS)
        parts.append(text[start:end])
    if len(parts) < 4:
        return end, False, end
    return end, all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts), end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def card_at(text: str, at: int) -> tuple[int, bool]:
    """Digits with single blanks or hyphens between, from ``at``: end, validity."""
    n, end, digits = len(text), at + 1, [text[at]]
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end += 2
        else:
            break
        digits.append(text[end - 1])
    return end, 13 <= len(digits) <= 19 and luhn("".join(digits))


def phone_at(text: str, at: int) -> tuple[int, int] | None:
    """The number behind the plus sign at ``at``: start and end, None if invalid."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = run_end(text, at + 2, PHONE)
    while end > at + 2 and text[end - 1] not in DIGITS:
        end -= 1
    if end < at + 4:  # a character of the class, then a digit
        return None
    return (at, end) if 9 <= sum(c in DIGITS for c in text[at:end]) <= 15 else None


def credential_at(text: str, after: int) -> tuple[int, int] | None:
    """user:password behind ``://``, up to the at-sign of the same authority."""
    end = run_end(text, after, USERINFO)
    if end < len(text) and text[end] == "@" and ":" in text[after:end].strip(":"):
        return after, end
    return None


def iban_at(text: str, after: int) -> tuple[int, int] | None:
    """An account number after its cue whose check digits hold."""
    start = after
    while start < len(text) and start - after < 4 and text[start] in " :.#=\t":
        start += 1
    end, kept = start, []
    while end < len(text) and len(kept) < 34:
        if text[end] in DIGITS or text[end] in UPPER:
            kept.append(text[end])
        elif not (text[end] == " " and end + 1 < len(text) and (text[end + 1] in DIGITS or text[end + 1] in UPPER)):
            break
        end += 1
    raw = "".join(kept)
    if not (15 <= len(raw) <= 34 and raw[:2].isalpha() and raw[2:4].isdigit()):
        return None
    if int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 != 1:
        return None
    return start, end


def ssn_at(text: str, after: int) -> tuple[int, int] | None:
    """ddd-dd-dddd after its cue, with valid groups."""
    start = after
    while start < len(text) and start - after < 12 and text[start] not in DIGITS and text[start] != "\n":
        start += 1
    part = text[start : start + 11]
    if len(part) < 11 or part[3] != "-" or part[6] != "-" or run_end(text, start + 7, DIGITS) != start + 11:
        return None
    area, group, serial = part[:3], part[4:6], part[7:]
    if not all(c in DIGITS for c in area + group + serial):
        return None
    if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
        return None
    return start, start + 11


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), by kind as listed, then start; null has none."""
    if not text:
        return []
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = ip_end = card_end = 0
    for last, what in automaton().iter(text):
        if what == "digit":
            if last >= ip_end:
                end, valid, ip_end = ip_at(text, last)
                if valid:
                    out["ip"].append((last, end))
            if last >= card_end:
                card_end, valid = card_at(text, last)
                if valid:
                    out["card"].append((last, card_end))
        elif what == "at":
            if found := email_at(text, last, email_end):
                out["email"].append(found)
                email_end = found[1]
        elif what == "plus":
            if found := phone_at(text, last):
                out["phone"].append(found)
        elif what == "scheme":
            if found := credential_at(text, last + 1):
                out["credential"].append(found)
        elif found := (iban_at if what == "iban" else ssn_at)(text, last + 1):
            if not out[what] or out[what][-1][1] <= found[0]:
                out[what].append(found)
    return [(kind, *span) for kind in KINDS for span in out[kind]]


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def masked(text: str | None) -> str | None:
    """The text with every span, overlaps joined, replaced by the name of its first kind."""
    spans = sorted((s, e, k) for k, s, e in find(text))
    if not spans:
        return text
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def scan_pii(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans.

    A null or empty text has no spans; repeated rows each get theirs. No shuffle.
    """
    base = KINDS[:4]

    def scan(texts: list[str | None]) -> list[list]:
        found = [find(t) for t in texts]
        firsts = [[s for s in x if s[0] in base] for x in found]
        counts = [[sum(s[0] == k for s in x) for x in firsts] for k in base]
        return [*counts, [hashlib.sha256(written(x).encode()).hexdigest() for x in firsts], [written(x) for x in found]]

    fields = ", ".join(f"n_{k} long" for k in base) + ", base_sha256 string, spans string"
    return per_text(docs, scan, fields, text, keep=[id_col])


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with personal data in ``text`` replaced by kind names.

    A null text stays null.
    """

    made = per_text(docs, lambda texts: [[masked(t) for t in texts]], f"`{text}` string", text)
    return made.select(*[f"`{c}`" for c in docs.columns])
