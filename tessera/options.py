"""Options of the comparison operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class NormOptions:
    """Which differences between characters do not count.

    ``fold_width`` (full-width forms equal half-width ones) is on by default,
    whatever the others say. ``ignore_newline`` compares texts as one flow
    instead of line by line.
    """

    ignore_case: bool = False
    ignore_eol: bool = True
    ignore_whitespace: bool = False
    ignore_newline: bool = False
    ignore_punct: bool = False
    fold_width: bool = True


@dataclass(frozen=True)
class TableDiffConfig:
    """How two tables are compared.

    ``keys``: key columns; those missing on either side are passed over, and
    without any left a key is guessed. ``equality``: ``loose`` (numbers within
    a tolerance, dates in any notation, kinds of blank alike) or ``strict``
    (trimmed text). ``blank_composite_is_key``: a key of several columns takes
    part in matching even if all its parts are blank.
    """

    keys: tuple[str, ...] = ()
    equality: str = "loose"
    sheet: str = ""
    blank_composite_is_key: bool = True
