"""How wide and how high a text is drawn, estimated without fonts."""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwarden.runtime import ship_package

# Widths in columns' units, sizes in points.
TAB, SPACE, WIDE, PUNCTUATION = 4.0, 0.5, 2.0, 0.8
FONT, LEAST_FACTOR, MOST_FACTOR, WIDE_FACTOR, BOLD_FACTOR = 11.0, 0.7, 2.5, 1.08, 1.04
COLUMN, ROW = 8.43, 15.0


def is_wide(c: str) -> bool:
    return unicodedata.east_asian_width(c) in "WF"


@lru_cache(maxsize=10_000)
def unit(c: str) -> float:
    if c == "\t":
        return TAB
    if c.isspace():
        return SPACE
    return WIDE if is_wide(c) else PUNCTUATION if unicodedata.category(c)[0] == "P" else 1.0


def display_units(text: str) -> float:
    return sum(map(unit, text))


def font_factor(text: str, size: float | None, bold: bool) -> float:
    factor = min(MOST_FACTOR, max(LEAST_FACTOR, (size or FONT) / FONT))
    return factor * (WIDE_FACTOR if any(map(is_wide, text)) else 1.0) * (BOLD_FACTOR if bold else 1.0)


def wrapped_lines(text: str, room: float, factor: float) -> int:
    """Lines that a text takes if words wrap at the room's end and longer ones break."""
    lines, used = 1, 0.0
    for gap, word in re.findall(r"(\s*)(\S+)", text):
        before, width = display_units(gap) * factor, display_units(word) * factor
        if used and used + before + width > room:
            lines, used, before = lines + 1, 0.0, 0.0
        if used:
            used += before + width
        else:
            more = max(1, math.ceil((before + width) / room)) - 1
            lines, used = lines + more, before + width - more * room
    tail = display_units(text[len(text.rstrip()) :]) * factor
    return lines + (max(0, math.ceil((used + tail) / room) - 1) if tail and used else 0)


def measure(text: str, size: float | None, bold: bool, wrap: bool, room: float) -> tuple[float, int, float]:
    """(width, lines, height) that a text needs in a cell of so much width."""
    factor = font_factor(text, size, bold)
    lines = re.split("\r\n|\r|\n", text)
    width = max(display_units(x) for x in lines) * factor + 1.0
    n = sum(wrapped_lines(x, max(room - 1.0, 1.0), factor) for x in lines) if wrap else len(lines)
    return width, n, n * max(12.0, (size or FONT) * 1.25) + 2.0


def text_size(cells: DataFrame, text: Column, size: Column, bold: Column, wrap: Column, room: Column) -> Column:
    """measure() of each text as a struct (width, lines, height); null for a null or blank text."""
    ship_package(cells.sparkSession)

    def found(*columns: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s, b, w, r in zip(*columns, strict=True):
            blank = t is None or not t.strip()
            rows.append((None, None, None) if blank else measure(t, None if pd.isna(s) else s, bool(b), bool(w), COLUMN if pd.isna(r) else r))
        return pd.DataFrame(rows, columns=["width", "lines", "height"]).astype({"lines": "Int64"})

    return F.pandas_udf(found, "width double, lines int, height double")(text, size.cast("double"), bold, wrap, room.cast("double"))


def identifier_width(digits: Column, width: Column) -> Column:
    """The column width that a long identifier of so many digits and such a text width asks for."""
    rounded = F.ceil((width + 0.5) * 4) / 4
    return F.least(F.lit(40.0), F.greatest(F.lit(12.0), digits * 1.1 + 1.5, rounded))
