"""Text helpers whose white space and digits follow the transcripts' conventions rather than Java's."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space, as the inside of a character class.
SPACE = "\\t\\n\\u000B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
WS = f"[{SPACE}]"
SPACES = "".join(c for c in map(chr, range(0x10000)) if re.fullmatch(WS, c))
# Half and full width digits.
HALF, FULL = "0123456789", "０１２３４５６７８９"
DIGITS = "[0-9０-９]"


def trim_ws(col: Column) -> Column:
    """Without white space (of any kind in WS) at both ends."""
    return F.btrim(col, F.lit(SPACES))


def drop_ws(col: Column) -> Column:
    return F.regexp_replace(col, f"{WS}+", "")


def squeeze_ws(col: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trim_ws(F.regexp_replace(col, f"{WS}+", " "))


def drop_newlines(col: Column) -> Column:
    return F.regexp_replace(col, "[\\r\\n]+", "")


def to_half_digits(col: Column) -> Column:
    return F.translate(col, FULL, HALF)


def find_all(col: Column, pattern: str, groups: int) -> Column:
    """All matches as an array of structs g1, g2, ... (the groups of the pattern), in order."""
    parts = [F.regexp_extract_all(col, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in range(1, groups + 1)]
    return F.arrays_zip(*parts)


def let(col: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a column that is worked out once, however often ``use`` names it."""
    return F.transform(F.array(col), use)[0]
