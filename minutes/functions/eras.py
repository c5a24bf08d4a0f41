"""Era years: eras of the calendar to years and back, numerals, and the ways a year is written."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, to_half_digits, trim_ws

# Name, letter and the year before the first, newest first.
ERAS = [("令和", "R", 2018), ("平成", "H", 1988), ("昭和", "S", 1925)]
KANJI_DIGITS = "〇一二三四五六七八九元"
PLAIN_DIGITS = "01234567891"
ERA_YEAR = "(令和|平成|昭和|[RrHhSs])"


def era_to_year(name: Column, n: Column) -> Column:
    """The year of an era's n-th; null for an unknown era."""
    out = F.when(F.lit(False), F.lit(0))
    for era, letter, base in ERAS:
        out = out.when((name == era) | (F.upper(name) == letter), n + base)
    return out


def year_to_era(year: Column) -> Column:
    """Like 令和7年, the first year as 元; a year before all eras as a number."""
    out = F.when(F.lit(False), F.lit(""))
    for era, _, base in ERAS:
        n = year - base
        out = out.when(n >= 1, F.concat(F.lit(era), F.when(n == 1, "元").otherwise(n.cast("string")), F.lit("年")))
    return F.when(year.isNotNull(), F.coalesce(out, year.cast("string")))


def kanji_number(col: Column) -> Column:
    """Digits, 元, tens with 十, or kanji digits in a row; anything else is null."""
    leading = lambda c: F.regexp_extract(c, "^([0-9]{1,9})", 1).try_cast("int")

    def part(c: Column, empty: int) -> Column:
        return F.when(c == "", empty).when(c.rlike(f"^[{KANJI_DIGITS}]\\z"), F.translate(c, KANJI_DIGITS, PLAIN_DIGITS).try_cast("int")).otherwise(leading(c))

    tens = F.split(col, "十", -1)
    return (
        F.when(col.rlike("^[0-9]{1,9}\\z"), col.try_cast("int"))
        .when(col.contains("十"), part(tens[0], 1) * 10 + part(tens[1], 0))
        .when(col.rlike(f"^[{KANJI_DIGITS}]{{1,9}}\\z"), F.translate(col, KANJI_DIGITS, PLAIN_DIGITS).try_cast("int"))
    )


def year_variants(year: Column) -> Column:
    """The ways a year is written: 2025, 令和7年, 令和7, R7."""
    out = F.array(year.cast("string"))
    for era, letter, base in reversed(ERAS):
        n = year - base
        shown = F.concat(F.lit(era), F.when(n == 1, "元").otherwise(n.cast("string")))
        out = F.when(n >= 1, F.array(year.cast("string"), F.concat(shown, F.lit("年")), shown, F.concat(F.lit(letter), n.cast("string")))).otherwise(out)
    return F.when(year.isNotNull(), F.array_distinct(out))


def expand_year(token: Column) -> Column:
    """struct(year, era, terms) of a year as written in a query, else null."""
    pattern = f"^{ERA_YEAR}{_WS}*([0-9一二三四五六七八九十〇元]+){_WS}*年?\\z"

    def year_of(t: Column) -> Column:
        number = let(F.regexp_extract(t, pattern, 2), kanji_number)
        return F.coalesce(F.regexp_extract(t, "^([0-9]{4})年?\\z", 1).try_cast("int"), let(number, lambda n: era_to_year(F.regexp_extract(t, pattern, 1), n)))

    def described(y: Column) -> Column:
        return F.when(y.isNotNull(), F.struct(y.alias("year"), year_to_era(y).alias("era"), year_variants(y).alias("terms")))

    return let(let(to_half_digits(trim_ws(token)), year_of), described)


def year_terms(token: str) -> list[str]:
    """``expand_year`` for a term of a query: the ways its year is written, none if it is no year."""
    t = token.strip().translate(str.maketrans("０１２３４５６７８９", "0123456789"))
    if m := re.fullmatch("([0-9]{4})年?", t):
        year = int(m[1])
    elif m := re.fullmatch(ERA_YEAR + r"\s*([0-9一二三四五六七八九十〇元]+)\s*年?", t):
        n = _number(m[2])
        base = next(b for era, letter, b in ERAS if m[1] == era or m[1].upper() == letter)
        if n is None:
            return []
        year = base + n
    else:
        return []
    out = [str(year)]
    for era, letter, base in ERAS:
        if (n := year - base) >= 1:
            shown = f"{era}{'元' if n == 1 else n}"
            out += [f"{shown}年", shown, f"{letter}{n}"]
            break
    return list(dict.fromkeys(out))


def _number(text: str) -> int | None:
    plain = str.maketrans(KANJI_DIGITS, PLAIN_DIGITS)
    if re.fullmatch("[0-9]+", text):
        return int(text)
    if "十" in text:
        a, b, *_ = text.split("十")
        ten, one = (default if not x else x.translate(plain) if len(x) == 1 else (re.match("[0-9]+", x) or [None])[0] for x, default in ((a, 1), (b, 0)))
        return None if ten is None or one is None else int(ten) * 10 + int(one)
    return int(text.translate(plain)) if re.fullmatch(f"[{KANJI_DIGITS}]+", text) else None


_WS = "[\\s\\u3000\\u00A0]"
