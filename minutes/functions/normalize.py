"""Normal forms for comparing spellings.

``normalize_text`` works character by character: skipped characters go, variants become standard, then the
compatibility form of that single character in lower case. ``profile_normalize`` is a second rule, used for corpus
profiles: skipped characters go, then the compatibility form of the whole string, without variants.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dictionaries import SKIPPED, VARIANTS

_SPACES = re.compile("[\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]")


def skipped(char: str) -> bool:
    return char in SKIPPED or bool(_SPACES.match(char))


#: Stands for a number of characters that was not worked out yet; no character becomes so many.
_UNKNOWN = 255


class Table(dict):
    """What each character becomes, for str.translate; worked out when a character is first met."""

    def __init__(self, variants: dict[str, str]) -> None:
        super().__init__()
        self.variants = variants
        self.known = np.full(0x110000, _UNKNOWN, np.uint8)

    def __missing__(self, code: int) -> str:
        char = chr(code)
        self[code] = "" if skipped(char) else unicodedata.normalize("NFKC", self.variants.get(char, char)).lower()
        return self[code]

    def sizes(self, codes: np.ndarray) -> np.ndarray:
        """How many characters each becomes."""
        found = self.known[codes]
        new = codes[found == _UNKNOWN]
        if len(new):
            for c in set(new.tolist()):
                self.known[c] = len(self[c])
            found = self.known[codes]
        return found

    def __reduce__(self):
        return Table, (self.variants,)


_DEFAULT = Table(VARIANTS)


def table(variants: dict[str, str] | None) -> Table:
    return _DEFAULT if variants is None else Table(variants)


def normalize_term(term: str, variants: dict[str, str] | None = None) -> str:
    return term.translate(table(variants))


#: Characters that the JVM's functions may treat. Texts with others go to Python, whose str.translate is several times as fast as
#: regular expressions over large classes and the JVM's translate with hundreds of pairs.
LATIN = range(0x100)


@cache
def _native(variants: tuple[tuple[str, str], ...]) -> tuple[str, str]:
    own = Table(dict(variants))
    gone = [c for c in LATIN if skipped(chr(c))]
    plain = [c for c in LATIN if c in gone or own[c] == chr(c).lower() and len(own[c]) == 1]
    # from one end to the other without a step back, which is much faster than to look for other characters
    return f"[{_class(gone)}]+", f"^[{_class(plain)}]*+\\z"


def _class(codes: list[int]) -> str:
    """The inside of a class of code points, in runs."""
    runs: list[list[int]] = []
    for c in codes:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs)


def native(variants: dict[str, str] | None = None) -> tuple[str, str]:
    """Patterns of what is skipped, and of texts whose normal form is lower case without it: all of ASCII, most of Latin-1."""
    return _native(tuple((VARIANTS if variants is None else variants).items()))


def needs_python(col: Column, variants: dict[str, str] | None = None) -> Column:
    return F.coalesce(~col.rlike(native(variants)[1]), F.lit(False))


def normalizer(variants: dict[str, str] | None = None) -> Callable[[Column], Column]:
    """Normal forms with the JVM's functions where they suffice. Other texts go to Python; those are null there."""
    own = table(variants)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t.translate(own) if t else t)

    def form(col: Column) -> Column:
        in_python = run(F.when(needs_python(col, variants), col))
        return F.coalesce(in_python, F.lower(F.regexp_replace(col, native(variants)[0], "")), F.lit(""))

    return form


def normalize_text(col: Column, variants: dict[str, str] | None = None) -> Column:
    """The normal form of each text; null becomes empty."""
    return normalizer(variants)(col)


#: Bytes of texts whose places are worked out at once: a batch of Spark's has any number of them.
SLICE = 4_000_000


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[pa.Array]:
    """A batch of texts in stretches of up to ``size`` bytes, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield texts.slice(at, end - at)
        at = end


def lists(values: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """Offsets and values of a list array."""
    return pa.array(np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)), np.concatenate([np.empty(0, np.int32), *values]).astype(np.int32)


def normalize_with_map(col: Column, variants: dict[str, str] | None = None) -> Column:
    """struct(norm, map): map[j] is the place in the text of what made the j-th character of the normal form."""
    own = table(variants)

    @F.arrow_udf("struct<norm: string, map: array<int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in slices(batch):
                found = [with_map(t or "", own) for t in texts.to_pylist()]
                offsets, places = lists([m for _, m in found])
                yield pa.StructArray.from_arrays([pa.array([n for n, _ in found], pa.string()), pa.ListArray.from_arrays(offsets, pa.array(places))], ["norm", "map"])

    return run(col)


def with_map(text: str, own: Table = _DEFAULT) -> tuple[str, np.ndarray]:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return text.translate(own), np.repeat(np.arange(len(codes), dtype=np.int32), own.sizes(codes))


def add_norm_runs(speeches: DataFrame, variants: dict[str, str] | None = None) -> DataFrame:
    """With columns norm and runs: stretches (n, t) of the normal form that are stretches of the text, by where each begins
    in both. A new one begins where characters were dropped before it, or where one character became several."""
    own = table(variants)

    @F.arrow_udf("struct<norm: string, runs: array<struct<n: int, t: int>>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in slices(batch):
                found = [with_map(t or "", own) for t in texts.to_pylist()]
                begins = [np.flatnonzero(np.diff(m, prepend=-2) != 1) for _, m in found]
                offsets, n = lists(begins)
                _, t = lists([m[b] for (_, m), b in zip(found, begins, strict=True)])
                runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(n), pa.array(t)], ["n", "t"]))
                yield pa.StructArray.from_arrays([pa.array([n for n, _ in found], pa.string()), runs], ["norm", "runs"])

    return speeches.withColumn("__made", run(F.col("text"))).withColumns({"norm": F.col("__made.norm"), "runs": F.col("__made.runs")}).drop("__made")


def add_norm(speeches: DataFrame, variants: dict[str, str] | None = None) -> DataFrame:
    """With a column norm, worked out only where there is none yet."""
    made = normalize_text(F.col("text"), variants)
    return speeches.withColumn("norm", F.coalesce(F.col("norm"), made) if "norm" in speeches.columns else made)


def profile_normalize(col: Column) -> Column:
    """The profile form of each text, which knows no variants; in the engine where its functions suffice."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: profile_term(t) if t else t)

    in_python = run(F.when(needs_python(col, {}), col))
    return F.coalesce(in_python, F.lower(F.regexp_replace(col, native({})[0], "")), F.lit(""))


def profile_term(term: str) -> str:
    return unicodedata.normalize("NFKC", "".join(c for c in term if not skipped(c))).lower()
