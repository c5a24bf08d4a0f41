"""Where a hit stands in the original text, snippets and marked texts. Meant for the rows of a page."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.normalize import lists, slices, table, with_map
from ..functions.text import let

BEFORE, BEHIND, HEAD = 60, 170, 200
OPEN, CLOSE, MORE = "<mark>", "</mark>", "…"
#: Values, or characters, that are looked through one by one; whole stretches of them are skipped.
STRETCH = 64


def merged(text: str, alternatives: list[str], own) -> np.ndarray:
    """Start and end of each span, in order."""
    norm = text.translate(own)
    first, last = [], []
    for a in filter(None, alternatives):
        at = norm.find(a)
        while at >= 0:
            first.append(at)
            last.append(at + len(a) - 1)
            at = norm.find(a, at + len(a))
    if not first:
        return np.empty((0, 2), np.int32)
    places = with_map(text, own)[1]
    starts, ends = places[first], places[last] + 1
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    return np.stack([starts[new], ends[np.append(new[1:], len(ends)) - 1]], 1)


def hit_ranges(text: Column, alternatives: list[str], variants: dict[str, str] | None = None) -> Column:
    """Spans [start, end) of the text where an alternative is found in its normal form; spans that touch are one."""
    own = table(variants)

    @F.arrow_udf("array<struct<start: int, end: int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in slices(batch):
                found = [merged(t or "", alternatives, own) for t in texts.to_pylist()]
                (offsets, starts), (_, ends) = lists([x[:, 0] for x in found]), lists([x[:, 1] for x in found])
                yield pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(starts), pa.array(ends)], ["start", "end"]))

    return run(text)


def running(values: Column, zero: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The fold of each value and all before it, without a step for each of those: whole stretches are folded once."""

    def within(own: Column, start: Column, first: Column, last: Column) -> Column:
        return F.aggregate(F.sequence(first, last), start, lambda s, i: join(s, F.get(own, i)))

    def folded(own: Column) -> Column:
        size, of = F.size(own), lambda i: F.floor(i / STRETCH).cast("int")
        one = lambda b: F.when(b == 0, zero).otherwise(within(own, zero, (b - 1) * STRETCH, b * STRETCH - 1))
        # the n-th is the fold of the stretch before the n-th
        wholes = F.transform(F.sequence(F.lit(0), of(F.greatest(size - 1, F.lit(0)))), one)
        return let(wholes, lambda w: F.transform(own, lambda _, i: within(own, within(w, zero, F.lit(0), of(i)), of(i) * STRETCH, i)))

    return let(values, folded)


def stored_ranges(norm: Column, runs: Column, alternatives: list[str]) -> Column:
    """The same from a stored normal form and its runs (``add_norm_runs``), with SQL functions alone."""
    span = lambda start, end: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
    none = F.array().cast("array<struct<start: int, end: int>>")
    terms = list(dict.fromkeys(filter(None, alternatives)))
    if not terms:
        return none

    def place(own: Column, j: Column) -> Column:
        """Where the j-th character of the normal form stands in the text: the last run that begins there or before, by bisection."""
        at = F.aggregate(own["steps"], F.lit(0), lambda low, s: F.when(F.get(own["runs"], low + s)["n"] <= j, low + s).otherwise(low))
        return let(F.get(own["runs"], at), lambda r: r["t"] + j - r["n"])

    def hits(own: Column, term: str) -> Column:
        """Spans of a term's places without overlap: each is where what stands before it, and the terms there, end."""
        sizes = F.transform(F.split(own["norm"], F.lit(re.escape(term)), F.lit(-1)), lambda part: F.length(part))
        before = let(running(sizes, F.lit(0), lambda s, n: s + n), lambda x: F.slice(x, 1, F.size(x) - 1))
        starts = F.transform(before, lambda s, k: s + k * len(term))
        return F.transform(starts, lambda s: span(place(own, s), place(own, s + len(term) - 1) + 1))

    def joined(spans: Column) -> Column:
        """Spans in order as one where they touch or overlap."""
        ends = running(F.transform(spans, lambda x: x["end"]), F.lit(0), lambda a, b: F.greatest(a, b))

        def cut(ends: Column) -> Column:
            first = F.filter(F.transform(spans, lambda _, i: i), lambda i: (i == 0) | (F.get(spans, i)["start"] > F.get(ends, i - 1)))
            last = lambda first, k: F.coalesce(F.get(first, k + 1), F.size(spans)) - 1
            return let(first, lambda f: F.transform(f, lambda i, k: span(F.get(spans, i)["start"], F.get(ends, last(f, k)))))

        return let(ends, cut)

    steps = F.filter(F.array(*(F.lit(1 << k) for k in reversed(range(30)))), lambda s: s < F.size(runs))
    own = F.struct(norm.alias("norm"), runs.alias("runs"), steps.alias("steps"))
    found = let(own, lambda x: let(F.array_sort(F.concat(*(hits(x, t) for t in terms))), joined))
    return F.when(F.coalesce(norm, F.lit("")) == "", none).otherwise(found)


def _marked(text: Column, ranges: Column, start: Column, end: Column) -> Column:
    """text[start, end) with its ranges marked. The text lies in stretches, so that a cut costs what it is long."""
    size = 4 * STRETCH
    of = lambda n: F.floor(n / size).cast("int")

    def run(x: Column) -> Column:
        own, spans = x["own"], x["ranges"]

        def cut(a: Column, b: Column) -> Column:
            over = F.array_join(F.transform(F.sequence(of(a), of(b - 1)), lambda i: F.get(own, i)), "")
            return F.when(b > a, F.substring(over, a - of(a) * size + 1, b - a)).otherwise("")

        def piece(r: Column, i: Column) -> Column:
            return F.concat(cut(F.coalesce(F.get(spans, i - 1)["end"], x["start"]), r["start"]), F.lit(OPEN), cut(r["start"], r["end"]), F.lit(CLOSE))

        behind = F.coalesce(F.get(spans, F.size(spans) - 1)["end"], x["start"])
        return F.concat(F.array_join(F.transform(spans, piece), ""), cut(behind, x["end"]))

    own = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    x = F.struct(own.alias("own"), ranges.alias("ranges"), start.cast("int").alias("start"), end.cast("int").alias("end"))
    return F.when(text.isNotNull(), let(x, run))


def snippet(text: Column, ranges: Column) -> Column:
    """From 60 characters before the first hit to 170 behind the last one, hits marked, … where it is cut."""
    size = F.length(text)
    start = F.greatest(F.lit(0), F.element_at(ranges, 1)["start"] - BEFORE)
    end = F.least(size, F.element_at(ranges, -1)["end"] + BEHIND)
    inside = F.concat(F.when(start > 0, MORE).otherwise(""), _marked(text, ranges, start, end), F.when(end < size, MORE).otherwise(""))
    head = F.concat(F.substring(text, 1, HEAD), F.when(size > HEAD, MORE).otherwise(""))
    return F.when(F.size(ranges) == 0, head).otherwise(inside)


def highlight_full(text: Column, ranges: Column) -> Column:
    return _marked(text, ranges, F.lit(0), F.length(text))
