"""Keyword search over normalised speeches: AND, OR and NOT with synonyms, readings and era years."""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dictionaries import READINGS, SYNONYMS
from ..functions.eras import year_terms
from ..functions.normalize import normalize_term
from .speeches import role_category

PAGE = 20
#: Up to so many saved queries are one expression; beyond, texts go through an automaton of all their terms.
INLINE_QUERIES = 200
#: So many matches, and those of one more text, are handed on at once by the automaton.
MATCHES = 50_000


@dataclass(frozen=True)
class Term:
    negative: bool
    term: str
    alternatives: tuple[str, ...]


def expand_term(term: str, synonyms: list[list[str]] | None = None, readings: dict[str, str] | None = None, variants: dict[str, str] | None = None) -> list[str]:
    """The normal form of a term, of its synonyms (the last group that has it), of its reading, and of its year."""
    norm = lambda t: normalize_term(t, variants)
    base = norm(term)
    out = [base]
    groups = [g for g in ([norm(t) for t in group] for group in (SYNONYMS if synonyms is None else synonyms)) if base in g]
    out += groups[-1] if groups else []
    by_reading = {norm(k): norm(v) for k, v in (READINGS if readings is None else readings).items()}
    out += [by_reading[base]] if base in by_reading else []
    out += [norm(t) for t in year_terms(term)]
    return [t for t in dict.fromkeys(out) if t]


def compile_query(query: str, **dictionaries) -> list[list[Term]]:
    """Groups joined by OR; within a group all terms must hold, those with a leading minus must not."""
    groups: list[list[Term]] = [[]]
    for token in re.split(r"[\s\u3000\ufeff]+", query):
        if token in ("OR", "or", "｜", "|"):
            groups.append([])
            continue
        negative = token[:1] in ("-", "－")
        term = token[1:] if negative else token
        if term:
            groups[-1].append(Term(negative, term, tuple(expand_term(term, **dictionaries))))
    return [g for g in groups if g]


def positive_alternatives(groups: list[list[Term]]) -> list[str]:
    return list(dict.fromkeys(a for g in groups for t in g if not t.negative for a in t.alternatives))


def _found(norm: Column, term: Term) -> Column:
    return reduce(or_, (norm.contains(F.lit(a)) for a in term.alternatives), F.lit(False))


def _holds(norm: Column, group: list[Term]) -> Column:
    return reduce(and_, (~_found(norm, t) if t.negative else _found(norm, t) for t in group))


def match(norm: Column, groups: list[list[Term]]) -> Column:
    """Whether any group holds; true without groups."""
    return reduce(or_, (_holds(norm, g) for g in groups)) if groups else F.lit(True)


def occurrences(text: Column, term: str) -> Column:
    """How often a term occurs without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def hit_score(norm: Column, groups: list[list[Term]]) -> Column:
    """Over each positive term of a group the count of its first alternative that occurs; the greatest group that holds."""
    if not groups:
        return F.lit(0)
    scores = []
    for group in groups:
        total = F.lit(0)
        for term in group:
            if not term.negative and term.alternatives:
                first = F.when(F.lit(False), F.lit(0))
                for a in term.alternatives:
                    first = first.when(norm.contains(F.lit(a)), occurrences(norm, a))
                total = total + F.coalesce(first, F.lit(0))
        scores.append(F.when(_holds(norm, group), total).otherwise(0))
    return F.greatest(*scores, F.lit(0))


def apply_filters(df: DataFrame, year: int | str | None = None, type: str | None = None, meeting: str | None = None, role: str | None = None, speaker: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Rows of a year, type, meeting and role category, whose speaker's name or role holds ``speaker``, in a span of
    dates (a null date fails it)."""
    out = df
    if year:
        out = out.where(F.col("year").cast("string") == str(year))
    if type:
        out = out.where(F.col("type") == type)
    if meeting:
        out = out.where(F.col("meeting_id") == meeting)
    if role:
        out = out.where(role_category(F.coalesce("role", F.lit(""))) == role)
    if speaker:
        out = out.where(F.coalesce(F.col("name").contains(speaker), F.lit(False)) | F.coalesce(F.col("role").contains(speaker), F.lit(False)))
    if date_from:
        out = out.where((F.col("date") != "") & (F.col("date") >= date_from))
    if date_to:
        out = out.where((F.col("date") != "") & (F.col("date") <= date_to))
    return out


def search(speeches: DataFrame, query: str, norm_col: str = "norm", dictionaries: dict | None = None, **filters) -> DataFrame:
    """The rows that match, with score. The plan is one scan: filters are pushed down, text columns pruned if unused."""
    groups = compile_query(query, **(dictionaries or {}))
    norm = F.coalesce(norm_col, F.lit(""))
    return apply_filters(speeches, **filters).where(match(norm, groups)).withColumn("score", hit_score(norm, groups))


def search_summary(matched: DataFrame) -> DataFrame:
    """Rows, meetings and hits of a result."""
    return matched.agg(F.count("*").alias("n_rows"), F.count_distinct("meeting_id").alias("n_meetings"), F.coalesce(F.sum("score"), F.lit(0)).alias("n_hits"))


def rank_columns(by: str, order: list[str]) -> list[Column]:
    date, score = F.coalesce("date", F.lit("")).desc(), F.col("score").desc()
    return [*((score, date) if by == "relevance" else (date, score)), *(F.col(c).asc() for c in order)]


def rank(df: DataFrame, by: str = "date", order: list[str] | None = None) -> DataFrame:
    """By date or relevance, ties in the order of the index (its columns in ``order``)."""
    return df.orderBy(*rank_columns(by, order or ["ord"]))


def page(ranked: DataFrame, n: int = 1, size: int = PAGE) -> DataFrame:
    """The n-th page of a ranked result; a top-k, not a sort of everything."""
    return ranked.offset((n - 1) * size).limit(size)


def page_count(matched: DataFrame, size: int = PAGE) -> DataFrame:
    return matched.agg(F.ceil(F.count("*") / size).cast("long").alias("n_pages"))


def after(df: DataFrame, date: str, score: int, ord_: int, by: str = "date") -> DataFrame:
    """Rows behind a given one in rank order: deep pages without an offset."""
    d, s, o = F.coalesce("date", F.lit("")), F.col("score"), F.col("ord")
    first, second, a, b = (s, d, F.lit(score), F.lit(date)) if by == "relevance" else (d, s, F.lit(date), F.lit(score))
    return df.where((first < a) | ((first == a) & ((second < b) | ((second == b) & (o > ord_)))))


def search_many(speeches: DataFrame, queries: list[tuple[str, str]], id_cols: list[str], norm_col: str = "norm", dictionaries: dict | None = None) -> DataFrame:
    """(query_id, …id_cols, score) for a table of saved queries in one scan, however many they are.

    A row's matches are worked out as an array and exploded, so a speech is read once for all queries. The queries are
    configuration: a list that the caller holds.
    """
    compiled = [(name, compile_query(q, **(dictionaries or {}))) for name, q in queries]
    norm = F.coalesce(norm_col, F.lit(""))
    if len(compiled) > INLINE_QUERIES:
        return _by_automaton(speeches.select(*id_cols, norm.alias("__norm")), compiled)
    hits = F.array(*(F.when(match(norm, g), F.struct(F.lit(name).alias("query_id"), hit_score(norm, g).alias("score"))) for name, g in compiled))
    return speeches.select(*id_cols, F.explode(F.array_compact(hits)).alias("h")).select("h.query_id", *id_cols, "h.score")


def _by_automaton(rows: DataFrame, compiled: list[tuple[str, list[list[Term]]]]) -> DataFrame:
    """The same for rows with a column __norm: a text is read once for the terms of all queries, and only queries with a
    term that occurs, or without a positive one, are looked at."""
    sent = rows.sparkSession.sparkContext.broadcast(compiled)
    ids = [c for c in rows.columns if c != "__norm"]
    kinds = dict(rows.dtypes)

    def score(text: str, present: set[str], groups: list[list[Term]]) -> int | None:
        held = [g for g in groups if all(t.negative != any(a in present for a in t.alternatives) for t in g)]
        if groups and not held:
            return None
        counts = [sum(text.count(next(a for a in t.alternatives if a in present)) for t in g if not t.negative and t.alternatives) for g in held]
        return max(counts, default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        queries = sent.value
        machine, asked, always = ahocorasick.Automaton(), defaultdict(set), set()
        for i, (_, groups) in enumerate(queries):
            if not groups:
                always.add(i)
            for group in groups:
                terms = [a for t in group if not t.negative for a in t.alternatives]
                for a in terms:
                    asked[a].add(i)
                if not terms:
                    always.add(i)
                for t in group:
                    for a in t.alternatives:
                        machine.add_word(a, a)
        machine.make_automaton()
        every = pa.array([name for name, _ in queries], pa.string())

        def matches(batch: pa.RecordBatch, at: array, which: array, scores: array) -> pa.RecordBatch:
            kept = [batch.column(c).take(pa.array(at, pa.int32())) for c in ids]
            return pa.RecordBatch.from_arrays([every.take(pa.array(which, pa.int32())), *kept, pa.array(scores, pa.int32())], ["query_id", *ids, "score"])

        for batch in batches:
            at, which, scores = array("i"), array("i"), array("i")
            for row, text in enumerate(batch.column("__norm")):
                text = text.as_py()
                present = {a for _, a in machine.iter(text)} if len(machine) else set()
                for i in sorted(always.union(*(asked[a] for a in present if a in asked))):
                    found = score(text, present, queries[i][1])
                    if found is not None:
                        at.append(row)
                        which.append(i)
                        scores.append(found)
                if len(at) >= MATCHES:  # handed on before the batch is through, which may hold any number of them
                    yield matches(batch, at, which, scores)
                    at, which, scores = array("i"), array("i"), array("i")
            yield matches(batch, at, which, scores)

    return rows.mapInArrow(run, ", ".join(["query_id string", *(f"`{c}` {kinds[c]}" for c in ids), "score int"]))
