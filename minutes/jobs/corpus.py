"""The three workloads end to end: build the index, search it, rank themes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, extraction, highlight, search, themes
from ..sources import tables
from ..sources.scratch import stored


def build_tables(texts: DataFrame, meetings: DataFrame) -> dict[str, DataFrame]:
    """speeches, agenda and questioners of the meetings' files; the texts are read once, and what they hold is stored."""
    return extraction.tables_of(stored(extraction.extract(texts, meetings), "extracted"))


def index_folder(spark: SparkSession, text_dir: str, meetings_path: str, toc_path: str, out: str) -> None:
    """Read texts and catalogue, and write the tables below ``out``."""
    meetings = tables.read_meetings(spark, meetings_path)
    made = build_tables(tables.read_texts(spark, text_dir), meetings)
    tables.write_speeches(made["speeches"], f"{out}/speeches", with_norm=True)
    for name in ("agenda", "questioners"):
        tables.write_table(made[name], f"{out}/{name}")
    toc = catalog.mark_indexed(tables.read_toc(spark, toc_path), spark.read.parquet(f"{out}/speeches"))
    tables.write_table(toc, f"{out}/toc")


def search_page(said: DataFrame, query: str, by: str = "date", n: int = 1, order: list[str] | None = None, dictionaries: dict | None = None, **filters) -> tuple[DataFrame, DataFrame]:
    """(summary, page): totals, and a page with snippets; highlighting runs on the rows of the page alone."""
    found = search.search(said, query, dictionaries=dictionaries, **filters)
    shown = search.page(search.rank(found, by, order), n)
    ranges = highlight.hit_ranges(F.col("text"), search.positive_alternatives(search.compile_query(query, **(dictionaries or {}))))
    return search.search_summary(found), shown.withColumn("ranges", ranges).withColumn("snippet", highlight.snippet(F.col("text"), F.col("ranges")))


def theme_ranking(said: DataFrame, agenda: DataFrame, extra: list[tuple[str, list[str]]] | None = None, top: int = themes.TOP) -> DataFrame:
    """The themes of a corpus: seeds, then titles of bills, then ``extra``, scored and ranked.

    At most 48 labels and those in ``extra`` come to the driver, where they become the expression that is matched.
    """
    seeds = [(s, [s]) for s in themes.SEEDS]
    titles = [(r["label"], [r["label"]]) for r in themes.title_candidates(agenda).collect()]
    every = dict(reversed([*seeds, *titles, *(extra or [])]))
    return themes.rank_themes(themes.score_themes(said, agenda, list(reversed(every.items()))), top)
