"""The catalogue of meetings and their files, from pages with links."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.eras import era_to_year, kanji_number
from ..functions.text import DIGITS, WS, let, squeeze_ws, to_half_digits, trim_ws

# Ids of meetings in addresses, pages that only look like meetings, and categories.
MEETING_ID = "0000[0-9]{5,6}"
DENIED = ["0000006723", "0000003025"]
CATEGORY = "category/32-3-6-[0-9]+"
EXTRA, REGULAR = "臨時会", "定例会"


#: An ampersand that begins no reference with a semicolon. It stands for itself, as in ?a=1&copy=2 and in texts that were cut.
_BARE = re.compile("&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)")


class _Links(HTMLParser):
    """First heading, title, and anchors with their text; scripts and styles are no text."""

    def read(self, html: str) -> None:
        self.feed(_BARE.sub("&amp;", html))
        self.close()

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.links: list[list[str]] = []
        self.heads: dict[str, list[str]] = {}
        self.open: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.open = [x for x in self.open if x is not self.links]  # an anchor ends an anchor left open
            self.links.append([dict(attrs).get("href") or "", ""])
        elif tag in ("h1", "title") and tag not in self.heads:
            self.heads[tag] = []
        self.open.append([tag])

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i] == [tag]:
                del self.open[i:]
                return

    def handle_data(self, data):
        inside = {x[0] for x in self.open}
        if inside & {"script", "style"}:
            return
        for tag in ("h1", "title"):
            if tag in inside:
                self.heads[tag].append(data)
        if "a" in inside and self.links:
            self.links[-1][1] += data


def extract_links(pages: DataFrame, root: str, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` without its html, with title and links (text, href absolute against ``root``); empty hrefs are dropped.
    References without a semicolon stay as they are."""

    @F.pandas_udf("struct<title: string, links: array<struct<text: string, href: string>>>")
    def parse(htmls: pd.Series) -> pd.DataFrame:
        titles, links = [], []
        for html in htmls:
            page = _Links()
            page.read(html or "")
            texts = ["".join(page.heads.get(t, [])).strip() for t in ("h1", "title")]
            titles.append(texts[0] or texts[1])
            links.append([{"text": " ".join(text.split()), "href": _absolute(root, href)} for href, text in page.links if href])
        return pd.DataFrame({"title": titles, "links": links})

    rest = [c for c in pages.columns if c != html_col]
    return pages.withColumn("__page", parse(F.col(html_col))).select(*rest, "__page.title", "__page.links")


def _absolute(root: str, href: str) -> str:
    try:
        return urljoin(root, href)
    except ValueError:
        return href


def is_meeting_href(href: Column) -> Column:
    """A page right below the domain whose name is a meeting id that is not denied."""
    return href.rlike(f"^https?://[^/]+/{MEETING_ID}\\.html\\z") & ~F.regexp_extract(href, MEETING_ID, 0).isin(DENIED)


def is_category_href(href: Column) -> Column:
    return href.rlike(CATEGORY)


def meeting_id_of(url: Column) -> Column:
    plain = F.regexp_extract(url, "([0-9]{4,6})\\.html", 1)
    full = F.regexp_extract(url, MEETING_ID, 0)
    return F.when(full != "", full).when(plain != "", plain)


def parse_era_year(name: Column) -> tuple[Column, Column]:
    """(era, year) of a name like 令和7年…; nulls if there is none or its number cannot be read."""
    pattern = f"(令和|平成|昭和){WS}*([0-9０-９一二三四五六七八九十元]+){WS}*年"
    number = let(to_half_digits(F.regexp_extract(name, pattern, 2)), kanji_number)
    era = F.regexp_extract(name, pattern, 1)
    shown = let(number, lambda n: F.concat(era, F.when(n == 1, "元").otherwise(n.cast("string")), F.lit("年")))
    return shown, let(number, lambda n: era_to_year(era, n))


def meeting_type(name: Column) -> Column:
    return F.when(name.contains("臨時"), EXTRA).otherwise(REGULAR)


def guess_date(href: Column, label: Column, year: Column) -> Column:
    """Eight digits before a PDF's name, else a month and day in the label with the meeting's year; else null."""
    stamp = F.regexp_extract(href, "(?i)/([0-9]{8})[^/]*\\.pdf\\z", 1)
    month, day = (F.lpad(F.regexp_extract(label, "([0-9]{1,2})月([0-9]{1,2})日", g), 2, "0") for g in (1, 2))
    dated = F.concat_ws("-", F.substring(stamp, 1, 4), F.substring(stamp, 5, 2), F.substring(stamp, 7, 2))
    spoken = label.rlike("[0-9]{1,2}月[0-9]{1,2}日") & year.isNotNull() & (year != 0)
    return F.when(stamp != "", dated).when(spoken, F.concat_ws("-", year.cast("string"), month, day))


def build_catalog(links: DataFrame) -> DataFrame:
    """Meetings by id from (ord, text, href), the first occurrence of each: id, url, name, era, year, type, indexed."""
    own = links.where(is_meeting_href(F.col("href"))).withColumn("id", meeting_id_of(F.col("href")))
    first = own.where("id is not null").groupBy("id").agg(F.min(F.struct("ord", "href", "text")).alias("x"))
    name = trim_ws(F.regexp_replace(F.coalesce("x.text", F.lit("")), "・会議録\\z", ""))
    named = first.select("id", F.col("x.href").alias("url"), name.alias("name"), F.col("x.ord").alias("ord"))
    era, year = parse_era_year(F.col("name"))
    return named.select("id", "name", year.alias("year"), era.alias("era"), meeting_type(F.col("name")).alias("type"), "url", F.lit(False).alias("indexed"), "ord")


def meeting_pdfs(pages: DataFrame) -> DataFrame:
    """Files of each meeting page (id, url, title, links): id, name, type, era, year, url, pdfs; no row without a file."""
    name = trim_ws(F.regexp_replace(F.col("title"), "・会議録\\z", ""))
    named = pages.withColumn("name", name)
    era, year = parse_era_year(F.col("name"))
    about = named.withColumn("era", era).withColumn("year", year)
    files = F.filter("links", lambda x: x["href"].rlike("(?i)/cmsfiles/.+\\.pdf\\z"))
    first = F.filter(files, lambda x, i: ~F.exists(F.slice(files, 1, F.greatest(i, F.lit(0))), lambda y: y["href"] == x["href"]))

    def pdf(x: Column) -> Column:
        label = F.when(x["text"] != "", x["text"]).otherwise(F.element_at(F.split(x["href"], "/"), -1))
        return F.struct(label.alias("label"), guess_date(x["href"], label, F.col("year")).alias("date"), x["href"].alias("url"))

    out = about.withColumn("pdfs", F.transform(first, pdf)).where(F.size("pdfs") > 0)
    return out.select("id", "name", meeting_type(F.col("name")).alias("type"), "era", "year", "url", "pdfs")


def select_targets(catalog: DataFrame, ids: list[str] | None = None, limit: int = 0) -> DataFrame:
    """The meetings asked for, compared without leading zeros; the first ``limit`` of them."""
    plain = [i.lstrip("0") for i in ids or []]
    out = catalog.where(F.regexp_replace("id", "^0+", "").isin(plain)) if plain else catalog
    return out.orderBy("ord").limit(limit) if limit else out


def order_meetings(df: DataFrame) -> DataFrame:
    return df.orderBy(F.coalesce("year", F.lit(0)).desc(), F.desc("id"))


def mark_crawled(toc: DataFrame, meetings: DataFrame) -> DataFrame:
    """The catalogue with name and files of the meetings that were read, marked as indexed."""
    done = meetings.select("id", F.col("name").alias("__name"), F.col("pdfs").alias("__pdfs"))
    out = toc.drop("pdfs").join(done, "id", "left")
    return out.withColumn("indexed", F.col("__pdfs").isNotNull()).withColumn("name", F.coalesce("__name", "name")).withColumn("pdfs", F.coalesce("__pdfs", F.array().cast(dict(meetings.dtypes)["pdfs"]))).drop("__name", "__pdfs")


def mark_indexed(toc: DataFrame, speeches: DataFrame) -> DataFrame:
    """The catalogue with indexed set where a meeting has a speech."""
    have = speeches.select(F.col("meeting_id").alias("id"), F.lit(True).alias("__has")).distinct()
    return toc.drop("indexed").join(have, "id", "left").withColumn("indexed", F.coalesce("__has", F.lit(False))).drop("__has")


def announcement_key(name: Column) -> tuple[Column, Column, Column]:
    """(year, type, month) by which announcements and meetings are matched."""
    after = lambda era, base: F.regexp_extract(name, f"{era}([0-9]+)年", 1).try_cast("int") + base
    year = F.when(name.contains("令和元年"), 2019).otherwise(F.coalesce(after("令和", 2018), after("平成", 1988)))
    month = F.coalesce(F.regexp_extract(name, "[（(]([0-9]+)月", 1).try_cast("int"), F.regexp_extract(name, "([0-9]+)月[定臨]", 1).try_cast("int"))
    return year, meeting_type(name), month


def match_meeting_pages(toc: DataFrame, announcements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(meeting id, page_url) for the meetings with an announcement (ord, name, url; the last per key), and the rest."""
    year, kind, month = announcement_key(F.col("name"))
    known = announcements.select(year.alias("year"), kind.alias("type"), month.alias("month"), "ord", "url").where("year is not null and month is not null")
    last = known.groupBy("year", "type", "month").agg(F.max_by("url", "ord").alias("page_url"))
    own = toc.withColumn("month", announcement_key(F.col("name"))[2])
    on = ["year", "type", "month"]
    return own.join(last, on).select("id", "page_url"), own.join(last, on, "left_anti").select(*toc.columns)


def text_key(meeting_id: Column, date: Column, url: Column) -> Column:
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split(url, "/"), -1), "(?i)\\.pdf\\z", ""), "[^A-Za-z0-9_.-]", "_")
    return F.concat_ws("_", meeting_id, F.coalesce(F.replace(date, F.lit("-"), F.lit("")), stem))


def flat_pdfs(meetings: DataFrame) -> DataFrame:
    """One row per file of a meeting, with its place and text key."""
    from .bills import is_toc_pdf

    rows = meetings.select(F.col("id").alias("meeting_id"), F.posexplode("pdfs").alias("pdf_pos", "p")).select("meeting_id", "pdf_pos", "p.*")
    return rows.withColumn("text_key", text_key(F.col("meeting_id"), F.col("date"), F.col("url"))).withColumn("is_toc", is_toc_pdf(F.col("url"), F.col("label")))


def pending_texts(pdfs: DataFrame, existing: DataFrame) -> DataFrame:
    """The files whose text is not there yet."""
    return pdfs.join(existing.select("text_key").distinct(), "text_key", "left_anti").select(*pdfs.columns)


def pdf_manifest(meetings: DataFrame, toc: DataFrame) -> DataFrame:
    """One row per file of both tables, by meeting and file name, the last address winning: file, url."""
    both = None
    for rank, table in enumerate((meetings, toc)):
        rows = table.select(F.lit(rank).alias("table"), F.col("id").alias("meeting_id"), F.coalesce("year", F.lit(0)).alias("year"), F.posexplode("pdfs").alias("pos", "p"))
        rows = rows.select(F.concat_ws("_", "meeting_id", F.element_at(F.split("p.url", "/"), -1)).alias("file"), F.struct("table", (-F.col("year")).alias("year"), "pos").alias("at"), F.col("p.url").alias("url"))
        both = rows if both is None else both.unionByName(rows)
    return both.groupBy("file").agg(F.max_by("url", "at").alias("url"))


def local_pdf_path(meeting_id: Column, url: Column, folder: str) -> Column:
    return F.concat(F.lit(f"{folder}/"), F.concat_ws("_", meeting_id, F.element_at(F.split(url, "/"), -1)))


def rewrite_pdf_links(speeches: DataFrame, mapping: DataFrame) -> DataFrame:
    """Speeches with the bundled path of their file (mapping: url, path) where there is one, the least of several."""
    known = mapping.groupBy(F.col("url").alias("pdf")).agg(F.min("path").alias("__path"))
    return speeches.join(known, "pdf", "left").withColumn("pdf", F.coalesce("__path", "pdf")).select(*speeches.columns)


def rewrite_nested_links(meetings: DataFrame, mapping: DataFrame) -> DataFrame:
    """Meetings with the same done inside their files."""
    rows = meetings.select("id", F.posexplode_outer("pdfs").alias("pos", "p")).join(mapping.groupBy(F.col("url").alias("__url")).agg(F.min("path").alias("path")), F.col("p.url") == F.col("__url"), "left")
    pdf = F.struct("pos", F.struct(F.col("p.label").alias("label"), F.col("p.date").alias("date"), F.coalesce("path", "p.url").alias("url")).alias("p"))
    nested = rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), pdf))), lambda x: x["p"]).alias("pdfs"))
    return meetings.drop("pdfs").join(nested, "id").select(*meetings.columns)


def link_rows(pages: DataFrame, order: Column) -> DataFrame:
    """Links of pages one by one with an ordinal: those of a page with a smaller ``order`` come first."""
    rows = pages.select(order.alias("__page"), F.posexplode("links").alias("__pos", "x"))
    return rows.select(F.struct("__page", "__pos").alias("ord"), F.col("x.text").alias("text"), F.col("x.href").alias("href"))


def heading(col: Column) -> Column:
    return squeeze_ws(col)
