"""Bills and questioners, from the agenda at the head of a session and from tables of contents.

Per-file extraction is narrow; the merge by meeting shuffles only (meeting, number, title) rows. "First" and "last" follow
the position of a file in its meeting and of a match in its file, kept in the columns pdf_pos and ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import DIGITS, SPACE, WS, drop_newlines, drop_ws, find_all, let, to_half_digits
from .speeches import BILL

# Where the minutes proper begin; prefixes of bills in tables of contents; kinds with their words, in order.
BODY = "会議の概要"
ENDS = "〃|日程第|会議の概要|議第|報第|議案第|選第|諮第|発議第"
TOC_BILL = "(議第|報第|議案第|選第|諮第|発議第|決議案第)"
RANGE = f"(議第|報第|議案第){WS}*({DIGITS}+){WS}*号{WS}*から{WS}*(?:議第|報第|議案第)?{WS}*({DIGITS}+){WS}*号{WS}*まで{WS}*[（(]([^）)…‥]*)"
KINDS = [
    ("契約", "工事請負|請負契約|契約の締結|契約について"),
    ("指定管理", "指定管理者の指定"),
    ("意見書", "意見書|決議について|要望書?決議"),
    ("財産", "財産の取得|財産の処分|財産の無償|不動産の取得"),
    ("債権放棄", "私債権の放棄|債権の放棄"),
    ("組合", "組合規約の変更|組合の解散|一部事務組合|組合を組織"),
    ("選挙", "選挙について|議長選挙|副議長選挙|選挙の方法"),
    ("委員会", "特別委員会の設置|委員会の設置|委員会の委員の定数|協議会の設置"),
    ("人事", "任命|推薦|選任|同意|委嘱|評価員|監査委員|固定資産|教育委員|人権擁護"),
    ("路線", "路線の認定|路線の廃止|路線の変更|町道.*(認定|変更)"),
    ("条例", "条例"),
    ("規則", "会議規則|規則の一部|規則の制定"),
    ("予算", "補正予算|当初予算|予算（第|会計予算|歳入歳出予算"),
    ("決算", "決算の認定|歳入歳出決算|決算"),
    ("報告", "報告|繰越.*計算書|健全化.*比率|計算書|専決処分.*報告"),
    ("一般質問", "一般質問"),
]
OTHER = "その他"
LONGEST_RANGE = 30


def bill_kind(col: Column) -> Column:
    """The kind of a bill by the words in its number and title."""
    out = F.when(F.lit(False), F.lit(""))
    for kind, words in KINDS:
        out = out.when(col.rlike(words), kind)
    return out.otherwise(OTHER)


def is_toc_pdf(url: Column, label: Column) -> Column:
    return F.concat_ws(" ", url, F.coalesce(label, F.lit(""))).rlike("(?i)mokuji|目次")


def agenda_head(raw: Column) -> Column:
    """What stands before the minutes proper; if that is empty, the first 8,000 characters."""
    flat = drop_newlines(raw)
    head = F.split(flat, BODY, 2)[0]
    return F.when(head != "", head).otherwise(F.substring(flat, 1, 8000))


def number(prefix: Column, n: Column) -> Column:
    return F.concat(prefix, to_half_digits(n), F.lit("号"))


def clean_title(col: Column) -> Column:
    """A title without spaces, leader dots, page references and fragments of ranges; 80 characters at most."""
    t = F.regexp_replace(drop_ws(col), "^[、，]", "")
    for pattern in ("(?s)[…・]{2,}.*\\z", "(?s)[0-9]+[－-][0-9]+[．.0-9]*.*\\z", "^から\\z", "[0-9]+[-－][0-9]+\\z", "[－‐-][0-9]+[－‐-]?\\z"):
        t = F.regexp_replace(t, pattern, "")
    return F.substring(t, 1, 80)


#: Places of what comes behind everything found with a title of its own.
BEHIND = 1_000_000


def first_by_number(matches: DataFrame, *keys: str) -> DataFrame:
    """(keys, no, title, ord): of matches (pos, no, title) the first of each number."""
    first = matches.groupBy(*keys, "no").agg(F.min(F.struct("pos", "title")).alias("x"))
    return first.select(*keys, "no", "x.title", F.col("x.pos").alias("ord"))


def _numbered(text: Column, found: Column) -> Column:
    """``found``, bills in a text. All prefixes have this character, so the patterns do not go through a text without it."""
    return F.when(text.contains("第"), found).when(text.isNotNull(), F.array().cast("array<struct<pos: int, no: string, title: string>>"))


def bill_matches(raw: Column) -> Column:
    """(pos, no, title) of every bill in an agenda's head: those with a title, then all numbers without one."""
    found = lambda head, pattern, n: find_all(head, f"{BILL}{WS}*({DIGITS}+){WS}*号{pattern}", n)
    row = lambda m, pos, title: F.struct(pos.cast("int").alias("pos"), number(m["g1"], m["g2"]).alias("no"), title.alias("title"))

    def both(head: Column) -> Column:
        titled = F.transform(found(head, f"{WS}*([^〃]*?)(?={ENDS}|\\z)", 3), lambda m, i: row(m, i, clean_title(m["g3"])))
        seen = F.transform(found(head, "", 2), lambda m, i: row(m, i + BEHIND, F.lit(None).cast("string")))
        return F.concat(F.filter(titled, lambda x: x["title"] != ""), seen)

    return let(agenda_head(raw), lambda head: _numbered(head, both(head)))


def named_bills(matches: DataFrame, *keys: str) -> DataFrame:
    """(keys, no, kind, title, ord) of matches: the first title stands for a number, else the number for itself."""
    first = first_by_number(matches, *keys)
    kind = F.when(F.col("title").isNull(), OTHER).otherwise(bill_kind(F.concat("no", "title")))
    return first.select(*keys, "no", kind.alias("kind"), F.coalesce("title", "no").alias("title"), "ord")


def extract_bills(texts: DataFrame) -> DataFrame:
    """(text_key, no, kind, title, ord) of each text, and the other columns of ``texts`` but raw.

    The first title that is not empty stands for a number; numbers without any title come last, with themselves as title.
    """
    rest = [c for c in texts.columns if c != "raw"]
    return named_bills(texts.select(*rest, F.inline(bill_matches(F.col("raw")))), *rest)


def item_matches(raw: Column) -> Column:
    """(pos, no, title) of the single bills in a table of contents."""
    pattern = f"^１．{WS}*{TOC_BILL}{WS}*({DIGITS}+){WS}*号{WS}*(.+)"

    def item(part: Column, i: Column) -> Column:
        line = drop_newlines(part)
        title = F.regexp_extract(line, pattern, 3)
        for cut in ("[…‥]+.*\\z", f"{DIGITS}+[－-]{DIGITS}+.*\\z", "〔.*\\z"):
            title = F.regexp_replace(title, cut, "")
        made = F.struct(i.cast("int").alias("pos"), number(F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2)).alias("no"), drop_ws(title).alias("title"))
        return F.when(line.rlike(pattern), made)

    items = F.transform(F.split(raw, "(?=１．)"), item)
    return F.filter(items, lambda x: x.isNotNull() & ~x["title"].startswith("から") & (F.length(x["title"]) >= 3))


def range_matches(raw: Column) -> Column:
    """(pos, no, title) of every number in the ranges "A to B (title)", none of which is longer than 31."""
    limit = lambda m, g: to_half_digits(m[g]).try_cast("int")

    def numbers(m: Column, pos: Column) -> Column:
        low, high, title = limit(m, "g2"), limit(m, "g3"), drop_ws(m["g4"])
        one = lambda n: F.struct((BEHIND + pos * (LONGEST_RANGE + 1) + n).cast("int").alias("pos"), F.concat(m["g1"], n.cast("string"), F.lit("号")).alias("no"), title.alias("title"))
        good = (title != "") & (high >= low) & (high - low <= LONGEST_RANGE)
        return F.when(good, F.transform(F.sequence(low, high), one)).otherwise(F.array().cast("array<struct<pos: int, no: string, title: string>>"))

    return F.flatten(F.transform(find_all(drop_newlines(raw), RANGE, 4), numbers))


def expand_bill_ranges(texts: DataFrame) -> DataFrame:
    """One row per number of every range, the first range per number."""
    rest = [c for c in texts.columns if c != "raw"]
    return first_by_number(texts.select(*rest, F.inline(range_matches(F.col("raw")))), *rest)


def toc_matches(raw: Column) -> Column:
    """Single items of a table of contents, then the numbers of ranges."""
    return _numbered(raw, F.concat(item_matches(raw), range_matches(raw)))


def extract_toc_titles(texts: DataFrame) -> DataFrame:
    """Titles by number of each table of contents: single items, then ranges for the numbers these lack."""
    rest = [c for c in texts.columns if c != "raw"]
    return first_by_number(texts.select(*rest, F.inline(toc_matches(F.col("raw")))), *rest)


def merge_bills(bills: DataFrame, toc: DataFrame) -> DataFrame:
    """Bills of a meeting: the first over its files; a title from a table of contents (the last file's) replaces it, and
    adds what is missing. Columns meeting_id, no, kind, title and place, the order of insertion."""
    b = bills.groupBy("meeting_id", "no").agg(F.min(F.struct("pdf_pos", "ord", "kind", "title")).alias("b"))
    t = toc.groupBy("meeting_id", "no").agg(F.max_by("title", "pdf_pos").alias("toc_title"), F.min(F.struct("pdf_pos", "ord")).alias("t"))
    both = b.join(t, ["meeting_id", "no"], "full")
    title = F.coalesce("toc_title", "b.title")
    kind = F.when(F.col("toc_title").isNotNull(), bill_kind(F.concat("no", title))).otherwise(F.col("b.kind"))
    place = F.struct(F.col("b").isNull().alias("added"), F.coalesce("b.pdf_pos", "t.pdf_pos").alias("pdf_pos"), F.coalesce("b.ord", "t.ord").alias("ord"))
    return both.select("meeting_id", "no", kind.alias("kind"), title.alias("title"), place.alias("place"))


def drop_resolution_duplicates(bills: DataFrame) -> DataFrame:
    """Without the bills that repeat a resolution's title in the same meeting under an ordinary number."""
    resolution = bills.where(F.col("no").startswith("決議案第")).select("meeting_id", "title").distinct()
    ordinary = F.col("no").rlike("^(議第|議案第)")
    again = bills.where(ordinary).join(resolution, ["meeting_id", "title"], "left_anti").select(*bills.columns)
    return bills.where(~ordinary).unionByName(again)


def order_bills(bills: DataFrame) -> DataFrame:
    """With ord, the place by number in its meeting; ties in order of insertion."""
    n = F.coalesce(F.regexp_replace("no", "[^0-9]", "").try_cast("long"), F.lit(0))
    return bills.withColumn("ord", F.row_number().over(Window.partitionBy("meeting_id").orderBy(n, "place", "no"))).drop("place")


def build_agenda(bills: DataFrame, toc: DataFrame) -> DataFrame:
    return order_bills(drop_resolution_duplicates(merge_bills(bills, toc)))


def questioner_matches(raw: Column) -> Column:
    """(pos, member) of everybody named after the first mention of general questions in the head."""
    head = F.split(raw, BODY, 2)[0]
    block = F.when(head.contains("一般質問"), F.regexp_extract(head, "(?s)(一般質問.*)", 1)).when(head.isNotNull(), "")
    # A name is kanji in one or two parts before 君.
    pattern = f"{DIGITS}{{1,2}}{WS}*番[{SPACE}、,]*([一-龥々]{{2,4}}){WS}*([一-龥々]{{0,4}}){WS}*君"
    return F.transform(find_all(block, pattern, 2), lambda m, i: F.struct(i.cast("int").alias("pos"), F.concat(m["g1"], m["g2"]).alias("member")))


def first_by_member(matches: DataFrame, *keys: str) -> DataFrame:
    return matches.groupBy(*keys, "member").agg(F.min("pos").alias("ord")).select(*keys, "ord", "member", F.lit("").alias("theme"))


def extract_questioners(texts: DataFrame) -> DataFrame:
    """(…, ord, member, theme) of each text, the first mention per name."""
    rest = [c for c in texts.columns if c != "raw"]
    return first_by_member(texts.select(*rest, F.inline(questioner_matches(F.col("raw")))), *rest)


def merge_questioners(questioners: DataFrame) -> DataFrame:
    """Per meeting, the first mention of each over its files in order."""
    first = questioners.groupBy("meeting_id", "member").agg(F.min(F.struct("pdf_pos", "ord")).alias("at"))
    ord_ = F.row_number().over(Window.partitionBy("meeting_id").orderBy("at"))
    return first.select("meeting_id", ord_.alias("ord"), "member", F.lit("").alias("theme"))
