"""Transcripts to speeches: who spoke, in what role, and what was said.

A text file is one row (``meeting_id, text_key, raw`` and whatever else describes it). Everything up to the speech row is
narrow: the text is marked at every speaker, split, and exploded in place; the roster of a file is a map on its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DIGITS, FULL, HALF, SPACE, WS, drop_ws, find_all, let, to_half_digits, trim_ws
from ..sources.scratch import narrow

# A speaker's mark, role（name君）; the names given to what has no speaker; bill prefixes; member roles.
# A mark is looked for by its name; the role is then read backwards, so that no place is tried as the beginning of a role.
_ROLE = f"{SPACE}、。「」（）"
MARK, ROLE, LONGEST_ROLE = f"（(?<=[^{_ROLE}]（)([^（）\\n]{{1,14}})君）", f"[^{_ROLE}\\u0001-\\u0003]+\\z", 16
PREAMBLE, WHOLE = "（会議録情報）", "（本文）"
BILL = "(議第|報第|議案第|選第|諮第|発議第)"
SEAT_ROLE, MEMBER_ROLE = f"^{DIGITS}*番\\z", f"^{DIGITS}+番\\z"
DASH = "－―‐"
BRACKETS = "〔〕〈〉《》【】"


def clean_label(col: Column) -> Column:
    """A role or name without page headers, line numbers, stage directions and stray numbers; seats in half width."""
    r = drop_ws(col)
    r = F.regexp_replace(r, f"^[{DASH}\\-]+{DIGITS}+[{DASH}\\-]+", "")
    r = F.regexp_replace(r, f"^{DIGITS}+[-{DASH}]{DIGITS}+(?={DIGITS}*番)", "")
    r = F.regexp_replace(r, f"^{DIGITS}+[-{DASH}]{DIGITS}+", "")
    r = F.regexp_replace(r, f"^(?:[{DASH}][^{DASH}]*[{DASH}])+", "")
    r = F.regexp_replace(r, f"^.*[{DASH}]", "")
    r = F.regexp_replace(r, f"^.*[{BRACKETS}]", "")
    for full, half in zip(FULL, HALF, strict=True):
        r = F.regexp_replace(r, f"{full}(?={DIGITS}*番)", half)
    return F.regexp_replace(r, f"^{DIGITS}+(?=[^0-9０-９番])", "")


def _parts(raw: Column) -> Column:
    """A text cut before every speaker's mark: (role, name, text) as printed; the first part has no role or name."""
    plain = F.regexp_replace(F.coalesce(raw, F.lit("")), "[\\u0001-\\u0003]", "")
    cut = F.split(F.regexp_replace(plain, MARK, "\u0001$1\u0003"), "\u0001", -1)

    def parts(pieces: Column, roles: Column) -> Column:
        """Of pieces "name, text, role of the next"."""

        def part(piece: Column, i: Column) -> Column:
            said = F.element_at(F.split(piece, "\u0003", -1), -1)
            text = let(said, lambda x: F.when(i + 1 < F.size(pieces), F.left(x, F.length(x) - F.length(roles[i]))).otherwise(x))
            return F.struct(F.get(roles, i - 1).alias("role"), F.when(i > 0, F.substring_index(piece, "\u0003", 1)).alias("name"), text.alias("text"))

        return F.transform(pieces, part)

    roles = lambda pieces: F.transform(pieces, lambda piece: F.regexp_extract(F.right(piece, F.lit(LONGEST_ROLE)), ROLE, 0))
    return let(cut, lambda pieces: let(F.struct(pieces.alias("pieces"), roles(pieces).alias("roles")), lambda x: parts(x["pieces"], x["roles"])))


def _speech(part: Column, i: Column, alone: Column, led: Column) -> list[Column]:
    """speech_pos, role, name and text of the i-th part of a text; ``alone``: there is no other, ``led``: it begins with a mark."""
    first = i == 0
    return [
        F.when(alone, 0).otherwise(i - F.when(led, 1).otherwise(0)).alias("speech_pos"),
        F.when(first, "").otherwise(clean_label(part["role"])).alias("role"),
        F.when(alone, WHOLE).when(first, PREAMBLE).otherwise(clean_label(part["name"])).alias("name"),
        trim_ws(part["text"]).alias("text"),
    ]


def split_speeches(texts: DataFrame) -> DataFrame:
    """One row per speech of each text: speech_pos, role, name, text, and the columns of ``texts`` but raw.

    What stands before the first speaker, and a text without any, is a row of its own. An empty speech keeps its number.
    """
    rest = [c for c in texts.columns if c != "raw"]
    rows = texts.withColumn("__parts", _parts(F.col("raw"))).select(*rest, (F.size("__parts") == 1).alias("__alone"), (F.col("__parts")[0]["text"] == "").alias("__led"), F.posexplode("__parts").alias("__pos", "__part"))
    rows = rows.where(F.col("__alone") | (F.col("__pos") > 0) | ~F.col("__led"))
    return rows.select(*rest, *_speech(F.col("__part"), F.col("__pos"), F.col("__alone"), F.col("__led")))


def speech_list(raw: Column) -> Column:
    """The same as an array on the text's own row, roles with the seats of its roster; without empty speeches."""

    def rows(parts: Column, seats: Column) -> Column:
        alone, led = F.size(parts) == 1, parts[0]["text"] == ""
        every = F.transform(parts, lambda p, i: F.when(alone | (i > 0) | ~led, F.struct(*_speech(p, i, alone, led))))
        return F.transform(F.filter(every, lambda x: x["text"] != ""), lambda x: x.withField("role", resolve_seats(x["role"], x["name"], seats)))

    return let(F.struct(_parts(raw).alias("parts"), seat_map(raw).alias("seats")), lambda x: rows(x["parts"], x["seats"]))


def seat_list(raw: Column) -> Column:
    """(name, pos, seat) of the roster of members present, in order of name; of several seats for a name the last."""
    end = "欠席|遅刻|途中退席|[2２]．"
    present = lambda roster: F.when(roster.rlike(end), F.regexp_extract(roster, f"(?s)^(.*?)(?:{end})", 1)).otherwise(F.substring(roster, 1, 400))
    roster = F.when(raw.contains("出席議員"), F.regexp_extract(raw, "(?s)(出席議員[（(].*)", 1)).when(raw.isNotNull(), "")
    block = let(roster, present)
    pairs = find_all(block, f"({DIGITS}+){WS}*番{WS}*([^0-9０-９]+?)(?={DIGITS}+{WS}*番|\\z)", 2)
    named = F.transform(pairs, lambda p, i: F.struct(F.regexp_replace(p["g2"], f"[{SPACE}・]", "").alias("name"), i.alias("pos"), F.concat(to_half_digits(p["g1"]), F.lit("番")).alias("seat")))
    kept = F.array_sort(F.filter(named, lambda p: F.length(p["name"]).between(2, 6)))
    # in order of name and place, the last of a name stands before another one
    return let(kept, lambda own: F.filter(own, lambda p, i: ~F.get(own, i + 1)["name"].eqNullSafe(p["name"])))


def seat_map(raw: Column) -> Column:
    """Name to seat, from the roster of members present."""
    return F.map_from_entries(F.transform(seat_list(raw), lambda p: F.struct(p["name"], p["seat"])))


def seat_rows(texts: DataFrame) -> DataFrame:
    """The same as rows (text_key, name, seat), for rosters of any length."""
    return texts.select("text_key", F.explode(seat_list(F.col("raw"))).alias("p")).select("text_key", "p.name", "p.seat")


def with_seats(speeches: DataFrame, seats: DataFrame) -> DataFrame:
    """``resolve_seats`` of speeches (text_key, name, role, …) by a join with ``seat_rows``, one for each file and name."""
    found = speeches.join(seats.withColumnRenamed("seat", "__seat"), ["text_key", "name"], "left")
    role = F.when(F.col("role").rlike(SEAT_ROLE), F.coalesce("__seat", "role")).otherwise(F.col("role"))
    return found.withColumn("role", role).select(*speeches.columns)


def resolve_seats(role: Column, name: Column, seats: Column) -> Column:
    """The seat of the file's roster instead of a printed one, where the roster has the name."""
    return F.when(role.rlike(SEAT_ROLE), F.coalesce(F.try_element_at(seats, name), role)).otherwise(role)


def detect_agenda_ref(text: Column) -> Column:
    """The first bill that a text refers to, like 議第48号; null if none."""
    pattern = f"{BILL}{WS}*({DIGITS}+){WS}*号"
    return F.when(text.contains("号") & text.rlike(pattern), F.concat(F.regexp_extract(text, pattern, 1), to_half_digits(F.regexp_extract(text, pattern, 2)), F.lit("号")))


def role_category(role: Column) -> Column:
    """Chair, member, official, or '' without a role."""
    return F.when(role.contains("議長"), "議長").when(role.rlike(MEMBER_ROLE), "議員").when(role != "", "当局").otherwise("")


def date_tag(date: Column, text_key: Column) -> Column:
    return F.coalesce(F.replace(date, F.lit("-"), F.lit("")), F.regexp_replace(text_key, "^[^_]*_?", ""))


def make_sid(meeting_id: Column, date: Column, text_key: Column, speech_pos: Column) -> Column:
    return F.concat_ws("_", meeting_id, date_tag(date, text_key), F.format_string("%04d", speech_pos))


def build_index(texts: DataFrame, pdfs: DataFrame, meetings: DataFrame) -> DataFrame:
    """The table of speeches.

    texts (meeting_id, text_key, raw); pdfs (meeting_id, pdf_pos, date, url, text_key); meetings (id, name, type, year,
    era). Two files of a meeting with the same date share a text, and their speeches their ids; they are kept. The catalogue
    tables are joined first and are the narrow side: texts are neither sorted nor moved unless these have too many rows to be
    broadcast.
    """
    about = pdfs.select("meeting_id", "pdf_pos", "date", F.col("url").alias("pdf"), "text_key").join(
        meetings.select(F.col("id").alias("meeting_id"), F.col("name").alias("meeting"), "type", "year", "era"), "meeting_id"
    )
    files = texts.select("text_key", "raw", seat_map(F.col("raw")).alias("seats")).join(narrow(about), "text_key")
    rows = split_speeches(files).where("text <> ''")
    return rows.select(
        make_sid(F.col("meeting_id"), F.col("date"), F.col("text_key"), F.col("speech_pos")).alias("sid"),
        "meeting_id", "meeting", "type", "year", "era", "date", "pdf",
        resolve_seats(F.col("role"), F.col("name"), F.col("seats")).alias("role"), "name",
        detect_agenda_ref(F.col("text")).alias("agenda_ref"), "text", "pdf_pos", "speech_pos",
    )


def index_stats(speeches: DataFrame, agenda: DataFrame, questioners: DataFrame) -> DataFrame:
    """One row of totals."""
    said = speeches.agg(F.count("*").alias("speeches"), F.count_distinct("meeting_id").alias("meetings"), F.count_distinct("name").alias("speakers"))
    return said.crossJoin(agenda.agg(F.count("*").alias("bills"))).crossJoin(questioners.agg(F.count("*").alias("questioners")))
