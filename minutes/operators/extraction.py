"""All that transcripts hold, in one reading of their texts.

``extract`` works out speeches, bills, titles of contents and questioners as arrays on the row of a text and emits them as
tagged rows, so texts are scanned, and joined to the catalogue, once. The rows are stored by the caller and read by kind;
what is left to do on them (the first of a number, merging by meeting) shuffles narrow rows only. A catalogue of few rows is
broadcast to the texts; beyond that they are worked out where they lie, and the rows are shuffled to it, so that the tasks of the
work are those of the reading, however few the shuffle makes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import is_narrow
from . import bills, catalog, speeches

#: Kinds of rows. A row of kind FILE stands for the text itself, so one that holds nothing leaves a trace.
FILE, SPEECH, BILL, CONTENTS, ASKED = "file", "speech", "bill", "contents", "asked"
_FIELDS = ("pos", "no", "title", "role", "name", "text")
_ABOUT = ("meeting_id", "pdf_pos", "date", "pdf", "is_toc", "meeting", "type", "year", "era")


def _tagged(kind: str, found: Column, **fields: str) -> Column:
    """An array of structs as tagged rows: ``fields`` names the tag's field for each of theirs."""
    named = {v: k for k, v in fields.items()}
    kinds = {"pos": "int"}
    one = lambda x: F.struct(F.lit(kind).alias("kind"), *((x[named[f]] if f in named else F.lit(None)).cast(kinds.get(f, "string")).alias(f) for f in _FIELDS))
    return F.transform(found, one)


def extract(texts: DataFrame, meetings: DataFrame) -> DataFrame:
    """(text_key, what the catalogue tells of the file, kind, pos, no, title, role, name, text) for texts (text_key, raw)."""
    pdfs = catalog.flat_pdfs(meetings).withColumnRenamed("url", "pdf")
    about = pdfs.join(meetings.select(F.col("id").alias("meeting_id"), F.col("name").alias("meeting"), "type", "year", "era"), "meeting_id")
    about, texts = about.select("text_key", *_ABOUT), texts.select("text_key", "raw")
    if is_narrow(about):
        return texts.join(F.broadcast(about), "text_key").select("text_key", *_ABOUT, F.inline(_held(F.col("is_toc"))))
    found = texts.select("text_key", F.inline(_held(F.lit(True)))).join(about, "text_key")
    return found.where((F.col("kind") != CONTENTS) | F.col("is_toc")).select("text_key", *_ABOUT, "kind", *_FIELDS)


def _held(is_toc: Column) -> Column:
    """The tagged rows of a text ``raw``; those of contents only where ``is_toc``."""
    raw, none = F.col("raw"), F.array().cast("array<struct<pos: int, no: string, title: string>>")
    return F.concat(
        _tagged(FILE, F.array(F.struct(F.lit(0).alias("pos"))), pos="pos"),
        _tagged(SPEECH, speeches.speech_list(raw), speech_pos="pos", role="role", name="name", text="text"),
        _tagged(BILL, F.coalesce(bills.bill_matches(raw), none), pos="pos", no="no", title="title"),
        _tagged(CONTENTS, F.when(is_toc & raw.isNotNull(), bills.toc_matches(raw)).otherwise(none), pos="pos", no="no", title="title"),
        _tagged(ASKED, F.coalesce(bills.questioner_matches(raw), F.array().cast("array<struct<pos: int, member: string>>")), pos="pos", member="name"),
    )


def speeches_of(rows: DataFrame) -> DataFrame:
    """The table of speeches of extracted rows."""
    said = rows.where(F.col("kind") == SPEECH)
    sid = speeches.make_sid(F.col("meeting_id"), F.col("date"), F.col("text_key"), F.col("pos"))
    return said.select(sid.alias("sid"), "meeting_id", "meeting", "type", "year", "era", "date", "pdf", "role", "name", speeches.detect_agenda_ref(F.col("text")).alias("agenda_ref"), "text", "pdf_pos", F.col("pos").alias("speech_pos"))


def agenda_of(rows: DataFrame) -> DataFrame:
    """The bills of each meeting of extracted rows."""
    key = ("meeting_id", "pdf_pos", "text_key")
    of = lambda kind: rows.where(F.col("kind") == kind).select(*key, "pos", "no", "title")
    return bills.build_agenda(bills.named_bills(of(BILL), *key), bills.first_by_number(of(CONTENTS), *key))


def questioners_of(rows: DataFrame) -> DataFrame:
    asked = rows.where(F.col("kind") == ASKED).select("meeting_id", "pdf_pos", "text_key", "pos", F.col("name").alias("member"))
    return bills.merge_questioners(bills.first_by_member(asked, "meeting_id", "pdf_pos", "text_key"))


def tables_of(rows: DataFrame) -> dict[str, DataFrame]:
    return {"speeches": speeches_of(rows), "agenda": agenda_of(rows), "questioners": questioners_of(rows)}
