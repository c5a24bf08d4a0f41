"""Schemas of the tables, as DDL."""

PDF = "struct<label: string, date: string, url: string>"
MEETINGS = f"id string, name string, type string, era string, year int, url string, pdfs array<{PDF}>"
TOC = f"{MEETINGS}, indexed boolean"
TEXTS = "meeting_id string, text_key string, raw string"
SPEECHES = (
    "sid string, meeting_id string, meeting string, type string, year int, era string, date string, pdf string, "
    "role string, name string, agenda_ref string, text string, pdf_pos int, speech_pos int"
)
AGENDA = "meeting_id string, ord int, no string, kind string, title string"
QUESTIONERS = "meeting_id string, ord int, member string, theme string"
BILL_LIST, ASKED_LIST = "array<struct<no: string, kind: string, title: string>>", "array<struct<member: string, theme: string>>"
GIAN = f"map<string, struct<agenda: {BILL_LIST}, ippan: {ASKED_LIST}>>"
VECTORS = "sid string, vec array<tinyint>"
SUMMARIES = "map<string, struct<summary: string, topics: array<string>, gian: array<struct<no: string, kind: string>>>>"
HIGHLIGHTS = "label string, query string, reason string"
MEETING_PAGES = "id string, page_url string"
#: Tables with a writer and reader of their own.
TYPED = {"highlights": HIGHLIGHTS, "meeting_pages": MEETING_PAGES, "vectors": VECTORS}
