"""WARC archives: write one gzip member per record with Spark's own file writer, and read archives in sequence.

Writing. A record is compressed to a gzip member in the task that holds the page. Spark's text writer puts the bytes
of a value and a separator into one file per task, under the commit protocol of the job, on any file system. A gzip
member ends with the high byte of its length, which is zero below 16 MiB; that zero is left out of the value and comes
back as the separator. Behind a longer record the separator is a zero byte between members, which gzip readers skip.

Pages are dealt to archives by a hash of id and payload, so many that one holds about ARCHIVE bytes of payload. Rows that
repeat an id and a payload are one key; where they pass ARCHIVE together, the key is dealt to several archives. Files keep
the names that Spark's text writer gives them.

Reading. An archive of up to MOST bytes is one row of ``binaryFile``. The reader walks through it with an incremental
decompressor, one member after the other, takes header and block by their stated lengths, and verifies block and payload
digests. A larger archive, of any size, is read as a stream by the text source, which inflates files that are named .gz member
by member and cuts them before every mark of a record; a cut within a block is mended by the block's stated length. So no
task holds more than a batch of records. Only what is both over 2 GiB and not named .gz cannot be read by Spark either way.

Defined cases: a null payload is empty; pages with equal payloads of at least ``least`` bytes are written once in full,
by the page with the largest id, and as revisits of it otherwise; rows that repeat that id with the same payload are
each written in full; a null id is never the original unless all ids of the payload are null, and then all its rows
are written in full; a page of any length is one record; an empty table gives no records. Only the id, url and payload
columns are read, under names of their own, so other columns may have any name. A record that breaks framing or a digest fails the read, unless ``strict`` is off, when it is
given with its ``error``.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, slices, stored

#: Payload bytes per archive, bytes of the largest archive that is read whole, and bytes handed to the decompressor at once.
ARCHIVE = 32 << 20
MOST = 1 << 30
PIECE = 1 << 18
#: What every record begins with, all versions.
MARK = "WARC/1."
DATE = "2000-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
RECORDS = "page_id {kind}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, error string"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page, url: str | None, payload: bytes, original) -> bytes:
    """One WARC record as bytes: a response, or a revisit of page ``original`` (None: a response)."""
    head = HTTP % len(payload)
    block = head if original is not None else head + payload
    lines = [
        ("WARC-Type", "response" if original is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", "".join(c for c in url if c >= " "))] if url else []),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Payload-Length", len(payload)),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        *([] if original is None else [("WARC-Refers-To", f"<urn:page:{original}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without time or name, so that equal records give equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def value(packed: bytes) -> bytes:
    return packed[:-1] if packed[-1] == 0 else packed


def write(pages: DataFrame, path: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write the rows of ``pages`` as archives below ``path``."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumn("sum", F.unhex(F.sha1("payload"))).withColumn("key", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    # a narrow row for each distinct page; the join with a hot side has ids and digests only
    size = F.octet_length("payload")
    kinds = stored(own.groupBy("page_id", "key", "sum").agg(F.count("*").alias("n"), F.max(size).alias("size")), "pages")
    first = kinds.where(F.col("size") >= least).groupBy("sum").agg(F.max("page_id").alias("original"), F.sum("n").alias("all")).where("all > 1 and original is not null")
    again = kinds.where(F.col("size") >= least).join(first, "sum").where("not page_id <=> original").select("key", "sum", "original")
    # payloads then meet the result by page, which is even but for rows that repeat
    cuts = F.ceil(F.col("n") * (F.col("size") + len(HTTP)) / ARCHIVE)
    hot = stored(kinds.groupBy("key", "sum").agg(F.max(cuts).alias("cuts")).where("cuts > 1"), "repeated")
    whole = kinds.agg(F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0))).first()[0]
    one = F.coalesce("cuts", F.lit(1).cast("long"))
    # the row of a task, taken before a join that may bring all rows of a key together
    own = own.withColumn("turn", F.monotonically_increasing_id())
    dealt = own.join(hot, ["key", "sum"], "left").withColumn("cut", F.pmod(F.xxhash64("turn"), one)).drop("cuts", "turn")
    each = again.join(hot, ["key", "sum"], "left").select("key", "sum", F.explode(F.sequence(F.lit(0).cast("long"), one - 1)).alias("cut"), "original")
    place = ["key", "sum", "cut"]
    rows = dealt.repartition(max(1, -(-whole // ARCHIVE)), *place).join(each, place, "left")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "payload", 4 << 20):
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "original")), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([value(member(record(*r))) for r in rows], pa.binary())], ["value"])

    records = rows.select("page_id", "url", "payload", "original").mapInArrow(pack, "value binary").select(F.col("value").cast("string"))
    records.write.option("lineSep", "\0").option("compression", "none").text(path)


def members(content: bytes) -> Iterator[bytes]:
    """The decompressed records of an archive, one gzip member at a time."""
    view, at = memoryview(content), 0
    while at < len(view):
        if view[at] == 0:  # padding
            at += 1
            continue
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("an archive ends within a record")
            piece = view[at : at + PIECE]
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> dict:
    """Headers, block and payload of a record, with ``error`` set if its framing or a digest is wrong."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    out = {"fields": fields, "error": None, "payload": b""}
    length = fields.get("content-length", "")
    if not found or not lines[0].startswith("WARC/") or not length.isdigit():
        return out | {"error": "no WARC header"}
    block = rest[: int(length)]
    if len(block) != int(length) or rest[int(length) :] != b"\r\n\r\n":
        return out | {"error": "block is not as long as stated"}
    if fields.get("content-type", "").startswith("application/http"):
        out["payload"] = block.partition(b"\r\n\r\n")[2]
    else:
        out["payload"] = block
    for name, part in (("warc-block-digest", block), ("warc-payload-digest", out["payload"])):
        said = fields.get(name, "")
        if said.startswith("sha1:") and not (name == "warc-payload-digest" and fields.get("warc-type") == "revisit") and said[5:] != digest(part):
            return out | {"error": f"{name} does not match"}
    return out


def complete(data: bytes) -> bool:
    """Whether a record has all of its block, as far as its header tells."""
    head, found, rest = data.partition(b"\r\n\r\n")
    length = next((x.partition(b":")[2].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
    return bool(found) and (not length.isdigit() or len(rest) >= int(length) + 4)


def joined(pieces: Iterator[tuple[str, bytes]]) -> Iterator[bytes]:
    """Whole records of (file, piece), the pieces of a file being what stands between its marks."""
    now, held = None, b""
    for file, piece in pieces:
        if file != now:
            if held:
                yield held  # an archive that ends within a record; its framing is wrong
            now, held = file, b""
            if piece.strip(b"\0\r\n"):
                yield piece
            continue
        held += MARK.encode() + piece
        if complete(held):
            yield held
            held = b""
    if held:
        yield held


def read(spark: SparkSession, path: str, id_type: str = "bigint", strict: bool = True, content: bool = False) -> DataFrame:
    """One row per record below ``path`` (RECORDS; with ``content`` also the payload of responses)."""

    def page(uri: str) -> str | None:
        return uri.removeprefix("<urn:page:").removesuffix(">") or None

    def rows(records: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for data in records:
            r = parse(data)
            if r["error"] and strict:
                raise ValueError(f"{r['error']}: {r['fields']}")
            held.append(row(r))
            size += len(r["payload"])
            if len(held) >= 4096 or content and size > 4 << 20:
                yield table(held)
                held, size = [], 0
        yield table(held)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("content"):
                yield from rows(members(archive.as_py()))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((file, piece) for batch in batches for file, piece in zip(batch.column("file").to_pylist(), batch.column("piece").to_pylist(), strict=True))
        yield from rows(joined(pieces))

    def row(r: dict) -> tuple:
        f = r["fields"]
        revisit = f.get("warc-type") == "revisit"
        said = f.get("warc-payload-digest", "").removeprefix("sha1:")
        n = int(f.get("warc-payload-length", 0)) if revisit else len(r["payload"])
        return (
            page(f.get("warc-record-id", "")), f.get("warc-target-uri"), n, said if revisit else digest(r["payload"]),
            f.get("warc-type"), page(f.get("warc-refers-to", "")), r["error"], *([None if revisit else r["payload"]] if content else []),
        )

    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), *([pa.binary()] if content else [])]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "error", *(["payload"] if content else [])]

    def table(held: list[tuple]) -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").load(path)
    out = RECORDS.format(kind="string") + ", payload binary" * content
    large = [r["path"] for r in files.where(F.col("length") > MOST).select("path", "length").collect() if r["path"].endswith(".gz") or r["length"] >= 1 << 31]
    if odd := [p for p in large if not p.endswith(".gz")]:
        raise ValueError(f"archives of over 2 GiB need a name that ends in .gz: {odd[:3]}")
    found = files.where(~F.col("path").isin(large)).select("content").mapInArrow(whole, out)
    if large:
        # one mark of a record to the next, in the order of the file
        lines = spark.read.option("lineSep", MARK).text(large).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
        found = found.unionByName(lines.mapInArrow(stream, out))
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(pages, path, least, id_col, url_col, payload_col)
    return read(spark, path, dict(pages.dtypes)[id_col])


def sql(pages: str) -> str:
    """The rows of ``round_trip`` with ``least`` 0 in SQL, for a table with the default column names and ids."""
    bits = "(('0x' || substr(sum, (i // 4) * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))) & 31"
    return f"""
    WITH own AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS sum FROM {pages}),
    best AS (SELECT *, max(page_id) OVER (PARTITION BY sum) AS original FROM own),
    said AS (SELECT *, original IS NOT NULL AND page_id IS DISTINCT FROM original AS again FROM best)
    SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
      array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ({bits}) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
      CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN original END AS refers_to FROM said
    """
