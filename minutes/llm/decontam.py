"""Benchmark decontamination with a distributed positional inverted index.

The index is cut by documents: a segment is one row with the documents of a few MB of text and, for each term, its
sorted positions in the segment, as gaps of seven bits a byte. All terms are stored, so an index that is written once
serves any test items, with no need of the texts. Segments are searched where they lie; neither texts nor postings are
shuffled, and the work per task does not depend on how common a term is.

A search decodes the lists of the items' terms and intersects, for every window of consecutive item words, the lists of its terms shifted by their offsets,
beginning with the rarest term of the segment; what is left are exact phrase matches. With ``span`` it also looks for
near matches: places of the window's first term with every other term of it within ``span`` words.

Test items are sent to the tasks in blocks of at most ITEM_BYTES, one pass over the index per block.

Defined cases: a null text has no words; an item without words or with a null id takes no part; an item shorter than
the window is one window; items with the same id and text count once; repeated documents are judged row by row; a null
doc_id is kept; a very long text is a segment of its own; an empty table of documents gives no rows, one of items hits
nothing. Only the id and the text column are read, under names of their own, so other columns may have any name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, utf8

#: Bytes of text in a segment, and of test items in a block.
SEGMENT = 4 << 20
ITEM_BYTES = 16 << 20
#: Lower-cases A-Z; what is neither a digit, a letter nor beyond ASCII parts words.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Items:
    """The windows of a block of test items, by the numbers of their terms."""

    def __init__(self, rows: list[tuple[str, bytes]], window: int) -> None:
        self.terms: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in rows:
            ids = [self.terms.setdefault(w, len(self.terms)) for w in words(text)]
            for s in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[s : s + window]), set()).add(item)
        #: (matrix of term numbers, the items of each row), one for each length of window
        self.windows: list[tuple[np.ndarray, list[list[str]]]] = []
        for n in sorted({len(w) for w in found}):
            own = [w for w in found if len(w) == n]
            self.windows.append((np.array(own, np.int64), [sorted(found[w]) for w in own]))


def blocks(items: DataFrame, window: int) -> tuple[int, Iterator[Items]]:
    """The number of blocks of ITEM_BYTES, and the blocks one by one."""
    rows = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).dropna()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item")), F.lit(0))).first()[0]
    n = max(1, -(-size // ITEM_BYTES))
    parts = (rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n))
    return n, (Items([(r[0], bytes(r[1])) for r in own.toLocalIterator()], window) for own in parts)


def pack(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in seven bits a byte, the lowest first and the last one marked; and where each ends."""
    size = np.ones(len(gaps), np.int64)
    for bits in range(7, 64, 7):
        more = gaps >= 1 << bits
        if not more.any():
            break
        size += more
    ends = np.cumsum(size)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    left = np.arange(len(gaps))
    for k in range(size.max(initial=0)):
        left = left[size[left] > k]
        out[ends[left] - size[left] + k] = (gaps[left] >> 7 * k) & 127
    out[ends - 1] |= 128
    return out, ends


def unpack(raw: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(raw & 128)
    size = np.diff(np.r_[-1, last])
    out, left = np.zeros(len(last), np.int64), np.arange(len(last))
    for k in range(size.max(initial=0)):
        left = left[size[left] > k]
        out[left] |= (raw[last[left] - size[left] + 1 + k] & 127).astype(np.int64) << 7 * k
    return out


def build_index(docs: DataFrame, gap: int) -> DataFrame:
    """Segments of ``docs`` (uid, doc_id, text). Between two documents lie ``gap`` empty positions, the most that a search's
    window and span may come to."""

    def segment(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: defaultdict[bytes, int] = defaultdict()
        known.default_factory = known.__len__  # a new term has the next number
        parts, sizes = [], []
        for text in utf8(batch.column("text")):
            own = words(text)
            sizes.append(len(own))
            parts.append(np.fromiter(map(known.__getitem__, own), np.int64, len(own)))
        counts = np.array(sizes, np.int64)
        starts = np.cumsum(counts + gap) - (counts + gap)
        ids = np.concatenate(parts)
        keys = np.sort(ids << 40 | (np.arange(len(ids)) + np.repeat(np.arange(len(counts)) * gap, counts)))
        ids, at = keys >> 40, keys & ((1 << 40) - 1)
        gaps = np.diff(at, prepend=0)
        first = np.searchsorted(ids, np.arange(len(known)))
        gaps[first] = at[first]
        raw, ends = pack(gaps)
        one = lambda x, t: pa.array([x], pa.list_(t))
        return pa.RecordBatch.from_arrays(
            [
                one(batch.column("uid").to_pylist(), pa.int64()), one(batch.column("doc_id").to_pylist(), batch.column("doc_id").type),
                one(starts, pa.int64()), one(counts, pa.int64()), one(list(known), pa.binary()),
                one(np.r_[0, ends][np.r_[first, len(gaps)]], pa.int64()), pa.array([raw.tobytes()], pa.binary()), pa.array([gap], pa.int64()),
            ],
            ["uids", "doc_ids", "starts", "sizes", "terms", "bounds", "positions", "gap"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SEGMENT):
            yield segment(batch)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"uids array<long>, doc_ids array<{kind}>, starts array<long>, sizes array<long>, terms array<binary>, bounds array<long>, positions binary, gap long")


def lists(terms: pa.Array, bounds: np.ndarray, raw: np.ndarray, asked: pa.Array) -> list[np.ndarray]:
    """The positions of each asked term in a segment."""
    found = pa.compute.index_in(asked, value_set=terms)
    have = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
    at = found.drop_null().to_numpy()
    spans = [raw[a:b] for a, b in zip(bounds[at], bounds[at + 1], strict=True)]
    gaps = unpack(np.concatenate(spans)) if spans else np.zeros(0, np.int64)
    sizes = [int(np.count_nonzero(s & 128)) for s in spans]
    out = [np.zeros(0, np.int64)] * len(asked)
    for t, own in zip(have, np.split(gaps, np.cumsum(sizes[:-1])), strict=False):
        out[t] = np.cumsum(own)
    return out


def among(values: np.ndarray, posting: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(posting, values), len(posting) - 1)
    return posting[at] == values


def within(values: np.ndarray, posting: np.ndarray, span: int) -> np.ndarray:
    """Whether a position of the posting lies no more than ``span`` from each value."""
    at = np.minimum(np.searchsorted(posting, values - span), len(posting) - 1)
    return np.abs(posting[at] - values) <= span


def find(postings: list[np.ndarray], items: Items, span: int | None) -> tuple[list, list]:
    """Phrase matches (start, length, items) and near matches (place, items) of a segment."""
    exact, near = [], []
    lengths = np.array([len(p) for p in postings] or [0], np.int64)
    for matrix, owners in items.windows:
        counts = lengths[matrix]
        for w in np.flatnonzero(counts.min(1) > 0):
            order = np.argsort(counts[w], kind="stable")
            ids = matrix[w]
            base = postings[ids[order[0]]]
            left = base - order[0]
            for o in order[1:]:
                if not len(left):
                    break
                left = left[among(left + o, postings[ids[o]])]
            exact.extend((int(s), len(ids), owners[w]) for s in left)
            if span is not None:
                close = postings[ids[0]]
                for t in dict.fromkeys(ids[order]):
                    if not len(close):
                        break
                    close = close[within(close, postings[t], span)]
                near.extend((int(p), owners[w]) for p in close)
    return exact, near


def search_index(index: DataFrame, items: Items, span: int | None) -> DataFrame:
    """Per document: its number of words, the spans hit, the items matched and those matched nearly."""
    sent = index.sparkSession.sparkContext.broadcast(items)
    reach = max((m.shape[1] for m, _ in items.windows), default=0) + (span or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        names = pa.array(list(asked.terms), pa.binary())
        for batch in batches:
            for row in range(batch.num_rows):
                cell = lambda name: batch.column(name)[row]  # noqa: B023, E731
                if reach > cell("gap").as_py():
                    raise ValueError(f"windows and spans of {reach} words pass the index's gap")
                starts = cell("starts").values.to_numpy()
                raw = np.frombuffer(cell("positions").as_buffer(), np.uint8)
                postings = lists(cell("terms").values, cell("bounds").values.to_numpy(), raw, names)
                exact, near = find(postings, asked, span)
                spans: list[list] = [[] for _ in starts]
                hit: list[set] = [set() for _ in starts]
                close: list[set] = [set() for _ in starts]
                for s, n, owners in exact:
                    d = int(np.searchsorted(starts, s, "right")) - 1
                    spans[d].append((s - starts[d], s - starts[d] + n))
                    hit[d].update(owners)
                for p, owners in near:
                    close[int(np.searchsorted(starts, p, "right")) - 1].update(owners)
                pair = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
                merged = [[{"start": a, "stop": b} for a, b in joined(x)] for x in spans]
                yield pa.RecordBatch.from_arrays(
                    [
                        cell("uids").values, cell("doc_ids").values, cell("sizes").values, pa.array(merged, pa.list_(pair)),
                        *(pa.array([sorted(x) for x in y], pa.list_(pa.string())) for y in (hit, close)),
                    ],
                    ["uid", "doc_id", "n_words", "spans", "items", "near"],
                )

    kind = dict(index.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")
    return index.mapInArrow(run, f"uid long, doc_id {kind}, n_words long, spans array<struct<start long, stop long>>, items array<string>, near array<string>")


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def matches(docs: DataFrame, items: DataFrame, window: int = 10, span: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, doc_id, n_words, spans, items, near) for every row of ``docs``; items has item_id and text."""
    narrow = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    index = stored(build_index(narrow, window + (span or 0)), "postings")
    _, parts = blocks(items, window)
    found = [search_index(index, own, span) for own in parts]
    if len(found) == 1:
        return found[0]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)  # noqa: E731  no longer than one document's matches
    return every.groupBy("uid", "doc_id", "n_words").agg(flat("spans"), flat("items"), flat("near"))


def judge(docs: DataFrame, items: DataFrame, window: int = 10, span: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: words, words hit, items matched and their digest, and whether any word is hit."""
    found = matches(docs, items, window, span, id_col, text_col)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(a, s):
        return F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["stop"] - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(a["end"], s["stop"]).alias("end"))

    n_hit = F.aggregate(F.array_sort("spans"), start, add)["n"]
    ids = F.array_sort(F.array_distinct("items"))
    return found.select(
        F.col("doc_id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.size(F.array_distinct("near")).cast("long").alias("n_near_items"), ids.alias("items"), "spans",
    )


def sql(docs: str, items: str, window: int, span: int) -> str:
    """The same in SQL, for tables with the default column names."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS uid, doc_id, {words} AS w FROM {docs}),
    terms AS (SELECT uid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM docs),
    asked AS (SELECT DISTINCT item_id::VARCHAR AS item, {words} AS w FROM {items} WHERE item_id IS NOT NULL),
    cut AS (SELECT item, unnest(generate_series(1, greatest(1, len(w) - {window - 1}))) AS s, w FROM asked WHERE len(w) > 0),
    windows AS (SELECT item, list_slice(w, s, s + {window - 1}) AS p FROM cut),
    distinct_windows AS (SELECT p, list(DISTINCT item) AS items, row_number() OVER () AS wid FROM windows GROUP BY p),
    starts AS (SELECT t.uid, t.pos, d.p, d.items FROM distinct_windows d JOIN terms t ON t.word = d.p[1]),
    exact AS (SELECT s.uid, s.pos, len(s.p) AS n, s.items FROM starts s JOIN docs USING (uid) WHERE list_slice(docs.w, s.pos, s.pos + len(s.p) - 1) = s.p),
    hit AS (SELECT uid, count(DISTINCT place) AS n_hit FROM (SELECT uid, unnest(generate_series(pos, pos + n - 1)) AS place FROM exact) GROUP BY 1),
    found AS (SELECT uid, list_sort(list(DISTINCT item)) AS ids FROM (SELECT uid, unnest(items) AS item FROM exact) GROUP BY 1),
    near AS (SELECT uid, count(DISTINCT item) AS n_near FROM (
      SELECT s.uid, unnest(s.items) AS item FROM starts s JOIN docs USING (uid) WHERE list_has_all(list_slice(docs.w, greatest(1, s.pos - {span}), s.pos + {span}), s.p)) GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, len(coalesce(ids, []))::BIGINT AS n_items, sha256(array_to_string(coalesce(ids, []), ',')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near_items
    FROM docs LEFT JOIN hit USING (uid) LEFT JOIN found USING (uid) LEFT JOIN near USING (uid)
    """
