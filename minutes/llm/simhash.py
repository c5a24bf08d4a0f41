"""Near-duplicate documents by SimHash, compared bit-sliced.

1. Fingerprints: every word shingle is hashed (XXH64; wider fingerprints derive more words from that hash); a bit is
   set if it is set in over half of the hashes, repeats included.
2. Equal fingerprints are folded into one node first, so thousands of copies cost one comparison.
3. Candidates share a band of bits. ``pigeonhole`` bands find every pair within a small radius: of r + 2 bands any two
   fingerprints within r bits agree on two. ``lsh`` bands serve a large radius: they widen with the logarithm of the
   number n of fingerprints, so that about STRANGERS n^(1/4) meet by chance in a band (a block's worth: comparing is cheap
   beside sending), and there are as many of them as the stated recall takes. At a similarity of 0.8 the rows sent then
   grow as n^1.22.
4. Fingerprints that share a band are compared in blocks. A block keeps bit planes (bit i of 64 fingerprints in one
   word); planes are XORed with a fingerprint's bit and added to vertical counters by carry-save adders, and the
   block is left as soon as every counter has passed the radius. A band with many members is cut into parts that meet
   pairwise in separate tasks. Pairs come in bounded pieces and are joined at once; a block whose members are all
   connected is left.
5. A block returns a spanning forest of its links, never all pairs; components of all links are found by stars.
6. With ``similarity``, fingerprints only propose: they are made of distinct shingles, and members of a block that have
   a candidate there are sent once more with their sets of shingle hashes. A link is a pair of one band group whose
   exact Jaccard similarity is high enough; a pair that shares several bands is verified in the first of them, and
   pairs that are connected already are not compared again.

Defined cases: a null, empty or blank text has the fingerprint zero and links like any other; fewer words than a
shingle: the whole sequence is the one shingle; a text of any length is one row of its task, and one whose shingles pass
SHINGLES is a part of its own; repeated rows are given row by row; null ids stay, and a component whose ids are all null
has the id null; an empty table gives no rows. Only the id and the text column are read, under names of their own, so
other columns may have any name but ``__id``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, utf8
from .components import connected

#: Fingerprints in a packed block of small bands, and in each part of a large band.
LANES, BLOCK = 256, 2048
#: Shingles in each part of a large band.
SHINGLES = 1 << 20
SLICE = 2 << 20
#: Strangers that share a band key by the fourth root of their number, and the share of pairs at the stated similarity
#: that share any band.
STRANGERS, RECALL = 6, 0.97
#: Candidates (id, hash, node: some 100 bytes each) that are broadcast to the texts; beyond, texts are shuffled to them.
ASKED = 500_000
#: Words of a counter plane worked on at once: 64 pairs each.
WORDS = 1 << 13
_STEP = 0x9E3779B97F4A7C15
_MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def widen(h: np.ndarray, words: int) -> np.ndarray:
    """(n, words): the hashes and, behind them, mixes of each (a counter-based finaliser of 64-bit words)."""
    out = np.empty((len(h), words), np.uint64)
    out[:, 0] = h
    for j in range(1, words):
        x = h + np.uint64(_STEP * j & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MULTIPLIERS[0])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MULTIPLIERS[1])
        out[:, j] = x ^ (x >> np.uint64(31))
    return out


def shingles(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """The hashes of a text's word shingles, in order."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=False)], np.uint64)


def majority(h: np.ndarray, bits: int) -> bytes:
    """The big-endian fingerprint of hashes."""
    rows = widen(h, bits // 64).astype(">u8").view(np.uint8).reshape(len(h), bits // 8)
    total = np.zeros(bits, np.int64)
    for at in range(0, len(rows), 1 << 16):
        total += np.unpackbits(rows[at : at + (1 << 16)], axis=1).sum(0, dtype=np.uint32)
    return np.packbits(2 * total > len(h)).tobytes()


def fingerprint(text: bytes, shingle: int, bits: int, seed: int = 42) -> tuple[bytes, int]:
    """Big-endian fingerprint, and the number of shingles."""
    h = shingles(text, shingle, seed)
    return majority(h, bits), len(h)


def fingerprints(docs: DataFrame, shingle: int = 3, bits: int = 64, id_col: str = "doc_id", text_col: str = "text", distinct: bool = False) -> DataFrame:
    """(doc_id, fp binary, n_shingles, digest, hash). With ``distinct`` repeats of a shingle do not count, and ``digest``
    stands for the set of shingles; ``hash`` is of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            found = []
            for text in utf8(batch.column("text")):
                h = shingles(text, shingle)
                h = np.unique(h) if distinct else h
                found.append((majority(h, bits), len(h), xxhash.xxh3_128_digest(h.tobytes()) if distinct else None))
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, batch.column("hash")], ["doc_id", "fp", "n_shingles", "digest", "hash"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    return narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, fp binary, n_shingles long, digest binary, hash long")


def pigeonhole(radius: int, bits: int = 64) -> list[np.ndarray]:
    """Bands as bit places: every two of radius + 2 parts. Complete for pairs within the radius."""
    cuts = np.linspace(0, bits, radius + 3).astype(int)
    parts = [np.arange(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [np.concatenate(two) for two in combinations(parts, 2)]


def recall(width: int, count: int, bits: int, share: float) -> float:
    """The chance that two fingerprints, each bit of which differs with chance ``share``, agree on any of ``count`` bands
    of ``width`` bits drawn without replacement."""
    d = np.arange(bits + 1)
    log = lambda n: np.array([math.lgamma(x + 1) for x in np.atleast_1d(n)])
    weight = np.exp(log(bits) - log(d) - log(bits - d) + d * math.log(share) + (bits - d) * math.log1p(-share))
    left = np.maximum(bits - d, width)
    same = np.where(bits - d >= width, np.exp(log(left) - log(left - width) - log(bits) + log(bits - width)), 0.0)
    return float((weight * -np.expm1(count * np.log1p(-np.minimum(same, 1 - 1e-12)))).sum())


def lsh(n: int, bits: int, similarity: float) -> list[np.ndarray]:
    """Bands for ``n`` fingerprints: wide enough that few meet by chance, as many as RECALL takes."""
    few = min(BLOCK / 2, STRANGERS * max(n, 1) ** 0.25)
    width = min(bits // 4, 60, max(8, math.ceil(math.log2(max(n, 1) / few))))
    share, count = differing(similarity), 1
    while recall(width, count, bits, share) < RECALL:
        count += max(1, count // 16)
    rng = np.random.default_rng(width)
    return [np.sort(rng.permutation(bits)[:width]) for _ in range(count)]


def band_keys(rows: np.ndarray, bands: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each band the key of every bit row; equal keys are equal bits (wider bands than 64: equal hashes of them)."""
    for band in bands:
        packed = np.packbits(rows[:, band], axis=1)
        if packed.shape[1] > 8:
            yield np.array([xxhash.xxh64_intdigest(r.tobytes()) for r in packed], np.uint64).view(np.int64)
        else:
            wide = np.zeros((len(packed), 8), np.uint8)
            wide[:, 8 - packed.shape[1] :] = packed
            yield wide.view(">i8")[:, 0].astype(np.int64)


def add_plane(counters: list[np.ndarray], plane: np.ndarray, over: np.ndarray, at: int = 0) -> None:
    """Add a bit of weight 2^at to the vertical counters; what runs over is kept in ``over``."""
    for k in range(at, len(counters)):
        carry = counters[k] & plane
        counters[k] ^= plane
        plane = carry
    over |= plane


def full_adder(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = a ^ b
    return both ^ c, (a & b) | (both & c)


def close_pairs(left: np.ndarray, right: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i of left, j of right) of bit rows that differ in no more than ``radius`` bits, in pieces of at most
    64 * WORDS (or one row's), sorted by i. Without ``right``: pairs i < j of left."""
    own_side = right is None
    right = left if own_side else right
    n, bits = right.shape
    lanes = -(-n // 64)
    padded = np.zeros((bits, lanes * 64), np.uint8)
    padded[:, :n] = right.T
    planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
    full = np.uint64(2**64 - 1)
    width = max(1, int(radius).bit_length())
    preset = (1 << width) - 1 - radius  # a counter runs over at radius + 1
    chunk = max(1, WORDS // max(1, lanes))
    for at in range(0, len(left), chunk):
        own = left[at : at + chunk]
        first = at // 64 if own_side else 0
        flip = np.where(own.T[:, :, None] > 0, full, np.uint64(0))
        shape = (len(own), lanes - first)
        counters = [np.full(shape, full if preset >> k & 1 else np.uint64(0)) for k in range(width)]
        over = np.zeros(shape, np.uint64)
        for b in range(0, bits, 3):
            x = [planes[i, first:] ^ flip[i] for i in range(b, min(b + 3, bits))]
            if len(x) == 3:
                ones, twos = full_adder(*x)
                add_plane(counters, ones, over)
                add_plane(counters, twos, over, 1)
            else:
                for plane in x:
                    add_plane(counters, plane, over)
            if b % 12 == 0 and b > radius and (over == full).all():
                break
        else:
            near = np.unpackbits((~over).view(np.uint8).reshape(len(own), -1), axis=1, bitorder="little")[:, : n - 64 * first]
            if own_side:
                near &= np.arange(64 * first, n) > np.arange(at, at + len(own))[:, None]
            i, j = np.nonzero(near)
            if len(i):
                yield i + at, j + 64 * first


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each member's group when the links (i, j) are added to the groups of ``label``."""
    i, j = label[i], label[j]
    new = i != j
    if new.any():
        pairs = np.unique(np.stack([i[new], j[new]]), axis=1)
        tied = np.arange(len(label))
        while True:
            before = tied.copy()
            np.minimum.at(tied, pairs[0], before[pairs[1]])
            np.minimum.at(tied, pairs[1], before[pairs[0]])
            tied = tied[tied]
            if (tied == before).all():
                return tied[label]
    return label


def bit_rows(fp: pa.Array) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(fp.to_pylist()), np.uint8).reshape(len(fp), -1), axis=1)


def borders(held: pa.Table) -> np.ndarray:
    """Where a group begins, but for the first."""
    group = np.stack([held.column(c).to_numpy() for c in GROUP], axis=1)
    return np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1


def in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in pieces that hold whole groups (band, key, i, j): small ones together up to LANES, a larger one or one
    of two parts alone."""
    kept: list[pa.Table] = []

    def pieces(held: pa.Table, ends: list[int]) -> Iterator[pa.Table]:
        cross = (held.column("i").to_numpy() != held.column("j").to_numpy()) if held.num_rows else []
        start = last = 0
        for end in ends:
            alone = end - last > LANES or cross[last]
            if last > start and (alone or end - start > LANES):
                yield held.slice(start, last - start).combine_chunks()
                start = last
            if alone:
                yield held.slice(start, end - start).combine_chunks()
                start = end
            last = end
        if last > start:
            yield held.slice(start, last - start).combine_chunks()

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(pa.Table.from_batches([batch]))
        held = pa.concat_tables(kept).combine_chunks()
        ends = borders(held).tolist()
        if ends:
            yield from pieces(held, ends)
        kept = [held.slice(ends[-1] if ends else 0)]
    if kept and kept[0].num_rows:
        held = kept[0].combine_chunks()
        yield from pieces(held, [*borders(held).tolist(), held.num_rows])


def near_pairs(part: pa.Table, rows: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Close pairs of a piece; of a group of two parts those of one part with the other."""
    if part.column("i")[0].as_py() == part.column("j")[0].as_py():
        yield from close_pairs(rows, None, radius)
    else:
        mine = part.column("own").to_numpy() == part.column("i")[0].as_py()
        left, right = np.flatnonzero(mine), np.flatnonzero(~mine)
        for i, j in close_pairs(rows[left], rows[right], radius) if len(left) and len(right) else ():
            yield left[i], right[j]


GROUP = ["band", "key", "i", "j"]
NAMES = ["fp", "node", "n_shingles"]


def blocks(nodes: DataFrame, bands: list[np.ndarray]) -> DataFrame:
    """Nodes (node, fp, n_shingles) dealt to the blocks (band, key, i, j) in which they meet others, sorted by block."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                for k, own in enumerate(band_keys(bit_rows(part.column("fp")), bands)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, np.int32)), pa.array(own), *part.columns], ["band", "key", *NAMES])

    keyed = stored(nodes.select(*NAMES).mapInArrow(key, "band int, key long, fp binary, node long, n_shingles long"), "bands")
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m"))
    cut = F.greatest(F.ceil(F.col("n") / BLOCK), F.least("n", F.ceil(F.col("m") / SHINGLES)))
    # written by itself: it has only keys of many members, and is broadcast if Spark sees that it is small
    large = stored(sizes.select("band", "key", cut.alias("cut")).where("cut > 1"), "large")
    member = keyed.join(large, ["band", "key"], "left").withColumn("cut", F.coalesce("cut", F.lit(1).cast("long")))
    member = member.withColumn("own", F.pmod(F.hash("node"), F.col("cut")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cut") - 1))
    met = member.select("band", "key", *NAMES, "own", other.alias("other")).select(
        "band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *NAMES, "own"
    )
    return met.repartition(*GROUP).sortWithinPartitions(*GROUP)


def links(nodes: DataFrame, bands: list[np.ndarray], radius: int) -> DataFrame:
    """Edges (a, b) that connect whatever links within ``radius`` bits connect."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_groups(batches):
            rows, node = bit_rows(part.column("fp").combine_chunks()), part.column("node").to_numpy()
            label = np.arange(len(node))
            for i, j in near_pairs(part, rows, radius):
                label = join_labels(label, i, j)
                if not label.any():  # all are one group
                    break
            own = np.flatnonzero(label != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[label[own]])], ["a", "b"])

    return blocks(nodes.withColumn("n_shingles", F.lit(0).cast("long")), bands).mapInArrow(compare, "a long, b long")


def differing(similarity: float) -> float:
    """The share of bits that differ between fingerprints of sets of this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def reach(bits: int, similarity: float) -> int:
    """A radius that four standard deviations of the differing bits at this Jaccard similarity stay within."""
    share = differing(similarity)
    return math.ceil(bits * share + 4 * math.sqrt(bits * share * (1 - share)))


def alike(pairs: Iterable[tuple[np.ndarray, np.ndarray]], sizes: np.ndarray, hashes: np.ndarray, similarity: float) -> np.ndarray:
    """The least member of each member's group under those of the pairs (i, j), each piece sorted by i, whose sets, lying
    in ``hashes`` one behind the other, have at least this Jaccard similarity."""
    n = len(sizes)
    label, ends = np.arange(n), np.r_[0, np.cumsum(sizes)]
    dense = mark = None
    for i, j in pairs:
        if dense is None:  # only where there is a pair to verify
            _, dense = np.unique(hashes, return_inverse=True)
            mark = np.zeros(len(hashes) + 1, bool)
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        for start, end in zip(starts, [*starts[1:], len(i)], strict=True):
            own, others = i[start], j[start:end]
            others = others[label[others] != label[own]]
            if not len(others):
                continue
            mine = dense[ends[own] : ends[own + 1]]
            mark[mine] = True
            if len(others) > 16:
                upto = np.r_[0, np.cumsum(mark[dense])]
                common = upto[ends[others + 1]] - upto[ends[others]]
            else:
                common = np.array([np.count_nonzero(mark[dense[ends[o] : ends[o + 1]]]) for o in others])
            mark[mine] = False
            close = others[common >= similarity * (sizes[own] + sizes[others] - common) - 1e-9]
            if len(close):
                joined = np.unique(label[np.r_[own, close]])
                label[np.isin(label, joined)] = joined[0]
    return label


def verified_links(nodes: DataFrame, docs: DataFrame, bands: list[np.ndarray], bits: int, similarity: float, shingle: int) -> DataFrame:
    """Edges (a, b) that connect whatever pairs of a band group connect that have this Jaccard similarity at least.

    ``nodes`` have in (id, hash) a row of ``docs`` (doc_id, text) to take the shingles from.
    """
    radius = reach(bits, similarity)
    inside = np.zeros((bits, len(bands)), np.float32)
    for k, band in enumerate(bands):
        inside[band, k] = 1

    def pairs(part: pa.Table, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of one group, close in bits and in size, that share no band before the group's."""
        size, band = part.column("n_shingles").to_numpy(), part.column("band").to_numpy()
        group = np.zeros(part.num_rows, np.int64)
        group[borders(part)] = 1
        group = np.cumsum(group)
        for i, j in near_pairs(part, rows, radius):
            fit = (group[i] == group[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9)
            i, j = i[fit], j[fit]
            for at in range(0, len(i), 1 << 14):
                a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                first = (((rows[a] ^ rows[b]).astype(np.float32) @ inside) < 0.5).argmax(1) == band[a]
                if first.any():
                    yield a[first], b[first]

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [*GROUP, *NAMES, "own"]
        for part in in_groups(batches):
            found = np.zeros(part.num_rows, bool)
            for i, j in pairs(part, bit_rows(part.column("fp").combine_chunks())):
                found[i] = found[j] = True
            if found.any():
                at = pa.array(np.flatnonzero(found))
                yield pa.RecordBatch.from_arrays([part.column(c).combine_chunks().take(at) for c in kept], kept)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            sets = [np.unique(shingles(t, shingle)).view(np.int64) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_groups(batches):
            rows, node, sets = bit_rows(part.column("fp").combine_chunks()), part.column("node").to_numpy(), part.column("shingles").combine_chunks()
            size = pa.compute.list_value_length(sets).to_numpy().astype(np.int64)
            label = alike(pairs(part, rows), size, sets.flatten().to_numpy(), similarity)
            linked = np.flatnonzero(label != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[label[linked]])], ["a", "b"])

    kind = "band int, key long, i long, j long, fp binary, node long, n_shingles long, own long"
    near = stored(blocks(nodes, bands).mapInArrow(propose, kind), "candidates")
    asked = stored(near.select("node").distinct().join(nodes, "node").select("node", "id", F.col("hash").alias("__hash")), "asked")
    few = F.broadcast(asked) if asked.count() <= ASKED else asked
    text = docs.withColumn("hash", F.xxhash64("text")).join(few, (F.col("hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "text")
    # rows that repeat an id and a text give the same set again; both sides meet by node without another exchange
    sets = text.mapInArrow(cut, "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles"))
    return near.join(sets, "node").repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(verify, "a long, b long")


def groups(docs: DataFrame, shingle: int = 3, bits: int = 64, radius: int = 2, similarity: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row: the least id reachable over links of at most ``radius`` bits, or, with
    ``similarity``, over pairs whose sets of shingles have that Jaccard similarity at least (found with RECALL)."""
    found = stored(fingerprints(docs, shingle, bits, id_col, text_col, similarity > 0), "fingerprints")
    key = ["fp", "digest"] if similarity else ["fp"]
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "hash"))
    folded = found.groupBy(*key).agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n_shingles"), one.alias("one"))
    nodes = stored(folded.select(*key, "n_shingles", "least", "one.id", "one.hash", F.monotonically_increasing_id().alias("node")), "nodes")
    if similarity:
        own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        roots = connected(verified_links(nodes, own, lsh(nodes.count(), bits, similarity), bits, similarity, shingle))
    else:
        roots = connected(links(nodes, pigeonhole(radius, bits), radius))
    placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # written by itself: a join below an aggregate by the same key could not be split where a group is large
    least = stored(placed.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = placed.join(least, "root").select(*key, "component_id")
    return found.join(named, key, "left").select(F.col("doc_id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, bits: int = 256, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of every group of near copies the one with the least id.

    Similar are documents whose sets of shingles have the Jaccard similarity ``similarity`` at least. Rows that repeat an id count as one document, of which one row stays. Rows
    with a null id cannot be told apart: they go if every one of them is a copy of a row with an id, else all stay.
    """
    found = groups(docs, shingle, bits, similarity=similarity, id_col=id_col, text_col=text_col)
    same = F.col(id_col).eqNullSafe(F.col("component_id"))
    by_id = stored(found.groupBy(F.col(id_col).alias("__id")).agg(F.max(same).alias("stays"), F.count("*").alias("n")), "copies")
    # what goes is written by itself, so that Spark can see its size and broadcast it where it is small
    gone = stored(by_id.where("not stays").select("__id"), "gone")
    kept = docs.join(gone, F.col(id_col).eqNullSafe(F.col("__id")), "left_anti")
    again = stored(by_id.where("stays and n > 1 and __id is not null").select("__id"), "repeated")
    if again.isEmpty():
        return kept
    alone = kept.join(again, F.col(id_col).eqNullSafe(F.col("__id")), "left_anti")
    return alone.unionByName(kept.join(again, F.col(id_col) == F.col("__id"), "left_semi").dropDuplicates([id_col]))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.hex(fp))
