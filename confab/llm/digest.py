"""Improbable-feature digests: rare byte windows in chained Bloom filters, compared by normalised bit overlap."""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_CHARS, arrow, parallelism, slices, small_batches, text_slices

WINDOW = 32
LEVELS = 128  # of entropy, from 0 to log2(WINDOW) bits
NEAR, VOTES = 32, 8  # neighbouring windows that compete, and in how many such neighbourhoods a feature is the rarest
FEATURES, FILTER_BITS, HASHES = 128, 2048, 4
SAMPLE = 64
UNIT = 1 << 24  # of entropy sums, which are whole numbers and so the same wherever a window lies


def _gains() -> np.ndarray:
    """What the k-th equal byte in a window adds to the sum of c * log2(c) over its bytes' counts c, in UNITs."""
    c = np.arange(WINDOW + 1, dtype=np.float64)
    return np.concatenate([[0], np.diff(np.rint(c * np.log2(np.maximum(c, 1)) * UNIT))]).astype(np.int64)


GAINS = _gains()


@dataclass
class Windows:
    """All windows of a batch of texts: the bytes on end, each window's text, first byte and entropy level."""

    flat: np.ndarray
    sizes: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    level: np.ndarray


def windows(data: list[bytes]) -> Windows:
    """Every run of 32 bytes of each text. A text of under 32 bytes is one window, filled with zero bytes; an empty text
    has none."""
    sizes = np.array([len(x) for x in data], np.int64)
    room = np.where(sizes > 0, np.maximum(sizes, WINDOW), 0)
    flat = np.frombuffer(b"".join(x.ljust(WINDOW, b"\0") if x else b"" for x in data), np.uint8)
    many = np.where(sizes > 0, room - WINDOW + 1, 0)
    doc = np.repeat(np.arange(len(data), dtype=np.int32), many)
    first = np.cumsum(room) - room
    at = np.arange(len(doc)) + np.repeat(first - (np.cumsum(many) - many), many)
    return Windows(flat, sizes, doc, at, _levels(flat)[at] if len(at) else np.zeros(0, np.uint8))


def _levels(flat: np.ndarray) -> np.ndarray:
    """Shannon entropy of the WINDOW bytes from each place, in LEVELS steps.

    A window's sum follows from that of the window before: the byte that leaves takes off what it had added as the last of
    its kind, the byte that enters adds as one more."""
    n = len(flat) - WINDOW + 1
    ahead, behind = np.zeros(len(flat), np.uint8), np.zeros(len(flat), np.uint8)  # equal bytes among the next and the last 31
    for lag in range(1, WINDOW):
        same = (flat[lag:] == flat[:-lag]).view(np.uint8)
        ahead[:-lag] += same
        behind[lag:] += same
    start = np.bincount(flat[:WINDOW], minlength=256)
    total = np.empty(n, np.int64)
    total[0] = sum(int(GAINS[: c + 1].sum()) for c in start.tolist())
    total[1:] = GAINS[behind[WINDOW:] + 1] - GAINS[ahead[: n - 1] + 1]
    entropy = np.log2(WINDOW) - np.cumsum(total) / (WINDOW * UNIT)
    return np.clip(np.rint(entropy / np.log2(WINDOW) * (LEVELS - 1)), 0, LEVELS - 1).astype(np.uint8)


def _hash(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    words = np.ndarray((len(flat) - 7,), "<u8", flat.data, 0, (1,))
    h = np.minimum(size, WINDOW).astype(np.uint64)
    for k in range(0, WINDOW, 8):
        h = (h ^ words[at + k]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def select(w: Windows, counts: np.ndarray) -> np.ndarray:
    """Which windows become features (by number): of each NEAR neighbours the one with the least probable entropy (by
    counts; the first of equals) gets a vote. VOTES make a feature; in a text where none has so many, those with the most
    do. In a text of fewer than NEAR windows all are."""
    n = len(w.doc)
    if not n:
        return np.zeros(0, np.int64)
    rank = np.empty(LEVELS, np.int64)
    rank[np.lexsort((np.arange(LEVELS), counts))] = np.arange(LEVELS)
    votes = np.zeros(n, np.uint8)
    for b in range(0, n, 1 << 23):  # places within a block and ranks fit into 32 bits
        stop = min(n, b + (1 << 23) + NEAR - 1)
        least = rank[w.level[b:stop]].astype(np.uint32) << np.uint32(24) | np.arange(stop - b, dtype=np.uint32)
        reach = 1
        while reach < NEAR and len(least) > reach:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach == NEAR:
            inside = w.doc[b : b + len(least)] == w.doc[b + NEAR - 1 : b + NEAR - 1 + len(least)]
            winner = (least[inside] & np.uint32((1 << 24) - 1)).astype(np.int64)
            votes[b:stop] += np.bincount(winner, minlength=stop - b).astype(np.uint8)
    many = np.bincount(w.doc, minlength=len(w.sizes))
    begin = np.cumsum(many) - many
    there = np.flatnonzero(many)
    need = np.full(len(many), VOTES, np.uint8)
    need[there] = np.minimum(VOTES, np.maximum.reduceat(votes, begin[there]))
    need[many < NEAR] = 0
    return np.flatnonzero(votes >= need[w.doc])


def digests(data: list[bytes], counts: np.ndarray) -> list[np.ndarray]:
    """For each text its chain of filters (filters x bytes): distinct features in order of place, FEATURES to a filter."""
    w = windows(data)
    on = select(w, counts)
    doc = w.doc[on].astype(np.int64)
    h = _hash(w.flat, w.at[on], w.sizes[doc]) if doc.size else np.zeros(0, np.uint64)
    if doc.size:
        # equal windows of a text count once, where they come first
        order = np.lexsort((np.arange(len(h)), h, doc))
        fresh = np.ones(len(h), bool)
        fresh[order[1:]] = (doc[order][1:] != doc[order][:-1]) | (h[order][1:] != h[order][:-1])
        doc, h = doc[fresh], h[fresh]
    many = np.bincount(doc, minlength=len(data))
    begin = np.cumsum(many) - many
    filters = -(-many // FEATURES)
    base = np.cumsum(filters) - filters
    bits = np.zeros((int(filters.sum()), FILTER_BITS), bool)
    row = base[doc] + (np.arange(len(doc)) - begin[doc]) // FEATURES
    for k in range(HASHES):
        bits[row, ((h >> np.uint64(k * 11)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[b : b + n] for b, n in zip(base.tolist(), filters.tolist(), strict=True)]


def text_of(digest: np.ndarray) -> str:
    """The number of filters and their bits in base64; an empty text's is "0:"."""
    return f"{len(digest)}:" + base64.b64encode(digest.tobytes()).decode()


def digest_of(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text.partition(":")[2]), np.uint8).reshape(-1, FILTER_BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: for each filter of either side its best overlap with the other side's, less what chance gives, by its own
    bits; the mean, weighed by bits. Equal digests are 1; an empty one is 0 to any other."""
    if len(a) == len(b) and np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    x, y = np.unpackbits(a, axis=1).astype(np.float32), np.unpackbits(b, axis=1).astype(np.float32)
    na, nb = x.sum(1), y.sum(1)
    over = np.empty((len(a), len(b)), np.float32)
    for k in range(0, len(a), 1024):
        over[k : k + 1024] = x[k : k + 1024] @ y.T
    chance = np.outer(na, nb) / FILTER_BITS
    left = ((over - chance) / (na[:, None] - chance)).max(1).clip(0, 1)
    right = ((over - chance) / (nb[None, :] - chance)).max(0).clip(0, 1)
    return float((left @ na + right @ nb) / (na.sum() + nb.sum()))


def entropy_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many windows of all texts have each entropy level. At most LEVELS rows leave a task."""

    def run(batches):
        total = np.zeros(LEVELS, np.int64)
        for found in text_slices(batches, SLICE_CHARS):
            total += np.bincount(windows([x.encode("utf-8", "surrogatepass") for x in found]).level, minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS, dtype=np.int32)), pa.array(total)], names=["level", "n"])

    out = np.zeros(LEVELS, np.int64)
    for r in arrow(docs.select(text_col), run, "level int, n bigint").groupBy("level").agg(F.sum("n").alias("n")).collect():
        out[r["level"]] = r["n"]
    return out


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, stray, id, text: rows dealt to parts by ranges of the id. Within a part, by (stray, id, text), each row is
    followed by the one that follows it among all rows: a part ends with a stray copy of the first rows of the next
    one (the last part with the first of all).

    Cut points are quantiles of the id, approximate or, where it isn't a number, of a sample of SAMPLE ids for each part;
    only these and one id for each part reach the driver. Null ids come first. Rows of one id lie in one part."""
    parts = parallelism(docs.sparkSession)
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    ids = docs.select(F.col(id_col).alias("id"))
    number = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    if parts == 1:
        cuts = []
    elif number:
        cuts = np.unique(ids.select(F.col("id").cast("double")).approxQuantile("id", [k / parts for k in range(1, parts)], min(0.01, 0.25 / parts))).tolist()
    else:
        some = sorted(r["id"] for r in ids.where("id IS NOT NULL").orderBy(F.xxhash64(F.lit("cut"), "id"), "id").limit(SAMPLE * parts).collect())
        cuts = sorted({some[len(some) * k // parts] for k in range(1, parts)}) if some else []

    def part_of(column: pa.Array) -> np.ndarray:
        if number:
            return np.searchsorted(cuts, column.cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False), "right").astype(np.int32)
        return np.array([0 if x is None else bisect_right(cuts, x) for x in column.to_pylist()], np.int32)

    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(part_of(batch.column(0))), batch.column(0)], names=["part", "id"])

    head = F.min(F.struct(F.col("id").isNotNull().alias("some"), "id")).alias("h")
    heads = [(r["part"], r["h"]["id"]) for r in arrow(ids, place, f"part int, id {kind}").groupBy("part").agg(head).orderBy("part").collect()]
    before = {p: (first, heads[k - 1][0]) for k, (p, first) in enumerate(heads)}

    def deal(batches):
        names = ["part", "stray", "id", "text"]
        for batch in batches:
            part, zero = part_of(batch.column(0)), np.zeros(batch.num_rows, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(zero), batch.column(0), batch.column(1)], names=names)
            found = batch.column(0).to_pylist()
            at = [k for k, (p, x) in enumerate(zip(part.tolist(), found, strict=True)) if before[p][0] == x]
            if at:
                copy = batch.take(pa.array(at))
                to = pa.array([before[int(part[k])][1] for k in at], pa.int32())
                yield pa.RecordBatch.from_arrays([to, pa.array(zero[at] + 1), copy.column(0), copy.column(1)], names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = arrow(rows, deal, f"part int, stray int, id {kind}, text string")
    return dealt.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "stray", "id", "text")


def _edited(text: str, after: str) -> str:
    """The last half of the code points replaced by as many of the next text (all, if it has fewer)."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    The next row is by ascending id (then text; nulls first; after the last the first), the row itself if it is alone.
    near_edited and near_next are the likeness of a row's digest to that of its edited text and of the next row. Null
    texts count as empty; equal texts have equal fingerprints; an empty table gives none; other columns aren't read.
    Which entropies are improbable is counted over all windows of all texts."""
    counts = entropy_counts(docs, text_col)
    kind = dict(docs.dtypes)[id_col]
    schema = f"{id_col} {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def made(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        """rows: (id, text, digest, next text, next digest)."""
        from hashlib import sha256

        edited = [_edited(t, after).encode("utf-8", "surrogatepass") for _, t, _, after, _ in rows]
        other = digests(edited, counts)
        out = [
            pa.array([r[0] for r in rows], id_type),
            pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([sha256(x).hexdigest() for x in edited]),
            pa.array([text_of(r[2]) for r in rows]),
            pa.array([text_of(x) for x in other]),
            pa.array([likeness(r[2], x) for r, x in zip(rows, other, strict=True)], pa.float64()),
            pa.array([likeness(r[2], r[4]) for r in rows], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(out, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for the one behind it: (part, id, text, digest)
        for batch, found in slices(batches, "text", SLICE_CHARS // 2):
            part, stray = (batch.column(k).to_pylist() for k in (0, 1))
            own = digests([x.encode("utf-8", "surrogatepass") for x in found], counts)
            rows = []
            for p, s, x, t, d in zip(part, stray, batch.column(2).to_pylist(), found, own, strict=True):
                if held is not None and held[0] == p:
                    rows.append((*held[1:], t, d))
                held = None if s else (p, x, t, d)
            if rows:
                yield made(rows, batch.schema.field(2).type)

    return arrow(with_next(docs, id_col, text_col), run, schema)
