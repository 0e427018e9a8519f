"""Near-duplicate lines by a segment-partition edit join (Pass-Join), and their removal.

A line of under 20 words is a string of characters, a longer one a string of words. Two such strings within t edits
share, if the shorter one is cut into t + 1 segments, at least one segment, at nearly the same place. Each distinct line is
indexed by its segments and probes, for its own length and each shorter one in reach, the substrings that can be such a
segment (the multi-match-aware choice of positions). All segments of a slice of lines are hashed at once, as differences
of prefix sums. Index and probe entries meet by hash; only entries that meet another line's go on to get their texts, and
each match is verified with a banded bit-parallel edit distance. Within a match group lines that are connected already
aren't compared again, so a group gives at most one link for each line and not all its pairs.

The edits of a long line grow with the root of its words, so that the probes of a line, about a third of the third power
of its edits, stay fewer than two for each word up to 20,000 words. Up to 225 words that is at least one edit in 45
words, as many single words as leave the 5-word shingles of two lines 0.8 alike."""

from __future__ import annotations

import re
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, by_text, durable, parallelism, small_batches, text_slices, unused
from .components import components

FILTER_BITS = 23
SLICE = 1_000_000  # characters of lines that are told apart at once
LONG_LINE = 20  # words
LONG_WORD = 40  # a longer word, or one in a script without blanks, counts as its characters
INDEX, PROBE = 0, 1
CHUNK = 512  # lines of a match group that are compared at once with as many others


def word_edits(words: int) -> int:
    """The edits of a line of so many words (20 or more): two, or a third of the root of its words."""
    return max(2, isqrt(words) // 3)


@lru_cache(65536)
def cuts(length: int, edits: int) -> tuple[tuple[int, int], ...]:
    """(begin, size) of edits + 1 segments as even as can be, the longer ones last."""
    n = edits + 1
    small, more = divmod(length, n)
    out, at = [], 0
    for i in range(n):
        size = small + (i >= n - more)
        out.append((at, size))
        at += size
    return tuple(out)


@lru_cache(256)
def places(length: int, edits: int, by_words: bool) -> np.ndarray:
    """(segment, indexed length, begin, size, kind) of the segments that a line of this length is indexed by, and of the
    substrings that it looks up. By words, edits is the least number for any length."""
    most = (lambda n: word_edits(n)) if by_words else (lambda n: edits)
    least = LONG_LINE if by_words else edits + 1
    out = [(i, length, p, size, INDEX) for i, (p, size) in enumerate(cuts(length, most(length)))]
    for other in range(max(least, length - most(length)), length + 1):
        d, t = length - other, most(other)
        if d > t:
            continue
        for i, (p, size) in enumerate(cuts(other, t)):
            low = max(0, p - i, p + d - (t - i))
            high = min(length - size, p + i, p + d + (t - i))
            out += [(i, other, q, size, PROBE) for q in range(low, high + 1)]
    return np.array(out, np.int64).reshape(-1, 5)


def within(a: str, b: str, edits: int) -> bool:
    """Whether a turns into b with at most so many insertions, deletions and replacements of characters.

    After the common ends are cut off, a bit-parallel automaton runs over b: for each number of errors a word with one
    bit for each diagonal of the band of width 2 * edits + 1. The places of a character are kept within the band too, so
    each step costs the same however long the strings are."""
    if abs(len(a) - len(b)) > edits:
        return False
    k = _common(a, b)
    a, b = a[k:], b[k:]
    k = _common(a[::-1], b[::-1])
    if k:
        a, b = a[:-k], b[:-k]
    if len(a) <= edits and len(b) <= edits:
        return True  # replace, then insert or delete the rest
    width = 2 * edits + 1
    full = (1 << width) - 1
    where: dict[str, tuple[int, int]] = {}  # character: its places within the band, seen from step

    def add(i: int, step: int) -> None:
        places, was = where.get(a[i], (0, step))
        where[a[i]] = places >> (step - was) | 1 << (i - step + edits), step

    for i in range(min(edits, len(a))):
        add(i, 0)
    # bit d + edits of word e: a[: j + d] turns into b[:j] with e errors
    now = [1 << edits]
    for _ in range(edits):
        now.append((now[-1] << 1 | now[-1]) & full)
    for j, c in enumerate(b):
        if j + edits < len(a):
            add(j + edits, j)
        found, was = where.get(c, (0, j))
        match = found >> (j - was) & full
        after = [now[0] & match]
        for e in range(1, edits + 1):
            after.append(((now[e] & match) | now[e - 1] | now[e - 1] >> 1 | after[-1] << 1 | after[-1]) & full)
        now = after
        if not now[-1]:
            return False
    return bool(now[-1] >> (len(a) - len(b) + edits) & 1)


def _common(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _key(line: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))


def lines_of(text: str) -> list[str]:
    return text.split("\n")


UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def words_of(line: str) -> list[bytes]:
    """Words are parted by ASCII blanks; very long ones and those of scripts without blanks count as their characters."""
    found = line.encode("utf-8", "surrogatepass").split()
    if len(max(found, key=len, default=b"")) <= LONG_WORD and (line.isascii() or not UNSPACED.search(line)):
        return found
    out = []
    for w in found:
        x = w.decode("utf-8", "surrogatepass")
        if len(x) > LONG_WORD or UNSPACED.search(x):
            out += [c.encode("utf-8", "surrogatepass") for c in x]
        else:
            out.append(w)
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


_known: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_known.get(base, ())) < n:
        out = np.full(1 << n.bit_length(), base, np.uint64)
        out[0] = 1
        if len(out) > 1 << 23:  # a slice with a very long line: not kept
            return np.multiply.accumulate(out)[:n]
        _known[base] = np.multiply.accumulate(out)
    return _known[base][:n]


def _hashed(symbols: np.ndarray, sizes: np.ndarray, edits: int, by_words: bool) -> tuple[np.ndarray, np.ndarray]:
    """(line, sig) of the entries of lines given as hashed symbols on end. The last bit of a sig is its kind."""
    n = len(symbols)
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(_mix(symbols) * _powers(BASE, n))])
    back = _powers(UNBASE, n + 1)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    lines, sigs = [], []
    for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        if not group.size:
            continue
        at = places(int(sizes[group[0]]), edits, by_words)
        salt = _mix(_mix(at[:, 1].astype(np.uint64) + np.uint64(BASE)) + (at[:, 0] * 2 + by_words).astype(np.uint64))
        for k in range(0, len(group), max(1, 500_000 // len(at))):
            part = group[k : k + max(1, 500_000 // len(at))]
            begin = starts[part][:, None] + at[:, 2]
            h = (sums[begin + at[:, 3]] - sums[begin]) * back[begin]
            h = _mix(_mix(h) + salt)
            lines.append(np.repeat(part, len(at)))
            sigs.append((h & ~np.uint64(1) | at[:, 4].astype(np.uint64)).ravel())
    if not lines:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(lines), np.concatenate(sigs)


def _word_hashes(flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each of the byte strings flat[begin:end]."""
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.add.accumulate((flat + np.uint64(1)) * _powers(BASE, len(flat)), out=sums[1:])
    return _mix((sums[end] - sums[begin]) * _powers(UNBASE, len(flat) + 1)[begin] + (end - begin).astype(np.uint64))


def _symbols(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of words of each line, and hashes of the words of those that have LONG_LINE or more, on end."""
    data = [x.encode("utf-8", "surrogatepass") for x in lines]
    flat = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    ends = np.cumsum([len(x) + 1 for x in data])
    starts = np.concatenate([[0], ends[:-1]])
    blank = (flat == 32) | (flat - np.uint8(9) < 5)
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    begin, end = edge[::2], edge[1::2]
    of = np.searchsorted(ends, begin, "right")
    # lines with words that may count as their characters are looked at one by one
    odd = np.maximum.reduceat(flat, starts) >= 0xE0
    odd[of[end - begin > LONG_WORD]] = True
    n = np.bincount(of, minlength=len(lines))
    apart = np.flatnonzero(odd)
    split = [words_of(lines[i]) for i in apart.tolist()]
    n[apart] = np.fromiter(map(len, split), np.int64, len(split))
    on = ~odd[of] & (n[of] >= LONG_LINE)
    usual = _word_hashes(flat, begin[on], end[on])
    more = [w for x in split if len(x) >= LONG_LINE for w in x]
    sizes = np.fromiter(map(len, more), np.int64, len(more))
    others = _word_hashes(np.frombuffer(b"".join(more), np.uint8), np.cumsum(sizes) - sizes, np.cumsum(sizes))
    counted = np.where(n >= LONG_LINE, n, 0)
    mine = np.repeat(odd, counted)
    out = np.empty(int(counted.sum()), np.uint64)
    out[mine], out[~mine] = others, usual
    return n, out


def entries(lines: list[str], edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, sig) of all segments of lines and of all substrings that they look up."""
    n, words = _symbols(lines)
    long, short = np.flatnonzero(n >= LONG_LINE), np.flatnonzero(n < LONG_LINE)
    a, s = _hashed(words, n[long], edits, True)
    of, sig = long[a], s
    part = [lines[i] for i in short.tolist()]
    codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    a, s = _hashed(codes + np.uint64(1), np.fromiter(map(len, part), np.int64, len(part)), edits, False)
    return np.concatenate([of, short[a]]), np.concatenate([sig, s])


def _groups(s: np.ndarray, k: np.ndarray, size: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, key, chunk, chunks) of the entries whose hash has an index and a probe entry of different lines. A group is
    known by a hash of its lines, so lines that share several segments meet once, and cut to chunks in order of key."""
    sig = s >> np.uint64(1)
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    n = np.diff(np.append(first, len(s)))
    probing = np.add.reduceat((s & np.uint64(1)).astype(np.int64), first)
    differ = np.maximum.reduceat(k, first) != np.minimum.reduceat(k, first)
    keep = np.repeat((probing > 0) & (probing < n) & differ, n)
    sig, k = sig[keep], k[keep]
    if not len(sig):
        return sig, k, np.zeros(0, np.int32), np.zeros(0, np.int32)
    order = np.lexsort((k, sig))
    sig, k = sig[order], k[order]
    fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (k[1:] != k[:-1])])
    sig, k = sig[fresh], k[fresh]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    n = np.diff(np.append(first, len(sig)))
    group = np.repeat(_mix(np.add.reduceat(_mix(k + np.uint64(BASE)), first)), n)
    order = np.lexsort((k, group))
    group, k = group[order], k[order]
    fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (k[1:] != k[:-1])])
    group, k = group[fresh], k[fresh]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    n = np.diff(np.append(first, len(group)))
    place = np.arange(len(group)) - np.repeat(first, n)
    return group, k, (place // size).astype(np.int32), np.repeat(-(-n // size), n).astype(np.int32)


def _fresh(found: list[str], min_chars: int) -> list[str]:
    return list(dict.fromkeys(x for t in found for x in lines_of(t) if len(x) >= min_chars))


def _meetings(docs: DataFrame, edits: int, min_chars: int, text: str, size: int) -> DataFrame:
    """sig, key, chunk, chunks: the lines that share a segment, by group."""
    ranges = parallelism(docs.sparkSession)
    small_batches(docs.sparkSession)

    def emit(batches):
        for found in text_slices(batches, SLICE):
            fresh = _fresh(found, min_chars)
            if not fresh:
                continue
            of, s = entries(fresh, edits)
            k = np.array([_key(x) for x in fresh], np.uint64)[of]
            where = ((s >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.uint16 if ranges < 1 << 16 else np.int64)
            order = np.argsort(where, kind="stable")
            s, k = s[order], k[order]
            cut = np.searchsorted(where[order], np.arange(ranges + 1))
            at = [r for r in range(ranges) if cut[r + 1] > cut[r]]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([s[cut[r] : cut[r + 1]].tobytes() for r in at], pa.binary()), pa.array([k[cut[r] : cut[r + 1]].tobytes() for r in at], pa.binary())], names=["range", "sigs", "keys"])

    def meet(batches):
        parts: dict[int, list] = {}
        for batch in batches:
            for r, s, k in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                parts.setdefault(r, []).append((np.frombuffer(s.as_py(), np.uint64), np.frombuffer(k.as_py(), np.uint64)))
        for r in list(parts):
            part = parts.pop(r)
            s, k = np.concatenate([x[0] for x in part]), np.concatenate([x[1] for x in part])
            order = np.argsort(s)
            group, k, chunk, chunks = _groups(s[order], k[order], size)
            if len(group):
                yield pa.RecordBatch.from_arrays([pa.array(group.view(np.int64)), pa.array(k.view(np.int64)), pa.array(chunk), pa.array(chunks)], names=["sig", "key", "chunk", "chunks"])

    return arrow(arrow(docs.select(text), emit, "range int, sigs binary, keys binary").repartitionById(ranges, F.col("range")), meet, "sig bigint, key bigint, chunk int, chunks int").distinct()


def _histograms(texts: list) -> np.ndarray:
    codes = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) if isinstance(t, str) else np.array(t, np.uint32)
    return np.array([np.bincount(codes(t) & 63, minlength=64) for t in texts], np.int32)


def _strings(lines: list[str]) -> tuple[list, bool]:
    """Lines that share a segment as strings of symbols (of one kind), and whether these are words."""
    split = [words_of(x) for x in lines]
    if len(split[0]) < LONG_LINE:
        return lines, False
    number: dict[str, int] = {}
    said = [tuple([number.setdefault(w, len(number)) for w in x]) for x in split]
    # as many words as there are characters can be written as such, which compare faster
    return (["".join(map(chr, x)) for x in said] if len(number) < 0x110000 else said), True


def join_group(rows: list[tuple[int, str]], edits: int) -> list[tuple[int, int]]:
    """Links of (a part of) one match group: rows (key, line) that share a segment. The index entries of a group have its least
    length, so only pairs with such a line are compared, and of these only unconnected ones."""
    rows = sorted(rows)
    said, by_words = _strings([t for _, t in rows])
    size = np.array([len(x) for x in said])
    least = int(size.min())
    most = word_edits(least) if by_words else edits
    # lines of the least length first: they are what the others are held against
    order = np.argsort(size, kind="stable")
    counts = _histograms([said[i] for i in order]) if len(rows) > 8 else None
    size = size[order]
    part, out = np.arange(len(rows)), []
    for i in range(int(np.searchsorted(size, least, "right"))):
        to = np.arange(i + 1, int(np.searchsorted(size, least + most, "right")))
        to = to[part[to] != part[i]]
        if counts is not None and to.size:
            # symbols that differ in number are two for each edit at most: most pairs fall to that
            to = to[np.abs(counts[to] - counts[i]).sum(1) <= 2 * most]
        while to.size:
            j, to = to[0], to[1:]
            if within(said[order[i]], said[order[j]], most):
                a, b = rows[order[i]][0], rows[order[j]][0]
                out.append((min(a, b), max(a, b)))
                part[part == part[j]] = part[i]
                to = to[part[to] != part[i]]
    return out


def links(docs: DataFrame, edits: int = 2, min_chars: int = 24, text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between keys of different lines of min_chars or more that are near: both of under 20 words and within so
    many edits of characters, or both of 20 words or more and within word_edits edits of words, by the one with fewer:
    enough to connect all that such pairs connect."""
    if min_chars <= edits:
        raise ValueError("min_chars must be over edits, so that no segment is empty")
    met = durable(_meetings(docs, edits, min_chars, text_col, chunk))
    # A filter of fixed size on the keys that met: it lets all of them pass, and of the others few while those are few
    words = met.selectExpr(f"shiftrightunsigned(key, {64 - FILTER_BITS}) AS p").selectExpr("cast(p div 32 AS int) AS w", "shiftleft(1L, cast(p % 32 AS int)) AS b")
    bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    for r in words.groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        bits[r["w"]] = r["b"]

    def emit(batches):
        for found in text_slices(batches, SLICE):
            fresh = _fresh(found, min_chars)
            k = np.array([_key(x) for x in fresh], np.uint64)
            p = k >> np.uint64(64 - FILTER_BITS)
            hit = np.flatnonzero(bits[(p >> np.uint64(5)).astype(np.int64)] >> (p & np.uint64(31)).astype(np.uint32) & 1)
            if hit.size:
                yield pa.RecordBatch.from_arrays([pa.array(k[hit].view(np.int64)), pa.array([fresh[i] for i in hit])], names=["key", "line"])

    needed = met.select("key").distinct()
    texts = arrow(docs.select(text_col), emit, "key bigint, line string").join(needed, "key", "left_semi").groupBy("key").agg(F.first("line").alias("line"))
    # a group's cells, one for each pair of its chunks: what a task holds at once is bounded, and a large group spreads
    ready = met.join(texts, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    ready = ready.select("sig", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "key", "line")
    ready = ready.repartition(parallelism(docs.sparkSession), "sig", "low", "high").sortWithinPartitions("sig", "low", "high")

    def verify(batches):
        names, held, cell, out = ["a", "b"], [], None, []
        for batch in batches:
            for s, low, high, k, t in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (s, low, high) != cell:
                    out += join_group(held, edits) if len(held) > 1 else []
                    held, cell = [], (s, low, high)
                held.append((k, t))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=names)
            out = []
        out = join_group(held, edits) if len(held) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=names)

    return arrow(ready.select("sig", "low", "high", "key", "line"), verify, "a bigint, b bigint")


def _mark(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def decisions(docs: DataFrame, edits: int = 2, min_chars: int = 24, id_col: str = "doc_id", text_col: str = "text", equal_chars: int | None = None) -> DataFrame:
    """id, mark (a hash of the text), dropped: array of (line, first_doc) of the rows that lose a line, in order.

    Lines are parted by a line feed. Lines of min_chars or more characters that are equal or near (see links), directly or
    over others, are one class; all but its first occurrence (by id, mark and line number; null ids first) are dropped;
    first_doc is where that is. Shorter lines of equal_chars (min_chars, if null) or more that aren't blank are one class
    only if they are equal; others never are dropped. Rows equal in id and text share their decisions. Lines are known by
    64 bits of a hash: of n different ones two are taken for one with a chance of about n * n / 2^65."""
    kind = dict(docs.dtypes)[id_col]
    equal = min_chars if equal_chars is None else equal_chars

    def make(rest, found):
        n = [[(i, x) for i, x in enumerate(lines_of(t)) if len(x) >= min_chars or len(x) >= equal and x.strip()] for t in found]
        row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in n]), pa.int64())
        flat = [y for x in n for y in x]
        key = np.array([_key(x) for _, x in flat], np.uint64).view(np.int64)
        return {"id": rest["id"].take(row), "mark": rest["mark"].take(row), "line": pa.array([i for i, _ in flat], pa.int32()), "key": key}

    rows = docs.select(F.col(id_col).alias("id"), _mark(text_col).alias("mark"), F.col(text_col).alias("text"))
    lines = durable(by_text(rows, ["id", "mark"], f"id {kind}, mark bigint, line int, key bigint", make))
    roots = components(links(docs, edits, min_chars, text_col))
    place = F.struct(F.col("id").isNotNull().alias("some"), "id", "mark", "line")
    keys = lines.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    joined = keys.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    classes = joined.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1")
    several = durable(joined.select("key", "root").join(classes.select("root", "first"), "root").select("key", "first"))
    lost = lines.join(several, "key").where(~place.eqNullSafe(F.col("first")))
    return lost.groupBy("id", "mark").agg(F.array_sort(F.collect_set(F.struct("line", F.col("first.id").alias("first_doc")))).alias("dropped"))


def duplicate_lines(docs: DataFrame, edits: int = 2, min_chars: int = 24, id_col: str = "doc_id", text_col: str = "text", equal_chars: int | None = None) -> DataFrame:
    """id, n_lines, n_dropped, dropped (line numbers), first_docs (id of each one's first occurrence) for each row.

    See decisions. A null text is one empty line; repeated rows give a row each; very long texts and lines are handled
    whole; an empty table gives none; other columns aren't read."""
    lost = decisions(docs, edits, min_chars, id_col, text_col, equal_chars).withColumnRenamed("id", "other")
    n = F.coalesce(F.size(F.split(F.col(text_col), "\n", -1)), F.lit(1))
    rows = docs.select(F.col(id_col).alias("id"), _mark(text_col).alias("own"), F.when(F.col(text_col).isNull(), 1).otherwise(n).alias("n_lines"))
    found = rows.join(lost, F.col("id").eqNullSafe(F.col("other")) & (F.col("own") == F.col("mark")), "left")
    dropped = F.coalesce("dropped.line", F.array().cast("array<int>"))
    kind = dict(docs.dtypes)[id_col]
    return found.select(F.col("id").alias(id_col), "n_lines", F.size(dropped).alias("n_dropped"), dropped.alias("dropped"), F.coalesce("dropped.first_doc", F.array().cast(f"array<{kind}>")).alias("first_docs"))


def remove_lines(docs: DataFrame, edits: int = 2, min_chars: int = 24, id_col: str = "doc_id", text_col: str = "text", equal_chars: int | None = None) -> DataFrame:
    """docs without the dropped lines; a row that had more than blanks and is left with none goes. Columns stay as they
    are (also others, of any name). Null texts stay; repeated rows share their decisions; an empty table gives none."""
    own, lost_id, lost_mark, lost_lines, new = unused(docs.columns, 5)
    lost = decisions(docs, edits, min_chars, id_col, text_col, equal_chars).select(F.col("id").alias(lost_id), F.col("mark").alias(lost_mark), F.col("dropped.line").alias(lost_lines))
    both = docs.withColumn(own, _mark(text_col)).join(lost, F.col(id_col).eqNullSafe(F.col(lost_id)) & (F.col(own) == F.col(lost_mark)), "left")
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains(F.col(lost_lines), i))
    text = F.when(F.col(lost_lines).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    out = both.withColumn(new, text).where(F.col(lost_lines).isNull() | (F.length(F.trim(F.regexp_replace(new, r"\s+", " "))) > 0))
    return out.select(*[F.col(new).alias(c) if c == text_col else F.col(c) for c in docs.columns])
