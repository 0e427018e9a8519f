"""SimHash fingerprints and near-duplicate groups by multi-index hashing."""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import by_text, durable, parallelism, unused
from .components import components

BITS = 64


def simhash(text: str, words: int = 3, seed: int = 42) -> int:
    """The fingerprint as a signed 64-bit integer: bit k is set if it is in over half of the shingles' XXH64.

    Words are runs without ASCII white space, A-Z in lower case; a shorter text is one shingle; no word: 0."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        hashes = [xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])[: len(found) - words + 1]
        hashes = list(map(xxh64_intdigest, map(joined.__getitem__, map(slice, begins.tolist(), ends[words - 1 :].tolist())), repeat(seed)))
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 16384):
        part = np.array(hashes[k : k + 16384], "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (bigint) of each row; a null text counts as empty (fp 0)."""
    kind = dict(docs.dtypes)[id_col]
    make = lambda rest, found: {id_col: rest[id_col], "fp": np.array([simhash(x, words) for x in found], np.int64)}
    return by_text(docs, [id_col], f"{id_col} {kind}, fp bigint", make, text_col)


def _segments(max_bits: int) -> list[tuple[int, int, int]]:
    """(first bit, width, radius) of the segments that the fingerprint is cut to: so many that no ball has a radius over 1.

    Of two fingerprints at max_bits = m * r + a differing bits or fewer in m segments, one of the first a + 1 segments
    differs in at most r bits or one of the others in at most r - 1."""
    m = max(2, max_bits // 2 + 1)
    edges = [BITS * i // m for i in range(m + 1)]
    r, a = divmod(max_bits, m)
    return [(lo, hi - lo, r if i <= a else r - 1) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]


def _looked_up(fps: DataFrame, segments: list[tuple[int, int, int]], balls: bool) -> DataFrame:
    """fp and key, a segment's number and value: one row for each segment, or one for each value in its Hamming ball."""
    flips = [(i, lo, (1 << width) - 1, x) for i, (lo, width, radius) in enumerate(segments) if radius >= 0 for x in (0, *((1 << k for k in range(width)) if balls and radius else ()))]
    cut = F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(lo).alias("lo"), F.lit(mask).cast("bigint").alias("mask"), F.lit(x).cast("bigint").alias("flip")) for i, lo, mask, x in flips])
    rows = fps.select("fp", F.explode(cut).alias("p"))
    return rows.select("fp", F.expr("shiftleft(p.i, 32) | ((shiftrightunsigned(fp, p.lo) & p.mask) ^ p.flip)").alias("key"))


def _within(a: str, b: str, max_bits: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits


def _stars(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links (fp, other) that join all that links at max_bits (1 or 2) join, whatever the segments: two fingerprints at 2
    bits share a point at 1 bit from both. A point has at most 65 fingerprints, which lie within 2 bits of one another,
    so each links to the least of them: 65 rows for a fingerprint and never a square of a group."""
    points = [0, *(1 << k if k < 63 else -(1 << 63) for k in range(BITS))]
    at = fps.select("fp", F.explode(F.array(*[F.lit(x).cast("bigint") for x in points])).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("key"))
    # at 1 bit a fingerprint meets the other as the point itself
    least = at.groupBy("key").agg(F.min("fp").alias("other")) if max_bits == 2 else fps.select(F.col("fp").alias("key"), F.col("fp").alias("other"))
    return at.join(least, "key").where((F.col("fp") != F.col("other")) & _within("fp", "other", max_bits)).select("fp", "other")


def links(fps: DataFrame, max_bits: int = 2, bucket: int = 64) -> DataFrame:
    """Edges (a, b) between distinct fingerprints at max_bits or fewer differing bits, enough of them to join all that such
    links connect.

    fps has one column fp of distinct values. Multi-index hashing: each segment has a table of all fingerprints by the
    segment's value. A fingerprint looks up the values in a small Hamming ball about each of its own segments (see
    _segments), and complete distances are verified with what the tables hold there. At 2 bits that is 2 tables of 32 bits
    and 34 values. Where a value holds more than bucket fingerprints, those that look it up aren't compared by pairs but
    join by _stars (at 1 or 2 bits; at more they are compared all the same)."""
    if not 0 <= max_bits < BITS // 4:
        raise ValueError(f"max_bits is 0 to {BITS // 4 - 1}")
    if max_bits == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    segments = _segments(max_bits)
    fps = fps.repartition(parallelism(fps.sparkSession), "fp")
    table = _looked_up(fps, segments, False).withColumnRenamed("fp", "other")
    if max_bits <= 2:
        crowded = table.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("key")
        table = table.join(crowded, "key", "left_anti").select("key", "other").union(crowded.select("key", F.lit(None).cast("bigint")))
    asked = _looked_up(fps, segments, True)
    met = (F.col("fp") > F.col("other")) & _within("fp", "other", max_bits)
    found = asked.join(table.hint("shuffle_hash"), (asked["key"] == table["key"]) & (F.col("other").isNull() | met)).select("fp", "other").distinct()
    if max_bits <= 2:
        found = durable(found)
        found = found.where("other IS NOT NULL").union(_stars(found.where("other IS NULL").select("fp"), max_bits))
    return found.select(F.col("fp").alias("a"), F.col("other").alias("b"))


def _groups(fps: DataFrame, max_bits: int, first: Column) -> DataFrame:
    """fp and least, the smallest value of first in the fingerprint's component."""
    nodes = durable(fps.groupBy("fp").agg(F.min(first).alias("rep")))
    roots = components(links(nodes.select("fp"), max_bits))
    joined = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    return joined.join(joined.groupBy("root").agg(F.min("rep").alias("least")), "root").select("fp", "least")


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 lower-case hex digits), component_id of each row.

    Rows link at max_bits or fewer differing bits; component_id is the smallest id reachable, itself included. Equal
    fingerprints are one node, so copies are never paired. Null and empty texts have fingerprint 0 and link like any
    other. A row with a null id belongs to its component, whose id is the smallest that isn't null (null if there is
    none). Repeated rows give a row each; an empty table gives none; other columns aren't read."""
    fps = durable(fingerprints(docs, words, id_col, text_col))
    of = _groups(fps, max_bits, F.col(id_col)).withColumnRenamed("least", "component_id")
    return fps.join(of, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, with all their columns (of any name): of each component one, that with the smallest id (then smallest
    hash of the text; nulls last; of rows equal in both any one).

    A null or empty text has fingerprint 0, as in near_duplicates; very long texts count whole; an empty table gives none."""
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), mark.alias("mark"), F.col(text_col).alias("text"))
    kind = dict(docs.dtypes)[id_col]
    make = lambda rest, found: rest | {"fp": np.array([simhash(x, words) for x in found], np.int64)}
    fps = durable(by_text(rows, ["id", "mark"], f"id {kind}, mark bigint, fp bigint", make))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    kept_id, kept_mark, own, copy = unused(docs.columns, 4)
    kept = _groups(fps, max_bits, place).select("least.id", "least.mark").distinct().toDF(kept_id, kept_mark)
    joined = docs.withColumn(own, mark).join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_mark)))
    one = W.partitionBy(kept_id, kept_mark).orderBy(F.lit(0))
    return joined.withColumn(copy, F.row_number().over(one)).where(F.col(copy) == 1).select(*docs.columns)
