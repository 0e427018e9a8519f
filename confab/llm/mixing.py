"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from math import ceil, isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import durable, unused

WORD = r"[^\x20\x09-\x0D]+"
#: Sources that the driver shares targets out to, and up to how many they are sent to all workers (some 100 bytes each).
MOST_SOURCES, BROADCAST_SOURCES = 2_000_000, 50_000


def apportion(weights: np.ndarray, seats: int) -> np.ndarray:
    """Sainte-Laguë: seats go one by one to the highest weight / (2 * seats held + 1); ties to the earlier.

    A divisor d gives each party round(weight / d) seats, just those of quotients down to 1 / (2 d). Bisection finds the
    least d that gives no more than the seats there are; what is left goes by highest quotient, seat by seat, so the
    work depends on the number of parties and ties, not of seats."""
    w = np.asarray(weights, np.float64)
    held = np.zeros(len(w), np.int64)
    if seats <= 0 or w.sum() <= 0:
        return held
    at = lambda d: np.floor(w / d + 0.5).astype(np.int64)
    low, high = w.sum() / (2.0 * (seats + len(w))), 2.0 * w.max() + w.sum()
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if at(middle).sum() > seats else (low, middle)
    held = at(high)
    for _ in range(int(seats - held.sum())):
        held[int(np.argmax(w / (2 * held + 1)))] += 1
    return held


def targets(sizes: np.ndarray, weights: np.ndarray, most: float = 3.0) -> np.ndarray:
    """Shares of sum(sizes) by weight, none above most times its size; the excess is shared again by weight."""
    sizes, weights = np.asarray(sizes, np.float64), np.asarray(weights, np.float64)
    out, open_ = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    left = sizes.sum()
    while open_.any():
        share = left * weights / weights[open_].sum()
        over = open_ & (share > most * sizes)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = most * sizes[over]
        left -= out[over].sum()
        open_ &= ~over
    return out


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _plan(sized: DataFrame, keep: list[str], weights: tuple[float, ...], most: float, block: int, shard_rows: int, seed: int) -> DataFrame:
    """The columns in keep (the id first, the mark second), size, source_size, target, taken, source, whole (how often the
    row is taken whole) and spans (the words [a, b) taken once more) of rows with keep, source and size."""
    id_col, mark = keep[:2]
    sums = [(r["source"], int(r["s"]), int(r["n"])) for r in sized.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()]
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources: targets are shared out on the driver")
    sums.sort(key=lambda x: (x[0] is None, [ord(c) for c in x[0] or ""]))
    sizes = np.array([s for _, s, _ in sums], np.int64)
    goal = targets(sizes, np.array([weights[k % len(weights)] for k in range(len(sums))]), most)
    quota = np.zeros(len(sums), np.int64)
    if len(sums) and sizes.sum():
        quota = apportion(goal, int(round(goal.sum() / block)))
        quota = np.minimum(quota, np.floor(most * sizes / block).astype(np.int64) + 1)
    session = sized.sparkSession
    table = pd.DataFrame(
        {"source": pd.Series([s for s, _, _ in sums], dtype=object), "number": np.arange(len(sums)), "source_size": sizes, "target": goal, "quota": quota, "shards": np.array([-(-n // max(shard_rows, isqrt(n))) for _, _, n in sums], np.int64)}
    )
    of = session.createDataFrame(table, "source string, number bigint, source_size bigint, target double, quota bigint, shards bigint")
    # one row for each source, as read by the driver above; where they are many, Spark chooses the join
    of = F.broadcast(of) if len(sums) <= BROADCAST_SOURCES else of
    laid = sized.join(of, sized["source"].eqNullSafe(of["source"])).drop(of["source"])
    laid = laid.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), id_col, mark), F.col("shards")))
    at = W.partitionBy("number", "shard").orderBy(id_col, "size", mark).rowsBetween(W.unboundedPreceding, 0)
    laid = laid.withColumn("begin", F.sum("size").over(at) - F.col("size"))
    totals = laid.groupBy("number", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        words = pdf["words"].to_numpy()
        blocks = np.where(words > 0, np.maximum(1, np.rint(words / block)), 0).astype(np.int64)
        limit = blocks * ceil(most)
        got = np.minimum(apportion(words, int(pdf["quota"].iloc[0])), limit)
        while (over := min(int(pdf["quota"].iloc[0]), int(limit.sum())) - int(got.sum())) > 0:  # a full shard's seats go to the others
            more = np.minimum(limit - got, np.maximum(apportion(limit - got, over), 0))
            got = got + more
        return pd.DataFrame({"number": pdf["number"], "shard": pdf["shard"], "blocks": blocks, "shard_quota": got, "words": words})

    shards = totals.groupBy("number").applyInPandas(deal, "number bigint, shard bigint, blocks bigint, shard_quota bigint, words bigint")
    # block i covers words [i * words div blocks, (i + 1) * words div blocks); a row looks at the blocks it can meet
    placed = laid.join(shards, ["number", "shard"]).selectExpr(
        "*",
        "if(size > 0, greatest(0L, (begin * blocks) div words - 1), null) AS lo",
        "if(size > 0, least(blocks - 1, ((begin + size) * blocks) div words + 1), null) AS hi",
        "shard_quota % blocks AS extra",
        f"pmod(xxhash64({seed}, number, shard), blocks) AS shift",
        # a step without a common factor: a prime that doesn't divide blocks
        "if(blocks % 1000003 <> 0, 1000003L, 999983L) AS step",
    )
    once_more = """aggregate(sequence(lo, hi), 0L, (acc, i) -> acc + if((i * step + shift) % blocks < extra,
        greatest(0L, least(begin + size, ((i + 1) * words) div blocks) - greatest(begin, (i * words) div blocks)), 0L))"""
    spans = '''if(size > 0, filter(transform(filter(sequence(lo, hi), i -> (i * step + shift) % blocks < extra),
        i -> struct(greatest(begin, (i * words) div blocks) - begin AS a, least(begin + size, ((i + 1) * words) div blocks) - begin AS b)), s -> s.a < s.b), null)'''
    taken = f"if(size > 0, (shard_quota div blocks) * size + {once_more}, 0L) AS taken"
    return placed.selectExpr(*keep, "size", "source_size", "target", taken, "source", "(shard_quota div blocks) AS whole", f"{spans} AS spans")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, block: int = 32, shard_rows: int = 4096, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, size, source_size, target, taken (words of the row that the mix takes, repeats counted), source.

    Sources in code point order, null last, get weights in turn; targets share the words of all. A source's rows are
    dealt by a hash of id and text to shards of about shard_rows rows (the root of the source's rows, if that is more, so
    that neither a shard nor the list of a source's shards grows large), laid end to end by id within a shard, and cut to blocks of about
    block words, of equal size but for one word. Sainte-Laguë gives each source a number of blocks, then each of its
    shards a part of that (an integer quota). A shard takes all its blocks quota // blocks times, and quota % blocks of
    them, chosen by a seeded permutation, once more. No block, so no row, is taken more than ceil(most) times.

    Null texts have size 0. Rows without words take 0. Rows with equal ids lie in their shard by size and a hash of the
    text; repeated rows are alike and may trade what they take. Very long texts are rows like others. An empty table gives
    none; other columns aren't read. Only one row for each source reaches the driver (two million at most, else it raises)."""
    id_name, mark = unused([id_col], 2)
    sized = durable(docs.select(F.col(id_col).alias(id_name), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias(mark), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")))
    return _plan(sized, [id_name, mark], weights, most, block, shard_rows, seed).select(F.col(id_name).alias(id_col), "size", "source_size", "target", "taken", "source")


def sample_rows(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, block: int = 32, shard_rows: int = 4096, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The mix itself, with the columns of docs (of any name): a row for each time that a row is taken whole, and one with
    the words of the spans taken once more (with the white space before each; chars_col, if there, follows).

    See mix. Rows without words, so null and empty texts too, don't come; repeated rows may trade what they take; an empty
    table gives none."""
    own_id, own_mark, own_source, copy, words, text, plan_id, plan_mark, plan_copy, whole, spans = unused(docs.columns, 11)
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    # rows equal in id and text are told apart by their source, which both sides can sort by
    number = F.row_number().over(W.partitionBy(own_id, own_mark).orderBy(own_source))
    rows = docs.withColumns({own_id: F.col(id_col), own_mark: mark, own_source: F.col(source_col)})
    sized = rows.select(own_id, own_mark, own_source, n_words(F.col(text_col)).alias("size")).withColumn(copy, number)
    sized = durable(sized.withColumnRenamed(own_source, "source"))
    names = {own_id: plan_id, own_mark: plan_mark, copy: plan_copy, "whole": whole, "spans": spans}
    plan = _plan(sized, [own_id, own_mark, copy], weights, most, block, shard_rows, seed).where("taken > 0").select(*[F.col(a).alias(b) for a, b in names.items()])
    both = rows.withColumn(copy, number).join(plan, F.col(own_id).eqNullSafe(F.col(plan_id)) & (F.col(own_mark) == F.col(plan_mark)) & (F.col(copy) == F.col(plan_copy)))
    part = r"[\x20\x09-\x0D]*" + WORD
    split = both.withColumn(words, F.when(F.size(spans) > 0, F.regexp_extract_all(F.col(text_col), F.lit(part), F.lit(0))))
    once = F.expr(f"array_join(flatten(transform({spans}, s -> slice({words}, cast(s.a + 1 AS int), cast(s.b - s.a AS int)))), '')")
    again = F.when(F.size(spans) > 0, F.array(F.regexp_replace(once, r"^[\x20\x09-\x0D]+", ""))).otherwise(F.array().cast("array<string>"))
    out = split.withColumn(text, F.explode(F.concat(F.array_repeat(F.col(text_col), F.col(whole).cast("int")), again)))
    kinds = dict(docs.dtypes)
    new = {text_col: F.col(text)} | ({chars_col: F.length(text).cast(kinds[chars_col])} if chars_col in kinds else {})
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])
