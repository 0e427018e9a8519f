"""Sweeps over configurations: a grid is rows, a run is a DataFrame keyed by its configuration, and equal outcomes are
scored once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields, replace
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import durable
from .islands import Rules, refine
from .reports import rank_outcomes, ratio

MOST_CONFIGS = 1_000_000


def grid(spark: SparkSession, **values: list) -> DataFrame:
    """SWP-01: config (from 0, in the order of the product, names in text order) and a column for each name."""
    names = sorted(values)
    rows = [(k, *x) for k, x in enumerate(product(*(values[n] for n in names)))]
    if len(rows) > MOST_CONFIGS:
        raise ValueError(f"over {MOST_CONFIGS} configurations")
    kind = lambda v: "bigint" if isinstance(v[0], int) else "double" if isinstance(v[0], float) else "string"
    return spark.createDataFrame(rows, "config bigint, " + ", ".join(f"{n} {kind(values[n])}" for n in names))


def rule_grid(base: Rules = Rules(), **values: list) -> list[tuple[int, Rules]]:
    """(config, rules) in the order of grid(); names are fields of Rules."""
    unknown = set(values) - {f.name for f in fields(Rules)} | {"passes", "min_segments"} & set(values)
    if unknown:
        raise ValueError(f"no such rules, or not for a grid: {sorted(unknown)}")
    names = sorted(values)
    return [(k, replace(base, **dict(zip(names, x, strict=True)))) for k, x in enumerate(product(*(values[n] for n in names)))]


def outcomes(segments: DataFrame, configs: list[tuple[int, Rules]], session: str = "session") -> DataFrame:
    """SWP-02: config, session, signature (a hash of the final labels in order), relabelled (how many segments changed) and
    labels (the final ones) of each configuration. configs differ in thresholds only.

    All configurations run through one refinement: a session of a configuration is a session of its own, whose key carries
    the thresholds that differ, so neither the plan nor the number of jobs grows with the grid."""
    if not configs:
        raise ValueError("no configurations")
    if len(configs) > MOST_CONFIGS:
        raise ValueError(f"over {MOST_CONFIGS} configurations")
    base = configs[0][1]
    differ = [f.name for f in fields(Rules) if any(getattr(r, f.name) != getattr(base, f.name) for _, r in configs)]
    rules = replace(base, **{n: F.col("session")[n] for n in differ})
    cells = F.array(*[F.struct(F.lit(k).cast("bigint").alias("config"), *[F.lit(getattr(r, n)).alias(n) for n in differ]) for k, r in configs])
    spread = segments.select(F.col(session).alias("_own"), "pos", "speaker", "start", "end", F.explode(cells).alias("_cell"))
    keyed = spread.select(F.struct("_cell.*", F.col("_own").alias("own")).alias("session"), "pos", "speaker", "start", "end")
    order = F.array_sort(F.collect_list(F.struct("pos", "speaker")))["speaker"]
    one = refine(keyed, rules).groupBy("session").agg(order.alias("labels"), F.count_if(F.col("refined_from").isNotNull()).alias("relabelled"))
    return durable(one.select("session.config", F.col("session.own").alias(session), F.xxhash64("labels").alias("signature"), "relabelled", "labels"))


def memoised(found: DataFrame, score: Callable[[DataFrame], DataFrame], session: str = "session") -> DataFrame:
    """SWP-02: found with the columns that score() gives for (session, signature, labels); each distinct outcome of a
    session is scored once, however many configurations share it."""
    distinct = found.groupBy(session, "signature").agg(F.min_by("labels", "config").alias("labels"))
    return found.drop("labels").join(score(distinct), [session, "signature"])


def summary(scored: DataFrame) -> DataFrame:
    """SWP-02 and AGG-27: a row for each distinct outcome over all sessions: the first configuration that has it, n_same,
    errors over words as cpwer, the mean wer, speakers and relabelled segments. Rows: config, session, signature,
    relabelled, errors, n_words, wer, speakers."""
    by = scored.groupBy("config").agg(
        F.xxhash64(F.array_sort(F.collect_list(F.struct("session", "signature")))).alias("outcome"),
        (100 * ratio(F.sum("errors"), F.sum("n_words"))).alias("cpwer"),
        F.avg("wer").alias("wer"),
        F.sum("speakers").alias("speakers"),
        F.sum("relabelled").alias("relabelled"),
    )
    w = W.partitionBy("outcome")
    x = by.withColumn("n_same", F.count("*").over(w)).withColumn("_n", F.row_number().over(w.orderBy("config")))
    return x.where("_n = 1").drop("_n", "outcome")


def with_expensive(ranked: DataFrame, keys: list[str], n: int, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """SWP-03: the n best by keys, with the columns that score() gives for them by config; the others aren't scored."""
    top = durable(rank_outcomes(ranked, keys, n))
    return top.join(score(top.select("config")), "config", "left")


def sweep(configs: DataFrame, rows: DataFrame, run: Callable[[DataFrame], DataFrame], keep: list[str] | None = None) -> DataFrame:
    """SWP-04: every configuration on all rows as one DataFrame: run() gets the rows with the configuration's columns and
    gives rows that keep `config`. A failed configuration shows as one without rows. The grid is small and known, so each
    row carries it as an array: nothing is joined, and work spreads by row and configuration."""
    names = configs.columns
    cells = [r.asDict() for r in configs.limit(MOST_CONFIGS + 1).collect()]
    if len(cells) > MOST_CONFIGS:
        raise ValueError(f"over {MOST_CONFIGS} configurations")
    kinds = dict(configs.dtypes)
    cell = F.array(*[F.struct(*[F.lit(c[n]).cast(kinds[n]).alias(n) for n in names]) for c in cells])
    return run(rows.withColumn("_cell", F.explode(cell)).select(*(keep or rows.columns), "_cell.*"))


def replicates(configs: DataFrame, n: int) -> DataFrame:
    """SWP-04: each configuration n times, numbered by `run`."""
    return configs.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
