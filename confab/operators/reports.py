"""Aggregates over scored samples, runs and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def micro_macro(samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AGG-07 and AGG-08: sum of errors over sum of words, and the mean of the samples' own rates; 0 without words."""
    rate = ratio(F.col("errors"), F.col("n_words"))
    micro, macro = ratio(F.sum("errors"), F.sum("n_words")), F.coalesce(F.avg(rate), F.lit(0.0))
    return samples.groupBy(*(by or [])).agg(F.count("*").alias("n"), micro.alias("micro"), macro.alias("macro"))


def score_rollup(samples: DataFrame, key: str) -> DataFrame:
    """MET-12: a row for each key and one of all (key null): micro rate, macro mean of `rate`, counts."""
    return samples.rollup(key).agg(F.count("*").alias("n"), F.sum("errors").alias("errors"), F.sum("n_words").alias("n_words"), ratio(F.sum("errors"), F.sum("n_words")).alias("micro"), F.coalesce(F.avg("rate"), F.lit(0.0)).alias("macro"))


def best_worst(samples: DataFrame, rate: str, order: str) -> DataFrame:
    """AGG-09: the first sample with the least and with the greatest rate."""
    return samples.agg(F.min_by(order, F.struct(rate, order)).alias("best"), F.min_by(order, F.struct((-F.col(rate)).alias("r"), order)).alias("worst"))


def rate_histogram(samples: DataFrame, rate: str) -> DataFrame:
    """AGG-10: 0, (0, 0.1], (0.1, 0.3], above."""
    r = F.col(rate)
    return samples.agg(F.count_if(r == 0).alias("perfect"), F.count_if((r > 0) & (r <= 0.1)).alias("good"), F.count_if((r > 0.1) & (r <= 0.3)).alias("fair"), F.count_if(r > 0.3).alias("poor"))


def noise_floor(runs: DataFrame, metric: str, value: str) -> DataFrame:
    """AGG-11: mean, sample deviation (0 for one run), least, greatest, range and two deviations."""
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return runs.groupBy(metric).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), sd.alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"), (F.max(value) - F.min(value)).alias("range"), (2 * sd).alias("two_sd"))


def replicate_mean(runs: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """AGG-12: nulls don't count."""
    return runs.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])


def ab_delta(runs: DataFrame, arm: str, a: str, b: str, metric: str, value: str) -> DataFrame:
    """AGG-13: mean of arm b less that of arm a for each metric; under half a point it is noise, below 0 b is better."""
    wide = runs.groupBy(metric).agg(F.avg(F.when(F.col(arm) == a, F.col(value))).alias("a"), F.avg(F.when(F.col(arm) == b, F.col(value))).alias("b"))
    d = wide.withColumn("delta", F.col("b") - F.col("a"))
    return d.withColumn("verdict", F.when(F.abs("delta") < 0.5, "noise").when(F.col("delta") < 0, "b better").otherwise("a better"))


def _judged(decisions: DataFrame) -> tuple[Column, Column]:
    unknown = F.coalesce((F.col("assigned") == "") | (F.col("assigned") == "Unknown"), F.lit(True))
    return unknown, ~unknown & F.col("reference").isNotNull() & ~F.col("mapped").eqNullSafe(F.col("reference"))


def decision_accuracy(decisions: DataFrame) -> DataFrame:
    """AGG-14: by decision: n, wrong, unknown, seconds, wrong_seconds, rate of wrong among those not unknown. Rows have the
    decision, assigned, mapped (the reference speaker that the assigned label stands for), reference, seconds."""
    unknown, wrong = _judged(decisions)
    x = decisions.withColumns({"_u": unknown, "_w": wrong})
    out = x.groupBy("decision").agg(F.count("*").alias("n"), F.count_if("_w").alias("wrong"), F.count_if("_u").alias("unknown"), F.sum("seconds").alias("seconds"), F.coalesce(F.sum(F.when(F.col("_w"), F.col("seconds"))), F.lit(0.0)).alias("wrong_seconds"))
    return out.withColumn("rate", ratio(F.col("wrong"), F.col("n") - F.col("unknown")))


def banded(decisions: DataFrame, value: str, edges: list[float], names: list[str]) -> DataFrame:
    """AGG-15 and AGG-16: n, wrong and rate by band of a value ([low, high) each); unknown decisions, those without a
    reference and those without the value are left out."""
    unknown, wrong = _judged(decisions)
    v = F.col(value)
    band = F.lit(len(edges))
    for k in reversed(range(len(edges))):
        band = F.when(v < edges[k], F.lit(k)).otherwise(band)
    x = decisions.where(~unknown & F.col("reference").isNotNull() & v.isNotNull()).withColumns({"_w": wrong, "_b": band})
    out = x.groupBy("_b").agg(F.count("*").alias("n"), F.count_if("_w").alias("wrong"))
    return out.select(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_b") + 1).alias("band"), "n", "wrong", ratio(F.col("wrong"), F.col("n")).alias("rate"))


def mean_confidence(decisions: DataFrame, value: str) -> DataFrame:
    """AGG-16: the mean confidence of right and of wrong decisions, over the same decisions as banded()."""
    unknown, wrong = _judged(decisions)
    x = decisions.where(~unknown & F.col("reference").isNotNull() & F.col(value).isNotNull()).withColumn("_w", wrong)
    return x.agg(F.avg(F.when(~F.col("_w"), F.col(value))).alias("right"), F.avg(F.when(F.col("_w"), F.col(value))).alias("wrong"))


def longest_probe(probes: DataFrame, key: str, seconds: str = "seconds", order: str = "pos") -> DataFrame:
    """SRT-06: of each key the probe with the most seconds (null counts as 0), the first of equals."""
    rest = [c for c in probes.columns if c != key]
    x = probes.groupBy(key).agg(F.min(F.struct((-F.coalesce(seconds, F.lit(0.0))).alias("_s"), F.col(order).alias("_o"), *[F.col(c) for c in rest])).alias("_r"))
    return x.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def session_means(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """AGG-24: sessions, and the mean of each metric over them (a session counts once, whatever its length)."""
    return scores.agg(F.count("*").alias("sessions"), *[F.avg(m).alias(f"avg_{m}") for m in metrics])


def latency(chunks: DataFrame, by: str, skip: int = 1) -> DataFrame:
    """AGG-21: mean and median latency without the first chunks, and processing over audio time."""
    n = F.row_number().over(W.partitionBy(by).orderBy("chunk"))
    warm = chunks.withColumn("_n", n).where(f"_n > {skip}")
    return warm.groupBy(by).agg(F.count("*").alias("n"), F.avg("latency").alias("mean_latency"), F.median("latency").alias("median_latency"), ratio(F.sum(F.col("stt") + F.col("diar")), F.sum("audio")).alias("rtf"))


def peaks(samples: DataFrame, columns: list[str]) -> DataFrame:
    """AGG-22."""
    return samples.agg(*[F.max(c).alias(f"peak_{c}") for c in columns])


def dataset_summary(samples: DataFrame, speaker: str, seconds: str) -> DataFrame:
    """AGG-23."""
    return samples.agg(F.count("*").alias("n"), F.sum(seconds).alias("total"), F.avg(seconds).alias("mean"), F.min(seconds).alias("low"), F.max(seconds).alias("high"), F.count_distinct(speaker).alias("n_speakers"))


def sweep_cells(results: DataFrame, by: list[str], value: str) -> DataFrame:
    """AGG-25 and SRT-08: the mean of each cell (NaN and null out) and whether it is the least (the first of equals)."""
    m = results.where(~F.isnan(value)).groupBy(*by).agg(F.avg(value).alias("mean"))
    # over one row a cell; the number of cells is that of the grid
    return m.withColumn("best", F.row_number().over(W.orderBy("mean", *by)) == 1)


def outcome_dedup(results: DataFrame, signature: str, order: str) -> DataFrame:
    """AGG-27 and SET-06: the first configuration of each distinct outcome, with how many share it."""
    w = W.partitionBy(signature)
    x = results.withColumn("_n", F.row_number().over(w.orderBy(order))).withColumn("n_same", F.count("*").over(w))
    return x.where("_n = 1").drop("_n")


def rank_outcomes(results: DataFrame, keys: list[str], n: int) -> DataFrame:
    """SRT-02, SRT-03, SWP-03: the n best by several keys."""
    return results.orderBy(*keys).limit(n)


def top_hypotheses(hyps: DataFrame, key: str, words: str = "n_words") -> DataFrame:
    """SRT-04: of each key the eight longest, and all of 50 words or more."""
    n = F.row_number().over(W.partitionBy(key).orderBy(F.desc(words), "speaker"))
    return hyps.withColumn("_n", n).where((F.col("_n") <= 8) | (F.col(words) >= 50)).drop("_n")


def top_margin(scores: DataFrame, probe: str = "probe", label: str = "label", score: str = "score") -> DataFrame:
    """WIN-10: the best label of each probe, its score and lead over the second (null if alone)."""
    w = W.partitionBy(probe).orderBy(F.desc(score), label)
    x = scores.withColumn("_n", F.row_number().over(w)).withColumn("_second", F.lead(score).over(w))
    return x.where("_n = 1").select(probe, F.col(label).alias("best"), F.col(score).alias("best_score"), (F.col(score) - F.col("_second")).alias("margin"))


def energy_top(blocks: DataFrame, key: str, n: int) -> DataFrame:
    """WIN-13: each key's n loudest blocks, in time order by `block`."""
    w = W.partitionBy(key).orderBy(F.desc("rms"), "block")
    return blocks.withColumn("_n", F.row_number().over(w)).where(f"_n <= {n}").drop("_n")


def partial_due(n_frames: Column) -> Column:
    """WIN-14 and STM-04: every 10th frame up to 100, then every 20th."""
    return F.when(n_frames <= 100, n_frames % 10 == 0).otherwise(n_frames % 20 == 0)


def before_after(before: DataFrame, after: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """SWP-05: a row for each key and metric with both values and the change."""
    long = lambda df, out: df.unpivot([key], metrics, "metric", out)
    return long(before, "before").join(long(after, "after"), [key, "metric"]).withColumn("change", F.col("after") - F.col("before"))


def coverage(speech: DataFrame, hypothesis: DataFrame, key: str) -> DataFrame:
    """MET-13: hypothesis seconds over speech seconds, and compute over audio time."""
    h = hypothesis.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("hyp_seconds"))
    x = speech.join(h, key, "left")
    return x.select(key, ratio(F.coalesce("hyp_seconds", F.lit(0.0)), F.col("speech_seconds")).alias("coverage"), ratio(F.col("compute_seconds"), F.col("audio_seconds")).alias("rtf"))
