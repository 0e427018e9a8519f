"""Numeric functions of timing, decision quality and speaker posteriors, as Column expressions.

Unknown durations and missing rivals are null (infinity and NaN count as null at the edge)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def parse_time(value: Column) -> Column:
    """NUM-01: seconds of a number, a number in text, MM:SS(.s) or HH:MM:SS(.s); null for anything else."""
    t = F.trim(value.cast("string"))
    p = F.split(t, ":")
    at = lambda k: F.try_element_at(p, F.lit(k)).try_cast("double")
    return F.coalesce(t.try_cast("double"), F.when(F.size(p) == 3, at(1) * 3600 + at(2) * 60 + at(3)), F.when(F.size(p) == 2, at(1) * 60 + at(2)))


def parse_time_json(raw: Column) -> Column:
    """NUM-01 over JSON text: a scalar, or an object with `original`, else its first value."""
    v = F.trim(raw)
    objects = F.from_json(F.when(v.startswith("{"), v), "map<string,string>")
    inner = F.coalesce(F.try_element_at(objects, F.lit("original")), F.try_element_at(F.map_values(objects), F.lit(1)))
    return parse_time(F.coalesce(inner, F.regexp_replace(v, '^"|"$', "")))


def pcm_duration_ms(n_bytes: Column, rate: Column, channels: Column) -> Column:
    """NUM-02: an error for a rate or channel count that isn't positive."""
    good = F.assert_true((rate > 0) & (channels > 0), "rate and channels must be positive")
    return F.when(good.isNull(), F.floor(n_bytes / (2 * channels)) / rate * 1000.0)


def known(x: Column) -> Column:
    return F.when(~(F.isnan(x) | (x == float("inf"))), x)


def duration_quality(duration: Column) -> Column:
    """NUM-03: (d - 0.35) / 1.85 within [0.25, 1]; 1 if unknown."""
    return F.coalesce(F.greatest(F.lit(0.25), F.least(F.lit(1.0), (known(duration) - 0.35) / (2.2 - 0.35))), F.lit(1.0))


def maturity(seconds: Column) -> Column:
    """NUM-04."""
    return F.least(F.lit(1.0), 0.45 + 0.55 * (F.coalesce(seconds, F.lit(0.0)) / 8.0))


def effective_threshold(threshold: Column | float, quality: Column, mature: Column) -> Column:
    """NUM-05."""
    base = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return base + (1.0 - quality) * 0.08 + (1.0 - mature) * 0.06


@dataclass(frozen=True)
class PosteriorConfig:
    theta: float = 0.55
    temperature: float = 0.09
    unknown_bias: float = 0.0
    competitor_slope: float = 0.25
    duration_slope: float = 1.0


def temperature_for(duration: Column, c: PosteriorConfig) -> Column:
    """NUM-06: short speech flattens the distribution."""
    if c.duration_slope <= 0:
        return F.lit(c.temperature)
    return F.coalesce(c.temperature * (1.0 + c.duration_slope / F.greatest(known(duration), F.lit(0.05))), F.lit(c.temperature))


def posterior(scores: DataFrame, c: PosteriorConfig = PosteriorConfig(), probe: str = "probe", label: str = "label", score: str = "score", duration: str | None = None) -> DataFrame:
    """NUM-07: probe, best_label, p_best, p_unknown, p_unknown_raw, temperature and, for each row of scores, p.

    A softmax over the labels' scores and an `unknown` rival whose logit falls as the best score rises and, with
    slope * ln(K), rises with the number of rivals; raw leaves that part out. One window over the probe: a shuffle by
    probe, no join. Ties for the best go to the lesser label."""
    w = W.partitionBy(probe)
    t = temperature_for(F.col(duration), c) if duration else F.lit(c.temperature)
    x = scores.withColumn("temperature", t).withColumn("_k", F.count("*").over(w)).withColumn("_top", F.max(score).over(w))
    x = x.withColumn("_z", (F.col(score) - c.theta) / F.col("temperature")).withColumn("_u", (c.theta - F.col("_top")) / F.col("temperature") + c.unknown_bias)
    x = x.withColumn("_v", F.col("_u") + c.competitor_slope * F.ln("_k"))
    x = x.withColumn("_peak", F.greatest(F.max("_z").over(w), "_v")).withColumn("_raw", F.greatest(F.max("_z").over(w), "_u"))
    total = F.sum(F.exp(F.col("_z") - F.col("_peak"))).over(w) + F.exp(F.col("_v") - F.col("_peak"))
    raw_total = F.sum(F.exp(F.col("_z") - F.col("_raw"))).over(w) + F.exp(F.col("_u") - F.col("_raw"))
    best = F.min(F.when(F.col(score) == F.col("_top"), F.col(label))).over(w)
    x = x.withColumn("p", F.exp(F.col("_z") - F.col("_peak")) / total).withColumn("p_unknown", F.exp(F.col("_v") - F.col("_peak")) / total)
    x = x.withColumn("p_unknown_raw", F.exp(F.col("_u") - F.col("_raw")) / raw_total).withColumn("best_label", best)
    return x.withColumn("p_best", F.max("p").over(w)).drop("_k", "_top", "_z", "_u", "_v", "_peak", "_raw")


def policy_gates(p_best: Column, p_unknown_raw: Column, assign: float = 0.459, learn: float = 0.459, new_speaker: float = 0.60) -> Column:
    """NUM-08: struct of the three decisions."""
    return F.struct((p_best >= assign).alias("confident"), (p_best >= learn).alias("may_learn"), (p_unknown_raw >= new_speaker).alias("may_create"))


def cohort_normalize(scores: DataFrame, alpha: float, reference: float, probe: str = "probe", score: str = "score") -> DataFrame:
    """NUM-10: adds `normalized`: score - alpha * (mean of the probe's other scores - reference); as it is below three."""
    w = W.partitionBy(probe)
    n, total = F.count("*").over(w), F.sum(score).over(w)
    other = (total - F.col(score)) / (n - 1)
    return scores.withColumn("normalized", F.when((n >= 3) & F.lit(alpha > 0), F.col(score) - alpha * (other - reference)).otherwise(F.col(score)))


def log_likelihood(score: Column, same: Column, theta: Column | float, temperature: Column | float) -> Column:
    """NUM-11: log probability of a label under the logistic curve (argument within 40, probability within [1e-9, 1 - 1e-9])."""
    theta, temperature = (x if isinstance(x, Column) else F.lit(x) for x in (theta, temperature))
    z = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), (score - theta) / temperature))
    p = 1.0 / (1.0 + F.exp(-z))
    return F.ln(F.greatest(F.lit(1e-9), F.least(F.lit(1.0 - 1e-9), F.when(same, p).otherwise(1.0 - p))))


def round_binary(x: Column, digits: int) -> Column:
    """NUM-12: rounded to so many decimals by the exact binary value, halves to even (neither round nor bround does that:
    they round the shortest decimal form)."""
    shape = "0" + ("." + "0" * digits if digits else "")
    return F.replace(F.call_function("format_number", x.cast("double"), F.lit(shape)), F.lit(","), F.lit("")).cast("double")


def threshold_grid(start: float, end: float, step: float) -> list[float]:
    """NUM-13: by whole steps, two decimals."""
    return [round(start + k * step, 2) for k in range(int(round((end - start) / step)) + 1)]


def pretty_duration(seconds: Column) -> Column:
    """NUM-14: 59s, 1m05s, 1h02m."""
    s = F.floor(seconds).cast("bigint")
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm%02ds", F.floor(s / 60).cast("bigint"), s % 60)).otherwise(F.format_string("%dh%02dm", F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint")))
