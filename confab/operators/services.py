"""Operators around models and services: calibrated settings, translation scores, session reports, batch signal steps.

Models are passed in; what a missing one would give is null."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .metrics import bleu, chrf, diarization_errors, speaker_permutation_errors, word_errors
from .segments import concat_by_speaker, not_calibrating
from .speech import apply_model
from .tracking import Settings


def load_settings(spark: SparkSession, path: str, base: Settings = Settings(), new_speaker: float | None = None) -> Settings | None:
    """SRC-17 and NUM-09: tracker settings from a calibration file (theta, temperature, suggested_cutpoints by target); None
    if it holds no curve. Assigning needs the 5 % cut, learning the highest cut that covers a tenth; new speakers take the
    argument, else the file's value, else 0.60."""
    r = calibrations(spark.read.text(path, wholetext=True), base, new_speaker).first()
    if r is None or r["theta"] is None or r["temperature"] is None:
        return None
    return Settings(**{**base.__dict__, "posterior": (r["theta"], r["temperature"], 0.25, 1.0), "policy": (r["assign"], r["learn"], r["new_speaker"])})


def calibrations(raw: DataFrame, base: Settings = Settings(), new_speaker: float | None = None) -> DataFrame:
    """SRC-17 over a column `value` of JSON: theta, temperature, assign, learn, new_speaker, and the other columns."""
    kind = "theta double, temperature double, new_speaker double, suggested_cutpoints map<string, struct<p_best:double, coverage:double>>"
    x = raw.withColumn("_j", F.from_json("value", kind)).withColumn("_c", F.col("_j.suggested_cutpoints"))
    wide = F.array_max(F.transform(F.filter(F.map_values("_c"), lambda c: c["coverage"] >= 0.10), lambda c: c["p_best"]))
    assign = F.coalesce(F.try_element_at("_c", F.lit("error<=5%"))["p_best"], F.lit(base.policy[0]))
    new = F.lit(new_speaker) if new_speaker is not None else F.coalesce("_j.new_speaker", F.lit(0.60))
    return x.select(*[c for c in raw.columns if c != "value"], "_j.theta", "_j.temperature", assign.alias("assign"), F.coalesce(wide, F.lit(base.policy[1])).alias("learn"), new.alias("new_speaker"))


def translation_report(pairs: DataFrame, key: str, neural: Callable | None = None) -> DataFrame:
    """MET-09 to MET-11: one row: bleu, chrf, and the mean of an injected neural score (null without one). pairs: key,
    source, reference, hypothesis."""
    one = lambda df: df.withColumn("_one", F.lit(1))
    out = one(bleu(pairs, key)).join(one(chrf(pairs, key)), "_one")
    if neural is None:
        return out.select("bleu", "chrf", F.lit(None).cast("double").alias("neural"))
    scored = apply_model(pairs.select("source", "reference", "hypothesis"), "score double", neural).agg(F.avg("score").alias("neural"))
    return out.join(one(scored), "_one").select("bleu", "chrf", "neural")


def session_report(reference: DataFrame, hypothesis: DataFrame, key: str = "session", collar: float = 0.0) -> DataFrame:
    """MET-14: for each session wer (of all words by time), cpwer and der, with its counts. Segments with calibrating labels
    are left out of the hypothesis."""
    hyp = hypothesis.where(not_calibrating(F.col("speaker")))
    flat = lambda df, c: df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("start", "pos", F.trim("text").alias("t"))))["t"], " ").alias(c))
    words = word_errors(flat(reference, "reference").join(flat(hyp, "hypothesis"), key)).select(key, "n_words", "errors", "wer")
    pairs = speaker_permutation_errors(concat_by_speaker(reference, key), concat_by_speaker(hyp, key), key).select(key, "cpwer")
    return words.join(pairs, key, "left").join(diarization_errors(reference, hyp, key, collar).select(key, "der"), key, "left")


def fir(x: np.ndarray, low: float, high: float, rate: int, taps: int = 257) -> np.ndarray:
    """DSP-06: a windowed-sinc band-pass, as long as its input."""
    k = np.arange(taps) - (taps - 1) / 2
    sinc = lambda f: 2 * f / rate * np.sinc(2 * f / rate * k)
    return np.convolve(x, (sinc(high) - sinc(low)) * np.hamming(taps), "same")


@lru_cache(32)
def _kernels(source: int, target: int, zeros: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Steps p of the input for q samples of the output, and for each of these its first input and its weights: rates have a
    common measure, so there are only q different kernels."""
    g = gcd(source, target)
    p, q = source // g, target // g
    cut = min(1.0, target / source) * 0.95
    reach = int(np.ceil(zeros / cut))
    at = np.arange(q) * p
    first = at // q
    d = np.arange(-reach, reach + 1) - (at % q / q)[:, None]
    return p, q, first, cut * np.sinc(cut * d) * np.cos(np.clip(d / (reach + 1), -1, 1) * np.pi / 2) ** 2


def resample(x: np.ndarray, source: int, target: int, zeros: int = 16) -> np.ndarray:
    """DSP-05: by a windowed sinc of `zeros` crossings to a side, cut off at the lower rate's band; zeros lie beyond the
    ends."""
    if source == target or not len(x):
        return x
    p, q, first, kernels = _kernels(source, target, zeros)
    width = kernels.shape[1]
    n = int(np.ceil(len(x) * target / source))
    wide = np.pad(np.asarray(x, float), (width // 2, width + p))
    out = np.empty(n)
    for r in range(min(q, n)):
        many = -(-(n - r) // q)
        windows = np.lib.stride_tricks.sliding_window_view(wide, width)[first[r] : first[r] + p * (many - 1) + 1 : p]
        out[r::q] = windows @ kernels[r]
    return out


def resample_rows(rows: DataFrame, target: int) -> DataFrame:
    """DSP-05 over rows path, rate, samples (doubles)."""

    def run(batches):
        for p in batches:
            yield pd.DataFrame({"path": p["path"], "rate": target, "samples": [resample(np.asarray(s, float), int(r), target) for s, r in zip(p["samples"], p["rate"], strict=True)]})

    return rows.select("path", "rate", "samples").mapInPandas(run, "path string, rate int, samples array<double>")


def stale_basis(known: DataFrame, now: DataFrame) -> DataFrame:
    """VEC-07: whether the profiles (label) differ from those that a projection basis was made of."""
    a, b = known.select("label").distinct(), now.select("label").distinct()
    return a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), "label", "full_outer").agg(F.coalesce(F.bool_or(F.col("_a").isNull() | F.col("_b").isNull()), F.lit(False)).alias("stale"))
