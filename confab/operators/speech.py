"""Speech regions and other signal operators on arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import let


def frames(audio: DataFrame, pcm: str, size: int, pad: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """SRC-04 and SRC-05: fixed frames of a sample array, with their index; an incomplete last one goes, or is filled with
    zeros."""

    def cut(x: Column) -> Column:
        count = F.ceil(F.size(x) / size) if pad else F.floor(F.size(x) / size)
        one = lambda i: F.slice(x, (i * size + 1).cast("int"), size)
        full = (lambda i: F.concat(one(i), F.array_repeat(F.lit(0).cast("smallint"), F.lit(size) - F.size(one(i))))) if pad else one
        return F.transform(F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>")), full)

    made = let(F.col(pcm), cut)
    return audio.select(*keep, F.posexplode(made).alias("frame", "samples"))


def to_float(samples: Column, channels: int = 1) -> Column:
    """DSP-01 and DSP-13: interleaved 16-bit samples to mono within [-1, 1)."""
    if channels == 1:
        return F.transform(samples, lambda x: x / 32768.0)

    def mixed(x: Column) -> Column:
        i = F.sequence(F.lit(0), (F.floor(F.size(x) / channels) - 1).cast("int"))
        total = lambda k: F.aggregate(F.slice(x, k * channels + 1, channels), F.lit(0.0), lambda acc, v: acc + v)
        return F.when(F.size(x) >= channels, F.transform(i, lambda k: total(k) / channels / 32768.0)).otherwise(F.array().cast("array<double>"))

    return let(samples, mixed)


def rms(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v) / F.size(x))).otherwise(F.lit(0.0))


def speech_level(x: Column, block: int) -> Column:
    """DSP-02: 95th percentile (between ranks by line) of the blocks' RMS; the RMS of all under three blocks."""

    def between(levels: Column) -> Column:
        at = (F.size(levels) - 1) * 0.95
        low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
        a, b = F.element_at(levels, low + 1), F.element_at(levels, high + 1)
        return a + (b - a) * (at - low)

    def level(a: Column) -> Column:
        n = F.floor(F.size(a) / block).cast("int")
        blocks = F.array_sort(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: rms(F.slice(a, i * block + 1, block))))
        return F.when(n >= 3, let(blocks, between)).otherwise(rms(a))

    return let(x, level)


def gain(x: Column, level: Column, target: float = 0.1, most: float = 10.0) -> Column:
    """DSP-03."""
    raised = lambda g: F.transform(x, lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v * g)))
    return let(level, lambda at: F.when(at > 0.001, let(F.least(F.lit(most), target / at), raised)).otherwise(x))


def regions(probabilities: list[float], window: int = 512, rate: int = 16000, enter: float = 0.5, hysteresis: float = 0.15, min_silence_ms: float = 100, min_speech_ms: float = 250, pad_ms: float = 30, n_samples: int | None = None) -> list[tuple[int, int]]:
    """DSP-08: speech regions in samples from one probability a window.

    A region opens at or above `enter` and closes once windows below enter - hysteresis have lasted for the silence
    time; regions must be longer than the speech time. Each is widened by the pad, and two whose pads would meet share
    the gap halfway."""
    per_ms = rate / 1000
    quiet, least, pad = min_silence_ms * per_ms, min_speech_ms * per_ms, int(pad_ms * per_ms)
    total = n_samples if n_samples is not None else len(probabilities) * window
    p = np.asarray(probabilities, float)
    found, begin, falling = [], None, None
    for i in np.flatnonzero((p >= enter) | (p < enter - hysteresis)):  # windows in the dead band change nothing
        at = int(i) * window
        if p[i] >= enter:
            falling = None
            begin = at if begin is None else begin
        elif begin is not None:
            falling = at if falling is None else falling
            # the silence so far, this window included only once the next one comes
            if at - falling >= quiet:
                found.append((begin, falling))
                begin = falling = None
    if begin is not None:
        found.append((begin, total))
    found = [list(x) for x in found if x[1] - x[0] > least]
    for k, r in enumerate(found):
        if k == 0:
            r[0] = max(0, r[0] - pad)
        if k + 1 < len(found):
            gap = found[k + 1][0] - r[1]
            share = gap // 2 if gap < 2 * pad else pad
            r[1] += share
            found[k + 1][0] -= share
        else:
            r[1] = min(total, r[1] + pad)
    return [tuple(x) for x in found]


def speech_regions(rows: DataFrame, key: str, **settings) -> DataFrame:
    """DSP-08 by key: rows key, window, prob to key, region, start, end (samples). A key's probabilities go to one call."""
    kind = dict(rows.dtypes)[key]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        found = regions(p.sort_values("window")["prob"].tolist(), **settings)
        return pd.DataFrame({key: [p[key].iloc[0]] * len(found), "region": range(len(found)), "start": [a for a, _ in found], "end": [b for _, b in found]})

    return rows.select(key, "window", "prob").groupBy(key).applyInPandas(run, f"{key} {kind}, region int, start bigint, end bigint")


def fallback_regions(rows: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """DSP-07: runs of windows above the threshold, by windows: key, first, last."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy("window")
    x = rows.where(F.col("prob") > threshold).withColumn("_r", F.col("window") - F.row_number().over(w))
    return x.groupBy(key, "_r").agg(F.min("window").alias("first"), F.max("window").alias("last")).drop("_r")


def delay_and_sum(channels: np.ndarray, rate: int, reference: int = 0, most_ms: float = 5.0) -> np.ndarray:
    """DSP-12: the mean of channels (rows), each shifted within most_ms to fit the reference in its loudest second."""
    n = channels.shape[1]
    size, most = min(rate, n), int(most_ms * rate / 1000)
    energy = np.convolve(channels[reference] ** 2, np.ones(size), "valid")
    at = int(energy.argmax()) if len(energy) else 0
    ref = channels[reference, at : at + size]
    out = np.zeros(n)
    for c in channels:
        wide = np.pad(c, most)[at : at + size + 2 * most]
        shift = int(np.correlate(wide, ref, "valid").argmax()) - most
        out += np.roll(c, -shift) if not shift else np.pad(c, most)[most + shift : most + shift + n]
    return out / len(channels)


def beamform(rows: DataFrame, key: str, rate: int) -> DataFrame:
    """DSP-12 by key: rows key, channel, samples."""
    kind = dict(rows.dtypes)[key]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("channel")
        n = max(map(len, p["samples"]))
        x = np.array([np.pad(np.asarray(s, float), (0, n - len(s))) for s in p["samples"]])
        return pd.DataFrame({key: [p[key].iloc[0]], "samples": [delay_and_sum(x, rate)]})

    return rows.groupBy(key).applyInPandas(run, f"{key} {kind}, samples array<double>")


class Resampler:
    """DSP-04: a low-pass (129-tap windowed sinc) and a fractional linear resampler that keep their state between calls."""

    def __init__(self, source: int, target: int, taps: int = 129):
        self.ratio = source / target
        cut = 0.5 * min(1.0, target / source) * 0.9
        k = np.arange(taps) - (taps - 1) / 2
        h = 2 * cut * np.sinc(2 * cut * k) * np.hamming(taps)
        self.filter = h / h.sum() if source > target else None
        self.tail = np.zeros(taps - 1)
        self.last, self.at = None, 0.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return x
        if self.filter is not None:
            wide = np.concatenate([self.tail, x])
            self.tail = wide[-len(self.tail) :]
            x = np.convolve(wide, self.filter, "valid")
        if self.last is not None:
            x = np.concatenate([[self.last], x])
        n = max(0, int(np.floor((len(x) - 1 - self.at) / self.ratio)) + 1)
        t = self.at + self.ratio * np.arange(n)
        out = np.interp(t, np.arange(len(x)), x)
        self.at = self.at + self.ratio * n - (len(x) - 1)
        self.last = x[-1]
        return out


def plane(centroids: np.ndarray, points: np.ndarray) -> np.ndarray | None:
    """VEC-05: two orthonormal directions of most variance, of the centroids if there are three, else of the points, else
    None. A single direction is completed by the axis least like it."""
    x = centroids if len(centroids) >= 3 else points if len(points) >= 3 else None
    if x is None:
        return None
    _, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    basis = [b for b, w in zip(v[:2], s[:2], strict=False) if w > 1e-9]
    while len(basis) < 2:
        e = np.eye(x.shape[1])[int(np.argmin(np.abs(np.sum(basis, 0)) if basis else np.zeros(x.shape[1])))]
        for b in basis:
            e = e - (e @ b) * b
        basis.append(e / np.linalg.norm(e))
    return np.array(basis)


def apply_model(rows: DataFrame, schema: str, model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], batch: int | None = None) -> DataFrame:
    """UDF-01 to UDF-10: an injected model over Arrow batches: model() is called once a task and gives the function that
    turns a batch into rows of the schema (recognition, diarisation, embedding, translation, neural voice activity). With
    batch, the function gets so many rows at once at most (UDF-08); tasks report progress as they end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = model()
        for p in batches:
            for k in range(0, len(p), batch or max(1, len(p))):
                yield f(p.iloc[k : k + (batch or len(p))].reset_index(drop=True))

    return rows.mapInPandas(run, schema)


def translate(rows: DataFrame, cache: DataFrame, model: Callable, text: str = "text") -> DataFrame:
    """UDF-04 to UDF-06: distinct misses are translated once and joined back; equal languages and empty texts are not
    asked for; what the model leaves empty stays out of the cache. cache: text, source, target, translation."""
    same = F.lower(F.split_part("source", F.lit("-"), F.lit(1))) == F.lower(F.split_part("target", F.lit("-"), F.lit(1)))
    keys = [text, "source", "target"]
    asked = rows.where(~same & (F.trim(text) != "")).select(*keys).distinct()
    new = apply_model(asked.join(cache, keys, "left_anti"), f"{text} string, source string, target string, translation string", model)
    known = cache.select(*keys, "translation").union(new.where("translation <> ''"))
    return rows.join(known, keys, "left").withColumn("translation", F.when(same, F.col(text)).when(F.trim(text) == "", F.lit("")).otherwise(F.col("translation")))
