"""What surrounds the injected models of a live session: recognition, attribution of words to speakers, and voice embeddings.

A model is a function without arguments that makes, once a task, the function from a batch to rows (see speech.apply_model);
the steps before and behind it are column expressions and joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import segments as seg
from . import speech
from .intervals import point_in_interval
from .islands import merge_words

WORD = "array<struct<start:double,end:double,word:string>>"
RECOGNISED = f"pos int, start double, end double, text string, compression_ratio double, no_speech_prob double, avg_logprob double, words {WORD}"


def recognise(chunks: DataFrame, model: Callable, key: list[str], final: bool = True, batch: int = 8) -> DataFrame:
    """UDF-01 and UDF-10: segments (key, pos, start, end, text, words) of chunks (key, trim_seconds and what the model needs).

    The model gets the chunks with `beam` (5 for final results, 1 for partial ones) and `with_words`, and gives key and
    RECOGNISED. Made-up lines go (FLT-01); what was transcribed before, the first trim_seconds, is cut off by words for
    final results (FLT-02) and by whole segments for partial ones (FLT-03)."""
    kinds = dict(chunks.dtypes)
    asked = chunks.withColumns({"beam": F.lit(5 if final else 1), "with_words": F.lit(final)})
    schema = ", ".join(f"{k} {kinds[k]}" for k in key) + ", " + RECOGNISED
    found = speech.apply_model(asked, schema, model, batch)
    good = found.where(~seg.is_hallucination(F.col("text"), F.col("compression_ratio"), F.col("no_speech_prob"), F.col("avg_logprob")))
    x = good.join(chunks.select(*key, F.coalesce("trim_seconds", F.lit(0.0)).alias("_trim")), key)
    if final:
        x = seg.trim_prefix(x, F.col("_trim"))
    else:
        x = x.where((F.col("_trim") <= 0) | (F.col("end") > F.col("_trim")))
    return x.select(*key, "pos", "start", "end", "text", "words")


def attribute(words: DataFrame, turns: DataFrame, mapping: DataFrame, key: str, countdown: Column | None = None, warm: Column | None = None) -> DataFrame:
    """UDF-02: segments (key, run, speaker, start, end, text) of words (key, pos, start, end, word) and a diariser's turns
    (key, pos, start, end, local): local labels become speakers by mapping (key, local, label; FLT-15), each word takes the
    turn about its middle or the nearest (JOI-01), and runs of one speaker become segments (WIN-09)."""
    named = seg.relabel(turns, mapping, [key], warm, countdown).select(key, "pos", "start", "end", "speaker")
    said = point_in_interval(words, named, key).withColumn("wordless", F.lit(False))
    return merge_words(said, key)


def voices(audio: DataFrame, model: Callable, key: list[str], rate: int = 16_000, cleaned: str | None = None, batch: int = 8) -> DataFrame:
    """UDF-03: key, embedding, seconds of each local speaker's audio (key, samples within [-1, 1], and, if named, the column of
    seconds of speech that are left after cleaning).

    Audio that is too short, too quiet or has too little speech has no embedding (FLT-10: null); the rest is raised to a
    common level (DSP-02, DSP-03) before the model, which gives key and embedding."""
    kinds = dict(audio.dtypes)
    level = speech.speech_level(F.col("samples"), rate // 50)
    x = audio.withColumn("_level", level).withColumn("_seconds", F.size("samples") / float(rate))
    good = seg.good_audio(F.col("_seconds"), F.col("_level"), F.col(cleaned) if cleaned else F.col("_seconds"))
    x = x.withColumn("_good", F.coalesce(good, F.lit(False)))
    asked = x.where("_good").withColumn("samples", speech.gain(F.col("samples"), F.col("_level"))).select(*key, "samples")
    made = speech.apply_model(asked, ", ".join(f"{k} {kinds[k]}" for k in key) + ", embedding array<double>", model, batch)
    return x.select(*key, F.col("_seconds").alias("seconds")).join(made, key, "left").select(*key, "embedding", "seconds")
