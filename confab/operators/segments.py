"""Filters and projections of transcript segments (session, pos, speaker, start, end, text; words where there are any)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import HALLUCINATIONS, speaker_index

# Fixed values of the speaker column that stand for no speaker.
PSEUDO = ("Unknown", "CALIBRATING")
PSEUDO_PREFIX = "[Calibrating"


def is_pseudo(speaker: Column) -> Column:
    """FLT-04: missing, empty, unknown or calibrating."""
    return F.coalesce(speaker.isin(*PSEUDO) | (speaker == "") | speaker.startswith(PSEUDO_PREFIX), F.lit(True))


def duration(start: Column, end: Column) -> Column:
    """FLT-05."""
    zero = F.lit(0).cast("double")
    return F.greatest(zero, F.coalesce(end, zero) - F.coalesce(start, zero))


def normalize_label(speaker: Column) -> Column:
    """FLT-06: a countdown label becomes CALIBRATING."""
    return F.when(speaker.startswith(PSEUDO_PREFIX), F.lit("CALIBRATING")).otherwise(speaker)


def not_calibrating(speaker: Column) -> Column:
    """FLT-07: by the mixed-case word only, so CALIBRATING stays."""
    return ~F.coalesce(speaker.contains("Calibrating"), F.lit(False))


def is_hallucination(text: Column, compression: Column, no_speech: Column, logprob: Column) -> Column:
    """FLT-01: missing scores count as 0."""
    t, zero = F.trim(F.coalesce(text, F.lit(""))), F.lit(0.0)
    c, n, p = (F.coalesce(x, zero) for x in (compression, no_speech, logprob))
    return (t == "") | (c > 2.4) | ((n > 0.6) & (p < -1.0)) | (F.lower(t).isin(*HALLUCINATIONS) & ((n > 0.3) | (p < -0.5)))


def trim_prefix(segments: DataFrame, trim: Column | float, words: str = "words") -> DataFrame:
    """FLT-02: words with their middle before trim go and the rest make the segment anew; a segment without words stays
    if it ends after trim; empty ones go. Nothing changes where trim is 0 or less."""
    trim = trim if isinstance(trim, Column) else F.lit(float(trim))
    has = (F.coalesce(F.size(words), F.lit(0)) > 0) & (trim > 0)
    x = segments.withColumn("_trim_at", trim).withColumn("_has", has)
    x = x.withColumn("_kept", F.when(F.col("_has"), F.filter(words, lambda w: (w["start"] + w["end"]) / 2 >= F.col("_trim_at"))))
    x = x.where(F.when(F.col("_has"), F.size("_kept") > 0).otherwise((F.col("_trim_at") <= 0) | (F.col("end") > F.col("_trim_at"))))
    first, last = F.try_element_at("_kept", F.lit(1)), F.try_element_at("_kept", F.lit(-1))
    text = F.trim(F.array_join(F.transform("_kept", lambda w: w["word"]), ""))
    new = {words: F.when(F.col("_has"), F.col("_kept")).otherwise(F.col(words)), "start": F.when(F.col("_has"), first["start"]).otherwise(F.col("start")), "end": F.when(F.col("_has"), last["end"]).otherwise(F.col("end")), "text": F.when(F.col("_has"), text).otherwise(F.col("text"))}
    return x.withColumns(new).where(~F.col("_has") | (F.col("text") != "")).drop("_has", "_kept", "_trim_at")


def drop_before(segments: DataFrame, trim: float) -> DataFrame:
    """FLT-03: of partial results, segments that end by trim go."""
    return segments.where(F.col("end") > trim)


def truncate(intervals: DataFrame, limit: Column | float) -> DataFrame:
    """FLT-08: starts at the limit or later go, ends are cut there, empty ones go."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    return intervals.where(F.col("start") < limit).withColumn("end", F.least("end", limit)).where("end > start")


def clip(intervals: DataFrame, low: Column | float, high: Column | float) -> DataFrame:
    """FLT-09 and FLT-17: what lies within [low, high] of each, empty ones out."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return intervals.withColumn("start", F.greatest("start", low)).withColumn("end", F.least("end", high)).where("end > start")


def good_audio(seconds: Column, rms: Column, cleaned: Column) -> Column:
    """FLT-10."""
    return (seconds >= 0.35) & (rms >= 0.01) & (cleaned >= 0.35)


def merge_chunk(segments: DataFrame, key: list[str]) -> DataFrame:
    """FLT-11: one row a chunk: texts joined by a blank in order, first start, last end, first speaker."""
    order = F.array_sort(F.collect_list(F.struct("pos", F.trim("text").alias("t"))))
    one = segments.groupBy(*key).agg(F.min_by("speaker", "pos").alias("speaker"), F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"), order.alias("o"))
    return one.withColumn("text", F.array_join(F.filter(F.col("o.t"), lambda t: t != ""), " ")).drop("o")


def usable_supervisions(rows: DataFrame, length: Column) -> DataFrame:
    """FLT-12: starts before the recording's end, cut there, at least 0.1 s, with text."""
    x = rows.where((F.col("start") < length) & (F.trim("text") != "")).withColumn("end", F.least("end", length))
    return x.where(F.col("end") - F.col("start") >= 0.1)


def only(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """FLT-13."""
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def to_absolute(rows: DataFrame, offset: str) -> DataFrame:
    """FLT-14."""
    return rows.withColumns({"start": F.col("start") + F.col(offset), "end": F.col("end") + F.col(offset)})


def relabel(turns: DataFrame, mapping: DataFrame, key: list[str], warm: Column | None = None, countdown: Column | None = None) -> DataFrame:
    """FLT-15: the mapped label, else Unknown; while warm holds, the countdown label."""
    x = turns.join(mapping.withColumnRenamed("label", "_label"), [*key, "local"], "left")
    found = F.coalesce("_label", F.lit("Unknown"))
    return x.withColumn("speaker", found if warm is None else F.when(warm, countdown).otherwise(found)).drop("_label")


def real_speakers(segments: DataFrame, session: str = "session") -> DataFrame:
    """FLT-16 and SET-01."""
    return segments.groupBy(session).agg(F.count_distinct(F.when(~is_pseudo(F.col("speaker")), F.col("speaker"))).alias("n_speakers"))


def qualify_speaker(path: Column, speaker: Column) -> Column:
    """FLT-18: P<digits> of the file name before the label."""
    return F.concat_ws("_", F.nullif(F.regexp_extract(path, r"(P\d+)", 1), F.lit("")), speaker)


def summary(segments: DataFrame, session: str = "session") -> DataFrame:
    """AGG-02: seconds by speaker, pseudo ones too."""
    return segments.groupBy(session, "speaker").agg(F.sum(duration(F.col("start"), F.col("end"))).alias("seconds"), F.count("*").alias("n_segments"))


def log_summary(segments: DataFrame, last: int = 200, session: str = "session") -> DataFrame:
    """AGG-03 and WIN-16: seconds of nameable speakers over the last segments of each session."""
    n = F.row_number().over(W.partitionBy(session).orderBy(F.desc("pos")))
    return summary(segments.withColumn("_n", n).where(f"_n <= {last}").where(speaker_index(F.col("speaker")).isNotNull()), session)


def continuation(segments: DataFrame, last: int = 300, session: str = "session") -> DataFrame:
    """WIN-12: the last lines of a session, each with whether its speaker is that of the line before."""
    back = W.partitionBy(session).orderBy(F.desc("pos"))
    tail = segments.withColumn("_n", F.row_number().over(back)).where(f"_n <= {last}")
    before = F.lag("speaker").over(W.partitionBy(session).orderBy("pos"))
    return tail.withColumn("continues", F.coalesce(before == F.col("speaker"), F.lit(False))).drop("_n")


def concat_by_speaker(segments: DataFrame, session: str = "session") -> DataFrame:
    """AGG-06: each speaker's texts by start, then place, joined by a blank; blank texts out."""
    t = segments.where(F.trim("text") != "")
    parts = F.array_sort(F.collect_list(F.struct("start", "pos", F.trim("text").alias("t"))))
    return t.groupBy(session, "speaker").agg(F.array_join(parts["t"], " ").alias("text"))


def smallest_first(segments: DataFrame, session: str = "session") -> DataFrame:
    """SRT-01: by start, stable."""
    return segments.orderBy(session, "start", "pos")


def append_chunks(*parts: DataFrame) -> DataFrame:
    """SET-05: the segments of all chunks as one, columns by name (missing ones null), with pos anew by start over each
    session."""
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p, allowMissingColumns=True)
    return x.withColumn("pos", F.row_number().over(W.partitionBy("session").orderBy("start", "chunk", "pos")))


def label_order(labels: DataFrame, label: str = "label") -> DataFrame:
    """SRT-07: labels in text order, in which SPEAKER_100 comes before SPEAKER_11; profiles merge in this order."""
    return labels.orderBy(label)
