"""Sinks: interval files, transcripts, traces and reports."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import format_result_line
from ..session import durable
from .readers import encode_wav


def rttm_lines(segments: DataFrame, drop_empty: bool = True) -> DataFrame:
    """SNK-03 and SNK-04: meeting, value in order of start. Rows: meeting, start, end, speaker."""
    dur = F.col("end") - F.col("start")
    x = segments.where(dur > 0) if drop_empty else segments
    three = lambda c: F.replace(F.call_function("format_number", c, F.lit("0.000")), F.lit(","), F.lit(""))
    line = F.concat(F.lit("SPEAKER "), F.col("meeting"), F.lit(" 1 "), three(F.col("start")), F.lit(" "), three(dur), F.lit(" <NA> <NA> "), F.col("speaker"), F.lit(" <NA> <NA>"))
    return x.select("meeting", "start", line.alias("value")).sortWithinPartitions("meeting", "start")


def write_rttm(segments: DataFrame, path: str, drop_empty: bool = True) -> None:
    """One folder for each meeting, its lines in order of start in one file."""
    rttm_lines(segments, drop_empty).repartition("meeting").sortWithinPartitions("meeting", "start").select("meeting", "value").write.partitionBy("meeting").text(path)


def speaker_transcripts(texts: DataFrame, flat: DataFrame, key: str) -> DataFrame:
    """SNK-05: key, value: JSON with the speakers' texts and the flat text."""
    m = texts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker", "text")))).alias("speakers"))
    return m.join(flat.select(key, F.col("text").alias("flat")), key).select(key, F.to_json(F.struct("speakers", "flat")).alias("value"))


def raw_segments(segments: DataFrame, key: str) -> DataFrame:
    """SNK-06: key, value: JSON array in order, times with three decimals."""
    one = F.struct("pos", "speaker", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text")
    return segments.groupBy(key).agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda s: F.struct(s["speaker"].alias("speaker"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))).alias("value"))


def transcript_lines(segments: DataFrame, key: str) -> DataFrame:
    """SNK-13: key, text: formatted lines in order, joined by line feeds."""
    line = format_result_line(F.col("speaker"), F.col("start"), F.col("end"), F.col("text"))
    return segments.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", line.alias("l"))))["l"], "\n").alias("text"))


def session_wavs(frames: DataFrame, rate: int, key: str = "session") -> DataFrame:
    """SNK-02: key, n_samples, content of a WAV file of each session's frames (key, frame, samples) in order. A session's
    recording is one value, as its file is."""
    kind = dict(frames.dtypes)[key]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("frame")
        x = np.concatenate([np.asarray(s, np.int16) for s in p["samples"]])
        return pd.DataFrame({key: [p[key].iloc[0]], "n_samples": [len(x)], "content": [encode_wav(rate, x)]})

    return frames.select(key, "frame", "samples").groupBy(key).applyInPandas(run, f"{key} {kind}, n_samples bigint, content binary")


def write_wavs(frames: DataFrame, folder: str, rate: int, key: str = "session", enabled: bool = True) -> DataFrame | None:
    """SNK-02: writes each session's recording to `folder` (a URI that all workers reach) as <session>.wav and gives key,
    path, n_samples; nothing is recorded unless enabled. A file is written under another name and then renamed."""
    if not enabled:
        return None
    made = session_wavs(frames, rate, key)
    kind = dict(frames.dtypes)[key]

    def run(batches):
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        for p in batches:
            names = []
            for k, content in zip(p[key], p["content"], strict=True):
                part = f"{path}/.{k}-{uuid.uuid4().hex}"
                with where.open_output_stream(part) as out:
                    out.write(content)
                where.move(part, f"{path}/{k}.wav")
                names.append(f"{folder.rstrip('/')}/{k}.wav")
            yield pd.DataFrame({key: p[key], "path": names, "n_samples": p["n_samples"]})

    return durable(made.mapInPandas(run, f"{key} {kind}, path string, n_samples bigint"))


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """SNK-09 and SNK-10."""
    rows.select(*columns).write.option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """SNK-07 and SNK-12."""
    rows.write.json(path)


def trace_frames(probes: DataFrame) -> DataFrame:
    """SNK-08: frames (session, time, warming_up, probes) that a trace keeps: none without probes, and of the warm-up the
    first."""
    w = W.partitionBy("session", "warming_up").orderBy("time")
    return probes.where(F.size("probes") > 0).withColumn("_n", F.row_number().over(w)).where("not warming_up or _n = 1").drop("_n")


def write_trace(probes: DataFrame, path: str) -> None:
    """SNK-08: Parquet with nested vectors; its dictionaries pool repeated values."""
    trace_frames(probes).write.option("compression", "zstd").parquet(path)


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """SNK-09 and SNK-10 as lines: value."""
    return rows.select(F.to_csv(F.struct(*columns)).alias("value"))


def json_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """SNK-07 and SNK-12 as lines: value."""
    return rows.select(F.to_json(F.struct(*columns)).alias("value"))


def markdown(rows: DataFrame, columns: list[str], limit: int = 1000) -> str:
    """SNK-11: a table of a small result; more than `limit` rows are an error."""
    found = rows.select(*columns).take(limit + 1)
    if len(found) > limit:
        raise ValueError(f"a report of over {limit} rows")
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join("-" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in found])
