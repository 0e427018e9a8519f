"""Sources: interval files, transcripts, parallel text, audio and traces."""

from __future__ import annotations

import io
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.num import parse_time_json
from ..functions.text import clean_tagged
from ..session import batches_by_size, pieces

MEETINGS = "meeting_id string, audio_path string, sampling_rate int, num_channels int, duration_sec double, num_speakers int"


def intervals(lines: DataFrame, drop_empty: bool = True) -> DataFrame:
    """SRC-06 to SRC-08 over a column `value` of RTTM lines: meeting, start, end, speaker; at least eight fields, SPEAKER
    lines; with drop_empty only durations above 0."""
    p = F.split(F.trim(F.col("value")), r"\s+")
    at = lambda k: F.element_at(p, k)
    x = lines.where((F.size(p) >= 8) & (at(1) == "SPEAKER"))
    x = x.select(at(2).alias("meeting"), at(4).cast("double").alias("start"), at(5).cast("double").alias("dur"), at(8).alias("speaker"))
    return (x.where("dur > 0") if drop_empty else x).select("meeting", "start", (F.col("start") + F.col("dur")).alias("end"), "speaker")


def read_rttm(spark: SparkSession, path: str, drop_empty: bool = True) -> DataFrame:
    return intervals(spark.read.text(path), drop_empty)


def meetings(raw: DataFrame) -> DataFrame:
    """SRC-09 over a column `value` of JSON arrays (or single objects): one row a meeting."""
    made = F.from_json(F.when(F.ltrim(F.col("value")).startswith("{"), F.concat(F.lit("["), F.col("value"), F.lit("]"))).otherwise(F.col("value")), f"array<struct<{MEETINGS.replace(' ', ':').replace(',:', ',')}>>")
    return raw.select(F.explode(made).alias("m")).select("m.*")


def read_meetings(spark: SparkSession, path: str) -> DataFrame:
    return meetings(spark.read.text(path, wholetext=True))


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """path, value: files as they are."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def speaker_transcripts(raw: DataFrame, key: str = "path") -> DataFrame:
    """SRC-10 over key, value: key, speaker, text; the flat text has a null speaker."""
    x = raw.select(key, F.from_json("value", "speakers map<string,string>, flat string").alias("j")).select(key, "j.*")
    return x.select(key, F.explode("speakers").alias("speaker", "text")).union(x.where("flat is not null").select(key, F.lit(None).cast("string"), "flat"))


def read_speaker_transcript(spark: SparkSession, path: str) -> DataFrame:
    return speaker_transcripts(_whole(spark, path))


def json_segments(raw: DataFrame, key: str = "path") -> DataFrame:
    """SRC-11 over key, value: key, pos, speaker, start, end, text of JSON arrays, in order."""
    x = raw.select(key, F.from_json("value", "array<struct<speaker:string,start:double,end:double,text:string>>").alias("s"))
    return x.select(key, F.posexplode("s").alias("pos", "s")).select(key, "pos", "s.*")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return json_segments(_whole(spark, path))


def timed_transcripts(raw: DataFrame, key: str = "path") -> DataFrame:
    """SRC-12 over key, value: key, pos, speaker, start, end, text of JSON arrays whose times are numbers, clock texts or
    objects by device; rows without times or text go; pos orders by start, stable."""
    kind = "array<struct<start_time:string,end_time:string,words:string,text:string,speaker:string>>"
    x = raw.select(key, F.from_json("value", kind).alias("s")).select(key, F.posexplode("s").alias("i", "s"))
    text = clean_tagged(F.coalesce(F.nullif("s.words", F.lit("")), F.col("s.text"), F.lit("")))
    y = x.select(key, "i", F.coalesce(F.nullif("s.speaker", F.lit("")), F.lit("Unknown")).alias("speaker"), parse_time_json(F.col("s.start_time")).alias("start"), parse_time_json(F.col("s.end_time")).alias("end"), text.alias("text"))
    n = F.row_number().over(W.partitionBy(key).orderBy("start", "i"))
    return y.where("start is not null and end is not null and text <> ''").withColumn("pos", n).drop("i")


def read_timed_transcript(spark: SparkSession, path: str) -> DataFrame:
    return timed_transcripts(_whole(spark, path))


def utterances(lines: DataFrame) -> DataFrame:
    """SRC-13 over `value` and `line_no`: id and text; lines without a text go, the last of equal ids stays."""
    p = F.split(F.trim(F.col("value")), " ", 2)
    x = lines.where(F.size(p) == 2).select(F.element_at(p, 1).alias("id"), F.element_at(p, 2).alias("text"), "line_no")
    return x.groupBy("id").agg(F.max_by("text", "line_no").alias("text"))


def lines_of(raw: DataFrame, key: str = "path") -> DataFrame:
    """key, pos (from 0), value: the lines of key, value texts in order."""
    x = raw.select(key, F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n").alias("l"))
    return x.select(key, F.posexplode("l").alias("pos", "value"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return lines_of(_whole(spark, path))


def read_utterances(spark: SparkSession, path: str) -> DataFrame:
    x = read_lines(spark, path)
    return utterances(x.withColumn("line_no", F.struct("path", "pos")))


def corpus_samples(listing: DataFrame, transcripts: DataFrame, low: float, high: float, limit: int | None = None) -> DataFrame:
    """SRC-14 and SRT-05: audio files (id, path, duration) with a transcript and a duration within [low, high], by path."""
    x = listing.join(transcripts, "id").where(F.col("duration").between(low, high)).orderBy("path")
    return x if limit is None else x.limit(limit)


def read_parallel(spark: SparkSession, source: str, reference: str, limit: int | None = None) -> DataFrame:
    """SRC-15 and JOI-06: line i of one file with line i of the other, to the shorter."""
    a = read_lines(spark, source).select("pos", F.col("value").alias("source"))
    x = a.join(read_lines(spark, reference).select("pos", F.col("value").alias("reference")), "pos")
    return x if limit is None else x.where(F.col("pos") < limit)


def resolve_paths(wanted: DataFrame, listing: DataFrame, roots: list[str]) -> DataFrame:
    """SRC-19: for each raw path the first that exists: itself, below each root, rebased behind its `datasets` component,
    or the least path of the same file name. wanted: raw; listing: path."""
    tail = F.regexp_extract("raw", r"(?:^|/)datasets/(.*)$", 1)
    tries = [F.col("raw"), *[F.concat(F.lit(r.rstrip("/") + "/"), F.col("raw")) for r in roots], *[F.when(tail != "", F.concat(F.lit(r.rstrip("/") + "/"), tail)) for r in roots]]
    x = wanted.select("raw", F.posexplode(F.array(*tries)).alias("rank", "path")).join(listing, "path", "left_semi")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    named = wanted.withColumn("_n", F.regexp_extract("raw", r"([^/]+)$", 1)).join(listing.withColumn("_n", name), "_n").select("raw", F.lit(len(tries)).alias("rank"), "path")
    best = x.unionByName(named).groupBy("raw").agg(F.min(F.struct("rank", "path")).alias("b"))
    return wanted.join(best, "raw", "left").select("raw", "b.path")


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """SRC-20: path, length, modificationTime of files; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).drop("content")


def select_audio(listing: DataFrame, session: str, mode: str = "far", array: str = "U01", enhance: str = "none", speaker: str | None = None) -> DataFrame:
    """SRC-20: path and place (from 1) of the files of a session to read, of a listing (path); no rows if there are none.

    worn: the speaker's own file, or all worn files in text order. far: of each array (a list by commas, or `all` that
    the listing has) the channels 1 to 4 for `average` and `beamform`, the first array's lowest channel for `none`. gss:
    files below a folder `gss`, else the first enhanced file of the arrays or the session, else as for beamform."""
    if mode not in ("worn", "far") or enhance not in ("none", "average", "beamform", "gss"):
        raise ValueError("mode is worn or far; enhance is none, average, beamform or gss")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    files = listing.select("path", name.alias("name")).where(F.col("name").startswith(f"{session}_") | F.col("path").rlike("(^|/)gss/"))
    if mode == "worn":
        own = files.where(F.col("name") == f"{session}_{speaker}.wav") if speaker else files.where(F.col("name").rlike(f"^{session}_P.*\\.wav$"))
        return _placed(own, ["path"], 1 if speaker else None)
    at = F.regexp_extract("name", f"^{session}_(U\\d\\d)\\.CH([1-4])\\.wav$", 1)
    channel = F.regexp_extract("name", f"^{session}_(U\\d\\d)\\.CH([1-4])\\.wav$", 2)
    wanted = [x.strip() for x in array.split(",") if x.strip()]
    # where every array is wanted and none has a first channel, the first array is meant
    x = files.withColumns({"at": at, "channel": channel})
    if array == "all":
        having = x.where("channel = '1'").select("at").distinct()
        x = x.join(having, "at", "left_semi")
        order = F.col("at")
    else:
        x = x.where(F.col("at").isin(*wanted))
        order = F.array_position(F.array(*[F.lit(w) for w in wanted]), F.col("at"))
    channels = x.where("channel <> ''").withColumn("order", order)
    if enhance == "none":
        first = channels.withColumn("first", F.min("order").over(W.partitionBy())).where(F.col("order") == F.col("first"))
        return _placed(first, ["channel", "path"], 1)
    both = channels.select("path", F.lit(9).alias("rank"), F.col("order").cast("string").alias("order"), "channel")
    if enhance == "gss":
        folder = files.where(F.col("path").rlike("(^|/)gss/")).select("path", F.lit(0).alias("rank"), F.lit("").alias("order"), F.lit("").alias("channel"))
        exact = [n for w in (wanted if array != "all" else ["U01"]) for n in (f"{session}_{w}.GSS.wav", f"{session}_{w}_GSS.wav", f"{session}_GSS.wav")]
        place = F.array_position(F.array(*[F.lit(n) for n in exact]), F.col("name"))
        named = files.where(place > 0).select("path", F.lit(1).alias("rank"), F.lpad(place.cast("string"), 6, "0").alias("order"), F.lit("").alias("channel"))
        alike = files.where(F.col("name").rlike("GSS.*\\.wav$")).select("path", F.lit(2).alias("rank"), F.col("path").alias("order"), F.lit("").alias("channel"))
        both = both.union(folder).union(named).union(alike)
    best = both.withColumn("_r", F.min("rank").over(W.partitionBy())).where("rank = _r")
    # one enhanced file stands for all
    placed = _placed(best, ["order", "channel", "path"], None, ["rank"])
    return placed.where("rank not in (1, 2) or place = 1").drop("rank")


def _placed(files: DataFrame, order: list[str], limit: int | None, keep: list[str] | None = None) -> DataFrame:
    """path and place; the files of one session are few, so their order is that of one task."""
    x = files.withColumn("place", F.row_number().over(W.partitionBy().orderBy(*order))).select("path", "place", *(keep or []))
    return x if limit is None else x.where(F.col("place") <= limit)


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples (frames x channels, 16-bit) of a PCM WAV file."""
    at, rate, channels = 12, 0, 1
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if kind not in (1, 0xFFFE) or bits != 16:
                raise ValueError("only 16-bit PCM")
        elif name == b"data":
            n = len(body) // (2 * channels)
            return rate, np.frombuffer(body[: 2 * channels * n], "<i2").reshape(n, channels)
        at += 8 + size + size % 2
    raise ValueError("no data")


def encode_wav(rate: int, samples: np.ndarray) -> bytes:
    """SNK-02: a 16-bit PCM WAV file."""
    x = samples.reshape(len(samples), -1).astype("<i2")
    c, out = x.shape[1], io.BytesIO()
    out.write(b"RIFF" + struct.pack("<I", 36 + x.nbytes) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, c, rate, rate * 2 * c, 2 * c, 16) + b"data" + struct.pack("<I", x.nbytes))
    return out.getvalue() + x.tobytes()


def wav_samples(files: DataFrame, channel: int | None = 0, start: float = 0.0, end: float | None = None) -> DataFrame:
    """SRC-03 and SRC-21 over path, content: path, rate, samples (16-bit) of each file: one channel, or their mean if
    channel is None, within [start, end) seconds, clipped to the file."""

    def rows(batches):
        for p in batches:
            for name, data in zip(p["path"], p["content"], strict=True):
                rate, x = decode_wav(data)
                x = x[max(0, int(start * rate)) : None if end is None else max(0, int(end * rate))]
                y = x[:, channel] if channel is not None else np.trunc(x.mean(1)).astype("<i2") if len(x) else x[:, 0]
                yield name, rate, y.astype(np.int16)

    def run(batches):
        return pieces(rows(batches), ["path", "rate", "samples"], lambda r: r[2].nbytes)

    batches_by_size(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, "path string, rate int, samples array<smallint>")


def read_wav(spark: SparkSession, path: str, channel: int | None = 0, start: float = 0.0, end: float | None = None) -> DataFrame:
    return wav_samples(spark.read.format("binaryFile").load(path), channel, start, end)


def combine_channels(rows: DataFrame, key: str, enhance: str = "average") -> DataFrame:
    """SRC-21: key, samples: the channels (key, channel, samples) of each key as one: cut or beyond a file's end they may
    differ in length, so shorter ones are filled with zeros; `average` cuts the mean to whole numbers, `beamform` adds them
    in step (at 16 kHz). Empty channels don't count."""
    some = rows.where(F.size("samples") > 0)
    if enhance == "beamform":
        from ..operators.speech import beamform

        return beamform(some, key, 16_000)
    all_ = some.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("channel", "samples")))["samples"].alias("c"))
    longest = F.array_max(F.transform("c", F.size))
    mean = lambda i: (F.aggregate("c", F.lit(0.0), lambda acc, x: acc + F.coalesce(F.try_element_at(x, (i + 1).cast("int")), F.lit(0))) / F.size("c")).cast("smallint")
    return all_.select(key, F.transform(F.sequence(F.lit(0), longest - 1), mean).alias("samples"))


def trace_probes(frames: DataFrame, vectors: DataFrame) -> DataFrame:
    """SRC-16 and VEC-09: probes of a trace with their vectors in place of references. frames: time, probes array of
    struct<local, i, ...>; vectors: i, vector."""
    x = frames.select("time", F.posexplode("probes").alias("pos", "p")).select("time", "pos", "p.*")
    return x.join(vectors, "i", "left")


class Catalog:
    """SRC-22: names of datasets, whatever their case; KeyError for others."""

    def __init__(self):
        self._made: dict[str, object] = {}

    def register(self, name: str, make) -> None:
        self._made[name.lower()] = make

    def get(self, name: str):
        return self._made[name.lower()]
