"""Live streams: a source of audio frames, the tracker as a keyed processor, and sinks of events and upserts."""

from __future__ import annotations

import os
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators.tracking import SessionRun, Settings, Tracker, session_rows
from .upserts import latest

# STM-17, the types of events between the parts of a live session.
EVENT_TYPES = (
    "AudioFrameCaptured",
    "SpeechStateChanged",
    "ChunkReadyForSTT",
    "ChunkReadyForDiarization",
    "TranscriptSegmentCreated",
    "TranscriptSegmentFinalized",
    "TranslationUpdated",
    "SpeakerTurnsReady",
    "TranscriptSegmentRevised",
    "PipelineStatusChanged",
)
EVENT = "event_type string, data map<string,string>, timestamp double"


def typed_events(events: DataFrame) -> DataFrame:
    """STM-17: events of the known types; another type is an error."""
    known = F.col("event_type").isin(*EVENT_TYPES)
    return events.withColumn("event_type", F.when(known, F.col("event_type")).otherwise(F.raise_error(F.concat(F.lit("no such event type: "), F.coalesce("event_type", F.lit("null"))))))


# --- SRC-01 ---


class FrameReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.session = options["path"], options.get("session", "live")
        self.size = int(options.get("rate", 16_000)) * int(options.get("frame_ms", 30)) // 1000 * int(options.get("channels", 1))
        self.most = int(options.get("max_frames", 1000))

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def _frames(self, begin: int, end: int) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            f.seek(2 * self.size * begin)
            data = np.frombuffer(f.read(2 * self.size * (end - begin)), "<i2")
        # a list's iterator, as the engine copies it; a micro-batch has max_frames at most
        return iter([(self.session, begin + k, x.tolist()) for k, x in enumerate(data[: len(data) // self.size * self.size].reshape(-1, self.size))])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        there = os.path.getsize(self.path) // (2 * self.size) if os.path.exists(self.path) else 0
        end = max(start["frame"], min(there, start["frame"] + self.most))
        return self._frames(start["frame"], end), {"frame": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._frames(start["frame"], end["frame"])

    def commit(self, end: dict) -> None:
        pass


class FrameSource(DataSource):
    """SRC-01: whole frames of a growing file of raw 16-bit samples (a device's or a pipe's recording), as session, frame,
    samples. Options: path, session, rate, frame_ms, channels, max_frames (of a micro-batch).

    A microphone is one device of one machine, so one simple reader serves it; the file stays readable, so frames can be
    read again after a failure. An incomplete last frame waits."""

    @classmethod
    def name(cls) -> str:
        return "pcm_frames"

    def schema(self) -> str:
        return "session string, frame bigint, samples array<smallint>"

    def simpleStreamReader(self, schema: StructType) -> FrameReader:
        return FrameReader(self.options)


def read_frames(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    spark.dataSource.register(FrameSource)
    return spark.readStream.format("pcm_frames").options(path=path, **{k: str(v) for k, v in options.items()}).load()


# --- STM-12, STM-13, WIN-15 ---

DECISIONS = "session string, chunk bigint, local string, assigned string, decision string, best_score double"


class TrackProcessor(StatefulProcessor):
    """Keeps a session's tracker (its candidates age by chunks, its reference score is an exponential average) and its open
    chunk. The last row of a session carries `last`. Rows of a micro-batch are put in order; chunks arrive in order."""

    def __init__(self, settings: Settings, tracker: Callable[[Settings], Tracker] = Tracker):
        self.settings, self.tracker = settings, tracker

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", "data binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        s = pickle.loads(self.state.get()[0]) if self.state.exists() else SessionRun(self.tracker(self.settings))
        p = pd.concat(list(rows))
        found = [x for row in session_rows(p) for x in s.feed((row[0], row[1], None if row[2] is None else np.asarray(row[2], float), *row[3:]))]
        if p["last"].any():
            found += s.end()
            self.state.clear()
        else:
            self.state.update((pickle.dumps(s),))
        out = pd.DataFrame(found, columns=["chunk", "local", "assigned", "decision", "best_score"])
        out.insert(0, "session", str(key[0]))
        yield out

    def close(self) -> None:
        pass


def track_stream(rows: DataFrame, settings: Settings = Settings(), tracker: Callable[[Settings], Tracker] = Tracker) -> DataFrame:
    """STM-12: decisions of a stream of session, chunk, local, embedding, seconds, chunk_ms, last, in append mode. The rows
    of a warm-up come late, with their final labels (STM-10)."""
    return rows.groupBy("session").transformWithStateInPandas(statefulProcessor=TrackProcessor(settings, tracker), outputStructType=DECISIONS, outputMode="Append", timeMode="None")


# --- SNK-01, STM-10, STM-11 ---


def upsert_sink(path: str) -> Callable[[DataFrame, int], None]:
    """STM-10 and STM-11: a foreachBatch function that keeps each micro-batch's rows under its number, as `revision`.
    A batch that runs again replaces what it wrote, so each change counts once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("revision", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return put


def read_upserts(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """What an upsert sink holds now: of each key the rows of its last revision."""
    return latest(spark.read.parquet(path).drop("batch"), by, "revision")


def event_sink(events: DataFrame, path: str, checkpoint: str, callback: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """SNK-01: a running query that writes a stream of typed events once each, by micro-batch, and hands each batch to a
    callback (with its number, which repeats if a batch runs again)."""
    put = upsert_sink(path)

    def both(batch: DataFrame, number: int) -> None:
        put(batch, number)
        if callback is not None:
            callback(batch, number)

    return typed_events(events).writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).start()
