"""Speech chunking: sessions whose gap depends on their length, with a cap, a pre-roll and an overlap.

STM-01 to STM-04. The clock is the frame counter of a session. The core holds counts and not audio: a chunk is a range of
frames, from which the audio is sliced (see speech.frames); so state stays small for any chunk length."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "session string, chunk int, type string, start_frame bigint, n_frames int, trim_frames int, reason string"


@dataclass(frozen=True)
class Settings:
    frame_ms: int = 30
    silence_limit: int = 30
    short_silence_limit: int = 15
    soft_ms: int = 5_000
    max_ms: int = 10_000
    preroll_ms: int = 240
    overlap_ms: int = 480
    partial_window_ms: int = 4_000
    partials: bool = False

    @property
    def preroll(self) -> int:
        return self.preroll_ms // self.frame_ms

    @property
    def overlap(self) -> int:
        return self.overlap_ms // self.frame_ms


#: STM-02: the offline chunker has neither pre-roll nor overlap.
OFFLINE = Settings(preroll_ms=0, overlap_ms=0)


class Chunker:
    """State of one session; feed() takes frames in order and gives the chunks that they close."""

    def __init__(self, settings: Settings = Settings()):
        self.s = settings
        self.frame = 0  # the next frame's index
        self.quiet_before = 0  # frames that can lead a chunk in
        self.start: int | None = None
        self.size = self.silence = self.trim = self.made = 0

    def feed(self, speech: bool) -> list[tuple[int, str, int, int, int, str]]:
        """(chunk, type, start frame, frames, frames already transcribed, reason)."""
        s, at = self.s, self.frame
        self.frame += 1
        if self.start is None:
            if not speech:
                self.quiet_before = min(self.quiet_before + 1, s.preroll)
                return []
            self.start, self.size, self.silence = at - self.quiet_before, self.quiet_before, 0
            self.quiet_before = 0
        self.size += 1
        self.silence = 0 if speech else self.silence + 1
        out = []
        if s.partials and self.size % (10 if self.size <= 100 else 20) == 0:
            window = s.partial_window_ms // s.frame_ms
            n = min(self.size, window)
            out.append((self.made, "partial", at + 1 - n, n, self.trim if self.size <= window else 0, "cadence"))
        ms = self.size * s.frame_ms
        if self.silence > (s.short_silence_limit if ms > s.soft_ms else s.silence_limit):
            out.append(self._close("silence"))
        elif ms >= s.max_ms:
            out.append(self._close("max"))
            if s.overlap:
                carry = min(s.overlap, self.size)
                self.start, self.size, self.silence, self.trim = at + 1 - carry, carry, 0, carry
                return out
        else:
            return out
        self.start, self.size, self.silence, self.trim = None, 0, 0, 0
        return out

    def _close(self, reason: str) -> tuple[int, str, int, int, int, str]:
        self.made += 1
        return self.made - 1, "final", self.start, self.size, self.trim, reason

    def end(self) -> list[tuple[int, str, int, int, int, str]]:
        """STM-03: what is open at the end of the stream."""
        if self.start is None:
            return []
        out = [self._close("end")]
        self.start, self.size, self.silence, self.trim = None, 0, 0, 0
        return out


def run_session(speech: Iterable[bool], c: Chunker, last: bool) -> list[tuple]:
    out = [x for s in speech for x in c.feed(bool(s))]
    return out + (c.end() if last else [])


def _frame(session: Any, found: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(found, columns=["chunk", "type", "start_frame", "n_frames", "trim_frames", "reason"])
    out.insert(0, "session", str(session))
    return out


def chunk_batch(frames: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Chunks of rows session, frame, speech. One grouped call for each session."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("frame")
        return _frame(p["session"].iloc[0], run_session(p["speech"], Chunker(settings), True))

    return frames.select("session", "frame", "speech").groupBy("session").applyInPandas(run, OUTPUT)


class ChunkProcessor(StatefulProcessor):
    """Keeps a session's Chunker; the last frame of a session carries `last` and closes what is open.

    Frames of a micro-batch are put in order; each session's frames are expected to arrive in order between batches, as
    the source numbers them (there is no watermark: the frame counter is the event time)."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("chunker", "data binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        c = pickle.loads(self.state.get()[0]) if self.state.exists() else Chunker(self.settings)
        p = pd.concat(list(rows)).sort_values("frame")
        last = bool(p["last"].any())
        found = run_session(p["speech"], c, last)
        if last:
            self.state.clear()
        else:
            self.state.update((pickle.dumps(c),))
        yield _frame(key[0], found)

    def close(self) -> None:
        pass


def chunk_stream(frames: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Chunks of a stream of session, frame, speech, last, in append mode."""
    return frames.groupBy("session").transformWithStateInPandas(statefulProcessor=ChunkProcessor(settings), outputStructType=OUTPUT, outputMode="Append", timeMode="None")
