"""Voice activity frame by frame: an injected window model, an optional vote, and the stream state between them.

DSP-09 to DSP-11 and STM-16. The detector is a plain object that pickles with its state, so a batch (one grouped call for
a stream) and a stateful processor can share it."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .speech import Resampler

RATE, WINDOW, CONTEXT = 16_000, 512, 64
#: Rates that a vote is asked at.
VOTE_RATES = (8_000, 16_000, 32_000, 48_000)
FRAME_MS = 30


class WindowModel(Protocol):
    """A probability of speech for 512 samples at 16 kHz; keeps its own state between windows."""

    def __call__(self, window: np.ndarray) -> float: ...

    def reset(self) -> None: ...


class OnnxModel:
    """DSP-11: a window model from a file with inputs input, state and sr: 64 samples of context lead each window, and the
    recurrent state is handed on. Needs onnxruntime and the file on each worker."""

    def __init__(self, path: str, state_shape: tuple[int, ...] = (2, 1, 128)):
        self.path, self.shape = path, state_shape
        self._session = None
        self.reset()

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_session": None}

    def reset(self) -> None:
        self.state, self.context = np.zeros(self.shape, np.float32), np.zeros(CONTEXT, np.float32)

    def __call__(self, window: np.ndarray) -> float:
        if len(window) != WINDOW:
            raise ValueError(f"a window has {WINDOW} samples")
        if self._session is None:
            import onnxruntime

            options = onnxruntime.SessionOptions()
            options.inter_op_num_threads = options.intra_op_num_threads = 1
            self._session = onnxruntime.InferenceSession(self.path, sess_options=options, providers=["CPUExecutionProvider"])
        wide = np.concatenate([self.context, window]).astype(np.float32)
        out, self.state = self._session.run(None, {"input": wide[None], "state": self.state, "sr": np.array(RATE, np.int64)})
        self.context = wide[-CONTEXT:]
        return float(np.ravel(out)[0])


class EnergyModel:
    """A stand-in without a file: the window's RMS over a full-scale level, at most 1."""

    def __init__(self, full: float = 0.1):
        self.full = full

    def reset(self) -> None:
        pass

    def __call__(self, window: np.ndarray) -> float:
        return float(min(1.0, np.sqrt(np.mean(window * window)) / self.full))


class Detector:
    """State of one stream. frame() takes raw 16-bit samples and says whether they are speech, and how sure it is."""

    def __init__(self, model: WindowModel, threshold: float = 0.5, vote: Callable[[np.ndarray, int], bool] | None = None):
        self.model, self.threshold, self.vote = model, threshold, vote
        self.resampler: Resampler | None = None
        self.rate: int | None = None
        self.waiting = np.zeros(0)
        self.last = 0.0

    def reset(self) -> None:
        """STM-16: after a chunk that silence closed; not after one that was cut in the middle of speech."""
        self.model.reset()
        self.resampler = self.rate = None
        self.waiting, self.last = np.zeros(0), 0.0

    def probability(self, mono: np.ndarray, rate: int) -> float:
        """DSP-10: the highest probability of the windows that this frame completes; the last one known if it completes
        none (a frame of 30 ms is shorter than a window)."""
        if rate != self.rate:
            self.rate, self.waiting = rate, np.zeros(0)
            self.resampler = Resampler(rate, RATE) if rate != RATE else None
        self.waiting = np.concatenate([self.waiting, self.resampler(mono) if self.resampler else mono])
        n = len(self.waiting) // WINDOW
        if n:
            self.last = max(self.model(w) for w in self.waiting[: n * WINDOW].reshape(n, WINDOW))
            self.waiting = self.waiting[n * WINDOW :]
        return self.last

    def _voted(self, mono: np.ndarray, rate: int) -> bool:
        """DSP-09: no vote, a rate or length that it doesn't know, or an error let the frame pass."""
        if self.vote is None or rate not in VOTE_RATES or len(mono) != rate * FRAME_MS // 1000:
            return True
        try:
            return bool(self.vote(np.clip(mono * 32768.0, -32768, 32767).astype(np.int16), rate))
        except Exception:  # a failed vote isn't a no
            return True

    def frame(self, samples: np.ndarray, rate: int, channels: int = 1) -> tuple[bool, float]:
        """Both the model, which sees every frame, and the vote must agree. Channels are averaged; no samples: no speech."""
        x = np.asarray(samples, np.float64)
        mono = x[: len(x) // channels * channels].reshape(-1, channels).mean(1) / 32768.0
        if not len(mono):
            return False, 0.0
        p = self.probability(mono, rate)
        return self._voted(mono, rate) and p > self.threshold, p


def detect(frames: DataFrame, model: Callable[[], WindowModel], threshold: float = 0.5, vote: Callable | None = None, rate: int = RATE, channels: int = 1, key: str = "session", reset_after: int = 0) -> DataFrame:
    """DSP-09 to DSP-11 over rows key, frame, samples: key, frame, speech, prob. One grouped call for each stream, in order
    of frame. With reset_after, the state starts anew once so many frames in a row were no speech (STM-16)."""
    kind = dict(frames.dtypes)[key]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("frame", kind="stable")
        d, out, quiet = Detector(model(), threshold, vote), [], 0
        for samples in p["samples"]:
            speech, prob = d.frame(np.asarray(samples), rate, channels)
            quiet = 0 if speech else quiet + 1
            if reset_after and quiet == reset_after:
                d.reset()
            out.append((speech, prob))
        return pd.DataFrame({key: p[key], "frame": p["frame"], "speech": [a for a, _ in out], "prob": [b for _, b in out]})

    return frames.select(key, "frame", "samples").groupBy(key).applyInPandas(run, f"{key} {kind}, frame bigint, speech boolean, prob double")
