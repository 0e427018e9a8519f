"""Speaker identity across chunks: a keyed state machine, one pure core for batch and streaming.

STM-12. A session first gathers embeddings (warm-up), clusters them once to profiles, then maps each chunk's local labels
to profiles, learns from clear matches, and opens new profiles for voices seen again. The core works on numpy vectors and
plain values, so that state can be pickled between micro-batches."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

UNKNOWN = "Unknown"


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.66
    warmup_ms: float = 20_000
    warmup_embeddings: int = 6
    warmup_audio_factor: float = 2.0
    singleton_filter_at: int = 12  # 0: no filter
    reservoir: int = 8
    seed_reservoirs: bool = True
    learn_above: float = 0.85
    learn_quality: float = 0.35
    margin: float = 0.06
    merge_at: float = 0.85
    confirmations: int = 2
    candidate_ttl: int = 15
    self_similarity: float = 0.78
    new_speaker_seconds: float = 2.0
    cohort_alpha: float = 0.0
    cohort_profiles: int = 3
    cohort_momentum: float = 0.05
    posterior: tuple[float, float, float, float] | None = None  # theta, temperature, competitor slope, duration slope
    policy: tuple[float, float, float] = (0.459, 0.459, 0.60)


@dataclass
class Profile:
    kept: list[np.ndarray]
    centroid: np.ndarray
    seconds: float
    _known: tuple | None = field(default=None, repr=False, compare=False)

    def vectors(self) -> list[tuple[np.ndarray, float]]:
        """The kept vectors and the centroid with their norms, which are counted once for each change of them."""
        now = (*self.kept, self.centroid)
        if self._known is None or len(self._known) != len(now) or any(a is not b for (a, _), b in zip(self._known, now, strict=True)):
            self._known = tuple((x, np.linalg.norm(x)) for x in now)
        return self._known


@dataclass
class Decision:
    local: str
    assigned: str | None
    kind: str
    best: str | None
    best_score: float
    margin: float | None
    learned: bool
    scores: dict[str, float] = field(default_factory=dict)


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if n > 0 else 0.0


def average_linkage(vectors: list[np.ndarray], threshold: float) -> list[list[int]]:
    """Clusters by mean similarity: the most similar pair joins (the first of equals) while it is at or above threshold."""
    groups = [[i] for i in range(len(vectors))]
    x = np.array([unit(v) for v in vectors])
    total = x @ x.T  # sums of similarities between groups
    size = np.ones(len(groups))
    while len(groups) > 1:
        mean = total / np.outer(size, size)
        mean[np.tril_indices(len(groups))] = -np.inf
        i, j = divmod(int(mean.argmax()), len(groups))
        if mean[i, j] < threshold:
            break
        groups[i] += groups.pop(j)
        total[i] += total[j]
        total[:, i] += total[:, j]
        size[i] += size[j]
        total, size = np.delete(np.delete(total, j, 0), j, 1), np.delete(size, j)
    return groups


class Tracker:
    """State of one session. warm(chunk) until it is active, then place(chunk)."""

    def __init__(self, settings: Settings = Settings()):
        self.s = settings
        self.profiles: dict[str, Profile] = {}
        self.candidates: list[tuple[int, list[np.ndarray]]] = []
        self.buffer: list[tuple[object, np.ndarray]] = []
        self.audio_ms = 0.0
        self.active = False
        self.warm_labels: dict[object, str] = {}
        self.chunks = 0
        self.made = 0
        self.cohort: float | None = None
        self.apart: dict[str, np.ndarray] = {}  # centroids that are known to be no pair to merge

    # --- warm-up ---

    def warm(self, embeddings: Iterable[tuple[object, np.ndarray | None]], chunk_ms: float) -> bool:
        """Takes one chunk's (source, embedding) pairs; True if the session is active now."""
        got = [(k, np.asarray(v, float)) for k, v in embeddings if v is not None]
        if not got:
            return False
        self.buffer += got
        self.audio_ms += chunk_ms
        enough = len(self.buffer) >= self.s.warmup_embeddings or self.audio_ms >= self.s.warmup_ms * self.s.warmup_audio_factor
        if self.audio_ms >= self.s.warmup_ms and enough:
            self._begin()
        return self.active

    @property
    def remaining_ms(self) -> float:
        return max(0.0, self.s.warmup_ms - self.audio_ms)

    def _begin(self) -> None:
        vectors = [v for _, v in self.buffer]
        for group in self.drop_noise(average_linkage(vectors, self.s.threshold), len(vectors)):
            label = self._open([vectors[i] for i in group], seed=self.s.seed_reservoirs)
            for i in group:
                if self.buffer[i][0] is not None:
                    self.warm_labels[self.buffer[i][0]] = label
        self.buffer, self.active = [], True

    def drop_noise(self, groups: list[list[int]], n: int) -> list[list[int]]:
        """Groups of one go if there is data enough to expect more and they are no more than half of the groups."""
        single = [g for g in groups if len(g) == 1]
        if self.s.singleton_filter_at and n >= self.s.singleton_filter_at and 2 * len(single) <= len(groups):
            return [g for g in groups if len(g) > 1]
        return groups

    def _open(self, vectors: list[np.ndarray], seed: bool = True) -> str:
        label = f"SPEAKER_{self.made:02d}"
        self.made += 1
        kept = vectors[-self.s.reservoir :]
        self.profiles[label] = Profile(list(kept) if seed else [], unit(np.mean(kept, 0)), float(len(vectors)))
        return label

    # --- active phase ---

    def score(self, v: np.ndarray, p: Profile) -> float:
        own = np.linalg.norm(v)
        best = sorted((float(v @ x / (own * n)) if own * n > 0 else 0.0 for x, n in p.vectors()), reverse=True)[:2]
        return sum(best) / len(best)

    def _normalized(self, raw: dict[str, float]) -> dict[str, float]:
        if self.s.cohort_alpha <= 0 or len(raw) < self.s.cohort_profiles:
            return raw
        total, rest = sum(raw.values()), len(raw) - 1
        impostors = (total - max(raw.values())) / rest
        reference = impostors if self.cohort is None else self.cohort
        self.cohort = (1 - self.s.cohort_momentum) * reference + self.s.cohort_momentum * impostors
        return {k: x - self.s.cohort_alpha * ((total - x) / rest - reference) for k, x in raw.items()}

    def _gates(self, scores: dict[str, float], best: str | None, best_score: float, margin: float | None, seconds: float | None) -> tuple[bool, bool, bool]:
        """accept, learn, may open a new profile."""
        quality = 1.0 if seconds is None else max(0.25, min(1.0, (seconds - 0.35) / (2.2 - 0.35)))
        long = seconds is None or seconds >= self.s.new_speaker_seconds
        if self.s.posterior is not None:
            p_best, p_none = self._posterior(scores, seconds)
            assign, learn, new = self.s.policy
            return best is not None and p_best >= assign, best is not None and p_best >= learn and quality >= self.s.learn_quality, p_none >= new and long
        grown = min(1.0, 0.45 + 0.55 * self.profiles[best].seconds / 8.0) if best else 1.0
        bar = self.s.threshold + (1 - quality) * 0.08 + (1 - grown) * 0.06
        clear = margin is None or margin >= self.s.margin
        return best is not None and best_score >= bar, clear and best_score > self.s.learn_above and quality >= self.s.learn_quality, long

    def _posterior(self, scores: dict[str, float], seconds: float | None) -> tuple[float, float]:
        """Probability of the best profile, and of none of them without the penalty for many rivals."""
        if not scores:
            return 0.0, 1.0
        theta, t, slope, by_length = self.s.posterior
        t = t if seconds is None or by_length <= 0 else t * (1 + by_length / max(seconds, 0.05))
        z = (np.array(list(scores.values())) - theta) / t
        none = -z.max()
        share = lambda u: np.exp(np.append(z, u) - max(z.max(), u))
        a, b = share(none + slope * np.log(len(z))), share(none)
        return float(a[z.argmax()] / a.sum()), float(b[-1] / b.sum())

    def place(self, chunk: Iterable[tuple[str, np.ndarray | None, float | None]]) -> list[Decision]:
        """Decisions for one chunk's (local label, embedding, seconds or None), in order. Only the best profile is
        tested, never one further down. Labels without an embedding are Unknown."""
        self.chunks += 1
        self.candidates = [c for c in self.candidates if self.chunks - c[0] < self.s.candidate_ttl]
        out = [self._one(local, None if v is None else np.asarray(v, float), seconds) for local, v, seconds in chunk]
        gone = self._merge()
        for d in out:
            d.assigned = gone.get(d.assigned, d.assigned)
        return out

    def _one(self, local: str, v: np.ndarray | None, seconds: float | None) -> Decision:
        if v is None:
            return Decision(local, UNKNOWN, "no_embedding", None, -1.0, None, False)
        scores = self._normalized({k: self.score(v, p) for k, p in self.profiles.items()})
        ranked = sorted(scores.items(), key=lambda x: -x[1])
        best, best_score = ranked[0] if ranked else (None, -1.0)
        margin = best_score - ranked[1][1] if len(ranked) > 1 else None
        accept, learn, may_open = self._gates(scores, best, best_score, margin, seconds)
        d = Decision(local, best or UNKNOWN, "unknown", best, best_score, margin, False, scores)
        if accept:
            self._credit(best, seconds)
            unclear = self.s.posterior is None and margin is not None and margin < self.s.margin
            d.kind, d.learned = "matched_ambiguous" if unclear else "matched", learn
            if learn:
                p = self.profiles[best]
                p.kept = [*(p.kept or [p.centroid]), v][-self.s.reservoir :]
                p.centroid = unit(np.mean(p.kept, 0))
        elif not may_open:
            if best:
                d.kind = "low_confidence" if self.s.posterior is not None else "sticky_short"
                if self.s.posterior is None:
                    self._credit(best, seconds)
        else:
            d.kind, opened = self._candidate(v)
            if opened:
                d.assigned = opened
                self._credit(opened, seconds)
        return d

    def _candidate(self, v: np.ndarray) -> tuple[str, str | None]:
        for k, (_, seen) in enumerate(self.candidates):
            if cosine(v, np.mean(seen, 0)) >= self.s.self_similarity:
                seen.append(v)
                pairs = [cosine(a, b) for i, a in enumerate(seen) for b in seen[i + 1 :]]
                if len(seen) >= self.s.confirmations and (not pairs or np.mean(pairs) >= self.s.self_similarity):
                    self.candidates.pop(k)
                    return "candidate_promoted", self._open(seen)
                return "candidate_pending", None
        self.candidates.append((self.chunks, [v]))
        return "candidate_new", None

    def _credit(self, label: str | None, seconds: float | None) -> None:
        if label in self.profiles and seconds is not None:
            self.profiles[label].seconds += max(0.0, seconds)

    def _merge(self) -> dict[str, str]:
        """Joins profiles alike, the lower label stays; labels in text order. Two profiles whose centroids are those of the
        last call were compared then."""
        gone: dict[str, str] = {}
        old = {k for k, p in self.profiles.items() if self.apart.get(k) is p.centroid}
        new = self.profiles.keys() - old
        if not new:
            return gone
        for keep in sorted(self.profiles):
            rest = deque(sorted(x for x in (self.profiles if keep in new else new) if x > keep and x in self.profiles)) if keep in self.profiles else ()
            while rest:
                drop = rest.popleft()
                if cosine(self.profiles[keep].centroid, self.profiles[drop].centroid) >= self.s.merge_at:
                    a, b = self.profiles[keep], self.profiles.pop(drop)
                    a.kept = [*(a.kept or [a.centroid]), *(b.kept or [b.centroid])][-self.s.reservoir :]
                    a.centroid, a.seconds = unit(np.mean(a.kept, 0)), a.seconds + b.seconds
                    gone[drop] = keep
                    if keep not in new:  # it is another one now, also for those behind
                        new.add(keep)
                        rest = deque(sorted(x for x in self.profiles if x > drop))
        self.apart = {k: p.centroid for k, p in self.profiles.items() if k not in gone.values()}
        return gone


class SessionRun:
    """Rows (chunk, local, embedding, seconds, chunk ms) of one session in order, to decisions (chunk, local, assigned,
    kind, best score).

    A chunk is decided once a row of the next one comes, or at the end. Rows of the warm-up come out with the labels that
    clustering gave them (STM-10: Unknown if none did), once it is done; a session that ends before is CALIBRATING. The
    object holds a chunk at most besides the tracker's own bounded state, and pickles between micro-batches."""

    def __init__(self, t: Tracker):
        self.t = t
        self.chunk: list[tuple] = []
        self.warm: list[tuple] = []

    def feed(self, row: tuple[int, str, object, float | None, float]) -> list[tuple[int, str, str, str, float]]:
        out = self._close() if self.chunk and self.chunk[0][0] != row[0] else []
        self.chunk.append(row)
        return out

    def _close(self) -> list[tuple]:
        chunk, self.chunk = self.chunk, []
        if not chunk:
            return []
        k, t = chunk[0][0], self.t
        if t.active:
            return [(k, d.local, d.assigned, d.kind, d.best_score) for d in t.place([(c[1], c[2], c[3]) for c in chunk])]
        self.warm += [(k, c[1]) for c in chunk]
        if not t.warm([((k, c[1]), c[2]) for c in chunk], chunk[0][4]):
            return []
        warm, self.warm = self.warm, []
        return [(w[0], w[1], t.warm_labels.get(w, UNKNOWN), "warm_up", 0.0) for w in warm]

    def end(self) -> list[tuple]:
        out = self._close()
        warm, self.warm = self.warm, []
        return out + [(w[0], w[1], "CALIBRATING", "warm_up", 0.0) for w in warm]


def run_session(rows: Iterable[tuple[int, str, object, float | None, float]], t: Tracker) -> list[tuple[int, str, str, str, float]]:
    s = SessionRun(t)
    return [x for row in rows for x in s.feed(row)] + s.end()


def session_rows(p: pd.DataFrame) -> Iterable[tuple]:
    """A session's rows in order, as a SessionRun takes them."""
    p = p.sort_values(["chunk", "local"], kind="stable")
    return zip(p["chunk"], p["local"], p["embedding"], [None if pd.isna(x) else float(x) for x in p["seconds"]], p["chunk_ms"], strict=True)


def track(rows: DataFrame, settings: Settings = Settings(), session: str = "session", tracker: Callable[[Settings], Tracker] = Tracker) -> DataFrame:
    """STM-12 in batch: rows session, chunk, local, embedding, seconds (null: unknown), chunk_ms. One grouped call for each
    session, which is the unit that is sequential by nature; sessions run in parallel. UDF-11: a subclass of Tracker can stand in."""
    kind = dict(rows.dtypes)[session]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        found = run_session(session_rows(p), tracker(settings))
        out = pd.DataFrame(found, columns=["chunk", "local", "assigned", "decision", "best_score"])
        out.insert(0, session, p[session].iloc[0])
        return out

    return rows.select(session, "chunk", "local", "embedding", "seconds", "chunk_ms").groupBy(session).applyInPandas(run, f"{session} {kind}, chunk bigint, local string, assigned string, decision string, best_score double")
