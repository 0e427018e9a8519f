"""Evaluation of transcripts and diarisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.num import round_binary
from ..functions.text import characters, normalize_text, token_edits, words
from .reports import ratio


def word_errors(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """MET-01: adds errors, n_words and wer over normalised texts; 0 for an empty reference. Built-in functions only."""
    r, h = words(normalize_text(F.coalesce(reference, F.lit("")))), words(normalize_text(F.coalesce(hypothesis, F.lit(""))))
    x = pairs.withColumn("errors", token_edits(r, h)).withColumn("n_words", F.size(r))
    return x.withColumn("wer", ratio(F.col("errors"), F.col("n_words")))


def character_errors(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """MET-02: adds char_errors, n_chars and cer, blanks left out."""
    bare = lambda c: F.replace(normalize_text(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit(""))
    r, h = bare(reference), bare(hypothesis)
    x = pairs.withColumn("char_errors", F.levenshtein(r, h)).withColumn("ref_chars", F.size(characters(r)))
    return x.withColumn("cer", ratio(F.col("char_errors"), F.col("ref_chars")))


def edit_counts(reference: list, hypothesis: list) -> tuple[int, int, int]:
    """STR-05: substitutions, insertions, deletions of one optimal alignment.

    Among equals a substitution goes before a deletion and that before an insertion. Rows of the table are numpy vectors
    along its anti-diagonals, so a long pair costs vector steps and not a Python step for each cell."""
    n, m = len(reference), len(hypothesis)
    if not n or not m:
        return 0, m, n
    ids = {t: i for i, t in enumerate(dict.fromkeys([*reference, *hypothesis]))}
    a, b = np.array([ids[t] for t in reference]), np.array([ids[t] for t in hypothesis])
    # cost and, packed beside it, counts: a cell's value is cost * K^3 + its substitutions, insertions, deletions
    cost = np.full((3, n + 1), np.iinfo(np.int32).max // 2, np.int64)
    subs, ins, dels = (np.zeros((3, n + 1), np.int64) for _ in range(3))
    for d in range(n + m + 1):
        now, one, two = d % 3, (d - 1) % 3, (d - 2) % 3
        low, high = max(0, d - m), min(n, d)
        i = np.arange(low, high + 1)
        best = np.full(len(i), np.iinfo(np.int32).max // 2, np.int64)
        s, k, e = (np.zeros(len(i), np.int64) for _ in range(3))
        inner = (i > 0) & (i < d)
        p = i[inner]
        differ = (a[p - 1] != b[d - p - 1]).astype(np.int64)
        best[inner], s[inner], k[inner], e[inner] = cost[two, p - 1] + differ, subs[two, p - 1] + differ, ins[two, p - 1], dels[two, p - 1]
        down = i > 0
        p = i[down]
        c = cost[one, p - 1] + 1
        take = c < best[down]
        q = np.flatnonzero(down)[take]
        best[q], s[q], k[q], e[q] = c[take], subs[one, p[take] - 1], ins[one, p[take] - 1], dels[one, p[take] - 1] + 1
        right = i < d
        p = i[right]
        c = cost[one, p] + 1
        take = c < best[right]
        q = np.flatnonzero(right)[take]
        best[q], s[q], k[q], e[q] = c[take], subs[one, p[take]], ins[one, p[take]] + 1, dels[one, p[take]]
        if d == 0:
            best[:] = 0
        cost[now] = np.iinfo(np.int32).max // 2
        cost[now, i], subs[now, i], ins[now, i], dels[now, i] = best, s, k, e
    last = (n + m) % 3
    return int(subs[last, n]), int(ins[last, n]), int(dels[last, n])


def word_error_details(pairs: DataFrame, key: list[str], reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """MET-01 and MET-08: key, substitutions, insertions, deletions, n_words, wer. An Arrow batch at a time."""
    rows = pairs.select(*key, words(normalize_text(F.coalesce(reference, F.lit("")))).alias("r"), words(normalize_text(F.coalesce(hypothesis, F.lit("")))).alias("h"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = p[key].copy()
            found = [edit_counts(list(r), list(h)) for r, h in zip(p["r"], p["h"], strict=True)]
            for k, name in enumerate(("substitutions", "insertions", "deletions")):
                out[name] = [x[k] for x in found]
            out["n_words"] = [len(r) for r in p["r"]]
            yield out

    kinds = dict(pairs.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in key) + ", substitutions int, insertions int, deletions int, n_words int"
    return rows.mapInPandas(run, schema).withColumn("wer", ratio(F.col("substitutions") + F.col("insertions") + F.col("deletions"), F.col("n_words")))


def evaluate(pairs: DataFrame, key: list[str], reference: str = "reference", hypothesis: str = "hypothesis", digits: int = 4) -> DataFrame:
    """MET-08: a row for each sample: status, substitutions, insertions, deletions, n_words, wer and cer (rounded as
    round_binary). A sample without a hypothesis (null) has failed: status `failed` and null scores."""
    done = pairs.where(F.col(hypothesis).isNotNull())
    words_ = word_error_details(done, key, reference, hypothesis)
    letters = character_errors(done, reference, hypothesis).select(*key, "cer")
    scored = words_.join(letters, key).select(*key, F.lit("ok").alias("status"), "substitutions", "insertions", "deletions", "n_words", round_binary(F.col("wer"), digits).alias("wer"), round_binary(F.col("cer"), digits).alias("cer"))
    lost = pairs.where(F.col(hypothesis).isNull()).select(*key, F.lit("failed").alias("status"))
    return scored.unionByName(lost, allowMissingColumns=True)


def evaluation_counts(samples: DataFrame) -> DataFrame:
    """MET-08: total, successful and failed samples, and the micro and macro word error rates of the successful ones."""
    ok = F.col("status") == "ok"
    errors = F.col("substitutions") + F.col("insertions") + F.col("deletions")
    return samples.agg(F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), ratio(F.sum(errors), F.sum("n_words")).alias("micro"), F.coalesce(F.avg("wer"), F.lit(0.0)).alias("macro"))


def assign(cost: np.ndarray) -> np.ndarray:
    """JOI-08: the column of each row in an assignment of least total cost (square matrix), by shortest augmenting paths
    with potentials, in cubic time."""
    n = len(cost)
    u, v, row_of = np.zeros(n + 1), np.zeros(n + 1), np.full(n + 1, -1)
    for r in range(n):
        row_of[n] = r
        at, least, back, used = n, np.full(n, np.inf), np.full(n, -1), np.zeros(n + 1, bool)
        while row_of[at] >= 0:
            used[at] = True
            free = ~used[:n]
            reduced = cost[row_of[at]] - u[row_of[at]] - v[:n]
            better = free & (reduced < least)
            least[better], back[better] = reduced[better], at
            k = int(np.where(free, least, np.inf).argmin())
            step = least[k]
            on = np.flatnonzero(used)
            u[row_of[on]] += step
            v[on] -= step
            least[free] -= step
            at = k
        while at != n:
            row_of[at] = row_of[back[at]]
            at = back[at]
    out = np.empty(n, np.int64)
    out[row_of[:n]] = np.arange(n)
    return out


def speaker_permutation_errors(reference: DataFrame, hypothesis: DataFrame, key: str) -> DataFrame:
    """MET-03, MET-04: least word errors over one-to-one pairings of speakers; unpaired ones count whole.

    reference and hypothesis: key, speaker, text (one row a speaker). Output: key, errors, n_words, cpwer, mapping
    (ref_speaker, hyp_speaker, errors; null for the missing side). Distances of all pairs of a key come from the built-in
    distance; only the small cost matrix of a key goes to a grouped function."""
    r = reference.select(key, F.col("speaker").alias("r_spk"), words(normalize_text(F.col("text"))).alias("r"))
    h = hypothesis.select(key, F.col("speaker").alias("h_spk"), words(normalize_text(F.col("text"))).alias("h"))
    both = r.join(h, key).select(key, "r_spk", "h_spk", token_edits(F.col("r"), F.col("h")).alias("e"))
    alone = r.select(key, "r_spk", F.lit(None).cast("string").alias("h_spk"), F.size("r").alias("e")).union(h.select(key, F.lit(None).cast("string"), "h_spk", F.size("h").alias("e")))
    kind = dict(reference.dtypes)[key]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        refs, hyps = sorted(p["r_spk"].dropna().unique()), sorted(p["h_spk"].dropna().unique())
        n = max(len(refs), len(hyps))
        c = np.zeros((n, n))
        ri, hi = {s: k for k, s in enumerate(refs)}, {s: k for k, s in enumerate(hyps)}
        for a, b, e in zip(p["r_spk"], p["h_spk"], p["e"], strict=True):
            if pd.isna(b):
                c[ri[a], len(hyps) :] = e
            elif pd.isna(a):
                c[len(refs) :, hi[b]] = e
        for a, b, e in zip(p["r_spk"], p["h_spk"], p["e"], strict=True):
            if not pd.isna(a) and not pd.isna(b):
                c[ri[a], hi[b]] = e
        to = assign(c)
        total = int(c[np.arange(n), to].sum()) if n else 0
        n_words = int(p.loc[p["h_spk"].isna(), "e"].sum())
        pairs = [{"ref_speaker": refs[i] if i < len(refs) else None, "hyp_speaker": hyps[j] if j < len(hyps) else None, "errors": int(c[i, j])} for i, j in enumerate(to)]
        return pd.DataFrame({key: [p[key].iloc[0]], "errors": [total], "n_words": [n_words], "mapping": [pairs]})

    out = both.union(alone).groupBy(key).applyInPandas(run, f"{key} {kind}, errors bigint, n_words bigint, mapping array<struct<ref_speaker:string,hyp_speaker:string,errors:int>>")
    return out.withColumn("cpwer", ratio(F.col("errors"), F.col("n_words")))


def greedy_mapping(weights: DataFrame, key: str) -> DataFrame:
    """JOI-07: one-to-one pairs (hypothesis, reference) by falling weight; earlier rows (pos) win ties. A key's distinct
    label pairs go to one grouped call."""
    w = weights.groupBy(key, "hypothesis", "reference").agg(F.sum("weight").alias("weight"), F.min("pos").alias("pos"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["weight", "pos", "hypothesis", "reference"], ascending=[False, True, True, True])
        left, right, keep = set(), set(), []
        for i, a, b in zip(p.index, p["hypothesis"], p["reference"], strict=True):
            if a not in left and b not in right:
                left.add(a)
                right.add(b)
                keep.append(i)
        return p.loc[keep, [key, "hypothesis", "reference", "weight"]]

    kinds = dict(w.dtypes)
    return w.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, hypothesis string, reference string, weight {kinds['weight']}")


def diarization_errors(reference: DataFrame, hypothesis: DataFrame, key: str, collar: float = 0.0, skip_overlap: bool = False) -> DataFrame:
    """MET-06, MET-07: total reference speech and false alarm, miss and confusion seconds of each key, with their rates.

    reference and hypothesis: key, start, end, speaker. Time is cut at every boundary; each elementary interval has its
    sets of speakers; hypothesis speakers are mapped one to one to reference ones to share the most time. Half the collar
    is left out on either side of each reference boundary, and overlapped reference speech too if asked for. A key's
    turns (one recording) go to one grouped call."""
    rows = reference.select(key, "start", "end", "speaker", F.lit(True).alias("ref")).union(hypothesis.select(key, "start", "end", "speaker", F.lit(False)))
    kind = dict(reference.dtypes)[key]
    names = ["total", "false_alarm", "miss", "confusion"]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [p[key].iloc[0]], **dict(zip(names, ([x] for x in sweep(p, collar, skip_overlap)), strict=True))})

    out = rows.where("end > start").groupBy(key).applyInPandas(run, f"{key} {kind}, " + ", ".join(f"{n} double" for n in names))
    total = F.greatest("total", F.lit(1e-8))
    out = out.withColumn("der", (F.col("false_alarm") + F.col("miss") + F.col("confusion")) / total)
    return out.withColumns({f"{n}_rate": F.col(n) / total for n in names[1:]})


def sweep(p: pd.DataFrame, collar: float, skip_overlap: bool) -> tuple[float, float, float, float]:
    start, end = p["start"].to_numpy(float), p["end"].to_numpy(float)
    ref = p["ref"].to_numpy(bool)
    refs, hyps = sorted(set(p["speaker"][ref])), sorted(set(p["speaker"][~ref]))
    marks = np.concatenate([start[ref], end[ref]])
    half = collar / 2
    cuts = np.unique(np.concatenate([start, end, marks - half, marks + half]))
    length, middle = np.diff(cuts), (cuts[1:] + cuts[:-1]) / 2
    keep = np.ones(len(length), bool)
    if half > 0:
        m = np.sort(marks)
        at = np.searchsorted(m, middle)
        near = np.minimum(np.abs(middle - m[np.maximum(at - 1, 0)]), np.abs(m[np.minimum(at, len(m) - 1)] - middle)) if len(m) else np.full(len(middle), np.inf)
        keep &= near >= half

    def active(names: list[str], side: np.ndarray) -> np.ndarray:
        steps = np.zeros((len(names), len(cuts)), np.int64)
        row = {s: k for k, s in enumerate(names)}
        on = np.flatnonzero(side)
        speaker = np.array([row[s] for s in p["speaker"].iloc[on]], np.int64)
        np.add.at(steps, (speaker, np.searchsorted(cuts, start[on])), 1)
        np.add.at(steps, (speaker, np.searchsorted(cuts, end[on])), -1)
        return (np.cumsum(steps, 1)[:, :-1] > 0)[:, : len(length)]

    r, h = active(refs, ref), active(hyps, ~ref)
    if skip_overlap:
        keep &= r.sum(0) <= 1
    w = np.where(keep, length, 0.0)
    share = (r * w) @ h.T.astype(float)
    n = max(len(refs), len(hyps), 1)
    square = np.zeros((n, n))
    square[: len(refs), : len(hyps)] = -share
    to = assign(square)
    correct = np.zeros(len(length))
    for i in range(len(refs)):
        if to[i] < len(hyps):
            correct += r[i] & h[to[i]]
    nr, nh = r.sum(0), h.sum(0)
    total = float((nr * w).sum())
    return total, float((np.maximum(nh - nr, 0) * w).sum()), float((np.maximum(nr - nh, 0) * w).sum()), float(((np.minimum(nr, nh) - correct) * w).sum())


def _grams(tokens: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.array_join(F.slice(tokens, i + 1, n), "\u0001"))


def _matches(pairs: DataFrame, reference: str, hypothesis: str, order: int, key: str) -> DataFrame:
    """order, matches, hyp, ref: clipped n-gram counts of all pairs."""
    parts = []
    for n in range(1, order + 1):
        side = lambda c, k: pairs.where(F.size(c) >= n).select(key, F.explode(_grams(F.col(c), n)).alias("g")).groupBy(key, "g").agg(F.count("*").alias(k))  # noqa: B023, E731
        x = side(reference, "r").join(side(hypothesis, "h"), [key, "g"], "full_outer")
        parts.append(x.agg(F.lit(n).alias("n"), F.coalesce(F.sum(F.least(F.coalesce("r", F.lit(0)), F.coalesce("h", F.lit(0)))), F.lit(0)).alias("matches"), F.coalesce(F.sum("h"), F.lit(0)).alias("hyp"), F.coalesce(F.sum("r"), F.lit(0)).alias("ref")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def bleu(pairs: DataFrame, key: str, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """MET-09: corpus BLEU (0 to 100) over blank-separated tokens: up to four words, exponential smoothing of orders
    without a match, brevity penalty. One row."""
    tok = lambda c: F.filter(F.split(F.trim(F.col(c)), r"\s+"), lambda w: w != "")
    t = pairs.select(key, tok(reference).alias("_r"), tok(hypothesis).alias("_h"))
    rows = _matches(t, "_r", "_h", 4, key).where("hyp > 0")
    sizes = t.agg(F.sum(F.size("_r")).alias("len_ref"), F.sum(F.size("_h")).alias("len_hyp"))
    # the k-th order without a match counts as 1 / 2^k
    ordered = F.array_sort(F.collect_list(F.struct("n", "matches", "hyp")))
    step = lambda acc, x: F.struct(F.when(x["matches"] == 0, acc["s"] * 2).otherwise(acc["s"]).alias("s"), (acc["l"] + F.ln(F.when(x["matches"] == 0, 1.0 / (acc["s"] * 2 * x["hyp"])).otherwise(x["matches"] / x["hyp"]))).alias("l"))
    logs = rows.agg(ordered.alias("o")).select(F.aggregate("o", F.struct(F.lit(1.0).alias("s"), F.lit(0.0).alias("l")), step)["l"].alias("l"), F.size("o").alias("orders"))
    penalty = F.when(F.col("len_hyp") >= F.col("len_ref"), 1.0).otherwise(F.exp(1 - F.col("len_ref") / F.col("len_hyp")))
    # one row with one row
    both = logs.withColumn("_one", F.lit(1)).join(sizes.withColumn("_one", F.lit(1)), "_one")
    return both.select(F.when((F.col("orders") == 4) & (F.col("len_hyp") > 0), 100 * penalty * F.exp(F.col("l") / 4)).otherwise(0.0).alias("bleu"))


def chrf(pairs: DataFrame, key: str, reference: str = "reference", hypothesis: str = "hypothesis", beta: float = 2.0) -> DataFrame:
    """MET-09: corpus chrF++ (0 to 100): mean F-beta over character 1- to 6-grams without blanks and word 1- and 2-grams.
    One row."""
    chars = lambda c: F.filter(F.split(F.regexp_replace(F.col(c), r"\s+", ""), ""), lambda w: w != "")
    # punctuation stands apart from words
    tok = lambda c: F.filter(F.split(F.trim(F.regexp_replace(F.col(c), r"([\p{P}\p{S}])", " $1 ")), r"\s+"), lambda w: w != "")
    t = pairs.select(key, chars(reference).alias("_r"), chars(hypothesis).alias("_h"), tok(reference).alias("_rw"), tok(hypothesis).alias("_hw"))
    rows = _matches(t, "_r", "_h", 6, key).union(_matches(t, "_rw", "_hw", 2, key))
    p, r, b = ratio(F.col("matches"), F.col("hyp")), ratio(F.col("matches"), F.col("ref")), beta * beta
    f = F.when((p + r) > 0, (1 + b) * p * r / (b * p + r)).otherwise(0.0)
    used = rows.where("hyp > 0 or ref > 0")
    return used.agg((100 * F.coalesce(F.avg(f), F.lit(0.0))).alias("chrf"))
