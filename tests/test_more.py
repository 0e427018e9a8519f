"""Interval joins, refinement, sweeps, voice activity, sources and live streams against plain loops."""

from __future__ import annotations

import os
import random
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from confab.functions import num
from confab.operators import intervals, islands, metrics, services, similarity, speech, sweeps, tracking, voice
from confab.operators.islands import Rules
from confab.sources import readers, writers
from confab.streaming import live, upserts

WORDS = "k int, pos int, start double, end double, tags map<string,int>"
TURNS = "k int, pos int, start double, end double, speaker string"


def spans(r, keys, n, longest):
    out = []
    for k in keys:
        for p in range(r.randint(0, n)):
            a = r.randint(0, 400) / 2
            out.append((k, p, a, a + r.randint(0, longest) / 2))
    return out


def sides(r):
    words = [(*x, {"t": 1}) for x in spans(r, range(40), 12, 30)]
    words += [(1, 99, None, None, None), (1, 99, None, None, None), (None, 5, 1.0, 2.0, {}), (77, 0, 1.0, 2.0, {}), *words[:3]]
    turns = [(*x, r.choice("ABCD")) for x in spans(r, range(38), 10, 300)] + [(1, 50, 9.0, 3.0, "Z"), (2, 50, None, 4.0, "Z")]
    return words, turns


@pytest.mark.parametrize("width", [7.0, 30.0, 1000.0])
def test_interval_joins_against_loops(spark, width):
    """Also with repeated rows, nulls, a map column, keys without turns, and turns that end before they start."""
    words, turns = sides(random.Random(width))
    w, t = spark.createDataFrame(words, WORDS), spark.createDataFrame(turns, TURNS)

    def mine(k):
        return [x for x in turns if x[0] == k and k is not None and x[2] is not None and x[2] <= x[3]]

    def at(x):
        if x[2] is None or not mine(x[0]):
            return "Unknown"
        m = (x[2] + x[3]) / 2
        return min(mine(x[0]), key=lambda y: (max(y[2] - m, m - y[3], 0), y[1]))[4]

    def most(x):
        over = lambda y: min(x[3], y[3]) - max(x[2], y[2])
        hit = [y for y in mine(x[0]) if x[2] is not None and over(y) > 0]
        return min(hit, key=lambda y: (-over(y), y[1]))[4] if hit else "Unknown"

    rows = lambda df: sorted((x["k"] is None, x["k"] or 0, x["pos"], x["start"] or 0, x["speaker"]) for x in df.collect())
    expect = lambda f: sorted((x[0] is None, x[0] or 0, x[1], x[2] or 0, f(x)) for x in words)
    assert rows(intervals.point_in_interval(w, t, "k", width)) == expect(at)
    assert rows(intervals.max_overlap(w, t, "k", width)) == expect(most)
    decisions = w.withColumn("decision", F.floor(F.col("pos") / 3))
    got = {(x["k"], x["decision"]): (x["reference"], x["seconds"]) for x in intervals.summed_overlap(decisions, t, "k", bucket=width).collect() if x["k"] is not None}
    for k, d in {(x[0], x[1] // 3) for x in words if x[0] is not None}:
        sums, first = {}, {}
        for x in words:
            for y in mine(k):
                if x[0] == k and x[1] // 3 == d and x[2] is not None and min(x[3], y[3]) > max(x[2], y[2]):
                    sums[y[4]] = sums.get(y[4], 0) + min(x[3], y[3]) - max(x[2], y[2])
                    first[y[4]] = min(first.get(y[4], 1e9), y[2])
        best = min(sums, key=lambda s: (-sums[s], first[s], s), default=None)
        assert got[k, d] == ((best, sums[best]) if best else (None, 0.0))


def test_word_meets_few_turns(spark):
    """A long session: no step of the plan makes more rows than a few for each word or turn."""
    n, m = 4000, 1000
    w = spark.range(n).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("pos"), (F.col("id") * 2.0).alias("start"), (F.col("id") * 2.0 + 1).alias("end"))
    t = spark.range(m).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("pos"), (F.col("id") * 8.0).alias("start"), (F.col("id") * 8.0 + 6).alias("end"), F.concat(F.lit("S"), F.col("id") % 3).alias("speaker"))
    lists = intervals._turn_lists(t, "k", intervals.BUCKET).agg(F.sum(F.size("_turns")).alias("n"), F.max(F.size("_turns")).alias("most")).first()
    assert lists["n"] <= 2 * m and lists["most"] <= 6
    for f in (intervals.point_in_interval, intervals.max_overlap):
        assert f(w, t, "k").count() == n


def test_tolerance_nearest_keeps_rows(spark):
    p = spark.createDataFrame([(1, 10.0, None, {"a": 1}), (1, 10.0, None, {"a": 1}), (1, None, 2, None), (2, 5.0, 3, {})], "k int, t double, n int, m map<string,int>")
    r = spark.createDataFrame([(1, 12.0, "late"), (1, 8.0, "early"), (1, 13.0, "far")], "k int, u double, name string")
    got = intervals.tolerance_nearest(p, r, "k", "t", "u", 3.0, "name").collect()
    assert sorted((x["k"], x["t"] or 0, x["name"] or "-") for x in got) == [(1, 0, "-"), (1, 10.0, "early"), (1, 10.0, "early"), (2, 5.0, "-")]


def rule_by_rule(segs, r):
    """Refinement over plain lists of (label, seconds)."""
    labels = [x for x, _ in segs]
    pseudo = lambda x: x in ("Unknown", "CALIBRATING", "")

    def runs():
        out = []
        for i, x in enumerate(labels):
            if not out or out[-1][0] != x:
                out.append([x, [], 0.0])
            out[-1][1].append(i)
            out[-1][2] += segs[i][1]
        return out

    def sides(isl, k):
        real = [(j, x[0]) for j, x in enumerate(isl) if not pseudo(x[0])]
        before = next((x for j, x in reversed(real) if j < k and x != isl[k][0]), None)
        after = next((x for j, x in real if j > k and x != isl[k][0]), None)
        return before, after

    def put(changes, isl):
        for k, to in changes.items():
            for i in isl[k][1]:
                labels[i] = to

    for _ in range(r.passes):
        was = list(labels)
        isl = runs()
        real = [k for k, x in enumerate(isl) if not pseudo(x[0])]
        alone = lambda k: sum(isl[j][0] == isl[k][0] for j in real) == 1  # noqa: B023, E731
        put({k: sides(isl, k)[0] for k in real if alone(k) and isl[k][2] <= r.small_seconds and len(isl[k][1]) <= r.small_segments and sides(isl, k)[0] is not None and sides(isl, k)[0] == sides(isl, k)[1]}, isl)
        isl = runs()
        real = [k for k, x in enumerate(isl) if not pseudo(x[0])]
        tiny = {}
        for x in {isl[k][0] for k in real}:
            own = [k for k in real if isl[k][0] == x]
            if sum(isl[k][2] for k in own) <= r.tiny_seconds and sum(len(isl[k][1]) for k in own) <= r.tiny_segments and r.tiny_min_islands <= len(own) <= r.tiny_max_islands:
                tiny[x] = own
        won = {}
        for x, own in tiny.items():
            votes = {}
            for k in own:
                for v in sides(isl, k):
                    if v is not None:
                        votes[v] = votes.get(v, 0) + 1
            top = [v for v in votes if votes[v] == max(votes.values())]
            if len(top) == 1 and votes[top[0]] / sum(votes.values()) >= r.tiny_share and top[0] not in tiny:
                won[x] = top[0]
        put({k: won[isl[k][0]] for k in range(len(isl)) if isl[k][0] in won}, isl)
        isl = runs()
        put({k: isl[k - 1][0] for k in range(1, len(isl) - 1) if isl[k][0] == "Unknown" and isl[k - 1][0] == isl[k + 1][0] and not pseudo(isl[k - 1][0]) and len(isl[k][1]) <= r.gap_segments and isl[k][2] <= r.gap_seconds}, isl)
        if labels == was:
            break
    return labels


def test_refine_random(spark):
    r = random.Random(71)
    rules = Rules(small_seconds=4.5, tiny_seconds=9.5, tiny_segments=4, tiny_share=0.4, gap_seconds=2.5)
    sessions = [[(r.choice(["A", "A", "A", "B", "B", "C", "X", "Unknown"]), float(r.randint(1, 4))) for _ in range(r.randint(1, 25))] for _ in range(60)]
    data = [(s, p, x, 0.0, d) for s, seq in enumerate(sessions) for p, (x, d) in enumerate(seq)]
    df = spark.createDataFrame(data, "session int, pos int, speaker string, start double, end double")
    got = {}
    for x in islands.refine(df, rules).orderBy("session", "pos").collect():
        got.setdefault(x["session"], []).append(x["speaker"])
        assert (x["refined_from"] is None) == (sessions[x["session"]][x["pos"]][0] == x["speaker"])
    for s, seq in enumerate(sessions):
        assert got[s] == (rule_by_rule(seq, rules) if len(seq) >= rules.min_segments else [x for x, _ in seq]), seq


def test_sweeps(spark):
    """Each configuration as if refined alone; equal outcomes are scored once; the summary ranks distinct ones."""
    r = random.Random(72)
    data = [(s, p, r.choice("AABX"), 0.0, float(r.randint(1, 4))) for s in range(6) for p in range(12)]
    df = spark.createDataFrame(data, "session int, pos int, speaker string, start double, end double")
    configs = sweeps.rule_grid(small_seconds=[0.5, 4.5], tiny_seconds=[3.0, 20.0])
    found = sweeps.outcomes(df, configs).cache()
    for k, rules in configs:
        alone = {x["session"]: x["l"] for x in islands.refine(df, rules).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("pos", "speaker")))["speaker"].alias("l")).collect()}
        assert {x["session"]: x["labels"] for x in found.where(F.col("config") == k).collect()} == alone
    scored_rows = []

    def score(d):
        rows = d.collect()
        scored_rows.append(len(rows))
        return spark.createDataFrame([(x["session"], x["signature"], len(set(x["labels"])), 10, 0.1 * len(set(x["labels"])), len(set(x["labels"]))) for x in rows], "session int, signature bigint, errors int, n_words int, wer double, speakers int")

    scored = sweeps.memoised(found, score)
    assert scored_rows == [found.select("session", "signature").distinct().count()] and scored.count() == 24
    assert sweeps.summary(scored).agg(F.sum("n_same")).first()[0] == 4
    cells = sweeps.grid(spark, b=[1.5, 2.5], a=["x", "y"])
    assert [tuple(x) for x in cells.orderBy("config").collect()] == [(0, "x", 1.5), (1, "x", 2.5), (2, "y", 1.5), (3, "y", 2.5)]
    assert sweeps.sweep(sweeps.replicates(cells, 3), spark.range(5), lambda x: x.groupBy("config", "run").count()).count() == 12


def test_detector():
    """The model sees every window in order; a frame that completes none keeps the last probability; a vote can only say no."""
    seen = []

    class Model:
        def reset(self):
            seen.append("reset")

        def __call__(self, window):
            seen.append(float(window[0]))
            return min(1.0, abs(float(window[0])) * 4)

    d = voice.Detector(Model(), 0.5, vote=lambda s, rate: s[0] != 99)
    x = np.arange(480 * 16, dtype=np.int16)
    out = [d.frame(x[k : k + 480], 16_000) for k in range(0, len(x), 480)]
    assert seen == [k * 512 / 32768 for k in range(480 * 16 // 512)]
    assert out[0] == (False, 0.0) and out[1][1] == 0.0 and out[2][1] == min(1.0, 512 / 32768 * 4)
    assert all(speech_ == (p > 0.5) for speech_, p in out)
    d.reset()
    assert seen[-1] == "reset" and d.last == 0.0 and not len(d.waiting)
    loud = voice.Detector(voice.EnergyModel(0.01), 0.5, vote=lambda s, rate: False)
    assert [loud.frame(np.full(480, 9000), 16_000)[0] for _ in range(3)] == [False] * 3
    odd = voice.Detector(voice.EnergyModel(0.01), 0.5, vote=lambda s, rate: 1 / 0)
    assert [odd.frame(np.full(960, 9000), 16_000, 2)[0] for _ in range(2)] == [False, True]
    unknown_rate = voice.Detector(voice.EnergyModel(0.01), 0.5, vote=lambda s, rate: False)
    assert unknown_rate.frame(np.full(44_100, 9000), 44_100)[0] is True
    assert odd.frame(np.zeros(0), 16_000) == (False, 0.0)


def test_detect_by_stream(spark):
    rows = [(s, k, [int(9000 * (k % 3 > 0))] * 480) for s in ("a", "b") for k in range(12)]
    got = voice.detect(spark.createDataFrame(rows, "session string, frame bigint, samples array<smallint>"), lambda: voice.EnergyModel(0.1), 0.5, reset_after=2).orderBy("session", "frame").collect()
    d = voice.Detector(voice.EnergyModel(0.1), 0.5)
    expect = [d.frame(np.array(x[2]), 16_000) for x in rows[:12]]
    assert [(x["speech"], x["prob"]) for x in got[:12]] == expect == [(x["speech"], x["prob"]) for x in got[12:]]


def test_resampler_in_pieces_and_whole():
    """The streaming resampler gives the same whatever the pieces; the batch one keeps a tone within its band."""
    x = np.sin(np.arange(4800) * 2 * np.pi * 440 / 48_000)
    whole, parts = speech.Resampler(48_000, 16_000), speech.Resampler(48_000, 16_000)
    a, b = whole(x), np.concatenate([parts(x[k : k + 137]) for k in range(0, 4800, 137)])
    assert np.allclose(a, b) and abs(len(a) - 1600) <= 1
    y = services.resample(x, 48_000, 16_000)
    expect = np.sin(np.arange(1600) * 2 * np.pi * 440 / 16_000)
    assert len(y) == 1600 and np.abs(y[50:-50] - expect[50:-50]).max() < 0.06
    band = services.fir(x, 200, 3500, 48_000)
    assert 0.9 < np.sqrt(np.mean(band[400:-400] ** 2)) / np.sqrt(0.5) < 1.1
    low = services.fir(np.sin(np.arange(9600) * 2 * np.pi * 20 / 48_000), 200, 3500, 48_000)
    assert np.sqrt(np.mean(low[400:-400] ** 2)) < 0.2


def test_plane_of_most_variance():
    r = np.random.default_rng(3)
    x = r.normal(size=(50, 8)) * np.array([9, 5, 1, 1, 1, 1, 1, 1])
    b = speech.plane(np.zeros((0, 8)), x)
    assert np.allclose(b @ b.T, np.eye(2), atol=1e-9)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2]
    assert np.allclose(np.var((x - x.mean(0)) @ b.T, axis=0, ddof=1), values)


def tracked_rows(r, sessions=3):
    rng = np.random.default_rng(r)
    rows = []
    for s in range(sessions):
        voices = [v / np.linalg.norm(v) for v in rng.normal(size=(3, 8))]
        for c in range(25):
            for k in range(int(rng.integers(1, 3))):
                v = voices[int(rng.integers(0, 3))] + rng.normal(size=8) * 0.05
                rows.append((f"s{s}", c, f"L{k}", None if rng.random() < 0.05 else [float(x) for x in v], None if rng.random() < 0.1 else 2.5, 4000.0, False))
        rows[-1] = (*rows[-1][:6], True)
    return rows


def test_track_stream_equals_batch(spark, tmp_path):
    schema = "session string, chunk bigint, local string, embedding array<double>, seconds double, chunk_ms double, last boolean"
    rows = tracked_rows(5)
    batch = sorted(map(tuple, tracking.track(spark.createDataFrame(rows, schema).drop("last")).collect()))
    rows.sort(key=lambda x: (x[1], x[0], x[2]))
    for k, at in enumerate(range(0, len(rows), 20)):
        spark.createDataFrame(rows[at : at + 20], schema).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
    (tmp_path / "in").mkdir()
    for k in range(-(-len(rows) // 20)):
        next((tmp_path / f"p{k}").glob("part-*")).rename(tmp_path / "in" / f"{k:04d}.parquet")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = live.track_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert len(got) == len(batch) and [x[:5] for x in got] == [x[:5] for x in batch]
    assert np.allclose([x[5] for x in got], [x[5] for x in batch])
    assert {x[4] for x in got} >= {"warm_up", "matched"}


def test_frame_source(spark, tmp_path):
    path = tmp_path / "live.raw"
    np.arange(480 * 3 + 100, dtype="<i2").tofile(path)
    out, c = str(tmp_path / "out"), str(tmp_path / "c")

    def run():
        q = live.read_frames(spark, str(path), session="m").writeStream.format("parquet").option("checkpointLocation", c).trigger(processingTime="0 seconds").start(out)
        q.processAllAvailable()
        q.stop()
        return spark.read.parquet(out).orderBy("frame").collect()

    got = run()
    assert [(x["session"], x["frame"], x["samples"][0]) for x in got] == [("m", 0, 0), ("m", 1, 480), ("m", 2, 960)]
    with open(path, "ab") as f:
        np.arange(480 * 3 + 100, 480 * 5, dtype="<i2").tofile(f)
    assert [x["samples"][-1] for x in run()] == [480 * k - 1 for k in range(1, 6)]


def test_event_sink_and_upserts(spark, tmp_path):
    kind = "event_type string, data map<string,string>, timestamp double"
    schema = "k string, " + kind
    parts = [[("a", "TranscriptSegmentCreated", {"text": "x"}, 1.0), ("b", "TranscriptSegmentCreated", {"text": "y"}, 2.0)], [("a", "TranscriptSegmentRevised", {"text": "z"}, 3.0)]]
    (tmp_path / "in").mkdir()
    seen = []
    for k, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        next((tmp_path / f"p{k}").glob("part-*")).rename(tmp_path / "in" / f"{k}.parquet")
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = live.event_sink(stream, str(tmp_path / "events"), str(tmp_path / "c"), lambda b, n: seen.append((n, b.count())))
        q.processAllAvailable()
        q.stop()
    got = {x["k"]: x["data"]["text"] for x in live.read_upserts(spark, str(tmp_path / "events"), ["k"]).collect()}
    assert got == {"a": "z", "b": "y"} and [n for _, n in seen] == [2, 1]
    put = live.upsert_sink(str(tmp_path / "again"))
    one = spark.createDataFrame(parts[0], schema)
    put(one, 0)
    put(one, 0)
    assert spark.read.parquet(str(tmp_path / "again")).count() == 2
    with pytest.raises(Exception, match="no such event type"):
        live.typed_events(spark.createDataFrame([("Nothing", None, 0.0)], kind)).collect()
    assert len(live.EVENT_TYPES) == 10


def test_refine_session_of_upserts(spark):
    rows = [("s", c, 0, 0, x, float(c), c + 1.0, x) for c, x in enumerate(["A", "A", "X", "A", "A"])] + [("s", 2, 1, 0, "X", 2.0, 2.5, "again")]
    df = spark.createDataFrame(rows, "session string, segment_index int, revision int, pos int, speaker string, start double, end double, text string")
    got = upserts.refine_session(df).collect()
    assert [(x["segment_index"], x["speaker"], x["text"]) for x in got] == [(2, "A", "again")]


def test_failed_samples(spark):
    df = spark.createDataFrame([(1, "a b c", "a x c"), (2, "a b", None), (3, "", "a"), (4, "übel", "ubel")], "id int, reference string, hypothesis string")
    got = metrics.evaluate(df, ["id"])
    assert {x["id"]: (x["status"], x["wer"], x["cer"]) for x in got.collect()} == {1: ("ok", 0.3333, 0.3333), 2: ("failed", None, None), 3: ("ok", 0.0, 0.0), 4: ("ok", 1.0, 0.25)}
    c = metrics.evaluation_counts(got).first()
    assert (c["total"], c["successful"], c["failed"]) == (4, 3, 1)


def test_rounding_as_python_does(spark):
    r = random.Random(9)
    x = [r.uniform(-100, 100) for _ in range(500)] + [0.125, 0.375, 2.5, 1.005, 0.12345, 1e15 / 7, -0.5, 2.675]
    for digits in (0, 2, 4):
        got = [y["v"] for y in spark.createDataFrame([(v,) for v in x], "x double").select(num.round_binary(F.col("x"), digits).alias("v")).collect()]
        assert got == [float(round(v, digits)) for v in x]


def test_catalog_and_files(spark, tmp_path):
    c = readers.Catalog()
    c.register("AMI", "made")
    assert c.get("ami") == "made"
    with pytest.raises(KeyError):
        c.get("other")
    (tmp_path / "m.json").write_text('[{"meeting_id": "a", "num_speakers": 3}, {"meeting_id": "b"}]')
    assert [(x["meeting_id"], x["num_speakers"]) for x in readers.read_meetings(spark, str(tmp_path / "m.json")).collect()] == [("a", 3), ("b", None)]


def test_long_vocabulary_is_an_error(spark):
    df = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(36_000)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ").alias("reference"), F.lit("w1").alias("hypothesis"))
    with pytest.raises(Exception, match="too many distinct tokens"):
        metrics.word_errors(df).select("errors").collect()


@pytest.mark.parametrize("block", [3, 2048])
def test_similar_pairs_by_blocks(spark, block):
    rng = np.random.default_rng(8)
    rows = [(int(k), i, [float(x) for x in rng.normal(size=4)]) for i, k in enumerate(rng.integers(0, 3, 40))] + [(0, 100, None), (0, 101, [0.0] * 4), (1, 102, [1.0, None, 1.0, 1.0])]
    got = {(x["a_id"], x["b_id"]): x["cosine"] for x in similarity.similar_pairs(spark.createDataFrame(rows, "k int, i long, v array<double>"), "k", "i", "v", 0.2, block).collect()}
    good = [x for x in rows if x[2] and None not in x[2]]
    expect = {}
    for n, (k, i, v) in enumerate(good):
        for k2, j, w in good[n + 1 :]:
            c = np.dot(v, w) / max(np.linalg.norm(v), 1e-9) / max(np.linalg.norm(w), 1e-9)
            if k == k2 and c >= 0.2:
                expect[i, j] = c
    assert got.keys() == expect.keys() and np.allclose([got[k] for k in sorted(got)], [expect[k] for k in sorted(expect)])


def test_recordings(spark, tmp_path):
    rows = [("a", 1, [3, 4]), ("a", 0, [1, 2]), ("b", 0, [9, 9])]
    df = spark.createDataFrame(rows, "session string, frame int, samples array<smallint>")
    assert writers.write_wavs(df, f"file://{tmp_path}/w", 8000, enabled=False) is None and not (tmp_path / "w").exists()
    got = {x["session"]: (x["path"], x["n_samples"]) for x in writers.write_wavs(df, f"file://{tmp_path}/w", 8000).collect()}
    assert got == {"a": (f"file://{tmp_path}/w/a.wav", 4), "b": (f"file://{tmp_path}/w/b.wav", 2)}
    back = {x["path"].rsplit("/", 1)[1]: (x["rate"], x["samples"]) for x in readers.read_wav(spark, f"file://{tmp_path}/w").collect()}
    assert back == {"a.wav": (8000, [1, 2, 3, 4]), "b.wav": (8000, [9, 9])}


def test_wav_samples_come_in_batches_by_size(spark):
    """One batch of many large files leaves as several, each within the bytes that an Arrow batch may have; a file of its own
    size stays whole, and what goes in is bounded too."""
    from confab.session import BATCH_BYTES

    class Files:
        sparkSession = spark

        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            return run

    x = np.arange(BATCH_BYTES // 8, dtype=np.int16)  # a quarter of a batch
    files = pd.DataFrame({"path": list("abcdefghij"), "content": [readers.encode_wav(8000, np.resize(x, len(x) * (5 if k == 3 else 1))) for k in range(10)]})
    got = list(readers.wav_samples(Files())(iter([files])))
    assert [list(p["path"]) for p in got] == [list("abc"), ["d"], list("efgh"), list("ij")]
    assert all(len(p) == 1 or sum(s.nbytes for s in p["samples"]) <= BATCH_BYTES for p in got)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) <= BATCH_BYTES


def test_tracker_merges_compare_only_what_changed(monkeypatch):
    """Profiles end as by comparing all pairs after each chunk, though pairs that stayed as they were aren't compared again."""

    class Direct(tracking.Tracker):
        def _merge(self):
            self.apart = {}
            return super()._merge()

    r = np.random.default_rng(3)
    s = tracking.Settings(threshold=0.3, self_similarity=0.3, merge_at=0.4, learn_above=0.35)
    rows = [(k // 2, f"L{k % 2}", r.normal(size=8) + 0.2, 2.5, 6000.0) for k in range(400)]
    a, b = tracking.Tracker(s), Direct(s)
    assert tracking.run_session(rows, a) == tracking.run_session(rows, b)
    assert a.made > len(a.profiles) > 1, "profiles merged"
    calls, cosine = [], tracking.cosine
    monkeypatch.setattr(tracking, "cosine", lambda x, y: calls.append(1) or cosine(x, y))
    a.place([("L0", None, None)])
    calls.clear()
    a.place([("L0", None, None)])
    assert not calls


SMALL = """import sys
from pyspark.sql import SparkSession, functions as F
from confab.plans import more
spark = SparkSession.builder.master("local[2]").config("spark.driver.extraJavaOptions", f"-Dio.netty.maxDirectMemory={48 << 20}").config("spark.ui.enabled", "false").config("spark.local.dir", sys.argv[1]).getOrCreate()
spark.range(0, 600, 1, 2).select(F.col("id").alias("doc_id"), F.lit(60_000).alias("n_chars")).write.parquet(f"{sys.argv[1]}/documents.parquet")
x = getattr(more, sys.argv[2])(spark, sys.argv[1]).groupBy("n", "total").count().collect()
print([tuple(r) for r in x])
"""


@pytest.mark.parametrize("name, first, last", [("wav_range", 400, 1200), ("wav_round_trip", 0, 60_000)])
def test_signals_cross_in_little_memory(tmp_path, name, first, last):
    """72 MB of signals (144 MB as files) go to Python and back, in a session that may have 48 MB outside its heap."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-c", SMALL, str(tmp_path), name], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-3000:]
    assert run.stdout.strip() == str([(last - first, sum(i * 37 % 2000 - 1000 for i in range(first, last)), 600)])


def test_pieces_of_empty_rows_end():
    from confab.session import BATCH_ROWS, pieces

    assert [len(p) for p in pieces(((k,) for k in range(2 * BATCH_ROWS + 1)), ["k"], lambda r: 0)] == [BATCH_ROWS, BATCH_ROWS, 1]
