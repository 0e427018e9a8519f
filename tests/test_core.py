"""Text, numbers, metrics, tracking, chunking and files."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from confab.functions import num, text, vec
from confab.operators import intervals, metrics, segments, speech, tracking
from confab.sources import readers, writers
from confab.streaming import chunking, upserts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, text.normalize_text(F.lit(" Hello,   WORLD! "))) == "hello world"
    assert one(spark, text.clean_tagged(F.lit("[laughs] it's well-known, yes."))) == "it's well known yes"
    r = one(spark, text.parse_result_line(F.lit("[[Calibrating... 35s]] 0.0s - 2.5s: a: b")))
    assert tuple(r) == ("Calibrating... 35s", 0.0, 2.5, "a: b")
    assert one(spark, text.parse_result_line(F.lit("nothing"))) is None
    assert one(spark, text.format_result_line(F.lit("S"), F.lit(0.25), F.lit(1234.75), F.lit("x"))) == "[S] 0.2s - 1234.8s: x"
    assert one(spark, text.speaker_index(F.lit("SPEAKER_07"))) == 7 and one(spark, text.display_name(F.lit("SPEAKER_7"))) == "SPEAKER_07"
    assert one(spark, text.same_language(F.lit("en-US"), F.lit("en"))) and not one(spark, text.same_language(F.lit(""), F.lit("")))
    assert one(spark, text.palette_slot(F.lit("Unknown"))) is None and one(spark, text.palette_slot(F.lit("SPEAKER_09"))) == 2


def test_time_and_pcm(spark):
    for raw, expect in {"12.34": 12.34, "5": 5.0, '"123.45"': 123.45, '"02:15.50"': 135.5, '"00:45"': 45.0, '"01:02:03.500"': 3723.5, '{"original":"0:01:00"}': 60.0, '"x"': None}.items():
        assert one(spark, num.parse_time_json(F.lit(raw))) == expect, raw
    assert one(spark, num.pcm_duration_ms(F.lit(320), F.lit(16000), F.lit(1))) == 10.0
    assert one(spark, num.pcm_duration_ms(F.lit(1920), F.lit(48000), F.lit(2))) == 10.0
    with pytest.raises(Exception):
        one(spark, num.pcm_duration_ms(F.lit(320), F.lit(0), F.lit(1)))


def test_vectors_and_cohort(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, vec.best_two_mean(a(0.1, 0.9, 0.5))) == pytest.approx(0.7) and one(spark, vec.best_two_mean(F.array().cast("array<double>"))) == -1
    assert one(spark, vec.cosine(a(1, 0), a(1, 1))) == pytest.approx(2**-0.5)
    df = spark.createDataFrame([(1, "a", 0.8), (1, "b", 0.4), (1, "c", 0.3)], "probe int, label string, score double")
    got = {r["label"]: r["normalized"] for r in num.cohort_normalize(df, 1.0, 0.35).collect()}
    assert got["a"] == pytest.approx(0.8)
    p = num.posterior(df).collect()
    assert sum(r["p"] for r in p) + p[0]["p_unknown"] == pytest.approx(1.0) and p[0]["best_label"] == "a"


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[:], i
        for j, y in enumerate(b, 1):
            d[j] = min(p[j] + 1, d[j - 1] + 1, p[j - 1] + (x != y))
    return d[-1]


def test_edit_counts_random():
    r = random.Random(1)
    for _ in range(500):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 9))] for _ in range(2))
        s, i, d = metrics.edit_counts(a, b)
        assert s + i + d == edits(a, b) and i - d == len(b) - len(a)
    assert metrics.edit_counts(["hello", "world"], ["hello", "word"]) == (1, 0, 0)


def test_assignment_random():
    r = np.random.default_rng(2)
    for _ in range(200):
        n = int(r.integers(1, 6))
        c = r.integers(0, 9, (n, n)).astype(float)
        to = metrics.assign(c)
        assert c[np.arange(n), to].sum() == min(c[np.arange(n), list(p)].sum() for p in itertools.permutations(range(n)))


def test_cpwer(spark):
    ref = spark.createDataFrame([("m", "P01", "a b"), ("m", "P02", "c d e")], "k string, speaker string, text string")
    hyp = spark.createDataFrame([("m", "S0", "c d x"), ("m", "S1", "a b")], "k string, speaker string, text string")
    r = metrics.speaker_permutation_errors(ref, hyp, "k").first()
    assert r["cpwer"] == pytest.approx(0.2) and {(p["ref_speaker"], p["hyp_speaker"]) for p in r["mapping"]} == {("P01", "S1"), ("P02", "S0")}
    more = hyp.union(spark.createDataFrame([("m", "S2", "q r s t")], "k string, speaker string, text string"))
    assert metrics.speaker_permutation_errors(ref, more, "k").first()["errors"] == 5


def test_der_against_raster():
    r = random.Random(4)
    for _ in range(60):
        rows = [(a := r.randint(0, 50), a + r.randint(1, 20), r.choice("AB") if side else r.choice("xyz"), side) for side in (True, False) for _ in range(r.randint(1, 5))]
        p = pd.DataFrame(rows, columns=["start", "end", "speaker", "ref"])
        total, fa, miss, conf = metrics.sweep(p, 0.0, False)
        at = lambda side, t: {s for a, b, s, k in rows if k == side and a <= t < b}  # noqa: B023, E731
        cells = [(at(True, t), at(False, t)) for t in range(80)]
        refs, hyps = sorted({s for *_, s, k in rows if k}), sorted({s for *_, s, k in rows if not k})
        n = max(len(refs), len(hyps))
        best = max(sum(sum(1 for i, x in enumerate(refs) if p[i] < len(hyps) and x in a and hyps[p[i]] in b) for a, b in cells) for p in itertools.permutations(range(n)))
        assert total == sum(len(a) for a, _ in cells)
        assert fa == sum(max(0, len(b) - len(a)) for a, b in cells) and miss == sum(max(0, len(a) - len(b)) for a, b in cells)
        assert conf == sum(min(len(a), len(b)) for a, b in cells) - best


def test_regions():
    count = lambda p: speech.regions(p)
    assert len(count([0] * 5 + [0.9] * 10 + [0] * 5)) == 1 and count([0] * 5 + [0.9] * 2 + [0] * 13) == []
    assert len(count([0] * 3 + [0.9] * 10 + [0.1] + [0.9] * 10 + [0] * 3)) == 1
    two = count([0] * 3 + [0.9] * 12 + [0] * 12 + [0.9] * 12 + [0] * 3)
    assert len(two) == 2 and two[0][1] <= two[1][0]
    assert len(count([0] * 3 + [0.9] * 8 + [0.4] * 8 + [0.9] * 8 + [0] * 3)) == 1
    assert count([0] * 3 + [0.9] * 15)[0][1] == 18 * 512


def test_tracker_warm_up_and_new_speaker():
    e = np.eye(6)
    t = tracking.Tracker()
    assert not t.warm([((0, i), e[i]) for i in range(3)], 5000) and t.remaining_ms == 15000
    groups = [[0, 1, 2], [3], [4], [5]]
    assert len(t.drop_noise(groups, 6)) == 4 and len(t.drop_noise([[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11], [12]], 13)) == 4
    for k in range(1, 4):
        t.warm([((k, i), e[i]) for i in range(3)], 5000)
    assert t.active and sorted(t.profiles) == ["SPEAKER_00", "SPEAKER_01", "SPEAKER_02"]
    assert t.place([("a", e[0], 3.0)])[0].assigned == "SPEAKER_00"
    assert t.place([("b", e[5], 3.0)])[0].kind == "candidate_new"
    d = t.place([("b", e[5], 3.0)])[0]
    assert d.kind == "candidate_promoted" and d.assigned == "SPEAKER_03"
    assert t.place([("c", None, None)])[0].assigned == "Unknown"
    assert t.place([("d", e[4], 0.5)])[0].kind == "sticky_short"


def speech_line(r, n):
    out, on = [], False
    while len(out) < n:
        out += [on] * r.randint(1, 400 if on else 60)
        on = not on
    return out[:n]


def test_chunks_cover_speech_and_cut_where_they_must():
    c = chunking.Chunker()
    got = chunking.run_session([True] * 700, c, True)
    assert got[0][3] == 334 and got[0][5] == "max" and got[1][4] == 16 and got[1][2] == 334 - 16
    c = chunking.Chunker()
    got = chunking.run_session([False] * 20 + [True] * 10 + [False] * 40, c, True)
    assert got == [(0, "final", 12, 8 + 10 + 31, 0, "silence")]


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(6)
    rows = [(f"s{k}", i, v, i == 899) for k in range(3) for i, v in enumerate(speech_line(r, 900))]
    df = spark.createDataFrame(rows, "session string, frame bigint, speech boolean, last boolean")
    for k in range(3):
        df.where(f"frame >= {k * 300} and frame < {k * 300 + 300}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        q = chunking.chunk_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
    key = lambda f: sorted(map(tuple, f.collect()))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(chunking.chunk_batch(df))


def test_transcript_view(spark):
    rows = [("s", 1, 0, "final", False, "a"), ("s", 2, 1, "speaker_update", False, "lost"), ("s", 3, 0, "speaker_update", False, "A"), ("s", 4, 0, "final", True, "late"), ("s", 5, 2, "final", False, "c")]
    df = spark.createDataFrame(rows, "session string, seq int, segment_index int, type string, provisional boolean, text string")
    assert [(r["segment_index"], r["text"]) for r in upserts.transcript_view(df).orderBy("segment_index").collect()] == [(0, "A"), (1, ""), (2, "c")]


def test_trim_and_hallucination(spark):
    w = "array<struct<start:double,end:double,word:string>>"
    df = spark.createDataFrame([(0, "A", 0.0, 2.0, " one two", [(0.0, 0.5, " one"), (0.5, 2.0, " two")]), (1, "A", 0.0, 0.4, "x", None)], f"pos int, speaker string, start double, end double, text string, words {w}")
    got = segments.trim_prefix(df, 0.5).collect()
    assert [(r["pos"], r["start"], r["text"]) for r in got] == [(0, 0.5, "two")]
    f = lambda t, c, n, p: one(spark, segments.is_hallucination(F.lit(t), F.lit(c), F.lit(n), F.lit(p)))
    assert f(" ", 0.0, 0.0, 0.0) and f("x", 2.5, 0.0, 0.0) and f("Thank you.", 1.0, 0.4, 0.0) and not f("Thank you.", 1.0, 0.1, -0.1)


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("m", 1.5, 3.75, "a"), ("m", 0.0, 1.0, "b"), ("m", 5.0, 5.0, "c")], "meeting string, start double, end double, speaker string")
    writers.write_rttm(rows, str(tmp_path / "r"))
    got = readers.read_rttm(spark, str(tmp_path / "r" / "meeting=m")).orderBy("start").collect()
    assert [tuple(r) for r in got] == [("m", 0.0, 1.0, "b"), ("m", 1.5, 3.75, "a")]
    (tmp_path / "t.txt").write_text("utt-1 HELLO WORLD\n\nutt-2\nutt-1 AGAIN NOW\n")
    assert [tuple(r) for r in readers.read_utterances(spark, str(tmp_path / "t.txt")).collect()] == [("utt-1", "AGAIN NOW")]
    (tmp_path / "c.json").write_text('[{"start_time": {"original": "0:00:02"}, "end_time": "3.5", "words": "Hi-there [noise]", "speaker": "P1"}, {"start_time": "x", "end_time": 1, "words": "no"}, {"start_time": 1, "end_time": 2, "text": "First."}]')
    got = readers.read_timed_transcript(spark, str(tmp_path / "c.json")).orderBy("pos").collect()
    assert [(r["speaker"], r["start"], r["end"], r["text"]) for r in got] == [("Unknown", 1.0, 2.0, "First"), ("P1", 2.0, 3.5, "Hi there")]
    x = np.arange(-40, 40, dtype=np.int16).reshape(-1, 2)
    (tmp_path / "a.wav").write_bytes(readers.encode_wav(16000, x))
    assert readers.read_wav(spark, str(tmp_path / "a.wav")).first()["samples"] == x[:, 0].tolist()


def test_nearest_ties(spark):
    p = spark.createDataFrame([("k", 0, 5.0), ("k", 1, 0.0), ("k", 2, 9.0), ("z", 3, 1.0)], "key string, pos int, at double")
    s = spark.createDataFrame([("k", 4.0, "a"), ("k", 6.0, "b")], "key string, at double, label string")
    assert {r["pos"]: r["label"] for r in intervals.nearest(p, s, "key").collect()} == {0: "a", 1: "a", 2: "b", 3: None}


def test_frames_and_levels(spark):
    df = spark.createDataFrame([(list(range(10)),)], "pcm array<smallint>")
    assert [r["samples"] for r in speech.frames(df, "pcm", 4).collect()] == [[0, 1, 2, 3], [4, 5, 6, 7]]
    assert speech.frames(df, "pcm", 4, pad=True).orderBy("frame").collect()[2]["samples"] == [8, 9, 0, 0]
    x = np.random.default_rng(0).normal(size=4000) * 0.1
    r = speech.Resampler(48000, 16000)
    parts = np.concatenate([r(x[:1000]), r(x[1000:1500]), r(x[1500:])])
    whole = speech.Resampler(48000, 16000)(x)
    assert np.allclose(parts, whole[: len(parts)]) and abs(len(parts) - len(whole)) <= 1


def test_settings_file(spark, tmp_path):
    from confab.operators import services

    (tmp_path / "c.json").write_text('{"theta": 0.55, "temperature": 0.09, "suggested_cutpoints": {"error<=10%": {"p_best": 0.27, "coverage": 0.642}, "error<=5%": {"p_best": 0.459, "coverage": 0.487}, "error<=2%": {"p_best": 0.986, "coverage": 0.001}}}')
    assert services.load_settings(spark, str(tmp_path / "c.json")).policy == (0.459, 0.459, 0.60)
    (tmp_path / "d.json").write_text('{"theta": 0.55, "temperature": 0.09, "suggested_cutpoints": {"error<=5%": {"p_best": 0.459, "coverage": 0.487}, "error<=2%": {"p_best": 0.8, "coverage": 0.25}}}')
    assert services.load_settings(spark, str(tmp_path / "d.json"), new_speaker=0.7).policy == (0.459, 0.8, 0.7)
    (tmp_path / "e.json").write_text("{}")
    assert services.load_settings(spark, str(tmp_path / "e.json")) is None


def test_filters():
    from confab.operators import services

    t = np.arange(4800) / 48000
    tone = lambda f: np.sin(2 * np.pi * f * t)
    y = services.resample(tone(440), 48000, 16000)
    assert len(y) == 1600 and np.abs(y[100:-100] - np.sin(2 * np.pi * 440 * np.arange(1600) / 16000)[100:-100]).max() < 0.02
    assert np.abs(services.fir(tone(1000), 200, 3500, 48000)[1000:-1000]).max() > 0.8 and np.abs(services.fir(tone(9000), 200, 3500, 48000)[1000:-1000]).max() < 0.05


def test_bleu_of_equal_and_different(spark):
    df = lambda h: spark.createDataFrame([(1, "the cat sat on the mat", h)], "k int, reference string, hypothesis string")
    assert metrics.bleu(df("the cat sat on the mat"), "k").first()["bleu"] == pytest.approx(100) and metrics.chrf(df("the cat sat on the mat"), "k").first()["chrf"] == pytest.approx(100)
    got = metrics.bleu(df("the cat the cat on the mat"), "k").first()["bleu"]
    # 5/7 words, 3/6 pairs; orders three and four: 1/5, and none of 4 (smoothed to half a match)
    assert got == pytest.approx(100 * (5 / 7 * 3 / 6 * 1 / 5 * 1 / 8) ** 0.25, rel=1e-6)
