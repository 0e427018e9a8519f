"""Language features and steps, network gradients, and the mix against direct versions; clashing names; edge cases of the
pipeline."""

from __future__ import annotations

import collections
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from confab.llm import common, language_id, mixing, packing, quality, simhash
from confab.llm.paths import tokenizer

M32 = (1 << 32) - 1


def plain_ngrams(text, bits, order=3):
    """Features of all n-grams, one by one, from the definition."""
    s = []
    for c in text.lower():
        c = c if unicodedata.category(c).startswith("L") else " "
        if c != " " or (s and s[-1] != " "):
            s.append(c)
    if not any(c != " " for c in s):
        return collections.Counter()
    s = [" ", *s, " "]
    out = collections.Counter()
    for n in range(1, order + 1):
        for k in range(len(s) - n + 1):
            g = s[k : k + n]
            if (n == 1 and g[0] == " ") or " " in g[1:-1] or (n > 1 and g[0] == " " and g[-1] == " "):
                continue
            h = ord(g[0]) * 2654435761 & M32
            for c in g[1:]:
                h = ((h ^ h >> 15) * 2654435761 + ord(c) * 40503) & M32
            if n > 1:
                h = (h * 2654435761 + n) & M32
            h ^= h >> 16
            out[(h * 2654435761 & M32) >> (32 - bits)] += 1
    return out


def test_ngrams_one_by_one():
    r = random.Random(1)
    texts = ["", "12 34", "a", "Ab  c-d", "äÖß 日本 é", " x ", "a1b"] + ["".join(r.choice("abC é.,7日") for _ in range(r.randint(0, 40))) for _ in range(300)]
    for t in texts:
        assert collections.Counter(language_id.ngrams(t, 14).tolist()) == plain_ngrams(t, 14), t


def test_document_frequencies_and_prediction(spark):
    texts = ["ab ab", "abc", None, "", "xyz ab"]
    df = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    counts = lambda x: {int(k): int(x[k]) for k in np.flatnonzero(x)}
    expect = lambda some: dict(collections.Counter(k for t in some for k in plain_ngrams(t or "", 10)))
    assert counts(language_id.document_frequencies(df, 10)[None]) == expect(texts)
    by = language_id.document_frequencies(df, 10, lang_col="lang")
    assert counts(by["a"]) == expect(texts[::2]) and counts(by["b"]) == expect(texts[1::2])
    rng = np.random.default_rng(2)
    model = language_id.LanguageModel(["p", "q"], 1 + rng.random(1024), rng.normal(size=(1024, 2)), rng.normal(size=2), 0.7, 10)
    for t in ("ab ab", "xyz q"):
        x = np.zeros(1024)
        for k, n in plain_ngrams(t, 10).items():
            x[k] = n * model.idf[k]
        z = ((x / np.linalg.norm(x)) @ model.weights + model.bias) / 0.7
        p = np.exp(z) / np.exp(z).sum()
        assert model.predict(t) == (["p", "q"][int(p.argmax())], pytest.approx(float(p.max())))


def test_unlearned_languages_are_told_by_their_ngrams(spark):
    """Texts of a language that wasn't learned, and junk, have n-grams that the others lack; learned ones are kept."""
    r = random.Random(6)
    syllables = {"p": ["ba", "ne", "li", "tor"], "q": ["sch", "und", "ei", "ge"], "z": ["vuk", "jox", "zwy", "qa"]}
    made = [(k, "".join(" " * (r.random() < 0.4) + r.choice(syllables[x]) for _ in range(80)), x if x != "z" else None) for k, x in enumerate("pq" * 60 + "z" * 20)]
    made += [(200, "привет как дела " * 9, None), (201, "今日は天気がいい" * 9, None), (202, "12 34", None), (203, None, None)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = language_id.fit(df, F.lit(True), sample=200)
    kept = {x["doc_id"] for x in language_id.select_rows(df, model, 0.3, 0.9).collect()}
    assert kept == {k for k, _, x in made if x}
    for _, t, _ in made[:130:9]:
        grams = plain_ngrams(t, model.bits)
        assert model.known_share(t) == pytest.approx(sum(n for g, n in grams.items() if model.known[g]) / sum(grams.values()))


def test_ftrl_step_by_step():
    """Each coordinate on its own, with both penalties."""
    rng = np.random.default_rng(3)
    alpha, beta, l1, l2, d, c = 0.7, 1.3, 0.8, 0.2, 6, 3
    f = language_id.Ftrl(d, c, alpha, beta, l1, l2)
    z, n = np.zeros((d + 1, c)), np.zeros((d + 1, c))

    def w(i, k):
        return 0.0 if abs(z[i, k]) <= l1 else -(z[i, k] - np.sign(z[i, k]) * l1) / ((beta + n[i, k] ** 0.5) / alpha + l2)

    for _ in range(40):
        at = np.sort(rng.choice(d, 3, replace=False))
        x, y = rng.random(3), int(rng.integers(c))
        f.learn(at, x, y)
        full = [*zip(at.tolist(), x.tolist(), strict=True), (d, 1.0)]
        s = [sum(v * w(i, k) for i, v in full) for k in range(c)]
        p = [np.exp(v) / sum(np.exp(u) for u in s) for v in s]
        weights = {(i, k): w(i, k) for i, _ in full for k in range(c)}
        for i, v in full:
            for k in range(c):
                g = v * (p[k] - (k == y))
                z[i, k] += g - ((n[i, k] + g * g) ** 0.5 - n[i, k] ** 0.5) / alpha * weights[i, k]
                n[i, k] += g * g
    assert np.allclose(f.z, z) and np.allclose(f.n, n)
    assert np.allclose(f.weights(), [[w(i, k) for k in range(c)] for i in range(d + 1)])
    assert (f.weights() == 0).any()


def test_network_gradients():
    """By finite differences, in double precision."""
    rng = np.random.default_rng(4)
    net = quality.ByteCnn.start(1, size=3, filters=4, hidden=5)
    for k in ("embed", "conv", "bias", "hidden", "hidden_bias", "out"):
        setattr(net, k, getattr(net, k).astype(np.float64) + rng.normal(size=getattr(net, k).shape) * 0.1)
    raw, live = rng.integers(0, 256, (3, 40)).astype(np.uint8), np.ones((3, 16), bool)
    live[1, 5:] = False
    y, w = np.array([0, 1, 1]), np.array([1.0, 2.0, 0.5])
    _, g = quality.gradients(net, raw, live, y, w)
    for name in ("embed", "conv", "bias", "hidden", "hidden_bias", "out", "out_bias"):
        flat = np.atleast_1d(np.asarray(getattr(net, name), float)).ravel()
        for at in rng.choice(flat.size, min(flat.size, 25), replace=False) if name != "embed" else raw[0, :8].astype(int) * 3:
            found = []
            for step in (1e-6, -1e-6):
                moved = flat.copy()
                moved[at] += step
                setattr(net, name, float(moved[0]) if name == "out_bias" else moved.reshape(np.shape(getattr(net, name))))
                found.append(quality.gradients(net, raw, live, y, w)[0])
                setattr(net, name, float(flat[0]) if name == "out_bias" else flat.reshape(np.shape(getattr(net, name))))
            assert np.atleast_1d(g[name]).ravel()[at] == pytest.approx((found[0] - found[1]) / 2e-6, abs=1e-6), name


def seats(weights, n):
    """Sainte-Laguë, seat by seat."""
    held = [0] * len(weights)
    for _ in range(n if sum(weights) else 0):
        k = max(range(len(weights)), key=lambda i: (weights[i] / (2 * held[i] + 1), -i))
        held[k] += 1
    return held


@pytest.mark.parametrize("most", [3.0, 2.5])
def test_mix_block_by_block(spark, most):
    """Targets, quotas of sources and shards, and what each row's words come to, from the definition."""
    r = random.Random(5)
    texts = [" ".join("w" * r.randint(1, 5) for _ in range(r.randint(0, 90))) for _ in range(240)]
    sources = [r.choice(["a", "a", "a", "a", "b", "é", None]) for _ in texts]
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(zip(texts, sources, strict=True))], "doc_id long, text string, source string")
    marks = {x["doc_id"]: (x["m"], x["h"]) for x in df.select("doc_id", F.xxhash64("text").alias("m"), F.xxhash64(F.lit(17), "doc_id", F.xxhash64("text")).alias("h")).collect()}
    got = {x["doc_id"]: x for x in mixing.mix(df, most=most, block=16, shard_rows=32).collect()}
    size = [len(t.split()) for t in texts]
    names = ["a", "b", "é", None]
    total = {s: sum(n for n, x in zip(size, sources, strict=True) if x == s) for s in names}
    weight, goal, free, left = dict(zip(names, (1, 2, 3, 1), strict=True)), {}, set(names), float(sum(size))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * total[s]}
        for s in over or free:
            goal[s] = most * total[s] if over else share[s]
        left -= sum(goal[s] for s in over)
        free = free - over if over else set()
    quota = dict(zip(names, seats([goal[s] for s in names], round(sum(goal.values()) / 16)), strict=True))
    checked = 0
    for number, s in enumerate(names):
        rows = [i for i, x in enumerate(sources) if x == s]
        shards = -(-len(rows) // max(32, int(len(rows) ** 0.5)))
        quota[s] = min(quota[s], int(most * total[s] // 16) + 1)
        lay = collections.defaultdict(list)
        for i in rows:
            lay[marks[i][1] % shards].append(i)
        words = {k: sum(size[i] for i in lay[k]) for k in sorted(lay)}
        blocks = {k: max(1, round(n / 16)) if n else 0 for k, n in words.items()}
        dealt = dict(zip(words, seats(list(words.values()), quota[s]), strict=True))
        bounded = all(dealt[k] <= blocks[k] * -(-most // 1) for k in words)
        for k in words:
            if not bounded or not words[k]:
                continue
            shift = spark.sql(f"SELECT pmod(xxhash64(17, {number}L, {k}L), {blocks[k]}L)").first()[0]
            extra, at = dealt[k] % blocks[k], 0
            for i in sorted(lay[k], key=lambda i: (i, size[i], marks[i][0])):
                once = sum(max(0, min(at + size[i], (b + 1) * words[k] // blocks[k]) - max(at, b * words[k] // blocks[k])) for b in range(blocks[k]) if (b * 1000003 + shift) % blocks[k] < extra)
                assert got[i]["taken"] == dealt[k] // blocks[k] * size[i] + once
                assert got[i]["target"] == pytest.approx(goal[s]) and got[i]["size"] == size[i] and got[i]["source_size"] == total[s]
                at += size[i]
                checked += 1
    assert checked > 100
    assert all(x["taken"] <= -(-most // 1) * x["size"] for x in got.values())


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, own_0 int, own_1 string, OWN_2 int, __id int, __mark int, id int, mark int, fp long, key long, rank int, salt int, size int, taken int, spans int"


def clashing(spark, texts):
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), 1, "x", *range(12)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CLASHING) if rows else spark.createDataFrame([], CLASHING)


TEXTS = ["one line of some length that is here\nand another line of some length", "one line of some length that is here\nand a third one", None, "", "plain words", "plain words", "z " * 30_000]


@pytest.mark.parametrize("texts", [TEXTS, []])
def test_clashing_columns(spark, texts):
    """Operators that hand rows on keep columns of any name, with their values."""
    df = clashing(spark, texts)
    for out in (simhash.keep_first(df), mixing.sample_rows(df, shard_rows=4)):
        assert out.columns == df.columns
        for x in out.collect():
            assert x["own_1"] == "x" and x["__mark"] == 2 and x["OWN_2"] == 0 and x["spans"] == 11
    assert packing.pack(df, tokenizer("word_bpe_49k.json"), capacity=64).count() >= len(texts)
    assert common.unused(["Own_0", "a"], 2) == ["own_1", "own_2"]


@pytest.mark.parametrize("case", ["empty", "repeated", "clashing"])
def test_pipeline_edge_cases(spark, tmp_path, case):
    """Empty tables give no rows; repeated rows and null ids leave one copy; other columns do no harm."""
    texts = {"empty": [], "repeated": TEXTS * 3 + ["x " * 50, "one more text about nothing at all"], "clashing": TEXTS}[case]
    df = clashing(spark, texts) if case == "clashing" else clashing(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    if case == "repeated":
        df = df.withColumn("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 4))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(out) == bool(texts)
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        at = stage(spark, at, str(tmp_path))
        assert at.columns == df.columns
        at.write.parquet(str(tmp_path / f"s{k}"))
        at = spark.read.parquet(str(tmp_path / f"s{k}"))
        if k == 2:
            assert at.count() == at.select("text").distinct().count()
