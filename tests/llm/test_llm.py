"""Training-data operators against libraries, brute force and held-out labels, and their edge cases."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from confab.llm import components, digest, language_id, line_dedup, mixing, ngram_lm, packing, quality, simhash, token_counts, topk_search
from confab.llm.common import fold
from confab.llm.paths import tokenizer

ODD = ["", None, " ", "\n\n", "a", "  two  words ", "ÄÖ ß é 日本語 фы 😀", "x" * 5000, "the " * 3000, "don't, it's.\tx", "<|endoftext|> <s> </s> ▁", "12345 | --- ***", "\x00\x01", "same line of twenty-four characters\nsame line of twenty-four characters"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, mark int, part int, whole int, spans string"


def docs(spark, texts, langs=None, sources=None):
    n = len(texts)
    rows = [(i, t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", len(t or ""), "k", 1, 2, 3, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA) if n else spark.createDataFrame([], SCHEMA)


def prose(r, n, words=None):
    words = words or ["the", "of", "and", "over", "stone", "river", "light", "Walk", "green", "seven", "house"]
    return " ".join(r.choice(words) for _ in range(n))


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[:], i
        for j, y in enumerate(b, 1):
            d[j] = min(p[j] + 1, d[j - 1] + 1, p[j - 1] + (x != y))
    return d[-1]


def roots(n, pairs):
    at = list(range(n))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_token_counts(spark):
    import sentencepiece

    r = random.Random(1)
    texts = ODD + ["".join(r.choice("aeinrst  \n\t.,-éüß日фы▁\x00€😀0129<>") for _ in range(r.randint(0, 80))) for _ in range(300)] + ["ab" * 2000, "\n" * 700]
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    got = {x["doc_id"]: x for x in token_counts.token_counts(docs(spark, texts), tokenizer("piece_bpe_32k.model"), limit=100).collect()}
    for i, t in enumerate(texts):
        n = len(sp.encode(t or ""))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 100), t
    assert token_counts.token_counts(docs(spark, []), tokenizer("piece_bpe_32k.model")).count() == 0


def brute_lm(train, texts):
    toks = lambda t: [*(t or "").encode().lower().split(), None]
    c, bi = collections.Counter(), collections.Counter()
    for t in map(toks, train):
        c.update(t)
        bi.update(zip([1, *t[:-1]], t, strict=True))
    total, v = sum(c.values()), len(c)

    def cut(n):
        d = [0, 0.5, 1.0, 1.5]
        if n[0] and n[1]:
            y = n[0] / (n[0] + 2 * n[1])
            for k in (1, 2, 3):
                if n[k - 1] and n[k] and 0 < (x := k - (k + 1) * y * n[k] / n[k - 1]) < k:
                    d[k] = x
        return d

    many = collections.Counter(bi.values())
    before = collections.Counter(b for _, b in bi)
    rare = collections.Counter(before.values())
    d, u = cut([many[k] for k in (1, 2, 3, 4)]), cut([rare[k] for k in (1, 2, 3, 4)])
    context, kinds = collections.Counter(), collections.defaultdict(lambda: [0] * 4)
    for (a, _), k in bi.items():
        context[a] += k
        kinds[a][min(k, 3)] += 1
    rest = sum(u[min(k, 3)] for k in before.values()) / len(bi) if bi else 1.0
    low = lambda w: (max(before[w] - u[min(before[w], 3)], 0) / len(bi) if bi else 0) + rest / (v + 1)

    def p(a, b):
        if a not in context:
            return low(b)
        k = bi[a, b]
        return max(k - d[min(k, 3)], 0) / context[a] + sum(d[i] * kinds[a][i] for i in (1, 2, 3)) / context[a] * low(b)

    assert not bi or sum(p(1, w) for w in c) + p(1, b"\xff") == pytest.approx(1.0)
    return [(len(t), sum(w in c for w in t), total, sum(math.log10((c[w] + 0.5) / (total + 0.5 * (v + 1))) for w in t), sum(math.log10(p(a, b)) for a, b in zip([1, *t[:-1]], t, strict=True))) for t in map(toks, texts)]


def test_lm_scoring(spark):
    r = random.Random(2)
    texts = ODD + [prose(r, r.randint(0, 60)) for _ in range(80)]
    df = docs(spark, texts)
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    got = {x["doc_id"]: x for x in ngram_lm.score(df, ngram_lm.fit(df.where(fold("doc_id", 5) != 1))).collect()}
    for i, (n, known, total, base, score) in enumerate(brute_lm(train, texts)):
        g = got[i]
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (n, known, total)
        assert g["base_score"] == pytest.approx(base) and g["score"] == pytest.approx(score)
    none = ngram_lm.fit(docs(spark, []))
    assert [x["score"] for x in ngram_lm.score(docs(spark, ["a b"]), none).collect()] == [0.0]


def mutate(r, s, k):
    s = list(s)
    for _ in range(k):
        at = r.randrange(len(s))
        s[at : at + r.randint(0, 1)] = r.choice(["", "a", "é"])
    return "".join(s)


def test_edit_join_parts():
    r = random.Random(3)
    for _ in range(4000):
        a = "".join(r.choice("abé") for _ in range(r.randint(4, 30)))
        b = mutate(r, a, r.randint(0, 4)) or "a"
        for k in (1, 2, 3):
            d = edits(a, b)
            assert line_dedup.within(a, b, k) == (d <= k)
            if min(len(a), len(b)) > k and d <= k and a != b:
                of, sig = line_dedup.entries([a, b], k)
                own = [{(int(x) >> 1, int(x) & 1) for x in sig[of == j]} for j in (0, 1)]
                assert any((x, 1) in own[1] for x, kind in own[0] if not kind) or any((x, 1) in own[0] for x, kind in own[1] if not kind)


def test_edit_join_of_very_long_lines():
    """Time grows with the length, not its square."""
    r = random.Random(31)
    a = "".join(r.choice("abcdefgh ") for _ in range(400_000))
    b = a[1:200_000] + "x" + a[200_000:] + "y"
    began = time.time()
    assert line_dedup.within(a, b, 3) and not line_dedup.within(a, b, 2)
    assert line_dedup.within(a[::-1], b[::-1], 3) and time.time() - began < 10


def test_line_dedup_against_brute_force(spark):
    r = random.Random(4)
    base = [prose(r, r.randint(5, 12)) for _ in range(25)]
    texts = ["\n".join(mutate(r, r.choice(base), r.choice([0, 0, 1, 2, 3])) for _ in range(r.randint(0, 6))) for _ in range(50)] + ODD
    lines = [(i, k, x) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if len(x) >= 24]
    root = roots(len(lines), [(a, b) for a in range(len(lines)) for b in range(a) if abs(len(lines[a][2]) - len(lines[b][2])) <= 2 and edits(lines[a][2], lines[b][2]) <= 2])
    lost = collections.defaultdict(list)
    for k, (i, at, _) in enumerate(lines):
        if root[k] != k:
            lost[i].append((at, lines[root[k]][0]))
    df = docs(spark, texts)
    got = {x["doc_id"]: x for x in line_dedup.duplicate_lines(df).collect()}
    for i, t in enumerate(texts):
        assert list(zip(got[i]["dropped"], got[i]["first_docs"], strict=True)) == lost[i]
        assert got[i]["n_lines"] == len((t or "").split("\n"))
    kept = {x["doc_id"]: x["text"] for x in line_dedup.remove_lines(df).collect()}
    for i, t in enumerate(texts):
        gone = {k for k, _ in lost[i]}
        expect = t if not gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        if gone and not expect.strip():
            assert i not in kept
        else:
            assert kept[i] == expect
    assert line_dedup.duplicate_lines(docs(spark, [])).count() == 0


def replaced(r, words, k):
    words = list(words)
    for at in r.sample(range(len(words)), k):
        words[at] = "".join(r.choice("pqrstuvw") for _ in range(9))
    return words


def test_line_dedup_of_long_lines(spark):
    """Lines of 20 words and more are near copies within a number of words that grows, in scripts without blanks of characters."""
    r = random.Random(41)
    base = [prose(r, r.randint(20, 400), [f"w{k}" for k in range(60)]).split(" ") for _ in range(14)]
    made = base + [replaced(r, b, k) for b in base for t in (line_dedup.word_edits(len(b)),) for k in (1, t, t + 1, 2 * t)]
    made += [b[: len(b) // 2] + b[len(b) // 2 + 1 :] for b in base]
    made += [["same"] * 60, ["same"] * 58, ["same"] * 57, ["other"] + ["same"] * 59]
    r.shuffle(made)
    lines = [" ".join(x) for x in made]
    lines += [lines[3].replace(" ", "  ", 5), lines[4][:-3] + "y"]
    han = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(60))
    lines += [han, han[:10] + "一丁" + han[12:], han[:10] + "一丁七万丈" + han[15:]]
    split = [line_dedup.words_of(x) for x in lines]
    near = [(a, b) for a in range(len(lines)) for b in range(a) if abs(len(split[a]) - len(split[b])) <= 8 and edits(split[a], split[b]) <= line_dedup.word_edits(min(len(split[a]), len(split[b])))]
    root = roots(len(lines), near)
    got = {x["doc_id"]: x for x in line_dedup.duplicate_lines(docs(spark, lines)).collect()}
    assert [got[i]["first_docs"] for i in range(len(lines))] == [[root[i]] if root[i] != i else [] for i in range(len(lines))]
    assert sum(root[i] != i for i in range(len(lines))) > 30


def test_line_dedup_of_a_large_group(spark):
    """A group of more lines than are held at once is compared part by part, with the same result."""
    r = random.Random(43)
    base = [f"word{k}" for k in range(30)]
    made = [replaced(r, base, 1) for _ in range(30)] + [base[:20] + [f"x{r.randrange(9)}{k}" for k in range(10)] for _ in range(30)]
    lines = [" ".join(x) for x in made]
    near = [(a, b) for a in range(60) for b in range(a) if edits(made[a], made[b]) <= 2]
    root = roots(60, near)
    place = {np.array([line_dedup._key(x)], np.uint64).view(np.int64)[0]: i for i, x in enumerate(lines)}
    for chunk in (7, 512):
        s, k = np.repeat(np.arange(2, dtype=np.uint64) << np.uint64(1), 20) | np.tile(np.arange(2, dtype=np.uint64), 20), np.arange(40, dtype=np.uint64)
        _, _, at, many = line_dedup._groups(s, k, chunk)
        assert many.tolist() == [-(-20 // chunk)] * 40 and at.max() == (20 - 1) // chunk
        found = [(place[x["a"]], place[x["b"]]) for x in line_dedup.links(docs(spark, lines), chunk=chunk).collect()]
        assert roots(60, found) == root


def test_line_dedup_of_clashing_names(spark):
    """Columns of any name stay; null ids and texts, repeated rows and empty tables have results."""
    line = "a line that stands in more than one document"
    rows = [(1, line, 1, 2, 3), (2, "x\n" + line, 1, 2, 3), (2, "x\n" + line, 1, 2, 3), (None, line, 1, 2, 3), (3, None, 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, own_0 int, __id int, mark int")
    got = line_dedup.remove_lines(df)
    assert got.columns == df.columns
    assert sorted((x["doc_id"] or 0, x["text"] or "-") for x in got.collect()) == [(0, line), (2, "x"), (2, "x"), (3, "-")]
    assert line_dedup.remove_lines(df.limit(0)).count() == 0


def test_line_dedup_of_short_lines(spark, tmp_path):
    """The query drops later occurrences of short lines too, if they are equal and not blank."""
    from confab.llm import queries

    han = "今日は天気がいいので散歩に行きました。"
    docs(spark, ["one\n\n \nx\n" + han, "\n \nOne\none\none", han + "\nx\n\nones", "\n"]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: (x["dropped"], x["first_docs"]) for x in queries.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: ([], []), 1: ([3, 4], [0, 0]), 2: ([0, 1], [0, 0]), 3: ([], [])}


LETTERS = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}


def lang_rows(r, n):
    langs = [r.choice(list(LETTERS)) for _ in range(n)]
    texts = [" ".join("".join(r.choice(LETTERS[x] * 4 + "xyz") for _ in range(r.randint(2, 7))) for _ in range(r.randint(3, 40))) for x in langs]
    return texts, langs


def test_language_id(spark):
    r = random.Random(5)
    texts, langs = lang_rows(r, 300)
    texts += ["", None, "123 ...", "日本"]
    langs += [None, "aa", "aa", None]
    df = docs(spark, texts, langs)
    model = language_id.fit(df, fold("doc_id", 3) != 1, sample=200)
    got = {x["doc_id"]: x for x in language_id.predict(df, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i]["lang_pred"] == langs[i] for i in held]) > 0.97
    assert [got[i]["lang_pred"] for i in (300, 301, 302)] == ["und"] * 3 and got[303]["lang_pred"] in LETTERS
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert (model.weights == 0).mean() > 0.5  # the L1 penalty
    assert {x["doc_id"] for x in language_id.select_rows(df, model, 0.3).collect()} == set(range(304)) - {300, 301, 302} - {i for i, x in got.items() if x["score"] < 0.3}
    empty = language_id.fit(docs(spark, []), fold("doc_id", 3) != 1)
    assert language_id.predict(docs(spark, ["abc"]), empty).first()["lang_pred"] == "und"


def test_top_k(spark):
    r = np.random.default_rng(6)
    rows = [(i, [float(x) for x in r.normal(size=16).astype(np.float32)]) for i in range(200)]
    rows += [(200, None), (220, [float("nan")] * 16), (240, []), (260, [None] + [1.0] * 15), (5, rows[7][1]), (280, rows[3][1]), (None, rows[3][1]), (300, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for x in topk_search.top_k(df, df.where("vec_id % 20 = 0"), k=7, block=64).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    good = [(i, np.pad(np.floor(64 * np.array(v, np.float32).astype(float)), (0, 16 - len(v))).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    assert set(got) == {i for i, _ in good if i % 20 == 0}
    for k, (i, q) in enumerate(good):
        if i % 20 == 0:
            best = sorted(((-int(q @ v), j) for n, (j, v) in enumerate(good) if n != k))[:7]
            assert got[i] == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert topk_search.top_k(df.limit(0), df.limit(0), k=3).count() == 0


def test_top_k_bounds_prune():
    """Each level leaves no more pairs than the one before, none of them wrongly; the finest leaves few."""
    r = np.random.default_rng(61)
    x = r.normal(size=(9000, 64))
    x = np.floor(64 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    q, ids, alive = x[:300], r.permutation(9000), np.zeros(5, np.int64)
    rows, found, score = topk_search.search(q, x, ids, 20, alive)
    assert (np.diff(alive) <= 0).all() and alive[-1] < 0.25 * alive[0], alive / alive[0]
    full = q @ x.T
    for i in range(len(q)):
        best = np.lexsort((ids, -full[i]))[:20]
        on = rows == i
        assert found[on].tolist() == best.tolist() and score[on].tolist() == full[i][best].tolist()
    for at in range(4):
        e = topk_search.edges(64, at)
        f, g = topk_search.features(q.astype(float), e), topk_search.features(x.astype(float), e)
        assert (f @ g.T >= full - 0.2).all()


def test_quality(spark):
    r = random.Random(7)
    good = [prose(r, r.randint(3, 80)) for _ in range(150)]
    bad = [" ".join(w + r.choice(["###", "$$$", "%%%"]) for w in prose(r, r.randint(3, 80)).split()) for _ in range(150)]
    texts = good + bad + ["", None, "x" * 50000]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(300, None, None)], "doc_id long, quality int, toxic int")
    net = quality.fit(df, labels, fold("doc_id", 3) != 1, sample=200)
    got = {x["doc_id"]: x for x in quality.predict(df, net).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i]["predicted"] == (i < 150) for i in held]) > 0.9
    assert len(got) == 303 and all(0 <= x["score"] <= 1 for x in got.values())
    assert quality.fit(df, labels.limit(0), F.lit(True)) is None and quality.predict(df, None).first()["score"] == 0.5

    def direct(t):
        data = t.encode()
        raw = np.frombuffer(data + b"\0" * 16, np.uint8)
        a = np.array([net.embed[raw[p : p + 8]].reshape(-1) @ net.conv for p in range(max(1, len(data)))])
        blocks = max(1, -(-len(data) // 128))
        h = [np.tanh(np.maximum(a[c * 256 : c * 256 + 512].max(0) + net.bias, 0) @ net.hidden + net.hidden_bias) for c in range(1 + max(0, -(-(blocks - 4) // 2)))]
        return 1 / (1 + np.exp(-(np.mean(h, 0) @ net.out + net.out_bias)))

    for i in (*range(0, 300, 37), 300, 302):
        assert got[i]["score"] == pytest.approx(direct(texts[i]), abs=1e-5)


def test_packing(spark):
    from tokenizers import Tokenizer

    r = random.Random(8)
    texts = ODD + [prose(r, r.randint(0, 90)) for _ in range(120)]
    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    got = packing.pack(docs(spark, texts), tokenizer("word_bpe_49k.json"), capacity=64, end_id=0, with_ids=True).collect()
    by_doc, fill = collections.defaultdict(list), collections.defaultdict(list)
    for x in got:
        by_doc[x["doc_id"]].append(x)
        fill[x["sequence_id"]].append((x["offset"], x["length"]))
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        cut = sorted(by_doc[i], key=lambda x: x["piece"])
        assert [y for x in cut for y in x["ids"]] == ids and all(x["start"] == 64 * x["piece"] for x in cut)
        assert all(x["ids_crc32"] == zlib.crc32(np.array(x["ids"], "<u4").tobytes()) for x in cut)
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(x["length"] for x in got)
    assert len(fill) <= 1.06 * -(-total // 64) + 1
    assert packing.pack(docs(spark, []), tokenizer("word_bpe_49k.json")).count() == 0


def optimal(sizes, capacity):
    """Fewest bins, by search."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for room in sorted({b for b in bins if b >= sizes[k]}):
            at = bins.index(room)
            go(k + 1, [*bins[:at], room - sizes[k], *bins[at + 1 :]])
        go(k + 1, [*bins, capacity - sizes[k]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    r = np.random.default_rng(9)
    for _ in range(1500):
        capacity = int(r.integers(6, 24))
        sizes = r.integers(1, capacity + 1, int(r.integers(1, 10)))
        n = np.bincount(sizes, minlength=capacity + 1)
        rest, fixed = packing.reduce_dominated(n, capacity)
        left = np.repeat(np.arange(capacity + 1), rest)
        assert optimal(list(left), capacity) + sum(k for _, k in fixed) == optimal(list(sizes), capacity)


def test_simhash(spark):
    import xxhash

    def plain(t):
        w = (t or "").encode().lower().split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    r = random.Random(10)
    base = [prose(r, 60, [f"w{i}" for i in range(300)]) for _ in range(12)]
    texts = ODD + base * 2 + [" ".join(x for x in b.split() if r.random() > 0.01) for b in base * 6]
    fp = [plain(t) for t in texts]
    expect = roots(len(fp), [(a, b) for a in range(len(fp)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 2])
    df = docs(spark, texts)
    got = {x["doc_id"]: x for x in simhash.near_duplicates(df).collect()}
    assert [int(got[i]["fingerprint"], 16) for i in range(len(fp))] == fp
    assert [got[i]["component_id"] for i in range(len(fp))] == expect
    assert sorted(x["doc_id"] for x in simhash.keep_first(df.union(df)).collect()) == sorted(set(expect))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_links_of_close_fingerprints(spark):
    r = random.Random(11)
    centre = r.getrandbits(64) - (1 << 63)
    fps = {centre}
    for _ in range(120):
        x = r.choice(sorted(fps))
        for _ in range(r.choice([1, 2, 3])):
            k = r.randrange(64)
            x ^= 1 << k if k < 63 else -(1 << 63)
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    # a crowded table (bucket 3) joins by stars
    for bits, bucket in ((1, 64), (1, 3), (2, 64), (2, 3), (3, 64), (5, 64)):
        expect = roots(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if ((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() <= bits])
        got = {x["node"]: x["root"] for x in components.components(simhash.links(df, bits, bucket)).collect()}
        assert [got.get(f, f) for f in fps] == [fps[k] for k in expect]


def test_components_chain(spark):
    n = 300
    r = random.Random(12)
    order = list(range(n))
    r.shuffle(order)
    pairs = [(order[i], order[i + 1]) for i in range(n - 1) if i % 100 != 99]
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert [got[i] for i in range(n)] == roots(n, pairs)


def test_apportionment():
    r = np.random.default_rng(13)
    for _ in range(200):
        w = r.integers(0, 50, int(r.integers(1, 8))).astype(float)
        seats = int(r.integers(0, 60))
        held = np.zeros(len(w), int)
        if w.sum():
            for _ in range(seats):
                held[int(np.argmax(w / (2 * held + 1)))] += 1
        got = mixing.apportion(w, seats)
        assert got.sum() == held.sum() and np.allclose(np.sort(w / np.maximum(2 * got - 1, 1e-9) * (got > 0)), np.sort(w / np.maximum(2 * held - 1, 1e-9) * (held > 0)))
    assert mixing.targets(np.array([100, 10, 10]), np.array([1, 2, 3])).tolist() == [60.0, 30.0, 30.0]


def test_mixing(spark):
    r = random.Random(14)
    texts = [prose(r, r.randint(1, 300)) for _ in range(300)] + ODD
    sources = [r.choice(["a", "a", "a", "a", "b", "é", None]) for _ in texts]
    df = docs(spark, texts, None, sources)
    rows = mixing.mix(df, shard_rows=64).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(df.repartition(3), shard_rows=64).collect()))
    size = [len((t or "").encode().split()) for t in texts]
    sums = collections.Counter()
    for s, n in zip(sources, size, strict=True):
        sums[s] += n
    taken, target = collections.Counter(), {}
    for x in rows:
        i = x["doc_id"]
        assert x["size"] == size[i] and x["source_size"] == sums[sources[i]] and 0 <= x["taken"] <= 3 * size[i]
        taken[sources[i]] += x["taken"]
        target[sources[i]] = x["target"]
    names = ["a", "b", "é", None]
    expect = mixing.targets(np.array([sums[s] for s in names]), np.array([1, 2, 3, 1]))
    for s, t in zip(names, expect, strict=True):
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= max(64, 0.03 * t)
    made = collections.Counter()
    for x in mixing.sample_rows(df.union(df.limit(5)), shard_rows=64).collect():
        made["n"] += len(x["text"].encode().split())
        assert x["n_chars"] == len(x["text"])
    total = sum(x["taken"] for x in mixing.mix(df.union(df.limit(5)), shard_rows=64).collect())
    assert abs(made["n"] - total) <= 0.02 * total
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.sample_rows(docs(spark, [])).count() == 0


M64 = (1 << 64) - 1


def plain_levels(data):
    """The entropy level of each run of 32 bytes, one by one."""
    f = [0, *(round(c * math.log2(c) * 2**24) for c in range(1, 33))]
    out = []
    for k in range(len(data) - 31):
        h = 5 - sum(f[c] for c in collections.Counter(data[k : k + 32]).values()) / (32 * 2**24)
        out.append(round(h / 5 * 127))
    return out


def plain_digest(text, counts):
    """Filters as whole numbers, straight from the definition."""
    data = text.encode()
    if not data:
        return []
    room = data.ljust(32, b"\0")
    order = sorted(range(128), key=lambda x: (counts[x], x))
    rank = {x: i for i, x in enumerate(order)}
    p = [rank[x] for x in plain_levels(room)]
    if len(p) < 32:
        chosen = range(len(p))
    else:
        votes = collections.Counter()
        for k in range(len(p) - 31):
            votes[min(range(k, k + 32), key=lambda j: (p[j], j))] += 1
        need = min(8, max(votes.values()))
        chosen = sorted(k for k, v in votes.items() if v >= need)
    seen = {}
    for k in chosen:
        h = min(len(data), 32)
        for j in range(0, 32, 8):
            h = (h ^ int.from_bytes(room[k + j : k + j + 8], "little")) * 0x9FB21C651E98DF25 & M64
            h ^= h >> 29
        h = h * 0xD6E8FEB86659FD93 & M64
        seen.setdefault(h ^ h >> 32)
    features = list(seen)
    return [{(h >> 11 * j) & 2047 for h in features[k : k + 128] for j in range(4)} for k in range(0, len(features), 128)]


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    best = lambda x, others: max(0.0, min(1.0, max((len(x & y) - len(x) * len(y) / 2048) / (len(x) - len(x) * len(y) / 2048) for y in others)))
    return (sum(best(x, b) * len(x) for x in a) + sum(best(y, a) * len(y) for y in b)) / (sum(map(len, a)) + sum(map(len, b)))


def test_fingerprints(spark):
    r = random.Random(15)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(900)]
    texts = ODD + [prose(r, r.randint(100, 900), words) for _ in range(40)]
    texts += [texts[-1], texts[-1]]
    got = {x["doc_id"]: x for x in digest.fingerprints(docs(spark, texts)).collect()}
    counts = collections.Counter(x for t in texts if t for x in plain_levels(t.encode().ljust(32, b"\0")))
    assert [counts[k] for k in range(128)] == digest.entropy_counts(docs(spark, texts)).tolist()
    n = len(texts)
    bits = lambda text: [set(np.flatnonzero(np.unpackbits(x)).tolist()) for x in digest.digest_of(text)]
    for i in range(n):
        t, after = texts[i] or "", texts[(i + 1) % n] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = (plain_digest(x, counts) for x in (t, edited, after))
        g = got[i]
        assert g["n_chars"] == len(t) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (bits(g["fingerprint"]), bits(g["edited_fingerprint"])) == (a, b)
        assert g["near_edited"] == pytest.approx(plain_likeness(a, b), abs=1e-5) and g["near_next"] == pytest.approx(plain_likeness(a, c), abs=1e-5)
    body = range(len(ODD), n - 3)
    assert 0.35 < np.mean([got[i]["near_edited"] for i in body]) < 0.65 and np.mean([got[i]["near_next"] for i in body]) < 0.1
    assert got[n - 2]["near_next"] == 1.0
    one = digest.fingerprints(docs(spark, ["just one text here, all alone"])).first()
    assert one["near_next"] == 1.0
    assert digest.fingerprints(docs(spark, [])).count() == 0


def test_fingerprints_of_text_ids(spark):
    """Ids of any kind: the next row follows in the order of the ids."""
    rows = [("b" * (k % 5) + str(k), f"text {k} " * 30) for k in range(60)] + [(None, "x")]
    got = {x["doc_id"]: x["edited_sha256"] for x in digest.fingerprints(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or ""))
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        assert got[i] == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()


def test_fingerprints_repeated_and_null_ids(spark):
    rows = [(1, "b"), (1, "a"), (None, "x"), (2, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x["doc_id"], x["n_chars"]): x for x in digest.fingerprints(df).collect()}
    assert len(got) == 3 and digest.fingerprints(df).count() == 4


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(16)
    texts, langs = lang_rows(r, 120)
    texts = [t + " " + prose(r, 30) for t in texts]
    texts += [texts[3], texts[4], "", "123 456", None]
    df = docs(spark, texts, langs + ["aa", "bb", None, "cc", None]).select("doc_id", "text", "lang", "source", "n_chars")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    at = df
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        at = stage(spark, at, str(tmp_path))
        assert at.columns == df.columns and at.schema.simpleString() == df.schema.simpleString(), name
        at.write.parquet(str(tmp_path / f"s{k}"))
        at = spark.read.parquet(str(tmp_path / f"s{k}"))
        ids = {x["doc_id"] for x in at.collect()}
        if name == "language_id":
            assert ids == set(range(122))
        if name in ("line_dedup", "simhash_near_dedup"):
            assert ids == set(range(120))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {x["doc_id"] for x in out} <= set(range(120))
