"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (proximal, per coordinate) under L1 and L2 penalties, then calibrated with a
temperature on rows kept out of training."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, by_text, slices, small_batches

UNDETERMINED = "und"
MIX = np.uint32(2654435761)
RARITY = 100  # a feature of fewer than one in so many texts of a language is a rarity there


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter, for all of them."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str, bits: int, order: int = 3) -> np.ndarray:
    """Hashed character n-grams of orders 1 to order: lower case, letters kept, runs of all else one blank; no n-gram
    has a blank inside. Empty if the text has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.where(letter, codes, np.uint32(32))[keep]
    c = np.concatenate([np.array([32], np.uint32), c, np.array([32], np.uint32)])
    blank = c == 32
    out, h, inside = [], c * MIX, np.zeros(len(c), bool)
    out.append(h[~blank])
    for n in range(2, order + 1):
        # inside: a blank among the characters that are neither first nor last
        inside = inside[:-1] | (blank[n - 2 : len(c) - 1] if n > 2 else False)
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * MIX + c[n - 1 :] * np.uint32(40503)
        both = blank[: len(c) - n + 1] & blank[n - 1 :]
        out.append(h[~(inside | both)] * MIX + np.uint32(n))
    h = np.concatenate(out)
    h ^= h >> np.uint32(16)
    h *= MIX
    return (h >> np.uint32(32 - bits)).astype(np.int64)


@dataclass
class LanguageModel:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x classes
    bias: np.ndarray
    temperature: float
    bits: int
    known: np.ndarray | None = None  # features that are no rarity in some language learned

    def logits(self, counts: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(counts)
        x = counts[at] * self.idf[at]
        return (x / max(np.sqrt((x * x).sum()), 1e-12)) @ self.weights[at] + self.bias

    def known_share(self, text: str) -> float:
        """Which share of a text's n-grams the languages learned have too; 0 without letters. A text of another language, or
        of junk, may be much like one of them by its known n-grams, but has others."""
        return self.known_among(ngrams(text, self.bits))

    def known_among(self, found: np.ndarray) -> float:
        return float(self.known[found].mean()) if found.size and self.known is not None else float(found.size > 0)

    def predict(self, text: str) -> tuple[str, float]:
        return self.predict_among(ngrams(text, self.bits))

    def predict_among(self, found: np.ndarray) -> tuple[str, float]:
        if not self.classes or not found.size:
            return UNDETERMINED, 0.0
        p = softmax(self.logits(np.bincount(found, minlength=1 << self.bits)) / self.temperature)
        k = int(p.argmax())
        return self.classes[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Ftrl:
    """FTRL-proximal for softmax regression: z and n for each weight; L1 leaves weights at exactly 0."""

    def __init__(self, features: int, classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))  # the last row is the bias
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        rows, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(rows)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[rows]
        after = n + g * g
        self.z[rows] += g - (np.sqrt(after) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = after


def document_frequencies(docs: DataFrame, bits: int, text_col: str = "text", lang_col: str | None = None) -> dict[str | None, np.ndarray]:
    """In how many texts of each language (of all, as None, without lang_col) each feature is, over all rows; partial sums
    leave each task as at most 2^bits rows for a language."""
    size = 1 << bits
    small_batches(docs.sparkSession)
    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")

    def run(batches):
        total: dict[str | None, np.ndarray] = {}
        for batch in batches:
            for part, found in slices(iter([batch])):
                for of, x in zip(part.column(0).to_pylist(), found, strict=True):
                    if of not in total:
                        total[of] = np.zeros(size, np.int64)
                    total[of] += np.bincount(ngrams(x, bits), minlength=size) > 0
        for of, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([of] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "feature", "n"])

    out: dict[str | None, np.ndarray] = {}
    rows = docs.select(lang.alias("lang"), F.col(text_col).alias("text"))
    for r in arrow(rows, run, "lang string, feature int, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r["lang"], np.zeros(size, np.int64))[r["feature"]] = r["n"]
    return out


def fit(docs: DataFrame, train: Column, sample: int = 2400, bits: int = 14, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learns from rows where train holds and the language isn't null.

    Document frequencies cover all such rows. Weights and temperature are fitted on a bounded sample of about `sample`
    rows (twice that at most, also where one id has very many), as many for each language as there are (chosen by a hash of
    the id), four fifths for the weights. No such rows give a
    model without classes, which says `und`."""
    size = 1 << bits
    rows = docs.where(train & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    classes = sorted(per)
    if not classes:
        return LanguageModel([], np.ones(size), np.zeros((size, 0)), np.zeros(0), 1.0, bits)
    of = document_frequencies(rows, bits, lang_col="lang")
    df = sum(of.values(), np.zeros(size, np.int64))
    total = sum(per.values())
    known = np.zeros(size, bool)
    for lang, n in of.items():
        known |= n >= max(1, per[lang] / RARITY)
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    each = max(1, sample // len(classes))
    share = F.coalesce(*[F.when(F.col("lang") == c, F.lit(min(1.0, each / per[c]))) for c in classes])
    mark = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30))
    made = by_text(
        rows.where(mark < share * (1 << 30)),
        ["id", "lang"],
        "id " + dict(rows.dtypes)["id"] + ", lang string, at binary, n binary",
        lambda rest, found: rest | dict(zip(("at", "n"), _packed(found, bits), strict=True)),
    )
    seen = sorted(((r["lang"], bytes(r["at"]), bytes(r["n"])) for r in made.drop("id").orderBy(F.xxhash64("at", "lang"), "lang", "at", "n").limit(2 * sample).collect()), key=lambda r: hash_of(r[1]))
    examples = []
    for lang, at, n in seen:
        at, n = np.frombuffer(at, "<u4").astype(np.int64), np.frombuffer(n, "<u4")
        if at.size:
            x = n * idf[at]
            examples.append((at, x / np.sqrt((x * x).sum()), classes.index(lang)))
    kept, out = examples[len(examples) // 5 :], examples[: len(examples) // 5]
    model = Ftrl(size, len(classes), alpha, beta, l1, l2)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(kept)):
            model.learn(*kept[k])
    w = model.weights()
    fitted = LanguageModel(classes, idf, w[:-1].copy(), w[-1].copy(), 1.0, bits, known)
    if out:
        z = np.array([x @ fitted.weights[at] + fitted.bias for at, x, _ in out])
        fitted.temperature = temperature(z, np.array([y for _, _, y in out]))
    return fitted


def hash_of(data: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(data, 3)


def _packed(found: list[str], bits: int) -> tuple[list[bytes], list[bytes]]:
    at, n = [], []
    for x in found:
        c = np.bincount(ngrams(x, bits), minlength=1 << bits)
        k = np.flatnonzero(c)
        at.append(k.astype("<u4").tobytes())
        n.append(c[k].astype("<u4").tobytes())
    return at, n


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The T with the least log loss of softmax(z / T), by golden section over log T in [log 0.02, log 20].

    Labels are smoothed by one part in the number of rows, so that separable rows don't drive T to its bound."""
    eps = 1.0 / (len(y) + 1)

    def loss(t: float) -> float:
        p = softmax(z / np.exp(t))
        q = np.full_like(p, eps / p.shape[1])
        q[np.arange(len(y)), y] += 1 - eps
        return float(-(q * np.log(np.maximum(p, 1e-300))).sum(1).mean())

    a, b, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def predict(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the columns in keep, lang_pred and score (calibrated probability, 0 to 1) of each row's whole text.

    Null texts and texts without a letter are `und` with score 0. Repeated rows give a row each; an empty table gives
    none; other columns aren't read. The model (features x languages) is the only thing sent to workers."""
    kinds = dict(docs.dtypes)
    columns = [id_col, *keep]

    def make(rest, found):
        said = [model.predict(x) for x in found]
        return rest | {"lang_pred": pa.array([a for a, _ in said], pa.string()), "score": np.array([b for _, b in said], np.float64)}

    return by_text(docs, columns, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", lang_pred string, score double", make, text_col)




def select_rows(docs: DataFrame, model: LanguageModel, least: float = 0.0, least_known: float = 0.0, text_col: str = "text") -> DataFrame:
    """Rows of docs, with all their columns (of any name), that aren't `und`, whose prediction scores least or more, and of
    whose n-grams the model knows a share of least_known or more. A
    model without classes can't tell languages and keeps every row whose text has a letter. Null and empty texts go; very
    long ones count whole; repeated rows share their fate; an empty table gives none."""

    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part, found in slices(iter([batch]), text_col):
                keep = []
                for x in found:
                    grams = ngrams(x, model.bits)
                    lang, score = model.predict_among(grams)
                    good = lang != UNDETERMINED and score >= least and model.known_among(grams) >= least_known
                    keep.append(good if model.classes else grams.size > 0)
                yield part.filter(pa.array(keep, pa.bool_()))

    return arrow(docs, run, docs.schema)
