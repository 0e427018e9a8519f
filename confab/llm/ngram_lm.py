"""Interpolated modified Kneser-Ney model, counted in Spark, kept as sorted hash arrays that workers map into memory.

Order 2. Words and word pairs are known by hashes (48 and 64 bits). A slice of texts becomes its distinct pairs with
counts, so a frequent word or pair leaves a slice once; slices' pairs meet by ranges of the pair hash, words' sums by
ranges of the word hash. Each range is written once, sorted, to the shared folder: the ranges on end are one sorted
array. To score, a worker maps the files and looks up a slice's distinct pairs and words in hash order."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, by_text, parallelism, remove, shared_folder, small_batches, text_slices

WORD_BITS = 48
RANGE_BYTES = 1 << 29  # of input for each range of hashes
BEGIN, END = 1, 2  # hashes of the context before the first word and of the token behind the last
#: what is stored of a word: its count, as a context its count and how many pairs it begins with counts 1, 2, 3 or more, and how many words precede it
FIELDS = ("count", "context", "n1", "n2", "n3", "before")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts on end, each text's followed by END, and the texts' token counts.

    Words are runs without ASCII white space with A-Z in lower case."""
    from xxhash import xxh3_64_intdigest

    split = [x.encode("utf-8", "surrogatepass").lower().split() for x in texts]
    n = np.array([len(ws) + 1 for ws in split], np.int64)
    h = np.empty(int(n.sum()), np.uint64)
    ends = np.cumsum(n) - 1
    word = np.ones(len(h), bool)
    word[ends] = False
    h[word] = np.fromiter((x for ws in split for x in map(xxh3_64_intdigest, ws)), np.uint64, len(h) - len(split))
    h >>= np.uint64(64 - WORD_BITS)
    h[ends] = END
    return h, n


def contexts(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The token before each token (BEGIN before a text's first)."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[np.cumsum(n) - n] = BEGIN
    return before


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a + np.uint64(0x632BE59BD9B4E019)) * _M1
    x ^= x >> np.uint64(29)
    x = (x + b) * _M2
    x ^= x >> np.uint64(32)
    x *= _M1
    return x ^ (x >> np.uint64(29))


def _range(h: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Which of n equal ranges of the hash; ascending with the hash."""
    return ((h >> np.uint64(bits - 32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Counts in four bytes each, or in eight where one needs them."""
    return x.astype("<u4" if int(x.max(initial=0)) < 1 << 32 else "<u8")


def _small(*columns: np.ndarray) -> bytes:
    flat = _narrow(np.concatenate(columns))
    return bytes([flat.itemsize]) + zlib.compress(flat.tobytes(), 1)


def _from_small(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"<u{data[0]}").reshape(columns, -1).astype(np.int64)


def _write(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """One file: the number of rows and of arrays, each array's bytes a row, then the arrays. Another attempt at a task writes the same bytes; a rename makes it whole."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with where.open_output_stream(part) as out:
        out.write(np.array([len(arrays[0]), len(arrays), *[x.itemsize for x in arrays]], "<u8").tobytes())
        for x in arrays:
            out.write(np.ascontiguousarray(x).tobytes())
    where.move(part, f"{path}/{name}")


def _map(folder: str, name: str) -> list[np.ndarray]:
    """The arrays of a file, mapped into memory. A file of a remote store is first copied to a nameless local one."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(folder)
    if isinstance(where, fs.LocalFileSystem):
        raw = np.memmap(f"{path}/{name}", np.uint8, "r")
    else:
        copy = tempfile.TemporaryFile()
        with where.open_input_stream(f"{path}/{name}") as source:
            while block := source.read(1 << 24):
                copy.write(block)
        copy.flush()
        raw = np.memmap(copy, np.uint8, "r")
    n, columns = raw[:16].view("<u8").tolist()
    at, out = 16 + 8 * columns, []
    for width in raw[16:at].view("<u8").tolist():
        size = n * width
        out.append(raw[at : at + size].view(f"<u{width}"))
        at += size
    return out


@dataclass
class Model:
    folder: str
    ranges: int
    totals: dict[str, int]

    def __post_init__(self):
        t = self.totals
        self.vocabulary, self.train_tokens, self.types = t["words"], t["tokens"], t["pairs"]
        self.pair_cut = _discounts([t[f"pairs{k}"] for k in (1, 2, 3, 4)])
        self.word_cut = _discounts([t[f"words{k}"] for k in (1, 2, 3, 4)])
        more = t["before_words"] - t["words1"] - t["words2"]
        self.rest = float(self.word_cut[1] * t["words1"] + self.word_cut[2] * t["words2"] + self.word_cut[3] * more) / self.types if self.types else 1.0

    def remove(self, spark: SparkSession) -> None:
        """Deletes the model's files, once nothing is to be scored any more."""
        remove(spark, self.folder)

    def probability(self, count: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """p(word | context) from the pair's count and the stored fields (rows FIELDS) of both."""
        before = word[5]
        low = self.rest / (self.vocabulary + 1)
        if self.types:
            low = low + np.maximum(before - self.word_cut[np.minimum(before, 3)], 0) / self.types
        c, (d1, d2, d3) = context[1], self.pair_cut[1:]
        seen = np.maximum(c, 1)
        high = np.maximum(count - self.pair_cut[np.minimum(count, 3)], 0) / seen
        back = np.where(c > 0, (d1 * context[2] + d2 * context[3] + d3 * context[4]) / seen, 1.0)
        return high + back * low


def _discounts(n: list[int]) -> np.ndarray:
    """Chen and Goodman's discounts for counts 0, 1, 2 and 3 or more, from how many have counts 1 to 4; where a count
    is missing or a discount leaves (0, its count), half its count."""
    d = np.array([0.0, 0.5, 1.0, 1.5])
    if n[0] and n[1]:
        y = n[0] / (n[0] + 2 * n[1])
        for k in (1, 2, 3):
            if n[k - 1] and n[k]:
                x = k - (k + 1) * y * n[k] / n[k - 1]
                if 0 < x < k:
                    d[k] = x
    return d


def _pairs(rows: DataFrame, ranges: int, text: str) -> DataFrame:
    """range, data: of each slice its distinct pairs by first word, with counts."""

    def run(batches):
        for found in text_slices(batches, 4_000_000):
            h, n = tokens(found)
            a = contexts(h, n)
            order = np.lexsort((h, a))
            a, h = a[order], h[order]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (h[1:] != h[:-1])]))
            count = np.diff(np.append(first, len(a)))
            a, h = a[first], h[first]
            where = _range(pair_hash(a, h), 64, ranges)
            order = np.argsort(where, kind="stable")
            cut = np.searchsorted(where[order], np.arange(ranges + 1))
            out, at = [], []
            for k in range(ranges):
                o = order[cut[k] : cut[k + 1]]
                if o.size:
                    x = a[o]
                    head = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                    parts = [_six(x[head]), _small(np.diff(np.append(head, len(x)))), _six(h[o]), _small(count[o])]
                    out.append(np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts))
                    at.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(out, pa.binary())], names=["range", "data"])

    small_batches(rows.sparkSession)
    return arrow(rows.select(text), run, "range int, data binary")


def _cut(data: bytes, n: int) -> list[bytes]:
    sizes = np.frombuffer(data[: 4 * n], "<u4")
    ends = 4 * n + np.cumsum(sizes.astype(np.int64))
    return [data[int(e) - int(s) : int(e)] for e, s in zip(ends, sizes, strict=True)]


def _sum_by(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], [np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]


def fit(rows: DataFrame, text_col: str = "text", folder: str | None = None) -> Model:
    """Counts all rows' whole texts (null: empty) and writes the model's files to a new place below the shared folder
    (spark.checkpoint.dir unless given). Only sums (one row) reach the driver."""
    spark = rows.sparkSession
    # a range is held by one task, so there are more of them where the input is large (a size of 2^60 stands for unknown)
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    ranges = max(parallelism(spark), size // RANGE_BYTES if size < 1 << 60 else 0)
    if folder is None:
        folder = shared_folder(spark)
    folder = f"{folder.rstrip('/')}/ngrams-{uuid.uuid4().hex}"

    def pairs(batches):
        groups: dict[int, list] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                head, runs, second, count = _cut(data.as_py(), 4)
                groups.setdefault(k, []).append((np.repeat(_from_six(head), _from_small(runs, 1)[0]), _from_six(second), _from_small(count, 1)[0]))
        names = ["range", "kind", "data"]
        for k in list(groups):
            a, b, c = (np.concatenate(x) for x in zip(*groups.pop(k), strict=True))
            h = pair_hash(a, b)
            order = np.argsort(h, kind="stable")
            h = h[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            c, a, b, h = np.add.reduceat(c[order], first), a[order][first], b[order][first], h[first]
            _write(folder, f"pairs-{k}", [h, _narrow(c)])
            one = np.ones(len(c), np.int64)
            wa, va = _sum_by(a, c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c >= 3).astype(np.int64))
            wb, vb = _sum_by(b, c, one)
            nothing = lambda w: np.zeros(len(w), np.int64)
            w, v = _sum_by(np.concatenate([wa, wb]), *(np.concatenate([x, y]) for x, y in zip([nothing(wa), *va, nothing(wa)], [vb[0], *[nothing(wb)] * 4, vb[1]], strict=True)))
            cut = np.searchsorted(_range(w, WORD_BITS, ranges), np.arange(ranges + 1))
            out = [(i, 0, _pack(w[s:e], [x[s:e] for x in v])) for i, (s, e) in enumerate(zip(cut, cut[1:], strict=False)) if e > s]
            out.append((k, 1, np.array([len(c), *[(c == j).sum() for j in (1, 2, 3, 4)]], "<u8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=names)

    sums = ["pairs", *[f"pairs{j}" for j in (1, 2, 3, 4)], "tokens", "words", "before_words", *[f"words{j}" for j in (1, 2, 3, 4)]]

    def words(batches):
        groups: dict[int, list] = {}
        total = np.zeros(len(sums), np.int64)
        for batch in batches:
            for k, kind, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if kind:
                    total[:5] += np.frombuffer(data, "<u8").astype(np.int64)
                else:
                    groups.setdefault(k, []).append(_unpack(data))
        for k in list(groups):
            part = groups.pop(k)
            w, v = _sum_by(np.concatenate([x[0] for x in part]), *(np.concatenate([x[1][j] for x in part]) for j in range(len(FIELDS))))
            _write(folder, f"words-{k}", [w, *map(_narrow, v)])
            before = v[5]
            total[5:] += np.array([v[0].sum(), (v[0] > 0).sum(), (before > 0).sum(), *[(before == j).sum() for j in (1, 2, 3, 4)]])
        yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in total], names=sums)

    made = arrow(_pairs(rows, ranges, text_col).repartitionById(ranges, F.col("range")), pairs, "range int, kind int, data binary")
    made = arrow(made.repartitionById(ranges, F.col("range")), words, ", ".join(f"{x} bigint" for x in sums))
    row = made.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in sums]).first()
    return Model(folder, ranges, row.asDict())


def _pack(w: np.ndarray, v: list[np.ndarray]) -> bytes:
    parts = [_six(w), _small(*v)]
    return np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    w, v = _cut(data, 2)
    return _from_six(w), _from_small(v, len(FIELDS))


class Lookup:
    """The files of a model, mapped by a worker."""

    def __init__(self, folder: str, ranges: int):
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(folder)
        there = {os.path.basename(x.path) for x in where.get_file_info(fs.FileSelector(path, allow_not_found=True))}
        self.ranges = ranges
        self.pairs = [_map(folder, f"pairs-{k}") if f"pairs-{k}" in there else None for k in range(ranges)]
        self.words = [_map(folder, f"words-{k}") if f"words-{k}" in there else None for k in range(ranges)]

    def find(self, sorted_keys: np.ndarray, files: list, bits: int, fields: int) -> np.ndarray:
        out = np.zeros((fields, len(sorted_keys)), np.int64)
        cut = np.searchsorted(_range(sorted_keys, bits, self.ranges), np.arange(self.ranges + 1))
        for k, (s, e) in enumerate(zip(cut, cut[1:], strict=False)):
            if e > s and files[k] is not None and len(files[k][0]):
                keys = sorted_keys[s:e]
                at = np.minimum(np.searchsorted(files[k][0], keys), len(files[k][0]) - 1)
                hit = files[k][0][at] == keys
                for j in range(fields):
                    out[j, s:e] = np.where(hit, files[k][1 + j][at], 0)
        return out


@lru_cache(2)
def _lookup(folder: str, ranges: int) -> Lookup:
    return Lookup(folder, ranges)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score (log10 of the whole text's probability), perplexity.

    A null text counts as empty: its one token is the end. base_score is the add-half unigram estimate over the same
    counts. Repeated rows give a row each; an empty table gives none; other columns aren't read. Words unknown to
    the model share one place of its vocabulary. Without training texts every token has the probability of that place."""
    kind = dict(docs.dtypes)[id_col]

    def make(rest, found):
        table = _lookup(model.folder, model.ranges)
        h, n = tokens(found)
        a = contexts(h, n)
        words, back = np.unique(np.concatenate([h, a]), return_inverse=True)
        fields = table.find(words, table.words, WORD_BITS, len(FIELDS))
        pairs, pair_back = np.unique(pair_hash(a, h), return_inverse=True)
        count = table.find(pairs, table.pairs, 64, 1)[0][pair_back]
        of = fields[:, back]
        p = np.log10(model.probability(count, of[:, len(h) :], of[:, : len(h)]))
        c = of[0, : len(h)]
        base = np.log10((c + 0.5) / (model.train_tokens + 0.5 * (model.vocabulary + 1)))
        starts = np.cumsum(n) - n
        total = np.add.reduceat(p, starts)
        return {
            id_col: rest[id_col],
            "n_tokens": n,
            "n_known": np.add.reduceat((c > 0).astype(np.int64), starts),
            "train_tokens": np.full(len(n), model.train_tokens, np.int64),
            "base_score": np.add.reduceat(base, starts),
            "score": total,
            "perplexity": 10.0 ** np.minimum(-total / n, 300),
        }

    return by_text(docs, [id_col], f"{id_col} {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double", make, text_col)


