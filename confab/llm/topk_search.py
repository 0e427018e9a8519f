"""Exact top-k by inner product with multi-resolution segment statistics.

Vectors are cut into segments. With means m and deviations s of a segment of w components, the squared distance of two
vectors is at least the sum of w * ((m - m')^2 + (s - s')^2), so their inner product is at most the sum of
w * (m * m' + s * s'). Bounds run from coarse to fine: one, four and sixteen segments, then segments of two components of
which the first half is cut to single ones. At each level only candidates whose bound reaches a query's threshold (its
k-th best score so far) go on, and exact products are computed for the survivors of all levels alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import arrow

#: Segments at each level; the finest is twos, half of them cut to ones.
LEVELS = (1, 4, 16)


def quantise(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their vectors as floor(scale * x): shorter ones are filled with zeros."""
    lists = column.cast(pa.list_(pa.float64()))
    size = np.array([-1 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()], np.int64)
    flat = lists.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    row = np.repeat(np.arange(len(size)), np.maximum(size, 0))
    bad = np.zeros(len(size), bool)
    bad[row[~np.isfinite(values)]] = True
    ok = (size >= 0) & ~bad
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    at = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0), np.maximum(size, 0))
    use = ok[row]
    out[row[use], at[use]] = np.floor(scale * values[use]).astype(np.int64)
    return np.flatnonzero(ok), out[ok]


def edges(d: int, level: int) -> list[int]:
    """Where the segments of a level begin and end; the last level is the finest."""
    if level < len(LEVELS):
        n = min(LEVELS[level], d)
        return [d * i // n for i in range(n + 1)] if n else [0]
    half = d // 2
    return [*range(half), *range(half, d, 2), d]


def features(x: np.ndarray, at: list[int]) -> np.ndarray:
    """Means and deviations of the segments, weighed so that the inner product of two rows bounds that of the vectors."""
    parts = []
    for a, b in zip(at, at[1:], strict=False):
        part = x[:, a:b]
        parts.append(part.mean(1) * np.sqrt(b - a))
        if b - a > 1:
            parts.append(part.std(1) * np.sqrt(b - a))
    return np.stack(parts, 1).astype(np.float32) if parts else np.zeros((len(x), 1), np.float32)


#: Over this share of alive pairs the bounds of a block cost less than those of the pairs.
DENSE = 0.05
#: A query's first threshold is the k-th best exact score among this many times k candidates with the highest bounds.
PILOT = 8
ROWS, COLUMNS = 256, 4096


def _products(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows."""
    out = np.empty(len(rows), a.dtype)
    for k in range(0, len(rows), 65536):
        out[k : k + 65536] = np.einsum("ij,ij->i", a[rows[k : k + 65536]], b[cols[k : k + 65536]])
    return out


def _best(r: np.ndarray, c: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (row, candidate) with scores each row's k best, by score and smaller id."""
    order = np.lexsort((ids[c], -score, r))
    r, c, score = r[order], c[order], score[order]
    keep = np.arange(len(r)) - np.searchsorted(r, np.arange(n))[r] < k
    return r[keep], c[keep], score[keep]


def search(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, alive: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's k best by score, then smaller id (all, if fewer).

    alive, if given, gets the pairs that reached each level added up: all, behind each level."""
    n = len(x)
    if not len(q) or not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    d = max(q.shape[1], x.shape[1])
    q, x = (np.pad(v, ((0, 0), (0, d - v.shape[1]))).astype(np.int64) for v in (q, x))
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    levels = [edges(d, i) for i in range(len(LEVELS) + 1)]
    fq, fx = [features(qf, at) for at in levels], [features(xf, at) for at in levels]
    # what rounding of single precision can take off a bound
    slack = 1e-5 * np.sqrt((qf * qf).sum(1)) * np.sqrt((xf * xf).sum(1).max()) + 1e-3
    # whole numbers up to 2^53 are exact in doubles; larger ones stay integers
    exact = (qf, xf) if np.abs(qf).max(initial=0) * np.abs(xf).max(initial=0) * max(d, 1) < 2**53 else (q, x)
    out = []
    for b in range(0, len(q), ROWS):
        rows = np.arange(b, min(b + ROWS, len(q)))
        own = exact[0][rows]
        threshold = np.full(len(rows), -np.inf)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for at in range(0, n, COLUMNS):
            here = slice(at, min(at + COLUMNS, n))
            many = min(here.stop - at, PILOT * k)
            if at == 0 and here.stop - at > many:
                pilot = np.argpartition(-(fq[-2][rows] @ fx[-2][here].T), many - 1, axis=1)[:, :many]
                found = _products(own, exact[1], np.repeat(np.arange(len(rows)), many), pilot.ravel()).reshape(len(rows), many)
                threshold = np.partition(found, many - k, axis=1)[:, many - k].astype(np.float64)
            least = (threshold - slack[rows]).astype(np.float64)
            mask = fq[0][rows] @ fx[0][here].T >= least[:, None]
            counted = [mask.size, np.count_nonzero(mask)]
            r = None
            for f, g in zip(fq[1:], fx[1:], strict=True):
                if r is None and counted[-1] > DENSE * mask.size:
                    mask &= f[rows] @ g[here].T >= least[:, None]
                    counted.append(np.count_nonzero(mask))
                else:
                    r, c = np.nonzero(mask) if r is None else (r, c)
                    go = _products(f[rows], g[here], r, c) >= least[r]
                    r, c = r[go], c[go]
                    counted.append(len(r))
            r, c = np.nonzero(mask) if r is None else (r, c)
            if alive is not None:
                alive += np.array(counted)
            score = _products(own, exact[1][here], r, c).astype(np.int64)
            good = score >= threshold[r]
            best = _best(*(np.concatenate(v) for v in zip(best, (r[good], c[good] + at, score[good]), strict=True)), ids, len(rows), k)
            last = np.searchsorted(best[0], np.arange(len(rows)), "right") - 1
            full = np.bincount(best[0], minlength=len(rows)) >= k
            threshold[full] = np.maximum(threshold[full], best[2][last[full]])
        out.append((rows[best[0]], best[1], best[2]))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, block: int = 16384, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each query: its k best among all other rows of vectors.

    queries are rows of vectors. Components become floor(scale * x), the score is the integer inner product, ties go to
    the smaller id. Rows whose vector is null or holds a null or non-finite component, and rows without an id, take no
    part; an empty vector scores 0 with any other. Queries equal in id and vector are answered once; a query's own row is
    left out once, so another row of its id is a candidate. Vectors of other lengths are filled with zeros. An empty
    table gives none; other columns aren't read.

    Candidates are dealt to blocks of about block rows by a hash of the id, queries to blocks of an eighth of that; each
    cell of the two block grids is one unit of work, which sees its candidates part by part with thresholds that rise, and
    gives k + 1 rows for a query. Components travel in as few bytes as hold them."""
    n_c, n_q = max(1, -(-vectors.count() // block)), max(1, -(-queries.count() * 8 // block))

    def deal(own: int, others: int, query: bool):
        def run(batches):
            for batch in batches:
                rows, data = quantise(batch.column(1), scale)
                ids = batch.column(0).to_pylist()
                known = np.array([ids[i] is not None for i in rows], bool)
                rows, data = rows[known], data[known]
                ids = np.array([ids[i] for i in rows], np.int64)
                place = (((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(own)).astype(np.int64)
                for p in np.unique(place).tolist():
                    on = place == p
                    part = data[on]
                    kind = next(t for t in ("<i1", "<i2", "<i4", "<i8") if not part.size or np.iinfo(t).min <= part.min() and part.max() <= np.iinfo(t).max)
                    head = np.array([data.shape[1], np.dtype(kind).itemsize], np.int64).tobytes()
                    blob = (ids[on].tobytes(), head + part.astype(kind).tobytes())
                    cells = [o * n_q + p if query else p * n_q + o for o in range(others)]
                    for i in range(0, len(cells), 64):
                        part = cells[i : i + 64]
                        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([query] * len(part)), pa.array([blob[0]] * len(part), pa.binary()), pa.array([blob[1]] * len(part), pa.binary())], names=["cell", "query", "ids", "data"])

        return run

    schema = "cell int, query boolean, ids binary, data binary"
    given = arrow(vectors.select(F.col(id_col).cast("bigint"), vector_col), deal(n_c, n_q, False), schema)
    asked = arrow(queries.select(F.col(id_col).cast("bigint"), vector_col), deal(n_q, n_c, True), schema)

    def joined(parts: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for i, d in parts:
            i, (width, size) = np.frombuffer(i, np.int64), np.frombuffer(d[:16], np.int64).tolist()
            found.append((i, np.frombuffer(d[16:], f"<i{size}").reshape(len(i), width).astype(np.int64)))
        width = max(d.shape[1] for _, d in found)
        return np.concatenate([i for i, _ in found]), np.concatenate([np.pad(d, ((0, 0), (0, width - d.shape[1]))) for _, d in found])

    names = ["query_id", "copy", "own", "vec_id", "score"]

    def work(batches):
        cells: dict[tuple[int, bool], list] = {}
        for batch in batches:
            for c, q, i, d in zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True):
                cells.setdefault((c, q), []).append((i, d))
        for c in sorted({c for c, _ in cells}):
            if (c, True) not in cells or (c, False) not in cells:
                continue
            (qi, q), (xi, x) = joined(cells.pop((c, True))), joined(cells.pop((c, False)))
            # equal queries are one; a hash of the vector tells queries of one id apart
            both = np.unique(np.concatenate([qi[:, None], q], 1), axis=0)
            qi, q = both[:, 0], both[:, 1:]
            copy = np.array([_mark(v) for v in q], np.int64)
            r, s, score = search(q, x, xi, k + 1)
            own = (q * q).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (qi[r], copy[r], own[r], xi[s], score)], names=names)

    cells = arrow(given.union(asked).repartitionById(n_c * n_q, F.col("cell")), work, ", ".join(f"{x} bigint" for x in names))
    by = W.partitionBy("query_id", "copy")
    # the own row is (query_id, own): one such row is left out
    mine = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    ranked = cells.withColumn("n", F.row_number().over(by.orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    ranked = ranked.withColumn("self", F.min(F.when(mine, F.col("n"))).over(by))
    ranked = ranked.where(F.col("self").isNull() | (F.col("n") != F.col("self"))).withColumn("rank", F.col("n") - F.when(F.col("n") > F.col("self"), 1).otherwise(0))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _mark(v: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return int(np.array([xxh3_64_intdigest(np.trim_zeros(v, "b").tobytes())], np.uint64).view(np.int64)[0])
