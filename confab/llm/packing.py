"""Packing documents into sequences of a fixed number of tokens: dominance reduction, then best fit."""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import arrow, by_text, durable

#: The form of a tokenizer file that the table of units is made for: what happens to a text before the vocabulary is met.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BLANK, LETTER, DIGIT, MARK, OTHER = range(5)
KEY_BYTES = 16


def _kinds() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[:128] = MARK
    out[ord("'")] = OTHER  # an apostrophe can join the letters behind it
    out[[9, 10, 11, 12, 13, 32]] = BLANK
    out[48:58] = DIGIT
    out[97:123] = LETTER
    return out


def in_units(tokenizer_file: str) -> bool:
    """Whether texts meet the vocabulary as the table of units expects: composed, lower-cased, white space dropped, parted
    into runs of letters, single digits and runs of marks, byte by byte, nothing added."""
    with open(tokenizer_file, encoding="utf-8") as f:
        form = json.load(f)
    normal, split = form.get("normalizer") or {}, form.get("pre_tokenizer") or {}
    steps = normal.get("normalizers", [])
    parts = split.get("pretokenizers", [])
    return (
        [x.get("type") for x in steps] == NORMALIZERS
        and (steps[1].get("pattern"), steps[1].get("content")) == ({"Regex": r"\s+"}, " ")
        and [x.get("type") for x in parts] == ["Split", "ByteLevel"]
        and (parts[0].get("pattern"), parts[0].get("behavior"), parts[0].get("invert")) == ({"Regex": PATTERN}, "Removed", True)
        and not parts[1].get("add_prefix_space")
        and not parts[1].get("use_regex")
        and bool(form.get("model", {}).get("end_of_word_suffix"))
        and not form.get("model", {}).get("dropout")
    )


class TextIds:
    """Token ids of texts.

    Where the tokenizer has the form of in_units, lower-cased bytes are cut to units: at ASCII blanks, around ASCII digits,
    and between ASCII letters and marks. No token crosses these cuts, so a text's ids are those of its units on end. The
    ids of a unit are the tokenizer's own; those of units of up to 16 bytes are kept in a hash table whose keys are the
    bytes themselves. Longer units and texts with a special string go to the tokenizer each time. The table starts anew
    when it holds max_units. Texts of any other tokenizer go to it whole."""

    def __init__(self, tokenizer_file: str, max_units: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.max_units = max_units
        self.by_unit = in_units(tokenizer_file)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = _kinds()
        if self.by_unit:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self._clear(1 << 16)

    def _clear(self, slots: int) -> None:
        self.low, self.high, self.unit = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        self.begin, self.length = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.ids, self.units, self.used = np.zeros(4096, np.uint32), 0, 0

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(65 - len(self.unit).bit_length())).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The unit of each key, -1 if it isn't there."""
        at = self._slots(low, high)
        out = self.unit[at]
        todo = np.flatnonzero((out >= 0) & ((self.low[at] != low) | (self.high[at] != high)))
        while todo.size:
            at[todo] = (at[todo] + 1) & (len(self.unit) - 1)
            a = at[todo]
            out[todo] = self.unit[a]
            todo = todo[(out[todo] >= 0) & ((self.low[a] != low[todo]) | (self.high[a] != high[todo]))]
        return out

    def _put(self, low: np.ndarray, high: np.ndarray, unit: np.ndarray) -> None:
        """Places keys that are not there yet, all different."""
        at = self._slots(low, high)
        todo = np.arange(len(low))
        while todo.size:
            free = todo[self.unit[at[todo]] < 0]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.low[at[won]], self.high[at[won]], self.unit[at[won]] = low[won], high[won], unit[won]
            rest = np.ones(len(low), bool)
            rest[won] = False
            todo = todo[rest[todo]]
            at[todo] = (at[todo] + 1) & (len(self.unit) - 1)

    def _learn(self, low: np.ndarray, high: np.ndarray, words: list[bytes]) -> None:
        if 2 * (self.units + len(words)) > len(self.unit):
            on = np.flatnonzero(self.unit >= 0)
            old = self.low[on], self.high[on], self.unit[on]
            slots = 1 << (3 * (self.units + len(words))).bit_length()
            self.low, self.high, self.unit = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
            self._put(*old)
        ids, lengths = self._ask(words)
        n = len(words)
        while self.units + n > len(self.begin):
            self.begin, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.begin[self.units : self.units + n] = self.used + np.cumsum(lengths) - lengths
        self.length[self.units : self.units + n] = lengths
        self.ids[self.used : self.used + len(ids)] = ids
        self._put(low, high, np.arange(self.units, self.units + n, dtype=np.int32))
        self.units += n
        self.used += len(ids)

    def _ask(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokenizer's ids of units on end, and how many each has. Units of letters alone go many in one line: each ends
        with the one token that ends a word."""
        said = [x.decode("utf-8", "surrogatepass") for x in words]
        plain = np.array([x.isalpha() and (x.isascii() or max(x) < "\u0100") for x in said], bool)
        lengths = np.zeros(len(words), np.int64)
        letters, others = np.flatnonzero(plain).tolist(), np.flatnonzero(~plain).tolist()
        lines = [" ".join([said[i] for i in letters[k : k + 64]]) for k in range(0, len(letters), 64)]
        flat = self._flat(self.tokenizer.encode_batch_fast(lines, add_special_tokens=False))[0]
        ends = np.flatnonzero(self.ends[flat]) + 1
        if len(ends) != len(letters):
            raise AssertionError("a run of letters isn't one word to the tokenizer")
        lengths[plain] = np.diff(ends, prepend=0)
        rest, n = self._flat(self.tokenizer.encode_batch_fast([said[i] for i in others], add_special_tokens=False))
        lengths[~plain] = n
        out = np.empty(int(lengths.sum()), np.uint32)
        of = np.repeat(plain, lengths)
        out[of], out[~of] = flat, rest
        return out, lengths

    @staticmethod
    def _flat(found: list) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in found]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum())), n

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._flat(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids on end, each text's followed by end_id, and where each text's begin (with the total at last)."""
        special = [any(s in x for s in self.special) for x in texts] if self.by_unit else []
        apart = np.array(special, bool) if self.by_unit else np.ones(len(texts), bool)
        whole, n_whole = self._whole([x for x, a in zip(texts, apart, strict=True) if a])
        ids, n = self._by_unit(["" if a else x for x, a in zip(texts, apart, strict=True)]) if self.by_unit else (np.zeros(0, np.uint32), np.zeros(len(texts), np.int64))
        n[apart] = n_whole
        at = np.concatenate([[0], np.cumsum(n + 1)])
        out = np.empty(int(at[-1]), np.uint32)
        mine = np.repeat(np.where(apart, 1, 0), n + 1)
        mine[at[1:] - 1] = 2
        out[mine == 0], out[mine == 1], out[mine == 2] = ids, whole, end_id
        return out, at

    def _by_unit(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and how many each has."""
        if self.units > self.max_units or self.used > 8 * self.max_units:
            self._clear(len(self.unit))
        data = [x.encode("utf-8", "surrogatepass") for x in texts]
        text_ends = np.cumsum([len(x) + 1 for x in data])
        raw = (b"\n".join(data) + b"\n").lower()
        flat = np.frombuffer(raw + bytes(KEY_BYTES), np.uint8)
        n = len(raw)
        kind = self.kind[flat[:n]]
        before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
        # cuts: where blanks end, around digits, and between letters and marks (all of them ASCII)
        ascii_both = (kind != OTHER) & (before != OTHER)
        begin = (kind != BLANK) & ((before == BLANK) | (ascii_both & ((kind != before) | (kind == DIGIT))))
        starts = np.flatnonzero(begin)
        if not starts.size:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        blank = np.flatnonzero((kind == BLANK) & (before != BLANK))  # ends of runs: one behind each
        stop = np.append(starts[1:], n)
        behind = blank[np.searchsorted(blank, starts)]
        sizes = np.minimum(stop, behind) - starts
        words = np.ndarray((len(flat) - 7,), "<u8", flat.data, 0, (1,))
        low, high = words[starts], words[starts + 8]
        short = np.minimum(sizes, 8).astype(np.uint64)
        low &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - (short << np.uint64(3)))
        more = np.clip(sizes - 8, 0, 8).astype(np.uint64) << np.uint64(3)
        high &= np.where(more > 0, np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(64) - more) & np.uint64(63)), np.uint64(0))
        long = np.flatnonzero(sizes > KEY_BYTES)
        low[long], high[long] = 0, 0  # no unit is of zero bytes alone but for NUL characters, which are looked at below
        odd = np.zeros(len(starts), bool)
        odd[long] = True
        odd |= (low == 0) & (high == 0)
        # a NUL at the end of a unit would be taken for filling
        if 0 in raw:
            odd |= flat[starts + sizes - 1] == 0
        unit = np.full(len(starts), -1, np.int32)
        usual = np.flatnonzero(~odd)
        unit[usual] = self._find(low[usual], high[usual])
        fresh = usual[unit[usual] < 0]
        if fresh.size:
            order = np.lexsort((low[fresh], high[fresh]))
            f = fresh[order]
            one = np.concatenate([[True], (low[f][1:] != low[f][:-1]) | (high[f][1:] != high[f][:-1])])
            f1 = f[one]
            known = self.units
            self._learn(low[f1], high[f1], [raw[a:b] for a, b in zip(starts[f1].tolist(), (starts + sizes)[f1].tolist(), strict=True)])
            unit[f] = known + np.cumsum(one) - 1
        lengths = np.where(odd, 0, self.length[np.maximum(unit, 0)]).astype(np.int64)
        strange = np.flatnonzero(odd)
        rest = np.zeros(0, np.uint32)
        if strange.size:
            rest, lengths[strange] = self._whole([raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[strange].tolist(), (starts + sizes)[strange].tolist(), strict=True)])
        total = np.concatenate([[0], np.cumsum(lengths)])
        own = np.where(odd, 0, lengths)
        source = np.repeat(self.begin[np.maximum(unit, 0)] - (np.cumsum(own) - own), own)
        found = self.ids[source + np.arange(len(source))]
        if strange.size:
            mine = np.repeat(odd, lengths)
            ids = np.empty(int(total[-1]), np.uint32)
            ids[mine], ids[~mine] = rest, found
        else:
            ids = found
        return ids, np.diff(total[np.searchsorted(starts, np.concatenate([[0], text_ends]))])


@lru_cache(1)
def _ids(tokenizer_file: str) -> TextIds:
    return TextIds(tokenizer_file)


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int, end_id: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids) of each row's tokens with end_id behind, cut at each capacity."""

    def make(rest, found):
        ids, at = _ids(tokenizer_file).encode(found, end_id)
        ids = ids.astype("<u4", copy=False)
        sizes = np.diff(at)
        n = -(-sizes // capacity)
        row = np.repeat(np.arange(len(found)), n)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start = piece * capacity
        length = np.minimum(capacity, sizes[row] - start)
        begin = at[row] + start
        cut = [ids[b : b + m] for b, m in zip(begin.tolist(), length.tolist(), strict=True)]
        out = {
            id_col: rest[id_col].take(pa.array(row)),
            "piece": piece.astype(np.int32),
            "start": start.astype(np.int64),
            "length": length.astype(np.int64),
            "ids_crc32": np.array([zlib.crc32(x.tobytes()) for x in cut], np.int64),
        }
        if with_ids:
            out["ids"] = pa.array([x.astype(np.int32) for x in cut], pa.list_(pa.int32()))
        return out

    kind = dict(docs.dtypes)[id_col]
    schema = f"{id_col} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return by_text(docs, [id_col], schema, make, text_col)


def _dominating(n: np.ndarray, size: int, capacity: int) -> tuple[int, ...] | None:
    """The items to put beside one of this size so that the set dominates every other set with it, if one is found. n
    counts the others by size.

    With room left and k the longest that fits: none if nothing fits; k if it fills the room or no two items fit. Where two
    but no three fit: k if nothing fits beside it and no pair is longer; k and b, the longest that fits beside k, if no two
    items longer than b fit (then a pair's longer item is at most k, its shorter one at most b)."""
    room = capacity - size
    fits = np.flatnonzero(n[: room + 1])
    if not fits.size:
        return ()
    k = int(fits[-1])
    least = [int(x) for x in fits[:3] for _ in range(min(3, int(n[x])))][:3]
    if k == room or len(least) < 2 or least[0] + least[1] > room:
        return (k,)
    if len(least) == 3 and sum(least) <= room:
        return None
    n[k] -= 1
    beside = np.flatnonzero(n[: room - k + 1])
    n[k] += 1
    if not beside.size:
        partner = fits[np.maximum(np.searchsorted(fits, room - fits, "right") - 1, 0)]
        pairs = np.where((fits + partner <= room) & ((partner != fits) | (n[fits] > 1)), fits + partner, 0)
        # where a single item is its own best partner, the next shorter one is
        alone = (partner == fits) & (n[fits] == 1)
        alone[0] = False
        pairs[alone] = fits[alone] + fits[np.flatnonzero(alone) - 1]
        return (k,) if pairs.max() <= k else None
    b = int(beside[-1])
    above = [int(x) for x in fits[fits > b][:2] for _ in range(min(2, int(n[x])))][:2]
    return (k, b) if len(above) < 2 or sum(above) > room else None


def reduce_dominated(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, list[tuple[tuple[int, ...], int]]]:
    """Martello and Toth's reduction on counts of lengths: sets of one to three items that dominate every other set with
    their first item.

    Such sets are fixed for good and the counts shrink, which can make further sets dominate, until none does. A set that
    dominates goes on doing so while its items last, as fewer others are left, so it is fixed as often as they allow.
    Returns what is left and the fixed (set, times)."""
    n, fixed = counts.copy(), []
    changed = True
    while changed:
        changed = False
        for size in range(capacity, 0, -1):
            while n[size]:
                n[size] -= 1
                others = _dominating(n, size, capacity)
                n[size] += 1
                if others is None:
                    break
                group = (size, *others)
                need = Counter(group)
                times = min(int(n[x]) // k for x, k in need.items())
                for x, k in need.items():
                    n[x] -= times * k
                fixed.append((group, times))
                changed = True
    return n, fixed


def plan(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int, int]:
    """Runs (length, first rank, end rank, first sequence, offset) for pieces ranked within their length, the number of
    sequences, and how many of them the reduction fixed. Works on counts by length, so its cost depends on capacity and
    not on the number of pieces."""
    rank = np.zeros(capacity + 1, np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def put(size: int, times: int, sequence: int, offset: int) -> None:
        runs.append((size, int(rank[size]), int(rank[size]) + times, sequence, offset))
        rank[size] += times

    rest, fixed = reduce_dominated(counts, capacity)
    for group, times in fixed:
        offset = 0
        for size in group:
            put(size, times, bins, offset)
            offset += size
        bins += times
    by_fixed = bins
    open_at: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, how many)
    rooms: list[int] = []

    def keep(room: int, sequence: int, many: int) -> None:
        if many and room:
            if room not in open_at:
                open_at[room] = []
                insort(rooms, room)
            open_at[room].append((sequence, many))

    for size in range(capacity, 0, -1):
        n = int(rest[size])
        while n:
            k = bisect_left(rooms, size)
            if k < len(rooms):
                room = rooms[k]
                sequence, many = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room]
                    rooms.pop(k)
            else:
                room, sequence = capacity, bins
                many = -(-n // (capacity // size))
                bins += many
            each = min(room // size, n)
            full = min(many, n // each)
            for j in range(each):
                put(size, full, sequence, capacity - room + j * size)
            n -= full * each
            keep(room - each * size, sequence, full)
            if full < many and n and n < each:
                for j in range(n):
                    put(size, 1, sequence + full, capacity - room + j * size)
                keep(room - n * size, sequence + full, 1)
                full, n = full + 1, 0
            keep(room, sequence + full, many - full)
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return table[table[:, 2] > table[:, 1]], bins, by_fixed


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, group_rows: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all rows with sequence_id and offset: every sequence holds at most capacity tokens without gaps.

    Columns: id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for). A null or empty text is
    one piece of the end id alone. Very long texts are cut to pieces and handled alone. Repeated rows and null ids are packed
    like any other; an empty table gives none; other columns aren't read. Any tokenizer file will do (see TextIds). Only
    counts by length (capacity rows at most) reach the driver. Pieces of one length are ranked in salted groups of
    group_rows or of the root of their number, whichever is more, so that no length lands in one task."""
    if not 0 < capacity < 1 << 13:
        raise ValueError("capacity is 1 to 8191")
    made = durable(pieces(docs, tokenizer_file, capacity, end_id, with_ids, id_col, text_col))
    counts = np.zeros(capacity + 1, np.int64)
    for r in made.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    runs, _, _ = plan(counts, capacity)
    salts = np.maximum(1, -(-counts // np.maximum(group_rows, np.sqrt(counts).astype(np.int64))))
    of_length = F.element_at(F.lit(salts.tolist()), F.col("length").cast("int") + 1)
    salted = made.withColumn("salt", F.pmod(F.xxhash64(id_col, "piece"), of_length).cast("int"))
    # a group's first rank: a sum over the groups of a length, of which there are no more than the root of its rows or a thousandth
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    order = W.partitionBy("length", "salt").orderBy(id_col, "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order)).join(F.broadcast(before) if salts.sum() <= 100_000 else before, ["length", "salt"]).withColumn("rank", F.col("rank") - 1 + F.col("before"))
    columns = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kinds = dict(made.dtypes)
    firsts, begin, sequence, offset = runs[:, 0], runs[:, 1], runs[:, 3], runs[:, 4]

    def place(batches):
        # lengths and ranks as one ascending key: ranks are below 2^50
        keys = firsts * (1 << 50) + begin
        for batch in batches:
            length, at = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            k = np.searchsorted(keys, length * (1 << 50) + at, "right") - 1
            out = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*out, pa.array(sequence[k] + at - begin[k]), pa.array(offset[k])], names=[*columns, "sequence_id", "offset"])

    return arrow(ranked.select(*columns, "rank"), place, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id bigint, offset bigint")
