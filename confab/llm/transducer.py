"""Finite-state compilation of a sentencepiece BPE vocabulary for token counting.

BPE is compiled lazily to a deterministic Mealy machine over characters.  For a text ``w`` let ``last(i)`` be the last
token of ``BPE(w[:i])`` and ``N(i)`` its token count.  A token sequence is a BPE result iff each neighbouring pair is one,
so ``last(i)`` is the one piece ``s`` ending at ``i`` whose predecessor ``last(i - len(s))`` is compatible with it, and
``N(i) = N(i - len(s)) + 1``.  Only starts ``j`` with ``w[j:i]`` a prefix of some piece can matter later, hence the state
is the finite list of ``(w[j:i], last(j), N(j) - N(i))`` and a transition emits ``N(i+1) - N(i)`` tokens (it can be
negative: a later character may join tokens).  The sum of emissions over a text is its token count.

States and transitions are made when a text first needs them, in a table of bounded size that starts again when full.

A batch of texts is cut into fixed chunks, each standing for a map from entry state to (exit state, emissions).  A chunk
that holds a *synchronising* position (two characters that no piece has side by side) has a constant exit state; its tail
runs in lockstep with all other chunks.  The maps of the others are known at the few entry states that they have been run
from, at first the exit that the chunk before has when it runs from the start.  Such maps compose: a prefix scan that
doubles its reach at each step gives the states that chunks are really entered in, as far as the maps are known there.
Where one isn't, the chunk is run from that state, as are all chunks of the same content, and the scan is made anew.
With the entry states all heads run, again in lockstep.
"""

from __future__ import annotations

import numpy as np

SPACE = "▁"
CHUNK = 192
BIAS = 128
START, WAIT = 0, 1
PAIR_BITS = 22  # of the table that tells which characters can stand side by side in a piece
ENTRIES = 8  # entry states at which the map of a chunk is known
ROUNDS = 24  # scans; what is open behind them is walked from chunk to chunk
FEW = 24  # lanes that are walked one by one rather than in lockstep


class Vocabulary:
    """Pieces of a sentencepiece BPE model with their ranks, and what is asked of them."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.score = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                self.score[sp.id_to_piece(i)] = sp.get_score(i)
        self.prefixes = {p[:k] for p in self.score for k in range(1, len(p))}
        self.inside = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        self.joined = sorted({c for p in self.score if len(p) > 1 for c in p})
        self.longest = max(map(len, self.score))
        self._pairs: dict[tuple[str, str], bool] = {}
        self._valid: dict[str, bool] = {}

    def bpe(self, text: str) -> list[str]:
        """Plain BPE: join the best-scored neighbouring pair, leftmost first, until none is a piece."""
        parts, score = list(text), self.score.get
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def valid(self, piece: str) -> bool:
        known = self._valid.get(piece)
        if known is None:
            known = self._valid[piece] = piece in self.score and (len(piece) == 1 or self.bpe(piece) == [piece])
        return known

    def pair(self, a: str | None, b: str) -> bool:
        """Whether BPE leaves a followed by b as these two tokens."""
        if a is None or a[-1] + b[0] not in self.inside:
            return True
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            known = self._pairs[a, b] = self.bpe(a + b) == [a, b]
        return known


class TokenCounter:
    """Counts tokens as sentencepiece's encode does (no begin or end): a space mark leads, spaces become marks, a
    character outside the vocabulary counts its UTF-8 bytes."""

    def __init__(self, model_file: str, table_mb: int = 160):
        self.vocab = v = Vocabulary(model_file)
        self.table_bytes = table_mb << 20
        # class 0: characters that no longer piece holds; they stand alone and end every context
        self.class_of = np.zeros(0x110000, np.int32)
        self.char_of = ["\0"]
        self.pending = np.zeros(0x110000, bool)
        self.pending[[ord(c) for c in v.joined]] = True
        self.weight = np.ones(0x110000, np.int8)
        self.weight[0x80:] = 2
        self.weight[0x800:] = 3
        self.weight[0x10000:] = 4
        for c in v.score:
            if len(c) == 1:
                self.weight[ord(c)] = 1
        self.weight[[ord(c) for c in v.joined]] = 0
        # neighbours within a piece by a hash of both: others taken for such only make fewer positions synchronise
        self.beside = np.zeros(1 << PAIR_BITS, bool)
        pairs = np.array([[ord(x) for x in p] for p in v.inside], np.uint32).reshape(-1, 2)
        self.beside[self._pair(pairs[:, 0], pairs[:, 1])] = True
        self._clear()

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77)
        return (h * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - PAIR_BITS)

    def _clear(self) -> None:
        for c in self.char_of[1:]:
            self.class_of[ord(c)] = 0
            self.pending[ord(c)] = True
        self.char_of = ["\0"]
        self.width = 64
        self.states: list[tuple] = [(("", None, 0),), ()]
        self.index = {self.states[0]: START}
        self.table = np.full((1024, self.width), -1, np.int32)
        self.table[:, 0] = START << 8 | BIAS
        self.table[WAIT, :] = WAIT << 8 | BIAS

    def _classes(self, codes: np.ndarray) -> np.ndarray:
        fresh = codes[self.pending[codes]]
        if fresh.size:
            for code in np.unique(fresh).tolist():
                if len(self.char_of) == self.width:
                    self._widen()
                self.class_of[code], self.pending[code] = len(self.char_of), False
                self.char_of.append(chr(code))
        return self.class_of[codes]

    def _widen(self) -> None:
        table = np.full((len(self.table), 2 * self.width), -1, np.int32)
        table[:, : self.width] = self.table
        table[WAIT, :] = WAIT << 8 | BIAS
        self.table, self.width = table, 2 * self.width

    def _compile(self, state: int, k: int) -> None:
        """Makes the transition of a state on a character's class."""
        c, v = self.char_of[k], self.vocab
        alive, token, delta = self.states[state], None, None
        for u, t, d in alive:
            s = u + c
            if v.valid(s) and v.pair(t, s):
                token, delta = s, d + 1
                break
        if token is None:
            raise AssertionError(f"no token ends after {c!r} in {alive!r}")
        after = []
        for u, t, d in alive:
            s = u + c
            if s in v.prefixes:
                after.append((s, t if t is not None and t[-1] + s[0] in v.inside else None, d - delta))
        after.append(("", token, 0))
        key = tuple(after)
        to = self.index.get(key)
        if to is None:
            to = len(self.states)
            if to == len(self.table):
                more = np.full((len(self.table), self.width), -1, np.int32)
                more[:, 0] = START << 8 | BIAS
                self.table = np.concatenate([self.table, more])
            self.states.append(key)
            self.index[key] = to
        self.table[state, k] = to << 8 | (delta + BIAS)

    def _step(self, state: np.ndarray, k: np.ndarray) -> np.ndarray:
        at = state * self.width + k
        v = self.table.ravel().take(at)
        if v.size and v.min() < 0:
            for miss in np.unique(at[v < 0]).tolist():
                self._compile(miss // self.width, miss % self.width)
            v = self.table.ravel().take(at)
        return v

    def count(self, texts: list[str]) -> np.ndarray:
        """Token count of each text."""
        if self.table.nbytes > self.table_bytes:
            self._clear()
        out = np.zeros(len(texts), np.int64)
        full = [i for i, t in enumerate(texts) if t]
        if not full:
            return out
        # a NUL between texts is of class 0 and so keeps them apart; its weight is taken off again
        joined = "\0" + "\0".join(SPACE + texts[i].replace(" ", SPACE) for i in full)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        k = self._classes(codes)
        lengths = np.array([len(texts[i]) + 2 for i in full], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        sync = np.ones(len(k), bool)
        sync[1:] = ~self.beside[self._pair(codes[:-1], codes[1:])]
        emitted = self._scan(k, sync)
        emitted += self.weight[codes]
        emitted[starts] = 0
        out[full] = np.add.reduceat(emitted.astype(np.int64), starts)
        return out

    def _walk(self, lane: np.ndarray, state: int) -> int:
        """The state behind a lane."""
        at, width = self.table.ravel(), self.width
        for k in lane.tolist():
            v = at.item(state * width + k)
            if v < 0:
                self._compile(state, k)
                at, width = self.table.ravel(), self.width
                v = at.item(state * width + k)
            state = v >> 8
        return state

    def _exits(self, lanes: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The state behind each row of lanes, from the given ones."""
        if len(state) < FEW:
            return np.array([self._walk(x, s) for x, s in zip(lanes, state.tolist(), strict=True)], np.int32)
        state = state.astype(np.int32)
        for k in lanes.T:
            state = self._step(state, k) >> 8
        return state

    def _scan(self, k: np.ndarray, sync: np.ndarray) -> np.ndarray:
        n, chunks = len(k), -(-len(k) // CHUNK)
        padded = np.zeros(chunks * CHUNK, np.int32)
        padded[:n] = k
        by_chunk = np.concatenate([sync, np.ones(chunks * CHUNK - n, bool)]).reshape(chunks, CHUNK)
        head = np.where(by_chunk.any(1), by_chunk.argmax(1), CHUNK)
        rows = padded.reshape(chunks, CHUNK)
        lanes, go_on = rows.T.copy(), (~by_chunk).T.astype(np.int32)
        emitted = np.empty((CHUNK, chunks), np.int16)
        state = np.full(chunks, WAIT, np.int32)
        for i in range(CHUNK):  # the tails: from WAIT, START at each synchronising position
            state *= go_on[i]
            v = self._step(state, lanes[i])
            emitted[i] = v & 255
            state = v >> 8
        exits = state
        whole = np.flatnonzero(head == CHUNK)
        if whole.size:
            exits[whole] = self._entered(rows[whole], whole, exits)
        # the heads, from what is now known of the chunks before; longer ones first
        todo = np.flatnonzero(head > 0)
        todo = todo[np.argsort(-head[todo], kind="stable")]
        state, need = exits[todo - 1].copy(), head[todo]
        for i in range(int(need[0]) if todo.size else 0):
            live = int(np.searchsorted(-need, -i, "left"))  # lanes whose head is longer than i
            v = self._step(state[:live], lanes[i, todo[:live]])
            emitted[i, todo[:live]] = v & 255
            state[:live] = v >> 8
        emitted -= BIAS
        return emitted.T.reshape(-1)[:n].copy()

    def _entered(self, lanes: np.ndarray, chunk: np.ndarray, exits: np.ndarray) -> np.ndarray:
        """Exit states of the chunks whose map isn't constant, by a prefix scan over their maps. exits holds those of the
        other chunks. A chunk that follows none of these begins a run; what it is entered in is known."""
        m = len(chunk)
        first = np.concatenate([[True], np.diff(chunk) > 1])
        run = np.maximum.accumulate(np.where(first, np.arange(m), 0))
        given = exits[chunk[run] - 1]  # what the run of each chunk is entered in
        content = np.unique(lanes, axis=0, return_inverse=True)[1].ravel()
        # maps: the entry states known of a chunk, and the exits they lead to
        entry, leave = np.full((m, ENTRIES), -1, np.int64), np.full((m, ENTRIES), -1, np.int64)
        many = np.zeros(m, np.int64)

        def learn(rows: np.ndarray, state: np.ndarray) -> None:
            """Runs chunks from states, once for each content and state."""
            key = np.unique(np.stack([content[rows], state], 1), axis=0, return_index=True)[1]
            rows, state = rows[key], state[key]
            found = self._exits(lanes[rows], state)
            for r, s, e in zip(rows.tolist(), state.tolist(), found.tolist(), strict=True):
                on = np.flatnonzero(content == content[r]) if m < 1 << 14 else np.array([r])
                on = on[(entry[on] != s).all(1)]
                at = many[on] % ENTRIES  # the oldest makes room
                entry[on, at], leave[on, at] = s, e
                many[on] += 1

        def compose() -> np.ndarray:
            """The exit of each chunk, -1 where a map on its way isn't known: in step j maps reach over 2^j chunks."""
            to = leave.copy()
            back = 1
            while back <= int((np.arange(m) - run).max()):
                on = np.flatnonzero(np.arange(m) - run >= back)
                # the map of the chunks before, followed by this one's
                before_from, before_to = source[on - back], to[on - back]
                same = before_to[:, :, None] == source[on][:, None, :]
                hit = same.any(2) & (before_to >= 0)
                after = np.where(hit, np.take_along_axis(to[on], same.argmax(2), 1), -1)
                to[on], source[on] = after, before_from
                back *= 2
            same = (source == given[:, None]) & (to >= 0)
            return np.where(same.any(1), np.take_along_axis(to, same.argmax(1)[:, None], 1)[:, 0], -1)

        learn(np.flatnonzero(first), given[first])
        rest = np.flatnonzero(~first)
        if rest.size:
            # a guess for the others: what the chunk before leaves when it runs from the start
            guess = self._exits(lanes[rest - 1], np.zeros(len(rest), np.int64))
            learn(rest, guess.astype(np.int64))
        for _ in range(ROUNDS):
            source = entry.copy()
            out = compose()
            open_ = np.flatnonzero(out < 0)
            if not open_.size:
                return out
            # of each run the first open chunk: it is entered in what the one before leaves
            head = open_[np.unique(run[open_], return_index=True)[1]]
            learn(head, np.where(first[head], given[head], out[head - 1]))
        for i in np.flatnonzero(out < 0).tolist():
            out[i] = self._walk(lanes[i], int(given[i] if first[i] else out[i - 1]))
        return out
