"""Token counts by finite-state tokenizer compilation.

Two deterministic transducers replace a byte-level BPE tokenizer.

The splitter reads character classes (with two characters of look-ahead folded into the
symbol) and marks where the tokenizer's pattern begins a piece. Each chunk of a text gives
a map from every entry state to its exit state; a parallel prefix scan composes the maps,
so all chunks of all texts of a batch run in lockstep. The counter's chunk maps, from entry
state to exit state and count, are composed by a scan as well (see ``Counter.count``).

The counter reads the bytes of a piece. Its state lists each place in the piece where a
token may still begin or go on: the vocabulary trie's node there, the last token before it
and the count of tokens up to it, relative to the current place. A transition is annotated
with the change of the count. The last token of every prefix is the only vocabulary token
that ends there and may follow the last token before it, so the transducer is exact. States
and transitions are compiled as texts need them and kept in the Python worker; past
``MOST_STATES`` they are dropped and compiled anew, which bounds memory, not results.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups_of, utf8_buffers

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CHUNK = 256
MOST_STATES = 200_000
_MEMO = 400_000
_GROUP = 2_000_000

# Character classes; look-ahead kinds; symbols of the splitter.
_L, _N, _O, _SPACE, _WHITE = range(5)
_SYM_L, _SYM_N, _SYM_O, _SYM_C2, _SYM_C3 = range(5)
_SYM_SPACE, _SYM_WHITE, _PAD, _SYMBOLS = 5, 8, 11, 12  # white ones: + 0 before white, + 1 before other, + 2 at the end
_START, _IN_L, _IN_N, _IN_O, _LEFT2, _LEFT1, _DONE, _PREFIX, _RUN, _STATES = range(10)


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, piece begins or not), both by symbol and state."""
    to, emit = np.zeros((_SYMBOLS, _STATES), np.uint8), np.zeros((_SYMBOLS, _STATES), bool)

    def begin(sym: int) -> int:
        if sym in (_SYM_L, _SYM_N, _SYM_O):
            return (_IN_L, _IN_N, _IN_O)[sym]
        if sym == _SYM_C2:
            return _LEFT1
        if sym == _SYM_C3:
            return _LEFT2
        base, ahead = (_SYM_SPACE, sym - _SYM_SPACE) if sym < _SYM_WHITE else (_SYM_WHITE, sym - _SYM_WHITE)
        if ahead == 1:  # the last white character before another
            return _PREFIX if base == _SYM_SPACE else _DONE
        return _RUN

    for sym in range(_PAD):
        for s in range(_STATES):
            kind = _SYM_O if sym in (_SYM_C2, _SYM_C3) else sym
            if s in (_LEFT2, _LEFT1):
                to[sym, s] = _LEFT1 if s == _LEFT2 else _DONE
            elif s == _PREFIX and kind <= _SYM_O:
                to[sym, s] = (_IN_L, _IN_N, _IN_O)[kind]
            elif s in (_IN_L, _IN_N, _IN_O) and kind == s - _IN_L:
                to[sym, s] = s
            elif s == _RUN and sym in (_SYM_SPACE, _SYM_WHITE, _SYM_SPACE + 2, _SYM_WHITE + 2):
                to[sym, s] = _RUN
            else:
                to[sym, s], emit[sym, s] = begin(sym), True
    to[_PAD] = np.arange(_STATES)
    return to, emit


_TO, _EMIT = _splitter()
_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    if not _classes:
        import regex

        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        t = np.full(0x110000, _O, np.uint8)
        for c, p in ((_L, r"\p{L}"), (_N, r"\p{N}"), (_WHITE, r"\p{White_Space}")):
            t[[ord(x) for x in regex.findall(p, every)]] = c
        t[32] = _SPACE
        _classes.append(t)
    return _classes[0]


def symbols(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The splitter's symbol of each code point; row i has code points [first[i], first[i + 1])."""
    n = len(cp)
    c = _class_table()[cp]
    white = c >= _SPACE
    last = np.zeros(n + 1, bool)
    last[first[1:] - 1] = True  # an empty row marks its neighbour's last or the spare place
    last = last[:n]
    ahead = np.ones(n, np.uint8)
    ahead[:-1][white[1:]] = 0
    ahead[last] = 2
    sym = np.where(c <= _O, c, np.where(c == _SPACE, _SYM_SPACE, _SYM_WHITE) + ahead).astype(np.uint8)
    quote = np.flatnonzero((cp == 39) & ~last)
    if len(quote):
        wide, end = np.concatenate([cp, [0, 0]]), np.concatenate([last, [True, True]])
        a, b = wide[quote + 1], np.where(end[quote + 1], 0, wide[quote + 2])
        sym[quote[np.isin(a, [115, 116, 109, 100])]] = _SYM_C2
        three = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        sym[quote[three]] = _SYM_C3
    return sym


def boundaries(sym: np.ndarray, first: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Places of code points at which a piece begins, by chunk maps and a prefix scan."""
    size = np.diff(first)
    n = -(-size // chunk)
    row = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    begin = first[:-1][row] + k * chunk
    length = np.minimum(first[1:][row] - begin, chunk)
    if not len(row):
        return np.zeros(0, np.int64)
    at = begin[:, None] + np.arange(chunk)
    inside = np.arange(chunk) < length[:, None]
    grid = np.where(inside, np.concatenate([sym, np.full(chunk, _PAD, np.uint8)])[at], _PAD).T.copy()
    states = _STATES
    to = _TO.ravel()
    maps = np.tile(np.arange(states, dtype=np.uint8), (len(row), 1))
    for s in grid:
        maps = to[s[:, None].astype(np.int32) * states + maps]
    maps[k == 0] = maps[k == 0][:, [_START]]  # a text begins in the start state whatever came before
    d = 1
    while d < len(maps):
        maps[d:] = np.take_along_axis(maps[d:], maps[:-d].astype(np.intp), 1)
        d *= 2
    now = np.full(len(row), _START, np.uint8)
    now[1:] = np.where(k[1:] == 0, _START, maps[:-1, _START])
    out, emit = np.zeros(grid.shape, bool), _EMIT.ravel()
    for j, s in enumerate(grid):
        i = s.astype(np.int32) * states + now
        out[j], now = emit[i], to[i]
    r, j = np.nonzero(out.T)
    return begin[r] + j


class Counter:
    """The counting transducer of a vocabulary, compiled on demand."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.encode = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.child: list[dict[int, int]] = [{}]
        self.token, self.below = [-1], [0]
        for b, i in sorted(ranks.items()):
            n = 0
            for x in b:
                self.below[n] += 1
                m = self.child[n].get(x)
                if m is None:
                    m = self.child[n][x] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                    self.below.append(0)
                n = m
            self.token[n] = i
        self.reset()

    def reset(self) -> None:
        start = ((0, -1, 0),)
        self.keys, self.ids = [start], {start: 0}
        self.column = np.full(256, -1, np.int64)
        self.columns = 0
        self.next = np.full((1024, 32), -1, np.int32)
        self.change = np.zeros((1024, 32), np.int8)
        self.pairs: dict[int, bool] = {}
        self.open: dict[int, bool] = {}

    def follows(self, a: int, t: int) -> bool:
        """Whether token t may come directly after token a (-1: the piece's beginning)."""
        if a < 0:
            return True
        k = a << 32 | t
        v = self.pairs.get(k)
        if v is None:
            if len(self.pairs) > _MEMO:
                self.pairs.clear()
            v = self.pairs[k] = self.encode(self.bytes_of[a] + self.bytes_of[t]) == [a, t]
        return v

    def live(self, a: int, node: int) -> bool:
        """Whether a longer token through ``node`` may follow token a; only asked of small subtrees."""
        if a < 0 or self.below[node] > 300:
            return True
        k = a << 32 | node
        v = self.open.get(k)
        if v is None:
            if len(self.open) > _MEMO:
                self.open.clear()
            stack, v = list(self.child[node].values()), False
            while stack and not v:
                n = stack.pop()
                v = self.token[n] >= 0 and self.follows(a, self.token[n])
                stack.extend(self.child[n].values())
            self.open[k] = v
        return v

    def compile(self, state: int, byte: int) -> None:
        best, held = None, []
        for node, a, c in self.keys[state]:
            n = self.child[node].get(byte)
            if n is None:
                continue
            if best is None and self.token[n] >= 0 and self.follows(a, self.token[n]):
                best = (self.token[n], c + 1)
            if self.child[n] and self.live(a, n):
                held.append((n, a, c))
        token, change = best
        key = (*((n, a, c - change) for n, a, c in held), (0, token, 0))
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.keys)
            self.keys.append(key)
        if self.column[byte] < 0:
            self.column[byte] = self.columns
            self.columns += 1
        rows, cols = self.next.shape
        if len(self.keys) > rows or self.columns > cols:
            shape = (max(rows, len(self.keys) + len(self.keys) // 4), cols + 32 * (self.columns > cols))
            wide, change_ = np.full(shape, -1, np.int32), np.zeros(shape, np.int8)
            wide[:rows, :cols], change_[:rows, :cols] = self.next, self.change
            self.next, self.change = wide, change_
        self.next[state, self.column[byte]] = to
        self.change[state, self.column[byte]] = change

    def forget(self, state: np.ndarray) -> np.ndarray:
        """Drops all states but the start and those given; returns the given ones' new numbers."""
        held, at = np.unique(state, return_inverse=True)
        keys = [self.keys[i] for i in held.tolist()]
        self.reset()
        new = [self.ids.setdefault(k, len(self.ids)) for k in keys]
        self.keys = list(self.ids)
        if len(self.keys) > len(self.next):
            self.next, self.change = np.full((len(self.keys), 32), -1, np.int32), np.zeros((len(self.keys), 32), np.int8)
        return np.array(new, np.int64)[at]

    def walk(self, buf: np.ndarray, begins: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray, change: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Exit states of the stretches buf[start : start + size] from their entry states, all in lockstep.

        Where ``begins`` is set a piece begins, in the start state. The changes of the counts
        are written to ``change``, by byte; ``held`` are states to keep when some are forgotten.
        """
        order = np.argsort(-size, kind="stable")
        begin, size, state = start[order], size[order], state[order].astype(np.int64)
        live = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        for j, m in enumerate(live):
            if len(self.keys) > MOST_STATES:
                state[:], held[:] = np.split(self.forget(np.concatenate([state, held])), [len(state)])
            at = begin[:m] + j
            byte, now = buf[at], np.where(begins[at], 0, state[:m])
            while True:
                col = self.column[byte]
                i = now * self.next.shape[1] + np.maximum(col, 0)
                to = self.next.ravel()[i]
                miss = (to < 0) | (col < 0)
                if not miss.any():
                    break
                for k in np.unique(now[miss] << 8 | byte[miss]).tolist():
                    self.compile(k >> 8, k & 255)
            change[at] = self.change.ravel()[i]
            state[:m] = to
        out = np.empty(len(order), np.int64)
        out[order] = state
        return out

    def count(self, buf: np.ndarray, begins: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """Change of the token count at each byte of ``buf``; ``begins`` marks where pieces begin, the first byte among them.

        A chunk's map from entry state to (exit state, count) is constant from its first
        beginning on: that part of all chunks is walked at once, whatever came before. What is
        left are the heads, which go on with a piece of the chunk before. The scan composes the
        maps: each head is entered with the exit of the chunk before it, all those that are
        known at once; only a chunk without a beginning hands its entry on, so there are as
        many rounds as the longest piece has whole chunks.
        """
        n = -(-len(buf) // chunk)
        edge = np.minimum(np.arange(n + 1) * chunk, len(buf))
        at = np.flatnonzero(begins)
        first = np.append(at, len(buf))[np.searchsorted(at, edge[:-1])]
        head = np.minimum(first, edge[1:]) - edge[:-1]  # bytes before the chunk's first beginning
        change, exits = np.zeros(len(buf), np.int8), np.full(n, -1, np.int64)
        some = np.flatnonzero(head < np.diff(edge))
        none = np.zeros(0, np.int64)
        exits[some] = self.walk(buf, begins, edge[some] + head[some], edge[some + 1] - edge[some] - head[some], np.zeros(len(some), np.int64), change, none)
        todo = np.flatnonzero(head)
        while len(todo):
            now = todo[exits[todo - 1] >= 0]
            known = np.flatnonzero(exits >= 0)
            held = exits[known]
            out = self.walk(buf, begins, edge[now], head[now], exits[now - 1], change, held)
            exits[known] = held
            whole = head[now] == edge[now + 1] - edge[now]
            exits[now[whole]] = out[whole]
            todo = np.setdiff1d(todo, now, assume_unique=True)
        return change


_counters: dict[str, Counter] = {}


def load(path: str) -> Counter:
    """The transducer of a vocabulary file (lines of base64 token and rank), once in each worker."""
    if path not in _counters:
        with open(path, "rb") as f:
            _counters[path] = Counter({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})
    return _counters[path]


def count_tokens(array, path: str = VOCABULARY) -> np.ndarray:
    """Tokens of each text of an Arrow string array."""
    counter = load(path)
    raw, off = utf8_buffers(array)
    out = np.zeros(len(off) - 1, np.int64)
    for a, b in groups_of(off, _GROUP):
        buf, o = raw[off[a] : off[b]], off[a : b + 1] - off[a]
        if not len(buf):
            continue
        cp = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((buf & 0xC0) != 0x80)
        first = np.searchsorted(place, o)
        begin = place[boundaries(symbols(cp, first), first)]
        begins = np.zeros(len(buf), bool)
        begins[begin] = True
        total = np.concatenate([[0], np.cumsum(counter.count(buf, begins), dtype=np.int64)])
        out[a:b] = total[o[1:]] - total[o[:-1]]
    return out


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row, as the tokenizer itself would count.

    * null and empty texts have 0 tokens; null ids are carried
    * repeated rows each give a row; an empty table gives an empty result
    * very long texts are read whole, and very long words without a limit
    * strings that look like special tokens are ordinary text
    * other columns are ignored, whatever their names
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(count_tokens(b.column("text"), path))], ["doc_id", "n_tokens"])

    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return one.mapInArrow(run, "doc_id long, n_tokens long")
