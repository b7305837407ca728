"""Byte-level BPE, encoding and decoding, with the ranks of a given vocabulary file.

Pre-tokenisation runs without regex. Every code point gets a class (letter, number, space kinds, other, the
apostrophe of a contraction), and each class is a function on the eight states of a small automaton for

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Composition of functions is associative, so the state before every code point comes from a blocked scan: all
blocks compose their functions side by side, the blocks' functions are scanned the same way, and a second
pass marks the boundaries. The slices between boundaries tile the text's bytes; Arrow dictionary-encodes
them without a copy, and only slices not seen before go to the merges, which run on all of them at once.
Token ids keep their byte offsets if asked for; decoding lays the tokens' bytes end to end.

Defined cases: a null or empty text has no tokens and decodes to no bytes; texts of any length are encoded
whole; repeated rows each give a row; other columns pass through.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import steps, tune

#: Slices that a worker remembers, and their bytes; past either it starts anew.
CACHE, CACHE_BYTES = 250_000, 32 << 20
#: Longer slices are merged one at a time with a heap, which takes n log n steps.
LONG = 384
_BLOCK = 64

# Symbols of the automaton. P: the last space character before other text, being U+0020; V: the same, being
# another one; W: any other space character; Q1, Q2: an apostrophe followed by a contraction's 1 or 2 letters.
_L, _N, _O, _Q1, _Q2, _W, _P, _V = range(8)
# States: the open token is of letters, numbers, others, spaces; one U+0020 that joins what follows; a
# contraction lacking 1 or 2 letters; none.
_SL, _SN, _SO, _SS, _SA, _SC1, _SC2, _SX = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and boundary by (symbol, state); symbols from 8 on begin a text."""
    step, bound = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    opens = {_L: _SL, _N: _SN, _O: _SO, _Q1: _SC1, _Q2: _SC2, _W: _SS, _P: _SA, _V: _SX}
    for symbol, state in opens.items():
        step[symbol], step[symbol + 8] = state, state
    for symbol, state in ((_L, _SL), (_N, _SN), (_O, _SO), (_Q1, _SO), (_Q2, _SO)):
        for before in (state, _SA):
            step[symbol, before], bound[symbol, before] = state, False
    for before, after in ((_SC1, _SX), (_SC2, _SC1)):
        step[_L, before], bound[_L, before] = after, False
    bound[_W, _SS] = False
    return step, bound


_STEP, _BOUND = _automaton()


@lru_cache(1)
def _classes() -> np.ndarray:
    """Letter, number, space or other, for every code point."""
    out = np.full(0x110000, _O, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = _L if kind == "L" else _N
    # The code points with the property White_Space.
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _W
    return out


def _symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The automaton's symbol of every code point; ``first`` marks those that begin a text."""
    s = _classes()[points]
    n = len(s)
    same = np.zeros(n, bool)  # the next code point belongs to the same text
    same[:-1] = ~first[1:]
    space = s == _W
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & same[:-1]
    s[last] = np.where(points[last] == 0x20, _P, _V)
    q = np.flatnonzero((points == 0x27) & same)
    if len(q):
        c1 = points[q + 1]
        s[q[np.isin(c1, [ord(c) for c in "stmd"])]] = _Q1
        q2 = q[(q + 2 < n) & np.isin(c1, [ord(c) for c in "rvl"])]
        q2 = q2[same[q2 + 1]]
        c1, c2 = points[q2 + 1], points[q2 + 2]
        s[q2[((c1 == ord("l")) & (c2 == ord("l"))) | ((c1 != ord("l")) & (c2 == ord("e")))]] = _Q2
    s[first] += 8
    return s


def _states(functions: np.ndarray) -> np.ndarray:
    """The state before each of the functions (n x 8), from state 'none' on: a scan by blocks of blocks."""
    n = len(functions)
    if n <= _BLOCK:
        out, state = np.zeros(n, np.uint8), _SX
        for i in range(n):
            out[i], state = state, functions[i, state]
        return out
    lanes = -(-n // _BLOCK)
    padded = np.empty((lanes * _BLOCK, 8), np.uint8)
    padded[:n], padded[n:] = functions, np.arange(8, dtype=np.uint8)
    f = padded.reshape(lanes, _BLOCK, 8)
    whole = f[:, 0].copy()
    for j in range(1, _BLOCK):
        whole = np.take_along_axis(f[:, j], whole, 1)
    state = _states(whole)
    out = np.empty((lanes, _BLOCK), np.uint8)
    rows = np.arange(lanes)
    for j in range(_BLOCK):
        out[:, j] = state
        state = f[rows, j, state]
    return out.reshape(-1)[:n]


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which code points begin a slice."""
    s = _symbols(points, first)
    n = len(s)
    lanes = -(-n // _BLOCK)
    padded = np.full(lanes * _BLOCK, _O, np.uint8)
    padded[:n] = s
    by_step = np.ascontiguousarray(padded.reshape(lanes, _BLOCK).T)
    flat = _STEP.reshape(-1)
    whole = np.tile(np.arange(8, dtype=np.uint8), (lanes, 1))
    for j in range(_BLOCK):
        whole = flat[(by_step[j].astype(np.uint16) * 8)[:, None] + whole]
    state = _states(whole)
    out = np.empty((_BLOCK, lanes), bool)
    edge = _BOUND.reshape(-1)
    for j in range(_BLOCK):
        at = by_step[j].astype(np.uint16) * 8 + state
        out[j], state = edge[at], flat[at]
    return out.T.reshape(-1)[:n]


class Vocabulary:
    """Ranks of a vocabulary file, its pairs as a sorted table, and the cache of slices."""

    def __init__(self, ranks_file: bytes):
        self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line.strip())}
        size = max(self.ids.values()) + 1
        tokens = [b""] * size
        for k, v in self.ids.items():
            tokens[v] = k
        self.token_length = np.array([len(t) for t in tokens])
        self.token_start = np.r_[0, np.cumsum(self.token_length)]
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for k, v in self.ids.items():
            for i in range(1, len(k)):
                a, b = self.ids.get(k[:i]), self.ids.get(k[i:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = v
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.pairs = pairs
        self.forget()

    def forget(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.held = 0
        self.pool, self.pool_n = np.zeros(1 << 20, np.uint32), 0
        self.at, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ids[at], 1 << 40)

    def _merge_long(self, piece: bytes) -> list[int]:
        ids = [int(self.byte_ids[b]) for b in piece]
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := self.pairs.get(a << 20 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (s := self.pairs.get(ids[x] << 20 | ids[y])) is not None:
                    heapq.heappush(heap, (s, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def _merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and their counts: in each round every piece merges its leftmost best pair."""
        count = np.array([len(p) for p in pieces])
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), count)
        done_ids, done_owner = [], []
        none = 1 << 40
        rank = np.full(len(ids), none)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self._ranks(ids[inner], ids[inner + 1])
        while len(ids):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(ids)])
            over = best >= none
            if over.any():
                gone = np.repeat(over, size)
                done_ids.append(ids[gone])
                done_owner.append(owner[gone])
                ids, owner, rank = ids[~gone], owner[~gone], rank[~gone]
                if not len(ids):
                    break
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                best, size = best[~over], size[~over]
            hits = np.flatnonzero(rank == np.repeat(best, size))
            at = hits[np.r_[True, owner[hits[1:]] != owner[hits[:-1]]]]
            ids[at] = best
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            ids, owner, rank, at = ids[keep], owner[keep], rank[keep], moved[at]
            for x in (at, at[at > 0] - 1):
                ok = x[(x + 1 < len(ids))]
                ok = ok[owner[ok] == owner[ok + 1]]
                rank[x] = none
                rank[ok] = self._ranks(ids[ok], ids[ok + 1])
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(pieces))

    def lookup(self, pieces: list[bytes]) -> np.ndarray:
        """The places of these distinct slices in the pool."""
        if len(self.seen) > CACHE or self.held > CACHE_BYTES:
            self.forget()
        get = self.seen.get
        out = [get(p, -1) for p in pieces]
        new = [i for i, x in enumerate(out) if x < 0]
        if new:
            whole, short, long = [], [], []
            for i in new:
                p = pieces[i]
                (whole if p in self.ids else short if len(p) <= LONG else long).append(i)
            groups = []
            if whole:
                groups.append((whole, np.array([self.ids[pieces[i]] for i in whole]), np.ones(len(whole), np.int64)))
            if short:
                groups.append((short, *self._merge([pieces[i] for i in short])))
            for i in long:
                ids = self._merge_long(pieces[i])
                groups.append(([i], np.array(ids), np.array([len(ids)])))
            for where, ids, count in groups:
                n, k = self.pool_n + len(ids), len(self.seen)
                while n > len(self.pool):
                    self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
                while k + len(where) > len(self.at):
                    self.at, self.count = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.count, np.zeros_like(self.count)])
                self.pool[self.pool_n : n] = ids
                self.at[k : k + len(where)] = self.pool_n + np.cumsum(count) - count
                self.count[k : k + len(where)] = count
                self.held += sum(len(pieces[i]) for i in where)
                for j, i in enumerate(where):
                    self.seen[pieces[i]] = out[i] = k + j
                self.pool_n = n
        return np.array(out, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the place of each text's first (one more entry at the end)."""
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        bounds = off - off[0] if len(off) else np.zeros(1, np.int64)
        if not len(off) or off[-1] == off[0]:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]]
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        first = np.zeros(len(raw), bool)
        first[bounds[:-1][bounds[:-1] < len(raw)]] = True
        cut = lead[boundaries(points, first[lead])]
        edges = np.r_[cut, len(raw)].astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(edges), pa.py_buffer(raw)]).dictionary_encode()
        place = self.lookup(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()]
        count = self.count[place]
        ends = np.cumsum(count)
        ids = self.pool[np.repeat(self.at[place] - (ends - count), count) + np.arange(ends[-1])]
        return ids, np.r_[0, ends][np.searchsorted(cut, bounds)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids end to end."""
        n = self.token_length[ids]
        ends = np.cumsum(n)
        return self.token_bytes[np.repeat(self.token_start[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


_LOADED: dict[int, Vocabulary] = {}


def _vocabulary(ranks_file: bytes) -> Vocabulary:
    """One per Python worker."""
    key = hash(ranks_file)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(ranks_file)
    return _LOADED[key]


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Slices of ``values`` between ``bounds`` as a binary column."""
    at = (bounds * values.itemsize).astype(np.int64)
    wide = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])
    return wide.cast(pa.binary())


def encode(docs: DataFrame, ranks_path: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """Replaces ``text`` by ``ids`` (little-endian unsigned 32-bit integers) and ``n_tokens``.

    With ``offsets``, ``starts`` has each token's first byte in the text, as 32-bit integers too.
    """
    tune(docs.sparkSession)
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary file: its size is fixed
    others = [c for c in docs.columns if c not in (text, "ids", "n_tokens", "starts")]
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(ranks.value)
        for b in steps(batches, text):
            ids, at = v.encode(b.column(text))
            out = {c: b.column(c) for c in others} | {"ids": _binary(ids.astype("<u4"), at), "n_tokens": pa.array(np.diff(at), pa.int64())}
            if offsets:
                n = v.token_length[ids]
                start = np.cumsum(n) - n
                base = np.repeat(np.r_[start, 0][at[:-1]] if len(ids) else at[:-1], np.diff(at))
                out["starts"] = _binary((start - base).astype("<u4"), at)
            yield pa.RecordBatch.from_pydict(out)

    schema = [f"`{c}` {kinds[c]}" for c in others] + ["ids binary", "n_tokens bigint"] + ["starts binary"] * offsets
    return docs.select(*[f"`{c}`" for c in others], f"`{text}`").mapInArrow(run, ", ".join(schema))


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ``decoded``, the bytes that ``ids`` stand for."""
    with open(ranks_path, "rb") as f:
        ranks = tokens.sparkSession.sparkContext.broadcast(f.read())
    kinds = [(c, t) for c, t in tokens.dtypes if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(ranks.value)
        for b in steps(batches, "ids"):
            column = b.column("ids").cast(pa.large_binary())
            data = pc.fill_null(column, b"")
            off = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
            raw = data.buffers()[2]
            ids = np.frombuffer(raw, "<u4", (off[-1] - off[0]) // 4, off[0]) if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint32)
            ends = np.r_[0, np.cumsum(v.token_length[ids])]
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c, _ in kinds} | {"decoded": _binary(v.decode(ids), ends[(off - off[0]) // 4])})

    return tokens.select(*[f"`{c}`" for c, _ in kinds]).mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in kinds] + ["decoded binary"]))
