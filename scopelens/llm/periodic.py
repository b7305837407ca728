"""Periodic run detection in the words of a text, after Kolpakov and Kucherov, and collapsing of repeats.

A run is a maximal stretch of consecutive words with smallest period q, of at least ``LEAST`` words and two
periods. A suffix automaton of the words gives their LZ factorisation: each factor is the longest stretch that
also starts further left. A run whose last word lies in a factor and which begins further left reaches back less
than that factor and two of the one before it (Main's bound), so common prefixes and suffixes of the factor and
of so many words before it give all runs that cross or touch its start. The other runs lie inside a factor, and
are copied from its earlier occurrence. Everything is linear in the words.

Most words need none of this. At least ``LEAST`` / 2 words from each end of a run are repeated a period
further, so every word of a run is in a stretch of that length which occurs twice; arrays over all texts find
these by sorted hashes, cut the texts where no such stretch covers a word, and look again for what occurs twice
within a piece, a few times over. Hash collisions can only keep more. Each piece is then searched by itself:
it holds all of any run that it holds some of, with the words on both sides.

Defined cases: null, empty and short texts have no runs; repeated rows have equal results; very long texts are
read whole, with about 200 bytes for each word of a piece; of runs of equal length the first comes first, then
that of smaller period; an empty table gives an empty result. Other columns pass through; those named like a
result are replaced.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, mix, rolled, steps, tune

LEAST = 12
#: Looks at what occurs twice within the pieces; further ones would only make pieces smaller.
ROUNDS = 8
#: White space between words, as a regular expression of the JVM.
GAP = r"[\x20\x09-\x0D]+"


class _Automaton:
    """A suffix automaton in packed arrays; a state's first edge is kept in two of them, further ones in a dictionary."""

    def __init__(self, word: list[int]):
        self.first = array("i", [0])  # the end of each state's first occurrence
        length, link = array("i", [0]), array("i", [-1])
        label, target = array("i", [-1]), array("i", [-1])
        more: dict[tuple[int, int], int] = {}
        others: dict[int, list[int]] = {}
        last = 0
        for i, c in enumerate(word):
            new = len(length)
            length.append(i + 1)
            self.first.append(i + 1)
            link.append(0)
            label.append(-1)
            target.append(-1)
            p = last
            while p >= 0:
                if label[p] == c:
                    q = target[p]
                    break
                q = more.get((p, c), -1)
                if q >= 0:
                    break
                if label[p] < 0:
                    label[p], target[p] = c, new
                else:
                    more[p, c] = new
                    others.setdefault(p, []).append(c)
                p = link[p]
            if p >= 0:
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(length)
                    length.append(length[p] + 1)
                    self.first.append(self.first[q])
                    link.append(link[q])
                    label.append(label[q])
                    target.append(target[q])
                    if q in others:
                        others[twin] = list(others[q])
                        for x in others[q]:
                            more[twin, x] = more[q, x]
                    while p >= 0:
                        if label[p] == c:
                            if target[p] != q:
                                break
                            target[p] = twin
                        elif more.get((p, c)) == q:
                            more[p, c] = twin
                        else:
                            break
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.label, self.target, self.more = label, target, more

    def factors(self, word: list[int]) -> list[tuple[int, int, int]]:
        """(start, end, earlier start): the longest stretches that also start further left; -1 for a new word."""
        label, target, more, first = self.label, self.target, self.more, self.first
        out, i, n = [], 0, len(word)
        while i < n:
            state, j = 0, i
            while j < n:
                c = word[j]
                to = target[state] if label[state] == c else more.get((state, c), -1)
                if to < 0 or first[to] > j:  # its first occurrence ends no earlier than here
                    break
                state, j = to, j + 1
            out.append((i, j, first[state] - (j - i)) if j > i else (i, i + 1, -1))
            i = out[-1][1]
        return out


def _prefixes(word: list[int]) -> list[int]:
    """How many words from each place on equal the first ones."""
    n = len(word)
    z = [0] * n
    if n:
        z[0] = n
    lo = hi = 0
    for i in range(1, n):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        while i + k < n and word[k] == word[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return z


def _crossing(word: list[int], b: int, end: int, reach: int, out: set[tuple[int, int, int]]) -> None:
    """Adds (start, end, period) of the runs that cross or touch ``b``, of which no more than ``reach`` words lie before it."""
    u, t = word[b:end], word[b - reach : b]
    n, m = len(u), len(t)
    back = t[::-1]
    right = _prefixes(u)  # of u at q
    left = _prefixes(back)  # of reversed t at q
    u_on_t = _prefixes([*u, -1, *t])[n + 1 :]  # u against the end of t
    t_on_u = _prefixes([*back[:n], -1, *u[::-1]])[min(n, m) + 1 :] if m else []
    size = len(word)

    def keep(s: int, e: int, q: int) -> None:
        if e - s >= LEAST and e - s >= 2 * q and (s == 0 or word[s - 1] != word[s - 1 + q]) and (e == size or word[e] != word[e - q]):
            out.add((s, e, q))

    for q in range(1, n + 1):  # the second half of a square lies in u
        ahead = right[q] if q < n else 0
        behind = t_on_u[n - q] if m else 0
        if ahead + behind >= q:
            keep(b - behind, b + q + ahead, q)
    for q in range(1, m + 1):  # or the first one in t
        behind = left[q] if q < m else 0
        ahead = u_on_t[m - q]
        if ahead >= q:
            ahead = q + (right[q] if q < n else 0)
        if ahead + behind >= q:
            keep(b - q - behind, b + ahead, q)


def runs(word: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of a sequence of numbers from 0 on, by start and period."""
    word = [*word, max(word, default=0) + 1]  # a last factor of its own, so that runs at the end touch its start
    factors = _Automaton(word).factors(word)
    found: set[tuple[int, int, int]] = set()
    before = 0
    for b, e, _ in factors:
        if b:
            _crossing(word, b, e, min(b, (e - b) + 2 * before), found)
        before = e - b
    # Only the smallest period of a stretch counts: others of the same stretch are its multiples.
    least: dict[tuple[int, int], int] = {}
    for s, e, q in found:
        least[s, e] = min(q, least.get((s, e), q))
    starts: dict[int, list[tuple[int, int]]] = {}
    for (s, e), q in least.items():
        starts.setdefault(s, []).append((e, q))
    for own in starts.values():
        own.sort()
    for b, e, earlier in factors:
        if e - b <= LEAST:
            continue
        shift = b - earlier
        for s in range(earlier + 1, e - shift):  # runs strictly inside the factor, from those inside its occurrence
            for end, q in starts.get(s, ()):
                if end >= e - shift:
                    break
                own = starts.setdefault(s + shift, [])
                if (end + shift, q) not in own:
                    own.append((end + shift, q))
                    own.sort()
    return sorted((s, e, q) for s, own in starts.items() for e, q in own)


def _pieces(h: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of words outside of which no run has a word; the texts follow each other in ``h``."""
    half = LEAST // 2
    n = len(h) - half + 1
    if n <= 0:
        return []
    wide = rolled(h, half, 0xD1342543DE82EF95)
    at = np.flatnonzero(doc[:n] == doc[half - 1 :])
    group = doc[at].astype(np.int64)
    for k in range(ROUNDS):
        key = mix(group.astype(U64) * U64(0x9E3779B97F4A7C15) ^ wide[at])
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        if k and twice.all():
            break
        at = at[twice]
        if not len(at):
            return []
        # Covered words next to each other in one text make a piece.
        new = np.r_[True, (at[1:] > at[:-1] + half) | (doc[at[1:]] != doc[at[:-1]])]
        group = np.cumsum(new) - 1
        first = at[new]
        end = at[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]] + half
    long = end - first >= LEAST
    return list(zip(first[long].tolist(), end[long].tolist(), strict=True))


def _found(batches: Iterator[pa.RecordBatch], passed: list[str], kinds: pa.DataType) -> Iterator[pa.RecordBatch]:
    for b in steps(batches, "text"):
        w = Words(b.column("text"))
        h = w.hashes()
        lists: list[list[dict]] = [[] for _ in range(b.num_rows)]
        drop = np.zeros(len(w) + 1, np.int64)
        for lo, hi in _pieces(h, w.doc):
            d = int(w.doc[lo])
            base = lo - int(w.first[d])
            for s, e, q in runs(np.unique(h[lo:hi], return_inverse=True)[1].tolist()):
                lists[d].append({"start": base + s, "length": e - s, "period": q})
                drop[lo + s + q] += 1
                drop[lo + e] -= 1
        kept = np.cumsum(drop)[:-1] == 0
        text, place = w.joined()
        mask = np.repeat(kept, np.diff(place))
        left = np.r_[0, np.cumsum(kept)]
        some = np.flatnonzero(np.diff(left[w.first]) > 0)
        last = np.flatnonzero(kept)[left[w.first[1:]][some] - 1]
        mask[place[last + 1] - 1] = False  # no space after a text's last word
        total = np.r_[0, np.cumsum(mask)]
        new = pa.Array.from_buffers(pa.large_string(), b.num_rows, [None, pa.py_buffer(total[place[w.first]].astype(np.int64)), pa.py_buffer(text[mask])])
        yield pa.RecordBatch.from_pydict({c: b.column(c) for c in passed} | {"runs": pa.array(lists, kinds), "collapsed": new.cast(pa.string())})


RESULTS = ("runs", "collapsed")


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with ``runs``, all runs of the words of ``text`` by start and period, and ``collapsed``, the words that
    no run holds after its first period, joined by single spaces.
    """
    tune(docs.sparkSession)
    passed = [(c, t) for c, t in docs.dtypes if c not in RESULTS]
    schema = ", ".join([f"`{c}` {t}" for c, t in passed] + ["runs array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed string"])
    kinds = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    names = [c for c, _ in passed]
    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(lambda batches: _found(batches, names, kinds), schema)


def with_loops(docs: DataFrame) -> DataFrame:
    """``docs`` where a tenth of the texts, drawn by the checksum of the id, end in a repetition of some of their words."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", GAP), lambda w: w != "")

    def looped(w: Column) -> Column:
        n = F.size(w)
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        copies = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), copies)), F.lit(1), n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")).otherwise("")

    changed = F.transform(F.array(words), looped)[0]
    return docs.withColumn("text", F.when((h % 10 == 0) & F.col("text").isNotNull(), changed).otherwise(F.col("text")))


def longest(runs_: Column) -> Column:
    """The run of greatest length; of equal ones the one of smallest start, then period."""
    best = F.array_max(F.transform(runs_, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))
