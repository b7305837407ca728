"""Substring dedup: every word covered by a window of words that starts anywhere else is removed.

Windows of ``WINDOW`` words are never shuffled one by one. The minimiser of a window is the smallest hash of
its runs of ``RUN`` words; consecutive windows mostly share it, and they travel as one packed string (a
super-k-mer) to the minimiser's bucket. Equal windows have equal minimisers, so a bucket sees all
places of its windows: it sorts them by a hash and compares neighbours that share it word by word.

A minimiser that carries far more windows than a bucket should hold (a passage that many documents repeat)
would load one bucket. A first pass over all documents finds those by bounded counts, however thin they are
spread. Their windows travel as strings of one window each, spread by the window's own hash, and each step of a
task sends every distinct one once; what a step has twice it knows to be repeated. The buckets treat these
strings like all others.

Defined cases: null, empty and short texts have no window and lose nothing; repeated rows repeat all their
windows, so long ones lose all words; very long texts are cut nowhere; an empty table gives an empty result;
other columns pass through, but columns named ``_words`` and ``_removed`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEND_BYTES, U64, Heavy, Words, by_partition, cut, free, from_blob, heavy_keys, mix, rolled, shuffle_partitions, steps, text_key, to_blob, trim, tune

WINDOW, RUN = 35, 4
#: Bucket partitions for each shuffle partition: packed strings are about three times the text.
PARTS = 2
#: Windows of a bucket partition, whose strings a task holds at once; windows below which no minimiser is heavy.
PART_WINDOWS, LEAST_HEAVY = 2_000_000, 64
_WIDE = 0xB492B66FBE98F273


class _Windows:
    """Windows of a step's texts: super-k-mers as (first window, windows, minimiser)."""

    def __init__(self, texts: pa.Array):
        self.words = w = Words(texts)
        self.hash = w.hashes()
        n = len(w) - WINDOW + 1
        if n <= 0:
            self.first = self.count = np.zeros(0, np.int64)
            self.minimiser = np.zeros(0, np.int64)
            return
        low = rolled(self.hash, RUN, 0x9FB21C651E98DF25)
        width, done = WINDOW - RUN + 1, 1
        while done < width:  # minima over ever longer stretches
            by = min(done, width - done)
            low = np.minimum(low[:-by], low[by:])
            done += by
        valid = w.doc[:n] == w.doc[WINDOW - 1 :]
        begins = valid.copy()
        begins[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
        ends = valid.copy()
        ends[:-1] &= ~valid[1:] | (low[1:] != low[:-1])
        self.first = np.flatnonzero(begins)
        self.count = np.flatnonzero(ends) + 1 - self.first
        self.minimiser = low[self.first].view(np.int64)


def _loads(parts: int):
    """Windows by minimiser, of those that may be heavy, and all windows under null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = Heavy(parts)
        for b in steps(batches, "text"):
            w = _Windows(b.column("text"))
            heavy.add(w.minimiser, w.count)
        keys, weights = heavy.rows()
        yield pa.RecordBatch.from_pydict({"key": pa.array([*keys.tolist(), None], pa.int64()), "weight": pa.array(weights)})

    return run


def _target(h: np.ndarray, parts: int) -> np.ndarray:
    return ((mix(h.view(U64)) >> U64(32)) * U64(parts) >> U64(32)).astype(np.int32)


def _send(hot: np.ndarray, parts: int):
    """Step by step: one blob for each target partition, of packed strings and of ranges that are known to be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text", SEND_BYTES):
            w = _Windows(b.column("text"))
            if not len(w.first):
                continue
            doc, key = b.column("doc_id"), b.column("_key")
            words = w.words
            text, at = words.joined()
            text = text.tobytes()
            heavy = np.isin(w.minimiser, hot)
            place, n, to = w.first[~heavy], w.count[~heavy], _target(w.minimiser[~heavy], parts)
            begin = lengths = np.zeros(0, np.int64)
            if heavy.any():
                f, c = w.first[heavy], w.count[heavy]
                win = np.repeat(f - (np.cumsum(c) - c), c) + np.arange(c.sum())
                h = rolled(w.hash, WINDOW, _WIDE)[win]
                order = np.argsort(h, kind="stable")
                h, win = h[order], win[order]
                equal = np.r_[False, (h[1:] == h[:-1]) & _same(text, at, win)]
                start = np.flatnonzero(~equal)
                size = np.diff(np.r_[start, len(win)])
                again = np.sort(win[np.repeat(size > 1, size)])
                # Neighbouring repeated windows of a text make one range.
                if len(again):
                    split = np.flatnonzero(np.r_[True, (np.diff(again) != 1) | (words.doc[again[1:]] != words.doc[again[:-1]])])
                    lengths, begin = np.diff(np.r_[split, len(again)]), again[split]
                place, n = np.r_[place, win[start]], np.r_[n, np.ones(len(start), np.int64)]
                to = np.r_[to, _target(h[start], parts)]
            packed = [text[s:e] for s, e in zip(at[place].tolist(), (at[place + n + WINDOW - 1] - 1).tolist(), strict=True)]
            known = np.r_[np.zeros(len(place), bool), np.ones(len(begin), bool)]
            place, n = np.r_[place, begin], np.r_[n, lengths]
            to = np.r_[to, _target(mix(begin.astype(U64)), parts)]
            d = words.doc[place]
            rows = {
                "known": pa.array(known), "doc_id": doc.take(pa.array(d)), "_key": key.take(pa.array(d)),
                "at": pa.array((place - words.first[d]).astype(np.int32)), "n": pa.array(n.astype(np.int32)),
                "text": pa.array([*packed, *[None] * len(begin)], pa.binary()),
            }
            order = np.argsort(to, kind="stable")
            table = pa.RecordBatch.from_pydict(rows).take(pa.array(order))
            to = to[order]
            start = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            out = []
            for s, e in zip(start.tolist(), [*start[1:].tolist(), len(to)], strict=True):
                part = table.slice(s, e - s)
                out.append(to_blob(level=5, **{c: part.column(c) for c in part.schema.names}))
            yield pa.RecordBatch.from_pydict({"part": pa.array(to[start]), "blob": pa.array(out, pa.binary())})

    return run


def _same(text: bytes, place: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each window's words equal those of the window before it."""
    s, e = place[first].tolist(), place[first + WINDOW].tolist()
    return np.array([text[a:b] == text[c:d] for a, b, c, d in zip(s[1:], e[1:], s, e, strict=False)], bool)


def _ranges(doc: pa.Array, key: pa.Array, owner: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Repeated windows (row, place) as word ranges; rows are super-k-mers, so neighbours make one range."""
    order = np.lexsort((at, owner))
    owner, at = owner[order], at[order]
    split = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)])
    n = np.diff(np.r_[split, len(at)])
    return pa.RecordBatch.from_pydict({
        "_doc": doc.take(pa.array(owner[split])), "_key": key.take(pa.array(owner[split])),
        "lo": pa.array(at[split].astype(np.int32)), "hi": pa.array((at[split] + n + WINDOW - 1).astype(np.int32)),
    })


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's blobs to the word ranges of its repeated windows."""
    trim()
    tables = [from_blob(x.as_buffer()) for b in batches for x in b.column("blob")]
    if not tables:
        return
    t = pa.concat_tables(tables).combine_chunks()
    del tables
    is_known = t.column("known").to_numpy()
    doc, key = t.column("doc_id").combine_chunks(), t.column("_key").combine_chunks()
    at, n = t.column("at").to_numpy(), t.column("n").to_numpy()
    at_of = at.astype(np.int64)

    known = np.flatnonzero(is_known)
    if len(known):
        yield pa.RecordBatch.from_pydict({"_doc": doc.take(pa.array(known)), "_key": key.take(pa.array(known)), "lo": pa.array(at[known]), "hi": pa.array((at[known] + n[known] + WINDOW - 1).astype(np.int32))})

    rows = np.flatnonzero(~is_known)
    if not len(rows):
        return
    packed = t.column("text").combine_chunks().take(pa.array(rows))
    del t
    # Hashes are made a stretch of strings at a time; what is kept of a window is its hash and its first word.
    hashes, firsts, texts, places = [], [], [], []
    n_words = n_bytes = 0
    starts = [np.zeros(1, np.int64)]  # of each string, counted in words
    for b in steps(iter([pa.RecordBatch.from_arrays([packed], ["text"])]), "text"):
        w = Words(b.column("text"))
        text, place = w.joined()
        h = rolled(w.hashes(), WINDOW, _WIDE)
        win = np.flatnonzero(w.doc[: len(h)] == w.doc[WINDOW - 1 :])
        hashes.append(h[win])
        firsts.append(win + n_words)
        texts.append(text.tobytes())
        places.append(place[:-1] + n_bytes)
        starts.append(w.first[1:] + n_words)
        n_words, n_bytes = n_words + len(w), n_bytes + len(text)
    del packed
    places.append(np.array([n_bytes]))
    data, place, start = b"".join(texts), np.concatenate(places), np.concatenate(starts)
    del texts, places
    a, first = np.concatenate(hashes), np.concatenate(firsts)
    del hashes, firsts
    order = np.argsort(a)
    near = a[order[1:]] == a[order[:-1]]
    member = np.zeros(len(a), bool)  # only windows that share a hash are looked at further
    member[1:] |= near
    member[:-1] |= near
    order = order[member]
    if not len(order):
        return
    a, first = a[order], first[order]
    equal = (a[1:] == a[:-1]) & _same(data, place, first)
    if (clash := np.flatnonzero((a[1:] == a[:-1]) & ~equal)).size:
        # Different windows under one hash: these few are put in the order of their words.
        for h in np.unique(a[clash]).tolist():
            at = np.flatnonzero(a == U64(h))
            first[at] = sorted(first[at].tolist(), key=lambda i: data[place[i] : place[i + WINDOW]])
        equal = (a[1:] == a[:-1]) & _same(data, place, first)
    twice = np.zeros(len(order), bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    if twice.any():
        hit = first[twice].astype(np.int64)
        row = np.searchsorted(start, hit, "right") - 1
        yield _ranges(doc, key, rows[row], at_of[rows[row]] + hit - start[row])


def _without(batches: Iterator[pa.RecordBatch], ranges_name: str, passed: list[str]) -> Iterator[pa.RecordBatch]:
    """Texts without the words in their ranges."""
    for b in steps(batches, "text"):
        w = Words(b.column("text"))
        ranges = b.column(ranges_name)
        flat = ranges.flatten()
        owner = np.repeat(np.arange(len(ranges)), np.asarray(pc.fill_null(pc.list_value_length(ranges), 0)))
        lo, hi = (np.asarray(flat.field(i)).astype(np.int64) + w.first[owner] for i in (0, 1))
        depth = np.zeros(len(w) + 1, np.int64)
        np.add.at(depth, lo, 1)
        np.add.at(depth, hi, -1)
        keep = np.cumsum(depth[:-1]) == 0
        text, place = w.joined()
        kept = np.r_[0, np.cumsum(keep)]
        # The space after each kept word stays, but for a text's last one.
        mask = np.repeat(keep, w.length + 1)
        left = np.diff(kept[w.first])
        last = np.flatnonzero(keep)[(kept[w.first[1:]] - 1)[left > 0]]
        mask[place[last + 1] - 1] = False
        total = np.r_[0, np.cumsum(mask)]
        bounds = total[place[w.first]]
        data = text[mask]
        new = pa.Array.from_buffers(pa.large_string(), len(ranges), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())
        n_words = np.diff(w.first)
        out = {c: b.column(c) for c in passed}
        yield pa.RecordBatch.from_pydict(out | {"text": new, "_words": pa.array(n_words, pa.int64()), "_removed": pa.array(n_words - left, pa.int64())})


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(_doc, _key, lo, hi): word ranges that repeated windows cover; together with the id, _key names a text."""
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("_key"), "text")
    parts = PARTS * shuffle_partitions(spark)
    hot, total = heavy_keys(rows.select("text").mapInArrow(_loads(parts), "key bigint, weight bigint"), parts, LEAST_HEAVY)
    parts = max(parts, total // PART_WINDOWS)
    blobs = rows.mapInArrow(_send(hot, parts), "part int, blob binary")
    return by_partition(blobs, parts, "part").mapInArrow(_count, "_doc bigint, _key bigint, lo int, hi int")


def remove_repeated(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept words as ``text``, and with ``_words`` and ``_removed``, their numbers before."""
    doc, key, key2, ranges = (free(docs, c) for c in ("doc", "key", "key2", "ranges"))
    # Equal rows have the same ranges, which each task names once, so a text's list is bounded by its words.
    found = repeated_ranges(docs).groupBy("_doc", "_key").agg(F.collect_set(F.struct("lo", "hi")).alias(ranges))
    found = found.withColumnsRenamed({"_doc": doc, "_key": key2})
    rows = docs.withColumn(key, text_key())
    joined = rows.join(found, rows["doc_id"].cast("bigint").eqNullSafe(found[doc]) & (rows[key] == found[key2]), "left")
    passed = [(c, t) for c, t in docs.dtypes if c not in ("text", "_words", "_removed")]
    names = [c for c, _ in passed]
    schema = ", ".join([f"`{c}` {t}" for c, t in passed] + ["text string", "_words bigint", "_removed bigint"])
    return joined.select(*[F.col(f"`{c}`") for c in [*names, "text", ranges]]).mapInArrow(lambda batches: _without(batches, ranges, names), schema)
