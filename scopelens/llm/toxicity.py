"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme values.

Model. Features of a word are the word and its first 4, 5 and 6 code points. Their log-odds between toxic and
clean training texts carry an informative Dirichlet prior (Monroe et al. 2008), and features whose z value is
at least ``Z`` in size, toxic or clean, score their log-odds less ``DRIFT``; every other word scores ``-DRIFT``.
Near copies count once. Scan. One linear pass (Ruzzo and Tompa 1999) finds all maximal-scoring segments of a
text; close repeats of a word score less each time. Calibration. By Karlin and Altschul (1990) the number of
segments of score S or more in n clean words is about K n exp(-lambda S), where lambda solves
sum p_i exp(lambda s_i) = 1 over the clean words' scores, and K is fitted by maximum likelihood to the best
segments of the clean training texts. A text's significance is -ln of the chance of its best segment; a
logistic curve over its logarithm, through the training texts, maps it to a probability.

Training takes at most ``MAX_ROWS`` labelled rows, in the order of a hash of the id; everything else covers
all rows. The model holds every significant feature of that sample. Only texts are inputs of a score.

Defined cases: null and empty texts have no segment and get the curve's lowest score; a null id counts as
training; a text that is labelled both ways, under one id or several, counts as toxic; repeated rows get equal
scores; without both kinds of labels every score is 0; an empty table gives an empty result; very long texts
are scanned whole; other columns pass through, but columns named ``score`` and ``passages`` are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, cut, mix, rolled, spans, steps, text_key, tune

MAX_ROWS = 10_000
Z, DRIFT, PRIOR = 4.0, 0.2, 500.0
#: Training texts that agree in one of so many bands of so many least shingle hashes count once.
BANDS, BAND = 16, 4
#: Texts that must have a feature, after near copies are removed.
MIN_TEXTS = 4
#: Occurrences of a word less than so many words apart damp each other.
REPEAT = 50
THRESHOLD = 0.7
_PREFIXES = (4, 5, 6)
#: Everything below 0x80 but digits and letters ends a word.
_BREAKS = np.ones(256, bool)
_BREAKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # sorted hashes
    scores: np.ndarray
    rate: float  # lambda
    scale: float  # K
    slope: float
    base: float

    def probability(self, significance: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(significance) + self.base, -40, 40)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _features(w: Words) -> list[np.ndarray]:
    return [w.hashes(), *w.prefix_hashes(_PREFIXES)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By feature: in how many toxic and clean texts of a step it occurs. Under feature 0: texts and words."""
    for b in steps(batches, "text"):
        w = Words(b.column("text"), lower=True, breaks=_BREAKS)
        toxic = np.asarray(b.column("toxic")).astype(np.int64)
        doc = np.tile(w.doc, 1 + len(_PREFIXES))
        f = np.concatenate(_features(w)).view(np.int64)
        order = np.lexsort((doc, f))
        f, doc = f[order], doc[order]
        new = np.ones(len(f), bool)
        new[1:] = (f[1:] != f[:-1]) | (doc[1:] != doc[:-1])
        f, y = f[new], toxic[doc[new]]
        first = np.flatnonzero(np.r_[True, f[1:] != f[:-1]]) if len(f) else np.zeros(0, np.int64)
        n = np.diff(np.r_[first, len(f)])
        n1 = np.add.reduceat(y, first) if len(f) else first
        words = np.diff(w.first)
        yield pa.RecordBatch.from_pydict({
            "feature": pa.array([*f[first].tolist(), None], pa.int64()),
            "n1": pa.array([*n1.tolist(), int(toxic.sum())], pa.int64()),
            "n0": pa.array([*(n - n1).tolist(), int((1 - toxic).sum())], pa.int64()),
            "w0": pa.array([*[0] * len(first), int(words[toxic == 0].sum())], pa.int64()),
        })


def _segments(at: np.ndarray, score: np.ndarray, cost: np.ndarray | None = None) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first word, last word) of a text, from its positive words alone.

    cost: the sum of the words before each of them, from the last one on; by default DRIFT for each of these.
    """
    total = 0.0
    found: list[list] = []  # [start sum, end sum, first, last, place of the last segment before it that starts lower]
    if cost is None:
        cost = DRIFT * (np.diff(at, prepend=-1) - 1)
    for i, s, c in zip(at.tolist(), score.tolist(), cost.tolist(), strict=True):
        total -= c
        start, first = total, i
        total += s
        j = len(found) - 1
        while j >= 0 and found[j][0] >= start:
            j = found[j][4]
        while j >= 0 and found[j][1] < total:  # the segments from j on grow together
            start, first, back = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = back
        found.append([start, total, first, i, j])
    return [(e - s, i, k) for s, e, i, k, _ in found]


def _significance(expected: np.ndarray) -> np.ndarray:
    """-ln of the chance of a segment where so many are expected, whatever their size: log(expected) is the input."""
    few = expected < -30
    chance = -np.expm1(-np.exp(np.where(few, 0.0, np.minimum(expected, 50))))
    return np.where(few, -expected, -np.log(np.maximum(chance, 1e-300)))


def _values(w: Words, features: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Each word's score: the best of its features that have one, else -DRIFT."""
    value = np.full(len(w), -np.inf)
    for h in _features(w):
        if len(features) and len(h):
            h = h.view(np.int64)
            at = np.minimum(np.searchsorted(features, h), len(features) - 1)
            value = np.maximum(value, np.where(features[at] == h, scores[at], -np.inf))
    return np.where(value == -np.inf, -DRIFT, value)


def _scan(texts: pa.Array, features: np.ndarray, scores: np.ndarray) -> list[tuple[int, list[tuple[float, int, int, int, int]]]]:
    """Each text's number of words and its segments: score, first and last word, and byte offsets."""
    w = Words(texts, lower=True, breaks=_BREAKS)
    value = _values(w, features, scores)
    hit = np.flatnonzero(value > 0)
    # The k-th of a word's occurrences that follow each other closely scores 1/k: a repeated junk word is weak evidence.
    word, doc = w.hashes()[hit], w.doc[hit]
    order = np.lexsort((hit, word, doc))
    near = (word[order[1:]] == word[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]]) & (np.diff(hit[order]) < REPEAT)
    place = np.arange(len(hit))
    start = np.maximum.accumulate(np.where(np.r_[False, near][: len(hit)], 0, place))
    value[hit[order]] /= place - start + 1
    fall = np.r_[0.0, np.cumsum(np.where(value > 0, 0.0, -value))]
    out: list = [(int(n), []) for n in np.diff(w.first)]
    docs = w.doc[hit]
    first, count = spans(docs)
    for s, e in zip(first.tolist(), (first + count).tolist(), strict=True):
        d = int(docs[s])
        base, begin = int(w.first[d]), int(w.bounds[d])
        got = _segments(hit[s:e] - base, value[hit[s:e]], np.diff(fall[hit[s:e]], prepend=fall[base]))
        out[d] = (out[d][0], [(x, i, j, int(w.start[base + i]) - begin, int(w.end[base + j]) - begin) for x, i, j in got])
    return out


def _best(scanned: list, rate: float) -> np.ndarray:
    """By text: log(n) - lambda S of its best segment, infinite without one."""
    return np.array([math.log(n) - rate * max(x[0] for x in got) if got else math.inf for n, got in scanned])


def _rate(scores: np.ndarray, chance: np.ndarray) -> float:
    """The positive root of sum p exp(r s) = 1, where all other clean words score -DRIFT."""
    rest = max(1 - chance.sum(), 1e-9)
    f = lambda r: float((chance * np.exp(np.minimum(r * scores, 600))).sum() + rest * math.exp(-r * DRIFT) - 1)
    if (chance * scores).sum() >= rest * DRIFT:
        return 1e-3  # clean text would drift upwards: nothing is significant
    low, high = 1e-6, 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, sketch, row) of every text: hashes of groups of its least shingle hashes under several orders."""
    for b in steps(batches, "text"):
        w = Words(b.column("text"), lower=True)
        h = w.hashes()
        s = rolled(h, 5, 0x9FB21C651E98DF25)
        ok = w.doc[: len(s)] == w.doc[4:] if len(s) else np.zeros(0, bool)
        s, doc = s[ok], w.doc[: len(s)][ok]
        first, _ = spans(doc)
        rows = b.column("row").to_numpy()[doc[first]]
        low = [np.minimum.reduceat(mix(s ^ U64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)), first) if len(first) else np.zeros(0, U64) for k in range(BANDS * BAND)]
        for k in range(BANDS):
            total = np.zeros(len(first), U64)
            for x in low[k * BAND : (k + 1) * BAND]:
                total = mix(total * U64(3) + x)
            yield pa.RecordBatch.from_pydict({"band": pa.array(np.full(len(first), k, np.int32)), "sketch": pa.array(total.view(np.int64)), "row": pa.array(rows)})


def _training_texts(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, toxic, row) of the sample: equal texts once, and texts with the sketch of an earlier one left out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # At most max_rows pairs of numbers, so the sample may be broadcast.
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    train = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(sample), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))
    train = cut(train.groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("row", text_key()))
    # Near copies would pass for support of every rare word in them; per band the least row stands for all that share its sketch.
    bands = train.select("row", "text").mapInArrow(_sketches, "band int, sketch bigint, row bigint")
    later = bands.groupBy("band", "sketch").agg(F.min("row").alias("least"), F.collect_set("row").alias("rows")).where(F.size("rows") > 1)
    drop = later.select("least", F.explode("rows").alias("row")).where("row <> least").select("row").distinct()
    return cut(train.join(drop, "row", "left_anti"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model of ``labels.toxic`` from the texts of training rows."""
    tune(docs.sparkSession)
    train = _training_texts(docs, labels, max_rows)
    counts = cut(train.mapInArrow(_counts, "feature bigint, n1 bigint, n0 bigint, w0 bigint").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.sum("w0").alias("w0")))
    nothing = Model(np.zeros(0, np.int64), np.zeros(0), 1.0, 1.0, 0.0, -30.0)
    whole = counts.where("feature IS NULL").first()
    if whole is None or not whole.n1 or not whole.n0:
        return nothing
    words = max(whole.w0, 1)
    # Totals over features, not texts: toxic texts may be longer or shorter than clean ones.
    d1, d0 = counts.where("feature IS NOT NULL").agg(F.sum("n1"), F.sum("n0")).first()
    if not d1 or not d0:
        return nothing
    share = d1 / (d1 + d0)
    y1, y0 = F.col("n1"), F.col("n0")
    a = PRIOR * 1e-2 * (y1 + y0) / (whole.n1 + whole.n0)
    delta = F.log((y1 + a) / (d1 + a - y1)) - F.log((y0 + a) / (d0 + a - y0))
    z = delta / F.sqrt(1 / (y1 + a) + 1 / (y0 + a))
    # Where one kind of text has no such feature, its variance is the prior's alone; there the chance that all
    # texts with it are of the other kind has to be as small as that of Z.
    tail = math.log(0.5 * math.erfc(Z / math.sqrt(2)))
    lone = ((y0 == 0) & (y1 * math.log(share) <= tail)) | ((y1 == 0) & (y0 * math.log(1 - share) <= tail))
    found = counts.where(f"feature IS NOT NULL AND n1 + n0 >= {MIN_TEXTS}").where((F.abs(z) >= Z) | lone)
    # The significant features of a bounded sample.
    rows = found.select("feature", delta.alias("delta"), "n0").orderBy("feature").collect()
    f, s, n0 = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float) - DRIFT, np.array([r[2] for r in rows], np.int64)
    if not (s > 0).any():
        return nothing

    def clean_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            v, k = np.unique(np.round(_values(Words(b.column("text"), lower=True, breaks=_BREAKS), f, s), 2), return_counts=True)
            yield pa.RecordBatch.from_pydict({"v": pa.array(v, pa.float64()), "k": pa.array(k, pa.int64())})

    clean = train.where("toxic = 0").select("text").mapInArrow(clean_scores, "v double, k bigint").groupBy("v").agg(F.sum("k").alias("k")).collect()  # by hundredths
    # A toxic feature that no clean training text has may still turn up in one.
    v, k = np.array([r.v for r in clean]), np.array([float(r.k) for r in clean])
    seen = v != round(-DRIFT, 2)
    unseen = (n0 == 0) & (s > 0)
    rate = _rate(np.r_[v[seen], s[unseen]], np.r_[k[seen], np.full(unseen.sum(), 0.01)] / words)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            x = _best(_scan(b.column("text"), f, s), rate)
            yield pa.RecordBatch.from_pydict({"x": pa.array(np.round(x * 4) / 4), "toxic": b.column("toxic")})

    bins = train.select("text", "toxic").mapInArrow(best, "x double, toxic int").groupBy("x", "toxic").count().collect()  # by quarters
    x, y, n = (np.array([r[i] for r in bins], float) for i in range(3))
    # The likeliest K: clean texts with a segment, over the sum of n exp(-lambda S); those without weigh their words.
    there = np.isfinite(x)
    spent = float((n * np.exp(np.where(there, x, 0.0)))[there & (y == 0)].sum())
    without = float(n[~there & (y == 0)].sum())
    scale = max(float(n[there & (y == 0)].sum()), 0.5) / max(spent + without * words / max(whole.n0, 1), 1e-9)
    sig = np.where(there, _significance(np.where(there, x, 0.0) + math.log(scale)), 0.0)
    return Model(f, s, rate, scale, *_logistic(np.log1p(sig), y, n))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and base by Newton steps, with a weak ridge so that separable data give finite values."""
    slope, base = 0.5, -2.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * x + base, -40, 40)))
        g = np.array([(n * (y - p) * x).sum() - 0.01 * slope, (n * (y - p)).sum() - 0.01 * base])
        v = n * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 0.01, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        slope, base = slope + step[0], base + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(slope), 0.0), float(base)


def score(docs: DataFrame, model: Model, passages: bool = False) -> DataFrame:
    """``docs`` with ``score``; with ``passages`` also every toxic segment: byte offsets, score, significance."""
    tune(docs.sparkSession)
    kinds = [(c, t) for c, t in docs.dtypes if c not in ("score", "passages")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = math.log(model.scale)
        for b in steps(batches, "text"):
            scanned = _scan(b.column("text"), model.features, model.scores)
            x = _best(scanned, model.rate)
            there = np.isfinite(x)
            p = model.probability(np.where(there, _significance(np.where(there, x, 0.0) + level), 0.0))
            out = {c: b.column(c) for c, _ in kinds} | {"score": pa.array(p)}
            if passages:
                sig = lambda n, s: float(_significance(np.array(math.log(n) - model.rate * s + level)))
                got = [[{"start": lo, "end": hi, "score": s, "significance": sig(n, s)} for s, _, _, lo, hi in segments] for n, segments in scanned]
                out["passages"] = pa.array(got, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("significance", pa.float64())])))
            yield pa.RecordBatch.from_pydict(out)

    extra = ["score double"] + ["passages array<struct<start:int,end:int,score:double,significance:double>>"] * passages
    return docs.select(*[f"`{c}`" for c, _ in kinds]).mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in kinds] + extra))
