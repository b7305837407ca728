"""Spelling variants, fingerprints and periodic runs against brute force on small tables with the awkward cases."""

import collections
import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scopelens.llm import periodic, registry, spelling, syncmers
from tests.oracle import connect, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_variants(counts: dict) -> list[tuple]:
    near, patterns = collections.defaultdict(set), collections.defaultdict(list)
    for x in counts:
        for k in range(len(x)):
            y = x[:k] + x[k + 1 :]
            if y in counts:
                near[x].add(y), near[y].add(x)
            patterns[k, y].append(x)
    for group in patterns.values():
        for x in group:
            near[x] |= set(group) - {x}
    form = {}
    for x, ys in near.items():
        best = min(ys, key=lambda y: (-counts[y], y), default=None)
        if best is not None and counts[best] >= 5 * counts[x]:
            form[x] = best
    out = []
    for x, n in counts.items():
        root = x
        while root in form:
            root = form[root]
        out.append((x, form.get(x), root, n, len(near[x]), counts[form[x]] if x in form else None))
    return sorted(out)


@pytest.mark.parametrize("alphabet,longest", [("ab", 9), ("abc", 7), ("aé𝒳", 6)])
def test_variants_are_those_of_all_pairs(spark, alphabet, longest):
    rng = np.random.default_rng(len(alphabet) + longest)
    words = {"".join(rng.choice(list(alphabet), int(rng.integers(1, longest)))) for _ in range(150)} | {alphabet[0] * 300, alphabet[0] * 301, alphabet[0] * 299 + alphabet[1]}
    counts = {w: int(rng.choice([5, 6, 25, 26, 125, 130, 700, 4000])) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    assert sorted(map(tuple, spelling.group_variants(table).collect())) == brute_variants(counts)


def test_large_nodes_are_broadcast_and_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LEAST_SIZE", 5)
    monkeypatch.setattr(spelling, "BROADCAST_NODES", 10**9)
    rng = np.random.default_rng(8)
    counts = {w: int(rng.integers(5, 500)) for w in {"".join(rng.choice(list("abcd"), 6)) for _ in range(400)}}
    table = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert sorted(map(tuple, spelling.group_variants(table).collect())) == brute_variants(counts)


def brute_counts(docs) -> dict:
    counts = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % registry.SLIP == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def test_words_are_counted_after_their_slips(spark):
    rng = np.random.default_rng(3)
    vocab = ["Réglage", "réglage", "REGLAGE", "ÀÉÎÕÜ×÷ß", "İstanbul", "straße", "kelvinK", "abcdef", "abcdeg", "ab-cdefgh", "snake_case_words"]
    docs = [(i if i % 9 else None, " ".join(rng.choice(vocab, 40)), "clash") for i in range(300)] + [(1, None, ""), (2, "", ""), (3, "x" * 4000, "")] + [(4, "repeated repeated", "")] * 4
    table = spark.createDataFrame(docs, "doc_id bigint, text string, word string").repartition(4)
    want = brute_counts([d[:2] for d in docs])
    assert {r.word: r.n for r in spelling.word_counts(table, slip=registry.SLIP).collect()} == want
    assert len(want) == 10 and "repeated" in want


def test_no_words_no_rows(spark):
    assert spelling.group_variants(spark.createDataFrame([], "word string, n bigint")).collect() == []


def test_op13_matches_its_sql(spark, sf_dir):
    got = registry.QUERIES["op13_spelling_variants"](spark, sf_dir).toPandas()
    assert rows(got) == rows(connect(sf_dir).sql(registry.ORACLES["op13_spelling_variants"]).df())


def xx(*parts) -> int:
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(struct.pack("<i", p) if isinstance(p, int) else p, seed=h)
    return h


def brute_fingerprint(text: str) -> list[int]:
    k, s = syncmers.K, syncmers.S
    words = [b""] * (k // 2) + [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)] + [b""] * (k // 2)
    n = len(words)
    inner = [np.uint64(xx(*words[i : i + s])).astype(np.int64) for i in range(n - s + 1)]
    anchors = [i for i in range(n - k + 1) if min(inner[i : i + k - s + 1]) == min(inner[i], inner[i + k - s])]
    found = {xx(*words[a : a + k], b - a) & 0xFFFFFFFF for a, b in zip(anchors, anchors[1:], strict=False)}
    return sorted(found or {xx(b"whole", text.encode()) & 0xFFFFFFFF})[: syncmers.SIZE]


def brute_likeness(a: list, b: list) -> float:
    both = sorted({*a, *b})[: syncmers.SIZE]
    return sum(x in a and x in b for x in both) / len(both)


def brute_edited(docs: list[tuple]) -> list[tuple]:
    """Of rows in the order in which they follow each other."""
    out = []
    for k, (i, text) in enumerate(docs):
        own, after = text or "", docs[(k + 1) % len(docs)][1] or ""
        m = len(own) // 3
        edited = own[: len(own) - m] + after[:m]
        a, b, c = brute_fingerprint(own), brute_fingerprint(edited), brute_fingerprint(after)
        digits = ["".join(f"{x:08x}" for x in f) for f in (a, b)]
        out.append((i, edited, *digits, brute_likeness(a, b), brute_likeness(a, c)))
    return out


def texts_of_all_sizes() -> list:
    rng = np.random.default_rng(12)
    vocab = ["word", "é", "𝒳𝒴", "straße", "a", "the", "\0", "\n", "漢字", "longer-words-too"]
    make = lambda n: " ".join(rng.choice(vocab, n))
    return [None, "", "x", "ab", "abcdefgh", "the quick brown", make(3), make(9), "z" * 30, "ab" * 3000, *(make(int(rng.integers(1, 60))) for _ in range(30)), make(3000), make(9000), "\t\n \v\f\r", "漢字\tかな\u2003x " * 40]


def result(df):
    return df.select("doc_id", "edited", syncmers.as_text(F.col("fingerprint")), syncmers.as_text(F.col("edited_fingerprint")), "near_edited", "near_next")


def test_fingerprints_and_their_likeness(spark):
    docs = [(3 * i - 40, t) for i, t in enumerate(texts_of_all_sizes())]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    want = brute_edited(sorted(docs, key=lambda d: -d[0]))
    assert sorted(map(tuple, result(syncmers.compare_edited(table)).collect())) == sorted(want)


def test_an_edit_leaves_distant_anchors_alone(spark):
    rng = np.random.default_rng(2)
    text = " ".join(rng.choice([f"w{i}" for i in range(90)], 500))
    shifted = "inserted in front " + text
    row = spark.createDataFrame([(text, shifted)], "a string, b string").select(syncmers.likeness(syncmers.fingerprint(F.col("a")), syncmers.fingerprint(F.col("b")))).first()[0]
    assert row > 0.9


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    docs = [(7, "one text that is long enough", "f"), (7, "another text that is long enough", "g"), (None, "without an id", "h"), (None, None, "i")] + [(5, "repeated row with its own text", "j")] * 40 + [(1, "last", "k")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string, fingerprint string").repartition(6)
    clash = table.selectExpr("*", "1 AS id", "2 AS key", "true AS none", "4 AS row", "5 AS _part", "'x' AS _next", "7 AS near_next")
    assert syncmers.compare_edited(clash).where("id = 1 AND key = 2 AND none AND row = 4 AND _part = 5 AND _next = 'x' AND near_next <= 1").count() == len(docs)
    got = syncmers.compare_edited(table)
    assert got.columns[:2] == ["doc_id", "text"] and got.schema["fingerprint"].dataType.simpleString() == "array<bigint>"
    rows_ = result(got).collect()
    assert len(rows_) == len(docs)
    repeated = [r for r in rows_ if r.doc_id == 5]
    assert sum(r.near_next == 1.0 for r in repeated) == 39  # each but the last is followed by its equal
    following = {(r.doc_id, r.edited) for r in rows_}
    assert (5, "repeated row with it" + "last") in following  # the next text is shorter than what it replaces
    assert [r.near_next < 1 for r in rows_ if r.doc_id == 1] == [True]


def test_one_row_follows_itself_and_none_gives_none(spark):
    one = spark.createDataFrame([(4, "on its own, this row comes next")], "doc_id bigint, text string")
    r = syncmers.compare_edited(one).first()
    assert r.near_next == 1.0 and r.edited == "on its own, this row " + "on its own"
    assert syncmers.compare_edited(one.where("false")).collect() == []


def test_op12_uses_functions_only(spark, sf_dir):
    plan = registry.QUERIES["op12_document_fingerprints"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def brute_runs(words: list, least: int = 12) -> list[tuple]:
    out, seen, n = [], set(), len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted((s, n, q) for s, n, q in out)


def brute_collapsed(words: list, runs: list) -> str:
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def brute_loops(doc_id, text: str | None) -> list:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


@pytest.mark.parametrize("least", [2, 4, 12])
def test_run_finder_against_all_periods(monkeypatch, least):
    monkeypatch.setattr(periodic, "LEAST", least)
    rng = np.random.default_rng(least)
    for _ in range(1500):
        k, n = int(rng.integers(1, 5)), int(rng.integers(0, 70))
        w = rng.integers(0, k, n).tolist()
        if n and rng.random() < 0.5:
            a, p = int(rng.integers(0, n)), int(rng.integers(1, n // 3 + 2))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert [(s, e - s, q) for s, e, q in periodic.runs(w)] == brute_runs(w, least)
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert [(s, e - s, q) for s, e, q in periodic.runs(b)] == brute_runs(b, least)


def test_runs_and_collapsed_texts(spark):
    rng = np.random.default_rng(6)
    vocab = ["a", "b", "É", "the", " x", "漢字"]
    make = lambda n, k=6: " ".join(rng.choice(vocab[:k], n))
    line = make(9)
    texts = [None, "", " \t\n", "one", "w " * 11, "w " * 12, "w\t" * 5000, f"{line}\n" * 3 + make(40) + f"{line}\n" * 2, "é " * 30 + "b " * 30, make(8) + f" {line}" * 4 + " " + make(6)]
    texts += [make(int(rng.integers(1, 200)), int(rng.integers(1, 5))) for _ in range(60)] + [(make(700) + " ") * 2]
    docs = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(9, texts[9], "x", "y")] * 2 + [(None, texts[8], None, None)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string, runs string, lang string").repartition(3)
    got = periodic.periodic_runs(table)
    assert got.columns == ["doc_id", "text", "lang", "runs", "collapsed"]
    want = []
    for i, t, _, lang in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = brute_runs(words)
        want.append((i, t, lang, found, brute_collapsed(words, found)))
    key = lambda r: repr(r)
    assert sorted(((*r[:3], [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()), key=key) == sorted(want, key=key)
    assert periodic.periodic_runs(table.where("false")).collect() == []


def test_op11_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for r in docs:
        words = brute_loops(r.doc_id, r.text)
        found = brute_runs(words)
        s, n, q = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((r.doc_id, len(found), s, n, q, None if s is None else 1000 * n // q, digest(lines), digest(brute_collapsed(words, found))))
    got = registry.QUERIES["op11_periodic_runs"](spark, sf_dir)
    assert dict(got.dtypes) == {c: "string" if "sha" in c else "bigint" for c in got.columns}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sum(w[1] > 0 for w in want) > 10
