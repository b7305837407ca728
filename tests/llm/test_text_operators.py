"""Text operators against brute force on small tables with the awkward cases: nulls, empties, long texts, repeats."""

import base64
import collections
import hashlib
import re
import struct
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as s
from pyspark.sql import functions as F

from scopelens.llm import bpe, chat, common, jaccard, licenses, mixing, registry, sharding, substrings, toxicity
from tests.oracle import connect, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def awkward() -> list[tuple]:
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(60)] + ["É", "the", "of", "don't"]
    make = lambda n: " ".join(rng.choice(vocab, n))
    passage, base = make(60), make(300)
    texts = [None, "", " \t\n", "one", "a b c d", make(34), make(35), passage, passage, base, base]
    texts += [make(int(rng.integers(5, 120))) for _ in range(40)]
    texts += [make(30) + "\n" + passage + "\t" + make(20) for _ in range(25)]
    for i in range(30):  # near copies of various degrees
        w = base.split(" ")
        for k in rng.integers(0, len(w), i):
            w[k] = "edit" + str(int(rng.integers(0, 999)))
        texts.append(" ".join(w))
    texts += [make(6000), "again and " * 400, "x" * 5000, "same words here today now " * 30]
    out = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[9], out[9]]  # a row three times


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_repeats(texts: list) -> list[tuple]:
    words = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        keep = [True] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                keep[i : i + 35] = [False] * 35
        out.append((len(w), keep.count(False), " ".join(x for x, k in zip(w, keep, strict=True) if k)))
    return out


def test_substrings(docs, empty):
    want = sorted((r[0], *b) for r, b in zip(awkward(), brute_repeats([r[1] for r in awkward()]), strict=True))
    got = sorted((r.doc_id, r._words, r._removed, r.text) for r in substrings.remove_repeated(docs).collect())
    assert got == want
    assert substrings.remove_repeated(empty).count() == 0
    clash = docs.withColumnsRenamed({"lang": "_ranges2", "source": "at"})
    assert substrings.remove_repeated(clash).count() == len(want)


def test_substrings_with_one_heavy_minimiser(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    texts = [f"a{i} b{i} c{i} {passage} d{i} e{i}" for i in range(400)] + [" ".join(f"u{i}x{j}" for j in range(60)) for i in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(6)
    got = {r.doc_id: r.text for r in substrings.remove_repeated(df).collect()}
    assert got == {i: x[2] for i, x in enumerate(brute_repeats(texts))}


def test_substrings_with_clashing_names(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    t = [(1, passage, "a", 1, [1], "k", 5), (2, "before " + passage + " after", "b", 2, [2], "l", 6), (3, None, None, None, None, None, None)]
    df = spark.createDataFrame(t, "doc_id int, text string, _key string, _words int, _ranges array<int>, _doc string, _removed int")
    got = sorted(substrings.remove_repeated(df).collect())
    assert [(r.doc_id, r.text, r._key, r._ranges, r._doc, r._words, r._removed) for r in got] == [(1, "", "a", [1], "k", 40, 40), (2, "before after", "b", [2], "l", 42, 40), (3, "", None, None, None, 0, 0)]


def test_query_one_equals_brute_force(spark, sf_dir):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in registry.op1_substring_dedup(spark, sf_dir).collect()}
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = {r.doc_id: (b[0], b[1], hashlib.sha256(b[2].encode()).hexdigest()) for r, b in zip(d, brute_repeats([r.text for r in d]), strict=True)}
    assert got == want


def brute_groups(table: list[tuple]) -> dict:
    sets = {}
    for i, t in table:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                c = len(sets[a] & sets[b])
                if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_groups(docs, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(docs).collect()}
    assert got == brute_groups([(r[0], r[1]) for r in awkward()])
    assert jaccard.jaccard_groups(empty).count() == 0
    kept = sorted(r.doc_id for r in jaccard.keep_one(docs).collect())
    assert kept == sorted({c for _, c in brute_groups([(r[0], r[1]) for r in awkward()]).values()})


def test_jaccard_without_ids(spark):
    t = "one two three four five six seven eight"
    df = spark.createDataFrame([(None, t), (None, t), (7, t + " nine"), (8, "other words that are quite different from it"), (None, "only here a text of its own is found")], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in jaccard.jaccard_groups(df).collect())
    assert got == [("7", "7"), ("8", "8"), ("None", "7"), ("None", "7"), ("None", "None")]


def test_keep_one_decides_by_row(spark):
    t, alone = "one two three four five six seven eight", "only here a text of its own is found"
    other, third = "other words that are quite different from it", "nobody else has any sentence like this last one"
    table = [(None, t), (None, t), (7, t + " nine"), (None, alone), (None, other), (9, third), (9, "and under nine stands quite another text too"), (9, third), (None, ""), (None, None), (3, ""), (3, None)]
    got = [(r.doc_id, r.text) for r in jaccard.keep_one(spark.createDataFrame(table, "doc_id bigint, text string")).collect()]
    assert sorted(got, key=str) == sorted([*table[2:7], *table[8:]], key=str)


def test_query_nine_equals_brute_force(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in registry.op9_jaccard_join(spark, sf_dir).collect()}
    assert got == brute_groups([(r.doc_id, r.text) for r in d])


def test_large_group_in_blocks(spark, monkeypatch):
    """Groups of near copies larger than a block, with stragglers that only some members link."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "NEIGHBOURS", 1)
    monkeypatch.setattr(jaccard, "LISTS", 1)
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    table = []
    for i in range(70):
        w = list(base)
        for k in rng.integers(0, 120, 3):
            w[k] = f"e{rng.integers(0, 40)}"
        table.append((i, " ".join(w)))
    df = spark.createDataFrame(table, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(df).collect()}
    assert got == brute_groups(table)


def test_jaccard_with_hot_shingles(docs, monkeypatch):
    """Shingles that travel with their nodes instead of to their hash's partition give the same groups."""
    found = []

    def heavy_of(told, parts, least):
        keys = sorted(r.key for r in told.where("key IS NOT NULL").groupBy("key").agg(F.sum("weight").alias("w")).where("w > 2").collect())
        found.extend(keys)
        return np.array(keys, np.int64), 1000

    monkeypatch.setattr(jaccard, "heavy_keys", heavy_of)
    monkeypatch.setattr(jaccard, "shuffle_partitions", lambda _: 50)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(docs).collect()}
    assert found and got == brute_groups([(r[0], r[1]) for r in awkward()])


def test_keep_one_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 5, "x", True), (1, "a b c d e f", 5, "x", True), (2, "a b c d e f", 6, "y", False)], "doc_id bigint, text string, _id int, _key string, _repeats boolean")
    assert [tuple(r) for r in jaccard.keep_one(df).collect()] == [(1, "a b c d e f", 5, "x", True)]


@given(s.lists(s.tuples(s.integers(0, 400), s.integers(1, 5)), min_size=1, max_size=400), s.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_heavy_keys_are_never_missed(pairs, hot):
    """However thin a key is spread over steps, one with 1 / (8 * parts) of all weight is told."""
    parts = 2
    heavy, true = common.Heavy(parts), collections.Counter()
    for i in range(0, len(pairs), 7):
        step = [*pairs[i : i + 7], *[(9000 + h, 3) for h in range(hot)]]
        heavy.add(np.array([k for k, _ in step], np.int64), np.array([w for _, w in step], np.int64))
        for k, w in step:
            true[k] += w
    keys, weights = heavy.rows()
    total = sum(true.values())
    assert weights[-1] == total and len(keys) <= 32 * parts
    assert {k for k, w in true.items() if w * 8 * parts >= total} <= set(keys.tolist())
    assert all(true[k] - total / (32 * parts) <= w <= true[k] for k, w in zip(keys.tolist(), weights.tolist(), strict=False))


@pytest.fixture(scope="module")
def reference_tokenizer():
    import public_tokenizers
    import tiktoken

    with open(registry.ranks_path(), "rb") as f:
        data = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Vocabulary(data)


@given(s.lists(s.text(alphabet=s.sampled_from(list("aZ'stmdrevl l  \n\t1²é-!🙂　\x85\x1c")) | s.characters(blacklist_categories=("Cs",)), max_size=60), min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_bpe_equals_the_library(reference_tokenizer, texts):
    enc, v = reference_tokenizer
    ids, at = v.encode(pa.array(texts))
    for i, t in enumerate(texts):
        own = ids[at[i] : at[i + 1]]
        assert own.tolist() == enc.encode_ordinary(t)
        assert v.decode(own).tobytes() == t.encode()


@pytest.mark.parametrize("text", ["x" * 3000 + "y" * 500, "'re're 're", "a  b\t\tc \n d   ", "don't 'tis ''s 'll"])
def test_bpe_on_hard_texts(reference_tokenizer, text):
    enc, v = reference_tokenizer
    assert v.encode(pa.array([text, None, ""]))[0].tolist() == enc.encode_ordinary(text)


def test_bpe_forgets_by_bytes(reference_tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 100)
    with open(registry.ranks_path(), "rb") as f:
        v = bpe.Vocabulary(f.read())
    for k in range(5):
        text = " ".join(f"word{k}{j}" * 9 for j in range(20))
        ids, _ = v.encode(pa.array([text]))
        assert bytes(v.decode(ids)).decode() == text and v.held < 10_000


def test_bpe_operator(docs, empty, reference_tokenizer):
    enc, _ = reference_tokenizer
    coded = bpe.encode(docs.withColumnRenamed("lang", "ids"), registry.ranks_path(), offsets=True)
    out = bpe.decode(coded, registry.ranks_path()).collect()
    assert len(out) == len(awkward())
    texts = {r[0]: r[1] or "" for r in awkward()}
    for r in out:
        want = enc.encode_ordinary(texts[r.doc_id])
        assert list(struct.unpack(f"<{r.n_tokens}I", r.ids)) == want
        assert bytes(r.decoded) == texts[r.doc_id].encode()
        starts = struct.unpack(f"<{r.n_tokens}I", r.starts)
        assert list(starts) == [sum(len(enc.decode_single_token_bytes(x)) for x in want[:k]) for k in range(len(want))] if len(want) < 500 else True
    assert bpe.encode(empty, registry.ranks_path()).count() == 0


def test_shards(docs, empty):
    got = sharding.assign_shards(docs, 8).collect()
    assert sharding.assign_shards(empty, 8).count() == 0
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in awkward())
    size = collections.Counter()
    slots = collections.defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    largest, total = max(r.size for r in got), sum(size.values())
    assert max(size.values()) <= total / 8 * 1.125 + 2 * largest


def test_shards_are_equal_on_even_texts(spark):
    df = spark.createDataFrame([(i, f"text {i:05d}") for i in range(4000)] + [(i, "copy copy!") for i in range(4000, 6000)], "doc_id bigint, text string")
    size = collections.Counter()
    for r in sharding.assign_shards(df, 8).collect():
        size[r.shard] += r.size
    assert max(size.values()) - min(size.values()) <= 40


def test_write_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "doc_id bigint, text string")
    sharding.write_shards(df, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100
    assert back.select("shard").distinct().count() == 4


def test_shards_of_repeated_rows(spark, tmp_path, monkeypatch):
    """A third of the rows are one text without an id; runs are cut, slots stay gapless, rows come back whole."""
    monkeypatch.setattr(sharding, "RUN", 7)
    t = [(None, "the same", 1, "a")] * 300 + [(i, f"text number {i}", i, "b") for i in range(600)] + [(5, "twice", 1, "c"), (5, "twice", 2, "d"), (5, None, 3, None)]
    df = spark.createDataFrame(t, "doc_id bigint, text string, shard int, _id string").repartition(5)
    got = sharding.assign_shards(df, shards=8).collect()
    assert len(got) == len(t)
    per = collections.defaultdict(list)
    for r in got:
        per[r.shard].append(r)
    total = sum(r.size for r in got)
    assert sorted(per) == list(range(8))
    assert all(sorted(r.slot for r in x) == list(range(len(x))) and abs(sum(r.size for r in x) - total / 8) <= 20 for x in per.values())
    sharding.write_shards(df, str(tmp_path / "out"), shards=8)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((str(r.doc_id), str(r.text), str(r._id)) for r in back.collect()) == sorted((str(a), str(b), str(d)) for a, b, _, d in t)


def brute_targets(size: dict) -> dict:
    names = sorted((k for k in size if k is not None)) + [None] * (None in size)
    weight = {k: i % 3 + 1 for i, k in enumerate(names)}
    target, capped = {}, set()
    while True:
        rest = sum(size.values()) - sum(3 * size[k] for k in capped)
        free = [k for k in names if k not in capped]
        total = sum(weight[k] for k in free)
        target = {k: 3.0 * size[k] if k in capped else rest * weight[k] / total for k in names}
        over = {k for k in free if target[k] > 3 * size[k] + 1e-9}
        if not over:
            return target
        capped |= over


def test_mixing(docs, empty):
    table = awkward()
    size = collections.Counter()
    for r in table:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    want = brute_targets(size)
    source = {r[0]: r[3] for r in table}
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(table)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == size[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size
        assert r.size == 0 or r.taken % r.size == 0
        taken[source[r.doc_id]] += r.taken
    for k in size:
        assert abs(taken[k] - want[k]) <= max(1, 0.02 * want[k])
    again = mixing.mix_report(docs.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    assert mixing.mix_report(empty).count() == 0
    rows_ = mixing.mix(docs)
    assert rows_.columns == docs.columns
    assert rows_.count() == sum(r.copies for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_mixing_places_the_words_of_a_long_text(spark, seed):
    rng = np.random.default_rng(seed)
    n = [*rng.integers(20, 700, 500).tolist(), 20_000]
    t = [(1000 * seed + i, "w " * k, "en", "a", 1) for i, k in enumerate(n)] + [(10**6 + i, "w " * 400, "en", "b", 1) for i in range(100)]
    got = [r for r in mixing.mix_report(spark.createDataFrame(t, DOCS).repartition(4)).collect() if r.source_size == sum(n)]
    assert len(got) == len(n)
    assert abs(sum(r.taken for r in got) - got[0].target) <= 60


def test_pivotal_steps_keep_expectations_and_words(spark):
    """Many seeds at once, each a source of its own: mean copies, floor or ceiling, words kept."""
    n, seeds, size = 60, 400, lambda i: 1000 // (i + 1) + 5
    item = "array(" + ",".join(f"struct(-{size(i)} as order, rand({i}) as u, cast({i} as bigint) as doc_id, cast({size(i)} as bigint) as size, 0 as key, 0 as no, 0 as source_size, 0d as target, 0 as low, 0.3d as f)" for i in range(n)) + ")"
    rows_ = spark.range(seeds).selectExpr(f"{item} as items").withColumn("x", mixing._in_pairs(F.col("items"))).collect()
    up = np.zeros((seeds, n))
    for k, r in enumerate(rows_):
        assert len(r.x.done) == n - 1
        for d in r.x.done:
            up[k, d.i] = d.copies
        up[k, r.x.i] = r.x.f
    words = np.array([size(i) for i in range(n)])
    assert np.allclose(up @ words, 0.3 * words.sum())
    assert np.abs(up.mean(0) - 0.3).max() < 4.5 * (0.21 / seeds) ** 0.5
    assert ((up == 0) | (up == 1)).sum() >= seeds * (n - 1)


def test_mixing_keeps_expected_copies(spark):
    """Sources of equal make-up, some larger than LONG: each kind of document has its expected copies on average."""
    kinds = [1000, 23, 50, 50, 50, 50, 400, 80]
    t = [(s * 10_000 + i, "w " * kinds[i % 8], "en", f"s{s % 3}{s:02d}", 1) for s in range(24) for i in range(1600 if s % 8 == 0 else 160)]
    got = mixing.mix_report(spark.createDataFrame(t, DOCS).repartition(8)).collect()
    assert len(got) == len(t)
    by = collections.defaultdict(list)
    for r in got:
        want = r.target / r.source_size
        by[r.size].append(r.copies - want)
        assert np.floor(want + 1e-9) <= r.copies <= np.ceil(want - 1e-9)
    assert all(abs(np.mean(x)) < 4.5 * 0.5 / len(x) ** 0.5 for x in by.values())
    taken = collections.Counter()
    for r in got:
        taken[r.doc_id // 10_000] += r.taken
    goal = {r.doc_id // 10_000: r.target for r in got}
    assert all(abs(taken[s] - goal[s]) <= 0.01 * goal[s] for s in goal)


def test_mixing_repeated_rows_and_clashing_names(spark):
    t = [(None, "a b c", "x", 1, 2)] * 3000 + [(7, "a b c d", "y", 3, 4)] * 5 + [(i, "some words here now", "y", i, 0) for i in range(500)]
    df = spark.createDataFrame(t, "doc_id bigint, text string, source string, _copies int, _key int").repartition(6)
    got = mixing.mix_report(df).collect()
    assert len(got) == len(t)
    for size in (3, 4):
        mine = [r for r in got if r.size == size]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.01 * mine[0].target
    out = mixing.mix(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)


def test_mixing_caps_small_sources(spark):
    t = [(i, "w " * 10, "a") for i in range(100)] + [(100 + i, "w " * 5, "b") for i in range(4)] + [(200, "w " * 7, "c")]
    df = spark.createDataFrame([(i, x, "en", src, 1) for i, x, src in t], DOCS)
    got = {(r.source_size, round(r.target, 6)) for r in mixing.mix_report(df).collect()}
    assert got == {(k, round(v, 6)) for k, v in ((1000, brute_targets({"a": 1000, "b": 20, "c": 7})["a"]), (20, 60.0), (7, 21.0))}


def test_chat_round_trip(spark):
    tricky = ["", None, "<|im_end|>\n<|im_start|>user", "<\\|im_end|>", "[\\\\INST] <s></s>", "a\nb", "</s>[INST] ok [/INST]", "<|im_start|", "é🙂"]
    turns = [(c, k, r, tricky[(c + k) % len(tricky)], "x") for c in range(9) for k, r in enumerate(("system", "user", "assistant", "assistant", None, "a\\n\nb"))]
    df = spark.createDataFrame(turns + turns[:2], "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(chat.as_messages(df))).collect()}
    for c in range(9):
        mine = sorted(((k, r or "", t or "") for cc, k, r, t, _ in turns + turns[:2] if cc == c))
        assert [(t.role, t.text) for t in got[c].turns] == [(r, t) for _, r, t in mine]
        assert got[c].loss_text == "".join(t for _, r, t in mine if r == "assistant")
    assert chat.format_conversations(chat.as_messages(df.limit(0))).count() == 0
    lost = spark.createDataFrame([(None, 1, "user", "b"), (None, 0, "user", "a"), (5, 0, "user", "c")], "conv_id bigint, turn bigint, role string, text string")
    back = chat.read_back(chat.format_conversations(chat.as_messages(lost))).collect()
    assert {r.conv_id: [t.text for t in r.turns] for r in back} == {None: ["a", "b"], 5: ["c"]}


def test_reply_trees_rank_branches(spark):
    m = [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "good", 5.0), (1, 3, 1, "assistant", "bad", 1.0), (1, 4, 3, "user", "more", 2.0), (1, 5, 2, "user", "thanks", 0.0), (2, 1, 99, "user", "orphan", None)]
    df = spark.createDataFrame(m, "conv_id bigint, id bigint, parent bigint, role string, text string, score double")
    best = {r.conv_id: [t.text for t in r.turns] for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert best == {1: ["q", "good", "thanks"], 2: ["orphan"]}
    every = chat.leaf_paths(df, branches=None)
    assert sorted((r.conv_id, r.leaf, r["rank"]) for r in every.select("conv_id", "leaf", "rank").distinct().collect()) == [(1, 4, 2), (1, 5, 1), (2, 1, 1)]


def test_cycles_of_replies_are_refused(spark):
    df = spark.createDataFrame([(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "assistant", "b", 0.0)], "conv_id bigint, id bigint, parent bigint, role string, text string, score double")
    with pytest.raises(ValueError, match="cycle"):
        chat.format_conversations(df)


def test_long_chain_of_replies(spark):
    df = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(150)], "conv_id bigint, turn bigint, role string, text string")
    r = chat.read_back(chat.format_conversations(chat.as_messages(df))).first()
    assert [t.text for t in r.turns] == [f"t{i}" for i in range(150)]


def test_licenses(spark):
    texts = [
        None, "", "Under the MIT License. under the mit license under THE mit-license!", "apache license, version 2.0", "CC BY-NC 4.0", "undér the mit license",
        "x " * 100 + licenses.TEMPLATES["bsd"] + " y" * 100, " ".join(licenses.TEMPLATES["bsd"].split()[:9]), licenses.TEMPLATES["gpl-3"] + " " + licenses.TEMPLATES["mit"],
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].last_word, got[2].labels) == (12, 3, 0, 8, "mit")
    assert [got[i].labels for i in (3, 4, 5, 6, 7, 8)] == ["apache-2", "cc-by-nc", "", "bsd", "", "gpl-3,mit"]
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].score) == (0, 0, None, 0.0)
    assert got[6].score == 1.0
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_license_join_equals_every_block_against_every_template(spark, monkeypatch):
    rng = np.random.default_rng(8)
    stock = [f"t{i}" for i in range(150)]
    templates = {f"lic{k}": " ".join(rng.choice(stock, int(rng.integers(1, 90)))) for k in range(25)}
    templates |= {"none": "", "twin": templates["lic3"]}
    norm = lambda x: re.sub(licenses.NOT_WORD, " ", (x or "").translate(LOWER)).strip(" ").split(" ")
    texts = [None, "", "t1", "no words known here"] + [" ".join(rng.choice(stock + ["the", "of"] * 20, int(rng.integers(1, 400)))) for _ in range(60)]
    for k in range(60):  # templates with some words exchanged, in the midst of others
        w = templates[f"lic{k % 25}"].split(" ")
        for i in rng.integers(0, len(w), int(rng.integers(0, 4))):
            w[i] = "other"
        texts.append(" ".join([*rng.choice(stock, int(rng.integers(0, 70))), *w, *rng.choice(stock, int(rng.integers(0, 70)))]))
    texts.append("filler " * 20_000 + templates["lic7"])
    docs = [(i if i % 9 else None, x, i) for i, x in enumerate(texts)] + [(70, texts[70], 70)] * 3
    df = spark.createDataFrame(docs, "doc_id bigint, text string, label int").withColumn("held", F.lit(1)).withColumn("ha", F.lit("x"))

    def brute(x):
        w, out = norm(x), {}
        for s in range(0, max(len(w) - 33, 0) + 1, 32):
            own = set(w[s : s + 64])
            for name, t in licenses.pieces(templates, 64):
                if len(own & t) >= -(-9 * len(t) // 10):
                    out[name] = max(out.get(name, 0), len(own & t) / len(t))
        return sorted(out.items())

    want = sorted([(i if i is not None else -1, brute(x)) for i, x, _ in docs], key=repr)
    assert sum(bool(m) for _, m in want) > 30
    for bound in (licenses.BROADCAST_NAMES, 0):
        monkeypatch.setattr(licenses, "BROADCAST_NAMES", bound)
        rows_ = licenses.scan_licenses(df, templates=templates).collect()
        got = sorted([(r.doc_id if r.doc_id is not None else -1, [(m.label, m.containment) for m in r.matches]) for r in rows_], key=repr)
        assert got == want
    assert not any(r.matches for r in licenses.scan_licenses(df, templates={}).collect())


def test_toxicity_scores_rare_and_moderate_words(spark):
    """Words in 1 % of the toxic texts count, and so do words ten times as common in toxic texts."""
    rng = np.random.default_rng(1)
    vocab, tail, mild = [f"w{i}" for i in range(300)], [f"{chr(97 + i // 26)}{chr(97 + i % 26)}zq" for i in range(200)], ["grim", "foul", "vile", "mean"]
    docs, labels = [], []
    for i in range(7500):
        w, y = list(rng.choice(vocab, 40)), int(i % 5 == 0)
        if y:
            w[20:22] = rng.choice(tail, 2)
        if rng.random() < (0.4 if y else 0.04):
            w[24:28] = mild
        docs.append((i, " ".join(map(str, w))))
        labels.append((i, y))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    held = {r.doc_id for r in df.select("doc_id", toxicity.held_out(df["doc_id"]).alias("h")).where("h").collect()}
    assert np.mean([(got[i] >= 0.7) == bool(y) for i, y in labels if i in held]) > 0.9
    odds = dict(zip(model.features.tolist(), model.scores.tolist(), strict=True))
    known = lambda x: int(toxicity._features(toxicity.Words(pa.array([x]), lower=True, breaks=toxicity._BREAKS))[0].view(np.int64)[0])
    assert all(0 < odds[known(x)] < 3 for x in mild)


def test_toxicity_finds_a_second_passage_and_repeats():
    f = np.sort(toxicity.Words(pa.array(["awful nasty vileness"]), lower=True, breaks=toxicity._BREAKS).hashes().view(np.int64))
    fill = "w " * 300
    texts = [fill + "awful nasty vileness " + fill + "vileness awful nasty " + fill, fill + "awful " * 8 + fill, fill + "awful " + fill]
    scanned = toxicity._scan(pa.array(texts), f, np.full(3, 3.0))
    got = [segments for _, segments in scanned]
    assert [len(g) for g in got] == [2, 1, 1]
    assert got[0][0][0] == pytest.approx(9) and got[0][1][0] == pytest.approx(9)
    best = toxicity._best(scanned, 1.5)
    assert best[1] < best[2] - 3
    assert [g for _, g in toxicity._scan(pa.array(["", None]), f, np.full(3, 3.0))] == [[], []]


def test_segments_take_linear_time():
    """Hits that fall one below the other keep every segment open."""
    began = time.perf_counter()
    got = toxicity._segments(np.arange(20_000) * 50, np.linspace(9.0, 1.0, 20_000))
    assert len(got) == 20_000 and time.perf_counter() - began < 1.0


def test_toxicity_settles_conflicting_labels_and_replaces_score(spark):
    docs = [(i, f"plain words number {i % 7} here", 9.0) for i in range(60)] + [(100 + i, f"awful vileness number {i} here", 9.0) for i in range(40)]
    docs += [(200, "awful vileness number 1 here", 9.0), (201, "awful vileness number 1 here", 9.0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(d[0], int("awful" in d[1])) for d in docs] + [(200, 0), (201, 0)], "doc_id bigint, toxic int")
    one, two = (toxicity.fit(df.repartition(n), labels.repartition(n)) for n in (1, 3))
    assert one.scores.tolist() == two.scores.tolist() and (one.slope, one.base) == (two.slope, two.base)
    out = toxicity.score(df, one)
    assert out.columns == ["doc_id", "text", "score"] and out.where("score > 1").isEmpty()


def test_toxicity_learns_planted_words(spark):
    rng = np.random.default_rng(0)
    vocab = [f"w{i}" for i in range(200)]
    bad = ["awful", "nasty", "vileness"]
    docs, labels = [], []
    for i in range(900):
        w = list(rng.choice(vocab, 60))
        y = int(i % 4 == 0)
        if y:
            for b in rng.choice(bad, 2):
                w[int(rng.integers(0, 60))] = str(b)
        docs.append((i, " ".join(w)))
        labels.append((i, y))
    df = spark.createDataFrame([*docs, (None, None), (901, ""), (902, "junk " * 3000)], "doc_id bigint, text string")
    lab = spark.createDataFrame([*labels, (3, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(df, lab)
    got = {r.doc_id: r for r in toxicity.score(df.withColumnRenamed("doc_id", "id").withColumnRenamed("id", "doc_id"), model, passages=True).collect()}
    held = {r.doc_id for r in df.where("doc_id IS NOT NULL").select("doc_id", toxicity.held_out(df["doc_id"]).alias("h")).where("h").collect()}
    right = [(got[i].score >= 0.7) == bool(y) for i, y in labels if i in held]
    assert np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[902].score < 0.7 and got[None].passages == []
    p = next(r for r in got.values() if r.passages)
    assert any(b in p.text.encode()[p.passages[0].start : p.passages[0].end].decode() for b in bad)
    none = toxicity.fit(df, lab.where("toxic = 0"))
    assert toxicity.score(df, none).selectExpr("max(score)").first()[0] < 0.01
    assert toxicity.score(df.limit(0), model).count() == 0


@given(s.lists(s.tuples(s.integers(0, 60), s.floats(0.5, 8)), max_size=25, unique_by=lambda x: x[0]))
@settings(max_examples=80, deadline=None)
def test_segments_hold_the_best_one(pairs):
    """The best of all segments, found by trying every one."""
    pairs = sorted(pairs)
    at, score = np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs])
    got = toxicity._segments(at, score)
    dense = np.full(61, -toxicity.DRIFT)
    dense[at] = score
    best = max((dense[i : j + 1].sum() for i in range(61) for j in range(i, 61)), default=0.0)
    assert (max((x[0] for x in got), default=0.0) == pytest.approx(best)) if len(pairs) else got == []


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    want = connect(sf_dir).sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_rows_that_differ_only_in_a_map_are_mixed_as_they_are(spark):
    df = spark.sql("""SELECT 1L AS doc_id, 'a b c' AS text, 's' AS source, map('k', i) AS m, array(map('x', i)) AS deep,
                      CASE WHEN i = 2 THEN NULL ELSE named_struct('v', parse_json(concat('{"z": ', i, '}'))) END AS v FROM range(3) AS t(i)""")
    got = mixing.mix(df)
    assert got.columns == df.columns
    assert sorted((r.m["k"], r.deep[0]["x"], r.v is None) for r in got.collect()) == [(0, 0, False), (1, 1, False), (2, 2, True)]


def test_substring_dedup_of_very_many_equal_rows(spark):
    """Their ranges are named once for each text, so the cost of a row doesn't rise with their number."""
    text = " ".join(f"w{i % 61}x{i}" for i in range(90))
    took = {}
    for n in (5_000, 50_000):
        df = spark.range(n).select(F.lit(3).cast("bigint").alias("doc_id"), F.lit(text).alias("text")).union(spark.createDataFrame([(4, "short one")], "doc_id bigint, text string"))
        began = time.time()
        got = substrings.remove_repeated(df).groupBy("doc_id", "_removed", "text").count().collect()
        took[n] = time.time() - began
        assert sorted(map(tuple, got)) == [(3, 90, "", n), (4, 0, "short one", 1)]
    assert took[50_000] < 20 * took[5_000]


@pytest.mark.parametrize("range_rows", [10**6, 17])
def test_cuts_are_those_of_one_long_row_of_texts(spark, monkeypatch, range_rows):
    """Brute force over all rows in the order of their texts' fingerprints, whatever ranges they are dealt to."""
    monkeypatch.setattr(sharding, "RANGE_ROWS", range_rows)
    rng = np.random.default_rng(21)
    texts = ["w" * int(n) for n in rng.integers(0, 400, 150)] + ["same text " * 30] * 40 + ["twice over"] * 2 + [None, "", "ü" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = sharding.assign_shards(df, shards=8).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    rows_ = sorted(got, key=lambda r: (r.ha, r.hb, r.doc_id))
    total = sum(r.size for r in rows_)
    assert total == sum(len((t or "").encode()) + 1 for t in texts)
    at, want, begin = 0, {}, {}
    for r in rows_:
        begin.setdefault((r.ha, r.hb), [at, 0])[1] += r.size
        want[r.doc_id] = at
        at += r.size
    slots = collections.Counter()
    for r in rows_:
        start, size = begin[r.ha, r.hb]
        middle = start + size / 2 if size <= 0.125 * total / 8 else want[r.doc_id] + r.size / 2
        assert r.shard == min(int(middle // (total / 8)), 7)
        assert r.slot == slots[r.shard]
        slots[r.shard] += 1
