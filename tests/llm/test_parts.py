"""The operators' parts, each against a plain version."""

import random
from collections import Counter

import numpy as np
import pytest
from public_tokenizers import path as tokenizer_file
from pyspark.sql import functions as F

from textloom.llm import decontaminate, graph, line_dedup, packing, secrets, sharding, shingles, substring_dedup, token_counts
from textloom.llm.common import Scratch, least_of_group, normalised_lines, running_sums, salted_slots, words
from textloom.llm.quality_rules import repeated_words


def test_words_split_at_six_characters_only(spark):
    text = " a\tb\nc\x0bd\fe\rf  g h i\x1cj 　 "
    got = spark.range(1).select(words(F.lit(text)).alias("w"), words(F.lit(None).cast("string")).alias("n"), words(F.lit(" \n")).alias("b")).first()
    assert got["w"] == [w.decode() for w in text.encode().split()]
    assert got["n"] == got["b"] == []


def test_slots_are_gapless(spark):
    rows = spark.range(500).select("id", F.expr("case when id < 300 then 'hot' when id < 400 then null else 'x' end").alias("g"))
    with Scratch(spark) as scratch:
        got = salted_slots(scratch, rows, "g", ["id"], F.pmod(F.xxhash64("id"), F.lit(7)), "slot").collect()
    for g, n in (("hot", 300), (None, 100), ("x", 100)):
        assert sorted(r["slot"] for r in got if r["g"] == g) == list(range(n))


def test_components_match_union_find(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    with Scratch(spark) as scratch:
        got = {x["node"]: x["component"] for x in graph.components(scratch, spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in root if x not in alone}


@pytest.mark.parametrize("n,share", [(3, 0.75), (40, 0.8), (400, 0.78)])
def test_signatures_find_alike_sets(n, share):
    hashing, r, found = shingles.OnePermutation(128, 32), np.random.default_rng(n), 0
    for _ in range(200):
        common = max(1, round(n * share))
        a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[:common], r.integers(0, 2**64, 0, dtype=np.uint64)])) if n > 3 else np.unique(np.append(a, r.integers(0, 2**64, 1, dtype=np.uint64)))
        found += bool(set(hashing.keys(hashing.signature(a)).tolist()) & set(hashing.keys(hashing.signature(b)).tolist()))
    assert found >= 199


def test_window_hashes_tell_windows_apart():
    r = np.random.default_rng(1)
    h = r.integers(0, 2**64, 300, dtype=np.uint64)
    h[200:260] = h[20:80]
    got = substring_dedup.window_hashes(h, 50)
    assert len(got) == 251
    assert [(i, j) for i in range(251) for j in range(i + 1, 251) if got[i] == got[j]] == [(20 + k, 200 + k) for k in range(11)]
    v = r.integers(0, 1000, 100)
    assert (substring_dedup.sliding_least(v, 43) == [v[i : i + 43].min() for i in range(58)]).all()


def test_suffix_ranks_sort_by_words():
    r = np.random.default_rng(2)
    ids = r.integers(0, 3, 400)
    ids[300:360] = ids[20:80]
    for depth in (1, 2, 5, 8, 50):
        got = substring_dedup.suffix_ranks(ids, depth)
        windows = [tuple(ids[i : i + depth]) for i in range(len(ids) - depth + 1)]
        order = {w: k for k, w in enumerate(sorted(set(windows)))}
        assert got.tolist() == [order[w] for w in windows]


def test_trees_compare_words_not_hashes():
    """Under one prefix, as if all hashes collided."""
    import pyarrow as pa

    a = [f"a{k}" for k in range(70)]
    b = [*a[:40], "x", *a[41:]]
    rows = [(1, 0, a), (2, 5, a), (3, 0, b), (4, 9, b)]
    table = pa.table({"doc_id": [r[0] for r in rows], "content": [7, 8, 7, 8], "start": [r[1] for r in rows], "n": pa.array([21] * 4, pa.int32()), "words": [" ".join(r[2]).encode() for r in rows]})
    assert sorted(map(tuple, (x.values() for x in substring_dedup.subtree(table).to_pylist()))) == [(2, 8, 5, 75), (4, 8, 9, 79)]


def test_short_inputs_have_no_window():
    h = np.arange(10, dtype=np.uint64)
    for n in range(10):
        assert len(substring_dedup.window_hashes(h[:n], 50)) == 0
    assert len(substring_dedup.window_hashes(h, 10)) == 1


def test_common_subsequence():
    r = random.Random(1)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = 0
            for k, y in enumerate(b):
                old, row[k + 1] = row[k + 1], old + 1 if x == y else max(row[k + 1], row[k])
        return row[-1]

    for _ in range(200):
        a, b = [[r.randrange(6) for _ in range(r.randint(1, 90))] for _ in range(2)]
        assert decontaminate.common_subsequence(np.array(a), np.array(b)) == plain(a, b)


def test_the_latent_basis_is_that_of_an_svd(spark):
    """Against numpy's SVD of the whole matrix, which has a few strong dimensions."""
    r = np.random.default_rng(3)
    topics = [r.permutation(60)[:12] for _ in range(6)]
    rows, dense = [], []
    s = decontaminate.Settings(rank=6, spare=6, window=32)
    weight = 1.0 + r.random(60)
    for k in range(150):
        ids = r.choice(topics[k % 6], 32)
        rows.append((ids.tolist(),))
        dense.append(np.bincount(ids, minlength=60) * weight)
    a = np.array(dense)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    items = [r.choice(topics[k], 20).astype(np.int32) for k in range(6)]
    b = np.array([np.bincount(x, minlength=60) * weight for x in items])
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    whole = np.concatenate([a / np.sqrt(150), b / np.sqrt(6)])
    best = np.linalg.svd(whole)[2][:6]
    got = decontaminate.latent_basis(spark.createDataFrame(rows, "terms array<int>"), lambda: iter([items]), weight, 150, s)
    assert got.shape == (60, 6)
    assert np.abs(got.T @ got - np.eye(6)).max() < 1e-4
    lost = lambda v: np.linalg.norm(whole - whole @ v @ v.T)
    assert lost(got) < 1.02 * lost(best.T)


def test_plans_place_every_piece_once():
    r = np.random.default_rng(5)
    for size, n in ((16, 50), (64, 5000), (2048, 20_000), (2048, 3)):
        counts = np.bincount(np.minimum(size, 1 + r.exponential(size / 4, n).astype(int)), minlength=size + 1)
        made = packing.plan(counts, size)
        slots = {}
        used = {}
        for length, low, high, many, first, offset in made:
            slots.setdefault(length, []).append((low, high))
            for k in range(low, high):
                used.setdefault(first + (k - low) // many, []).append((offset + (k - low) % many * length, length))
        for length in np.flatnonzero(counts):
            spans = sorted(slots[int(length)])
            assert spans[0][0] == 0
            assert spans[-1][1] == counts[length]
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= size
        assert len(used) <= 1.03 * -(-int((np.arange(size + 1) * counts).sum()) // size) + 1


def test_fits_reproduce_a_histogram_of_patterns():
    counts = np.zeros(101, np.int64)
    for lengths, n in (((60, 40), 700), ((50, 30, 20), 300), ((100,), 50)):
        for x in lengths:
            counts[x] += n
    assert sum(1 for _ in packing.plan(counts, 100)) < 20
    assert max(r[4] for r in packing.plan(counts, 100)) < 1050


def test_both_encoders_agree():
    path, ranks = str(tokenizer_file("byte_bpe_50k.json")), str(tokenizer_file("byte_bpe_50k.tiktoken"))
    quick, slow = packing.Encoder(path, ranks), packing.Encoder(path)
    plain = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028)]]
    texts = [a + c + b for c in plain for a, b in (("", ""), ("x", "y"), (" ", " "), ("1", "2"), ("'", "s"), ("\n", "\n "))]
    r = random.Random(2)
    texts += ["".join(r.choice(plain) for _ in range(60)) for _ in range(2000)]
    texts += ["".join(r.choice("ab  \n\t'sé1.") for _ in range(80)) for _ in range(2000)]
    texts += ["a <|endoftext|> b", "日本語 text", "x" * 30_000, " " * 5000, "́e "]
    for t in texts:
        assert quick(t).tolist() == slow(t).tolist(), repr(t)


def test_texts_split_at_white_space_count_the_same():
    r = random.Random(4)
    text = "".join(r.choice("ab'sé1. \n\t ́Σ") for _ in range(20_000)) + "<|endoftext|>"
    counts = token_counts.WordCounts(str(tokenizer_file("word_bpe_49k.json")))
    from tokenizers import Tokenizer

    want = len(Tokenizer.from_file(counts.path).encode(text, add_special_tokens=False).ids)
    assert sum(counts([p for p in token_counts.pieces(text.encode(), 100)])) == want
    assert counts([text.encode()]) == [want]


def test_sharding_follows_weights_and_moves_few(spark):
    keys = spark.range(6000)
    got = keys.select(sharding.rendezvous(F.col("id"), [1.0, 2.0, 0.0, 1.0]).alias("a"), sharding.rendezvous(F.col("id"), [1.0, 2.0, 0.0, 1.0, 1.0]).alias("b")).collect()
    share = [sum(r["a"] == k for r in got) / 6000 for k in range(4)]
    assert share[2] == 0
    assert abs(share[1] - 0.5) < 0.03
    assert all(r["b"] in (r["a"], 4) for r in got)
    assert abs(sum(r["b"] == 4 for r in got) / 6000 - 0.2) < 0.03


def test_blocks_catch_every_near_simhash(spark):
    r = random.Random(6)
    rows = []
    for k in range(300):
        x = r.getrandbits(64)
        y = x
        for bit in r.sample(range(64), r.randint(0, line_dedup.DISTANCE)):
            y ^= 1 << bit
        rows.append((k, x - (1 << 63), y - (1 << 63)))
    df = spark.createDataFrame(rows, "k int, x bigint, y bigint")
    assert df.where(F.arrays_overlap(line_dedup.block_keys(F.col("x")), line_dedup.block_keys(F.col("y")))).count() == 300


@pytest.mark.parametrize("line", ["alpha beta gamma delta epsilon zeta beta beta of a " + " ".join(f"word{k}" for k in range(20_000)) + " omega theta" * 9, "a b c d e f a", "onewordofmanylettersthatgoesonandonandon" * 3])
def test_simhash_is_the_majority_of_bits(spark, line):
    rows = spark.createDataFrame([(1, 1, line), (1, 1, line)], "doc_id bigint, content bigint, _text string")
    got = line_dedup.line_table(rows).collect()
    assert len(got) == 1
    ws = line.split()
    n = line_dedup.GRAM
    parts = [line[k : k + n] for k in range(len(line) - n + 1)] if len(ws) < line_dedup.MIN_WORDS else ws
    voters = list(zip(parts, parts[1:], parts[2:], strict=False))
    counts = Counter(voters)
    hashes = {(r["a"], r["b"], r["c"]): r["h"] for r in spark.createDataFrame(sorted(counts), "a string, b string, c string").select("a", "b", "c", F.xxhash64("a", "b", "c").alias("h")).collect()}
    votes = [sum(c for w, c in counts.items() if hashes[w] >> b & 1) for b in range(64)]
    assert got[0]["sim"] % (1 << 64) == sum(1 << b for b in range(64) if 2 * votes[b] > len(voters))


def test_spans_match_a_left_to_right_search(spark):
    import re

    r = random.Random(8)
    bits = ["token", "=", ":", " ", "\"", "abc", "secret", "AKIA", "0123456789ABCDEF", "deadbeefdeadbeefdeadbeef", "é", "\n", "passwd", "api_key", "x" * 7, "API_KEY", "ſecret"]
    texts = ["".join(r.choice(bits) for _ in range(40)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for rule in secrets.BASE_RULES:
        pattern = re.compile(rule.pattern)
        for made in (rule, secrets._fast(rule)):
            got = {x["k"]: [(s["start"], s["stop"]) for s in x["s"]] for x in df.select("k", secrets.spans(F.col("t"), made).alias("s")).collect()}
            want = {k: [m.span() for m in pattern.finditer(t) if len(m[rule.group]) >= rule.least] for k, t in enumerate(texts)}
            assert got == want


def test_lines_without_their_common_ends_are_as_far_apart(spark):
    r = random.Random(11)
    rows = []
    for k in range(400):
        a = [r.choice(["ab", "abc", "b", "ca", "aa"]) for _ in range(r.randint(1, 12))]
        b = list(a)
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(b))
            b[at : at + r.randint(0, 2)] = [r.choice(["ab", "q", "abc"])] * r.randint(0, 2)
        rows.append((k, " ".join(a), " ".join(b or ["x"])))
    df = spark.createDataFrame(rows, "k int, a string, b string").withColumn("d", line_dedup.differing(F.col("a"), F.col("b")))
    got = df.select(F.levenshtein("a", "b").alias("x"), F.levenshtein("d.a", "d.b").alias("y"), F.length("a").alias("n"), F.length("d.a").alias("m")).collect()
    assert all(x["x"] == x["y"] for x in got)
    assert sum(x["m"] for x in got) < 0.7 * sum(x["n"] for x in got)


def test_most_edits_bounds_the_edit_distance(spark):
    r = random.Random(15)
    rows = []
    for k in range(300):
        a = [r.choice(["a", "bc", "def", "ünï", ""]) for _ in range(r.randint(1, 12))]
        b = [r.choice(["a", "bcd", "", "é"]) if r.random() < 0.3 else w for w in a] + ["x"] * (k % 5 == 0)
        rows.append((" ".join(a), " ".join(b), len(a) == len(b)))
    df = spark.createDataFrame(rows, "a string, b string, same boolean")
    got = df.select("a", "b", "same", F.levenshtein("a", "b").alias("d"), line_dedup.most_edits(F.col("a"), F.col("b")).alias("most")).collect()
    assert all((x.most is not None) == x.same for x in got)
    assert all(x.most >= x.d for x in got if x.same)
    assert sum(x.most == x.d for x in got if x.same) > 100


def test_one_sign_a_word(spark):
    got = spark.createDataFrame([("the cat the dog é",)], "t string").select(line_dedup.one_sign_a_word(F.col("t")).alias("s")).first()["s"]
    assert len(got) == 5
    assert got[0] == got[2]
    assert len(set(got)) == 4


def test_running_sums(spark):
    r = random.Random(12)
    rows = [(k, [r.randrange(100) for _ in range(n)]) for k, n in enumerate([0, 1, 2, 63, 64, 65, 4095, 4096, 4097, 20_000])]
    got = {x.k: x.s for x in spark.createDataFrame(rows, "k int, v array<int>").select("k", running_sums(F.col("v")).alias("s")).collect()}
    for k, v in rows:
        want, at = [], 0
        for x in v:
            want.append(at)
            at += x
        assert got[k] == want


def test_least_of_group(spark):
    rows = [(k % 3 if k % 5 else None, "a" if k % 2 else None, k) for k in range(600)]
    got = least_of_group(spark.createDataFrame(rows, "g int, h string, v int"), ["g", "h"], F.col("v"), F.col("v"), "least").collect()
    assert sorted(map(tuple, got), key=lambda x: x[2]) == [(g, h, v, min(w for a, b, w in rows if (a, b) == (g, h))) for g, h, v in rows]


@pytest.mark.parametrize("bits", [1, 60, 62])
def test_repeated_words_whatever_the_hash_keeps(spark, bits):
    """With few bits left to the hash, windows of different words collide."""
    r = random.Random(bits)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(n)) for n in (0, 1, 3, 4, 9, 30, 200, 700)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {x.k: x.n for x in df.select("k", repeated_words(words(F.col("t")), 3, bits).alias("n")).collect()}
    for k, t in enumerate(texts):
        ws = t.split()
        seen = {}
        for i in range(len(ws) - 2):
            seen.setdefault(tuple(ws[i : i + 3]), []).append(i)
        assert got[k] == len({i + j for at in seen.values() if len(at) > 1 for i in at for j in range(3)})


def test_runs_of_any_blanks_are_one_space(spark):
    texts = ["a" + "\t" * 100_000 + "b", ("\t \r" * 30_000) + "x\n" + " " * 100_000 + "y", "a \t b\x0b\x0cc  d e", "\t\n\t"]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", normalised_lines(F.col("t")).alias("x")).orderBy("k").collect()
    assert [x.x for x in got] == [[" ".join(line.split()) for line in t.split("\n")] for t in texts]
