"""The registered queries on the smallest tables, against SQL or plain Python."""

import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from public_tokenizers import path as tokenizer_file
from tokenizers import Tokenizer

from tests.llm import brute
from tests.oracle import compare
from textloom.llm import decontaminate
from textloom.llm.common import Scratch
from textloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    compare(QUERIES[name](spark, SF), ORACLES[name], SF)


def test_token_counts_are_the_librarys(spark, documents):
    t = Tokenizer.from_file(str(tokenizer_file("word_bpe_49k.json")))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op4_token_counts"](spark, SF).collect()}
    want = {d: (len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 2048) for d, x in documents}
    assert got == want


def test_shards(spark, documents):
    rows = QUERIES["op5_sharding"](spark, SF).collect()
    texts = dict(documents)
    assert len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 16)
        assert 0 <= r.shard < 16
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(r.grown_shard == 16 for r in rows)
    assert 0 < moved < len(rows) / 5


def test_near_duplicates_match_all_pairs(spark, documents):
    rows = QUERIES["op6_near_dedup"](spark, SF).collect()
    want = brute.near_components(documents)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_line_dedup_keeps_one_of_each_line(spark, documents):
    rows = {r.doc_id: r for r in QUERIES["op7_line_dedup"](spark, SF).collect()}
    assert len(rows) == len(documents)
    held = Counter()
    for d, text in documents:
        gone = {int(x) for x in rows[d].removed.split(",") if x}
        assert rows[d].n_removed == len(gone)
        for k, line in enumerate((text or "").split("\n")):
            words = line.lower().split(" ")
            if k not in gone and len([w for w in words if w]) >= 5:
                held[" ".join(w for w in words if w)] += 1
    assert max(held.values()) == 1


def test_leaks_are_the_documents_with_benchmark_text(spark, documents):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    joined = {d: " ".join(decontaminate.terms_of(t)) for d, t in documents}
    want = {(d, i) for i, t in items for d, x in joined.items() if " ".join(decontaminate.terms_of(t)) in x}
    assert want == {(r.doc_id, r.item_id) for r in QUERIES["op8_decontaminate"](spark, SF).collect()}


def test_leaks_match_all_passages_held_against_all_items(spark, documents):
    """The benchmark's items, and copies of them with every fifth or every third word changed in a text of their own."""
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    fillers = [t for _, t in documents if t and len(t.split()) > 60]
    rows = list(documents)
    for k, (_, t) in enumerate(items):
        for every in (5, 3):
            ws = [w if (j + 1) % every or j > 0.7 * len(t.split()) else "changed" for j, w in enumerate(t.split())]
            rows.append((1_000_000 + 10 * k + every, " ".join(fillers[k % len(fillers)].split()[:60] + ws + fillers[-1 - k % len(fillers)].split()[:40])))
    settings = decontaminate.Settings()
    want = brute.leaks(rows, items, settings)
    assert sum(d >= 1_000_000 for d, _ in want) >= 0.9 * 2 * len(items)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    with Scratch(spark) as scratch:
        got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, spark.createDataFrame(items, "item_id bigint, text string"), scratch, settings=settings).collect()}
        small = decontaminate.Settings(block=7)
        assert got == {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, spark.createDataFrame(items, "item_id bigint, text string"), scratch, settings=small).collect()}
    assert len(got & want) >= 0.95 * len(want)
    assert not got - want


def test_repeated_windows_match_all_windows(spark, documents):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op9_substring_dedup"](spark, SF).collect()}
    assert got == brute.repeats(documents)


def test_packing_is_gapless_and_tight(spark, documents):
    t = Tokenizer.from_file(str(tokenizer_file("byte_bpe_50k.json")))
    used, least = brute.check_packing(documents, QUERIES["op10_packing"](spark, SF).collect(), lambda x: t.encode(x, add_special_tokens=False).ids)
    assert used <= least * 1.02 + 1
