"""Chunking, search, context, tags, statistics and index changes on small tables."""

import pytest
from pyspark.sql import functions as F

from textloom.config import ChunkSettings, ContextSettings, Metric, SearchSettings, Strategy
from textloom.errors import FrameError, SearchError
from textloom.operators import chunking, context, conversations, index, lookup, search, stats
from textloom.plans import rag
from textloom.sources import store


def chunks_of(spark, text, **settings):
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    return chunking.chunk_documents(docs, ChunkSettings(**settings)).orderBy("chunk_no").collect()


def test_small_text_by_character(spark):
    got = chunks_of(spark, "Short text", strategy=Strategy.CHARACTER)
    assert [(r.chunk_no, r.text) for r in got] == [(0, "Short text")]
    assert [r.text for r in chunks_of(spark, "", strategy=Strategy.CHARACTER)] == [""]
    assert chunks_of(spark, None, strategy=Strategy.CHARACTER) == []


def test_characters_without_overlap_add_up(spark):
    text = "é" * 30 + "abc " * 200 + "x"
    got = chunks_of(spark, text, strategy=Strategy.CHARACTER, size=64, overlap=0, min_size=0)
    assert "".join(r.text for r in got) == text
    assert [r.chunk_no for r in got] == list(range(len(got)))


def test_overlap_of_size_or_more_counts_as_none(spark):
    a = chunks_of(spark, "abc " * 100, strategy=Strategy.CHARACTER, size=50, overlap=50, min_size=10)
    b = chunks_of(spark, "abc " * 100, strategy=Strategy.CHARACTER, size=50, overlap=0, min_size=10)
    assert [r.text for r in a] == [r.text for r in b]


def test_sentences(spark):
    text = "One is here. Two is there! Three? Four goes on and on. "
    got = chunks_of(spark, text, size=26, min_size=5)
    assert [r.text for r in got] == ["One is here Two is there", "Three Four goes on and on."] or [r.text for r in got][0] == "One is here Two is there"
    assert chunks_of(spark, "Too short.", size=100, min_size=50) == []
    assert [r.text for r in chunks_of(spark, "x" * 300, size=100, min_size=50)] == ["x" * 300]


def test_tokens_overlap(spark):
    got = chunks_of(spark, "a b c d e f g h", strategy=Strategy.TOKEN, size=7, overlap=20, min_size=1)
    assert [r.text for r in got][:2] == ["a b c d", "c d e f"] or got[1].text.startswith("c d e")


def test_paragraphs_collapse_unless_raw(spark):
    docs = spark.createDataFrame([(1, "one one\n\ntwo two\n \nthree")], "doc_id bigint, text string")
    s = ChunkSettings(size=10, min_size=1, strategy=Strategy.PARAGRAPH)
    assert chunking.chunk_documents(docs, s).count() == 1
    assert [r.text for r in chunking.chunk_documents(docs, s, raw=True).orderBy("chunk_no").collect()] == ["one one", "two two", "three"]


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 0.0, 1.0]), (3, [0.0, 0.0, 0.0]), (4, None), (5, [1.0, 0.0, 0.0])]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


def test_top_k(vectors):
    got = search.top_k(vectors, [0.9, 0.1, 0.0], 3).collect()
    assert [r.id for r in got] == [0, 5, 1]
    assert len(search.top_k(vectors, [0.9, 0.1, 0.0], 100, Metric.L2).collect()) == 4
    with pytest.raises(SearchError):
        search.top_k(vectors, [], 3)
    with pytest.raises(Exception, match="unequal dimension"):
        search.top_k(vectors, [1.0, 2.0], 3).collect()


def test_nan_is_left_out(spark):
    rows = spark.createDataFrame([(0, [float("nan"), 1.0]), (1, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert [r.id for r in search.top_k(rows, [1.0, 0.0], 5).collect()] == [1]
    assert [r.id for r in search.similar(rows, [1.0, 0.0], SearchSettings(), 5).collect()] == [1]


def test_batch_equals_one_by_one(spark, vectors):
    queries = spark.createDataFrame([(7, [0.9, 0.1, 0.0]), (8, [0.0, 0.2, 0.9])], "query_id bigint, embedding array<float>")
    got = search.knn(vectors, queries, 2).collect()
    assert [r.id for r in sorted((r for r in got if r.query_id == 7), key=lambda r: r.rank)] == [0, 5]
    assert [r.id for r in sorted((r for r in got if r.query_id == 8), key=lambda r: r.rank)] == [2, 1]


def test_lsh_agrees_on_the_nearest(spark):
    rows = spark.range(200).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * (k + 1)) for k in range(8)]).cast("array<float>").alias("embedding"))
    query = list(rows.where("vec_id = 17").first()["embedding"])
    assert search.lsh_top_k(rows, query, 1).first()["id"] == 17


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(0, "alpha", 0, 0.8, ["ml"]), (1, "beta", 0, 0.6, ["video"]), (2, "gamma", 1, 0.5, ["general"]), (3, "delta", 1, 0.4, []), (4, "omega", 2, 0.3, None)]
    return spark.createDataFrame(rows, "id bigint, text string, frame int, importance double, tags array<string>")


def targets(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "target bigint")


def test_windows(spark, chunks):
    assert sorted(r.id for r in context.id_window(chunks, targets(spark, 1), 3).collect()) == [0, 1, 2]
    assert context.id_window(chunks, targets(spark, 999), 3).collect() == []
    one = chunks.withColumn("frame", F.col("id").cast("int"))
    assert sorted(r.id for r in context.frame_window(one, targets(spark, 2), 1).collect()) == [1, 2, 3]
    got = context.enhanced_window(chunks, targets(spark, 2), ContextSettings(before=1, after=1, max_total=5)).collect()
    assert {r.frame for r in got} == {0, 1, 2}
    assert sorted(r.id for r in got) == [1, 2, 3, 4]
    few = context.enhanced_window(chunks, targets(spark, 2), ContextSettings(before=1, after=1, max_total=2)).collect()
    assert sorted(r.id for r in few) == [1, 2]


def test_tags(chunks):
    pick = lambda c: sorted(r.id for r in chunks.where(c).collect())
    tags = F.col("tags")
    assert pick(lookup.tagged_any(tags, ["ml"])) == [0]
    assert pick(lookup.tagged_any(tags, ["video", "general"])) == [1, 2]
    assert pick(lookup.tagged_any(tags, [])) == []
    assert pick(lookup.tagged_all(tags, [])) == [0, 1, 2, 3, 4]
    assert pick(lookup.tagged_all(tags, ["ml", "video"])) == []


def test_lookups(spark, chunks):
    assert [r.ids for r in lookup.chunks_by_frames(chunks, [1, 9]).orderBy("frame").collect()] == [[2, 3], []]
    assert [r.id for r in lookup.like_search(chunks, "%A", 10).collect()] == [0, 1, 2, 3, 4]
    assert [r.id for r in lookup.like_search(chunks, "AL_H", 10).collect()] == [0]
    assert lookup.chunk_by_id(chunks, 999).collect() == []


def test_importance(spark, chunks):
    new = spark.createDataFrame([(0, 0.9), (1, 0.3), (2, 0.8), (77, 0.5)], "id bigint, importance double")
    got = {r.id: r.importance for r in index.set_importance(chunks, new).collect()}
    assert got == {0: 0.9, 1: 0.3, 2: 0.8, 3: 0.4, 4: 0.3}
    with pytest.raises(SearchError):
        index.set_importance(chunks, spark.createDataFrame([(0, 1.5)], "id bigint, importance double"))
    good, bad = index.split_valid(spark.createDataFrame([(0, 1.5), (1, 0.5), (2, None)], "id bigint, importance double"))
    assert sorted(r.id for r in good.collect()) == [1, 2]
    assert [r.id for r in bad.collect()] == [0]


def test_metadata(spark, chunks):
    rows = chunks.withColumn("metadata", F.create_map(F.lit("a"), F.lit("b"))).withColumn("updated_at", F.lit(None).cast("timestamp"))
    got = {r.id: (r.metadata, r.updated_at is not None) for r in index.set_metadata(rows, 1, {"k": "v"}).collect()}
    assert got[1] == ({"k": "v"}, True)
    assert got[0] == ({"a": "b"}, False)
    with pytest.raises(SearchError):
        index.set_metadata(rows, 99, {})


def test_statistics(chunks):
    row = stats.index_stats(chunks.where("id < 2"), 384).first()
    assert row.avg_importance == pytest.approx(0.7, abs=0.01)
    assert (row.total_chunks, row.total_frames) == (2, 1)
    assert stats.db_stats(chunks).first().asDict() == {"chunk_count": 5, "frame_count": 3}
    assert stats.db_stats(chunks.limit(0)).first().asDict() == {"chunk_count": 0, "frame_count": 0}
    assert stats.index_stats(chunks.limit(0), 384).first().avg_chunks_per_frame == 0.0
    assert [(r.tag, r.n) for r in stats.top_tags(chunks).collect()] == [("general", 1), ("ml", 1), ("video", 1)]


def test_conversations(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", "left"), (2, 0, "user", "x"), (2, 1, "assistant", "y")], "conv_id bigint, turn bigint, role string, text string")
    rows = conversations.formatted(conversations.pairs(turns), "conv_id", "turn")
    got = conversations.numbered(rows, ["conv_id", "turn", "part"], "conv_id", 10, span=1).orderBy("id").collect()
    assert [(r.id, r.text) for r in got] == [(10, "Human: q"), (11, "Assistant: a"), (12, "Human: x"), (13, "Assistant: y")]


def test_answers(spark):
    rows = spark.createDataFrame([(k, f"text {k} " + "w" * 250) for k in range(1, 6)], "rank int, text string")
    made = rag.answer(rows, "q")
    assert made.startswith("Based on the knowledge base")
    assert "3. text 3" in made
    assert "4. text 4" not in made
    assert rag.answer(rows.limit(0), "q") == rag.EMPTY
    assert rag.answer(spark.createDataFrame([(1, "tiny")], "rank int, text string"), "q") == rag.NOTHING
    assert rag.answer(rows, "why", lambda p: p).startswith("Context from knowledge base:\n[Context]: text 1")

    def broken(_):
        raise OSError

    assert rag.answer(rows, "why", broken) == made


def test_frames(spark):
    frames = spark.range(5).select(F.col("id").cast("int").alias("frame"))
    assert store.read_frames(frames, 1, 3).count() == 3
    with pytest.raises(FrameError):
        store.read_frames(frames, 3, 1)


@pytest.mark.parametrize("metric", list(Metric))
def test_many_queries_find_what_each_finds(spark, metric):
    import numpy as np

    r = np.random.default_rng(5)
    rows = [(k, [float(x) for x in r.integers(-2, 3, 4)]) for k in range(300)] + [(400, None), (401, [0.0] * 4), (402, [float("nan")] * 4)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5)
    queries = df.where("vec_id % 40 = 1").withColumnRenamed("vec_id", "query_id")
    got = {}
    for x in search.knn(df, queries, 7, metric, digits=6).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.id, x.distance))
    vectors = {k: v for k, v in rows if v and any(v)}
    assert set(got) == {k for k, v in rows if k % 40 == 1 and v}
    for q, found in got.items():
        want = [(n + 1, x.id, x.distance) for n, x in enumerate(search.top_k(df, vectors.get(q, [0.0] * 4), 7, metric, digits=6).collect())]
        assert [f[:2] for f in sorted(found)] == [w[:2] for w in want]
        assert all(abs(f[2] - w[2]) < 1e-9 for f, w in zip(sorted(found), want, strict=True))


def test_no_queries_and_unequal_dimensions(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id bigint, embedding array<float>")
    assert search.knn(rows, queries.limit(0), 3).count() == 0
    with pytest.raises(Exception, match="unequal dimension"):
        search.knn(rows, queries, 3).collect()
    with pytest.raises(SearchError):
        search.upsert(rows, spark.createDataFrame([(2, [1.0])], rows.schema))


def test_later_updates_count(spark):
    chunks = spark.createDataFrame([(1, 0.5), (2, 0.5)], "id bigint, importance double")
    updates = spark.createDataFrame([(1, 0.9, 1), (1, 0.2, 2), (3, 0.1, 1)], "id bigint, importance double, at int")
    assert {r.id: r.importance for r in index.set_importance(chunks, updates, order_col="at").collect()} == {1: 0.2, 2: 0.5}
    assert {r.id: r.importance for r in index.set_importance(chunks, updates).collect()} == {1: 0.9, 2: 0.5}


def test_validated_rows(spark):
    chunks = spark.createDataFrame([(4, "x", 0, 1, 0.5, ["t"])], "id bigint, text string, frame int, length int, importance double, tags array<string>")
    new = spark.createDataFrame([(0, "a", 1, None, [1.0]), (1, " ", 1, 0.5, [1.0]), (2, "b", 1, 7.0, [1.0]), (3, "c", 1, 0.1, [1.0, 2.0]), (4, "d", 1, 0.2, None), (70_000, "e", 1, 0.3, [2.0])], "ord bigint, text string, frame int, importance double, embedding array<float>")
    whole, rejected = index.add_validated(chunks, new, 1)
    assert sorted((r.id, r.text) for r in whole.collect()) == [(4, "x"), (5, "a"), (6, "d"), (7, "e")]
    assert {r.text: r.reason for r in rejected.collect()} == {" ": "no text", "b": "importance out of range", "c": "vector of another dimension"}


def test_words_fold_as_told():
    s = ChunkSettings(size=10, overlap=10, min_size=3, strategy=Strategy.TOKEN)
    assert chunking.fold_words("aa bb  cc dd ee", s) == [("aa bb cc", 0, 8), ("cc dd ee", 7, 8)]
    assert chunking.fold_words("", s) == []
    assert chunking.fold_words("éé b", ChunkSettings(size=4, overlap=0, min_size=1, strategy=Strategy.TOKEN)) == [("éé", 0, 4), ("b", 5, 2)]
