"""A memory from files to answers, and streaming append."""

import json
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from textloom import cli
from textloom.config import ChunkSettings, EmbedSettings, Settings
from textloom.errors import PdfError, SearchError, StorageError, TextError
from textloom.plans.memory import Memory
from textloom.sources import files
from textloom.sources.store import Store
from textloom.streaming.append import append_stream

SMALL = Settings(chunk=ChunkSettings(size=60, overlap=0, min_size=5), embed=EmbedSettings(dimension=32))
DOCS = [(0, "The red fox runs. The blue bird sings over the hill. Rain falls at night."), (1, "Ships carry iron across the sea. Harbours close in winter.")]


@pytest.fixture
def memory(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"), SMALL)
    m.build(spark.createDataFrame(DOCS, "doc_id bigint, text string"))
    return m


def test_build_and_search(memory):
    n = memory.stats().first()["chunk_count"]
    assert n >= 3
    text = memory.chunk(1).first()["text"]
    assert memory.search(text, 1).first()["id"] == 1
    assert memory.decode_frame(1).first()["text"] == text
    assert [r.id for r in memory.around(1, 3).collect()] == [0, 1, 2]
    assert isinstance(memory.ask("anything"), str)
    assert memory.store.info().first()["frame_count"] == n


def test_appends_number_on(memory, spark):
    n = memory.stats().first()["chunk_count"]
    memory.append_texts(["one more text", "GZ:and another"])
    memory.append_texts(["one more text"])
    pairs = spark.createDataFrame([(0, 0, "hi", "hello")], "conv_id bigint, turn bigint, human string, assistant string")
    memory.append_conversation(pairs)
    memory.append_documents(spark.createDataFrame([(5, "A new document is here. It has two sentences.")], "doc_id bigint, text string"))
    rows = memory.chunks().orderBy("id").collect()
    assert [r.id for r in rows] == list(range(len(rows)))
    assert [r.frame for r in rows] == list(range(len(rows)))
    assert [r.text for r in rows[n : n + 5]] == ["one more text", "GZ:and another", "one more text", "Human: hi", "Assistant: hello"]
    assert memory.decode_frame(n + 1).first()["text"] == "GZ:and another"
    with pytest.raises(StorageError):
        memory.append_texts([])


def test_store_rules(spark, tmp_path, memory):
    with pytest.raises(StorageError):
        Store(spark, str(tmp_path / "none")).read()
    with pytest.raises(StorageError):
        memory.store.append_chunks(memory.chunks().limit(1))
    with pytest.raises(StorageError):
        Memory(spark, str(tmp_path / "e"), SMALL).build(spark.createDataFrame([], "doc_id bigint, text string"))
    before = memory.chunks().count()
    memory.store.compact()
    assert memory.chunks().count() == before
    assert memory.store.size_bytes() > 0


def test_search_without_vectors_is_an_error(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "v"), SMALL)
    m.store.write({"chunks": spark.createDataFrame([(0, "x", None)], "id bigint, text string, embedding array<float>")})
    with pytest.raises(SearchError):
        m.search("x")


def test_stream_append_once(spark, tmp_path):
    source, store = tmp_path / "in", Store(spark, str(tmp_path / "s"))
    spark.createDataFrame(DOCS, "doc_id bigint, text string").write.parquet(str(source))
    read = lambda: spark.readStream.schema("doc_id bigint, text string").parquet(str(source))
    for _ in range(2):
        append_stream(read(), store, str(tmp_path / "c"), SMALL.chunk).awaitTermination()
    first = store.read().count()
    spark.createDataFrame([(9, "Later text comes in here. It is short.")], "doc_id bigint, text string").write.mode("append").parquet(str(source))
    append_stream(read(), store, str(tmp_path / "c"), SMALL.chunk).awaitTermination()
    ids = [r.id for r in store.read().orderBy("id").collect()]
    assert first < len(ids)
    assert ids == list(range(len(ids)))


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain text")
    (tmp_path / "b.md").write_text("# Head\n**bold**")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4 rest")
    assert files.read_texts(spark, str(tmp_path / "a.txt")).first()["text"] == "plain text"
    assert files.read_markdown(spark, str(tmp_path / "b.md")).first()["text"] == "Head bold"
    assert [r.is_pdf for r in files.read_binary(spark, str(tmp_path / "c.pdf"), str(tmp_path / "a.txt")).orderBy(F.desc("is_pdf")).collect()] == [True, False]
    with pytest.raises(PdfError):
        files.read_pdf(spark, str(tmp_path / "c.pdf"))
    pages = files.read_pdf(spark, str(tmp_path / "c.pdf"), extractor=lambda b: iter([(1, "A fine title here\nbody"), (2, " "), (3, "end")]))
    assert [r.page for r in pages.orderBy("page").collect()] == [1, 3]
    assert files.pdf_title(pages).first()["title"] == "A fine title here"


def test_conversation_files(spark, tmp_path):
    good, bad = tmp_path / "c.json", tmp_path / "d.json"
    good.write_text(json.dumps([{"human": "a", "assistant": "b"}, {"human": 1, "assistant": "b"}, {"human": "x"}, {"human": "c", "assistant": "d"}]))
    bad.write_text('{"human": "a"}')
    assert sorted((r.human, r.assistant) for r in files.read_conversations(spark, str(good)).collect()) == [("a", "b"), ("c", "d")]
    with pytest.raises(TextError):
        files.read_conversations(spark, str(bad))


def test_sqlite_import(spark, tmp_path):
    path = str(tmp_path / "m.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE chunks (id INTEGER PRIMARY KEY, text TEXT, source TEXT, page INTEGER, offset INTEGER, length INTEGER, frame INTEGER, embedding BLOB)")
        db.execute("INSERT INTO chunks VALUES (1, 'x', NULL, NULL, 0, 1, 0, ?), (2, 'y', 's', 3, 0, 1, 1, NULL)", (struct.pack("<2f", 0.5, 1.0) + b"\x01",))
    got = files.read_sqlite(spark, path).orderBy("id").collect()
    assert [(r.id, r.text, r.embedding) for r in got] == [(1, "x", [0.5, 1.0]), (2, "y", None)]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("The quick fox jumps over a dog. " * 10)
    m = str(tmp_path / "mem")
    assert cli.main(["encode", m, str(tmp_path / "a.txt"), "missing.txt", "--chunk-size", "200"]) == 0
    assert cli.main(["append", m, str(tmp_path / "a.txt")]) == 0
    (tmp_path / "c.json").write_text('[{"human": "hi", "assistant": "there"}]')
    assert cli.main(["append-conversation", m, str(tmp_path / "c.json")]) == 0
    assert cli.main(["search", m, "quick fox", "--top-k", "2"]) == 0
    out = capsys.readouterr().out
    assert "skipped, not there" in out
    assert "1. [" in out
    said = []
    cli.chat(Memory(spark, m), ["help", "stats", "search fox", "what?", "q", "never"], said.append)
    assert len(said) >= 4


def test_a_crash_before_the_manifest_leaves_the_last_version(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "crash"))
    rows = spark.createDataFrame([(1, "a")], "id bigint, text string")
    store.write({"chunks": rows})

    def crash(self, manifest):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", crash)
        with pytest.raises(OSError, match="lost"):
            store.write({"chunks": rows.union(rows)})
    assert store.read().count() == 1
    assert store.write({"chunks": rows.union(rows)}) == 2
    assert Store(spark, store.path).read().count() == 2


def test_a_version_is_published_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "once"))
    store.write({"chunks": spark.createDataFrame([(1, "a")], "id bigint, text string")})
    with pytest.raises(StorageError):
        store._publish({"version": 1})


def test_streamed_documents_are_found(spark, tmp_path):
    words = [f"subject{k} " * 30 for k in range(4)]
    spark.createDataFrame(list(enumerate(words)), "doc_id bigint, text string").write.parquet(str(tmp_path / "in"))
    memory = Memory(spark, str(tmp_path / "memory"))
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(str(tmp_path / "in"))
    memory.append_stream(stream, str(tmp_path / "check")).awaitTermination()
    memory.append_stream(stream, str(tmp_path / "check")).awaitTermination()
    assert memory.chunks().count() == 4
    found = memory.search(words[2].strip(), 1).first()
    assert found["text"] == words[2].strip()
    assert memory.decode_frame(found["frame"]).first()["text"] == words[2].strip()
