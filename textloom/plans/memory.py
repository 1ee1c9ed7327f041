"""A memory as a session: build, append, search, look around, answer."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import SearchSettings, Settings
from ..errors import SearchError, StorageError
from ..functions import codec
from ..functions.embedders import Embedder, WordHashEmbedder
from ..operators import context, conversations, lookup, search, stats
from ..operators.chunking import chunk_documents, number_chunks
from ..sources.store import Store
from ..streaming.append import append_stream, memory_tables, next_ids
from . import rag


class Memory:
    """Documents become chunks with vectors and payloads under a path; queries read them back."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings(), embedder: Embedder | None = None):
        self.spark, self.settings = spark, settings
        self.store = Store(spark, path)
        self.embedder = embedder or WordHashEmbedder(settings.embed.dimension, settings.embed.normalize)

    def chunks(self) -> DataFrame:
        return self.store.read()

    def build(self, docs: DataFrame, *, progress: Callable[[int, str], None] | None = None) -> int:
        """Chunks, embeds and stores docs (doc_id, text, and optionally source); replaces what was there."""
        tell = progress or (lambda *_: None)
        tell(0, "chunking")
        keep = ("doc_id", *[c for c in ("source",) if c in docs.columns])
        made = number_chunks(chunk_documents(docs, self.settings.chunk, keep=keep))
        if made.isEmpty():
            raise StorageError("no chunks to store")
        tell(25, "embedding")
        version = self._write(made.withColumn("frame", F.col("id").cast("int")), append=False)
        tell(100, "done")
        return version

    def _write(self, rows: DataFrame, *, append: bool) -> int:
        for name, kind in (("source", "string"), ("page", "int")):
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast(kind))
        return self.store.write(memory_tables(rows, self.embedder, self.settings.codec), append=append)

    def append_stream(self, stream: DataFrame, checkpoint: str, *, once: bool = True) -> StreamingQuery:
        """Appends a stream of (doc_id, text), which then is found like anything else."""
        return append_stream(stream, self.store, checkpoint, self.settings.chunk, once=once, embedder=self.embedder, payloads=self.settings.codec)

    def append_texts(self, texts: Iterable[str], source: str = "incremental_update") -> int:
        """Adds texts as they are, one chunk each, numbered on."""
        rows = [(k, t) for k, t in enumerate(texts)]
        if not rows:
            raise StorageError("no chunks to append")
        return self.append_rows(self.spark.createDataFrame(rows, "ord bigint, text string"), source)

    def append_rows(self, rows: DataFrame, source: str = "incremental_update") -> int:
        """Adds rows (ord dense from 0, text) as chunks."""
        first, frame = next_ids(self.store)
        made = rows.select((F.col("ord") + first).alias("id"), "text", F.lit(source).alias("source"), F.lit(0).alias("offset"), F.octet_length("text").alias("length"), (F.col("ord") + frame).cast("int").alias("frame"))
        return self._write(made, append=True)

    def append_documents(self, docs: DataFrame) -> int:
        """Chunks docs and adds the new chunks only."""
        made = number_chunks(chunk_documents(docs, self.settings.chunk))
        return self.append_rows(made.select(F.col("id").alias("ord"), "text"))

    def append_conversation(self, pairs: DataFrame) -> int:
        """Adds (conv_id, turn, human, assistant) as two chunks a pair."""
        rows = conversations.formatted(pairs, "conv_id", "turn")
        return self.append_rows(conversations.numbered(rows, ["conv_id", "turn", "part"], "conv_id", 0).select(F.col("id").alias("ord"), "text"))

    def vector(self, text: str) -> list[float]:
        return list(self.spark.range(1).select(self.embedder.column(F.lit(text)).alias("v")).first()["v"])

    def search(self, text: str, k: int = 5, settings: SearchSettings | None = None) -> DataFrame:
        """score and the whole record (but its vector) of the k chunks most alike."""
        chunks = self.chunks()
        if lookup.with_embedding(chunks).isEmpty():
            raise SearchError("no chunk has an embedding")
        best = search.similar(chunks, self.vector(text), settings or self.settings.search, k, id_col="id")
        return search.with_records(best, chunks.drop("embedding")).orderBy(F.desc("score"), "id")

    def chunk(self, chunk_id: int) -> DataFrame:
        return lookup.chunk_by_id(self.chunks(), chunk_id)

    def around(self, chunk_id: int, window: int) -> DataFrame:
        target = self.spark.createDataFrame([(chunk_id,)], "target bigint")
        return context.id_window(self.chunks(), target, window).orderBy("id")

    def decode_frame(self, frame: int) -> DataFrame:
        return self.store.read("frames").where(F.col("frame") == frame).select("frame", codec.decode("payload").alias("text"))

    def stats(self) -> DataFrame:
        return stats.db_stats(self.chunks())

    def ask(self, question: str, model: Callable[[str], str] | None = None, k: int = 5) -> str:
        found = self.search(question, k).collect()
        ranked = self.spark.createDataFrame([(n + 1, r["text"]) for n, r in enumerate(found)], "rank int, text string")
        return rag.answer(ranked, question, model)
