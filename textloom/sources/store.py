"""A memory on disk: Parquet tables by version, and a manifest that names the current one."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FrameError, StorageError
from ..schema import CHUNKS, VERSION


class Store:
    """Writers add files under a new version and put its manifest in place last, so readers see whole versions only.

    One writer at a time. Paths are those of any file system that Spark knows.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, name: str):
        return self._Path(f"{self.path}/{name}")

    def _versions(self) -> list[int]:
        """The versions whose manifests are in place, in order."""
        if not self._fs.exists(self._Path(self.path)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._Path(self.path))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json") and n[9:-5].isdigit())

    def manifest(self) -> dict:
        """The latest manifest; empty for a store that isn't there yet."""
        versions = self._versions()
        if not versions:
            return {}
        stream = self._fs.open(self._file(f"manifest-{versions[-1]}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Puts the manifest in place under its own version by a rename; older ones stay, so there is always one."""
        new, place = self._file("manifest.new"), self._file(f"manifest-{manifest['version']}.json")
        stream = self._fs.create(new, True)
        stream.write(bytearray(json.dumps(manifest, indent=1).encode()))
        stream.close()
        if self._fs.exists(place) or not self._fs.rename(new, place):
            raise StorageError(f"version {manifest['version']} has been published already")

    def tables(self) -> list[str]:
        return sorted(self.manifest().get("tables", {}))

    def read(self, name: str = "chunks") -> DataFrame:
        parts = self.manifest().get("tables", {}).get(name)
        if not parts:
            raise StorageError(f"{self.path} has no table {name}")
        return self.spark.read.parquet(*[f"{self.path}/{p}" for p in parts])

    def write(self, tables: dict[str, DataFrame], *, append: bool = False, batch: str | None = None) -> int:
        """Publishes tables as the next version; append keeps the parts that are there. A batch seen before is skipped."""
        old = self.manifest()
        if batch is not None and batch in old.get("batches", []):
            return old["version"]
        version = old.get("version", 0) + 1
        parts = dict(old.get("tables", {})) if append else {}
        for name, df in tables.items():
            part = f"{name}/v{version}"
            order = [c for c in ("frame", "id") if c in df.columns]
            (df.sortWithinPartitions(*order) if order else df).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{part}")
            parts[name] = [*parts.get(name, []), part] if append else [part]
        batches = [*old.get("batches", []), *([batch] if batch is not None else [])]
        self._publish({"schema": VERSION, "version": version, "written": time.time(), "tables": parts, "batches": batches})
        return version

    def append_chunks(self, chunks: DataFrame) -> int:
        """Adds chunks whose ids are new; an id that is there fails the whole."""
        if "chunks" in self.tables() and not chunks.join(self.read().select("id"), "id", "left_semi").isEmpty():
            raise StorageError("chunk ids are there already")
        return self.write({"chunks": chunks}, append=True)

    def compact(self, name: str = "chunks") -> int:
        """The table in one part, in a new version."""
        return self.write({n: self.read(n) for n in self.tables()} | {name: self.read(name)})

    def size_bytes(self) -> int:
        return self._fs.getContentSummary(self._Path(self.path)).getLength()

    def info(self, fps: float = 30.0) -> DataFrame:
        """frame_count, fps and duration of the frames table."""
        return self.read("frames").agg(F.count("*").alias("frame_count")).select("frame_count", F.lit(fps).alias("fps"), (F.col("frame_count") / fps).alias("duration"))


def empty_chunks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CHUNKS)


def read_frame(frames: DataFrame, n: int) -> DataFrame:
    return frames.where(F.col("frame") == n)


def read_frames(frames: DataFrame, first: int, last: int) -> DataFrame:
    """Frames first to last, both included."""
    if first > last:
        raise FrameError("the first frame lies behind the last")
    return frames.where(F.col("frame").between(first, last))
