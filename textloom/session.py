"""A Spark session with the settings that the engine counts on, and the library on its executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .errors import StorageError


def session(name: str = "textloom", master: str | None = None, **more: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; anything else as the cluster has it or as given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", **more}
    spark = builder.config(map=settings).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the executors, once a context, so that it need not be installed there."""
    context = spark.sparkContext
    if getattr(context, "_has_textloom", False):
        return
    home = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix="textloom-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(home.rglob("*.py")):
            out.write(file, Path(home.name) / file.relative_to(home))
    context.addPyFile(path)
    atexit.register(lambda: Path(path).unlink(missing_ok=True))
    context._has_textloom = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one set on the context.

    Where neither is set, a local session gets a folder of its own, once a
    context; a cluster has no machine-local folder that all can read, so there
    it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    by_hand = context._jsc.sc().getCheckpointDir()
    if by_hand.isDefined():
        return by_hand.get()
    if not (context.master == "local" or context.master.startswith("local[")):
        raise StorageError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not getattr(context, "_textloom_folder", None):
        context._textloom_folder = tempfile.mkdtemp(prefix="textloom-")
    return context._textloom_folder
