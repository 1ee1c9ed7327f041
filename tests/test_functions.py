"""Exact values of the scalar and vector functions."""

import math

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.oracle import compare
from textloom.config import ChunkSettings, CodecSettings, ErrorCorrection, Metric, Settings, Strategy
from textloom.errors import CodecError, ConfigError
from textloom.functions import codec, embedders, text, tokens
from textloom.functions import vector as V
from textloom.plans import catalog


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("n,want", [(0, "0 B"), (512, "512 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (2**20, "1.0 MB"), (2**30, "1.0 GB"), (2**40, "1.0 TB")])
def test_human_size(spark, n, want):
    assert value(spark, text.human_size(F.lit(n).cast("bigint"))) == want


@pytest.mark.parametrize("n,want", [(2**40, "1024.0 GB"), (5 * 2**40 + 2**28, "5120.2 GB"), (1280, "1.2 KB"), (1792, "1.8 KB"), (2**20 + 2**18, "1.2 MB"), (None, None)])
def test_human_size_up_to_a_unit_with_ties_to_even(spark, n, want):
    """As the query's SQL has it: no unit beyond GB, ties to even."""
    assert value(spark, text.human_size(F.lit(n).cast("bigint"), largest="GB")) == want


def test_human_size_matches_its_sql_on_large_ids(spark, tmp_path):
    rows = [(d, c) for d in (0, 1, 3, 255, 1023, 51_282, 3_000_000) for c in (0, 1, 640, 1152, 1280, 1792, 20_000, 327_680)]
    spark.createDataFrame(rows, "doc_id bigint, n_chars bigint").write.parquet(str(tmp_path / "made"))
    merged = pq.read_table(tmp_path / "made")
    pq.write_table(merged, tmp_path / "documents.parquet")
    compare(catalog.QUERIES["human_size"](spark, str(tmp_path)), catalog.ORACLES["human_size"], str(tmp_path))


@pytest.mark.parametrize("done,total,want", [(0, 100, 0), (50, 100, 50), (100, 100, 100), (0, 0, 0)])
def test_progress(spark, done, total, want):
    assert value(spark, text.progress(F.lit(done), F.lit(total))) == want


@pytest.mark.parametrize("n,target,want", [(10000, 10, 1000), (100, 10, 256), (50000, 10, 4096), (1000, 0, 1024)])
def test_best_chunk_size(spark, n, target, want):
    assert value(spark, text.best_chunk_size(F.lit(n), F.lit(target))) == want


def test_paths(spark):
    assert value(spark, text.file_extension(F.lit("a/b.tar.GZ"))) == "gz"
    assert value(spark, text.file_extension(F.lit("a/noext"))) is None
    assert value(spark, text.is_document(F.lit("x.PDF"))) is True
    assert value(spark, text.is_document(F.lit("x"))) is False
    assert value(spark, text.is_video(F.lit("x.mkv"))) is True
    assert value(spark, text.safe_name(F.lit('a/b\\c:d*e?f"g<h>i|j\n'))) == "a_b_c_d_e_f_g_h_i_j_"


def test_cleaning(spark):
    assert value(spark, text.clean(F.lit("  a \n\n b  c\t"))) == "a b c"
    assert value(spark, text.prepare(F.lit("  Hello   WORLD! "), lowercase=True)) == "hello world!"
    assert value(spark, text.nfc(F.lit("é"))) == "é"
    assert value(spark, text.preview(F.lit("é" * 5), 3)) == "ééé..."


def test_markdown_order(spark):
    assert value(spark, text.strip_markdown(F.lit("# T\n# U ![a](u) [l](u) ```x\ny``` **b**"))) == "T # U !a l b"
    assert value(spark, text.strip_markdown(F.lit("# T\n# U\n---\nx"), multiline=True)) == "T U x"
    assert value(spark, text.strip_markdown(F.lit("---"))) == ""


@pytest.mark.parametrize("x,want", [("", False), ("a" * 200_000, False), ("plain text", True), ("émile 1", True), ("smile \U0001f600", False)])
def test_decodable(spark, x, want):
    assert value(spark, text.decodable(F.lit(x))) is want


def test_vectors(spark):
    e0, e1, zero = (V.literal(x) for x in ([1, 0, 0], [0, 1, 0], [0, 0, 0]))
    assert value(spark, V.distance(e0, e1)) == 1.0
    assert value(spark, V.distance(e0, e1, Metric.L2)) == pytest.approx(math.sqrt(2))
    assert value(spark, V.distance(e0, e1, Metric.L1)) == 2.0
    assert value(spark, V.distance(e0, e1, Metric.DOT)) == 0.0
    assert value(spark, V.distance(e0, zero)) == 1.0
    assert value(spark, V.cosine_similarity(e0, zero)) == 0.0
    assert value(spark, V.normalise(V.literal([3, 4, 0]))) == pytest.approx([0.6, 0.8, 0.0])
    assert value(spark, V.normalise(zero)) == [0.0, 0.0, 0.0]
    with pytest.raises(Exception, match="unequal dimension"):
        value(spark, V.distance(e0, V.literal([1, 0])))


def test_tokens(spark):
    made = value(spark, tokens.tokenise(F.lit("one two three"), 8))
    assert len(made["input_ids"]) == len(made["attention_mask"]) == 8
    assert made["attention_mask"] == [1] * 5 + [0] * 3
    assert made["input_ids"][0] == tokens.START
    assert made["input_ids"][4] == tokens.END
    assert made["original_length"] == 13
    long = value(spark, tokens.tokenise(F.lit("a b c d e f g h i j"), 10))
    assert len(long["input_ids"]) == 10
    assert len(value(spark, tokens.pad(F.array(*map(F.lit, range(12))), 10, truncate=False))) == 12


def test_hash_embeddings(spark):
    e = embedders.WordHashEmbedder()
    a, b, c = (value(spark, e.column(F.lit(t))) for t in ("some words", "some words", "other words"))
    assert len(a) == 384
    assert a == b != c
    assert sum(x * x for x in a) == pytest.approx(1.0, abs=1e-5)
    t = value(spark, embedders.token_hash(F.lit("some words"), 64))
    assert sum(x * x for x in t) == pytest.approx(1.0, abs=1e-5)


def test_a_model_embedder_and_its_cache(spark):
    model = embedders.ModelEmbedder(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], 2)
    rows = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, None)], "id int, text string")
    got = {r["id"]: r["embedding"] for r in embedders.embed_texts(rows, model).collect()}
    assert got == {1: [2.0, 1.0], 2: [2.0, 1.0], 3: None}


@pytest.mark.parametrize("t", ["short", "x" * 500, "a\nb\tc", "!@#$%^&*()", "héllo 世界 \U0001f600", '{"a": [1, 2]}', "", "GZ:not really", "GZ:" + "y" * 300])
def test_payloads_come_back(spark, t):
    made = value(spark, codec.encode(F.lit(t)))
    assert codec.decode_text(made["payload"]) == t
    assert made["encoded_size"] == len(made["payload"].encode())
    assert value(spark, codec.decode(F.lit(made["payload"]))) == t


def test_payload_rules():
    assert codec.encode_text("x" * 99) == ("x" * 99, False)
    assert codec.encode_text("x" * 500)[1]
    assert codec.encode_text("x" * 500, CodecSettings(compress=False)) == ("x" * 500, False)
    with pytest.raises(CodecError):
        codec.decode_text("GZ:!!")


def test_capacities(spark):
    cap = lambda v, level: value(spark, codec.max_capacity(F.lit(v), F.lit(level)))
    assert cap(40, "L") == 852
    assert cap(40, "L") > cap(1, "L")
    assert cap(20, "L") > cap(20, "H")
    assert cap(30, "M") == 450
    assert value(spark, codec.smallest_version(F.lit(100), F.lit("L"))) == 5
    assert value(spark, codec.smallest_version(F.lit(10_000), F.lit("L"))) == 0


def test_settings_round_trip():
    s = Settings(chunk=ChunkSettings(size=7, strategy=Strategy.TOKEN), codec=CodecSettings(error_correction=ErrorCorrection.H))
    assert Settings.from_json(s.to_json()) == s
    with pytest.raises(ConfigError):
        ChunkSettings(size=0)
    with pytest.raises(ConfigError):
        Settings.from_json('{"nope": 1}')
