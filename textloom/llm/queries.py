"""The queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, line_dedup, near_dedup, packing, quality_rules, secrets, sharding, substring_dedup, token_counts
from .common import Scratch, table
from .oracles import ORACLES

SHARDS = 16
EVENTS = 4  # at most, that a turn is told in
CONTEXT = 2048


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        return scratch.keep(quality_rules.judge(table(spark, sf_dir, "documents"), scratch).drop("frequent"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans: one under the base rules, which fills the ledger, and one under all rules, which scans for the new ones only."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        _, ledger = secrets.scan_versions(docs, scratch, path_cols=["doc_id"], text_col="text", rules=secrets.BASE_RULES)
        found, _ = secrets.scan_versions(docs, scratch, path_cols=["doc_id"], text_col="text", ledger=ledger)
        base = {f"n_{r.kind}": F.size(f"found.{r.kind}").cast("long") for r in secrets.BASE_RULES}
        return scratch.keep(
            found.select(
                "doc_id",
                *[n.alias(k) for k, n in base.items()],
                F.sha2(secrets.listing(F.col("found"), secrets.BASE_RULES), 256).alias("base_sha256"),
                secrets.listing(F.col("found"), secrets.RULES).alias("spans"),
            )
        )


def conversation_events(turns: DataFrame) -> DataFrame:
    """A log of streamed conversations from finished turns (conv_id, turn, role, text), which fold_events() gives back.

    An assistant's turn is a draft that is regenerated and streamed in two
    deltas; any other is a message that an edit sets right. Sequence numbers
    are a conversation's, EVENTS to a turn.
    """
    text = F.coalesce("text", F.lit(""))
    half = F.expr("length(coalesce(text, '')) div 2")
    event = lambda k, kind, said: F.struct((F.col("turn") * EVENTS + k).alias("seq"), F.lit(kind).alias("kind"), said.alias("said"))
    streamed = F.array(event(0, "delta", F.concat(text, F.lit(" ..."))), event(1, "regenerate", F.lit("")), event(2, "delta", F.substring(text, F.lit(1), half)), event(3, "delta", F.substring(text, half + 1, F.length(text))))
    edited = F.array(event(0, "message", F.substring(text, F.lit(1), half)), event(1, "edit", text))
    numbered = turns.withColumn("message", F.monotonically_increasing_id())
    log = numbered.select("conv_id", "message", "role", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(edited)).alias("e"))
    return log.select("conv_id", "message", "role", F.col("e.seq").alias("seq"), F.col("e.kind").alias("kind"), F.col("e.said").alias("text"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    log = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    made = chat_format.render(chat_format.fold_events(conversation_events(log)))
    turns = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return made.withColumn("turns", chat_format.read_back(F.col("formatted"))).withColumn("learnt", chat_format.under_mask(F.col("formatted"), F.col("loss_spans"))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), max_tokens=CONTEXT)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        return scratch.keep(decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), scratch))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), ranks=tokenizer_path("byte_bpe_50k.tiktoken"), size=CONTEXT)


_ALL = (op1_quality_rules, op2_secret_scan, op3_chat_format, op4_token_counts, op5_sharding, op6_near_dedup, op7_line_dedup, op8_decontaminate, op9_substring_dedup, op10_packing)
QUERIES = {f.__name__: f for f in _ALL}
__all__ = ["ORACLES", "QUERIES"]
