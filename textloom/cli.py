"""Command line: encode, search, chat, append, append-conversation."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import functions as F

from .config import ChunkSettings, Settings
from .errors import TextloomError
from .plans.memory import Memory
from .session import session
from .sources.files import read_by_suffix, read_conversations


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    encode = sub.add_parser("encode", help="build a memory from files and folders")
    encode.add_argument("memory")
    encode.add_argument("inputs", nargs="+")
    encode.add_argument("--chunk-size", type=int, default=1024)
    encode.add_argument("--overlap", type=int, default=32)
    find = sub.add_parser("search", help="the chunks most like a text")
    find.add_argument("memory")
    find.add_argument("query")
    find.add_argument("--top-k", type=int, default=5)
    chat = sub.add_parser("chat", help="search line by line")
    chat.add_argument("memory")
    append = sub.add_parser("append", help="add files")
    append.add_argument("memory")
    append.add_argument("inputs", nargs="+")
    talk = sub.add_parser("append-conversation", help="add a JSON array of human and assistant texts, or a text file")
    talk.add_argument("memory")
    talk.add_argument("input")
    return p


def files(inputs: list[str], tell=print) -> list[str]:
    """The files under inputs; what is missing is told and left out."""
    found = []
    for path in inputs:
        if os.path.isdir(path):
            found += sorted(os.path.join(top, name) for top, _, names in os.walk(path) for name in names)
        elif os.path.exists(path):
            found.append(path)
        else:
            tell(f"skipped, not there: {path}")
    return found


def documents(spark, paths: list[str]):
    """doc_id, text, source of files, numbered by path."""
    read = read_by_suffix(spark, *paths)
    rank = F.expr("row_number() over (order by source, page) - 1").cast("bigint")  # one row a file: bounded by the command line
    return read.select(rank.alias("doc_id"), "text", "source")


def show(rows, tell=print) -> None:
    for n, r in enumerate(rows.collect(), 1):
        tell(f"{n}. [{r['score']:.3f}] {r['text'][:100]}{'...' if len(r['text']) > 100 else ''}")


def chat(memory: Memory, lines, tell=print) -> None:
    """quit, exit or q ends; help, stats, search TEXT; anything else is a question."""
    for line in lines:
        line = line.strip()
        if line in ("quit", "exit", "q"):
            break
        if line == "help":
            tell("quit, help, stats, search TEXT, or a question")
        elif line == "stats":
            tell(str(memory.stats().first().asDict()))
        elif line.startswith("search "):
            show(memory.search(line[7:], 3), tell)
        elif line:
            tell(memory.ask(line))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session()
    try:
        if args.command == "encode":
            memory = Memory(spark, args.memory, Settings(chunk=ChunkSettings(size=args.chunk_size, overlap=args.overlap, min_size=min(100, args.chunk_size))))
            memory.build(documents(spark, files(args.inputs)))
            print(memory.stats().first().asDict())
        elif args.command == "search":
            show(Memory(spark, args.memory).search(args.query, args.top_k))
        elif args.command == "chat":
            chat(Memory(spark, args.memory), sys.stdin)
        elif args.command == "append":
            Memory(spark, args.memory).append_documents(documents(spark, files(args.inputs)))
        elif args.input.lower().endswith(".json"):
            pairs = read_conversations(spark, args.input).withColumn("turn", F.monotonically_increasing_id()).withColumn("conv_id", F.lit(0).cast("bigint"))
            Memory(spark, args.memory).append_conversation(pairs)
        else:
            Memory(spark, args.memory).append_documents(documents(spark, files([args.input])))
    except TextloomError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0
