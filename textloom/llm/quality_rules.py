"""Quality rules: word and repetition rules, and cross-document line frequency by host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACE, Scratch, let, normalised_lines, words

SYMBOLS = "[#*$%&|<>]"  # fixed value
MIN_WORDS = 50  # fixed value
MAX_REPEAT_PERCENT = 50  # fixed value


def repeated_words(tokens: Column, window: int = 3, place_bits: int = 1) -> Column:
    """How many words lie in a window of so many words that the text has twice or more.

    The windows' hashes are packed with their places into longs and sorted, so
    equal windows are neighbours; neighbours of equal hash are compared word by
    word. Should any of them differ, as may happen in very long texts whose
    places leave few bits to the hash, the windows' words are sorted instead.
    The places then give the words covered. n log n in the text's length.
    place_bits: the least bits kept for the place.
    """
    bits_needed = F.greatest(F.ceil(F.log2(F.size(tokens) + 1.0)), F.lit(place_bits)).cast("int")
    starts = F.sequence(F.lit(0), F.size(tokens) - window)
    word = lambda i, k: F.get(tokens, i + k)
    own = lambda p: F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window))))
    total = lambda p: F.aggregate(own(p), F.lit(0).cast("long"), lambda a, x: a + x)

    def by_words() -> Column:
        rows = F.sort_array(F.transform(starts, lambda i: F.struct(F.array(*[word(i, k) for k in range(window)]).alias("w"), i.alias("at"))))
        twice = lambda s: F.filter(s, lambda x, k: (x["w"] == F.get(s, k - 1)["w"]) | (x["w"] == F.get(s, k + 1)["w"]))
        return let(rows, lambda s: let(F.sort_array(F.transform(twice(s), lambda x: x["at"])), total))

    def packed(bits: Column) -> Column:
        key = lambda i: F.xxhash64(*[word(i, k) for k in range(window)])
        put = lambda i: F.call_function("shiftleft", F.call_function("shiftrightunsigned", key(i), bits), bits).bitwiseOR(i.cast("long"))
        return F.sort_array(F.transform(starts, put))

    def covered(bits: Column) -> Column:
        place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")
        alike = lambda x, y: F.call_function("shiftright", x, bits) == F.call_function("shiftright", y, bits)
        met = lambda s: F.filter(s, lambda x, k: alike(x, F.get(s, k - 1)) | alike(x, F.get(s, k + 1)))

        def differ(x: Column, y: Column) -> Column:
            same = F.lit(True)
            for k in range(window):
                same = same & (word(place(x), k) == word(place(y), k))
            return alike(x, y) & ~same

        torn = lambda m: F.size(F.filter(m, lambda x, k: differ(x, F.get(m, k - 1)))) > 0
        by_hash = lambda m: let(F.sort_array(F.transform(m, place)), total)
        return let(packed(bits), lambda s: let(met(s), lambda m: F.when(torn(m), by_words()).otherwise(by_hash(m))))

    return F.when(F.size(tokens) < window + 1, F.lit(0).cast("long")).otherwise(let(bits_needed, covered))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the text's measures: _w (words), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    with_words = docs.withColumn("_w", words(F.col(text_col)))
    return with_words.select(
        "*",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_w")).alias("n_repeat_words"),
    )


def _lines(text: Column) -> Column:
    """Of each line with a word: (hash of the normalised line, its words)."""
    held = F.filter(normalised_lines(text, digits=True), lambda x: x != "")
    return F.transform(held, lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).alias("n")))


_ROW = ("_id", "_host", "_content")


def _judged(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, host_col: str, max_docs: int, depleted_percent: int) -> DataFrame:
    """judge(), with _id, _host and _content (the text's hash), which name a row."""
    measured = measures(docs.select(F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), F.col(text_col).alias("_text")), "_text")
    facts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = scratch.cut(measured.select("_id", "_host", F.xxhash64("_text").alias("_content"), *facts, _lines(F.col("_text")).alias("_lines")), "lines")
    distinct = F.array_distinct(F.transform("_lines", lambda x: x["line"]))
    # One row for each document that holds the line, whatever rows repeat its id: combined before and after the first exchange.
    by_doc = rows.select("_host", "_id", F.explode(distinct).alias("line")).groupBy("_host", "line", "_id").agg(F.lit(1).alias("_one"))
    frequent = by_doc.groupBy(F.col("_host").alias("_of"), F.col("line").alias("_line")).agg(F.count("*").alias("_n"), F.min("_id").alias("_first")).where(F.col("_n") > max_docs)
    frequent = scratch.cut(frequent.drop("_n"), "frequent")
    present = rows.select(*_ROW, F.explode("_lines").alias("x")).select(*_ROW, "x.line", "x.n")
    found = present.join(frequent, F.col("_host").eqNullSafe(F.col("_of")) & (F.col("line") == F.col("_line"))).where(~F.col("_id").eqNullSafe(F.col("_first")))
    # Rows of equal id, host and text are alike, so per such key the sums hold for each once divided by the rows.
    named = [F.col(c).alias(f"_l{c}") for c in _ROW]
    lost = found.groupBy(*named).agg(F.sum("n").alias("_lost"), F.collect_set("line").alias("frequent"))
    alike = rows.groupBy(*named).count().where(F.col("count") > 1)
    lost = lost.join(alike, _same_row(lost, alike, "_l", "_l"), "left").select(*[lost[f"_l{c}"] for c in _ROW], F.expr("_lost div coalesce(count, 1)").alias("_lost"), "frequent")
    joined = rows.join(lost, _same_row(rows, lost, "", "_l"), "left")
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    removed = F.coalesce(F.col("_lost"), F.lit(0)).cast("long")
    return joined.select(
        *_ROW,
        *facts,
        base_failed.alias("base_failed"),
        removed.alias("n_removed_words"),
        (~base_failed & (100 * removed <= depleted_percent * F.col("n_words"))).alias("kept"),
        F.coalesce("frequent", F.array().cast("array<bigint>")).alias("frequent"),
    )


def _same_row(a: DataFrame, b: DataFrame, of_a: str, of_b: str) -> Column:
    ident, host, content = ((a[f"{of_a}{c}"], b[f"{of_b}{c}"]) for c in _ROW)
    return ident[0].eqNullSafe(ident[1]) & host[0].eqNullSafe(host[1]) & (content[0] == content[1])


def judge(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 20, depleted_percent: int = 50) -> DataFrame:
    """Per row of docs: id, the measures, base_failed, n_removed_words, frequent (line hashes to remove), kept.

    A normalised line that more than max_docs distinct documents of one host
    hold is above the limit: it goes from all of the host's documents but that
    of the smallest id. Copies under ids of their own are documents of their
    own. A document that loses more than depleted_percent of its words is
    depleted; kept is false for it and where base_failed holds. A null host is
    a host of its own; null and blank texts have no words and fail. Rows that
    repeat an id count as one document, each gives a row, and each is judged by
    its own text; a line of theirs goes unless the id is the smallest. Rows
    with a null id count as one document. Lines' hashes have 64 bits.

    One pass over the texts writes measures and line hashes (about a tenth of
    the input); counts combine map-side, so a line of any frequency sends a row
    a document, spread by document, and the join back may be split where a line
    is hot.
    """
    return _judged(docs, scratch, id_col, text_col, host_col, max_docs, depleted_percent).withColumnRenamed("_id", id_col).drop("_host", "_content")


def apply_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 20, depleted_percent: int = 50) -> DataFrame:
    """The rows that judge() keeps, with their columns, less the lines above the limits.

    Verdicts come back by id, host and text, so that rows of one id with
    different texts each meet their own; repeated rows stay repeated.
    """
    with Scratch(docs.sparkSession) as scratch:
        verdict = _judged(docs, scratch, id_col, text_col, host_col, max_docs, depleted_percent)
        kept = verdict.where("kept").select(*[F.col(c).alias(f"_kept{c}") for c in _ROW], F.col("frequent").alias("_frequent"))
        kept = scratch.keep(kept.dropDuplicates([f"_kept{c}" for c in _ROW]), "kept")
    lines = F.struct(F.split(text_col, "\n").alias("raw"), normalised_lines(F.col(text_col), digits=True).alias("plain"))
    stays = lambda p: F.filter(p["raw"], lambda _, k: ~F.array_contains(F.col("_frequent"), F.xxhash64(F.get(p["plain"], k))))
    less = F.array_join(let(lines, stays), "\n")
    text = F.when(F.size("_frequent") > 0, less).otherwise(F.col(text_col))
    same = F.col(id_col).eqNullSafe(F.col("_kept_id")) & F.col(host_col).eqNullSafe(F.col("_kept_host")) & (F.xxhash64(text_col) == F.col("_kept_content"))
    joined = docs.join(kept.hint("shuffle_hash"), same).withColumn(text_col, text)
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return joined.select(*docs.columns)
