"""Secret scans: a ledger of content-addressed blobs, scanned once per rule version."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let, running_sums

LEDGER = "blob string, kind string, version int, spans array<struct<start:bigint,stop:bigint>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a Java pattern, and the least characters of one of its groups.

    marks: strings of which every match holds one; a text without them needs
    no scan under this rule. None where the kind has no such strings.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1
    marks: tuple[str, ...] = ()


# The base kinds' patterns and lengths, in their order.
BASE_RULES = (
    Rule("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
)
#: What the scan finds besides: private key headers, signed web tokens, tokens of code hosts.
MORE_RULES = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", marks=("PRIVATE KEY-----",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", marks=(".eyJ",)),
    Rule("forge", "gh[pousr]_[A-Za-z0-9]{36,}", marks=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
)
RULES = BASE_RULES + MORE_RULES


def spans(text: Column, rule: Rule) -> Column:
    """The rule's leftmost non-overlapping matches that are long enough, as (start, stop) in code points.

    What split() leaves lies between what regexp_extract_all() takes, so the
    places are running sums of both lengths. A short match still uses up its
    characters, as in a left-to-right search that drops it afterwards.
    """
    pattern = F.lit(rule.pattern)
    nothing = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def placed(x: Column) -> Column:
        steps = F.transform(x["hit"], lambda h, k: F.length(F.get(x["gap"], k)) + F.length(h))
        # Match k begins behind all steps before it and its own gap.
        spot = lambda at: F.transform(x["hit"], lambda h, k: F.struct((F.get(at, k) + F.length(F.get(x["gap"], k))).alias("start"), (F.get(at, k) + F.length(F.get(x["gap"], k)) + F.length(h)).alias("stop")))
        return F.filter(let(running_sums(steps), spot), lambda _, k: F.length(F.get(x["held"], k)) >= rule.least)

    parts = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("held"), F.split(text, rule.pattern, -1).alias("gap"))
    return F.when(text.rlike(_likely(rule)), let(parts, lambda x: F.when(F.size(x["hit"]) > 0, placed(x)).otherwise(nothing))).otherwise(nothing)


def _likely(rule: Rule) -> str:
    """A pattern that is found wherever the rule has a long enough match: it spares most texts the full search."""
    if rule.group:
        return rule.pattern
    return f"{rule.pattern[:-1]}{{{rule.least - (4 if rule.kind == 'access' else 0)},}}" if rule.least else rule.pattern


def _fast(rule: Rule) -> Rule:
    """The same matches with the length inside the pattern, where a match can't begin inside a shorter one."""
    return Rule(rule.kind, _likely(rule), version=rule.version) if rule.kind in ("access", "hex") and rule in BASE_RULES else rule


def scan_versions(versions: DataFrame, scratch: Scratch, *, path_cols: list[str], text_col: str, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): spans of every path and version of it, and the ledger with what was scanned now.

    Each row of versions is one historical version of a path. Its text's
    SHA-256 names a blob; only blobs that the ledger lacks under a rule's
    version are scanned, each once however many paths have it. findings has a
    row for each (path, blob) of versions with a map from kind to spans, empty
    arrays included. Null texts are empty. Repeated rows give one row.

    The blob's text comes from the row with the smallest path: names and
    numbers travel to find it, then each scanned text once, without a sort.
    Where every rule still wanted has marks, texts without any of them don't
    travel: their pairs enter the ledger without spans.
    """
    wanted = {r.kind: r.version for r in rules}
    named = versions.select(F.struct(*path_cols).alias("_path"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("blob", F.sha2("_text", 256))
    paths = scratch.cut(named.select("_path", "blob"), "paths")
    blobs = paths.groupBy("blob").agg(F.min("_path").alias("_path"))
    if ledger is None:
        todo = blobs.withColumn("_kinds", F.array(*[F.lit(k) for k in wanted]))
    else:
        current = ledger.where(F.col("kind").isin(*wanted)).where(F.expr("version = " + _version_case(wanted)))
        seen = current.groupBy("blob").agg(F.collect_set("kind").alias("_seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("_kinds", F.array_except(F.array(*[F.lit(k) for k in wanted]), F.coalesce("_seen", F.array().cast("array<string>")))).where(F.size("_kinds") > 0).drop("_seen")
    todo = scratch.cut(todo.select(F.col("blob").alias("_b"), F.col("_path").alias("_p"), "_kinds"), "todo")
    unseen = {r["kind"] for r in todo.select(F.explode("_kinds").alias("kind")).distinct().collect()}  # kinds: as many as rules at most
    due = [r for r in rules if r.kind in unseen]
    worth = _any([F.contains("_text", F.lit(m)) for r in due for m in r.marks]) if all(r.marks for r in due) else F.lit(True)
    texts = named.where(worth).join(todo.hint("shuffle_hash"), named["_path"].eqNullSafe(todo["_p"]) & (named["blob"] == todo["_b"]))
    nothing = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    found = [F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans(F.col("_text"), _fast(r)).alias("spans")) for r in due]
    scanned = texts.select("blob", F.filter(F.array(*found), lambda x: F.array_contains(F.col("_kinds"), x["kind"]) & (F.size(x["spans"]) > 0)).alias("_found")) if due else None
    hits = scratch.cut(scanned.select("blob", F.explode("_found").alias("x")).select("blob", "x.kind", "x.version", "x.spans").dropDuplicates(["blob", "kind"]), "hits") if due else None
    fresh = todo.select(F.col("_b").alias("blob"), F.explode("_kinds").alias("kind")).withColumn("version", F.expr(_version_case(wanted)))
    if due:
        fresh = fresh.join(hits.drop("version"), ["blob", "kind"], "left").select("blob", "kind", "version", F.coalesce("spans", nothing).alias("spans"))
    else:
        fresh = fresh.withColumn("spans", nothing)
    fresh = scratch.cut(fresh, "fresh")
    whole = fresh if ledger is None else ledger.unionByName(fresh)
    hits = (fresh if ledger is None else current.unionByName(fresh)).where(F.size("spans") > 0)
    by_blob = hits.groupBy(F.col("blob").alias("_b")).agg(F.map_from_entries(F.collect_list(F.struct("kind", "spans"))).alias("_map"))
    rows = paths.distinct().join(by_blob, F.col("blob") == F.col("_b"), "left")
    full = F.struct(*[F.coalesce(F.col("_map")[r.kind], nothing).alias(r.kind) for r in rules])
    return rows.select("_path.*", "blob", full.alias("found")), whole


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _version_case(wanted: dict[str, int]) -> str:
    return "case kind " + " ".join(f"when '{k}' then {v}" for k, v in wanted.items()) + " end"


def listing(found: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:stop of all spans by start, then kind in the rules' order, joined by commas."""
    def tagged(n: int, rule: Rule) -> Column:
        return F.transform(found[rule.kind], lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("n"), x["stop"].alias("stop"), F.lit(rule.kind).alias("kind")))

    merged = F.array_sort(F.concat(*[tagged(n, r) for n, r in enumerate(rules)]))
    return F.array_join(F.transform(merged, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
