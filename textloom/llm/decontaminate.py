"""Benchmark decontamination: latent semantic retrieval, then subsequence and answer checks."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

STORE = 400_000
CHUNK_TOKENS = 400_000
_NOT_WORD = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


@dataclass(frozen=True)
class Settings:
    window: int = 32  # words of a passage
    step: int = 16  # words from one passage searched to the next
    rank: int = 64  # dimensions of the latent space
    common: float = 0.01  # terms in more of the passages than this share say nothing,
    seldom: int = 20  # unless that many passages have them at most,
    telling: float = 0.25  # or unless fewer than this share of an item's words would be left
    seed: int = 8  # words in a row of an item that make a candidate whatever their weights
    cosine: float = 0.6  # least cosine of a candidate
    subsequence: float = 0.75  # least share of an item's words, in order, that settles it
    paraphrase: float = 0.55  # least share if the answer is there too
    answer: float = 0.8  # least share of the answer's words, in order
    block: int = 2000  # benchmark items searched at a time
    spare: int = 8  # dimensions that the sketch has besides, before the truncation
    least: float = 1e-3  # share of the largest singular value under which a dimension goes
    vocabulary_bytes: int = 256_000_000  # of the benchmark's terms, which are broadcast; more is an error


class Terms(dict):
    """The number of each written word's term, -1 where the benchmark lacks it, -2 where it has no letter or digit."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: bytes) -> int:
        if len(self) >= STORE:
            self.clear()
        term = plain(word)
        value = self.numbers.get(term, -1) if term else -2
        if len(word) <= 64:
            self[word] = value
        return value


def plain(word: bytes) -> str:
    return _NOT_WORD.sub("", word.decode("utf-8", "replace").lower())


def terms_of(text: str | None) -> list[str]:
    return [t for t in map(plain, (text or "").encode().split()) if t]


def answer_of(text: str | None) -> list[str]:
    """The words of a text's last sentence or line that has any."""
    return next((t for t in map(terms_of, reversed(_SENTENCE.split(text or ""))) if t), [])


def common_subsequence(first: np.ndarray, second: np.ndarray) -> int:
    """Length of the longest common subsequence, a word of bits a step."""
    places: dict[int, int] = {}
    for k, x in enumerate(first.tolist()):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(first)) - 1
    v = full
    for y in second.tolist():
        u = v & places.get(y, 0)
        if u:
            v = (v + u | v - u) & full
    return len(first) - v.bit_count()


def term_numbers(docs: DataFrame, numbers) -> DataFrame:
    """doc_id and the term numbers of each row's words, -1 for words that the benchmark lacks."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(numbers.value)
        for batch in batches:
            rows, ends = [], [0]
            for text in batch.column(1).to_pylist():
                ws = text.split()
                ids = np.fromiter(map(known.__getitem__, ws), np.int32, len(ws))
                rows.append(ids[ids > -2])
                ends.append(ends[-1] + len(rows[-1]))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "terms"])

    return docs.mapInArrow(run, f"doc_id {kind}, terms array<int>")


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, starts, terms) of as many rows at a time as have about CHUNK_TOKENS terms."""
    lists = batch.column(batch.schema.get_field_index("terms"))
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    low = 0
    while low < len(lists):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK_TOKENS, side="right")) - 1)
        high = min(high, len(lists))
        yield low, offsets[low : high + 1] - offsets[low], values[offsets[low] : offsets[high]]
        low = high


def _blocks(starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block of each term, first block of each row) where rows are cut into blocks of size terms."""
    n = np.diff(starts)
    blocks = -(-n // size)
    first = np.concatenate([[0], np.cumsum(blocks)])
    inside = np.arange(starts[-1]) - np.repeat(starts[:-1], n)
    return np.repeat(first[:-1], n) + inside // size, first


def passage_counts(rows: DataFrame, n_terms: int, window: int) -> DataFrame:
    """term and the number of passages with it; term -1: all passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms + 1, np.int64)
        for batch in batches:
            for _, starts, terms in _chunks(batch):
                block, first = _blocks(starts, window)
                there = terms >= 0
                pairs = np.sort(block[there] * np.int64(n_terms) + terms[there], kind="stable")
                new = np.concatenate([[True], pairs[1:] != pairs[:-1]])[: len(pairs)]
                total[:-1] += np.bincount(pairs[new] % n_terms, minlength=n_terms)
                total[-1] += first[-1]
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(term == n_terms, -1, term).astype(np.int32)), pa.array(total[term])], names=["term", "n"])

    return rows.select("terms").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _vectors(block: np.ndarray, terms: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, term, weight) of the blocks' TF-IDF entries, each block's of length 1."""
    n = len(weight)
    use = terms >= 0
    use[use] = weight[terms[use]] > 0
    pairs, tf = np.unique(block[use] * np.int64(n) + terms[use], return_counts=True)
    b, t = pairs // n, pairs % n
    w = tf * weight[t]
    if len(b):
        new = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        norm = np.sqrt(np.add.reduceat(w * w, new))
        w = w / np.repeat(norm, np.diff(np.concatenate([new, [len(b)]])))
    return b, t, w


def _times(b: np.ndarray, t: np.ndarray, w: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(blocks with entries, their rows of A @ right)."""
    if not len(b):
        return b, np.zeros((0, right.shape[1]), right.dtype)
    new = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    return b[new], np.add.reduceat(right[t] * w[:, None].astype(right.dtype), new)


def _gram(b: np.ndarray, t: np.ndarray, w: np.ndarray, right: np.ndarray, out: np.ndarray) -> None:
    """Adds A' (A right) to out."""
    if not len(b):
        return
    there, rows = _times(b, t, w, right)
    each = rows[np.searchsorted(there, b)] * w[:, None].astype(right.dtype)
    order = np.argsort(t, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], t[order][1:] != t[order][:-1]]))
    out[t[order][new]] += np.add.reduceat(each[order], new)


def sketch(rows: DataFrame, weight, test, window: int) -> DataFrame:
    """term and v: the rows of A' (A test) for the passages' TF-IDF matrix A of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, right = weight.value, test.value
        out = np.zeros(right.shape, np.float64)
        for batch in batches:
            for _, starts, terms in _chunks(batch):
                _gram(*_vectors(_blocks(starts, window)[0], terms, w), right, out)
        term = np.flatnonzero(out.any(axis=1)).astype(np.int32)
        flat = pa.array(out[term].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.ListArray.from_arrays(pa.array(np.arange(len(term) + 1, dtype=np.int32) * right.shape[1]), flat)], names=["term", "v"])

    parts = rows.select("terms").mapInArrow(run, "term int, v array<double>")
    rank = test.value.shape[1]
    return parts.groupBy("term").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(rank)]).alias("v"))


def latent_basis(rows: DataFrame, own: Callable[[], Iterable[list[np.ndarray]]], weight: np.ndarray, passages: int, s: Settings) -> np.ndarray:
    """The right singular vectors of the TF-IDF matrix A by a randomised SVD in one pass over all documents.

    The matrix has the passages of rows and the items of own() (blocks of term
    arrays), both weighing as much. One pass takes A'A times an orthonormal
    test matrix of s.rank + s.spare columns; the Nystrom form of that product,
    shifted a little so that it is surely positive, gives the singular values
    and vectors of A, of which the s.rank largest stay, less those under
    s.least of the first. What comes to the driver is bounded by terms x
    dimensions.
    """
    spark = rows.sparkSession
    n = len(weight)
    width = min(s.rank + s.spare, n)
    test = np.linalg.qr(np.random.default_rng(7).standard_normal((n, width)))[0].astype(np.float32)
    mine, items = np.zeros((n, width)), 0
    for xs in own():
        _gram(*_vectors(np.repeat(np.arange(len(xs)), [len(x) for x in xs]), np.concatenate(xs), weight), test, mine)
        items += len(xs)
    y = mine / max(items, 1)
    sent = [spark.sparkContext.broadcast(weight), spark.sparkContext.broadcast(test)]
    for r in sketch(rows, *sent, s.window).repartition(1).toLocalIterator():
        y[r["term"]] += np.array(r["v"]) / passages
    for x in sent:
        x.destroy()
    wide = test.astype(np.float64)
    shift = 1e-6 * max(np.linalg.norm(y), 1e-30)  # above what single precision leaves
    y += shift * wide
    core = wide.T @ y
    root = np.linalg.cholesky((core + core.T) / 2)
    vectors, singular, _ = np.linalg.svd(np.linalg.solve(root, y.T).T, full_matrices=False)
    singular = np.sqrt(np.maximum(singular**2 - shift, 0.0))[: s.rank]
    return vectors[:, : s.rank][:, singular >= s.least * singular[0]].astype(np.float32)


def benchmark_terms(items: DataFrame, limit: int) -> dict[str, int]:
    """The number of each term of all items; an error if they have more than limit bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {t for text in batch.column(0).to_pylist() for t in terms_of(text)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["term"])

    terms = items.select("text").mapInArrow(run, "term string").distinct()
    held = terms.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    if held > limit:
        raise ValueError(f"the benchmark's terms take {held} bytes to broadcast, more than vocabulary_bytes: search it in parts")
    return {r["term"]: k for k, r in enumerate(terms.repartition(1).sortWithinPartitions("term").toLocalIterator())}


@dataclass
class Model:
    """What a search needs: weights, the latent basis, and the items' terms, answers and latent rows."""

    weight: np.ndarray
    basis: np.ndarray
    items: list[np.ndarray]
    answers: list[np.ndarray]
    latent: np.ndarray
    settings: Settings = field(default_factory=Settings)
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(init=False)

    def __post_init__(self):
        self.seeds = seeds_of(self.items, self.settings.seed)


def term_weights(df: np.ndarray, passages: int, items: Iterable[np.ndarray], s: Settings) -> np.ndarray:
    """Each term's inverse document frequency; 0 if it is common, unless an item would be left without telling words.

    Such items have enough words in the corpus to be found there, but fewer
    than s.telling of their words are seldom ones; all their terms then count
    as just not common. So do terms that no passage has, or they would outweigh
    an item's others.
    """
    limit = max(s.common * passages, s.seldom)
    just = min(limit, passages)
    idf = np.log((1.0 + passages) / (1.0 + np.where(df > 0, np.minimum(df, just), just))) + 1.0
    here, common = df > 0, df > limit
    lift = np.zeros(len(df), bool)
    for x in items:
        if here[x].mean() >= s.paraphrase and (here & ~common)[x].mean() < s.telling:
            lift[x] = True
    return np.where(common & ~lift, 0.0, idf)


def _grams(terms: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the size terms from each place on."""
    factors = np.random.default_rng(11).integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out += (terms[at + k].astype(np.uint64) + np.uint64(1)) * factors[k]
    return out


def seeds_of(items: list[np.ndarray], size: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: (hashes in order, item, offset) of all runs of size terms of the items, shorter items whole."""
    by: dict[int, list] = {}
    for k, x in enumerate(items):
        n = min(size, len(x))
        at = np.arange(len(x) - n + 1)
        by.setdefault(n, []).append((_grams(x, at, n), np.full(len(at), k), at))
    out = {}
    for n, parts in by.items():
        hashes, item, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(hashes, kind="stable")
        out[n] = hashes[order], item[order], offset[order]
    return out


def _seed_hits(seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], starts: np.ndarray, terms: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, where the item would begin, place of the run) for each run of terms that an item has too."""
    foreign = np.concatenate([[0], np.cumsum(terms < 0)])
    for n, (hashes, item, offset) in seeds.items():
        if len(terms) < n:
            continue
        whole = np.flatnonzero(foreign[n:] == foreign[:-n])
        row = np.searchsorted(starts, whole, side="right") - 1
        inside = whole + n <= starts[row + 1]
        whole, row = whole[inside], row[inside]
        made = _grams(terms, whole, n)
        low, high = np.searchsorted(hashes, made, side="left"), np.searchsorted(hashes, made, side="right")
        for k in np.flatnonzero(high > low).tolist():
            for j in range(int(low[k]), int(high[k])):
                yield int(row[k]), int(item[j]), int(whole[k] - offset[j]), int(whole[k])


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.maximum(norm, 1e-30)


def search(rows: DataFrame, model) -> DataFrame:
    """doc_id, item (number), cosine, shared, answer of each document and item that the checks agree on."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        s = m.settings
        bags = [Counter(x.tolist()) for x in m.items]
        for batch in batches:
            keys, found = [], []
            for low, starts, terms in _chunks(batch):
                if not len(terms):
                    continue
                half, first = _blocks(starts, s.step)
                b, z = _times(*_entries(half, terms, m.weight), m.basis)
                full = np.zeros((first[-1] + 1, z.shape[1]), z.dtype)
                full[b] = z
                left = np.repeat(first[1:], np.diff(first)) - np.arange(first[-1])  # blocks of the row from here on
                passage = full[:-1].copy()
                for k in range(1, s.window // s.step):
                    passage[left > k] += full[np.flatnonzero(left > k) + k]
                live = np.flatnonzero(passage.any(axis=1))
                best: dict[tuple[int, int], tuple] = {}

                def check(row, item, start, length, cos):
                    words = m.items[item]
                    reach = len(words) // 2
                    region = terms[max(starts[row], start - reach) : min(starts[row + 1], start + length + reach)]  # noqa: B023
                    # No subsequence is longer than the item's words that occur there at all.
                    if sum(map(bags[item].__getitem__, bags[item].keys() & region.tolist())) < s.paraphrase * len(words):
                        return
                    shared = common_subsequence(words, region) / len(words)
                    if shared < s.paraphrase:
                        return
                    tail = m.answers[item]
                    answer = common_subsequence(tail, region) / len(tail)
                    if shared >= s.subsequence or answer >= s.answer:
                        value = (shared, cos, answer)
                        best[low + row, item] = max(best.get((low + row, item), value), value)  # noqa: B023

                for at in range(0, len(live), 8192):
                    part = live[at : at + 8192]
                    cosine = _unit(passage[part]) @ m.latent.T
                    p, item_no = np.nonzero(cosine >= s.cosine)
                    row_no = np.searchsorted(first, part[p], side="right") - 1
                    start_no = starts[row_no] + (part[p] - first[row_no]) * s.step
                    for cos, item, row, start in zip(cosine[p, item_no].tolist(), item_no.tolist(), row_no.tolist(), start_no.tolist(), strict=True):
                        check(row, item, start, s.window, cos)
                seen = set()
                for row, item, start, place in _seed_hits(m.seeds, starts, terms):
                    if (row, item, start) not in seen:
                        seen.add((row, item, start))
                        there = passage[first[row] + (place - starts[row]) // s.step]
                        check(row, item, start, len(m.items[item]), float((_unit(there[None, :]) @ m.latent[item])[0]))
                for (row, item), value in best.items():
                    keys.append(row)
                    found.append((item, *value))
            columns = list(zip(*found, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keys, pa.int64())), pa.array(columns[0], pa.int32()), pa.array(columns[2], pa.float64()), pa.array(columns[1], pa.float64()), pa.array(columns[3], pa.float64())], names=["doc_id", "item", "cosine", "shared", "answer"]
            )

    return rows.select("doc_id", "terms").mapInArrow(run, f"doc_id {kind}, item int, cosine double, shared double, answer double")


def _entries(block: np.ndarray, terms: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, term, weight) of every term that says something, in order."""
    use = terms >= 0
    use[use] = weight[terms[use]] > 0
    return block[use], terms[use], weight[terms[use]]


def find_leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id, item_id, cosine, shared, answer: the documents that hold benchmark items, verbatim or as a paraphrase.

    Passages are windows of a document's words, over the terms of the
    benchmark. Their TF-IDF matrix is never built: a randomised SVD takes its
    product in one pass over all documents' terms, the benchmark's own rows
    weighing as much as the corpus, and the right singular vectors are the
    latent space. Terms are counted over different texts, so copies make none
    common. Each passage whose cosine with an item reaches the limit, or that
    has settings.seed words of it in a row (a shorter item: all), whatever
    their weights, is held against it: the longest common subsequence of words,
    and for paraphrases that of the item's last sentence.

    Null and blank texts and items without a term match nothing; rows that
    repeat an id give their rows once; rows with a null id are searched and
    returned like others. Other columns are ignored. Terms, weights and basis
    are those of all items, so what is found doesn't depend on a block; items
    are held against the corpus in blocks of settings.block, which bounds what
    is broadcast besides the terms, whose bytes are checked. Words that no item
    has don't leave the first pass.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).distinct()
    items = scratch.cut(items.repartition(1).sortWithinPartitions("item_id", "text"), "items")
    kinds = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}"
    vocabulary = benchmark_terms(items, settings.vocabulary_bytes)
    if not vocabulary:
        return spark.createDataFrame([], f"{kinds}, cosine double, shared double, answer double")
    number = lambda ts: np.array([vocabulary[t] for t in ts], np.int32)

    def blocks() -> Iterator[list]:
        """Rows of items that have a term, settings.block at a time."""
        stream = (r for r in items.toLocalIterator() if terms_of(r["text"]))
        while batch := list(itertools.islice(stream, settings.block)):
            yield batch

    def own() -> Iterator[list[np.ndarray]]:
        for batch in blocks():
            yield [number(terms_of(r["text"])) for r in batch]

    sent = spark.sparkContext.broadcast(vocabulary)
    rows = scratch.cut(term_numbers(source, sent), "terms")
    sent.destroy()
    n = len(vocabulary)
    df, passages = np.zeros(n), 1
    for r in passage_counts(rows.select("terms").distinct(), n, settings.window).repartition(1).toLocalIterator():
        if r["term"] < 0:
            passages = r["n"]
        else:
            df[r["term"]] = r["n"]
    weight = term_weights(df, passages, itertools.chain.from_iterable(own()), settings)
    basis = latent_basis(rows, own, weight, passages, settings)
    found = None
    for batch in blocks():
        terms = [number(terms_of(r["text"])) for r in batch]
        there, z = _times(*_vectors(np.repeat(np.arange(len(terms)), [len(x) for x in terms]), np.concatenate(terms), weight), basis)
        latent = np.zeros((len(terms), basis.shape[1]), np.float32)
        latent[there] = _unit(z)
        model = spark.sparkContext.broadcast(Model(weight, basis, terms, [number(answer_of(r["text"])) for r in batch], latent, settings))
        hits = search(rows, model)
        names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(batch)], f"_item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        named = hits.join(names, hits["item"] == names["_item"]).groupBy("doc_id", "item_id").agg(F.max(F.struct("shared", "cosine", "answer")).alias("_best"))
        part = scratch.cut(named.select("doc_id", "item_id", "_best.cosine", "_best.shared", "_best.answer"), "leaks")
        model.destroy()
        found = part if found is None else found.union(part)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the documents that find_leaks() finds."""
    with Scratch(docs.sparkSession) as scratch:
        bad = scratch.keep(find_leaks(docs, benchmark, scratch, id_col=id_col, **options).select(F.col("doc_id").alias("_bad")).distinct())
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad"]), "left_anti")
