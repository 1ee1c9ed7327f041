"""Plain versions of the operators, over Python lists: (doc_id, text) rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np


def split(text):
    return (text or "").encode().split()


def shingle_sets(rows, size=5):
    out = {}
    for d, text in rows:
        ws = [w.decode() for w in (text or "").encode().lower().split()]
        out[d] = {tuple(ws)} if 0 < len(ws) < size else {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)}
    return out


def near_components(rows):
    """{doc_id: (n, component)} by comparing every pair of sets with a common shingle."""
    sets = shingle_sets(rows)
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    common = Counter()
    for ds in by.values():
        if len(ds) < 2:
            continue
        ds = sorted(ds)
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                common[a, b] += 1
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def repeats(rows, window=50):
    """{doc_id: (n_words, n_removed, sha of the kept words)}."""
    first = {}
    words = {d: split(t) for d, t in rows}
    for d in sorted(words):
        ws = words[d]
        for i in range(len(ws) - window + 1):
            first.setdefault(hashlib.md5(b" ".join(ws[i : i + window])).digest(), d)
    out = {}
    for d, ws in words.items():
        gone = bytearray(len(ws))
        for i in range(len(ws) - window + 1):
            if first[hashlib.md5(b" ".join(ws[i : i + window])).digest()] < d:
                gone[i : i + window] = b"\x01" * window
        kept = b" ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out[d] = (len(ws), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def check_packing(rows, placed, encode, size=2048):
    """Every piece is right and every sequence is gapless; returns (sequences, least possible by tokens)."""
    by = defaultdict(list)
    for r in placed:
        by[r["doc_id"]].append(r)
    total = 0
    for d, text in rows:
        ids = np.array([*encode(text or ""), 0], "<u4")
        total += len(ids)
        at = 0
        for k, p in enumerate(sorted(by[d], key=lambda p: p["piece"])):
            assert (p["piece"], p["start"]) == (k, at)
            assert p["length"] == size or k == 0
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in placed:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences), -(-total // size)


def leaks(rows, items, s):
    """{(doc_id, item_id)} by holding every passage of every document against every item, without any retrieval."""
    from textloom.llm import decontaminate as d

    found = set()
    wanted = {i: (d.terms_of(t), d.answer_of(t)) for i, t in items if d.terms_of(t)}
    numbers = {w: k for k, w in enumerate(sorted({w for ws, _ in wanted.values() for w in ws}))}
    coded = {i: [np.array([numbers[w] for w in x]) for x in pair] for i, pair in wanted.items()}
    bags = {i: Counter(x.tolist()) for i, (x, _) in coded.items()}
    for doc, text in rows:
        ids = np.array([numbers.get(w, -1) for w in d.terms_of(text)], np.int64)
        for i, (item, answer) in coded.items():
            reach = len(item) // 2
            for at in range(0, len(ids), s.step):
                region = ids[max(0, at - reach) : at + s.window + reach]
                if sum((bags[i] & Counter(region.tolist())).values()) < s.paraphrase * len(item):
                    continue
                shared = d.common_subsequence(item, region) / len(item)
                if shared >= s.subsequence or (shared >= s.paraphrase and d.common_subsequence(answer, region) / len(answer) >= s.answer):
                    found.add((doc, i))
                    break
    return found
