"""Substring dedup against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import substrings as S
from tessera.llm.common import read


def brute(rows):
    raw = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in raw:
        for k in range(len(t) - 49):
            w = t[k : k + 50]
            first[w] = min(first.get(w, (2, 0)), (i is None, i or 0))
    out = []
    for i, t in raw:
        gone = np.zeros(len(t) + 2, bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < (i is None, i or 0):
                gone[k + 1 : k + 51] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        rest = bytes(b for b, g in zip(t, gone[1:-1], strict=True) if not g)
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(map(repr, out))


def rows_of(df):
    return sorted(repr(tuple(r)) for r in S.report(df).collect())


def test_documents(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(eval(w)[2] > 0 for w in want) > 10
    assert rows_of(docs) == want


def texts(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "abcdefgh é漢\n"
    pieces = ["".join(rng.choice(letters) for _ in range(rng.randrange(20, 120))) for _ in range(12)]
    pieces += ["a" * 70, "ab" * 40, "xyz" * 30, "\0" * 60]
    for _ in range(60):
        yield "".join(rng.choice(pieces)[rng.randrange(10) :] + rng.choice(["", "-", "é", " "]) for _ in range(rng.randrange(0, 6)))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, seed):
    rows = [(i - 30, t) for i, t in enumerate(texts(seed))]
    random.Random(seed).shuffle(rows)
    assert rows_of(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_odd_rows(spark):
    line = "The same sentence of more than fifty bytes stands in all of these."
    rows = [(1, line), (1, line), (2, line + " x"), (None, line), (None, line), (3, None), (4, ""), (5, line[:49]), (6, line[:50]), (7, "w" * 200_000), (8, "w" * 49), (9, "w" * 50), (-9, "x" + line)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, chunk int, bucket string")
    assert rows_of(df) == brute(rows)
    assert S.report(df.limit(0)).count() == 0
    kept = {r.doc_id: (r.kept, r.spans) for r in S.find(df.where("doc_id in (-9, 2)"), keep=True).collect()}
    assert kept[2] == (b" x", [0, len(line)]) and kept[-9][0] == ("x" + line).encode()


def test_index_family():
    rng = np.random.default_rng(0)
    family, first, at = S.IndexFamily(), {}, 0
    for size in [40, 1, 100, 30, 30, 200, 5, 60]:
        words = np.array([b"%050d" % x for x in rng.integers(0, 150, size)], "S50")
        owners = np.sort(rng.integers(at, at + 20, size)).astype(np.uint64)
        at += 15
        at = max(at, int(owners.max()))
        got = family.add(np.frombuffer(words.tobytes(), np.uint8), 50 * np.arange(size), owners)
        for w, o in zip(words.tolist(), owners.tolist(), strict=True):
            first[w] = min(first.get(w, o), o)
        assert got.tolist() == [first[w] < o for w, o in zip(words.tolist(), owners.tolist(), strict=True)]
        sizes = [len(level) for level, _ in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and sum(sizes) == len(first)


def test_many_batches(monkeypatch):
    """A bucket's answer does not depend on how it is cut into batches."""
    rng = random.Random(4)
    base = [bytes(rng.choice(b"ab") for _ in range(90)) for _ in range(30)]
    parts = []
    for c in range(4):
        own = sorted({b[rng.randrange(20) :][: 50 + rng.randrange(20)] for b in base})
        parts.append(S._pack(own, np.zeros(len(own), np.uint32), np.array([rng.randrange(10) for _ in own], np.uint64)))
    want = S.search_bucket(parts)
    monkeypatch.setattr(S, "BATCH", 50)
    assert S.search_bucket(parts) == want


def test_chunk_covers_every_window():
    rows = list(texts(2))
    chunk = S.Chunk(pa.table({"doc_id": pa.array(range(len(rows)), pa.int64()), "text": rows}), 6)
    seen = np.concatenate([np.arange(a, a + n) for a, n in zip(chunk.runs.start, chunk.runs.size, strict=True)])
    want = np.concatenate([np.arange(a, b - 49) for a, b in zip(chunk.offsets, chunk.offsets[1:], strict=False)])
    assert sorted(seen.tolist()) == want.tolist()


def test_run_family():
    """Runs that agree have one number, in however many batches they come; levels are geometric."""
    rng = random.Random(2)
    family, number = S.RunFamily(), {}
    for size in [40, 1, 100, 30, 300, 5, 60]:
        runs = [(rng.randrange(9), b"%060d" % rng.randrange(60)) for _ in range(size)]
        for run, n in zip(runs, family.add(runs).tolist(), strict=True):
            assert number.setdefault(run, n) == n
        sizes = [len(level) for level, _ in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and sum(sizes) == len(number) == len(set(number.values()))


def test_every_window_is_found_by_the_families(spark, monkeypatch):
    """Without what the families answer, no window that two chunks share is found; with it, all are."""
    docs = read(spark, "/root/testdata/sf0.001", "documents").collect()
    chunks, bits = 5, 6
    parts = [[d for d in docs if d.doc_id % chunks == c] for c in range(chunks)]
    made = [S.Chunk(pa.table({"doc_id": pa.array([d.doc_id for d in p], pa.int64()), "text": [d.text for d in p]}), bits) for p in parts]
    found = [c.contents(_all_shared(c)) for c in made]
    got = set()
    for b in range(64):
        spans = [np.searchsorted(f.bucket, [b, b + 1]).tolist() for f in found]
        bits_of = S.search_bucket([S._pack(f.texts[x:y], f.short[x:y], f.first[x:y]) for f, (x, y) in zip(found, spans, strict=True)])
        for f, (x, y), raw in zip(found, spans, bits_of, strict=True):
            n = [len(t) - 49 for t in f.texts[x:y]]
            flags = np.unpackbits(np.frombuffer(raw, np.uint8), count=sum(n)).astype(bool)
            places = [(int(f.first[x + i]) - 2**63, t[k : k + 50]) for i, t in enumerate(f.texts[x:y]) for k in range(n[i])]
            got |= {p for p, flag in zip(places, flags.tolist(), strict=True) if flag}
    owner, first = {}, {}
    for c, p in enumerate(parts):
        for d in p:
            raw = d.text.encode()
            for k in range(len(raw) - 49):
                w = raw[k : k + 50]
                first[w] = min(first.get(w, d.doc_id), d.doc_id)
                owner[c, w] = min(owner.get((c, w), d.doc_id), d.doc_id)
    cross = {(i, w) for (c, w), i in owner.items() if first[w] < i}
    assert len(cross) > 1000 and cross <= got and all(first[w] < i for i, w in got)


def _all_shared(chunk):
    masks = {}
    for b in np.unique(chunk.bucket).tolist():
        n = int((chunk.bucket == b).sum())
        masks[b] = np.packbits(np.concatenate([np.ones(n, bool), np.zeros(n, bool)])).tobytes()
    return masks


@pytest.mark.parametrize("seed,limit", [(1, "HOT_CHUNKS"), (2, "HOT_CHUNKS"), (1, "HOT_RUNS"), (2, "HOT_RUNS")])
def test_hot_anchors_are_dealt_as_windows(spark, monkeypatch, seed, limit):
    rows = [(i - 30, t) for i, t in enumerate(texts(seed))]
    monkeypatch.setattr(S, limit, 1)
    assert rows_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_very_many_rows_alike(spark, monkeypatch):
    """Rows alike in id and text are one until the end, each with a row of its own there."""
    line = "The same sentence of more than fifty bytes stands in all of these."
    rows = [(1, line)] * 100 + [(2, line + " x")] * 70 + [(3, "x" + line), (None, line)] + [(None, None)] * 80
    monkeypatch.setattr("tessera.llm.common.COPIES", 16)
    assert rows_of(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
