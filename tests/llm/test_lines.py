"""Line dedup against brute force."""

import random
import re

import pytest

from tessera.llm import lines as L
from tessera.llm.common import read

FULL = re.compile(r"[^\x20\x09-\x0D]")


def brute(rows, depth=3):
    """Rows of (doc_id, text), in the order in which they count as earlier."""
    seen, out, alike = set(), [], set()
    for doc, text in rows:
        lines = (text or "").split("\n")
        full = [i for i, x in enumerate(lines) if FULL.search(x)]
        if (doc, text) in alike and len(full) >= depth:
            gone = set(range(len(full)))
        else:
            gone = set()
            for p in range(len(full) - depth + 1):
                w = tuple(lines[i] for i in full[p : p + depth])
                if w in seen:
                    gone.update(range(p, p + depth))
                seen.add(w)
        alike.add((doc, text))
        drop = {full[p] for p in gone}
        kept = text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in drop)
        out.append((doc, kept, len(full), len(gone), sum(p - 1 not in gone for p in gone)))
    return sorted(map(repr, out))


def rows_of(df, depth=3):
    return sorted(repr(tuple(r)) for r in L.dedup(df, depth).collect())


def test_documents(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    want = brute([(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()])
    assert rows_of(docs) == want
    assert sum(eval(w)[3] for w in want) > 100


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 5, 8])
def test_depths(spark, depth):
    rng = random.Random(depth)
    rows = [(i, "\n".join(rng.choice("abcd ") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 30)))) for i in range(40)]
    rows.append((40, "\n".join("xyz"[k % 3] for k in range(50))))
    assert rows_of(spark.createDataFrame(rows, "doc_id long, text string"), depth) == brute(rows, depth)


def test_odd_rows(spark):
    a, b = "one\ntwo\nthree\nfour", "\n\none\n \ntwo\n\nthree\n"
    rows = [(1, a), (1, a), (1, a), (2, b), (3, None), (4, ""), (5, "\n\n"), (6, "x\nx"), (6, "x\nx"), (7, "é\r\nü\n\tz\n" * 2), (8, "line\n" * 20_000), (9, "w " * 200_000 + "\n" + a), (None, a)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, rank string, pos int")
    assert rows_of(df) == brute(rows)
    assert L.dedup(df.limit(0)).count() == 0


def test_ranks_keep_the_order(spark):
    """Ranks sort suffixes as their sequences of line ids do."""
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    ids = {(r.row_a, r.row_b, r.pos): (r.id_a, r.id_b) for r in L.sequences(docs).collect()}
    found = sorted((r.rank, [ids[r.row_a, r.row_b, r.pos + k] for k in range(3)]) for r in L.suffixes(docs).collect())
    assert len(found) > 20 and [w for _, w in found] == sorted(w for _, w in found)


def test_plan_is_native(spark):
    plan = L.report(read(spark, "/root/testdata/sf0.001", "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def suffix_order(texts):
    """Naive suffix array of (row_a, row_b, ids of lines) in document order: (text, pos, lines shared with the suffix before) of the suffixes whose first line another has."""
    times = {}
    for t in texts:
        for i in t:
            times[i] = times.get(i, 0) + 1
    # the end of a text, then shared lines by id, then each line that is alone
    key = lambda s, p: [(1, *i) if times[i] > 1 else (2, s, p + k) for k, i in enumerate(texts[s][p:])]
    every = sorted((key(s, p), s, p) for s, t in enumerate(texts) for p in range(len(t)) if times[t[p]] > 1)
    out, before = [], []
    for k, s, p in every:
        n = 0
        while n < min(len(k), len(before)) and k[n] == before[n] and k[n][0] == 1:
            n += 1
        out.append((s, p, n))
        before = k
    return out


def array_of(spark, docs):
    array, order = L.suffix_array(docs)
    place = {r.seq: i for i, r in enumerate(order.orderBy("seq").collect())}
    keys = [(r.row_a, r.row_b) for r in order.orderBy("seq").collect()]
    ids = {k: [] for k in keys}
    for r in L.sequences(docs).orderBy("pos").collect():
        ids[r.row_a, r.row_b].append((r.id_a, r.id_b))
    return [(place[r.seq], r.pos, r.lcp) for r in array.orderBy("range", "path", "seq", "pos").collect()], [ids[k] for k in keys]


@pytest.mark.parametrize("seed", range(3))
def test_suffix_array_and_common_prefixes(spark, seed):
    """Order and common prefixes of all lengths, against a naive suffix array."""
    rng = random.Random(seed)
    pieces = [[rng.choice("abcdefg") for _ in range(rng.randrange(1, 30))] for _ in range(6)]
    rows = [(i, "\n".join(x for _ in range(rng.randrange(4)) for x in rng.choice(pieces)[rng.randrange(5) :] + [f"own {rng.random()}"] * rng.randrange(2))) for i in range(30)]
    rows += [(90, "\n".join("xyz"[k % 3] for k in range(200))), (91, "x\n" * 150), (92, "x\n" * 90), (93, None), (94, "")]
    got, texts = array_of(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    want = suffix_order(texts)
    assert got == want and max(n for *_, n in want) >= 89


def test_suffix_array_of_documents(spark):
    got, texts = array_of(spark, read(spark, "/root/testdata/sf0.001", "documents"))
    assert got == suffix_order(texts) and max(n for *_, n in got) > 3


def by_words(rows, depth=3, words=50):
    """Brute force of the rule with words: every run of up to ``depth`` lines that an earlier place has."""
    seen, out = set(), []
    for doc, text in rows:
        lines = (text or "").split("\n")
        full = [i for i, x in enumerate(lines) if FULL.search(x)]
        gone = set()
        for p in range(len(full)):
            for t in range(1, min(depth, len(full) - p) + 1):
                w = tuple(lines[i] for i in full[p : p + t])
                if w in seen and (t == depth or sum(len(x.split()) for x in w) >= words):
                    gone.update(range(p, p + t))
                seen.add(w)
        drop = {full[p] for p in gone}
        out.append((doc, text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in drop), len(full), len(gone), sum(p - 1 not in gone for p in gone)))
    return sorted(map(repr, out))


def test_long_lines_are_runs_by_their_words(spark):
    """A passage of fifty words or more goes wherever it repeats, be it one line; shorter ones need three."""
    long, half = "word " * 49 + "end", "some " * 25 + "."
    rows = [(1, f"{long}\na\nb"), (2, f"x\n{long}\ny"), (3, f"{half}\n{half} too"), (4, f"q\n{half}\n\n{half} too\nr"), (5, half), (6, long), (7, long), (7, long), (7, long + " \na"), (8, "a\nb"), (9, f"{half}\nz"), (None, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(repr(tuple(r)) for r in L.dedup(df, 3, 50).collect()) == by_words(rows)
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    want = by_words([(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()])
    assert sorted(repr(tuple(r)) for r in L.dedup(docs, 3, 50).collect()) == want


def test_many_alike_rows(spark, monkeypatch):
    """Copies of a row are made in pieces."""
    monkeypatch.setattr("tessera.llm.common.COPIES", 4)
    df = spark.createDataFrame([(1, "a\nb\nc")] * 11 + [(2, "a\nb\nc")] * 9, "doc_id long, text string")
    got = [tuple(r) for r in L.dedup(df).collect()]
    assert sorted(got) == [(1, "", 3, 3, 1)] * 10 + [(1, "a\nb\nc", 3, 0, 0)] + [(2, "", 3, 3, 1)] * 9
