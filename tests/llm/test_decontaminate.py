"""The FM-index and the verdicts against brute force."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import decontaminate as D
from tessera.llm.common import read

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, items, window=13):
    phrases = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[k : k + window]), set()).add("" if i is None else str(i))
    lengths = {len(p) for p in phrases}
    out = []
    for doc, t in rows:
        w, hit, own = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in phrases:
                    hit.update(range(k, k + n))
                    own |= phrases[p]
        sha = hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(own), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def rows_of(frame):
    return sorted(map(repr, ((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in frame.collect())))


def test_documents(spark):
    docs, items = read(spark, SF, "documents"), read(spark, SF, "benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sum(w[-1] for w in want) > 5
    assert rows_of(D.report(docs, items)) == sorted(map(repr, want))
    assert rows_of(D.judge(D.find(docs, items, block_bytes=2000))) == sorted(map(repr, want))  # in many blocks
    assert D.keep_clean(docs, items).columns == docs.columns and D.keep_clean(docs, items).count() == sum(not w[-1] for w in want)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40))
    items = [(1, long), (None, "Short one!"), (2, None), (3, " ,. "), (1, "other text"), (10, "é漢"), (2, "x")]
    rows = [(1, long.upper()), (2, None), (3, ""), (4, "a short-ONE b"), (5, "x"), (5, "x"), (None, "É漢 é漢 é漢"), (6, "other\ntext, short"), (7, "one " * 90_000 + "x"), (8, "w0 " + long[:60] + " x"), (9, long + " " + long)]
    docs = spark.createDataFrame([(*r, 3, []) for r in rows], "doc_id long, text string, n_hit int, spans array<int>")
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    assert rows_of(D.report(docs, bench)) == sorted(map(repr, brute(rows, items)))
    assert rows_of(D.report(docs, bench.limit(0))) == sorted(map(repr, brute(rows, [])))
    assert D.report(docs.limit(0), bench).count() == 0


class Sent:
    """A broadcast value, as a task sees it."""

    def __init__(self, value):
        self.value = value


@settings(max_examples=80, deadline=None, derandomize=True)
@given(st.lists(st.text("abc ", max_size=30), max_size=6), st.lists(st.text("abc ", min_size=1, max_size=12), max_size=5))
def test_random_texts(texts, items):
    p = D.Phrases(list(map(tuple, zip(map(str, range(len(items))), items, strict=True))), 3)
    out = list(D._search([Sent(p)], [])(iter([D.pa.RecordBatch.from_arrays([D.pa.array(range(len(texts)), D.pa.int64()), D.pa.array(texts, D.pa.string())], names=["doc_id", "text"])])))
    got = [(r["doc_id"], r["n_words"], sum(b - a for a, b in r["spans"]), len(r["items"])) for b in out for r in b.to_pylist()]
    assert got == [w[:4] for w in brute(list(enumerate(texts)), list(enumerate(items)), 3)]


def test_index():
    rng = np.random.default_rng(3)
    for n in (1, 5, 200):
        text = rng.integers(0, 4, n)
        index = D.Index(text)
        phrases = rng.integers(1, 6, (30, 3))
        low, high = index.search(phrases, np.full(30, 3))
        for p, a, b in zip(phrases.tolist(), low, high, strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(n - 2) if text[i : i + 3].tolist() == p]


def test_cut():
    assert D.cut("A b, C-d é f.", [[1, 3], [4, 5]]) == "A -d  f."


def test_clean_stage_on_odd_rows(spark):
    """Nulls, repeated rows and clashing names; a row without words is clean, and each of several rows alike is judged."""
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, 1, "a"), (1, long, 1, "a"), (2, None, 2, None), (2, None, 2, None), (3, "", 3, "b"), (None, "clean text", 4, "c"), (None, long, 5, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_hit int, spans string")
    bench = spark.createDataFrame([(1, long), (1, long), (None, None)], "item_id long, text string")
    kept = D.keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, rows[2:6]))
    assert D.keep_clean(docs.limit(0), bench).count() == 0 and D.keep_clean(docs, bench.limit(0)).count() == len(rows)


def test_spans_are_cut(spark):
    docs, items = (read(spark, SF, t) for t in ("documents", "benchmark"))
    found = {r.doc_id: r for r in D.find(docs, items).collect()}
    got = {r.doc_id: r.text for r in D.without_spans(docs, items).collect()}
    assert len(got) == len(found) and sum(bool(r.spans) for r in found.values()) > 5
    for i, r in found.items():
        assert got[i] == (D.cut(r.text, r.spans) if r.spans else r.text)
        assert len(D.split(got[i].encode())) == r.n_words - sum(b - a for a, b in r.spans)
