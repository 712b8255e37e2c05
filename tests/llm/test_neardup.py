"""Near duplicates against all pairs of full sets."""

import itertools
import random
import re

import numpy as np
import pytest

from tessera.llm import neardup as N
from tessera.llm.common import read
from tessera.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    done = set()
    for members in by.values():
        for a, b in itertools.combinations(members, 2):
            if (a, b) not in done:
                done.add((a, b))
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[max(top(a), top(b))] = min(top(a), top(b))
    ids = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[top(i)] = min(ids.get(top(i), doc), doc)
    return sorted(repr((doc, len(sets[i]), c := ids.get(top(i)), doc == c)) for i, (doc, _) in enumerate(rows))


def rows_of(frame):
    return sorted(repr(tuple(r)) for r in frame.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_documents(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(N.link(docs)) == want
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(eval(w)[0] for w in want if eval(w)[3])


def variants(seed, n_groups=12, size=14, words=120):
    """Groups of texts around the limit, some of which hang together by chains only."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    out = []
    for _ in range(n_groups):
        text = [word() for _ in range(words)]
        for _ in range(size):
            if rng.random() < 0.5:
                text = list(text)
                for _ in range(rng.randrange(1, 4)):
                    text[rng.randrange(words)] = word()
                out.append(" ".join(text))
            else:
                other = list(text)
                for _ in range(rng.randrange(0, 6)):
                    other[rng.randrange(words)] = word()
                out.append(" ".join(other))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("nodes,shingles", [(4096, 2_000_000), (5, 600)])
def test_groups_around_the_limit(spark, monkeypatch, nodes, shingles):
    monkeypatch.setattr(N, "BLOCK_NODES", nodes)
    monkeypatch.setattr(N, "BLOCK_SHINGLES", shingles)
    rows = list(enumerate(variants(nodes)))
    assert rows_of(N.link(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_large_groups_are_dealt_once(spark):
    """Rows of a large group go to one block each, but for the few that go to all; only what is left meets all the others."""
    nodes, blocks = 4000, 40
    members = spark.range(nodes).selectExpr("0 as band", "7L as key", "cast(cast(id as string) as binary) as node", "id", f"{blocks}L as chunks")
    own = N._own_blocks(members)
    assert own.select("node").distinct().count() == nodes and own.count() <= 1.2 * nodes and own.where("i != j").isEmpty()
    roots = members.selectExpr("node", "if(id < 3, id, 100L) as root").where("id != 4")
    one = N._other_blocks(members, members.selectExpr("node", "100L as root"), N.F.lit(1), 100)
    assert one.count() == 0
    dealt = N._other_blocks(members, roots, N.F.lit(1), 100)
    assert dealt.count() == (nodes - 4) + 4 * (blocks + 1)  # four that are left, in one block
    left = dealt.where("id < 3 or id = 4").groupBy("id").agg(N.F.collect_set("j").alias("j")).collect()
    assert len(left) == 4 and all(sorted(r.j) == list(range(blocks + 1)) for r in left)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(9, "A b c"), (4, "a B\nc"), (7, "a b c d"), (None, "a b c d"), (1, None), (2, ""), (3, " \n"), (None, None), (11, long), (12, long + " end"), (11, long), (11, "a b c d"), (None, "only null ids here"), (None, "only  null ids HERE")]
    rows += [(100 + i, "copy of a text that is found again and again") for i in range(60)] + [(100, "another text under the same id as before")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, kept int")
    want = brute(rows)
    fixed = sorted(w.replace("None, False", "None, True") for w in want)  # a null id that is its component's
    assert rows_of(N.link(df)) == fixed
    kept = N.keep_one(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text is None, (r.text or "")[:9]) for r in kept) == sorted(
        [(False, 4, False, "a B\nc"), (False, 7, False, "a b c d"), (False, 1, True, ""), (False, 2, False, ""), (False, 3, False, " \n"), (True, 0, True, ""), (False, 11, False, long[:9]), (True, 0, False, next((r.text for r in kept if r.text and r.text.startswith("only")), "")[:9]), (False, 100, False, "copy of a"), (False, 100, False, "another t")]
    )
    assert N.link(df.limit(0)).count() == 0 and N.keep_one(df.limit(0)).count() == 0


def test_sketch_estimates():
    rng = np.random.default_rng(5)
    for n in (40, 300, 3000, 30_000):
        for share in (0.99, 0.9, 0.86):
            common = rng.integers(0, 2**63, int(2 * n * share / (1 + share)), dtype=np.uint64) * np.uint64(2)
            sets = [np.unique(np.concatenate([common, rng.integers(0, 2**63, n - len(common), dtype=np.uint64) * np.uint64(2) + np.uint64(1)])) for _ in range(2)]
            (a, x), (b, y) = map(N.odd_sketch, sets)
            x, y = (np.frombuffer(s, np.uint64)[None] for s in (x, y))
            true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
            estimate, may = N._estimates(x, y, *(np.array([float(v)]) for v in (a, b, len(sets[0]), len(sets[1]))))
            assert abs(estimate[0] - true) < 0.12  # it errs to the high side
            assert may[0] or true < 0.85


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 100), (5, 5)]
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {(r.vertex, r.root) for r in got} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100), (102, 100)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
