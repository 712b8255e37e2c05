"""Quality rules against brute force, and the model on held-out labels."""

import collections
import itertools
import re

import numpy as np

from tessera.llm import quality as Q
from tessera.llm.common import read

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", None, " \n\t", "one", "a b c\n\na b c\n", "x " * 40, "a b c d e f g h " * 2, "a b c d e f g h\na b c d e f g h i", "é ü x y # $ | <b>\r\nx", "\n".join(["same line"] * 9), "w1 " * 7, "long " + "word " * 60_000]


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    times = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if times[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def rows_of(frame):
    return [(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in frame.collect()]


def test_base_counts(spark):
    """Nulls, empty and long texts, repeated rows and extra columns with the result's names."""
    rows = [(i, t, True) for i, t in enumerate(TEXTS)] + [(None, "a b", None), (3, "one", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept boolean")
    got = rows_of(Q.score(df, Q.fit([])))
    assert sorted(map(repr, got)) == sorted(repr((i, brute(t))) for i, t, _ in rows)
    assert Q.score(df.limit(0), Q.fit([])).count() == 0


def test_counts_on_documents(spark):
    docs = read(spark, SF, "documents").select("doc_id", "text")
    assert dict(rows_of(Q.score(docs, Q.fit([])))) == {r.doc_id: brute(r.text) for r in docs.collect()}


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(1)
    field = Q.Field(np.zeros((Q.N_FEATURES, 2)), rng.normal(size=(2, 2)))
    for n in (1, 2, 7):
        e = rng.normal(size=(n, 2))
        total = lambda y: sum(e[i, s] for i, s in enumerate(y)) + sum(field.move[a, b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        assert tuple(field.decode(e)) == max(itertools.product((0, 1), repeat=n), key=total)


def test_held_out_accuracy(spark):
    docs, labels = (read(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    half = labels.where("doc_id % 2 = 0")
    field = Q.fit(Q.labelled_sample(docs, half))
    verdicts = {r.doc_id: r for r in Q.score(docs, field).collect()}
    rest = [(r.quality, verdicts[r.doc_id]) for r in labels.where("doc_id % 2 = 1").collect()]
    rest = [(q, v.kept) for q, v in rest if not v.base_failed]
    assert np.mean([k for q, k in rest if q == 1]) > 0.98 and np.mean([not k for q, k in rest if q == 0]) > 0.95


def test_sample_is_bounded_and_needs_both_classes(spark):
    docs = spark.createDataFrame([(i, "some words here " * 10) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(1, 0), (None, 1)], "doc_id long, quality int")
    sample = Q.labelled_sample(docs, labels, docs_at_most=7)
    assert len(sample) == 7 and sample == Q.labelled_sample(docs, labels, docs_at_most=7)
    kept = Q.keep_quality(docs.selectExpr("*", "1 AS n_words"), labels.limit(0))
    assert kept.columns == ["doc_id", "text", "n_words"] and kept.count() == 0  # they repeat themselves


def sample_of(spark):
    docs, labels = (read(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    return Q.labelled_sample(docs, labels)


def test_sequences_change_state(spark):
    """Training texts hold lines of both labels, most of a text keeps its own, and lines of texts that all say the same keep it."""
    sample = sample_of(spark)
    features, doc, words = Q.sample_lines([t for t, _ in sample])
    quality = np.array([y for _, y in sample])
    labels = Q.line_labels(features, doc, words, quality)
    n = len(quality)
    content, total = np.bincount(doc, words * labels, n), np.bincount(doc, words, n)
    mixed = (content > 0) & (content < total)
    assert mixed.sum() > 50 and (2 * content[quality == 1] >= total[quality == 1]).all() and (2 * content[quality == 0] <= total[quality == 0]).all()


def test_boilerplate_in_good_texts_is_found(spark):
    """Menus spliced into good texts are boilerplate, the lines around them content; the share says how much is left."""
    sample = sample_of(spark)
    field = Q.fit(sample)
    good = [t for t, y in sample if y and t.count("\n") > 3 and not brute(t)[-1]][:50]
    menu = " | ".join(["Home", "About", "Login", "Contact", "News"] * 6)
    exact = 0
    for text in good:
        lines = text.split("\n")
        lines[2:2] = [menu, menu.upper()]
        found = Q.measure(Q.pa.array(["\n".join(lines)]))
        states = field.decode(field.scores(found.features))
        full = [i for i, x in enumerate(lines) if WORD.search(x)]
        exact += all(s == (i not in (2, 3)) for i, s in zip(full, states, strict=True))
    assert len(good) == 50 and exact >= 45


def test_stage_on_odd_rows(spark):
    """The stage judges nulls, repeated rows and clashing names as the scores do."""
    text = "\n".join(f"A line {x} of some {x} plain words {x}, ends." for x in "abcdefghi")
    rows = [(1, text, True, 1), (1, text, True, 1), (2, None, None, None), (3, "", False, 2), (None, text, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept boolean, n_words int")
    labels = spark.createDataFrame([(None, 1), (1, None), (1, 7)], "doc_id long, quality int")
    kept = Q.keep_quality(docs, labels)
    assert kept.columns == docs.columns and sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [rows[0], rows[1], rows[4]]))
    assert Q.keep_quality(docs.limit(0), labels).count() == 0
