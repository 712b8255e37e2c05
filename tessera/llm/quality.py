"""Quality rules: line labels by a linear-chain conditional random field.

A text is a sequence of its lines that hold a word. A field with two states, boilerplate and content, scores
each line by what it looks like and each pair of neighbours by their states; Viterbi decoding finds the best
labelling of the whole text, and the share of its words that stand in content lines decides retention.

Fitting takes weak labels of lines, found from the labels of texts: a line of a good text counts as content unless
it surely looks like the lines of bad ones, and the other way round, as long as most of a text keeps its label. It uses at most ``SAMPLE_DOCS`` labelled texts of at most ``SAMPLE_BYTES`` bytes each (the
ones with the smallest hashes of their ids), so the driver's share is bounded. Everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Numbering, blocks, byte_texts, flat, keyed_texts, mix, multipliers, release, to_python, word_ids

SAMPLE_DOCS = 1500
SAMPLE_BYTES = 20_000
#: Bytes of text that are measured at once.
STRETCH = 1 << 20
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
MIN_CONTENT_SHARE = 0.5
#: Log-odds from which a line's looks outweigh its text's label, and how often labels are found anew.
SURE = 1.0
EM_ROUNDS = 3
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_words long, content_share double, kept boolean"

#: Fixed value: the characters that count as symbols.
SYMBOLS = b"[#*$%&|<>]"[1:-1]


def _table(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


_SYMBOL = _table(SYMBOLS)
_UPPER = _table(bytes(range(65, 91)))
_LOWER = _table(bytes(range(97, 123)))
_DIGIT = _table(b"0123456789")
_HIGH = _table(bytes(range(128, 256)))
_LEAD = ~_table(bytes(range(0x80, 0xC0)))
_MARK = ~(SPACE | _UPPER | _LOWER | _DIGIT | _HIGH)
_END = _table(b".!?:;\"')")

#: Edges of the steps into which a line's measures are cut; each step is a feature of its own.
STEPS = {
    "words": (2, 4, 8, 16, 40),
    "upper per letter": (0.02, 0.08, 0.2, 0.5, 0.8),
    "marks per word": (0.1, 0.3, 0.6, 1.0, 2.0),
    "symbols per word": (0.01, 0.1, 0.3, 0.6, 1.0),
    "digits per character": (0.02, 0.1, 0.3),
    "characters per word": (2.5, 4, 6, 8, 12),
    "distinct per word": (0.3, 0.5, 0.7, 0.9),
    "earlier copy": (0.5,),
    "ends a sentence": (0.5,),
    "blank": (),
}
_FIRST = np.cumsum([0, *(len(s) + 1 for s in STEPS.values())])
N_FEATURES = int(_FIRST[-1])


@dataclass(frozen=True)
class Lines:
    """The lines with a word of a block of texts, with what base rules and features need."""

    doc: np.ndarray  # of each line, the text's place in the block
    words: np.ndarray
    features: np.ndarray  # of each line and measure, the number of its step
    n_words: np.ndarray  # from here on of each text
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def measure(column: pa.Array) -> Lines:
    """Measure a block of texts."""
    data, offsets = flat(column)
    texts = byte_texts(column)
    space = SPACE[data]
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1, [0]])) if len(data) else np.zeros(0, np.int64)
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))[: len(starts)]
    first = ~space
    first[1:] &= space[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    first[inner] = ~space[inner]  # a text's first byte starts a word whatever stands before it
    count = {}
    for name, mask in (("word", first), ("upper", _UPPER[data]), ("lower", _LOWER[data]), ("mark", _MARK[data]), ("symbol", _SYMBOL[data]), ("digit", _DIGIT[data]), ("char", ~space & _LEAD[data])):
        count[name] = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
    of = lambda name, a, b: count[name][b] - count[name][a]
    words = of("word", starts, ends)
    full = words > 0
    starts, ends, words = starts[full], ends[full], words[full]
    doc = np.searchsorted(offsets, starts, "right") - 1

    ids, bounds = word_ids(texts, Numbering())
    n_dup = np.zeros(len(texts), np.int64)
    copy = np.zeros(len(starts), bool)
    line, spans = 0, list(zip(doc.tolist(), starts.tolist(), ends.tolist(), strict=True))
    raw = data.tobytes()
    seen, at = set(), -1
    for line, (d, a, b) in enumerate(spans):
        if d != at:
            seen, at = set(), d
        key = raw[a : b - 1] if raw[b - 1] == 10 else raw[a:b]
        if key in seen:
            copy[line] = True
            n_dup[d] += 1
        else:
            seen.add(key)

    # distinct words of a line: words whose like stands earlier in the line don't count
    line_of_word = np.repeat(np.arange(len(starts)), words)
    distinct = np.bincount(np.unique(line_of_word * (int(ids.max()) + 1 if len(ids) else 1) + ids) // (int(ids.max()) + 1 if len(ids) else 1), minlength=len(starts)) if len(ids) else np.zeros(0)
    last = ends - 1 - (data[ends - 1] == 10) if len(ends) else ends
    letters = of("upper", starts, ends) + of("lower", starts, ends)
    chars = of("char", starts, ends)
    values = (
        words,
        of("upper", starts, ends) / np.maximum(letters, 1),
        of("mark", starts, ends) / np.maximum(words, 1),
        of("symbol", starts, ends) / np.maximum(words, 1),
        of("digit", starts, ends) / np.maximum(chars, 1),
        chars / np.maximum(words, 1),
        distinct / np.maximum(words, 1),
        copy,
        _END[data[last]] if len(last) else last,
        words,
    )
    features = np.stack([_FIRST[i] + np.searchsorted(np.asarray(s, float), np.asarray(v, float), "right") for i, (s, v) in enumerate(zip(STEPS.values(), values, strict=True))], 1)
    a, b = offsets[:-1], offsets[1:]
    return Lines(doc, words, features, np.diff(bounds), of("char", a, b), of("symbol", a, b), n_dup, repeat_words(ids, bounds))


def repeat_words(ids: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Of each text, its words in windows of ``window`` words that it holds twice or more."""
    n = len(ids) - window + 1
    docs = len(bounds) - 1
    if n <= 0:
        return np.zeros(docs, np.int64)
    h = np.zeros(n, np.uint64)
    scrambled = mix(ids.astype(np.uint64) + np.uint64(1))
    for j, m in enumerate(multipliers(window, 7)):
        h += scrambled[j : j + n] * m
    doc = np.repeat(np.arange(docs), np.diff(bounds))
    inside = doc[:n] == doc[window - 1 :]
    h = mix(h ^ mix(doc[:n].astype(np.uint64)))
    places = np.flatnonzero(inside)
    ordered = np.sort(h[places])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(docs, np.int64)
    near = np.minimum(np.searchsorted(twice, h[places]), len(twice) - 1)
    places = places[twice[near] == h[places]]
    # hashes only shortlist: the windows' words decide
    keys = np.ascontiguousarray(np.column_stack([doc[places], *(ids[places + j] for j in range(window))]))
    _, back, times = np.unique(keys.view([("", keys.dtype)] * keys.shape[1]).ravel(), return_inverse=True, return_counts=True)
    places = places[times[back.ravel()] > 1]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + window, -1)
    return np.bincount(doc, np.cumsum(edge)[:-1] > 0, docs).astype(np.int64)


@dataclass(frozen=True)
class Field:
    """A linear-chain field of two states: 0 boilerplate, 1 content."""

    emit: np.ndarray  # (features, 2)
    move: np.ndarray  # (2, 2)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.emit[features].sum(1)

    def decode(self, scores: np.ndarray) -> list[int]:
        """The best labelling of one text's lines (Viterbi); a tie goes to content."""
        (m00, m01), (m10, m11) = self.move.tolist()
        rows = scores.tolist()
        s0, s1 = rows[0]
        back = []
        for e0, e1 in rows[1:]:
            a0, b0, a1, b1 = s0 + m00, s1 + m10, s0 + m01, s1 + m11
            back.append((1 if b0 >= a0 else 0, 1 if b1 >= a1 else 0))
            s0, s1 = (b0 if b0 >= a0 else a0) + e0, (b1 if b1 >= a1 else a1) + e1
        state = 1 if s1 >= s0 else 0
        states = [state]
        for pointers in reversed(back):
            state = pointers[state]
            states.append(state)
        return states[::-1]


def fit(sample: list[tuple[str, int]], rounds: int = 80, rate: float = 0.25, penalty: float = 1e-3, longest: int = 64) -> Field:
    """A field from texts with their quality. Lines come in runs of at most ``longest``; a sample without both classes gives a field that calls every line content."""
    if len({y for _, y in sample}) < 2:
        return Field(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))
    features, doc, words = sample_lines([t for t, _ in sample])
    labels = line_labels(features, doc, words, np.asarray([y for _, y in sample]), rounds, rate, penalty)
    field = _train(features, labels, _in_runs(doc, longest), rounds, rate, penalty)
    release()
    return field


def sample_lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of the texts their features, text and words."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])
    parts, before = [], 0
    for block in blocks(iter([batch]), size=STRETCH):
        lines = measure(block.column("text"))
        parts.append((lines.features, lines.doc + before, lines.words))
        before += block.num_rows
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def line_labels(features: np.ndarray, doc: np.ndarray, words: np.ndarray, quality: np.ndarray, rounds: int = 80, rate: float = 0.25, penalty: float = 1e-3) -> np.ndarray:
    """Weak labels of lines: expectation and maximisation, with the texts' quality as a constraint.

    All lines begin with their text's label. A model of single lines then says how much each looks like content, and a
    line goes over to the other label where it is sure by ``SURE``. In a text the lines that fit its quality best keep its label,
    those with half of its words or more. This is done ``EM_ROUNDS`` times.
    """
    labels = quality[doc]
    single = np.arange(len(doc))[:, None], np.ones((len(doc), 1), bool)
    for _ in range(EM_ROUNDS):
        odds = np.subtract(*_train(features, labels, single, rounds, rate, penalty).scores(features).T[::-1])
        fits = np.where(quality[doc] == 1, odds, -odds)  # how well a line fits its text's quality
        order = np.lexsort((-fits, doc))
        before = np.cumsum(words[order]) - words[order]
        head = np.searchsorted(doc[order], np.arange(len(quality)))
        of_text = np.bincount(doc, words, len(quality))[doc[order]]
        most = np.empty(len(doc), bool)
        most[order] = 2 * (before - before[np.minimum(head, len(doc) - 1)][doc[order]]) < of_text
        labels = np.where(most | (fits > -SURE), quality[doc], 1 - quality[doc])
    return labels


def _in_runs(doc: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines of texts in a row, at most ``longest``, as a table of places and which of these count."""
    runs = [r[i : i + longest] for r in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1) for i in range(0, len(r), longest)]
    n, t = len(runs), max(map(len, runs))
    place, on = np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, r in enumerate(runs):
        place[i, : len(r)], on[i, : len(r)] = r, True
    return place, on


def _train(features: np.ndarray, labels: np.ndarray, runs: tuple[np.ndarray, np.ndarray], rounds: int, rate: float, penalty: float) -> Field:
    """Maximum likelihood by forward-backward and Adam."""
    place, on = runs
    n, t = place.shape
    x, y = features[place], labels[place]
    both = on[:, 1:]
    theta = np.zeros(2 * N_FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        emit, move = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
        e = emit[x].sum(2)
        alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        alpha[:, 0] = e[:, 0]
        for i in range(1, t):
            new = np.logaddexp(alpha[:, i - 1, :1] + move[0], alpha[:, i - 1, 1:] + move[1]) + e[:, i]
            alpha[:, i] = np.where(on[:, i, None], new, alpha[:, i - 1])
        for i in range(t - 2, -1, -1):
            ahead = beta[:, i + 1] + e[:, i + 1]
            new = np.logaddexp(ahead[:, :1] + move[:, 0], ahead[:, 1:] + move[:, 1])
            beta[:, i] = np.where(on[:, i + 1, None], new, beta[:, i + 1])
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])[:, None, None]
        gap = (np.exp(alpha + beta - z) - np.eye(2)[y]) * on[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + move + (beta + e)[:, 1:, None, :] - z[..., None])
        pair = (pair - np.eye(4)[y[:, :-1] * 2 + y[:, 1:]].reshape(n, t - 1, 2, 2)) * both[..., None, None] if t > 1 else np.zeros((1, 1, 2, 2))
        grad = np.zeros((N_FEATURES, 2))
        for k in range(x.shape[2]):
            for s in (0, 1):
                grad[:, s] += np.bincount(x[..., k].ravel(), gap[..., s].ravel(), N_FEATURES)
        g = np.concatenate([grad.ravel(), pair.sum((0, 1)).ravel()]) / on.sum() + penalty * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2))


def labelled_sample(docs: DataFrame, labels: DataFrame, docs_at_most: int = SAMPLE_DOCS, bytes_at_most: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """Texts with their quality, at most so many of at most so many bytes: those with the smallest hashes of their ids."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    y = y.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    # twice as many ids as texts: some texts may be too long or missing
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * docs_at_most).select("doc_id", "quality")
    short = keyed_texts(docs).where((F.octet_length("text") > 0) & (F.octet_length("text") <= bytes_at_most))
    rows = short.join(F.broadcast(y), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(docs_at_most).collect()
    return [(r.text, r.quality) for r in rows]


def score(docs: DataFrame, field: Field, min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """Base counts and verdict of every row, in one pass without a shuffle.

    A null text has no words, so it fails the base rules; rows with equal ids, and rows that repeat, each get a row; a null id
    stays null; a long text is measured and decoded whole, all its lines; of two labellings that score alike the one with content last
    counts; an empty table gives an empty one; other columns stay behind, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, size=STRETCH):
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *_judged(block.column("text"), field, min_share)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return to_python(keyed_texts(docs), run, SCHEMA)


def _judged(texts: pa.Array, field: Field, min_share: float) -> list[pa.Array]:
    """The columns of ``SCHEMA`` after the id."""
    found = measure(texts)
    n = len(texts)
    scores = field.scores(found.features) if len(found.doc) else np.zeros((0, 2))
    states = np.zeros(len(found.doc), np.int64)
    cut = (np.flatnonzero(np.diff(found.doc)) + 1).tolist()
    for a, b in zip([0, *cut], [*cut, len(found.doc)], strict=True):
        if b > a:
            states[a:b] = field.decode(scores[a:b])
    content = np.bincount(found.doc, found.words * states, n).astype(np.int64)
    share = content / np.maximum(found.n_words, 1)
    failed = (found.n_words < MIN_WORDS) | (100 * found.n_repeat_words > MAX_REPEAT_PERCENT * found.n_words)
    return list(map(pa.array, (found.n_words, found.word_chars, found.n_symbols, found.n_dup_lines, found.n_repeat_words, failed, content, share, ~failed & (share >= min_share))))


def keep_quality(docs: DataFrame, labels: DataFrame, min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """The rows of ``docs``, all columns, whose texts pass. A text goes to the model once, and comes back only if it passes.

    Nulls, long texts and ties as in ``score``: a null text never passes; each of several rows alike is judged, and alike; columns keep their
    names, whatever these are; an empty table gives an empty one. Labels without an id, a quality of 0 or 1, or agreement are passed over.
    """
    field = fit(labelled_sample(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, size=STRETCH):
            yield block.filter(_judged(block.column("text"), field, min_share)[-1])

    return to_python(docs, run, docs.schema)
