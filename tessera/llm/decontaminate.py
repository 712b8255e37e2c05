"""Benchmark decontamination with an FM-index of each training shard.

A shard is a few megabytes of texts as a sequence of word numbers. Words that no test phrase has can't be
inside a match, nor can pairs of neighbours that no phrase has, so the index covers the runs of words that
are left. Their suffix array gives the Burrows-Wheeler transform; a wavelet matrix over it answers ranks; all
phrases search backward at once; the places of their occurrences come from sampled suffix positions by
last-to-first steps. Occurrences merge to the spans to remove.

The phrases go to the tasks in blocks of bounded size (``PHRASE_BYTES`` of item text each), and each shard is searched for
one block after the other, which holds one block in memory at a time: neither table is ever joined with the other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Numbering, blocks, byte_texts, stored, to_python, total_bytes

WINDOW = 13
#: Bytes of text in an indexed shard, and of item text in a block of phrases.
SHARD_BYTES = 4 << 20
PHRASE_BYTES = 4 << 20
SAMPLE = 16
#: A text is contaminated when at least one in so many of its words is hit.
ONE_IN = 20

#: Bytes of words. ASCII letters in lower case, digits, and all that is not ASCII.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def split(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Phrases:
    """Windows of a block of items, as word numbers from 1, and which items each is of."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.numbers = Numbering({b"": 0})
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.numbers[w] for w in split((text or "").encode())]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.numbers = dict(self.numbers)
        self.items = [sorted(x) for x in found.values()]
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.words = np.zeros((len(found), window), np.int64)
        for k, p in enumerate(found):
            self.words[k, : len(p)] = p
        self.least = int(self.lengths.min()) if found else 0
        # pairs of neighbours, as a table by hash: it may let a pair through, never keep one out
        self.pairs = np.zeros(1 << 22, bool)
        a, b = self.words[:, :-1], self.words[:, 1:]
        self.pairs[self.pair(a[b > 0], b[b > 0])] = True

    @staticmethod
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 1_000_003 + b) & ((1 << 22) - 1)


class Index:
    """An FM-index over numbers. Inside, each is one more, and a 0 that is nowhere else ends the text."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        self.text = np.append(text + 1, 0)
        n = len(self.text)
        order = self._suffixes()
        bwt = self.text[order - 1]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.text))])
        self.levels = max(1, int(self.text.max()).bit_length())
        self.bits, self.zeros, self.ahead = [], [], []
        row = bwt
        for level in reversed(range(self.levels)):  # a wavelet matrix: at each level, zeros before ones
            bit = (row >> level & 1).astype(bool)
            self.bits.append(bit)
            self.ahead.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(n - int(self.ahead[-1][-1]))
            row = np.concatenate([row[~bit], row[bit]])
        self.marked = order % sample == 0
        self.rank_marked = np.cumsum(self.marked) - 1
        self.places = order[self.marked]
        self.n = n

    def _suffixes(self) -> np.ndarray:
        """Suffix array, by doubling the length that ranks cover; the suffix after the last is the least."""
        n = len(self.text)
        rank, k = self.text.astype(np.int64), 1
        while True:
            after = np.zeros(n, np.int64)
            after[: max(0, n - k)] = rank[k:] + 1
            key = rank * (n + int(self.text.max()) + 2) + after
            order = np.argsort(key, kind="stable")
            step = np.diff(key[order]) > 0
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(step)])
            if step.all():
                return order
            k *= 2

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each end."""
        first = np.zeros(len(ends), np.int64)
        ends = ends.copy()
        for i in range(self.levels):
            one = (symbols >> (self.levels - 1 - i) & 1).astype(bool)
            a, b = self.ahead[i][first], self.ahead[i][ends]
            first = np.where(one, self.zeros[i] + a, first - a)
            ends = np.where(one, self.zeros[i] + b, ends - b)
        return ends - first

    def symbol(self, rows: np.ndarray) -> np.ndarray:
        at, found = rows.copy(), np.zeros(len(rows), np.int64)
        for i in range(self.levels):
            bit, a = self.bits[i][at], self.ahead[i][at]
            found = found * 2 + bit
            at = np.where(bit, self.zeros[i] + a, at - a)
        return found

    def search(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each phrase the rows of the suffixes that begin with it."""
        low, high = np.zeros(len(words), np.int64), np.full(len(words), self.n, np.int64)
        largest = len(self.starts) - 2
        for j in reversed(range(words.shape[1])):
            on = np.flatnonzero((lengths > j) & (low < high))
            c = words[on, j] + 1
            known = c <= largest
            high[on[~known]] = low[on[~known]]
            on, c = on[known], c[known]
            low[on], high[on] = self.starts[c] + self.rank(c, low[on]), self.starts[c] + self.rank(c, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffixes: steps back until one is marked."""
        found, at, steps, on = np.zeros(len(rows), np.int64), rows.copy(), 0, np.arange(len(rows))
        while len(on):
            done = self.marked[at]
            found[on[done]] = self.places[self.rank_marked[at[done]]] + steps
            on, at = on[~done], at[~done]
            c = self.symbol(at)
            at, steps = self.starts[c] + self.rank(c, at), steps + 1
        return found % self.n


def occurrences(words: np.ndarray, bounds: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, phrase) of all occurrences in a shard's word numbers, texts end to end."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(words) or not phrases.least:
        return none
    known = words > 0
    if not known.any():
        return none
    joined = known[:-1] & known[1:] & phrases.pairs[phrases.pair(words[:-1], words[1:])]
    inner = bounds[1:-1]
    joined[inner[(inner > 0) & (inner < len(words))] - 1] = False  # no match crosses texts
    first = known.copy()
    first[1:] &= ~joined
    run = np.cumsum(first) - 1  # of each known word, its run
    keep = known & (np.bincount(run[known], minlength=run[-1] + 1)[np.maximum(run, 0)] >= phrases.least)
    places = np.flatnonzero(keep)
    if not len(places):
        return none
    gap = np.concatenate([[0], np.cumsum(first[places[1:]])])  # a separator before each further run
    text = np.zeros(len(places) + int(gap[-1]), np.int64)
    slots = np.arange(len(places)) + gap
    text[slots] = words[places]
    back = np.zeros(len(text) + 1, np.int64)
    back[slots] = places
    index = Index(text)
    low, high = index.search(phrases.words, phrases.lengths)
    times = high - low
    hit = np.flatnonzero(times > 0)
    rows = np.repeat(low[hit] - (np.cumsum(times[hit]) - times[hit]), times[hit]) + np.arange(int(times[hit].sum()))
    return back[index.locate(rows)], np.repeat(hit, times[hit])


def _search(blocks_of: list[Broadcast], carry: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Spans and items of every text. A shard's texts stay while the blocks of phrases come and go, one in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", SHARD_BYTES):
            words, bounds = [], [0]
            for t in byte_texts(block.column("text")):
                words += split(t)
                bounds.append(len(words))
            bounds = np.array(bounds, np.int64)
            edge = np.zeros(len(words) + 1, np.int64)
            items: list[set[str]] = [set() for _ in range(block.num_rows)]
            for sent in blocks_of:
                phrases = sent.value
                ids = np.fromiter((phrases.numbers.get(w, 0) for w in words), np.int64, len(words))
                at, phrase = occurrences(ids, bounds, phrases)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + phrases.lengths[phrase], -1)
                doc = np.searchsorted(bounds, at, "right") - 1
                for d, p in np.unique(np.column_stack([doc, phrase]), axis=0).tolist():
                    items[d].update(phrases.items[p])
                if len(blocks_of) > 1:
                    del phrases
                    sent.__dict__.pop("_value", None)  # it is read again from the worker's disk
            hit = np.cumsum(edge)[:-1] > 0
            # a span ends with its text, whatever comes next
            change = np.diff(np.concatenate([[0], hit.astype(np.int8)]))
            change[bounds[1:-1][bounds[1:-1] < len(words)]] = 0
            begins = np.zeros(len(words), bool)
            begins[change == 1] = True
            heads = bounds[:-1][bounds[:-1] < len(words)]
            begins[heads] = hit[heads]
            ends = hit.copy()
            ends[:-1] &= ~hit[1:] | begins[1:]
            spans = [[] for _ in range(block.num_rows)]
            starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
            for d, a, b in zip((np.searchsorted(bounds, starts, "right") - 1).tolist(), starts.tolist(), stops.tolist(), strict=True):
                spans[d].append([a - int(bounds[d]), b - int(bounds[d])])
            columns = [block.column("doc_id"), block.column("text"), pa.array(np.diff(bounds)), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array([sorted(x) for x in items], pa.list_(pa.string())), *(block.column(c) for c in carry)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_words", "spans", "items", *carry])

    return run


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, carry: dict[str, Column] | None = None, block_bytes: int = PHRASE_BYTES) -> DataFrame:
    """Of every row: n_words, the word spans to remove (start, end), and the ids of the items that occur.

    A null text has no words, an empty one neither; a long text is one shard, however long; rows with equal ids each get a row;
    a null id stays null. Items without words are not searched, an item with a null id goes by the empty id, items with equal ids are
    one, and an item that repeats is searched once; without items nothing is hit. An empty table gives an empty one; other columns stay
    behind, but for those in ``carry``, whose names must differ from the result's.
    """
    carry, sc = carry or {}, docs.sparkSession.sparkContext
    items = stored(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")).where("text is not null").distinct())
    n = max(1, -(-total_bytes(items, "text") // block_bytes))
    kinds = dict(docs.select(*[c.alias(k) for k, c in carry.items()]).dtypes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[c.alias(k) for k, c in carry.items()])
    schema = ", ".join(["doc_id long, text string, n_words long, spans array<array<long>>, items array<string>", *(f"`{k}` {t}" for k, t in kinds.items())])
    sent = []
    for k in range(n):
        block = [(r.item, r.text) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()]
        sent.append(sc.broadcast(Phrases(block, window)))
        if n > 1:
            sent[-1].__dict__.pop("_value", None)  # the driver keeps one block, too
    return to_python(rows, _search(sent, list(carry)), schema)


def judge_columns() -> dict[str, Column]:
    """The counts and the verdict, from the columns of ``find``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return {
        "n_hit": hit,
        "n_items": F.size("items").cast("long"),
        "items_sha256": F.sha2(F.concat_ws(",", "items"), 256),
        "contaminated": (hit > 0) & (ONE_IN * hit >= F.col("n_words")),
    }


def judge(found: DataFrame) -> DataFrame:
    """The counts and the verdict, beside the columns of ``find`` other than the text."""
    return found.drop("text").withColumns(judge_columns())


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return judge(find(docs, benchmark)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated.

    Nulls, empty and long texts as in ``find``: a row without words is clean. Rows that repeat are each judged, and alike; columns
    keep their names, whatever these are; an empty table gives an empty one.
    """
    # the text goes along once, as what is searched
    rest = [c for c in docs.columns if c != "text"]
    found = find(docs, benchmark, carry={f"__{i}": F.col(c) for i, c in enumerate(rest)})
    kept = found.where(~judge_columns()["contaminated"])
    return kept.select(*[F.col("text") if c == "text" else F.col(f"__{rest.index(c)}").alias(c) for c in docs.columns])


_WORD = re.compile(rb"[^ ]+")


def cut(text: str, spans: list[list[int]]) -> str:
    """A text without the words of its spans; what stands between two words of a span goes with them."""
    raw = text.encode()
    words = [m.span() for m in _WORD.finditer(raw.translate(_WORD_BYTES))]
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : words[a][0]])
        at = words[b - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


def without_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every row's id and its text without the spans that benchmark items cover. A null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in batches:
            texts = [t if t is None or not s else cut(t, s) for t, s in zip(block.column("text").to_pylist(), block.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return to_python(find(docs, benchmark).select("doc_id", "text", "spans"), run, "doc_id long, text string")


#: The query's rows in plain SQL.
ORACLE = r"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), places AS (
    SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0
), phrase AS (
    SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS p FROM places
), sizes AS (
    SELECT DISTINCT n FROM phrase
), windows AS (
    SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n
), hits AS (
    SELECT v.doc_id, v.i, v.n, p.item FROM (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS p FROM windows) AS v JOIN phrase AS p ON p.p = v.p AND p.n = v.n
), covered AS (
    SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) AS c GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) AS d GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(m.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM doc d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN named m ON m.doc_id = d.doc_id
"""
