"""Exact substring dedup with logarithmic families of suffix arrays.

Which bytes does a text share with a text of a smaller id, in strings of ``LENGTH`` bytes or more? The corpus's
suffixes are dealt to buckets, and each bucket has index families of its own: batches come in, each gets a sorted
array, is merge-scanned against the sorted levels that are there, and what no level has becomes a level; levels of like size
merge, so a bucket has logarithmically many.

What goes to which bucket is settled by minimisers. In a window of ``LENGTH`` bytes the ``GRAM``-byte string with the
least hash is the window's anchor. Equal windows have equal anchors, so they meet in the bucket of the
anchor's hash, and a window can only be shared if its anchor is in two documents. Windows in a row with one anchor are a
run. Hence:

1. Each chunk of documents sends, to each bucket, the hashes of its anchors: four bytes each.
2. Each bucket answers, two bits for a hash: whether two documents have it, and whether it is hot: more than ``HOT_CHUNKS``
   chunks have it, or one has more than ``HOT_RUNS`` different runs of it.
3. Each chunk sorts its runs with shared anchors, and sends one of those that are alike, as bytes, with the smallest id that has
   it. A run of a hot anchor goes as single windows, each to the bucket of its own hash, so that no
   task gets all surroundings of a common string.
4. Each bucket puts the runs through a family of sorted runs, which finds the long matches: runs that agree on their whole
   length. Runs of one anchor that differ go on, in order of their documents, to a family of suffix arrays, which finds
   the windows that they share. The answer is one bit for a window: whether an earlier document has it.
5. Each chunk cuts the windows' bytes from its documents.

A passage that a third of all documents hold thus costs each chunk one run. Chunks and buckets are a few megabytes, as long
as there are at most ``2 ** BUCKET_BITS[1]`` buckets; all answers can be computed anew from their inputs if an executor is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, keyed_texts, release, repeated, stored, to_python, total_bytes

LENGTH = 50
GRAM = 24
#: Bytes of text in a chunk, and in the stretches of it that are hashed at once.
CHUNK = 4 << 20
STRETCH = 1 << 18
#: There are about four buckets for each chunk, two to a power between these.
BUCKET_BITS = (6, 26)
#: Suffixes in a batch of an index family.
BATCH = 1 << 17
#: Chunks that have an anchor, and different runs of it in one chunk, from which on its runs are dealt as single windows.
HOT_CHUNKS = 4096
HOT_RUNS = 256
#: Rows alike in id and text from which on they are one row until the end.
ALIKE = 64
#: The place of a document without an id: after all others.
LAST = np.uint64(2**64 - 1)

_C = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@dataclass
class Runs:
    """Runs of neighbouring windows of one document that have one anchor."""

    start: np.ndarray  # byte of the chunk
    size: np.ndarray  # windows
    anchor: np.ndarray
    doc: np.ndarray  # row of the chunk


def _runs_of(data: np.ndarray, offsets: np.ndarray) -> Runs:
    n = len(data)
    padded = np.concatenate([data, np.zeros(64, np.uint8)]).tobytes()
    words = np.empty(n + 40, np.uint64)  # the eight bytes from each byte on
    for j in range(8):
        part = words[j::8]
        part[:] = np.frombuffer(padded, "<u8", len(part), j)
    h = words[:n] * _C[0]
    h += words[8 : n + 8] * _C[1]
    h += words[16 : n + 16] * _C[2]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    width, step = LENGTH - GRAM + 1, 1
    while 2 * step <= width:  # least hash of each window's grams, by doubling
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    h = np.minimum(h[: len(h) - (width - step)], h[width - step :]) if width > step else h
    begins = np.ones(n, bool)  # of windows: not the last bytes of a text
    full = np.diff(offsets) > 0
    ends = offsets[1:][full, None] - np.arange(1, LENGTH)
    begins[np.maximum(ends, offsets[:-1][full, None])] = False
    place = np.flatnonzero(begins[: len(h)])
    anchor = h[place]
    new = np.ones(len(place), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    head = np.zeros(n + 1, bool)
    head[offsets[:-1]] = True
    new |= head[place]
    first = np.flatnonzero(new)
    start, size, anchor = place[first], np.diff(np.append(first, len(place))), anchor[first]
    # an anchor is in no more than ``width`` windows in a row, unless the text repeats itself: then pieces of that size are alike
    pieces = -(-size // width)
    inside = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start, size, anchor = np.repeat(start, pieces) + width * inside, np.minimum(np.repeat(size, pieces) - width * inside, width), np.repeat(anchor, pieces)
    return Runs(start, size, anchor, np.searchsorted(offsets, start, "right") - 1)


class Chunk:
    """A chunk's documents, their runs, and the distinct anchors by bucket."""

    def __init__(self, table: pa.Table, bits: int):
        table = table.combine_chunks()
        column = table.column("text")
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
        self.data, self.offsets = flat(column)
        ids = table.column("doc_id").to_pylist()
        self.ids = ids
        # document order: signed numbers from 0 up, then those without one
        self.order = np.array([LAST if i is None else np.uint64(i + 2**63) for i in ids], np.uint64)
        found, a = [], 0
        while a < len(ids):
            b = max(a + 1, int(np.searchsorted(self.offsets, self.offsets[a] + STRETCH, "right")) - 1)
            runs = _runs_of(self.data[self.offsets[a] : self.offsets[b]], self.offsets[a : b + 1] - self.offsets[a])
            found.append(Runs(runs.start + self.offsets[a], runs.size, runs.anchor, runs.doc + a))
            a = b
        none = Runs(*(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64)))
        self.runs = Runs(*(np.concatenate([getattr(r, k) for r in [none, *found]]) for k in ("start", "size", "anchor", "doc")))
        # bucket and the next 32 bits of an anchor's hash: enough to find what may be shared
        self.bits = bits
        self.short = self.runs.anchor >> np.uint64(32 - bits)
        self.by_short = np.argsort(self.short)
        ranked = self.short[self.by_short]
        head = np.ones(len(ranked), bool)
        head[1:] = ranked[1:] != ranked[:-1]
        self.heads = np.flatnonzero(head)
        self.shorts = ranked[self.heads]
        self.place = np.empty(len(ranked), np.int64)  # of each run's anchor among the distinct ones
        self.place[self.by_short] = np.cumsum(head) - 1
        self.bucket = (self.shorts >> np.uint64(32)).astype(np.int64)

    def several(self) -> np.ndarray:
        """Of each distinct anchor, whether documents with different ids have it."""
        owner = self.order[self.runs.doc[self.by_short]]
        return np.minimum.reduceat(owner, self.heads) < np.maximum.reduceat(owner, self.heads) if len(owner) else np.zeros(0, bool)

    def many(self) -> np.ndarray:
        """Of each distinct anchor, whether the chunk has very many different runs of it."""
        times = np.diff(np.append(self.heads, len(self.by_short)))
        found = times > HOT_RUNS
        for k in np.flatnonzero(found).tolist():
            runs = self.by_short[self.heads[k] : self.heads[k] + times[k]]
            ends = self.runs.start[runs] + self.runs.size[runs] + LENGTH - 1
            found[k] = len({self.data[a:b].tobytes() for a, b in zip(self.runs.start[runs].tolist(), ends.tolist(), strict=True)}) > HOT_RUNS
        return found

    def contents(self, masks: dict[int, bytes]) -> Contents:
        """The runs whose anchors are shared, sorted by anchor and bytes, those that are alike as one."""
        shared, hot = np.zeros(len(self.shorts), bool), np.zeros(len(self.shorts), bool)
        for bucket, mask in masks.items():
            a, b = np.searchsorted(self.bucket, [bucket, bucket + 1])
            shared[a:b], hot[a:b] = np.unpackbits(np.frombuffer(mask, np.uint8), count=2 * (b - a)).reshape(2, -1)
        some = np.flatnonzero(shared[self.place] & ~hot[self.place])
        single = np.flatnonzero(hot[self.place])
        start, size, doc, short = self.runs.start[some], self.runs.size[some], self.runs.doc[some], self.short[some]
        if len(single):
            n = self.runs.size[single]
            at = np.repeat(self.runs.start[single] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            start, size, doc = np.concatenate([start, at]), np.concatenate([size, np.ones(len(at), np.int64)]), np.concatenate([doc, np.repeat(self.runs.doc[single], n)])
            short = np.concatenate([short, _of_windows(self.data, at) >> np.uint64(32 - self.bits)])
        raw = self.data.tobytes()
        texts = [raw[a:b] for a, b in zip(start.tolist(), (start + size + LENGTH - 1).tolist(), strict=True)]
        order = np.array(sorted(range(len(texts)), key=texts.__getitem__), np.int64)
        order = order[np.argsort(short[order], kind="stable")]
        ranked = [texts[i] for i in order.tolist()]
        head = np.array([k == 0 or ranked[k] != ranked[k - 1] for k in range(len(ranked))], bool)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(head) - 1
        heads = np.flatnonzero(head)
        first = np.minimum.reduceat(self.order[doc[order]], heads) if len(heads) else np.zeros(0, np.uint64)
        short = short[order[heads]]
        return Contents([ranked[k] for k in heads.tolist()], (short >> np.uint64(32)).astype(np.int64), short.astype(np.uint32), first, start, size, doc, which)


@dataclass
class Contents:
    """Distinct contents of a chunk's runs, by bucket and anchor, and the runs."""

    texts: list[bytes]
    bucket: np.ndarray
    short: np.ndarray
    first: np.ndarray  # the smallest document that has it
    start: np.ndarray  # from here on of each run
    size: np.ndarray
    doc: np.ndarray
    which: np.ndarray  # its content


def _of_windows(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the windows that begin at these places."""
    h = np.zeros(len(at), np.uint64)
    for j in range(LENGTH):
        h = (h ^ data[at + j]) * _C[0]
        h ^= h >> np.uint64(29)
    return h * _C[1]


def _levels_merge(levels: list, merge: Callable) -> None:
    """Levels of like size merge, so that each is at least twice as long as the next."""
    while len(levels) > 1 and len(levels[-2][0]) < 2 * len(levels[-1][0]):
        levels[-2:] = [merge(*levels[-2:])]


class RunFamily:
    """Sorted levels of distinct runs (anchor, bytes), each with its number; no run is in two."""

    def __init__(self):
        self.levels: list[tuple[list[tuple[int, bytes]], list[int]]] = []
        self.n = 0

    def add(self, runs: list[tuple[int, bytes]]) -> np.ndarray:
        """Take in a batch; the number of each run, the same for runs that agree on their whole length."""
        order = sorted(range(len(runs)), key=runs.__getitem__)  # parts of the batch are sorted already, so this merges them
        keys, group = [], np.empty(len(runs), np.int64)
        for i in order:
            if not keys or keys[-1] != runs[i]:
                keys.append(runs[i])
            group[i] = len(keys) - 1
        number = np.full(len(keys), -1)
        for level, of in self.levels:  # both sides are sorted: a merge scan
            i = j = 0
            while i < len(keys) and j < len(level):
                if keys[i] == level[j]:
                    number[i] = of[j]
                    i, j = i + 1, j + 1
                elif keys[i] < level[j]:
                    i += 1
                else:
                    j += 1
        new = np.flatnonzero(number < 0)
        number[new] = self.n + np.arange(len(new))
        self.n += len(new)
        if len(new):
            self.levels.append(([keys[i] for i in new.tolist()], number[new].tolist()))
        _levels_merge(self.levels, self._merge)
        return number[group]

    @staticmethod
    def _merge(a: tuple, b: tuple) -> tuple:
        both = sorted([*zip(*a, strict=True), *zip(*b, strict=True)])  # two sorted runs: one merge
        return [k for k, _ in both], [n for _, n in both]


@dataclass
class Suffixes:
    """A suffix array: places in a text, sorted by the ``LENGTH`` bytes that begin there."""

    text: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at)

    def keys(self) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.text, LENGTH)[self.at].view(f"S{LENGTH}").ravel()


class IndexFamily:
    """Levels of suffix arrays of distinct suffixes (by their first ``LENGTH`` bytes), each suffix with its first document; none is in two."""

    def __init__(self):
        self.levels: list[tuple[Suffixes, np.ndarray]] = []

    def add(self, text: np.ndarray, at: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """Take in a batch of the suffixes at some places of a text, owners rising and none before an earlier batch's; whether a smaller owner has each suffix."""
        suffixes = Suffixes(text, at).keys()
        order = np.argsort(suffixes, kind="stable")  # the batch's suffix array
        ranked = suffixes[order]
        head = np.ones(len(order), bool)
        head[1:] = ranked[1:] != ranked[:-1]
        group = np.cumsum(head) - 1
        keys, first = ranked[head], owners[order[head]]
        known = np.zeros(len(keys), bool)
        for level, of in self.levels:
            mine, theirs = _scan(keys, level.keys())
            first[mine] = of[theirs]
            known[mine] = True
        earlier = np.empty(len(order), bool)
        earlier[order] = first[group] < owners[order]
        if not known.all():
            self.levels.append((Suffixes(text, at[order[head]][~known]), first[~known]))
        _levels_merge(self.levels, self._merge)
        return earlier

    @staticmethod
    def _merge(a: tuple[Suffixes, np.ndarray], b: tuple[Suffixes, np.ndarray]) -> tuple[Suffixes, np.ndarray]:
        order = np.argsort(np.concatenate([a[0].keys(), b[0].keys()]), kind="stable")
        text, at = np.concatenate([a[0].text, b[0].text]), np.concatenate([a[0].at, b[0].at + len(a[0].text)])
        return Suffixes(text, at[order]), np.concatenate([a[1], b[1]])[order]


def _scan(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the strings that both sorted arrays have: a stable sort of two sorted runs merges them, and equal ones become neighbours."""
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")
    same = np.flatnonzero(both[order[1:]] == both[order[:-1]])
    return order[same], order[same + 1] - len(a)


def _pack(texts: list[bytes], short: np.ndarray, first: np.ndarray) -> bytes:
    sizes = np.fromiter(map(len, texts), np.uint32, len(texts))
    return zstandard.compress(b"".join([np.uint32(len(texts)).tobytes(), sizes.tobytes(), short.tobytes(), first.tobytes(), *texts]), 1)


def _unpack(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    sizes, short = np.frombuffer(raw, np.uint32, n, 4), np.frombuffer(raw, np.uint32, n, 4 + 4 * n)
    first = np.frombuffer(raw[4 + 8 * n : 4 + 16 * n], np.uint64)
    ends = (4 + 16 * n + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])).tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)], short, first


def _batches(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Items in turn, in batches of about ``BATCH`` windows."""
    at, total = 0, np.cumsum(sizes)
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BATCH, "right")))
        yield at, stop
        at = stop


def search_bucket(blobs: list[bytes]) -> list[bytes]:
    """Of each chunk's contents, bits of the windows that an earlier document has."""
    parts = [_unpack(blob) for blob in blobs]
    runs = [(a, t) for texts, short, _ in parts for a, t in zip(short.tolist(), texts, strict=True)]
    owners = np.concatenate([first for *_, first in parts])
    long = RunFamily()
    which = np.concatenate([np.zeros(0, np.int64), *(long.add(runs[a:b]) for a, b in _batches(np.fromiter((len(t) - LENGTH + 1 for _, t in runs), np.int64, len(runs))))])
    least, anchor = np.full(long.n, LAST), np.zeros(long.n, np.int64)
    np.minimum.at(least, which, owners)
    contents: list[bytes] = [b""] * long.n
    for (a, t), k in zip(runs, which.tolist(), strict=True):
        contents[k], anchor[k] = t, a
    sizes = np.fromiter(map(len, contents), np.int64, long.n) - LENGTH + 1
    ends = np.cumsum(sizes)
    found = np.zeros(int(sizes.sum()), bool)
    # runs of an anchor that agree on their whole length are one by now; where others are left, they may share windows
    _, group, times = np.unique(anchor, return_inverse=True, return_counts=True)
    several = np.flatnonzero(times[group] > 1)
    several = several[np.argsort(least[several], kind="stable")]
    family = IndexFamily()
    for at, stop in _batches(sizes[several]):
        batch = several[at:stop]
        buffer = np.frombuffer(b"".join([contents[i] for i in batch.tolist()]), np.uint8)
        n = sizes[batch]
        begin = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
        spread = lambda base: np.repeat(base - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))  # noqa: B023, E731
        found[spread(ends[batch] - n)] = family.add(buffer, spread(begin), np.repeat(least[batch], n))
    out, at = [], 0
    for texts, _, first in parts:
        own, at = which[at : at + len(texts)], at + len(texts)
        n = sizes[own]
        bits = found[np.repeat(ends[own] - n - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        out.append(np.packbits(bits | np.repeat(first > least[own], n)).tobytes())
    return out


def _by_bucket(answer: Callable[[pa.Table], pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole buckets of a partition that is sorted by bucket, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            at, buckets = 0, batch.column("bucket").to_numpy()
            for cut in [*(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]:
                if cut == at:
                    continue
                if held and held[-1].column("bucket")[0].as_py() != buckets[at]:
                    yield from answer(pa.Table.from_batches(held)).to_batches()
                    held = []
                held.append(batch.slice(at, cut - at))
                at = cut
        if held:
            yield from answer(pa.Table.from_batches(held)).to_batches()

    return run


def _share(table: pa.Table) -> pa.Table:
    """Which of the chunks' anchors two documents have, and which very many chunks."""
    keys = [np.frombuffer(k, np.uint32) for k in table.column("keys").to_pylist()]
    flags = [np.unpackbits(np.frombuffer(f, np.uint8), count=2 * len(k)).astype(bool).reshape(2, -1) for f, k in zip(table.column("flags").to_pylist(), keys, strict=True)]
    every = np.sort(np.concatenate(keys))
    twice = np.unique(every[1:][every[1:] == every[:-1]])  # a chunk has each anchor once
    often = np.unique(every[HOT_CHUNKS:][every[HOT_CHUNKS:] == every[: len(every) - HOT_CHUNKS]]) if len(every) > HOT_CHUNKS else every[:0]
    often = np.unique(np.concatenate([often, *(k[many] for k, (_, many) in zip(keys, flags, strict=True))]))
    masks = []
    for k, (several, _) in zip(keys, flags, strict=True):
        masks.append(np.packbits(np.concatenate([several | _among(k, twice), _among(k, often)])).tobytes())
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "mask": pa.array(masks, pa.binary())})


def _among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys if len(some) else np.zeros(len(keys), bool)


def _search(table: pa.Table) -> pa.Table:
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "mask": table.column("mask"), "bits": pa.array(search_bucket(table.column("blob").to_pylist()), pa.binary())})


def _tidied(step: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    def run(*tables: pa.Table) -> pa.Table:
        out = step(*tables)
        release()
        return out

    return run


def find(docs: DataFrame, keep: bool = False) -> DataFrame:
    """Of every row: doc_id, n_bytes, the byte spans to remove (start, end, ...), the digest of what stays, and with ``keep`` those bytes.

    A null text is empty. A null id is after all others, and rows with equal ids, or without one, take nothing from
    each other; rows alike in id and text are judged alike, and if there are very many of them, once. A long text is in a chunk
    whole. An empty table gives an empty one; other columns stay behind, whatever their names.
    """
    rows = keyed_texts(docs).withColumn("copies", F.lit(1).cast("long"))
    key = [F.xxhash64("doc_id", "text").alias("key_a"), F.xxhash64(F.lit("b"), "text", "doc_id").alias("key_b")]
    alike = stored(rows.select(*key).groupBy("key_a", "key_b").agg(F.count("*").alias("alike")).where(F.col("alike") > ALIKE))
    if not alike.isEmpty():
        each = rows.select(*key, "doc_id", "text")
        one = each.join(alike, ["key_a", "key_b"]).groupBy("key_a", "key_b").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("alike").alias("copies"))
        rows = each.join(alike, ["key_a", "key_b"], "left_anti").withColumn("copies", F.lit(1).cast("long")).unionByName(one).drop("key_a", "key_b")
        rows = stored(rows)
    chunks = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(total_bytes(rows, "text") / CHUNK))
    bits = min(max(math.ceil(math.log2(chunks)) + 2, BUCKET_BITS[0]), BUCKET_BITS[1])
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    schema = "doc_id long, copies long, n_bytes long, spans array<long>, kept_sha256 string" + ", kept binary" * keep

    def anchors(table: pa.Table) -> pa.Table:
        chunk = Chunk(table, bits)
        several, many, number = chunk.several(), chunk.many(), table.column("chunk")[0].as_py()
        buckets, at = np.unique(chunk.bucket, return_index=True)
        parts = list(zip(at.tolist(), [*at[1:].tolist(), len(chunk.bucket)], strict=True)) if len(at) else []
        keys = [chunk.shorts[a:b].astype(np.uint32).tobytes() for a, b in parts]
        flags = [np.packbits(np.concatenate([several[a:b], many[a:b]])).tobytes() for a, b in parts]
        return pa.table({"chunk": pa.array([number] * len(parts), pa.int32()), "bucket": pa.array(buckets, pa.int32()), "keys": pa.array(keys, pa.binary()), "flags": pa.array(flags, pa.binary())})

    def masks(table: pa.Table) -> dict[int, bytes]:
        return {b: m for b, m in zip(table.column("bucket").to_pylist(), table.column("mask").to_pylist(), strict=True) if m is not None}

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        shared = masks(answers)
        found = Chunk(table, bits).contents(shared)
        # single windows of hot anchors go to buckets of their own, from which there is no mask
        buckets, out = sorted({*shared, *np.unique(found.bucket).tolist()}), []
        for b in buckets:
            x, y = np.searchsorted(found.bucket, [b, b + 1]).tolist()
            out.append(_pack(found.texts[x:y], found.short[x:y], found.first[x:y]))
        number = pa.array([table.column("chunk")[0].as_py()] * len(buckets), pa.int32())
        return pa.table({"chunk": number, "bucket": pa.array(buckets, pa.int32()), "mask": pa.array([shared.get(b) for b in buckets], pa.binary()), "blob": pa.array(out, pa.binary())})

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(table, bits)
        found = chunk.contents(masks(answers))
        sizes = np.fromiter(map(len, found.texts), np.int64, len(found.texts)) - LENGTH + 1
        ends = np.cumsum(sizes)
        earlier = np.zeros(int(sizes.sum()), bool)
        for b, bits_of in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True):
            x, y = np.searchsorted(found.bucket, [b, b + 1]).tolist()
            if y > x:
                low, high = int(ends[x] - sizes[x]), int(ends[y - 1])
                earlier[low:high] = np.unpackbits(np.frombuffer(bits_of, np.uint8), count=high - low)
        edge = np.zeros(len(chunk.data) + 1, np.int32)
        content, size, start = found.which, found.size, found.start
        # a later document of the chunk has nothing of a content that its first one lacks
        whole = chunk.order[found.doc] > found.first[content]
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        gone = np.repeat(whole, size) | earlier[np.repeat(ends[content] - sizes[content], size) + inside]
        place = (np.repeat(start, size) + inside)[gone]
        np.add.at(edge, place, 1)
        np.add.at(edge, place + LENGTH, -1)
        covered = np.cumsum(edge)[:-1] > 0
        raw, spans, digests, kept = chunk.data, [], [], []
        for a, b in zip(chunk.offsets.tolist(), chunk.offsets[1:].tolist(), strict=False):
            own = covered[a:b]
            change = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
            rest = raw[a:b][~own].tobytes() if len(change) else raw[a:b].tobytes()
            spans.append(change)
            digests.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in spans])]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *spans]), pa.int64()))
        columns = {"doc_id": pa.array(chunk.ids, pa.int64()), "copies": table.column("copies"), "n_bytes": pa.array(np.diff(chunk.offsets)), "spans": lists, "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(columns | ({"kept": pa.array(kept, pa.binary())} if keep else {}))

    def to_buckets(rows: DataFrame, answer: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
        return to_python(rows.repartition("bucket").sortWithinPartitions("bucket", "chunk"), _by_bucket(answer), schema)

    grouped = rows.groupBy("chunk")
    sent = grouped.applyInArrow(lambda rows: _tidied(anchors)(rows), "chunk int, bucket int, keys binary, flags binary")
    shared = to_buckets(sent, _share, "chunk int, bucket int, mask binary")
    runs = grouped.cogroup(shared.groupBy("chunk")).applyInArrow(lambda rows, more: _tidied(send)(rows, more), "chunk int, bucket int, mask binary, blob binary")
    answers = to_buckets(runs, _search, "chunk int, bucket int, mask binary, bits binary")
    found = grouped.cogroup(answers.groupBy("chunk")).applyInArrow(lambda rows, more: _tidied(cut)(rows, more), schema)
    return repeated(found, "copies", "number").drop("copies", "number") if not alike.isEmpty() else found.drop("copies")


def report(docs: DataFrame) -> DataFrame:
    """The counts beside the digest."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: x - n)  # ends less starts: signs alternate
    return find(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), "kept_sha256")


#: The query's rows in plain SQL.
ORACLE = r"""
WITH doc AS (
    SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents
), place AS (
    SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM doc WHERE n >= 50
), gram AS (
    SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM place
), first AS (
    SELECT g, min(doc_id) AS least FROM gram GROUP BY g HAVING min(doc_id) < max(doc_id)
), hit AS (
    SELECT gram.doc_id, gram.i FROM gram JOIN first ON first.g = gram.g WHERE first.least < gram.doc_id
), step AS (
    SELECT doc_id, i, CASE WHEN lag(i) OVER (PARTITION BY doc_id ORDER BY i) >= i - 50 THEN 0 ELSE 1 END AS opens FROM hit
), numbered AS (
    SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM step
), span AS (
    SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, span
), edge AS (
    SELECT doc_id, a, b, lag(b) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM span
), kept AS (
    SELECT e.doc_id, string_agg(substr(d.h, 2 * coalesce(e.before, 0) + 1, 2 * (e.a - coalesce(e.before, 0))), '' ORDER BY e.a) AS head, max(e.b) AS last, sum(e.b - e.a) AS removed, count(*) AS spans
    FROM edge e JOIN doc d ON d.doc_id = e.doc_id GROUP BY e.doc_id
)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(k.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(coalesce(k.head, '') || substr(d.h, 2 * coalesce(k.last, 0) + 1))) AS kept_sha256
FROM doc d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
