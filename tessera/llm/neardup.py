"""Near duplicates: MinHash bands find candidates, odd sketches sift them, full shingle sets decide.

1. Every text gets its set of five-word shingles as 64-bit hashes, and from it a 128-bit name. Texts of equal
   sets have one name and are one node from here on, so a group of copies costs one row however large it is.
2. ``BANDS`` bands of ``ROWS`` MinHash values give each node its buckets.
3. A second kind of MinHash sample, the least hash in each of ``BINS`` ranges, is folded into a bitmap of
   parities, an odd sketch. The population count of two sketches' XOR estimates by how many samples the
   sets differ, closely so for sets that differ little. A pair goes on unless its estimate is ``SIGMAS``
   standard deviations below the limit.
4. A bucket gives a spanning forest of its candidate pairs, the most similar first, so it gives fewer pairs than
   it has nodes. The forests' components are clusters: a linked pair never lies in two.
5. The full sets of a cluster's nodes meet in one place and are compared there, again only where the sketches
   allow it and the nodes are not linked yet. What goes on are the links that join something, again fewer than
   there are nodes. Their components are the result.

A bucket or cluster that is too large for a task is dealt to blocks, together with a few of its nodes that go to all of
its blocks and so tie together what is alike in different ones. What is not joined to the group's largest component after
that meets, block by block, all nodes of the group; the largest component's nodes need not meet each other any more. Only
names and sketches go to buckets; sets are gathered for the nodes that have a candidate, and once more for those of large clusters that are not one component yet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, byte_texts, forget, joined, keyed_texts, mix, multipliers, scratch, stored, to_python
from .components import components

SHINGLE = 5
#: Texts are linked from this many hundredths of similarity.
LIMIT = 85
BANDS, ROWS = 20, 4
BINS = 1024
BITS = 1024
SIGMAS = 6.0
#: Nodes of a bucket's block, and shingles of a cluster's.
BLOCK_NODES = 4096
BLOCK_SHINGLES = 2_000_000
#: Of a group of several blocks, one node in so many times the number of its blocks goes to all of them: a small part of a block.
PIVOTS = 16
#: A table of at most so many ids is sent to all tasks; a larger one is shuffled.
BROADCAST_ROWS = 500_000
#: Words whose hashes a worker remembers.
CACHE = 200_000

#: Bytes with ASCII letters in lower case.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_A, _B = multipliers(BANDS * ROWS, 11), multipliers(BANDS * ROWS, 12)
_TERMS = multipliers(SHINGLE, 5)
SIGNATURE = "doc_id long, text_a long, text_b long, n_shingles long, node binary, bands array<long>, n_samples int, sketch binary"


class WordHashes(dict):
    """64-bit hashes of words, the same in every process."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingle_sets(texts: list[bytes], hashes: WordHashes) -> Iterator[np.ndarray]:
    """Each text's set of shingles, sorted; a text of fewer words is one shingle, one without words has none."""
    if len(hashes) > CACHE:
        hashes.clear()
    for t in texts:
        words = t.translate(_LOWER).split()
        if not words:
            yield np.zeros(0, np.uint64)
            continue
        h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - SHINGLE + 1)
        total = np.full(n, min(len(h), SHINGLE), np.uint64)
        for j in range(min(len(h), SHINGLE)):
            total += h[j : j + n] * _TERMS[j]
        yield np.unique(mix(total))


def _least(s: np.ndarray) -> np.ndarray:
    """MinHash values of a set."""
    found = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 512):  # small tables stay in the cache
        np.minimum(found, (s[i : i + 512, None] * _A + _B).min(0), out=found)
    return found


def odd_sketch(s: np.ndarray) -> tuple[int, bytes]:
    """Number of samples of a sorted set, and the parities of how many fall on each bit."""
    bins = s >> np.uint64(64 - (BINS.bit_length() - 1))
    first = s[np.concatenate([[True], bins[1:] != bins[:-1]])] if len(s) else s
    at = (mix(first ^ np.uint64(0x5EED)) % np.uint64(BITS)).astype(np.int64)
    return len(first), np.packbits(np.bincount(at, minlength=BITS).astype(np.uint8) & 1).tobytes()


def signatures(docs: DataFrame) -> DataFrame:
    """Of every row its id, two hashes of its text, and set size, name, bands, samples and sketch; no name where there is no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for block in blocks(batches):
            sizes, names, bands, samples, sketches = [], [], [], [], []
            for s in shingle_sets(byte_texts(block.column("text")), hashes):
                sizes.append(len(s))
                names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                rows = _least(s).reshape(BANDS, ROWS)
                bands.append(mix((mix(rows) * _TERMS[:ROWS]).sum(1, dtype=np.uint64)).view(np.int64) if len(s) else np.zeros(0, np.int64))
                n, sketch = odd_sketch(s)
                samples.append(n)
                sketches.append(sketch)
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bands)))
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in ("doc_id", "text_a", "text_b")), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), keys, pa.array(samples, pa.int32()), pa.array(sketches, pa.binary())], names=[c.split()[0] for c in SIGNATURE.split(", ")])

    return to_python(keyed_texts(docs).select("*", *_text_key(F.col("text"))), run, SIGNATURE)


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("text_a"), F.xxhash64(F.lit("b"), text).alias("text_b")]


def _estimates(x: np.ndarray, y: np.ndarray, samples_x: np.ndarray, samples_y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of sketch x to each sketch y, and whether the pair may reach the limit."""
    apart = np.bitwise_count(x ^ y).sum(1).astype(float)
    limit = LIMIT / 100
    differ = -BITS / 2 * np.log1p(-2 * np.minimum(apart, BITS / 2 - 1) / BITS)
    small, large = np.minimum(samples_x, samples_y), np.maximum(samples_x, samples_y)
    same = (samples_x + samples_y - differ) / 2
    similarity = np.clip(same / np.maximum(large, 1), 0, 1)
    # at the limit: error of the samples, less as they are most of the set, and of the sketch
    union = (n_x + n_y) / (1 + limit)
    sampled = np.minimum(large / np.maximum(union, 1), 1)
    at = 2 * large * (1 - limit) / (1 + limit)
    noise = np.maximum(BITS / 4 * np.expm1(4 * at / BITS) - at, 1) / 4 / np.maximum(small, 1) ** 2
    sigma = np.sqrt(limit * (1 - limit) / np.maximum(large, 1) * np.maximum(1 - sampled, 0.02) + noise)
    lengths = np.minimum(n_x, n_y) * 100 >= LIMIT * np.maximum(n_x, n_y)
    return similarity, lengths & (similarity >= limit - SIGMAS * sigma - 2 / np.maximum(small, 1))


class _Group:
    """The nodes of buckets, as arrays; in a bucket they stand by set size."""

    def __init__(self, rows: pa.RecordBatch | pa.Table):
        column = lambda c: rows.column(c).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column(c).to_numpy()
        self.bucket = [column(c) for c in ("band", "key", "i", "j")]
        self.n, self.samples, self.chunk = column("n").astype(float), column("samples").astype(float), column("chunk")
        self.cross = self.bucket[2] != self.bucket[3]
        self.root = column("root")
        self.node = column("node")
        self.sketch = np.frombuffer(b"".join(column("sketch")), np.uint64).reshape(len(self.n), -1)

    def candidates(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of pairs of rows, and which of them to look at."""
        similarity, may = _estimates(self.sketch[a], self.sketch[b], self.samples[a], self.samples[b], self.n[a], self.n[b])
        may &= ~self.cross[a] | (self.chunk[a] != self.chunk[b])
        return similarity, may & ((self.root[a] < 0) | (self.root[a] != self.root[b]))

    def forest(self, start: int, end: int) -> list[tuple[int, int]]:
        """A spanning forest of a bucket's candidates, the most similar pairs first (Prim); memory in proportion to its nodes."""
        best, near, out = np.full(end - start, -1.0), np.zeros(end - start, int), []
        open_ = np.ones(end - start, bool)
        for _ in range(end - start):
            k = int(np.argmax(np.where(open_, best, -2.0)))
            if best[k] >= 0:
                out.append((start + int(near[k]), start + k))
            open_[k] = False
            others = np.flatnonzero(open_)
            similarity, may = self.candidates(np.full(len(others), start + k), start + others)
            better = others[may & (similarity > best[others])]
            near[better] = k
            best[better] = similarity[may & (similarity > best[others])]
        return out


def _pairs_of(rows: pa.Table) -> pa.RecordBatch:
    """Spanning forests of whole buckets."""
    group = _Group(rows)
    starts, ends = _bounds(group.bucket)
    two = starts[ends - starts == 2]
    two = two[group.candidates(two, two + 1)[1]]
    pairs = list(zip(two.tolist(), (two + 1).tolist(), strict=True))
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a > 2:
            pairs += group.forest(a, b)
    return _named(group.node, pairs)


def _named(nodes: np.ndarray, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    names = [sorted((nodes[x], nodes[y])) for x, y in pairs]
    return pa.RecordBatch.from_arrays([pa.array([n[k] for n in names], pa.binary()) for k in (0, 1)], names=["a", "b"])


def _bounds(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First rows of the groups of rows alike, and the rows after their last."""
    starts = np.concatenate([[0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1])
    return starts, np.append(starts[1:], len(columns[0]))


def _by_group(rows: DataFrame, key: list[str], order: list[str], answer: Callable[[pa.Table], pa.RecordBatch]) -> DataFrame:
    """Pairs from groups of rows. A partition's groups come in order, and ``answer`` gets some whole groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in key):
                yield answer(pa.Table.from_batches(held).combine_chunks())
                held = []
            last = int(_bounds([batch.column(c).to_numpy(zero_copy_only=False) for c in key])[0][-1])
            if last:
                yield answer(pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks())
                held = []
            held.append(batch.slice(last))
        if held:
            yield answer(pa.Table.from_batches(held).combine_chunks())

    return to_python(rows.repartition(*key).sortWithinPartitions(*key, *order), run, "a binary, b binary").distinct()


_GROUP = ["band", "key"]
_BLOCK = [*_GROUP, "i", "j"]


def _own_blocks(members: DataFrame) -> DataFrame:
    """Rows dealt to blocks (i, i) of their groups; ``chunks`` is the number of blocks. Some few go to all blocks."""
    chunk, chunks = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"), F.col("chunks")
    pivot = (chunks > 1) & (F.pmod(F.xxhash64(F.lit("pivot"), "node"), chunks * PIVOTS) == 0)
    at = F.when(pivot, F.sequence(F.lit(0), (chunks - 1).cast("int"))).otherwise(F.array(chunk))
    dealt = members.withColumns({"chunk": chunk, "root": F.lit(-1).cast("long"), "i": at})
    return dealt.withColumn("i", F.explode("i")).withColumn("j", F.col("i")).drop("chunks")


def _other_blocks(members: DataFrame, roots: DataFrame, weight: Column, size: int) -> DataFrame:
    """Rows dealt to pairs of blocks i <= j of their groups, i one of those rows that are not of the group's largest component by weight."""
    placed = members.join(roots, "node", "left")
    parts = placed.groupBy(*_GROUP, "root").agg(F.sum(weight).alias("weight"))
    best = F.max(F.when(F.col("root").isNotNull(), F.struct("weight", "root"))).alias("best")
    groups = parts.groupBy(*_GROUP).agg(F.sum("weight").alias("weight"), best)
    left = F.ceil((F.col("weight") - F.coalesce(F.col("best.weight"), F.lit(0))) / size).cast("int")
    groups = stored(groups.select(*_GROUP, F.col("best.root").alias("core"), left.alias("left")).where("left > 0"))
    dealt = placed.join(groups, _GROUP).withColumn("is_core", F.coalesce(F.col("root") == F.col("core"), F.lit(False)))
    hashed, chunks = F.xxhash64("node"), F.col("chunks").cast("int")
    chunk = F.when(F.col("is_core"), F.col("left") + F.pmod(hashed, chunks)).otherwise(F.pmod(hashed, F.col("left"))).cast("int")
    dealt = dealt.withColumns({"chunk": chunk, "root": F.coalesce("root", F.lit(-1).cast("long"))})
    last = F.when(F.col("is_core"), F.col("left")).otherwise(F.col("left") + chunks) - 1
    others = F.transform(F.sequence(F.lit(0), last), lambda x: F.struct(F.least(x, "chunk").alias("i"), F.greatest(x, "chunk").alias("j")))
    return dealt.withColumn("at", F.explode(others)).withColumns({"i": F.col("at.i"), "j": F.col("at.j")}).drop("at", "chunks", "core", "left", "is_core")


def _joining(groups: DataFrame, members: Callable[[DataFrame], DataFrame], nodes: DataFrame, weight: Column, size: int, answer: Callable[[pa.Table], pa.RecordBatch]) -> DataFrame:
    """Pairs (a, b) that join the groups' nodes, as ``answer`` finds them. ``groups`` has the number of blocks, of ``size`` by weight, that each needs."""
    first = stored(_by_group(_own_blocks(members(groups)), _BLOCK, ["n", "node"], answer))
    large = groups.where("chunks > 1")
    if large.isEmpty():
        return first
    with scratch(nodes.sparkSession) as keep:
        ends = _ends(first, nodes)
        rest = _other_blocks(members(large), _components(first, ends), weight, size)
        pairs = stored(first.unionByName(_by_group(rest, _BLOCK, ["n", "node"], answer)).distinct())
        keep.append(pairs)
    forget(first)
    return pairs


def _links_of(rows: pa.Table) -> pa.RecordBatch:
    """Links of whole clusters (or of two blocks of one) that join their nodes."""
    group = _Group(rows)
    sets = [np.frombuffer(s, np.uint64) for s in rows.column("shingles").to_pylist()]
    pairs: list[tuple[int, int]] = []
    for a, b in zip(*(x.tolist() for x in _bounds(group.bucket)), strict=True):
        if b - a > 1:
            pairs += _confirmed(group, sets, a, b)
    return _named(group.node, pairs)


def _confirmed(group: _Group, sets: list[np.ndarray], start: int, end: int) -> list[tuple[int, int]]:
    """A spanning forest of a cluster's links, by full sets. Each node is compared at once with all that come into question."""
    sizes = np.array([len(s) for s in sets[start:end]])
    flat = np.unique(np.concatenate(sets[start:end]), return_inverse=True)[1]
    first = np.cumsum(sizes) - sizes
    own = np.zeros(int(flat.max()) + 1, bool)
    root, each = group.root[start:end], np.arange(end - start)
    label = np.unique(np.where(root < 0, -1 - each, root), return_inverse=True)[1]
    reach = np.searchsorted(sizes, sizes * (100 / LIMIT), "right")  # nodes stand by size
    out = []
    for k in range(end - start - 1):
        others = np.arange(k + 1, reach[k])
        others = others[label[others] != label[k]]
        if len(others):
            others = others[group.candidates(np.full(len(others), start + k), start + others)[1]]
        if not len(others):
            continue
        mine = flat[first[k] : first[k] + sizes[k]]
        own[mine] = True
        n = sizes[others]
        heads = np.cumsum(n) - n
        shared = np.add.reduceat(own[flat[np.repeat(first[others] - heads, n) + np.arange(int(n.sum()))]], heads, dtype=np.int64)
        own[mine] = False
        for o in others[100 * shared >= LIMIT * (n + sizes[k] - shared)].tolist():
            if label[o] != label[k]:
                out.append((start + k, start + o))
                label[label == label[o]] = label[k]
    return out


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted nodes, each from a text with the node's smallest id."""
    ids = wanted.select(F.col("doc_id").alias("of_id")).distinct()
    if wanted.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    some = keyed_texts(docs)
    some = some.join(ids, some.doc_id.eqNullSafe(F.col("of_id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for block in blocks(batches):
            found = [s.tobytes() for s in shingle_sets(byte_texts(block.column("text")), hashes)]
            names = [hashlib.blake2b(s, digest_size=16).digest() if s else None for s in found]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(found, pa.binary())], names=["node", "shingles"])

    rows = to_python(some, run, "node binary, shingles binary").join(wanted.select("node"), "node", "left_semi")
    return rows.dropDuplicates(["node"])


def _ends(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs' nodes with numbers in the order of their smallest ids, those without any last."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = nodes.select("node", "doc_id").join(ends, "node", "left_semi")
    by = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("node")]
    return stored(wanted.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("vertex", F.monotonically_increasing_id()))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows' signatures, and (node, component_id, leader) of every node; leader names the component's first node."""
    rows = stored(signatures(docs))
    one = lambda c: F.first(c).alias(c)  # noqa: E731  the same for all rows of a node
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.max("n_samples").alias("samples"), one("bands"), one("sketch"))
    # buckets hold nodes by number, which takes less room than a name in the rows that are shuffled most; the number is the table's, made once
    nodes = stored(nodes.withColumn("number", F.monotonically_increasing_id()))
    about = nodes.select("node", "n", "samples", "sketch")
    member = nodes.select("number", F.posexplode("bands").alias("band", "key"))
    buckets = member.groupBy(*_GROUP).agg(F.count("*").alias("size")).where("size > 1")
    buckets = stored(buckets.select(*_GROUP, F.ceil(F.col("size") / BLOCK_NODES).alias("chunks")))
    pairs = _joining(buckets, lambda g: member.join(g, _GROUP).join(nodes.select("number", *about.columns), "number").drop("number"), nodes, F.lit(1), BLOCK_NODES, _pairs_of)
    wanted = _ends(pairs, nodes)
    clusters = _components(pairs, wanted)
    sized = clusters.join(about, "node").select(F.lit(0).alias("band"), F.col("root").alias("key"), "node", "n", "samples", "sketch")
    groups = stored(sized.groupBy(*_GROUP).agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("chunks")))

    def with_sets(g: DataFrame) -> DataFrame:
        of = wanted if g is groups else wanted.join(sized.join(g, _GROUP).select("node"), "node", "left_semi")
        return sized.join(g, _GROUP).join(_sets(docs, of), "node")

    links = _joining(groups, with_sets, nodes, F.col("n"), BLOCK_SHINGLES, _links_of)
    found = _components(links, wanted)
    leaders = wanted.select(F.col("vertex").alias("root"), F.col("doc_id").alias("component_id"), F.col("node").alias("leader"))
    named = joined(found, leaders, "root").select(F.col("node").alias("of"), "component_id", "leader")
    every = nodes.select("node", "doc_id").join(named, F.col("node") == F.col("of"), "left")
    # a plain table, so that Spark can split a join in which one node has very many rows
    root = stored(every.select("node", F.when(F.col("leader").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("leader", "node").alias("leader")))
    forget(nodes, buckets, pairs, wanted, clusters, groups, links, found)
    return rows, root


def _components(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, root) of the wanted nodes; a root is the number of a component's first node."""
    ends = links.join(wanted.select(F.col("node").alias("a"), F.col("vertex").alias("u")), "a").join(wanted.select(F.col("node").alias("b"), F.col("vertex").alias("v")), "b")
    root = components(ends.select("u", "v"))
    found = wanted.select("node", "vertex").join(root, "vertex", "left")
    return stored(found.select("node", F.coalesce("root", "vertex").alias("root")))


def link(docs: DataFrame) -> DataFrame:
    """Every row's set size, the smallest id that it reaches over links, and whether that is its own.

    A null or empty text, or one without words, has no shingles and is linked with nothing; a long text has a larger
    set, all of which counts. Rows of equal texts are linked whatever their ids; rows with equal ids each get a row, and each of them
    that has its component's smallest id is kept. A null id is larger than any other; a component of null ids alone has a
    null id, and its rows are kept. An empty table gives an empty one; other columns stay behind, whatever their names.
    """
    rows, root = classes(docs)
    found = rows.select("doc_id", "n_shingles", F.col("node").alias("of")).join(root, F.col("of") == F.col("node"), "left")
    best = F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", best.alias("component_id"), F.coalesce(F.col("doc_id") == best, best.isNull()).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, one of each group: one with its smallest id.

    Rows without words (null, empty) are in no group and stay, also where they repeat; of rows that tie for the smallest id, or repeat, one
    stays; long texts and null ids as in ``link``; columns keep their names, whatever these are; an empty table gives an empty one.
    """
    rows, root = classes(docs)
    key = ["doc_id", "text_a", "text_b"]
    of_group = rows.where("node is not null").select(*key, "node").groupBy(*key, "node").agg(F.count("*").alias("copies")).join(root.select("node", "leader"), "node")
    order = F.struct(F.col("doc_id").isNull().alias("none"), *key)
    heads = stored(of_group.groupBy("leader").agg(F.min(F.struct(*[order[c].alias(c) for c in ("none", *key)])).alias("head")))
    marked = of_group.join(heads, "leader").withColumn("is_head", order == F.col("head"))
    # rows that go, and heads of which one row is enough
    gone = stored(marked.where(~F.col("is_head") | (F.col("copies") > 1)).select(*[F.col(c).alias(f"of_{c}") for c in key], "is_head"))
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    text = F.col("text").cast("string")
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_text_key(text), F.struct(*docs.columns).alias("__row"))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in key]
    stay = held.join(gone, same, "left_anti").select("__row")
    repeated = held.join(gone.where("is_head"), same).groupBy(*key).agg(F.first("__row").alias("__row")).select("__row")
    return stay.unionByName(repeated).select("__row.*")


#: The query's rows in plain SQL.
ORACLE = r"""
WITH RECURSIVE doc AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
    SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc WHERE len(w) > 0) AS places
), size AS (
    SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (
    SELECT x, y FROM shared JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)
), edge AS (
    SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (
    SELECT x AS doc_id, x AS other FROM edge
    UNION
    SELECT r.doc_id, e.y FROM reach r JOIN edge e ON e.x = r.other
), least_reached AS (
    SELECT doc_id, min(other) AS component FROM reach GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, coalesce(r.component, d.doc_id) AS component_id, d.doc_id = coalesce(r.component, d.doc_id) AS kept
FROM doc d LEFT JOIN size s ON s.doc_id = d.doc_id LEFT JOIN least_reached r ON r.doc_id = d.doc_id
"""
