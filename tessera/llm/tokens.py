"""Token ids in ORC files.

Texts go to range partitions in ascending id order and are encoded there; each partition becomes one file of
ORC stripes: ids under integer run-length encoding, a row index every ``STRIDE`` rows and a Bloom filter on the
document ids, so that a reader can take stripes in parallel and skip by metadata.

The tokenizer's file is read on the driver, and its text goes to the tasks as part of the function.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, blocks, flat, keyed_texts, mix, shared_folder, to_python

END_ID = 2
STRIDE = 1000
STRIPE_BYTES = 16 << 20
#: Pieces whose ids a worker remembers; beyond it only those that came up twice or more stay.
CACHE = 500_000
#: Unknown pieces that are encoded as one string.
JOINED = 2000
FILE_SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"

#: A piece is a run of white space and the run of other bytes after it. The tokenizer's own rule never crosses from a
#: character to the white space after it, so a text's ids are its pieces' ids in turn. That holds for this white space:
_BLANK = b" \t\n\r\f\v"
#: A text with any other goes to the tokenizer whole.
_ODD = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_ODD_FIRST = np.isin(np.arange(256), [0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3])


#: How the byte-level vocabulary spells space, tab, line feed, vertical tab, form feed, carriage return.
_SPACE_SIGNS = ("Ġ", "ĉ", "Ċ", "ċ", "Č", "č")


class _Table:
    """Numbers of pieces. Pieces of at most 16 bytes are found all at once: their first and last eight bytes and their length are the piece."""

    def __init__(self):
        self.long: dict[bytes, int] = {}
        self.first, self.last, self.size = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.number = np.zeros(0, np.int64)
        self.slots = np.full(1 << 16, -1, np.int32)

    def _home(self, first: np.ndarray, last: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (mix(first + last * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64)) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, first: np.ndarray, last: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of the pieces, -1 for those not known."""
        found, on, at = np.full(len(first), -1), np.arange(len(first)), self._home(first, last, size)
        while len(on):
            entry = self.slots[at]
            full = entry >= 0
            on, at, entry = on[full], at[full], entry[full]
            same = (self.first[entry] == first[on]) & (self.last[entry] == last[on]) & (self.size[entry] == size[on])
            found[on[same]] = self.number[entry[same]]
            on, at = on[~same], (at[~same] + 1) & (len(self.slots) - 1)
        return found

    def add(self, first: np.ndarray, last: np.ndarray, size: np.ndarray, number: np.ndarray) -> None:
        """Take in distinct pieces that are not there yet."""
        entry = np.arange(len(self.first), len(self.first) + len(first))
        for name, more in (("first", first), ("last", last), ("size", size), ("number", number)):
            setattr(self, name, np.concatenate([getattr(self, name), more]))
        if 2 * len(self.first) > len(self.slots):
            self.slots = np.full(1 << (4 * len(self.first)).bit_length(), -1, np.int32)
            entry = np.arange(len(self.first))
        at = self._home(self.first[entry], self.last[entry], self.size[entry])
        while len(entry):
            free = self.slots[at] < 0
            self.slots[at[free]] = entry[free]  # of those that want one slot, one gets it
            left = self.slots[at] != entry
            entry, at = entry[left], (at[left] + 1) & (len(self.slots) - 1)


class Encoder:
    """The tokenizer with its pieces' ids remembered."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        parts = json.loads(spec)
        self.special = [t["content"].encode() for t in parts.get("added_tokens") or []]
        pre = parts.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not parts.get("normalizer")
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.begins_blank = np.array([n.startswith(_SPACE_SIGNS) for n in names])
        self.ends_blank = np.array([n.endswith(_SPACE_SIGNS) for n in names])
        self.table = _Table()
        self.ids, self.starts, self.lengths, self.uses = (np.zeros(0, t) for t in (np.int32, np.int64, np.int64, np.int64))

    def _trim(self) -> None:
        """Forget pieces that came up once; if too many are left, all."""
        keep = self.uses > 1
        if keep.sum() > CACHE // 2:
            keep[:] = False
        moved = np.cumsum(keep) - 1
        old, self.table = self.table, _Table()
        stay = keep[old.number]
        self.table.add(old.first[stay], old.last[stay], old.size[stay], moved[old.number[stay]])
        self.table.long = {p: int(moved[n]) for p, n in old.long.items() if keep[n]}
        lengths, starts = self.lengths[keep], self.starts[keep]
        at = np.cumsum(lengths) - lengths
        self.ids = self.ids[np.repeat(starts - at, lengths) + np.arange(int(lengths.sum()))]
        self.starts, self.lengths, self.uses = at, lengths, np.ones(len(lengths), np.int64)

    def _encode(self, items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the items, end to end, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast([i.decode() for i in items], add_special_tokens=False)]
        return np.array([i for f in found for i in f], np.int32), np.fromiter(map(len, found), np.int64, len(found))

    def _encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that begin with white space and don't end with it: joined, they are a text that falls into them again."""
        ids = self._encode([b"".join(pieces[i : i + JOINED]) for i in range(0, len(pieces), JOINED)])[0]
        begins = self.begins_blank[ids]
        begins[1:] &= ~self.ends_blank[ids[:-1]]
        heads = np.flatnonzero(begins)
        if len(heads) != len(pieces):  # an unusual vocabulary
            return self._encode(pieces)
        return ids, np.diff(np.append(heads, len(ids)))

    def _learn(self, items: list[bytes], whole: int) -> None:
        """Remember the ids of new pieces, the last ``whole`` of which are texts."""
        joins = np.array([p[:1] in _BLANK and p[-1:] not in _BLANK for p in items], bool)
        joins[len(items) - whole :] = False
        starts, lengths = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
        for some, encode in ((np.flatnonzero(joins), self._encode_pieces), (np.flatnonzero(~joins), self._encode)):
            if len(some):
                ids, n = encode([items[i] for i in some.tolist()])
                lengths[some], starts[some] = n, len(self.ids) + np.cumsum(n) - n
                self.ids = np.concatenate([self.ids, ids])
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
        self.uses = np.concatenate([self.uses, np.zeros(len(items), np.int64)])

    def _whole(self, data: bytes, offsets: np.ndarray) -> np.ndarray:
        """Texts that can't be cut into pieces."""
        if not self.by_piece:
            return np.flatnonzero(np.diff(offsets) > 0)
        at = []
        for k in np.unique(np.searchsorted(offsets, np.flatnonzero(_ODD_FIRST[np.frombuffer(data, np.uint8)]), "right") - 1).tolist():
            at += [m.start() + int(offsets[k]) for m in [_ODD.search(data[offsets[k] : offsets[k + 1]])] if m]
        for special in self.special:
            at += [m.start() for m in re.finditer(re.escape(special), data)]
        return np.unique(np.searchsorted(offsets, np.array(at, np.int64), "right") - 1)

    def __call__(self, data: np.ndarray, offsets: np.ndarray, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts in UTF-8, end to end, each text's followed by the end id, and the n + 1 offsets of the texts' ids."""
        if len(self.starts) > CACHE:
            self._trim()
        raw, n = data.tobytes(), len(data)
        whole = self._whole(raw, offsets)
        blank = SPACE[data]
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        for k in whole.tolist():
            begins[offsets[k] + 1 : offsets[k + 1]] = False
        start = np.flatnonzero(begins)
        size = np.diff(np.append(start, n))
        counts = np.searchsorted(start, offsets)

        number = np.full(len(start), -1)
        whole_at = np.searchsorted(start, offsets[whole])
        short = size <= 16
        short[whole_at] = False
        some = np.flatnonzero(short)
        eight = np.ndarray((n + 1,), "<u8", raw + b"\0" * 8, strides=(1,))  # the eight bytes from each byte on
        few = np.minimum(size[some], 8)
        first = eight[start[some]] & (np.uint64(2**64 - 1) >> (np.uint64(64) - few.astype(np.uint64) * np.uint64(8)))
        last = np.where(size[some] > 8, eight[np.maximum(start[some] + size[some] - 8, 0)], np.uint64(0))
        number[some] = self.table.find(first, last, size[some])
        rest = np.flatnonzero(number[some] < 0)
        new: dict[bytes, int] = {}
        base = len(self.starts)
        piece = lambda i: raw[start[i] : start[i] + size[i]]
        if len(rest):
            at, to = start[some[rest]].tolist(), (start[some[rest]] + size[some[rest]]).tolist()
            which = np.fromiter((new.setdefault(raw[x:y], len(new)) for x, y in zip(at, to, strict=True)), np.int64, len(rest))
            number[some[rest]] = base + which
            head = np.full(len(new), -1)
            head[which[::-1]] = rest[::-1]
            self.table.add(first[head], last[head], size[some[head]], base + np.arange(len(new)))
        others = short
        others[whole_at] = True
        for i in np.flatnonzero(~others).tolist():
            p = piece(i)
            if (k := self.table.long.get(p)) is None:
                k = self.table.long[p] = base + new.setdefault(p, len(new))
            number[i] = k
        number[whole_at] = base + len(new) + np.arange(len(whole))
        if items := [*new, *(raw[offsets[k] : offsets[k + 1]] for k in whole.tolist())]:
            self._learn(items, len(whole))

        self.uses += np.bincount(number, minlength=len(self.uses))
        lengths = self.lengths[number]
        total = np.concatenate([[0], np.cumsum(lengths)])
        tokens = total[counts]
        source = np.repeat(self.starts[number] - total[:-1], lengths) + np.arange(int(total[-1]))
        # the end id stands after the last id of each text
        return np.insert(self.ids[source], tokens[1:], np.int32(end)), tokens + np.arange(len(offsets))


_ENCODERS: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """This worker's encoder for a tokenizer; it outlives a task."""
    if spec not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[spec] = Encoder(spec)
    return _ENCODERS[spec]


def write(docs: DataFrame, spec: str, path: str, end: int = END_ID) -> None:
    """Encode every text (null: empty) and write the ids as ORC, in ascending order of the document ids.

    A null id comes first; ties go by a hash of the text, then the text; rows that repeat are each encoded; a long text
    is encoded whole, in one row; an empty table has files without rows; other columns stay behind, whatever their names.
    """
    rows = keyed_texts(docs)
    # the driver samples the keys to deal by, so they hold no text; rows alike in id and text have numbers, so that no file has to take all of them
    tie = F.xxhash64("text")
    numbered = rows.withColumn("number", F.monotonically_increasing_id())
    ordered = numbered.repartitionByRange("doc_id", tie, "number").drop("number").sortWithinPartitions("doc_id", tie, "text").withColumn("part", F.spark_partition_id())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, before = encoder(spec), 0
        for block in blocks(batches):
            ids, offsets = encode_all(*flat(block.column("text")), end)
            column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("part"), pa.array(before + offsets[:-1]), pa.array(np.diff(offsets)), column], names=[c.split()[0] for c in FILE_SCHEMA.split(", ")])
            before += int(offsets[-1])

    writer = to_python(ordered, encode, FILE_SCHEMA).write.option("compression", "lz4")
    for key, value in (("stripe.size", STRIPE_BYTES), ("row.index.stride", STRIDE), ("create.index", "true"), ("bloom.filter.columns", "doc_id"), ("bloom.filter.fpp", 0.01)):
        writer = writer.option(f"orc.{key}", value)
    writer.orc(path)


def read(spark, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).orc(path)


def digest(files: DataFrame) -> DataFrame:
    """Of each document in the files: where its ids start in the whole sequence, how many, and their checksum.

    What stands before a part is the sum of a table with one row for each file.
    """
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = F.sum("tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("ids")
            values = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False))
            ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64)
            view, at = memoryview(values).cast("B"), (4 * ends).tolist()
            crc = [zlib.crc32(view[i:j]) for i, j in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("local_start"), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    rows = to_python(files.select("doc_id", "part", "local_start", "ids"), sums, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_digest(docs: DataFrame, spec: str, path: str | None = None) -> DataFrame:
    """Write the files, then describe every document from them: a row for each row of ``docs``, odd ones as in ``write``."""
    path = path or shared_folder(docs.sparkSession)
    write(docs, spec, path)
    return digest(read(docs.sparkSession, path))


def public_spec(name: str = "byte_bpe_50k.json") -> str:
    """The text of one of the public tokenizers' files."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()
