"""Token files against the tokenizer itself, and an exact round trip."""

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import tokens as T
from tessera.llm.common import flat, read

SPEC = T.public_spec()
TOKENIZER = Tokenizer.from_str(SPEC)
ENCODER = T.Encoder(SPEC)


def encode(encoder, texts):
    """Ids of each text."""
    ids, offsets = encoder(*flat(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]


def want(rows):
    """Rows of (doc_id, start, n_tokens, crc), one text at a time."""
    found, start = [], 0
    tie = lambda t: 42 if t is None else (xxhash.xxh64_intdigest(t.encode(), seed=42) + 2**63) % 2**64 - 2**63
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1]))):
        ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]
        found.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return found


@settings(max_examples=300, deadline=None, derandomize=True)
@given(st.lists(st.text(st.sampled_from("ab'sd 12.,\n\t\r\x0b\x1c\x85\xa0　é漢😀<|endoftext|>"), max_size=30), max_size=6))
def test_pieces_are_exact(texts):
    texts = [*texts, None, "a <|endoftext|> b", "don't  stop \n\n now ", "x\xa0 \n y"]
    for t, ids in zip(texts, encode(ENCODER, texts), strict=True):
        assert ids == [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 2]


def test_documents(spark, tmp_path):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    path = str(tmp_path / "orc")
    got = sorted(map(tuple, T.encode_and_digest(docs, SPEC, path).collect()))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got == want(rows)
    back = {r.doc_id: r.ids for r in T.read(spark, path).collect()}
    assert all(TOKENIZER.decode(back[i][:-1], skip_special_tokens=False) == t for i, t in rows)
    assert T.read(spark, path).where("doc_id = 17").count() == 1


def test_odd_rows(spark):
    rows = [(3, "b"), (3, "a"), (3, "a"), (None, "x"), (1, None), (2, ""), (9, "long text " * 50_000), (-5, "neg")]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, part int, ids string")
    assert sorted(map(tuple, T.encode_and_digest(df, SPEC).collect()), key=lambda r: r[1]) == want(rows)
    assert T.encode_and_digest(df.limit(0), SPEC).count() == 0


def test_cache_is_trimmed(monkeypatch):
    """Also with whole texts among the remembered ids, and pieces that come up once or often."""
    monkeypatch.setattr(T, "CACHE", 12)
    e = T.Encoder(SPEC)
    for k in range(30):
        texts = [f"the a{k} b b b{k}", f"the\x85 {k}", None, f" the thing{k} ", "the <|endoftext|>", f"\n\nthe q{k % 3}", f"a word of some length {k} aword-of-more-than-sixteen-bytes{k % 2}"]
        for t, ids in zip(texts, encode(e, texts), strict=True):
            assert ids == [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 2]
    assert len(e.starts) < 60


def test_files_hold_indexes_and_lookups_skip_stripes(spark, tmp_path, monkeypatch):
    """Several stripes in a file, each with a row index and a Bloom filter on doc_id; a lookup reads few row groups."""
    monkeypatch.setattr(T, "STRIPE_BYTES", 1 << 16)
    monkeypatch.setattr(T, "STRIDE", 1000)
    rng = np.random.default_rng(1)
    ids = (2**40 + 2 * rng.permutation(60_000)).tolist()  # beyond 32 bits, so that a key is a long in Java, too
    docs = spark.createDataFrame([(i, f"text {i} of some words {i % 977} and {i % 13}") for i in ids], "doc_id long, text string")
    path = str(tmp_path / "orc")
    T.write(docs.coalesce(1), SPEC, path)
    jvm, files = spark._jvm, sorted(tmp_path.glob("orc/*.orc"))
    orc, conf = jvm.org.apache.orc, spark._jsc.hadoopConfiguration()
    open_ = lambda f: orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), orc.OrcFile.readerOptions(conf))
    stripes, rows_in = 0, {}
    for f in files:
        reader = open_(f)
        assert reader.getRowIndexStride() == 1000
        inside = reader.rows()
        for stripe in reader.getStripes():
            kinds = [(s.getColumn(), s.getKind().toString()) for s in inside.readStripeFooter(stripe).getStreamsList()]
            stripes += 1
            column = reader.getSchema().getFieldNames().index("doc_id") + 1
            assert (column, "BLOOM_FILTER_UTF8") in kinds and {(column, "ROW_INDEX"), (5, "ROW_INDEX")} <= set(kinds)
        rows_in[f] = reader.getNumberOfRows()
    assert stripes > len(files) and sum(rows_in.values()) == len(ids)

    def looked_at(key):
        argument = jvm.org.apache.hadoop.hive.ql.io.sarg.SearchArgumentFactory.newBuilder().startAnd().equals("doc_id", jvm.org.apache.hadoop.hive.ql.io.sarg.PredicateLeaf.Type.LONG, key).end().build()
        seen = 0
        for f in files:
            reader = open_(f)
            rows = reader.rows(reader.options().searchArgument(argument, spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)))
            batch = reader.getSchema().createRowBatch()
            while rows.nextBatch(batch):
                seen += batch.count()
        return seen

    assert 0 < looked_at(ids[7]) <= 2000
    assert sum(looked_at(2**40 + 2 * k + 1) > 0 for k in range(100, 120)) <= 2  # odd ids are inside a stripe's range: its Bloom filter skips it


def test_rows_alike_are_spread_over_files(spark, tmp_path):
    rows = [(7, "the same text")] * 6000 + [(i, f"text {i}") for i in range(2000)]
    path = str(tmp_path / "orc")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = sorted(map(tuple, T.encode_and_digest(docs, SPEC, path).collect()), key=lambda r: r[1])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want(rows)
    sizes = [r["count"] for r in T.read(spark, path).groupBy("part").count().collect()]
    assert len(sizes) > 2 and max(sizes) < 5000
