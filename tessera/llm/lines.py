"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling.

A text is the sequence of its lines that hold something besides white space; a line's id stands for its
characters. Texts that are equal as a whole are one sequence.

1. Suffixes whose first line another suffix has too are ranked by that line; a rank is the suffix's place in the
   suffix array, of equal ones the first. Doubling refines: the rank by 2d lines follows from the rank by d lines here and
   the one d lines on. A rank that is one suffix's alone is final, and a sequence whose ranks are all final
   leaves. Where a line that nothing else has is d lines on, no suffix agrees further, and where the text ends there,
   nothing is left to compare; doubling goes on until all ranks are final, however long the repeats. A suffix's path, its
   ranks by 1, 2, 4, ... lines, orders it among all.
2. The longest common prefix of neighbours in the suffix array comes from the doubling's levels: where paths part after the
   rank by d lines, the suffixes share d lines, and what follows these is compared in the same way.
3. Suffixes in a row that share t lines or more are an interval. Its first suffix in order of the documents stays, and the t
   lines that the others begin with are deleted, if t is ``depth``, or if they have ``min_words`` words.
   A maximal repeated run is a chain of such suffixes, each a line on.

Everything runs as built-in functions in the JVM. Ranks are joined from written tables with one row for each key, so a key
that very many rows share (a line in a third of all documents) is a join of which Spark can split the other side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import repeated, scratch, stored

MIN_RUN = 3
#: A shorter run goes, too, if it has so many words.
MIN_WORDS = 50
_ROW = ["row_a", "row_b"]
_OWNER = ["none", "doc_id"]
#: What stands for a line that no other suffix begins with, where one is looked up.
_ALONE = 2**62


def _row(docs: DataFrame) -> DataFrame:
    """(doc_id, text) under a 128-bit key; rows alike in text have one key."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select(F.xxhash64("text").alias("row_a"), F.xxhash64(F.lit("b"), "text").alias("row_b"), "doc_id", "text")


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))


def _full(lines: Column) -> Column:
    """The lines that count, each with its place and words."""
    placed = F.transform(lines, lambda x, i: F.struct(i.alias("line"), x.alias("chars"), _words(x).alias("words")))
    return F.filter(placed, lambda s: s["words"] > 0)


def _texts(docs: DataFrame) -> DataFrame:
    """One row for each distinct text: its key, the first id that has it (null last), and the 128-bit ids and words of its lines that count."""
    lines = _row(docs).where("text is not null").withColumn("full", _full(_split(F.col("text"))))
    each = lines.select(
        *_ROW, "doc_id", F.col("doc_id").isNull().alias("none"),
        F.transform("full", lambda s: F.xxhash64(s["chars"])).alias("ids_a"),
        F.transform("full", lambda s: F.xxhash64(F.lit("b"), s["chars"])).alias("ids_b"),
        F.transform("full", lambda s: s["words"]).alias("words"),
    )
    one = lambda c: F.first(c).alias(c)  # noqa: E731  the same for all rows of a text
    return each.groupBy(*_ROW).agg(F.min("none").alias("none"), F.min("doc_id").alias("doc_id"), one("ids_a"), one("ids_b"), one("words"))


def _lines(texts: DataFrame, *carry: str) -> DataFrame:
    entry = lambda a, i: F.struct(i.alias("pos"), a.alias("id_a"), F.get("ids_b", i).alias("id_b"), F.get("words", i).alias("words"))
    return texts.select(*carry, F.size("ids_a").alias("n"), F.inline(F.transform("ids_a", entry)))


def sequences(docs: DataFrame) -> DataFrame:
    """One row for each line that counts of each distinct text: the text's key, the line's place and id."""
    return _lines(_texts(docs), *_ROW)


def _ranked(keys: DataFrame, by: list[str]) -> DataFrame:
    """Distinct keys with their ranks, numbers in the order of the keys: dealt by ranges, sorted, numbered in place and written, so that every reader sees the same."""
    return stored(keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()))


def _running(placed: DataFrame, by: list[str], weights: list[str]) -> DataFrame:
    """A table that is dealt by ranges of keys, with the sum of each weight up to each row in place of the weight.

    Sums run inside a range; a table with one line for each range has what stands before it.
    """
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy("range").agg(*[F.sum(w).alias(w) for w in weights])
    totals = totals.select("range", *[F.coalesce(F.sum(w).over(before), F.lit(0)).alias(f"{w}_first") for w in weights])
    inside = W.partitionBy("range").orderBy(*by).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = placed.withColumns({w: F.sum(w).over(inside) for w in weights}).join(F.broadcast(totals), "range")
    return found.withColumns({w: F.col(w) + F.col(f"{w}_first") for w in weights}).drop(*[f"{w}_first" for w in weights])


def _looking_ahead(rows: DataFrame, step: int) -> DataFrame:
    """The rows of the sequences that have an open suffix, each with the path of the suffix ``step`` lines on."""
    on = W.partitionBy("seq").orderBy("pos")
    looked = rows.withColumn("ahead", F.max("path").over(on.rangeBetween(step, step))).withColumn("open", F.max(~F.col("final")).over(W.partitionBy("seq")))
    return stored(looked)


def _first_level(texts: DataFrame, order: DataFrame, depth: int) -> DataFrame:
    """Suffixes that share their first line, ranked by it. ``words_t`` is the words of the t lines from here on, as far as these are shared."""
    each = _lines(texts, "text_id")
    shared = each.groupBy("id_a", "id_b").agg(F.count("*").alias("times")).where("times > 1")
    found = each.join(_ranked(shared.select("id_a", "id_b"), ["id_a", "id_b"]), ["id_a", "id_b"]).join(order.select("text_id", "seq"), "text_id")
    on = W.partitionBy("seq").orderBy("pos")
    sums = [F.sum("words").over(on.rangeBetween(0, t - 1)).alias(f"words_{t}") for t in range(1, depth)]
    rows = found.select("seq", "pos", "n", F.array("rank").alias("path"), F.lit(False).alias("final"), F.lit(0).alias("level"), *sums)
    return _looking_ahead(rows, 1)


def _doubled(state: DataFrame, step: int, level: int) -> DataFrame:
    """The state by twice as many lines, of the sequences that have something left to rank."""
    end = F.array().cast("array<bigint>")
    alone = F.array(F.lit(_ALONE).cast("long"), F.col("seq"), F.col("pos").cast("long"))
    ahead = F.when(F.col("pos") + step >= F.col("n"), end).otherwise(F.coalesce("ahead", alone))
    going = state.where("open and not final").withColumns({"here": F.element_at("path", -1), "next": ahead})
    keys = going.groupBy("here", "next").agg(F.count("*").alias("times"))
    again = going.join(_ranked(keys, ["here", "next"]), ["here", "next"])
    # suffixes of one rank that are shorter than the lines that count now are equal to their ends
    final = (F.col("times") == 1) | (F.col("n") - F.col("pos") < 2 * step)
    again = again.withColumns({"path": F.concat("path", F.array("rank")), "final": final, "level": F.lit(level)})
    names = [c for c in state.columns if c not in ("ahead", "open")]
    return _looking_ahead(state.where("open and final").select(*names).unionByName(again.select(*names)), 2 * step)


def _agreed(a: Column, b: Column) -> Column:
    """Lines that two suffixes share at once, by their paths: 2^(k-1), if the first k ranks are the same. Equal paths end with a rank that is too short to count."""
    least = F.least(F.size(a), F.size(b))
    apart = F.array_position(F.transform(F.sequence(F.lit(0), least - 1), lambda i: F.get(a, i) != F.get(b, i)), True).cast("int")
    k = F.when(apart > 0, apart - 1).otherwise(least - 1)
    return F.when(a.isNull() | b.isNull() | (k < 1), 0).otherwise(F.call_function("shiftleft", F.lit(1), k - 1))


def suffix_array(docs: DataFrame, depth: int = MIN_RUN) -> tuple[DataFrame, DataFrame]:
    """The suffix array of the texts' line ids, and (seq, key, first id) of the texts; seq keeps the order of the documents.

    The array has all suffixes whose first line another one has, in order of ``range``, path, seq and pos: path, the suffix's
    ranks by 1, 2, 4, ... lines; ``lcp``, the number of lines that it shares with the suffix before it; and the words of its first
    lines. Ids order lines that are shared; a line that is not comes after these, and the end of a text before; suffixes equal to their
    texts' ends are ordered by seq and pos.
    """
    texts = stored(_texts(docs).withColumn("text_id", F.monotonically_increasing_id()))
    order = stored(texts.select("text_id", *_ROW, *_OWNER).repartitionByRange(*_OWNER, *_ROW).sortWithinPartitions(*_OWNER, *_ROW).withColumn("seq", F.monotonically_increasing_id()))
    levels = [_first_level(texts, order, depth)]
    while not levels[-1].where("not final").isEmpty():
        levels.append(_doubled(levels[-1], 1 << (len(levels) - 1), len(levels)))
    # each suffix from the level that made its rank final
    done = [x.where(F.col("final") & (F.col("level") == k)) for k, x in enumerate(levels)]
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    by = ["path", "seq", "pos"]
    every = every.select(*by, *[f"words_{t}" for t in range(1, depth)])
    placed = stored(every.repartitionByRange(*by).withColumn("range", F.spark_partition_id()))
    here, on = F.struct(*by), W.partitionBy("range").orderBy(*by)
    ends = placed.groupBy("range").agg(F.max(here).alias("last")).select("range", F.lag("last").over(W.orderBy("range")).alias("last"))
    pairs = placed.withColumn("inside", F.lag(here).over(on)).join(F.broadcast(ends), "range").withColumn("before", F.coalesce("inside", "last"))
    agreed = F.coalesce(_agreed(F.col("path"), F.col("before.path")), F.lit(0))
    pairs = pairs.select(*placed.columns, F.col("before.seq").alias("seq_b"), F.col("before.pos").alias("pos_b"), agreed.alias("lcp"), agreed.alias("more"))
    parts = [stored(pairs)]
    paths = placed.select("seq", "pos", "path")
    # two lines or more: where they end, the rest may agree by less
    while not parts[-1].where("more > 1").isEmpty():
        going = parts[-1].where("more > 1")
        for side, seq, pos in (("a", "seq", "pos"), ("b", "seq_b", "pos_b")):
            mine = paths.select(F.col("seq").alias(seq), F.col("pos").alias(f"at_{side}"), F.col("path").alias(f"path_{side}"))
            going = going.withColumn(f"at_{side}", F.col(pos) + F.col("lcp")).join(mine, [seq, f"at_{side}"], "left")
        going = going.withColumn("more", F.coalesce(_agreed(F.col("path_a"), F.col("path_b")), F.lit(0))).withColumn("lcp", F.col("lcp") + F.col("more"))
        parts.append(stored(going.select(*parts[0].columns)))
    found = parts[0].where("more <= 1")
    for part in parts[1:]:
        found = found.unionByName(part.where("more <= 1"))
    return found.drop("seq_b", "pos_b", "more"), order


def _intervals(array: DataFrame, depth: int) -> DataFrame:
    """The suffix array with the suffixes' places in it from 1, and for each t up to ``depth`` the number of the interval of t lines that a suffix is in."""
    edges = {f"interval_{t}": F.when(F.col("lcp") < t, 1).otherwise(0) for t in range(1, depth + 1)}
    return stored(_running(array.withColumns(edges).withColumn("place", F.lit(1)), ["path", "seq", "pos"], [*edges, "place"]).drop("path", "range"))


def _later(intervals: DataFrame, t: int) -> DataFrame:
    """Suffixes that share their first t lines with an earlier one."""
    key = f"interval_{t}"
    first = intervals.groupBy(key).agg(F.count("*").alias("times"), F.min(F.struct("seq", "pos")).alias("first")).where("times > 1")
    return intervals.join(stored(first), key).where(F.struct("seq", "pos") > F.col("first"))


def suffixes(docs: DataFrame, depth: int = MIN_RUN) -> DataFrame:
    """Suffixes that share their first ``depth`` lines with another, with their place in the suffix array as ``rank``."""
    array, order = suffix_array(docs, depth)
    intervals, key = _intervals(array, depth), f"interval_{depth}"
    several = intervals.groupBy(key).agg(F.count("*").alias("times")).where("times > 1")
    return intervals.join(several, key).join(order, "seq").select(*_ROW, "pos", F.col("place").alias("rank"), "lcp")


def removed_lines(docs: DataFrame, depth: int = MIN_RUN, min_words: int | None = None) -> DataFrame:
    """(text key, places of the lines to delete among those that count) of the texts that lose some where they stand first."""
    array, order = suffix_array(docs, depth)
    intervals = _intervals(array, depth)
    parts = []
    for t in range(1 if min_words else depth, depth + 1):
        later = _later(intervals, t)
        if t < depth:
            later = later.where(F.col(f"words_{t}") >= min_words)
        parts.append(later.select("seq", F.explode(F.sequence(F.col("pos"), F.col("pos") + t - 1)).alias("pos")))
    each = parts[0]
    for part in parts[1:]:
        each = each.unionByName(part)
    return each.groupBy("seq").agg(F.collect_set("pos").alias("gone")).join(order, "seq").select(*_ROW, "gone")


def dedup(docs: DataFrame, depth: int = MIN_RUN, min_words: int | None = None) -> DataFrame:
    """Every row's id, kept text, and numbers of lines, deleted lines and deleted runs.

    A run of lines is deleted if an earlier place begins with the same lines, and it has ``depth`` lines or more, or, where
    ``min_words`` is given, so many words: earlier in the same text, or in a text with a smaller id (null last; of equal ids one
    text goes first throughout). Of rows alike in id and text one is judged so, and the others are later copies of it as a whole.
    Empty lines are neither counted nor deleted. A null text has no lines and stays null; a long text is a longer sequence, its
    lines dealt like all others; an empty table gives an empty one; other columns stay behind, whatever their names.
    """
    rows = _row(docs)
    alike = rows.where("text is not null").groupBy(*_ROW, "doc_id").agg(F.count("*").alias("alike"))
    several = alike.groupBy(*_ROW).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "alike")).alias("owner"), F.sum("alike").alias("copies")).where("copies > 1")
    with scratch(docs.sparkSession) as keep:
        about = stored(several.join(removed_lines(docs, depth, min_words), _ROW, "full"))
        keep.append(about)
    # what is found grows with the corpus, so it is never sent to all tasks; hashed, so that no text has to be sorted
    joined = rows.join(about.hint("shuffle_hash"), _ROW, "left")
    owned = F.col("owner").isNull() | F.col("doc_id").eqNullSafe(F.col("owner.doc_id"))  # no owner: the only row of its text
    one = joined.withColumn("copy", ~owned)
    if not about.where("owner.alike > 1").isEmpty():
        again = F.coalesce(owned & (F.col("owner.alike") > 1), F.lit(False))
        first = F.first("text").alias("text"), F.first("owner.alike").alias("alike"), F.first("gone").alias("gone")
        same = joined.where(again).groupBy(*_ROW, "doc_id").agg(*first)
        same = repeated(same, "alike", "number").withColumn("copy", F.col("number") > 0)
        one = one.where(~again).select("doc_id", "text", "gone", "copy").unionByName(same.select("doc_id", "text", "gone", "copy"))
    lines = one.withColumn("lines", _split(F.col("text")))
    placed = F.transform("lines", lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i))
    lines = lines.withColumn("full", F.filter(placed, lambda i: i.isNotNull()))
    whole = F.size("full") >= depth
    if min_words:
        whole = whole | (_words(F.col("text")) >= min_words)
    none = F.array().cast("array<int>")
    every = F.when(whole & (F.size("full") > 0), F.sequence(F.lit(0), F.size("full") - 1)).otherwise(none)
    lines = lines.withColumn("gone", F.when(F.col("copy"), every).otherwise(F.coalesce("gone", none)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.transform("gone", lambda p: F.get("full", p)))
    kept_text = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    starts = F.array_except("gone", F.transform("gone", lambda p: p + 1))
    return lines.select(
        "doc_id",
        F.when(F.size("gone") == 0, F.col("text")).otherwise(kept_text).alias("text"),
        F.size("full").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        F.size(starts).cast("long").alias("n_runs"),
    )


def report(docs: DataFrame) -> DataFrame:
    return dedup(docs, MIN_RUN, MIN_WORDS).select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The query's rows in plain SQL.
ORACLE = r"""
WITH raw AS (
    SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents
), each AS (
    SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS place FROM raw
), counting AS (
    SELECT doc_id, line, place, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS pos, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
    FROM each WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), windows AS (
    SELECT doc_id, pos, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c, words AS words_1, words + lead(words, 1) OVER w AS words_2
    FROM counting WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), numbered AS (
    SELECT doc_id, pos, 3 AS t, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS copy FROM windows WHERE c IS NOT NULL
    UNION ALL
    SELECT doc_id, pos, 2 AS t, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, pos) AS copy FROM windows WHERE b IS NOT NULL AND words_2 >= 50
    UNION ALL
    SELECT doc_id, pos, 1 AS t, row_number() OVER (PARTITION BY a ORDER BY doc_id, pos) AS copy FROM windows WHERE words_1 >= 50
), later AS (
    SELECT DISTINCT doc_id, pos + k AS pos FROM numbered, (SELECT unnest(range(0, 3)) AS k) AS steps WHERE copy > 1 AND k < t
), runs AS (
    SELECT doc_id, count(*) AS n_removed, sum(CASE WHEN before IS NULL OR before < pos - 1 THEN 1 ELSE 0 END) AS n_runs
    FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM later) AS l GROUP BY doc_id
), kept AS (
    SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.place) AS text
    FROM each e LEFT JOIN counting n ON n.doc_id = e.doc_id AND n.place = e.place LEFT JOIN later l ON l.doc_id = n.doc_id AND l.pos = n.pos
    WHERE l.pos IS NULL GROUP BY e.doc_id
)
SELECT d.doc_id,
    CAST(coalesce((SELECT count(*) FROM counting n WHERE n.doc_id = d.doc_id), 0) AS BIGINT) AS n_lines,
    CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed,
    CAST(coalesce(r.n_runs, 0) AS BIGINT) AS n_runs,
    sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN runs r ON r.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
