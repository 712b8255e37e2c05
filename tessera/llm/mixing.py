"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources that a document counts for. Each pattern
can give its words once, twice or three times, each pass dearer than the one before; a flow from patterns to
source quotas of least cost says how many words each pattern gives to each source. The driver sees only
the table of patterns. A pattern's words are then made up of whole documents: every document in the full
passes, and in the last, partial pass those whose seeded hash is below the cut of their size class. Around the
cuts a bounded run of documents is searched for the ones that fill what is left.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_PASSES = 3
SEED = 17
#: Hash buckets of a pattern: about the square root of the number of documents, a power of two between these.
BUCKETS = (1 << 8, 1 << 20)
#: Documents on either side of the cut whose choice may change to fill a remainder, and the bits of memory for that.
FILLERS = 40
FILL_BITS = 1 << 28
#: A table of at most so many lines is sent to all tasks; a longer one is joined by its key.
BROADCAST_ROWS = 200_000


def targets(sizes: list[int], weights: list[int], most: int = MAX_PASSES) -> list[Fraction]:
    """Shares of the sum of sizes by weight; none is above ``most`` times its size, and what is cut off goes to the others by weight."""
    rest, free = Fraction(sum(sizes)), set(range(len(sizes)))
    found = [Fraction(0)] * len(sizes)
    while free:
        per = rest / sum(weights[i] for i in free)
        over = {i for i in free if per * weights[i] > most * sizes[i]}
        for i in over or free:
            found[i] = Fraction(most * sizes[i]) if over else per * weights[i]
        if not over:
            break
        rest -= sum(found[i] for i in over)
        free -= over
    return found


def route(supply: list[int], members: list[list[int]], quota: list[int], passes: int = MAX_PASSES) -> list[dict[int, int]]:
    """Words that each pattern gives to each of its sources: a flow of most words at least cost, the k-th pass of a pattern costing k a word.

    Only the arcs from the start to a pattern cost anything, so an augmenting path costs what its first arc does. Shortest paths
    first thus means: a flow of most words with one pass of each pattern, then with one pass more, and so on. Each of these is found by
    Dinic's blocking flows; an arc is looked at once in a phase, so a table of a million patterns takes seconds.
    """
    users: list[list[int]] = [[] for _ in quota]
    for p, ms in enumerate(members):
        for s in ms:
            users[s].append(p)
    flow, room = [dict.fromkeys(ms, 0) for ms in members], list(quota)
    for _ in range(passes):
        left = list(supply)
        while (layers := _layers(left, room, members, users, flow)) is not None:
            _blocking(left, room, members, users, flow, *layers)
    return flow


def _layers(left: list[int], room: list[int], members: list[list[int]], users: list[list[int]], flow: list[dict[int, int]]) -> tuple[dict[int, int], dict[int, int], int] | None:
    """Layers of the patterns and sources that words left over reach, up to the first layer with room; None if no room is in reach."""
    patterns = {p: 0 for p, n in enumerate(left) if n}
    sources: dict[int, int] = {}
    front, depth = list(patterns), 0
    while front:
        reached = []
        for p in front:
            for s in members[p]:
                if s not in sources:
                    sources[s] = depth
                    reached.append(s)
        if any(room[s] for s in reached):
            return patterns, sources, depth
        front, depth = [], depth + 1
        for s in reached:  # a pattern that gives to this source could give to another instead
            for p in users[s]:
                if p not in patterns and flow[p][s]:
                    patterns[p] = depth
                    front.append(p)
    return None


def _blocking(left: list[int], room: list[int], members: list[list[int]], users: list[list[int]], flow: list[dict[int, int]], patterns: dict[int, int], sources: dict[int, int], last: int) -> None:
    """Send words along the layers until no path is left. A path is a pattern, a source, a pattern that gives to it, and so on."""
    tried_p, tried_s = dict.fromkeys(patterns, 0), dict.fromkeys(sources, 0)
    for first in [p for p, depth in patterns.items() if not depth]:
        path = [first]
        while path and left[first]:
            at = path[-1]
            if len(path) % 2:  # a pattern: the next source a layer on
                ms, i = members[at], tried_p[at]
                while i < len(ms) and sources.get(ms[i]) != patterns[at]:
                    i += 1
                tried_p[at] = i
                if i < len(ms):
                    path.append(ms[i])
                else:
                    path.pop()
                    if path:
                        tried_s[path[-1]] += 1
            elif sources[at] == last:
                if not room[at]:
                    path.pop()
                    tried_p[path[-1]] += 1
                    continue
                words = min([left[first], room[at], *(flow[path[k]][path[k - 1]] for k in range(2, len(path), 2))])
                left[first] -= words
                room[at] -= words
                for k in range(0, len(path), 2):
                    flow[path[k]][path[k + 1]] += words
                    if k:
                        flow[path[k]][path[k - 1]] -= words
                path = [first]
            else:  # a source without room: the next pattern that gives to it
                us, i = users[at], tried_s[at]
                while i < len(us) and not (patterns.get(us[i]) == sources[at] + 1 and flow[us[i]][at]):
                    i += 1
                tried_s[at] = i
                if i < len(us):
                    path.append(us[i])
                else:
                    path.pop()
                    tried_p[path[-1]] += 1


@dataclass(frozen=True)
class Plan:
    """What each pattern gives, and each source's size and target; all as long as the table of patterns or sources."""

    sources: list[tuple[str | None, int, float]]
    patterns: list[tuple[str, int, int, dict]]  # key, full passes, words of the partial pass, words to each source


def words(text: Column) -> Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draws(docs: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text", carry: list[Column] = (), seed: int = SEED) -> DataFrame:
    """Of each row its pattern, size and seeded draw, with the columns ``carry``."""
    text = F.col(text_col).cast("string")
    size = words(text)
    members = F.to_json(F.array_sort(F.array_distinct(sources)))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), members.alias("pattern"), size.alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), size, text).alias("draw"), *carry,
    )


def _bucket(buckets: int) -> Column:
    return F.shiftrightunsigned("draw", 64 - (buckets.bit_length() - 1)).cast("int")


def _buckets(docs: int) -> int:
    """Cells and the rows of one bucket both grow with the square root of the corpus."""
    return min(max(1 << (math.isqrt(docs).bit_length()), BUCKETS[0]), BUCKETS[1])


def solve(patterns: list[tuple[str, int]], weights: tuple[int, ...] = WEIGHTS) -> Plan:
    """Targets and flow for the table of patterns (key, words). A source's size is that of all documents that count for it."""
    members = [json.loads(k) for k, _ in patterns]
    names = sorted({s for ms in members for s in ms}, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    place = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for ms, (_, size) in zip(members, patterns, strict=True):
        for s in ms:
            sizes[place[s]] += size
    # overlapping sources share their words: the mix is as large as the corpus, however often a word counts
    goals = targets(sizes, [weights[i % len(weights)] for i in range(len(names))])
    if sum(sizes) > (total := sum(size for _, size in patterns)):
        goals = [g * Fraction(total, sum(sizes)) for g in goals]
    flow = route([size for _, size in patterns], [[place[s] for s in ms] for ms in members], [int(g) for g in goals])
    rows = []
    for (key, size), give in zip(patterns, flow, strict=True):
        full, part = divmod(sum(give.values()), size) if size else (0, 0)
        rows.append((key, full, part, {names[s]: w for s, w in give.items()}))
    return Plan([(s, z, float(g)) for s, z, g in zip(names, sizes, goals, strict=True)], rows)


def totals(rows: DataFrame) -> list[tuple[str, int]]:
    """The table of patterns with their words: what the driver sees of the corpus."""
    return sorted((r.pattern, r.words) for r in rows.groupBy("pattern").agg(F.sum("size").alias("words")).collect())


def _small(table: DataFrame, lines: int) -> DataFrame:
    return F.broadcast(table) if lines <= BROADCAST_ROWS else table


def passes(rows: DataFrame, plan: Plan, light: DataFrame | None = None) -> DataFrame:
    """``rows`` (of ``draws``) with a column ``passes``: how often the mix takes the row.

    One look at the sums of (pattern, bucket, size class) finds the cut of each class, so that a document too long for what is left
    closes its own class only; the rows of the buckets around these cuts, about ``FILLERS`` on either side and one bucket, and of
    the bucket with the class's smallest document that is left, are gathered and searched. When the search ends, no document that the
    partial pass leaves out would fit. The rest of the rows learn their passes from a table with one line for each pattern and class.
    """
    light = light if light is not None else rows
    schema = "pattern string, full long, part long"
    parts = rows.sparkSession.createDataFrame([(k, f, p) for k, f, p, _ in plan.patterns], schema)
    n, buckets = len(plan.patterns), _buckets(light.count())
    placed = lambda x: x.withColumn("bucket", _bucket(buckets)).withColumn("class", F.length(F.bin("size")))
    cells = placed(light.select("pattern", "size", "draw")).where("size > 0").groupBy("pattern", "bucket", "class")
    cells = cells.agg(F.sum("size").alias("words"), F.count("*").alias("docs"), F.min("size").alias("least")).join(_small(parts.where("part > 0"), n), "pattern")
    edges = stored(cells.groupBy("pattern").applyInPandas(_cuts, "pattern string, class int, first int, cut int, end int, low int, left long"))
    near = lambda x: placed(x).join(_small(parts, n), "pattern").join(_small(edges, 64 * n), ["pattern", "class"], "left")
    edge = F.coalesce(F.col("bucket").between(F.col("first"), F.col("end")) | (F.col("bucket") == F.col("low")), F.lit(False))
    # no cut: what is left of the class fits whole
    extra = F.when((F.col("part") > 0) & F.coalesce(F.col("bucket") < F.col("cut"), F.lit(True)), 1).otherwise(0)
    names = rows.columns
    outside = near(rows).where(~edge).select(*names, (F.col("full") + extra).alias("passes"))

    before = (F.col("bucket") < F.col("cut")).alias("before")
    kinds = near(light).where(edge & (F.col("left") > 0) & (F.col("size") > 0)).groupBy("pattern", "draw", "size", "left", "bucket", before).agg(F.count("*").alias("copies"))
    chosen = stored(kinds.groupBy("pattern").applyInPandas(_fill, "of_pattern string, of_draw long, of_size long, copies long, extra long").where("extra > 0"))
    same = (F.col("pattern") == F.col("of_pattern")) & (F.col("draw") == F.col("of_draw")) & (F.col("size") == F.col("of_size"))
    inside = stored(near(rows).where(edge).join(chosen, same, "left"))
    # of equal rows the rest may fit only some; they are numbered then, and then only
    some = F.coalesce(F.col("extra") < F.col("copies"), F.lit(False))
    all_or_none = inside.where(~some).select(*names, (F.col("full") + F.when(F.col("extra").isNotNull(), 1).otherwise(0)).alias("passes"))
    numbered = inside.where(some).withColumn("n", F.row_number().over(W.partitionBy("pattern", "draw", "size").orderBy("doc_id")))
    numbered = numbered.select(*names, (F.col("full") + F.when(F.col("n") <= F.col("extra"), 1).otherwise(0)).alias("passes"))
    every = outside.unionByName(all_or_none).unionByName(numbered)
    return every.withColumn("passes", F.when(F.col("size") > 0, F.col("passes")).otherwise(F.lit(0)).cast("int"))


def _cuts(cells: pd.DataFrame) -> pd.DataFrame:
    """Of a pattern, where each class is cut, the buckets to gather, and the words that these may have.

    Cells (bucket, class) are taken in the order of the buckets; the first of a class that does not fit closes it. A class
    that fits whole is cut behind its last bucket. A pattern whose documents all fit has no cut.
    """
    cells = cells.sort_values(["bucket", "class"], kind="stable")
    left = int(cells["part"].iloc[0])
    of_class: dict[int, list[tuple[int, int, int, int]]] = {}
    cut: dict[int, int] = {}
    for bucket, c, words, docs, least in zip(*(cells[n].tolist() for n in ("bucket", "class", "words", "docs", "least")), strict=True):
        of_class.setdefault(c, []).append((bucket, words, docs, least))
        if c not in cut:
            if words <= left:
                left -= words
            else:
                cut[c] = len(of_class[c]) - 1
    found = []
    for c, mine in of_class.items() if cut else ():
        at = cut.get(c, len(mine))
        first, docs = at, 0
        while first and docs < FILLERS:
            first -= 1
            docs += mine[first][2]
            left += mine[first][1]
        end, docs = at, 0
        while end < len(mine) and docs < FILLERS:
            docs += mine[end][2]
            end += 1
        low = min(mine[at:], key=lambda cell: cell[3], default=mine[first])
        found.append((cells["pattern"].iloc[0], c, mine[first][0], mine[at][0] if at < len(mine) else BUCKETS[1], mine[end - 1][0], low[0]))
    table = pd.DataFrame(found, columns=["pattern", "class", "first", "cut", "end", "low"])
    return table.assign(left=left)


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Documents around the cuts: those before them, then in the order of their draws each that fits; then the last that were taken and the smallest that were not are chosen anew, to come as close as they can."""
    rows = rows.sort_values(["before", "bucket", "draw", "size"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    left, extra = int(rows["left"].iloc[0]), [0] * len(rows)
    sizes, copies = rows["size"].tolist(), rows["copies"].tolist()
    for i in range(len(rows)):
        extra[i] = min(copies[i], left // sizes[i])
        left -= extra[i] * sizes[i]
    some = [i for i in range(len(rows)) if extra[i]][-FILLERS:] if left else []
    short = sorted((i for i in range(len(rows)) if extra[i] < copies[i]), key=lambda i: sizes[i])[:FILLERS] if left else []
    free = []
    for i in sorted({*some, *short}, key=lambda i: sizes[i]):
        # of a row that repeats, some copies stay as they are; so do documents so long that the table of sums would not fit
        n = min(copies[i], FILLERS)
        given_back = min(extra[i], n)
        if (len(free) + n + 1) * (left + given_back * sizes[i] + 1) > FILL_BITS:
            break
        free += [i] * n
        extra[i] -= given_back
        left += given_back * sizes[i]
    reach = [1]  # bit w of reach[k]: some of the first k documents have w words
    for i in free:
        reach.append((reach[-1] | reach[-1] << sizes[i]) & ((1 << left + 1) - 1))
    w = reach[-1].bit_length() - 1
    for k in range(len(free), 0, -1):
        if not reach[k - 1] >> w & 1:
            extra[free[k - 1]] += 1
            w -= sizes[free[k - 1]]
    return pd.DataFrame({"of_pattern": rows["pattern"], "of_draw": rows["draw"], "of_size": sizes, "copies": copies, "extra": extra})


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its size, its source's size and target, and the words that the mix takes of it.

    A null source is a source, the last one; a null text or one without words has size 0 and is not taken; a long text counts
    whole, and one too long for what is left is passed over for shorter ones; rows that repeat are taken each for itself, and of rows
    alike in all but the id those with smaller ids first; an empty table gives an empty one; other columns stay behind.
    """
    rows = stored(draws(docs, F.array(F.col(source_col).cast("string")), id_col, text_col))
    plan = solve(totals(rows))
    about = {s: (z, t) for s, z, t in plan.sources}
    sources = rows.sparkSession.createDataFrame([(k, *about[json.loads(k)[0]]) for k, *_ in plan.patterns], "pattern string, source_size long, target double")
    found = passes(rows, plan).join(_small(sources, len(plan.patterns)), "pattern")
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"))


def keep_mix(docs: DataFrame, source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it.

    Nulls, long texts, ties and repeated rows as in ``mix``; a row without words is never taken; columns keep their names, whatever
    these are; an empty table gives an empty one.
    """
    sources = F.array(F.col(source_col).cast("string"))
    light = stored(draws(docs, sources))
    rows = draws(docs, sources, carry=[F.struct(*docs.columns).alias("__row")])
    found = passes(rows, solve(totals(light)), light).where("passes > 0")
    return found.withColumn("__n", F.explode(F.sequence(F.lit(1), "passes"))).select("__row.*")
