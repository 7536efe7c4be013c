"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources. Documents are aggregated by membership
pattern (the set of their sources). A flow routes words from patterns to source
quotas: each further repetition of a pattern's documents is an arc with a higher
cost per word, so repetition is used only where a quota needs it and as evenly as
it allows. A pattern's routed words become whole passes over its documents plus
one part pass, for which documents are taken in the order of a seeded hash of
their id until the part is reached.

Only patterns (not documents) come to the driver: one short row for each set of sources that occurs. The place in the hash order
where the part pass ends is found in Spark: sums per pattern and hash prefix find the prefix
that holds it, and only that prefix's documents are put in order.

Nulls and edges: a null text has size 0; a null source is a source of its own, last
in order; a null id is hashed as an empty text; rows with equal ids, sizes and
patterns stand together in the hash order; an empty table gives an empty result.
A source whose documents have no words gets target 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dunning.llm.common import checkpointed

WEIGHTS = (1, 2, 3)
#: Most often that a document may be taken, and the cost per word of each pass (any rising costs give the same flow).
MAX_PASSES = 3
PASS_COSTS = (0, 1, 3)
#: Most rows of a plan (patterns or sources) that is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000
SEED = 6
#: Leading hex digits of the hash by which sizes are summed.
PREFIX_DIGITS = 4


#: A character of a word, and what lies between words.
WORD, BETWEEN = "[^\\x20\\x09-\\x0D]", "[\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than the six ASCII spaces; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, BETWEEN), "")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[int], cap: int = MAX_PASSES) -> list[float]:
    """Quotas by weight that add up to all sizes; one above ``cap`` times its size
    stops there and the excess is shared again by weight."""
    total, left, open_ = sum(sizes), sum(sizes), list(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        share = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] > cap * sizes[i] * share]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / share
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        left -= sum(cap * sizes[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    assert sum(out) <= total * (1 + 1e-9) + 1e-9
    return out


class Network:
    """Arcs from patterns to sources and from sources to the end; the words a pattern may still send are added pass by pass.

    Only the arcs out of the start cost anything, and a path leaves the start once. So the cheapest
    flow is a largest one over the first passes, enlarged over the second ones, and so on.
    """

    def __init__(self, patterns: int, members: list[list[int]], quota: list[int]):
        self.patterns, self.end = patterns, patterns + len(quota)
        self.out: list[list[int]] = [[] for _ in range(self.end + 1)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.routes = [[self._arc(i, patterns + j, 1 << 62) for j in sources] for i, sources in enumerate(members)]
        for j, words in enumerate(quota):
            self._arc(patterns + j, self.end, words)
        self.supply = [0] * patterns

    def _arc(self, a: int, b: int, room: int) -> int:
        for frm, to, r in ((a, b, room), (b, a, 0)):
            self.out[frm].append(len(self.to))
            self.to.append(to)
            self.room.append(r)
        return len(self.to) - 2

    def _levels(self) -> list[int]:
        level = [-1] * len(self.out)
        near = [i for i, words in enumerate(self.supply) if words]
        for i in near:
            level[i] = 0
        while near and level[self.end] < 0:
            found = []
            for a in near:
                for e in self.out[a]:
                    if self.room[e] and level[self.to[e]] < 0:
                        level[self.to[e]] = level[a] + 1
                        found.append(self.to[e])
            near = found
        return level

    def enlarge(self, words: list[int]) -> None:
        """Route as much as can be of so many more words per pattern; all shortest paths of a round in one step."""
        self.supply = [old + new for old, new in zip(self.supply, words, strict=True)]
        while (level := self._levels())[self.end] >= 0:
            ahead = [0] * len(self.out)  # the arc of each node to try next
            for i in range(self.patterns):
                while self.supply[i] and level[i] == 0 and (path := self._path(i, level, ahead)):
                    sent = min(self.supply[i], *(self.room[e] for e in path))
                    self.supply[i] -= sent
                    for e in path:
                        self.room[e] -= sent
                        self.room[e ^ 1] += sent

    def _path(self, start: int, level: list[int], ahead: list[int]) -> list[int]:
        path, at = [], start
        while at != self.end:
            while ahead[at] < len(self.out[at]):
                e = self.out[at][ahead[at]]
                if self.room[e] and level[self.to[e]] == level[at] + 1:
                    path.append(e)
                    at = self.to[e]
                    break
                ahead[at] += 1
            else:  # a dead end
                if not path:
                    return []
                at = self.to[path.pop() ^ 1]
                ahead[at] += 1
        return path


def min_cost_flow(capacity: list[int], members: list[list[int]], quota: list[int]) -> list[dict[int, int]]:
    """Per pattern the words for each of its sources: as much of the quotas as can be routed, at the least cost.

    A pattern whose one source no other pattern has cannot choose and bypasses the network.
    """
    passes = len(PASS_COSTS)
    users = [0] * len(quota)
    for sources in members:
        for j in sources:
            users[j] += 1
    alone = [len(sources) == 1 and users[sources[0]] == 1 for sources in members]
    flow = [{sources[0]: min(passes * words, quota[sources[0]])} if one else {} for words, sources, one in zip(capacity, members, alone, strict=True)]
    choosing = [i for i, one in enumerate(alone) if not one]
    if choosing:
        net = Network(len(choosing), [members[i] for i in choosing], quota)
        for _ in range(passes):
            net.enlarge([capacity[i] for i in choosing])
        for i, routes in zip(choosing, net.routes, strict=True):
            flow[i] = {j: net.room[e ^ 1] for j, e in zip(members[i], routes, strict=True)}
    return flow


def _plan(rows: DataFrame, weights: tuple[int, ...]) -> tuple[list[tuple], list[tuple]]:
    """Per pattern (pattern, size, whole passes, words of the part pass); per source (name, size, target)."""
    found = rows.groupBy("pattern").agg(F.sum("size").alias("size")).collect()  # patterns, not documents
    names = sorted({x for r in found for x in r.pattern}, key=lambda x: (x is None, x or ""))
    place = {x: i for i, x in enumerate(names)}
    found = sorted(((r.pattern, int(r.size)) for r in found), key=lambda r: [place[x] for x in r[0]])
    sizes = [0] * len(names)
    for pattern, size in found:
        for x in pattern:
            sizes[place[x]] += size
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(names))])
    flow = min_cost_flow([size for _, size in found], [[place[x] for x in pattern] for pattern, _ in found], [math.floor(x + 0.5) for x in wanted])
    plan = []
    for (pattern, size), row in zip(found, flow, strict=True):
        whole, part = divmod(sum(row.values()), size) if size else (0, 0)
        plan.append((pattern, size, whole, part))
    return plan, [(x, sizes[i], wanted[i]) for x, i in place.items()]


def _key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _pattern(sources: Column) -> Column:
    return F.sort_array(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>"))))


@dataclass(frozen=True)
class Mix:
    """``rows``: doc_id, pattern, size and key of every row; ``sources``: source, source_size, target;
    ``passes``: per pattern the whole passes and the last key of the part pass."""

    rows: DataFrame
    sources: DataFrame
    passes: DataFrame
    seed: int
    patterns: int


def sized(plan: DataFrame, rows: int) -> DataFrame:
    """A plan of so many rows, to be broadcast if these are few."""
    return F.broadcast(plan) if rows <= BROADCAST_ROWS else plan


def plan_mix(df: DataFrame, doc_id: Column, sources: Column, size: Column, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> Mix:
    """Decide how often each row is taken. ``sources``: an array of names (null is a name too; no array: no source)."""
    spark = df.sparkSession
    rows = checkpointed(df.select(doc_id.alias("doc_id"), _pattern(sources).alias("pattern"), size.alias("size"), _key(doc_id, seed).alias("key")))
    slim = rows.withColumn("prefix", F.substring("key", 1, PREFIX_DIGITS))
    # one row per pattern and prefix: what any number of documents comes down to
    sums = checkpointed(slim.groupBy("pattern", "prefix").agg(F.sum("size").alias("size")))
    plan, by_source = _plan(sums, weights)
    plans = spark.createDataFrame([(x, whole, part) for x, _, whole, part in plan], "pattern array<string>, whole long, part long")
    upto = Window.partitionBy("pattern").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    cut = sums.withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0))).join(sized(plans, len(plan)), "pattern")
    cut = cut.where((F.col("part") > 0) & (F.col("before") < F.col("part")) & (F.col("before") + F.col("size") >= F.col("part")))
    cut = cut.select("pattern", "prefix", (F.col("part") - F.col("before")).alias("need"))  # one row per pattern
    # the documents of the one prefix where the part pass ends, summed by key and put in order
    edge = slim.join(sized(cut, len(plan)), ["pattern", "prefix"]).groupBy("pattern", "prefix", "key", "need").agg(F.sum("size").alias("size"))
    so_far = Window.partitionBy("pattern").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("middle", F.sum("size").over(so_far) - F.col("size") / 2)
    # a document whose middle lies before the end is taken: the sum nearest to what is needed
    ends = edge.groupBy("pattern").agg(F.coalesce(F.max(F.when(F.col("middle") <= F.col("need"), F.col("key"))), F.min("prefix")).alias("last"))
    passes = checkpointed(plans.join(ends, "pattern", "left").select("pattern", "whole", "last"))
    return Mix(rows, spark.createDataFrame(by_source, "source string, source_size long, target double"), passes, seed, len(plan))


def taken(df: DataFrame, mix: Mix, pattern: str, key: str, has_words: Column, out: str = "passes") -> DataFrame:
    """``df`` and how often the mix takes each row. The plan has one row per pattern."""
    plan = mix.passes.select(F.col("pattern").alias("mix_pattern"), F.col("whole").alias("mix_whole"), F.col("last").alias("mix_last"))
    part = F.when(F.col(key) <= F.col("mix_last"), 1).otherwise(0)
    joined = df.join(sized(plan, mix.patterns), F.col(pattern) == F.col("mix_pattern"), "left")
    return joined.withColumn(out, F.when(has_words, F.col("mix_whole") + part).otherwise(0).cast("long")).drop("mix_pattern", "mix_whole", "mix_last")


def mixed(df: DataFrame, mix: Mix, doc_id: Column, sources: Column, text: Column) -> DataFrame:
    """The mix itself: each row of ``df`` as often as it is taken."""
    names = df.columns
    plain = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], _pattern(sources).alias("x_pattern"), _key(doc_id, mix.seed).alias("x_key"), F.coalesce(text.rlike(WORD), F.lit(False)).alias("x_words"))
    counted = taken(plain, mix, "x_pattern", "x_key", F.col("x_words"), "x_passes")
    repeated = counted.where("x_passes > 0").withColumn("x_pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("x_passes"))))
    return repeated.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
