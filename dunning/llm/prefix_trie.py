"""Conversation prefix trie: shared beginnings of rebuilt conversations, by time-forward processing.

Conversation c is rebuilt as the first h turns of conversation c - c % 5 followed by its own
turns after its first h, with h = crc32(c) % 9. Each distinct beginning of a rebuilt
conversation is a node; the empty one is the root.

Turns are reduced to a digest and a length and range-partitioned in reading order, cut
anywhere, so a conversation of any length is spread. A beginning is known by a polynomial in its
turns' digests (127 bits), which can be continued from a partition's summary: one small row
per partition tells the next ones where their first conversation stands.

The trie is cut into units that stay small: below every node with more conversations than
the limit (a heavy one), and every so many levels. Shards of whole units are sorted in reverse
level order; each node takes what its children have sent from a priority queue that spills
sorted runs to the task's own scratch files, and sends its subtree's totals on to its parent.
Units that others hang below are few (at most twice ``UPPER``, as the limit grows with the
input): their roots then pass totals on among themselves in the same way, and
their nodes are passed once more with what hangs below them. Totals of the other
units are summed by Spark before they meet, so a node with millions of children costs one row a task.

Nulls and edges: rows without conv_id belong to no conversation and take no part; a
null turn comes first; turns of equal number stand in the order of their digest; null role
or text is empty; repeated rows are further turns; texts may be of any length; an empty
table has no node, not even a root. Members that end at a node are hashed as one text, in
order: pieces of it are written in parallel and meet as finished text.
"""

from __future__ import annotations

import copy
import hashlib
import heapq
import pickle
import tempfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dunning.llm.common import checkpointed, narrow

#: Conversations and levels of a unit at least, and the number of upper units that both limits keep to.
UNIT, UPPER = 1024, 100_000
MAX_HEAD = 8
#: Messages in memory before they spill, rows of a result batch, characters of a piece of member ids.
HELD, BATCH, PIECE = 200_000, 8192, 1 << 16
MOD, BASE = (1 << 127) - 1, 0x5DEECE66D1CE4E5B9BF58476D1CE4E5B
ROOT = bytes(16)
KEYS = ["id", "parent", "depth", "n_bytes", "top", "up", "up_depth"]
NODE = "id binary, parent binary, depth long, n_bytes long, top binary, up binary, up_depth long, conv_id long"
TOTALS = f"{NODE}, n_convs long, n_ends long, n_children long, n_leaves long, saved_tokens long, parent_conv_id long"


# ------------------------------------------------------------ reading order
def reading_order(df: DataFrame) -> DataFrame:
    """conv, own (0: a turn of the base conversation), digest, n_bytes: the rebuilt conversations before their own first turns leave."""
    rows = narrow(df, conv="conv_id", turn="turn", role="role", text="text").where("conv IS NOT NULL")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turns = rows.select(F.col("conv").cast("long").alias("conv"), F.col("turn").cast("long").alias("place"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    order = ["place", "digest"]
    nth = F.row_number().over(Window.partitionBy("conv").orderBy(*order))
    heads = turns.where("conv % 5 = 0").withColumn("nth", nth).where(F.col("nth") <= MAX_HEAD)
    heads = heads.withColumn("to", F.explode(F.array(*[F.try_add("conv", F.lit(d).cast("long")) for d in range(-4, 5) if d])))
    heads = heads.where("to - to % 5 = conv").where(F.col("nth") <= F.crc32(F.col("to").cast("string")) % 9)
    heads = heads.join(turns.select(F.col("conv").alias("to")).distinct(), "to", "left_semi")
    both = turns.select("conv", F.lit(1).alias("own"), *order, "n_bytes").unionByName(
        heads.select(F.col("to").alias("conv"), F.lit(0).alias("own"), F.col("nth").cast("long").alias("place"), "digest", "n_bytes")
    )
    by = ["conv", "own", *order]
    return both.repartitionByRange(*by).sortWithinPartitions(*by).drop("place")


class Path:
    """A rebuilt conversation, read turn by turn."""

    def __init__(self, conv: int):
        self.conv, self.skip = conv, zlib.crc32(str(conv).encode()) % 9 if conv % 5 else 0
        self.depth, self.parent, self.prefix, self.power = 0, 0, 0, 1
        self.top, self.top_depth = ROOT, 0

    def take(self, own: int, turn: int) -> bool:
        """Read a turn; False if it is one of the own turns that leave."""
        if own and self.skip:
            self.skip -= 1
            return False
        self.parent = self.prefix
        self.extend(1, turn)
        return True

    def extend(self, n: int, tail: int) -> None:
        """Append n turns that hash to ``tail``."""
        self.prefix = (self.prefix + tail * self.power) % MOD
        self.power = self.power * pow(BASE, n, MOD) % MOD
        self.depth += n

    def follow(self, stretch: tuple) -> int:
        """Read a summarised stretch; the number of turns that stay."""
        _, opening, n, tail = stretch
        stay = sum(self.take(own, turn) for own, turn in opening)
        self.extend(n, tail)
        return stay + n


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns])


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))])


def mapped(df: DataFrame, rows, ddl: str) -> DataFrame:
    """``rows(iterator of tuples)`` over each partition."""
    schema = _arrow(ddl)
    return df.mapInArrow(lambda batches: _batches(rows(_rows(batches)), schema), ddl)


def summaries(rows: Iterator[tuple]) -> Iterator[tuple]:
    """One row: the stretches of the partition's first and last conversation, and whether they are one."""
    first = last = None
    for conv, own, digest, _ in rows:
        turn = int.from_bytes(digest) % MOD
        if last is None or conv != last[0]:
            last, power = [conv, [], 0, 0], 1
            first = first or last
        if len(last[1]) < 2 * MAX_HEAD:  # later turns all stay
            last[1].append((own, turn))
        else:
            last[2], last[3], power = last[2] + 1, (last[3] + turn * power) % MOD, power * BASE % MOD
    if last:
        yield TaskContext.get().partitionId(), pickle.dumps((first, last, first is last))


def carried(parts: list[tuple[int, bytes]]) -> tuple[dict[int, Path], set[int]]:
    """Where a partition's first conversation stands, if it began earlier, and the partitions whose last one goes on."""
    carry: dict[int, Path] = {}
    more: set[int] = set()
    path, chain = None, []
    for part, summary in sorted(parts):
        first, last, one = pickle.loads(summary)
        if path is not None and path.conv == first[0]:
            carry[part] = copy.copy(path)
            if path.follow(first):
                more.update(chain)
            if one:
                chain.append(part)
                continue
        path, chain = Path(last[0]), [part]
        path.follow(last)
    return carry, more


class Reader:
    """Reads a partition in order and gives its nodes' rows."""

    def __init__(self, carry: dict[int, Path], more: set[int], heavy: frozenset = frozenset(), levels: int = 0):
        self.carry, self.more, self.heavy, self.levels = carry, more, heavy, levels

    def walk(self, rows: Iterator[tuple]) -> Iterator[tuple[tuple, bool]]:
        """(node, whether the conversation ends there); node: NODE's columns."""
        part = TaskContext.get().partitionId()
        path = node = None
        for conv, own, digest, n_bytes in rows:
            if path is None or conv != path.conv:
                if node:
                    yield node, True
                if path is None and part in self.carry:
                    path = copy.copy(self.carry[part])
                else:
                    path, node = Path(conv), (ROOT, None, 0, 0, ROOT, None, None, conv)
            if not path.take(own, int.from_bytes(digest) % MOD):
                continue
            if node:
                yield node, False
            me, parent, up = path.prefix.to_bytes(16), path.parent.to_bytes(16), (None, None)
            if parent in self.heavy or (self.levels and path.depth % self.levels == 0):
                up = path.top, path.top_depth
                path.top, path.top_depth = me, path.depth
            node = (me, parent, path.depth, n_bytes, path.top, *up, conv)
        if node:
            yield node, part not in self.more

    def ids(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        return ((node[0],) for node, _ in self.walk(rows))

    def ends(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        return ((node[0], node[-1]) for node, last in self.walk(rows) if last)

    def nodes(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        return ((*node, int(last)) for node, last in self.walk(rows))

    def last_tops(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        """The last cut that the partition's last conversation makes in it, if any."""
        found = None
        for node, _ in self.walk(rows):
            found = node if node[0] == node[4] else found if found and found[-1] == node[-1] else None
        if found:
            yield TaskContext.get().partitionId(), found[0], found[2]


# ------------------------------------------------------------ time-forward processing
class Mail:
    """A priority queue of messages whose receivers come in ascending order; sorted runs spill to scratch files."""

    def __init__(self) -> None:
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []
        self.sent = 0

    def send(self, to: tuple, what: tuple) -> None:
        self.sent += 1
        heapq.heappush(self.heap, (to, self.sent, what))
        if len(self.heap) >= HELD:
            run = self._spilled(sorted(self.heap))
            heapq.heappush(self.runs, (*next(run), run))
            self.heap = []

    @staticmethod
    def _spilled(items: list[tuple]) -> Iterator[tuple]:
        file = tempfile.TemporaryFile()  # noqa: SIM115  the task's scratch: gone with it, written anew by its next attempt
        for i in range(0, len(items), 1024):
            pickle.dump(items[i : i + 1024], file)
        file.seek(0)

        def read() -> Iterator[tuple]:
            with file:
                for _ in range(0, n, 1024):
                    yield from pickle.load(file)

        n = len(items)
        return read()

    def receive(self, at: tuple) -> Iterator[tuple]:
        while self.heap and self.heap[0][0] == at:
            yield heapq.heappop(self.heap)[2]
        while self.runs and self.runs[0][0] == at:
            *_, what, run = self.runs[0]
            yield what
            following = next(run, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (*following, run))


def passed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Nodes of a shard in reverse level order, with what hangs below them in other units: their totals inside the shard.

    A node's row goes to its parent, which gives it out with its own smallest member; roots of units go out at once.
    """
    mail = Mail()
    for *node, kids, leaves, saved in rows:
        me, parent, depth, n_bytes, top, _, _, conv_id, n_convs, n_ends = node
        saved += (n_convs - 1) * n_bytes
        for child in mail.receive((-depth, me)):
            kids, leaves, saved = kids + 1, leaves + child[-2], saved + child[-1]
            yield (*child, conv_id)
        done = (*node, kids, 1 if n_ends == n_convs else leaves, saved)
        if me == top:
            yield (*done, None)
        else:
            mail.send((1 - depth, parent), done)


def raised(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Unit roots in reverse level order: their subtrees' whole totals."""
    mail = Mail()
    for me, parent, depth, up, up_depth, leaves, saved in rows:
        for more in mail.receive((-depth, me)):
            leaves, saved = leaves + more[0], saved + more[1]
        if up is not None:
            mail.send((-up_depth, up), (leaves, saved))
        yield parent, leaves, saved


def in_shards(nodes: DataFrame, below: DataFrame | None = None) -> DataFrame:
    if below is None:
        nodes = nodes.withColumns({c: F.lit(0).cast("long") for c in ("kids", "leaves", "saved")})
    else:
        nodes = nodes.join(F.broadcast(below.withColumnRenamed("parent", "id")), "id", "left").fillna(0, ["kids", "leaves", "saved"])
    shards = nodes.select(*KEYS, "conv_id", "n_convs", "n_ends", "kids", "leaves", "saved").repartition("top")
    return mapped(shards.sortWithinPartitions(F.col("depth").desc(), "id"), passed, TOTALS)


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """TOTALS of all nodes: within shards, then across shard roots, then once more where others hang below.

    The three broadcasts hold at most one row per unit that others hang below, or per node of such units that has
    children in others: no more than twice ``UPPER``.
    """
    inside = checkpointed(in_shards(nodes))
    roots = inside.where("id = top")
    upper = F.broadcast(roots.where("up IS NOT NULL").select(F.col("up").alias("unit")).distinct())
    lowest = roots.where("up IS NOT NULL").join(upper, F.col("id") == F.col("unit"), "left_anti")
    sums = [F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")]
    direct = lowest.groupBy("up").agg(*sums).select(F.col("up").alias("unit"), "leaves", "saved")
    joints = roots.join(upper, F.col("id") == F.col("unit"), "left_semi").join(direct, F.col("id") == F.col("unit"), "left").fillna(0, ["leaves", "saved"])
    joints = joints.select("id", "parent", "depth", "up", "up_depth", F.expr("leaves + n_leaves").alias("leaves"), F.expr("saved + saved_tokens").alias("saved"))
    whole = mapped(joints.repartition(1).sortWithinPartitions(F.col("depth").desc(), "id"), raised, "parent binary, leaves long, saved long").where("parent IS NOT NULL")
    hung = lowest.select("parent", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")).groupBy("parent").agg(F.count(F.lit(1)).alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    below = hung.unionByName(whole.withColumn("kids", F.lit(1).cast("long"))).groupBy("parent").agg(*[F.sum(c).alias(c) for c in ("kids", "leaves", "saved")])
    again = inside.join(upper, F.col("top") == F.col("unit"), "left_semi")
    done = inside.join(upper, F.col("top") == F.col("unit"), "left_anti").unionByName(in_shards(again, below))
    joined_at = below.select(F.col("parent").alias("at"))
    parents = inside.join(F.broadcast(joined_at), F.col("id") == F.col("at"), "left_semi").select(F.col("id").alias("at"), F.col("conv_id").alias("at_conv"))
    met = done.join(F.broadcast(parents), F.col("parent") == F.col("at"), "left")
    return met.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "at_conv")).drop("at", "at_conv")


# ------------------------------------------------------------ members that end at a node
def pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Comma-joined member ids of each node, piece by piece."""
    at, held, size = None, [], 0
    for me, conv in rows:
        if held and (me != at or size >= PIECE):
            yield at, int(held[0]), ",".join(held)
            held, size = [], 0
        at = me
        held.append(str(conv))
        size += len(held[-1]) + 1
    if held:
        yield at, int(held[0]), ",".join(held)


def digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    at = found = None
    for me, _, piece in rows:
        if me == at:
            found.update(b"," + piece.encode())
            continue
        if at is not None:
            yield at, found.hexdigest()
        at, found = me, hashlib.sha256(piece.encode())
    if at is not None:
        yield at, found.hexdigest()


def end_digests(ends: DataFrame) -> DataFrame:
    made = mapped(ends.repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id"), pieces, "id binary, least long, piece string")
    return mapped(made.repartition("id").sortWithinPartitions("id", "least"), digests, "id binary, ends_sha256 string")


def trie(df: DataFrame, unit: int | None = None) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = checkpointed(reading_order(df))
    limit = unit or max(UNIT, turns.count() // UPPER)
    carry, more = carried([tuple(r) for r in mapped(turns, summaries, "part int, summary binary").collect()])  # one row a partition
    plain = Reader(carry, more)
    counts = mapped(turns, plain.ids, "id binary").groupBy("id").count()
    heavy = frozenset(bytes(r.id) for r in counts.where(F.col("count") > limit).collect())  # at most twice UPPER
    reader = Reader(carry, more, heavy, limit)
    if carry:  # what the partitions' last conversations have been cut at
        spanning = turns.where(F.col("conv").isin(sorted({p.conv for p in carry.values()})))
        tops = {part: (bytes(top), depth) for part, top, depth in mapped(spanning, Reader(carry, more, heavy, limit).last_tops, "part int, top binary, depth long").collect()}
        at = None
        for part in range(max(carry) + 1):
            if part in carry:
                carry[part].top, carry[part].top_depth = at
            at = tops.get(part, at)
    rows = mapped(turns, reader.nodes, f"{NODE}, ends int")
    nodes = rows.groupBy(*KEYS).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("ends").alias("n_ends"))
    totals = subtree_totals(nodes)
    ends = end_digests(mapped(turns, plain.ends, "id binary, conv_id long"))
    out = totals.join(ends, "id", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
