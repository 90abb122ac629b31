"""Operator 12: the prefix trie of conversations by an LCP-aware external mergesort.

A turn is a digest of its role and text, a conversation the packed digests of
its turns.  Map tasks sort what they hold into runs, each row with the number of
turns it shares with the row before it (its LCP).  Runs are dealt out by ranges of
(turns, id), so that copies of one conversation are split by their ids, and each
range merges its pieces of the runs by a loser tree that compares two rows only
where their LCPs are equal, and only from there on.  The merged stream keeps the
open path of the trie on a stack: where a row shares fewer turns, the nodes
beyond are finished and leave the stack.

Nodes on the path of a range's first or last row may go on in its neighbours.
These are at most two paths a range; they leave the range as parts, are added up
by the digest of their prefix, and give their own leaves and savings to the nodes
above them along the path of the range in which they begin.  The ids of
conversations that end at such a node leave as ordered pieces that are hashed in
sequence, never gathered.

Turns of equal number are ordered by their digest.  Null roles and texts are
empty, rows without ``conv_id`` take no part, a remainder has the sign of its
dividend.  An empty table has no nodes, not even a root.  Repeated rows are
turns of their own.  Columns other than the four are not read, whatever their
names.  A conversation's packed turns (20 bytes each) are one row; a range is
sized for ``RANGE_BYTES`` of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CRC_SQL, cut, map_arrow

#: Bytes of a turn's digest in a packed conversation.
WIDTH = 16
#: Most turns that are taken over from another conversation.
BORROWED = 8
#: A run is sorted when it holds so many rows or bytes.
RUN_ROWS = 20_000
RUN_BYTES = 32 << 20
#: Packed bytes of a range on average.
RANGE_BYTES = 32 << 20
#: Ids in a piece of those that end at a node.
PIECE = 4_096
NO_IDS = hashlib.sha256(b"").hexdigest()

#: A conversation in a run: packed turns, id, sizes of the turns' texts, turns shared with the row before.
Row = tuple[bytes, int, bytes, int]


# ---- conversations -------------------------------------------------------------------------------------------------


def turns(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``conv_id, pos, token, size``: each conversation's turns in order, as digests."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    token = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * WIDTH))
    named = conversations.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), "turn", token.alias("token"), F.octet_length(text).alias("size"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "token")) - 1
    return named.select("conv_id", place.alias("pos"), "token", "size")


def borrowed(conv_id: str = "conv_id") -> F.Column:
    """How many turns a conversation takes over from that of its group of five."""
    return F.crc32(F.col(conv_id).cast("string")) % (BORROWED + 1)


def rebuild(own: DataFrame) -> DataFrame:
    """``conv_id, pos, token, size`` of rebuilt conversations; one without turns has one row whose ``pos`` is null."""
    ids = own.select("conv_id").distinct()
    b = F.col("conv_id")
    low, high = F.when(b <= 0, F.greatest(b, F.lit(4 - 2**63)) - 4).otherwise(b), F.when(b >= 0, F.least(b, F.lit(2**63 - 5)) + 4).otherwise(b)
    given = own.filter((b % 5 == 0) & (F.col("pos") < BORROWED)).select(F.explode(F.sequence(low, high)).alias("conv_id"), "pos", "token", "size")
    given = given.filter(F.col("pos") < borrowed()).join(ids, "conv_id", "left_semi")
    kept = own.filter(F.col("pos") >= borrowed())
    none = F.lit(None)
    return given.unionByName(kept).unionByName(ids.select("conv_id", none.cast("int").alias("pos"), none.cast("binary").alias("token"), none.cast("int").alias("size")))


# ---- runs ----------------------------------------------------------------------------------------------------------


def shared(a: bytes, b: bytes, start: int = 0) -> int:
    """Turns that two packed conversations have in common from the first on, ``start`` of which are known to be."""
    most, at = min(len(a), len(b)) // WIDTH, start
    while at < most and a[at * WIDTH : at * WIDTH + WIDTH] == b[at * WIDTH : at * WIDTH + WIDTH]:
        at += 1
    return at


def sorted_run(rows: list[tuple[bytes, int, bytes]]) -> list[Row]:
    """The rows in order of turns and id, each with its LCP."""
    out, before = [], b""
    for packed, conv_id, sizes in sorted(rows):
        out.append((packed, conv_id, sizes, shared(before, packed) if out else 0))
        before = packed
    return out


_RUN_SCHEMA = "packed binary, conv_id long, sizes binary, lcp int, run long, no int"


def runs(rebuilt: DataFrame) -> DataFrame:
    """Packed conversations in sorted runs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, bytes]] = []
        weight, made = 0, 0
        part = TaskContext.get().partitionId()

        def run() -> pa.RecordBatch:
            rows = sorted_run(held)
            names = ["packed", "conv_id", "sizes", "lcp"]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.binary(), pa.int32()))]
            number = pa.array(np.full(len(rows), part << 20 | made, np.int64))
            return pa.RecordBatch.from_arrays([*columns, number, pa.array(np.arange(len(rows), dtype=np.int32))], names=[*names, "run", "no"])

        for packed, conv_id, sizes in _conversations(batches):
            held.append((packed, conv_id, sizes))
            weight += len(packed) + len(sizes)
            if len(held) >= RUN_ROWS or weight >= RUN_BYTES:
                yield run()
                held, weight, made = [], 0, made + 1
        if held:
            yield run()

    return map_arrow(rebuilt.repartition("conv_id").sortWithinPartitions("conv_id", "pos"), work, _RUN_SCHEMA, None)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int, bytes]]:
    """Packed conversations of rows in order of id and place."""
    now, tokens, sizes = None, [], []
    for batch in batches:
        for conv_id, token, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "token", "size")), strict=True):
            if conv_id != now:
                if now is not None:
                    yield b"".join(tokens), now, np.array(sizes, np.int32).tobytes()
                now, tokens, sizes = conv_id, [], []
            if token is not None:
                tokens.append(token)
                sizes.append(size)
    if now is not None:
        yield b"".join(tokens), now, np.array(sizes, np.int32).tobytes()


# ---- merge ---------------------------------------------------------------------------------------------------------


class LoserTree:
    """Merges sorted runs; ``compared`` counts the pairs of rows whose turns had to be looked at.

    A node holds the loser of its match and how many turns it shares with the
    winner, which is the row that left last.  A contender comes with its LCP to
    that row too: of two rows with different LCPs the larger one's is smaller.
    """

    def __init__(self, runs: list[list[Row]]) -> None:
        self.heads = [iter(r) for r in runs]
        self.size = max(1, len(runs))
        self.compared = 0
        self.nodes: list[tuple[int, Row | None, int]] = [(-1, None, 0)] * self.size
        self.winner = self._build(1)

    def _next(self, run: int) -> tuple[int, Row | None, int]:
        row = next(self.heads[run], None) if run < len(self.heads) else None
        return run, row, row[3] if row else 0

    def _build(self, node: int) -> tuple[int, Row | None, int]:
        if node >= self.size:
            run, row, _ = self._next(node - self.size)
            return run, row, 0
        won, self.nodes[node] = self._match(self._build(2 * node), self._build(2 * node + 1))
        return won

    def _match(self, a: tuple, b: tuple) -> tuple[tuple, tuple]:
        """Winner, and the loser with its LCP to the winner."""
        (_, x, m), (_, y, n) = a, b
        if y is None:
            return a, b
        if x is None or n > m:
            return b, a
        if m > n:
            return a, b
        self.compared += 1
        at = shared(x[0], y[0], m)
        first = (x[0][at * WIDTH :], x[1]) <= (y[0][at * WIDTH :], y[1])
        won, lost = (a, b) if first else (b, a)
        return won, (lost[0], lost[1], at)

    def __iter__(self) -> Iterator[tuple[Row, int]]:
        """Rows in order, each with the turns it shares with the row before."""
        while self.winner[1] is not None:
            run, row, lcp = self.winner
            yield row, lcp
            now = self._next(run)
            node = (run + self.size) // 2
            while node:
                now, self.nodes[node] = self._match(now, self.nodes[node])
                node //= 2
            self.winner = now


class Node:
    """An open node; counts grow as what lies below it is finished."""

    __slots__ = ("depth", "size", "first", "least", "members", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, depth: int, size: int, first: bool) -> None:
        self.depth, self.size, self.first = depth, size, first
        self.least, self.members, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends: list[int] = []
        self.waiting: list[tuple] = []  # finished children, which need this node's smallest member

    def meet(self, least: int, members: int) -> None:
        self.least = least if self.least is None else min(self.least, least)
        self.members += members


#: Which of a range's two outer paths a node is on.
BOTH, FIRST, LAST = 0, 1, 2
_NODE_FIELDS = {
    "kind": pa.int8(), "conv_id": pa.int64(), "depth": pa.int32(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(),
    "ends_sha256": pa.string(), "part": pa.int32(), "path": pa.int8(), "key": pa.binary(), "parent_key": pa.binary(), "size": pa.int32(), "no": pa.int32(), "ids": pa.string(),
}
_NODE_SCHEMA = "kind byte, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, part int, path byte, key binary, parent_key binary, size int, no int, ids string"
#: Kinds of rows that a range gives: finished nodes, its parts of nodes that may go on elsewhere, pieces of ids.
FINISHED, PART, IDS = 0, 1, 2


def prefix_keys(packed: bytes) -> list[bytes]:
    """A digest for each prefix of a packed conversation, the empty one first."""
    rolling, out = hashlib.sha256(), []
    for at in range(0, len(packed) + WIDTH, WIDTH):
        out.append(rolling.digest()[:20])
        rolling.update(packed[at : at + WIDTH])
    return out


def open_path(stream: Iterator[tuple[Row, int]], part: int) -> Iterator[dict]:
    """Rows of ``_NODE_FIELDS`` for one range's merged stream."""
    stack: list[Node] = []
    first_keys: list[bytes] = []
    packed = b""

    def finish(node: Node, path: int | None, keys: list[bytes]) -> Iterator[dict]:
        """The node's children leave, and its own row goes to its parent or out as a part."""
        above = stack[-1] if stack else None
        if path is None:
            leaf = node.children == 0
            leaves, saved = node.leaves + leaf, node.saved + (node.members - 1) * node.size
            ends = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest() if node.ends else NO_IDS
            for child in node.waiting:
                yield {"kind": FINISHED, "parent_conv_id": node.least} | child
            above.waiting.append({"conv_id": node.least, "depth": node.depth, "n_convs": node.members, "n_children": node.children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends})
            above.children += 1
        else:
            leaves, saved = node.leaves, node.saved
            for child in node.waiting:
                yield {"kind": FINISHED, "part": part, "path": path} | child
            key = keys[node.depth]
            yield {"kind": PART, "conv_id": node.least, "depth": node.depth, "n_convs": node.members, "n_children": node.children, "n_leaves": leaves, "saved_tokens": saved, "part": part, "path": path, "key": key, "parent_key": keys[node.depth - 1] if node.depth else None, "size": node.size}
            for no, at in enumerate(range(0, len(node.ends), PIECE)):
                yield {"kind": IDS, "key": key, "part": part, "no": no, "ids": ",".join(map(str, node.ends[at : at + PIECE]))}
        if above is not None:
            above.meet(node.least, node.members)
            above.leaves += leaves
            above.saved += saved

    started = False
    for (packed, conv_id, sizes, _), lcp in stream:
        widths = np.frombuffer(sizes, np.int32).tolist()
        if not started:
            first_keys = prefix_keys(packed)
            stack.append(Node(0, 0, True))
        while len(stack) - 1 > (lcp if started else 0):
            node = stack.pop()
            yield from finish(node, FIRST if node.first else None, first_keys)
        for depth in range(len(stack), len(widths) + 1):
            stack.append(Node(depth, widths[depth - 1], not started))
        stack[-1].ends.append(conv_id)
        stack[-1].meet(conv_id, 1)
        started = True
    last_keys = prefix_keys(packed) if started else []
    while stack:
        node = stack.pop()
        yield from finish(node, BOTH if node.first else LAST, last_keys)


def merged(in_runs: DataFrame) -> DataFrame:
    """What each range of the order gives (``_NODE_FIELDS``)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[Row]] = {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("run", "packed", "conv_id", "sizes", "lcp")]
            for run, *row in zip(*columns, strict=True):
                found.setdefault(run, []).append(tuple(row))
        held: list[dict] = []
        for made in open_path(iter(LoserTree(list(found.values()))), TaskContext.get().partitionId()):
            held.append(made)
            if len(held) == 10_000:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    weight = in_runs.agg(F.sum(F.octet_length("packed") + F.octet_length("sizes") + 64)).head()[0] or 0
    ranges = max(int(in_runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-weight // RANGE_BYTES))
    dealt = in_runs.repartitionByRange(ranges, "packed", "conv_id").sortWithinPartitions("run", "no")
    return map_arrow(dealt, work, _NODE_SCHEMA, None)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], kind) for name, kind in _NODE_FIELDS.items()], names=list(_NODE_FIELDS))


# ---- nodes that span ranges ----------------------------------------------------------------------------------------


def _hashed(pieces: DataFrame) -> DataFrame:
    """``key, ends_sha256``: ids in order, hashed as they stream by."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rolling = None, hashlib.sha256()
        out: Callable[[], pa.RecordBatch] = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([rolling.hexdigest()])], names=["key", "ends_sha256"])
        for batch in batches:
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        yield out()
                    now, rolling = key, hashlib.sha256(ids.encode())
                else:
                    rolling.update(b"," + ids.encode())
        if now is not None:
            yield out()

    return map_arrow(pieces.select("key", "part", "no", "ids").repartition("key").sortWithinPartitions("key", "part", "no"), work, "key binary, ends_sha256 string", None)


def _spanning(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes on the ranges' outer paths, whole; and (part, path, depth, conv_id) by which finished children find their parent."""
    parts = found.filter(F.col("kind") == PART)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    same = [F.first(c).alias(c) for c in ("depth", "parent_key", "size")]
    whole = parts.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("part").alias("begins"), *sums, *same)
    kids = whole.filter("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("kids"))
    whole = cut(whole.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0))).drop("kids"))
    # what a node is itself (a leaf, a saving) counts for the nodes above it along the path of the range where it begins
    itself = [(F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("saving"), "begins", F.col("conv_id").alias("least")]
    on_paths = parts.select("key", "part", "path", "depth").join(whole.select("key", *itself), "key")
    here = F.col("part") == F.col("begins")
    below_all = Window.partitionBy("part").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, 0)
    below_own = Window.partitionBy("part", "path").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, 0)
    under = lambda c: F.when(F.col("path") == BOTH, F.sum(F.when(here, F.col(c)).otherwise(0)).over(below_all)).otherwise(F.sum(F.when(here, F.col(c)).otherwise(0)).over(below_own))
    added = on_paths.select("key", under("leaf").alias("leaf"), under("saving").alias("saving")).groupBy("key").agg(F.sum("leaf").alias("leaf"), F.sum("saving").alias("saving"))
    ends = _hashed(found.filter(F.col("kind") == IDS))
    parents = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    nodes = whole.join(added, "key").join(ends, "key", "left").join(parents, "parent_key", "left")
    nodes = nodes.withColumn("n_leaves", F.col("n_leaves") + F.col("leaf")).withColumn("saved_tokens", F.col("saved_tokens") + F.col("saving"))
    return nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_IDS))), on_paths.select("part", "path", "depth", "least")


def trie(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row for each node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    found = cut(merged(cut(runs(rebuild(cut(turns(conversations, id_col)))))))
    nodes, paths = _spanning(found)
    finished = found.filter(F.col("kind") == FINISHED)
    inner = finished.filter("part is null")
    # the join is by range, so that a frequent parent, such as the root, is met in each range apart
    outer = finished.filter("part is not null").drop("parent_conv_id").withColumn("up", F.col("depth") - 1)
    outer = outer.join(paths.select("part", "path", F.col("depth").alias("up"), F.col("least").alias("parent_conv_id")), ["part", "path", "up"])
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = [F.col(n).cast("string" if n == "ends_sha256" else "long").alias(n) for n in names]
    return inner.select(out).unionByName(outer.select(out)).unionByName(nodes.select(out))


TRIE_SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {CRC_SQL.format('conv_id')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h UNION ALL SELECT c.conv_id, pos, role, text FROM c
  JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h),
k AS (SELECT c.conv_id, coalesce(list(md5(role || chr(1) || text) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS l,
  coalesce(list(strlen(text) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS z FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
p AS (SELECT conv_id, d, len(l) AS n, md5(array_to_string(l[1:d], ',')) AS key, CASE WHEN d > 0 THEN md5(array_to_string(l[1:d - 1], ',')) END AS up,
  CASE WHEN d > 0 THEN z[d] ELSE 0 END AS size, list_transform(range(0, d + 1), lambda e: md5(array_to_string(l[1:e], ','))) AS path
  FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM k)),
n AS (SELECT key, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, any_value(path) AS path,
  sha256(coalesce(string_agg(CASE WHEN n = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM p GROUP BY key, d),
f AS (SELECT up AS key, d - 1 AS d, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY ALL), m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT
  JOIN f USING (key, d)),
b AS (SELECT path[e + 1] AS key, e AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * size) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM m) GROUP BY ALL)
SELECT m.conv_id, m.d AS depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, m.ends_sha256 FROM m JOIN b USING (key, d) LEFT JOIN n o ON o.key = m.up AND o.d = m.d - 1
"""
