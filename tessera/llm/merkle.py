"""Operator 11: a Merkle manifest of a dataset, with a proof for every row.

The rows of a source, in order of their id, are the leaves of a tree in which
every three consecutive nodes have one parent; the trees' tops, in order of the
source, are the leaves of one more tree.  Digests climb in Pregel-style
supersteps over an RDD of vertices: children message their digest to the parent,
a parent whose children are complete hashes them and messages its own parent, and
a vertex that is alone on its level halts as its tree's top.  Reverse supersteps
then hand the path of sibling digests down from the root to the leaves, where it
is hashed as the proof and folded again with the (tampered) leaf.

A vertex is placed by its tree and its ancestor ``LEVELS`` levels up, so that so
many supersteps need no shuffle: a partition streams its vertices in order, and
the levels between are held for one ancestor (``BLOCK`` leaves) at a time.  A
frequent source is dealt out over all partitions; what is shuffled after the
leaves shrinks by ``BLOCK`` with each stratum.  Places in the order come from a
range partitioning by source and id (``ordering``), never from one task.

A null id sorts first, writes ``-`` and is never tampered with.  Rows of equal id
are ordered by their leaf; such rows that are equal throughout are leaves of
their own, in any order.  A null source is a source of its own, first of all.
Texts of any length are hashed in the JVM.  An empty table gives an empty result;
columns other than the five are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CRC_SQL, cut
from .ordering import in_order

ARITY = 3
#: Supersteps between two shuffles, and the leaves that one vertex so many levels up has.
LEVELS = 4
BLOCK = ARITY**LEVELS
#: Vertices of a stratum that a partition has on average.
VERTICES_AT_ONCE = 20_000
#: What a row's digest covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Vertex = tuple[int, int, int, bytes]  # tree, place on the level, vertices of the tree on the level, digest


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _leaf(text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[_field(text if name == "text" else F.col(name)) for name in FIELDS]).cast("binary"), 256))


def leaves(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, source, leaf, twin``: digests of 32 bytes; the twin is the tampered row's, null where nothing is tampered with."""
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.col("text").contains("\n")
    twin = F.when(tampered, _leaf(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    named = docs.select(F.col(id_col).alias("doc_id"), *FIELDS[1:])
    return named.select("doc_id", "source", _leaf(F.col("text")).alias("leaf"), twin.alias("twin"))


def _hash(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join([d.hex() for d in digests]).encode()).digest()


def superstep(vertices: Iterator[Vertex]) -> Iterator[Vertex]:
    """One level up: the vertices of a level, in order, give those of the next; a lone vertex halts and stays."""
    for (tree, parent, n), children in groupby(vertices, key=lambda v: (v[0], v[1] // ARITY, v[2])):
        digests = [v[3] for v in children]
        yield (tree, parent, n, digests[0]) if n == 1 else (tree, parent, -(-n // ARITY), _hash(digests))


def up(vertices: Iterator[Vertex]) -> Iterator[Vertex]:
    """``LEVELS`` supersteps over vertices that are together with all of their ancestors' vertices."""
    for _ in range(LEVELS):
        vertices = superstep(vertices)
    return vertices


def reverse_supersteps(block: list[Vertex], path: bytes) -> list[bytes]:
    """The path to the root of each of the block's vertices, given the path of their common ancestor.

    A path has a step for each level, the lowest first: one byte for the place in
    the run and the run's length, then the siblings' digests.
    """
    levels = [block]
    for _ in range(LEVELS):
        levels.append(list(superstep(iter(levels[-1]))))
    paths = [path]
    for level, above in zip(levels[-2::-1], levels[:0:-1], strict=True):
        if level[0][2] == 1:  # the tree's top has halted: above it there are no steps of this tree
            continue
        first = above[0][1]
        runs: list[list[bytes]] = [[] for _ in above]
        for _, at, _, digest in level:
            runs[at // ARITY - first].append(digest)
        down = []
        for _, at, _, _ in level:
            run, mine = runs[at // ARITY - first], at % ARITY
            step = bytes([mine * 4 + len(run)]) + b"".join(run[:mine] + run[mine + 1 :])
            down.append(step + paths[at // ARITY - first])
        paths = down
    return paths


def steps(path: bytes) -> Iterator[tuple[int, list[str]]]:
    """Place in the run and the siblings' digests in hex, for each level that a path goes up."""
    at = 0
    while at < len(path):
        mine, others = path[at] >> 2, (path[at] & 3) - 1
        at += 1
        yield mine, [path[at + 32 * i : at + 32 * i + 32].hex() for i in range(others)]
        at += 32 * others


def fold(leaf: str, path: bytes) -> str:
    """The root that a leaf and its siblings give."""
    now = leaf
    for mine, others in steps(path):
        now = hashlib.sha256("".join([*others[:mine], now, *others[mine:]]).encode()).hexdigest()
    return now


def _place(key: tuple) -> int:
    return key[0] * 40_503 + key[1]


def _placed(vertices: RDD, many: int) -> RDD:
    """Records (tree, place, n, digest, ...) dealt by tree and block, in order within a partition."""
    keyed = vertices.map(lambda v: ((v[0], v[1] // BLOCK, v[1]), v))
    return keyed.repartitionAndSortWithinPartitions(many, _place)


def _strata(n: int) -> int:
    """Strata of ``LEVELS`` supersteps until a tree of ``n`` leaves has one vertex; none for a lone leaf."""
    count = 0
    while n > 1:
        n, count = -(-n // BLOCK), count + 1
    return count


def climb(vertices: RDD, largest: int, total: int, trees: int) -> tuple[list[RDD], RDD]:
    """Strata of placed vertices from the leaves up, and (tree, 0, 1, digest) of each tree's top."""
    strata = []
    for _ in range(_strata(largest)):
        placed = _placed(vertices, max(1, -(-total // VERTICES_AT_ONCE)))
        strata.append(placed)
        vertices = placed.mapPartitions(lambda rows: up(v[:4] for _, v in rows), True)
        total = total // BLOCK + trees
    return strata, vertices.map(lambda v: tuple(v[:4]))


def _down(records: Iterator[tuple]) -> Iterator[tuple]:
    """Vertices with the path and the root that their block's message brought; a partition's messages come first."""
    paths = {}
    for (tree, block), group in groupby(records, key=lambda r: r[0][:2]):
        whole = []
        for key, value in group:
            if key[2] < 0:
                paths[tree, block] = value
            else:
                whole.append(value)
        if whole:
            path, root = paths.pop((tree, block))
            for vertex, own in zip(whole, reverse_supersteps([v[:4] for v in whole], path), strict=True):
                yield vertex, own, root


def descend(strata: list[RDD], tops: RDD) -> RDD:
    """(leaf vertex, path, root) of each leaf; ``tops`` has (tree, path of its top, root)."""
    told = tops.map(lambda t: ((t[0], 0, -1), (t[1], t[2])))
    for number, placed in reversed(list(enumerate(strata))):
        messages = told.partitionBy(placed.getNumPartitions(), _place).mapPartitions(lambda rows: rows, True)
        made = messages.union(placed).mapPartitions(_down, True)
        if number == 0:
            return made
        told = made.map(lambda m: ((m[0][0], m[0][1], -1), (m[1], m[2])))
    raise ValueError("no strata")


def manifest(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    ordered = in_order(cut(leaves(docs, id_col)), "source", "doc_id", "leaf")
    # a source's rows in a range of the order are one row here, and the join by both is even however frequent a source is
    of_source = Window.partitionBy("source")
    here = ordered.groupBy("_part", "source").agg(F.min("_at").alias("_first"), F.count("*").alias("_here"))
    tree, n = F.min("_first").over(of_source).alias("tree"), F.sum("_here").over(of_source).alias("n")
    runs = here.select("_part", F.col("source").alias("_source"), "_here", tree, n)
    largest, trees, total = runs.agg(F.max("n"), F.countDistinct("tree"), F.sum("_here")).head()
    if total is None:
        return spark.createDataFrame([], schema)
    joined = ordered.alias("o").join(runs.alias("r"), (F.col("o._part") == F.col("r._part")) & F.col("o.source").eqNullSafe(F.col("r._source")))
    rows = joined.select("tree", (F.col("_at") - F.col("tree")).alias("at"), "n", "leaf", "doc_id", "twin")

    def vertex(row: tuple) -> tuple:
        tree, at, n, leaf, doc_id, twin = row
        return tree, at, n, bytes(leaf), doc_id, None if twin is None else bytes(twin)

    strata, tops = climb(rows.rdd.map(vertex), max(largest, 2), total, trees)
    # a tree is named by its first place in the whole order, so that trees ascend as their sources do
    subroots = in_order(spark.createDataFrame(tops.map(lambda v: (v[0], v[3])), "tree long, digest binary"), "tree")
    above = subroots.select("_at", "digest", "tree").rdd.map(lambda r: (0, r[0], trees, bytes(r[1]), r[2]))
    upper, top = climb(above, max(trees, 2), trees, 1)
    root = bytes(top.first()[3])
    told = descend(upper, spark.sparkContext.parallelize([(0, b"", root)], 1)).map(lambda m: (m[0][4], m[1], (m[0][3], m[2])))

    def finished(found: tuple) -> tuple:
        (_, _, _, leaf, doc_id, twin), path, (subroot, root) = found
        proof = hashlib.sha256("".join([d for _, others in steps(path) for d in others]).encode()).hexdigest()
        folded = fold((twin or leaf).hex(), path)
        return doc_id, leaf.hex(), subroot.hex(), root.hex(), proof, folded, folded == root.hex()

    return spark.createDataFrame(descend(strata, told).map(finished), schema, verifySchema=False)


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')" for x in (*FIELDS[:-1], text)) + ")"


MANIFEST_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf_sql('text')} AS leaf,
  CASE WHEN {CRC_SQL.format('doc_id')} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS twin FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree FROM d),
v(tree, level, place, n, h) AS (SELECT tree, 0, place, n, leaf FROM l UNION ALL SELECT tree, level + 1, place // 3, (n + 2) // 3, sha256(string_agg(h, ''
  ORDER BY place)) FROM v WHERE n > 1 GROUP BY tree, level, place // 3, n),
s AS (SELECT tree, h AS subroot FROM v WHERE n = 1), u(level, place, n, h) AS (SELECT 0, tree - 1, (SELECT count(*) FROM s), subroot FROM s
  UNION ALL SELECT level + 1, place // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY place)) FROM u WHERE n > 1 GROUP BY level, place // 3, n),
top AS (SELECT h AS root FROM u WHERE n = 1),
w(tree, start, level, place, n, h, proof) AS (SELECT tree, place, 0, place, n, coalesce(twin, leaf), '' FROM l
  UNION ALL SELECT w.tree, w.start, w.level + 1, w.place // 3, (w.n + 2) // 3, sha256(string_agg(CASE WHEN v.place = w.place THEN w.h ELSE v.h END, '' ORDER BY v.place)),
any_value(w.proof) || coalesce(string_agg(CASE WHEN v.place <> w.place THEN v.h END, '' ORDER BY v.place), '') FROM w
  JOIN v ON v.tree = w.tree AND v.level = w.level AND v.place // 3 = w.place // 3 WHERE w.n > 1 GROUP BY w.tree, w.start, w.level, w.place, w.n),
x(tree, start, level, place, n, h, proof) AS (SELECT tree, start, 0, tree - 1, (SELECT count(*) FROM s), h, proof FROM w WHERE n = 1
  UNION ALL SELECT x.tree, x.start, x.level + 1, x.place // 3, (x.n + 2) // 3, sha256(string_agg(CASE WHEN u.place = x.place THEN x.h ELSE u.h END, '' ORDER BY u.place)),
any_value(x.proof) || coalesce(string_agg(CASE WHEN u.place <> x.place THEN u.h END, '' ORDER BY u.place), '') FROM x
  JOIN u ON u.level = x.level AND u.place // 3 = x.place // 3 WHERE x.n > 1 GROUP BY x.tree, x.start, x.level, x.place, x.n)
SELECT l.doc_id, l.leaf, s.subroot, top.root, sha256(x.proof) AS proof_sha256, x.h AS folded_root, x.h = top.root AS verified FROM l JOIN s ON s.tree = l.tree
  JOIN x ON x.tree = l.tree AND x.start = l.place AND x.n = 1, top
"""
