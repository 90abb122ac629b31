"""Property graph as two tables, ``nodes(id, type, label)`` and ``edges(src, dst, type)``, and operators on it."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends exist, each id ``src->dst:type`` once."""
    ids = nodes.select("id")
    kept = edges.join(ids, edges.src == ids.id, "left_semi").join(ids, edges.dst == ids.id, "left_semi")
    return kept.dropDuplicates(["src", "dst", "type"]).withColumn("edge_id", F.concat(F.col("src"), F.lit("->"), F.col("dst"), F.lit(":"), F.col("type")))


def type_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    count = lambda f, kind: f.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    return count(nodes, "node").unionByName(count(edges, "edge"))


def both_ways(edges: DataFrame, types: Sequence[str] = ()) -> DataFrame:
    """``a, b, type`` in both directions, optionally of some types."""
    if types:
        edges = edges.filter(F.col("type").isin(*types))
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "type").unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "type"))


def neighbours(edges: DataFrame, nodes: DataFrame, start: str, edge_types: Sequence[str] = (), node_types: Sequence[str] = ()) -> DataFrame:
    """Nodes one edge away in either direction."""
    found = both_ways(edges, edge_types).filter(F.col("a") == start).select(F.col("b").alias("id"), F.col("type").alias("edge_type")).distinct()
    out = found.join(nodes, "id")
    return out.filter(F.col("type").isin(*node_types)) if node_types else out


def reach(edges: DataFrame, seeds: DataFrame, depth: int, edge_types: Sequence[str] = ()) -> DataFrame:
    """``id, depth`` of every node within ``depth`` edges of the seeds: one frontier join per level."""
    steps = cut(both_ways(edges, edge_types).select("a", "b").distinct())
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for level in range(1, depth + 1):  # a level is written once: the next one reads it, and its plan does not grow
        new = frontier.join(steps, frontier.id == steps.a).select(F.col("b").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        frontier = cut(new.withColumn("depth", F.lit(level)))
        seen = seen.unionByName(frontier)
    return seen


def k_hop(edges: DataFrame, seeds: DataFrame, depth: int = 2, most: int = 100) -> DataFrame:
    """The nearest ``most`` nodes by (depth, id); seeds come first."""
    return reach(edges, seeds, depth).orderBy("depth", "id").limit(most)


def shortest_path(edges: DataFrame, start: str, end: str, most: int = 5, edge_types: Sequence[str] = (), sizes: list[tuple[str, int]] | None = None) -> DataFrame:
    """``step, id`` of a shortest undirected path of at most ``most`` edges, the smallest by ids of those; empty if there is none.

    The search goes from both ends, each time where fewer edges leave the frontier, until
    the two have a node in common.  A frontier keeps for each node the smallest path to its
    end, so it never grows beyond the nodes; it is written once a level, and one small
    result a level says how many edges leave it and whether it has met the other.
    ``sizes`` gets the end and the number of nodes of every frontier that was grown.
    """
    steps = cut(both_ways(edges, edge_types).select("a", "b").distinct())
    degree = cut(steps.groupBy("a").agg(F.count("*").alias("degree")))
    spark = edges.sparkSession
    seen = {side: spark.createDataFrame([(node, [node])], "id string, path array<string>") for side, node in (("start", start), ("end", end))}
    frontier, leaving = dict(seen), {side: seen[side].join(degree, F.col("id") == F.col("a")).agg(F.sum("degree")).head()[0] or 0 for side in seen}
    met = start == end
    for _ in range(most):
        side = min(leaving, key=leaving.get)
        if met or not leaving[side]:
            break
        other = "end" if side == "start" else "start"
        grown = frontier[side].join(steps, F.col("id") == F.col("a"))
        path = F.concat("path", F.array("b")) if side == "start" else F.concat(F.array("b"), "path")
        new = grown.select(F.col("b").alias("id"), path.alias("path")).groupBy("id").agg(F.min("path").alias("path"))
        frontier[side] = cut(new.join(seen[side].select("id"), "id", "left_anti"))
        seen[side] = seen[side].unionByName(frontier[side])
        there = frontier[other].select("id", F.lit(1).alias("m"))
        nodes, common, edges_on = frontier[side].join(there, "id", "left").join(degree, F.col("id") == F.col("a")).agg(F.count("*"), F.count("m"), F.sum("degree")).head()
        leaving[side] = edges_on or 0
        if sizes is not None:
            sizes.append((side, nodes))
        met = common > 0
    whole = frontier["start"].select("id", F.col("path").alias("p")).join(frontier["end"].select("id", F.col("path").alias("q")), "id")
    paths = whole.select(F.concat("p", F.slice("q", 2, F.size("q"))).alias("path")).agg(F.min("path").alias("path")).filter("path is not null")
    return paths.select(F.posexplode("path").alias("step", "id"))


def pattern(edges: DataFrame, nodes: DataFrame, chain: Sequence[tuple[str, str, str]], wanted: int, filters: dict | None = None) -> DataFrame:
    """Nodes at place ``wanted`` of a chain (a:T1)-[:R1]->(b:T2)...; ``chain`` holds (from type, relation, to type).

    Semi-joins forward and backward reduce every place exactly, because a chain has no cycle.
    """
    types = [chain[0][0], *[c[2] for c in chain]]
    places = [nodes.filter(F.col("type") == t) for t in types]
    for place, condition in (filters or {}).items():
        places[place] = places[place].filter(condition)
    steps = [edges.filter(F.col("type") == r).select("src", "dst") for _, r, _ in chain]

    def reduced(n: int, towards: int) -> DataFrame:
        """Place n, reduced by everything on one side of it."""
        other = n + towards
        if not 0 <= other < len(places):
            return places[n]
        step, far = (steps[n], "dst") if towards > 0 else (steps[other], "src")
        near = "src" if far == "dst" else "dst"
        linked = step.join(reduced(other, towards).select(F.col("id").alias(far)), far, "left_semi").select(F.col(near).alias("id"))
        return places[n].join(linked, "id", "left_semi")

    return reduced(wanted, 1).join(reduced(wanted, -1).select("id"), "id", "left_semi")


def similar_by_sets(pairs: DataFrame, item: str, feature: str, least: float) -> DataFrame:
    """``a, b, score``: items whose feature sets have a Jaccard similarity of at least ``least``.

    Candidates share a feature of their prefixes: with the features of an item in the
    order of their frequency, rarest first, two sets that are similar enough have one of
    their first n - ceil(least * n) + 1 in common, so frequent features join nothing.
    """
    rows = cut(pairs.select(item, feature).distinct())
    frequency = rows.groupBy(feature).agg(F.count("*").alias("f"))
    own = Window.partitionBy(item)
    placed = rows.join(frequency, feature).withColumn("n", F.count("*").over(own)).withColumn("p", F.row_number().over(own.orderBy("f", feature)))
    prefix = placed.filter(F.col("p") <= F.col("n") - F.ceil(F.col("n") * least) + 1)
    a = prefix.select(F.col(item).alias("a"), feature, F.col("n").alias("na"))
    b = prefix.select(F.col(item).alias("b"), feature, F.col("n").alias("nb"))
    candidates = a.join(b, feature).filter((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * least)).select("a", "b", "na", "nb").distinct()
    held = candidates.join(rows.select(F.col(item).alias("a"), feature), "a")
    shared = held.join(rows.select(F.col(item).alias("b"), feature), ["b", feature]).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("both"))
    scored = shared
    return scored.withColumn("score", F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).filter(F.col("score") >= least).select("a", "b", "score")


def same_value(rows: DataFrame, item: str, value: str, score: float) -> DataFrame:
    """``a, b, score``: items that share a non-empty value."""
    own = rows.filter(F.coalesce(F.trim(F.col(value)), F.lit("")) != "").select(item, value).distinct()
    return own.select(F.col(item).alias("a"), value).join(own.select(F.col(item).alias("b"), value), value).filter("a < b").select("a", "b", F.lit(score).alias("score")).distinct()


def has_all(pairs: DataFrame, item: str, feature: str, wanted: Sequence) -> DataFrame:
    """Items that have every wanted feature (relational division)."""
    return pairs.filter(F.col(feature).isin(*wanted)).groupBy(item).agg(F.count_distinct(feature).alias("n")).filter(F.col("n") == len(set(wanted))).select(item)


def has_any(pairs: DataFrame, item: str, feature: str, wanted: Sequence) -> DataFrame:
    return pairs.filter(F.col(feature).isin(*wanted)).select(item).distinct()


def sequence_edges(rows: DataFrame, group: str, order: Sequence, id_col: str) -> DataFrame:
    """Edge from each row to the next of its group."""
    following = F.lead(id_col).over(Window.partitionBy(group).orderBy(*order))
    return rows.select(group, F.col(id_col).alias("src"), following.alias("dst")).filter("dst is not null")


def replace_type(entries: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """Entries of other types, plus the new ones of this type."""
    return entries.filter(F.col("type") != kind).unionByName(new.filter(F.col("type") == kind))


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes and the edges that touch them."""
    return nodes.filter(~F.col("id").isin(*ids)), edges.filter(~F.col("src").isin(*ids) & ~F.col("dst").isin(*ids))


def visual(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """JSON rows of at most ``most`` nodes and the edges among them."""
    kept = nodes.orderBy("id").limit(most)
    inner = edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi")
    return kept.select(F.lit("node").alias("kind"), F.to_json(F.struct("id", "type", "label")).alias("json")).unionByName(
        inner.select(F.lit("edge").alias("kind"), F.to_json(F.struct("src", "dst", "type")).alias("json"))
    )


#: Fixed words that a read-only graph query may not contain; a procedure is blocked by the beginning of its name.
BLOCKED = ("create", "merge", "delete", "detach delete", "set", "remove", "drop", "load csv", "call dbms", "call apoc", "call db.", "call gds.", "foreach", "unwind")


def read_only(text: str) -> bool:
    """Whether a pattern query only reads: no blocked words, comment or second statement, and something to match or return."""
    lower = re.sub(r"'[^']*'|\"[^\"]*\"", "''", text.lower()).replace("`", " ").strip().rstrip(";")
    if ";" in lower or "//" in lower or "/*" in lower or "--" in lower.replace("-->", "").replace("<--", ""):
        return False
    for words in BLOCKED:
        pattern = r"\s+".join(re.escape(w.rstrip(".")) for w in words.split()) + (r"\s*\." if words.endswith(".") else "" if words.startswith("call") else r"\b")
        if re.search(rf"\b{pattern}", lower):
            return False
    return bool(re.search(r"\b(match|return)\b", lower)) and not re.search(r"\bdetach\b|\bload\b", lower)


def expand_hierarchy(edges: DataFrame, kind: str, ids: Sequence[str], symmetric: bool = True) -> DataFrame:
    """``id, relation``: children of the ids over edges of one type, and parents too unless told otherwise."""
    own = edges.filter(F.col("type") == kind)
    children = own.filter(F.col("src").isin(*ids)).select(F.col("dst").alias("id"), F.lit("child").alias("relation"))
    parents = own.filter(F.col("dst").isin(*ids)).select(F.col("src").alias("id"), F.lit("parent").alias("relation"))
    return (children.unionByName(parents) if symmetric else children).distinct()


def related(edges: DataFrame, start: str, direct: Sequence[str], container: str, most: int) -> DataFrame:
    """``id, score``: nodes by direct typed edges (1.0), then those in the same container (0.5); best first."""
    near = both_ways(edges, direct).filter(F.col("a") == start).select(F.col("b").alias("id"), F.lit(1.0).alias("score"))
    member = edges.filter(F.col("type") == container)
    own = member.filter(F.col("src") == start).select("dst").distinct()
    siblings = member.join(own, "dst", "left_semi").filter(F.col("src") != start).select(F.col("src").alias("id"), F.lit(0.5).alias("score"))
    return near.unionByName(siblings).groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(most)


def overlap_scores(pairs: DataFrame, owner: str, item: str, kinds: dict[str, float], own: str) -> DataFrame:
    """``owner, score``: weighted number of features shared with ``own``'s items, by kind; features are (kind, value)."""
    mine = pairs.filter(F.col(owner) == own).select("kind", "value").distinct()
    shared = pairs.filter(F.col(owner) != own).select(owner, item, "kind", "value").distinct().join(mine, ["kind", "value"])
    weight = F.lit(0.0)
    for kind, w in kinds.items():
        weight = weight + F.when(F.col("kind") == kind, w).otherwise(0.0)
    return shared.groupBy(owner, item).agg(F.sum(weight).alias("score")).filter("score > 0")
