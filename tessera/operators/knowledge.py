"""Knowledge layers over documents, and what a graph adds to search hits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph as G

#: How many rows make a result good, fair or poor.
GOOD, FAIR = 10, 5


def layers(docs: DataFrame, id_col: str, kinds: Mapping[str, tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """``nodes(id, type, label)`` and ``edges(src, dst, type)`` of documents and of what they hold.

    ``kinds`` gives for each node type its relation and an array of values; one scan
    makes all edges, and a value's node is made once, whatever holds it.
    """

    def entries(kind: str, relation: str, values: Column) -> Column:
        filled = F.filter(values, lambda v: F.coalesce(F.trim(v), F.lit("")) != "")
        return F.transform(filled, lambda v: F.struct(F.lit(kind).alias("kind"), F.lit(relation).alias("type"), F.trim(v).alias("label")))

    held = F.concat(*[entries(kind, relation, values) for kind, (relation, values) in kinds.items()])
    own = F.concat(F.lit("document:"), F.col(id_col))
    rows = docs.select(own.alias("src"), F.explode(held).alias("h")).select("src", F.concat("h.kind", F.lit(":"), F.lower("h.label")).alias("dst"), "h.type", "h.kind", "h.label")
    values = rows.groupBy("dst").agg(F.min("kind").alias("type"), F.min("label").alias("label")).select(F.col("dst").alias("id"), "type", "label")
    nodes = docs.select(own.alias("id"), F.lit("document").alias("type"), F.col(id_col).cast("string").alias("label")).distinct().unionByName(values)
    return nodes, rows.select("src", "dst", "type").distinct()


def contexts(nodes: DataFrame, edges: DataFrame, ids: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """``id`` and, for each node type, the sorted labels of the neighbours of that type; ids without a node have no row."""
    own = nodes.join(ids, "id", "left_semi").select("id")
    near = G.both_ways(edges).join(own, F.col("a") == F.col("id"), "left_semi").join(nodes.select(F.col("id").alias("b"), F.col("type").alias("kind"), "label"), "b")
    gathered = near.groupBy(F.col("a").alias("id")).agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("label")))).alias(k) for k in kinds])
    found = own.join(gathered, "id", "left")
    return found.select("id", *[F.coalesce(k, F.array().cast("array<string>")).alias(k) for k in kinds])


def chains(rows: DataFrame, group: str, kind: str, ranks: Mapping[str, int], id_col: str) -> DataFrame:
    """``group, id, place``: each group's documents in the order in which its kinds follow one another; other kinds come last."""
    table = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    order = F.coalesce(F.try_element_at(table, F.col(kind)), F.lit(len(ranks) + 1))
    place = F.row_number().over(Window.partitionBy(group).orderBy(order, id_col))
    return rows.select(group, F.col(id_col).alias("id"), place.alias("place"))


def expanded_hits(hits: DataFrame, docs: DataFrame, group: str, id_col: str, most: int = 5) -> DataFrame:
    """Each hit with at most ``most`` other documents of its group (a null group has none): ``id, related, place``.

    A group's members are cut to ``most + 1`` before they meet the hits, so a large group costs no more than a small one.
    """
    wanted = docs.filter(F.col(group).isNotNull()).join(hits.select(group).distinct(), group, "left_semi")
    members = wanted.select(group, F.col(id_col).alias("related")).withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy("related"))).filter(F.col("n") <= most + 1)
    met = hits.select(id_col, group).join(members, group).filter(F.col(id_col) != F.col("related"))
    place = F.row_number().over(Window.partitionBy(id_col).orderBy("related"))
    return met.select(id_col, "related", place.alias("place")).filter(F.col("place") <= most)


def graph_search(hits: DataFrame, docs: DataFrame, group: str, kind: str, condition: Column, target: str | None) -> DataFrame:
    """Documents of the wanted kind in the groups of those hits that hold a condition."""
    groups = hits.filter(condition & F.col(group).isNotNull()).select(group).distinct()
    found = docs.join(groups, group, "left_semi")
    return found if target is None else found.filter(F.col(kind) == target)


def pattern_of(question: str, rules: Sequence[tuple[Sequence[str], Sequence[tuple[str, str, str]]]]) -> Sequence[tuple[str, str, str]] | None:
    """The chain of the first rule of which every word stands in the question."""
    lower = question.lower()
    return next((chain for words, chain in rules if all(w in lower for w in words)), None)


def answer(question: str, nodes: DataFrame, edges: DataFrame, rules: Sequence[tuple[Sequence[str], Sequence[tuple[str, str, str]]]]) -> DataFrame:
    """``id, label`` of the first place of the question's pattern whose last place's label stands in the question.

    A question without a rule gives no rows; where no label is named, none is asked for.
    """
    chain = pattern_of(question, rules)
    if chain is None:
        return nodes.filter(F.lit(False)).select("id", "label")
    named = F.lit(question.lower()).contains(F.lower("label"))
    last = chain[-1][2]
    asked = nodes.filter((F.col("type") == last) & named).limit(1).count() > 0
    kept = nodes.filter((F.col("type") != last) | named) if asked else nodes
    return G.pattern(edges, kept, chain, 0).select("id", "label")


def verdict(rows: DataFrame) -> DataFrame:
    """``n, verdict``: how many rows a pattern query found, and what that is worth."""
    n = F.count("*")
    return rows.agg(n.alias("n"), F.when(n >= GOOD, "good").when(n >= FAIR, "fair").when(n > 0, "poor").otherwise("empty").alias("verdict"))


def section_blocks(sections: DataFrame, id_col: str, text: Column, title: Column, labels: Sequence[Column]) -> DataFrame:
    """One text block a section: its labels and title in brackets, a line each, then its text."""
    head = F.concat_ws("\n", *[F.when(F.coalesce(F.trim(x), F.lit("")) != "", F.concat(F.lit("["), F.trim(x), F.lit("]"))) for x in (*labels, title)])
    return sections.select(id_col, "section_no", F.concat_ws("\n", F.nullif(head, F.lit("")), text).alias("block"))
