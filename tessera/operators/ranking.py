"""Hit aggregation, ranking scores, hybrid merging, lexical and full-text search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .tables import cut

#: BM25 constants, and the least idf as in full-text engines that floor it.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def aggregate_hits(hits: DataFrame, group: str, score: str = "score", id_col: str = "vec_id") -> DataFrame:
    """Per group: best score, sum, number of hits and the best hit's id; ranked by 5 * best + 0.15 * min(hits, 5)."""
    best = F.max(F.struct(F.col(score), (-F.col(id_col)).alias("_id")))
    rows = hits.groupBy(group).agg(F.max(score).alias("best"), F.sum(score).alias("total"), F.count("*").alias("hits"), best.alias("_top"))
    ranking = 5 * F.col("best") + 0.15 * F.least(F.col("hits"), F.lit(5))
    return rows.withColumn("ranking_score", ranking).withColumn("top_id", -F.col("_top._id")).drop("_top")


def with_rank(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Dense positions 1..n of a small, already aggregated result."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def rerank(rows: DataFrame, ranking: Column, keyword_hits: Column, category_weight: Column, overlap: Column, keyword_weight: float = 0.3) -> DataFrame:
    """Second pass: + keyword weight (at most 5), + category weight, + half a point per shared name term (at most 2)."""
    return rows.withColumn("rerank_score", ranking + F.least(keyword_hits * keyword_weight, F.lit(5.0)) + category_weight + F.least(overlap * 0.5, F.lit(2.0)))


def hybrid_merge(vector: DataFrame, graph: DataFrame, id_col: str, bonus_vector: float = 1.0, bonus_graph: float = 1.5, lift: float = 1.2) -> DataFrame:
    """Full outer merge by id: max score, lifted where the graph confirms a vector hit, plus source and both-hit bonuses."""
    joined = vector.select(id_col, F.col("score").alias("vector_score")).join(graph.select(id_col, F.col("score").alias("graph_score")), id_col, "full")
    v, g = F.coalesce("vector_score", F.lit(0.0)), F.coalesce("graph_score", F.lit(0.0))
    both = F.col("vector_score").isNotNull() & F.col("graph_score").isNotNull()
    score = F.greatest(v, g) * F.when(both, lift).otherwise(1.0)
    source = F.when(F.col("vector_score").isNotNull(), bonus_vector).otherwise(bonus_graph)
    extra = F.when((v > 0) & (g > 0), 1.0).otherwise(0.0) + F.when(both, 0.3).otherwise(0.0)
    return joined.withColumn("merged_score", 5 * score + source + extra)


def interleave(vector: DataFrame, graph: DataFrame, id_col: str) -> DataFrame:
    """Alternate the two ranked lists, vector first; an id counts at its first position."""
    order = Window.orderBy(F.desc("score"), id_col)
    lists = [f.select(id_col, F.row_number().over(order).alias("n"), F.lit(p).alias("part")) for p, f in enumerate((vector, graph))]
    first = lists[0].unionByName(lists[1]).groupBy(id_col).agg(F.min(F.struct("n", "part")).alias("at"))
    return first.select(id_col, F.row_number().over(Window.orderBy("at.n", "at.part", id_col)).cast("long").alias("rank"))


def bm25(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score``: documents with any term.

    One scan counts terms and lengths; its few numbers a document are written once, for the statistics and for the scores.
    """
    words = docs.select(id_col, tokens(F.col(text_col)).alias("w"))
    occurrences = lambda term: F.size(F.filter("w", lambda x: x == term))
    tf = [occurrences(t).alias(f"tf{i}") for i, t in enumerate(terms)]
    counted = cut(words.select(id_col, F.size("w").alias("dl"), *tf))
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    total = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(LEAST_IDF))
        f = F.col(f"tf{i}").cast("double")
        total = total + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hit = F.greatest(*[F.col(f"tf{i}") for i in range(len(terms))], F.lit(0)) > 0
    return counted.filter(hit).crossJoin(F.broadcast(stats)).select(id_col, total.alias("score"))


def inverted_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``term, id, tf``: the full-text index as a table."""
    return docs.select(id_col, F.explode(tokens(F.col(text_col))).alias("term")).groupBy("term", id_col).agg(F.count("*").alias("tf"))


def lexical_score(title: Column, body: Column, terms: list[str]) -> Column:
    """Two points per title term, one per term in the first 4,000 characters, three if the compact query is in the compact title."""
    wanted = F.array(*[F.lit(t) for t in terms])
    overlap = lambda text: F.size(F.array_intersect(tokens(text), wanted))
    compact = F.regexp_replace(F.lower(title), r"[ \t\r\n]+", "")
    return 2 * overlap(title) + overlap(F.substring(body, 1, 4000)) + F.when(compact.contains("".join(terms)), 3).otherwise(0)


def keyword_scores(cases: DataFrame, docs: DataFrame, case_col: str, id_col: str, text_col: str, most: int, least: float, least_docs: int) -> DataFrame:
    """``case, n_docs, kw_score, passed`` of cases with ``words`` to be found and ``asked`` to retrieve by.

    A case's documents are the ``most`` that hold most of its asked words; only postings of asked words are joined.
    """
    asked = cases.select(case_col, F.explode("asked").alias("term"))
    postings = docs.select(id_col, F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))
    shared = postings.join(asked, "term").groupBy(case_col, id_col).agg(F.count("*").alias("n"))
    order = Window.partitionBy(case_col).orderBy(F.desc("n"), id_col)
    found = shared.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).select(case_col, id_col)
    texts = docs.select(id_col, F.lower(F.col(text_col)).alias("_t")).join(found, id_col)
    # which words stand in any of the documents: unions of small arrays, not of texts
    met = texts.join(cases.select(case_col, "words"), case_col).select(case_col, id_col, F.filter("words", lambda w: F.contains(F.col("_t"), w)).alias("in_doc"))
    per_case = met.groupBy(case_col).agg(F.count_distinct(id_col).alias("n_docs"), F.size(F.array_distinct(F.flatten(F.collect_list("in_doc")))).alias("hits"))
    joined = cases.select(case_col, F.size("words").alias("_n")).join(per_case, case_col, "left")
    share = F.coalesce("hits", F.lit(0)) / F.greatest("_n", F.lit(1))
    n_docs = F.coalesce("n_docs", F.lit(0))
    return joined.select(case_col, n_docs.alias("n_docs"), share.alias("kw_score"), ((share >= least) & (n_docs >= least_docs)).alias("passed"))
