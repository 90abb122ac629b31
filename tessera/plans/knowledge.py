"""Knowledge layers of ``documents``, and the graph of the star schema beside search hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import knowledge as K
from . import graph
from .registry import query, table

_MENTIONS = "[CASE WHEN contains(lower(text), 'licensed') THEN 'Licence' END, CASE WHEN contains(lower(text), '@mail') THEN 'Mail' END, CASE WHEN contains(lower(text), 'the ') THEN 'Article' END]"
_LAYERS = f"""WITH h AS (SELECT 'document:' || doc_id AS src, 'source' AS kind, 'PUBLISHED_BY' AS type, source AS label FROM documents UNION ALL
SELECT 'document:' || doc_id, 'language', 'WRITTEN_IN', lang FROM documents UNION ALL
SELECT 'document:' || doc_id, 'term', 'MENTIONS', unnest(list_filter({_MENTIONS}, lambda x: x IS NOT NULL)) FROM documents),
edges AS (SELECT DISTINCT src, kind || ':' || lower(label) AS dst, type FROM h WHERE trim(label) <> ''),
nodes AS (SELECT DISTINCT 'document:' || doc_id AS id, 'document' AS type, CAST(doc_id AS VARCHAR) AS label FROM documents UNION ALL
SELECT kind || ':' || lower(label), min(kind), min(label) FROM h WHERE trim(label) <> '' GROUP BY 1)"""


def layered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, lower = table(spark, sf_dir, "documents"), F.lower("text")
    terms = [F.when(F.contains(lower, F.lit(word)), name) for word, name in (("licensed", "Licence"), ("@mail", "Mail"), ("the ", "Article"))]
    kinds = {"source": ("PUBLISHED_BY", F.array("source")), "language": ("WRITTEN_IN", F.array("lang")), "term": ("MENTIONS", F.array_compact(F.array(*terms)))}
    return K.layers(docs, "doc_id", kinds)


@query(f"{_LAYERS} SELECT * FROM nodes")
def knowledge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir)[0]


@query(f"{_LAYERS} SELECT * FROM edges")
def knowledge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir)[1]


@query(
    f"""{_LAYERS}, n AS (SELECT e.src AS id, v.type AS kind, v.label FROM edges e JOIN nodes v ON v.id = e.dst)
SELECT d.id, array_to_string(list_sort(list_distinct(coalesce(list(label) FILTER (kind = 'source'), []))), ',') AS source, array_to_string(list_sort(list_distinct(coalesce(list(label) FILTER (kind = 'language'), []))), ',') AS language,
array_to_string(list_sort(list_distinct(coalesce(list(label) FILTER (kind = 'term'), []))), ',') AS term FROM (SELECT id FROM nodes WHERE type = 'document') d LEFT
JOIN n ON n.id = d.id GROUP BY d.id"""
)
def document_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's neighbours by type."""
    nodes, edges = layered(spark, sf_dir)
    kinds = ["source", "language", "term"]
    found = K.contexts(nodes, edges, nodes.filter("type = 'document'").select("id"), kinds)
    return found.select("id", *[F.array_join(k, ",").alias(k) for k in kinds])


@query("""SELECT o_custkey, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1
WHEN '3-MEDIUM' THEN 2 ELSE 3 END, o_orderkey) AS INTEGER) AS place FROM orders""")
def doc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a chain of kinds."""
    return K.chains(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", {"1-URGENT": 1, "3-MEDIUM": 2}, "o_orderkey")


_BEST = "best AS (SELECT s_suppkey, s_nationkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 20)"


def best_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(20).select("s_suppkey", "s_nationkey", "s_name")


@query(f"""WITH {_BEST} SELECT b.s_suppkey, s.s_suppkey AS related, CAST(row_number() OVER (PARTITION BY b.s_suppkey ORDER BY s.s_suppkey) AS INTEGER) AS place FROM best b
JOIN supplier s ON s.s_nationkey = b.s_nationkey AND s.s_suppkey <> b.s_suppkey QUALIFY place <= 5""")
def expand_with_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with at most five others of their project."""
    return K.expanded_hits(best_suppliers(spark, sf_dir), table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey")


@query(f"""WITH {_BEST} SELECT c_custkey FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer) AND c_nationkey IN (SELECT s_nationkey FROM best
WHERE s_suppkey % 2 = 0)""")
def search_with_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projects of the hits that hold a condition, and their documents of one kind."""
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "s_nationkey")
    target = customers.agg(F.min("c_mktsegment")).head()[0]
    return K.graph_search(best_suppliers(spark, sf_dir), customers, "s_nationkey", "c_mktsegment", F.col("s_suppkey") % 2 == 0, target).select("c_custkey")


RULES = [
    (["supplier", "region"], [("supplier", "IN_NATION", "nation"), ("nation", "IN_REGION", "region")]),
    (["customer", "nation"], [("customer", "IN_NATION", "nation")]),
]


def question(spark: SparkSession, sf_dir: str) -> str:
    name = table(spark, sf_dir, "region").filter("r_regionkey = 2").head()["r_name"]
    return f"Which supplier is in the region {name}?"


@query(f"""{graph.GRAPH} SELECT c.id, c.label FROM nodes c JOIN edges e ON e.src = c.id JOIN edges f ON f.src = e.dst JOIN nodes r ON r.id = f.dst WHERE c.type = 'supplier'
AND r.type = 'region' AND r.label = (SELECT r_name FROM region WHERE r_regionkey = 2)""")
def question_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question becomes a chain of relations by rules; the named end filters it."""
    return K.answer(question(spark, sf_dir), graph.nodes(spark, sf_dir), graph.edges(spark, sf_dir), RULES)


@query("""SELECT count(*) AS n, CASE WHEN count(*) >= 10 THEN 'good' WHEN count(*) >= 5 THEN 'fair' WHEN count(*) > 0 THEN 'poor' ELSE 'empty' END AS verdict FROM supplier
JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2""")
def question_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.verdict(question_pattern(spark, sf_dir))


@query(
    """WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
h AS (SELECT *, regexp_matches(trim(line), '^Licensed.*|^This work is.*') AS hd FROM l), s AS (SELECT *, sum(CAST(hd AS INTEGER)) OVER (PARTITION BY doc_id
ORDER BY n) AS section_no FROM h)
SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, md5(concat_ws(chr(10), '[' || max(lang) || ']', '[' || max(CASE
WHEN hd THEN trim(line) END) || ']', string_agg(CASE WHEN NOT hd THEN line END, chr(10) ORDER BY n))) AS digest FROM s GROUP BY doc_id, section_no"""
)
def section_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections as labelled blocks; license lines act as headings, as in ``heading_sections``."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    heading = F.trim("line").rlike("^Licensed.*|^This work is.*")
    numbered = lines.withColumn("hd", heading).withColumn("section_no", F.sum(F.col("hd").cast("long")).over(K.Window.partitionBy("doc_id").orderBy("n")))
    inner = F.transform(F.array_sort(F.collect_list(F.when(~F.col("hd"), F.struct("n", "line")))), lambda x: x["line"])
    made = numbered.groupBy("doc_id", "section_no").agg(
        F.max("lang").alias("lang"), F.max(F.when(F.col("hd"), F.trim("line"))).alias("title"),
        F.when(F.count_if(~F.col("hd")) > 0, F.array_join(inner, "\n")).alias("text")
    )
    return K.section_blocks(made, "doc_id", F.col("text"), F.col("title"), [F.col("lang")]).select("doc_id", "section_no", F.md5(F.col("block").cast("binary")).alias("digest"))
