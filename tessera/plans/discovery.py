"""Dictionary layers, similar projects and references between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import dictionary as D
from ..operators import linkage
from ..operators.similar import Similar
from .registry import query, table

LAYERS = ["organisation", "technology", "method", "domain", "section", "keyword"]
RELATIONS = {"organisation": "ISSUED_BY", "technology": "USES_TECH", "method": "USES_METHOD", "domain": "IN_DOMAIN", "section": "HAS_SECTION", "keyword": "HAS_KEYWORD"}

# The dictionary: the long words of the benchmark passages are forms, words with the same beginning are one term, and the
# terms with the same two first letters have the first of them as their parent.
_DICTIONARY = f"""f AS (SELECT DISTINCT w AS form FROM (SELECT unnest(regexp_extract_all(lower(text), '[0-9a-z가-힣_]+')) AS w FROM benchmark) WHERE length(w) >= 7),
c AS (SELECT DISTINCT 'T:' || left(form, 4) AS canonical, [{', '.join(f"'{x}'" for x in LAYERS)}][CAST(ascii(substr(form, 2, 1)) % 6 AS INTEGER) + 1] AS layer, form
FROM f),
d AS (SELECT *, min(canonical) OVER (PARTITION BY layer, left(canonical, 4)) AS parent FROM c),
t AS (SELECT doc_id, lower(text) AS t FROM documents), hits AS (SELECT doc_id, layer, canonical, min(strpos(t, form) - 1) AS first, count(*) AS forms FROM t
JOIN d ON contains(t, form) GROUP BY ALL)"""


def words_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.explode(F.filter(tokens(F.col("text")), lambda w: F.length(w) >= 7))
    forms = table(spark, sf_dir, "benchmark").select(form.alias("form")).distinct()
    layer = F.element_at(F.array(*[F.lit(x) for x in LAYERS]), (F.ascii(F.substring("form", 2, 1)) % 6 + 1).cast("int"))
    named = forms.select(F.concat(F.lit("T:"), F.left("form", F.lit(4))).alias("canonical"), layer.alias("layer"), "form")
    first = named.groupBy("layer", F.left("canonical", F.lit(4)).alias("start")).agg(F.min("canonical").alias("parent"))
    return named.withColumn("start", F.left("canonical", F.lit(4))).join(first, ["layer", "start"]).drop("start")


@query(f"WITH {_DICTIONARY} SELECT doc_id, layer, canonical, first FROM hits")
def dictionary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of the dictionary in every text, with its first place; one pass whatever the number of forms."""
    found = D.terms(table(spark, sf_dir, "documents"), words_dictionary(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "layer", "canonical", "first")


_RELATION = "CASE layer " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RELATIONS.items()) + " END"
_GRAPH = f"""WITH {_DICTIONARY}, used AS (SELECT DISTINCT layer, canonical FROM hits), up AS (SELECT DISTINCT u.layer, d.parent, u.canonical FROM used u
JOIN d USING (layer, canonical) WHERE layer = 'technology' AND parent <> canonical),
edges AS (SELECT 'document:' || doc_id AS src, layer || ':' || lower(canonical) AS dst, {_RELATION} AS type FROM hits UNION ALL
SELECT layer || ':' || lower(parent), layer || ':' || lower(canonical), 'PARENT_TECH' FROM up),
nodes AS (SELECT layer || ':' || lower(canonical) AS id, layer AS type, canonical AS label FROM (SELECT * FROM used UNION SELECT layer, parent FROM up) UNION ALL
SELECT DISTINCT 'document:' || doc_id, 'document', CAST(doc_id AS VARCHAR) FROM hits)"""


def dictionary_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    words = words_dictionary(spark, sf_dir)
    return D.layers(D.terms(table(spark, sf_dir, "documents"), words), words, RELATIONS)


@query(f"{_GRAPH} SELECT id, type, label FROM nodes")
def dictionary_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary_graph(spark, sf_dir)[0]


@query(f"{_GRAPH} SELECT src, dst, type FROM edges")
def dictionary_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to their organisations, technologies, methods, domains, sections and keywords, and technologies to those below them."""
    return dictionary_graph(spark, sf_dir)[1].select("src", "dst", "type")


# Customers stand for projects: two of three have a nation as their organisation, segments are kinds, order priorities features.
_PROJECTS = """p AS (SELECT c_custkey AS item, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_nationkey || '/' || c_custkey % 4 END AS org, c_mktsegment AS kind FROM customer),
f AS (SELECT o_custkey AS item, list_sort(list_distinct(list(o_orderpriority || year(o_orderdate) % 2))) AS s FROM orders GROUP BY 1),
q AS (SELECT p.*, f.s FROM p LEFT JOIN f USING (item)),
pairs AS (SELECT x.item AS a, y.item AS b, CASE WHEN x.org <> '' AND x.org = y.org THEN 'organisation'
WHEN x.org = '' AND y.org = '' AND ((x.kind = 'FURNITURE' AND y.kind IN ('BUILDING', 'MACHINERY')) OR (y.kind = 'FURNITURE'
AND x.kind IN ('BUILDING', 'MACHINERY'))) THEN 'sequence'
WHEN len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) >= 0.6 THEN 'composition' END AS rule FROM q x JOIN q y ON x.item <> y.item)"""


def projects(spark: SparkSession, sf_dir: str) -> Similar:
    key = F.col("c_custkey")
    org = F.when(key % 3 == 0, F.lit("")).otherwise(F.concat(F.col("c_nationkey").cast("string"), F.lit("/"), (key % 4).cast("string")))
    rows = table(spark, sf_dir, "customer").select(key.alias("item"), org.alias("org"), F.col("c_mktsegment").alias("kind"))
    features = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item"), F.concat("o_orderpriority", (F.year("o_orderdate") % 2).cast("string")).alias("feature"))
    return Similar(rows, features, "item", "org", "kind", "feature", "FURNITURE", ["BUILDING", "MACHINERY"])


@query(
    f"""WITH {_PROJECTS} SELECT q.item, count(*) FILTER (rule = 'organisation') AS by_organisation, count(*) FILTER (rule = 'sequence') AS by_sequence,
count(*) FILTER (rule = 'composition') AS by_composition
FROM q LEFT JOIN pairs ON pairs.a = q.item GROUP BY q.item"""
)
def similar_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many partners each project has by each rule; classes are joined, never projects."""
    return projects(spark, sf_dir).counts().select("item", "by_organisation", "by_sequence", "by_composition")


# Whole numbers and strings of the tables, as a twin has to name them.
_COLUMNS = {
    "region": "r_regionkey:n r_name:s", "nation": "n_nationkey:n n_name:s n_regionkey:n", "customer": "c_custkey:n c_name:s c_nationkey:n c_mktsegment:s", "supplier": "s_suppkey:n s_name:s s_nationkey:n",
    "part": "p_partkey:n p_name:s p_brand:s p_type:s p_size:n", "orders": "o_orderkey:n o_custkey:n o_orderstatus:s o_orderpriority:s", "lineitem": "l_orderkey:n l_partkey:n l_suppkey:n l_linenumber:n l_returnflag:s l_linestatus:s",
}
_ALL = [(t, *c.split(":")) for t, cs in _COLUMNS.items() for c in cs.split()]
_INCLUDED = " UNION ALL ".join(
    f"""SELECT '{ct}' AS child_table, '{cc}' AS child_column, '{pt}' AS parent_table, '{pc}' AS parent_column, (SELECT count(DISTINCT {cc}) FROM {ct}) AS n_child, (SELECT
count(*) FROM {pt}) AS n_parent, {cc.split('_', 1)[1] == pc.split('_', 1)[1]} AS same_name """
    f"""WHERE (SELECT count(*) = count(DISTINCT {pc}) FROM {pt}) AND NOT EXISTS (SELECT {cc} FROM {ct} WHERE {cc} IS NOT NULL EXCEPT SELECT {pc} FROM {pt}) AND EXISTS (SELECT 1
FROM {ct} WHERE {cc} IS NOT NULL)"""
    for ct, cc, ck in _ALL
    for pt, pc, pk in _ALL
    if ck == pk and (ct, cc) != (pt, pc)
)


@query(_INCLUDED)
def table_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the star schema and the columns that refer to them, found from the values alone."""
    return linkage.references({t: table(spark, sf_dir, t) for t in _COLUMNS})
