"""Query clean-up, name rules and one-hop graph queries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import routing as R
from . import graph, search
from .registry import query, table


@query("SELECT item_id, replace(replace(text, 'the', 'teh'), 'teh ', 'the ') AS fixed FROM benchmark")
def typo_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", R.fix_typos(F.col("text"), [("the", "teh"), ("teh ", "the ")]).alias("fixed"))


@query("""SELECT s_suppkey, length(trim(s_name)) BETWEEN 10 AND 150 AND lower(trim(s_name)) NOT IN ('supplier_1', 'supplier#000000002') AND NOT
regexp_matches(trim(s_name), '(은|는|을|를|하고|한다|합니다|[.?!])$') AS ok FROM supplier""")
def project_name_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", R.valid_project_name(F.col("s_name"), ["supplier_1", "supplier#000000002"]).alias("ok"))


@query("""SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'promotion' WHEN contains(p_type, 'LARGE') THEN 'large' WHEN contains(p_type, 'PROMO') THEN 'promotion'
WHEN contains(p_type, 'SMALL') THEN 'small' ELSE p_type END AS category FROM part""")
def category_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", R.category_key(F.col("p_type"), {"PROMO": "promotion", "SMALL": "small", "LARGE": "large"}).alias("category"))


@query(
    f"""{search._TITLED}, s AS (SELECT page_id, list_distinct(regexp_extract_all(lower(title), '[0-9a-z가-힣_]+')) AS w,
regexp_replace(lower(title), '[ \\t\\r\\n\\x0B\\f]+', '', 'g') AS c FROM p)
SELECT page_id, round(CASE WHEN length(c) > 0 AND (contains(c, 'oftheque') OR contains('oftheque', c)) THEN 1.0 ELSE
len(list_intersect(w, ['of', 'the', 'que'])) / greatest(len(w), 3) END, 6)::DOUBLE AS score FROM s"""
)
def title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.titled(spark, sf_dir).select("page_id", F.round(R.title_match(F.col("title"), "of the que"), 6).alias("score"))


@query("""SELECT item_id, nullif(regexp_extract(text, '(Th[a-z]+)', 1), '') AS organisation, nullif(regexp_extract(text, '(20[0-9]{2})', 1), '') AS year, CASE
WHEN contains(lower(text), 'the ') THEN 'english' WHEN contains(lower(text), 'der ') THEN 'german' ELSE 'none' END AS kind,
CAST(len(list_distinct(list_filter(regexp_extract_all(lower(text), '[0-9a-z가-힣_]+'), lambda x: len(x) >= 2))) AS BIGINT) AS terms FROM benchmark""")
def prompt_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.analyse_prompt(F.col("text"), "(Th[a-z]+)", [("english", ["the "]), ("german", ["der "])])
    return table(spark, sf_dir, "benchmark").select("item_id", found.alias("a")).select("item_id", "a.*")


@query("""SELECT page_id, round(CASE WHEN regexp_matches(lower(t), 'the|der') THEN 0.25 ELSE 0 END + CASE WHEN len(string_split_regex(t, '[_ -]')) >= 2 THEN 0.25 ELSE 0 END + CASE
WHEN regexp_matches(lower(t), 'tion') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(lower(t), 'ing') THEN 0.15 ELSE 0 END + CASE WHEN
regexp_matches(lower(t), 'que') THEN 0.15 ELSE 0 END, 4)::DOUBLE AS confidence FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)""")
def filename_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.titled(spark, sf_dir).select("page_id", F.round(R.filename_confidence(F.col("title"), "the|der", "tion", "ing", "que"), 4).alias("confidence"))


@query(f"""{graph.GRAPH} SELECT DISTINCT dst AS id, 'child' AS relation FROM edges WHERE type = 'IN_REGION' AND src = 'nation:2' UNION SELECT DISTINCT src, 'parent' FROM edges
WHERE type = 'IN_REGION' AND dst = 'nation:2'""")
def hierarchy_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.expand_hierarchy(graph.edges(spark, sf_dir), "IN_REGION", ["nation:2"])


@query(f"""{graph.GRAPH} SELECT id, CAST(max(score) AS DOUBLE) AS score FROM (SELECT b AS id, 1.0 AS score FROM both_ways WHERE a = 'nation:2' AND type = 'IN_REGION' UNION ALL
SELECT src, 0.5 FROM edges WHERE type = 'IN_REGION' AND src <> 'nation:2' AND dst IN (SELECT dst FROM edges WHERE src = 'nation:2' AND type = 'IN_REGION')) GROUP BY id
ORDER BY max(score) DESC, id LIMIT 5""")
def related_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.related(graph.edges(spark, sf_dir), "nation:2", ["IN_REGION"], "IN_REGION", 5)


_PAIRS = """p AS (SELECT c_nationkey AS org, c_custkey AS item, 'tech' AS kind, c_mktsegment AS value FROM customer UNION SELECT c_nationkey, c_custkey, 'domain',
CAST(c_acctbal > 0 AS VARCHAR) FROM customer), m AS (SELECT DISTINCT kind, value FROM p WHERE org = 1)"""


@query(f"""WITH {_PAIRS} SELECT org, item, round(sum(CASE p.kind WHEN 'tech' THEN 0.6 ELSE 0.4 END), 4)::DOUBLE AS score FROM p JOIN m ON m.kind = p.kind AND m.value = p.value
WHERE org <> 1 GROUP BY org, item ORDER BY score DESC, item LIMIT 25""")
def similar_to_organisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    one = lambda kind, value: rows.select(F.col("c_nationkey").alias("org"), F.col("c_custkey").alias("item"), F.lit(kind).alias("kind"), value.alias("value"))
    pairs = one("tech", F.col("c_mktsegment")).unionByName(one("domain", (F.col("c_acctbal") > 0).cast("string")))
    found = G.overlap_scores(pairs, "org", "item", {"tech": 0.6, "domain": 0.4}, 1)
    return found.select("org", "item", F.round("score", 4).alias("score")).orderBy(F.desc("score"), "item").limit(25)


@query("""WITH t AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[0-9a-z가-힣_]+'), lambda x: len(x) >= 2 AND x NOT IN ('the', 'of', 'and')) AS ts FROM benchmark)
SELECT item_id, array_to_string(list_filter(ts, lambda x, i: list_position(ts, x) = i), ' ') AS terms FROM t""")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct terms without generic ones; here without the operator's default limit of eight."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(R.search_terms(F.col("text"), ["the", "of", "and"], 1_000_000), " ").alias("terms"))
