"""Audits, entity coverage, picks, metadata rules and set operations over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as A
from ..operators import vectors
from .registry import ORACLE_SQL, query, table


@query(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT * FROM v ORDER BY md5('7:' || vec_id), vec_id LIMIT 50),
s AS (SELECT q.vec_id AS q, v.vec_id AS i, round(list_cosine_similarity(q.e, v.e), 9) AS s FROM q, v), o AS (SELECT q, s AS own FROM s WHERE q = i),
b AS (SELECT s.q, count(*) FILTER (s.s > own OR (s.s = own AND i < s.q)) AS n FROM s JOIN o ON o.q = s.q GROUP BY s.q)
SELECT count(*) AS sampled, round(avg(CASE WHEN n = 0 THEN 1 ELSE 0 END), 6) AS first, round(avg(CASE WHEN n < 3 THEN 1 ELSE 0 END), 6) AS top3 FROM b"""
)
def self_hit_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty vectors, drawn by seeded hash, against all."""
    rows = table(spark, sf_dir, "embeddings")
    return A.self_hit(A.hash_sample(rows, 50, "vec_id", 7), rows)


@query(ORACLE_SQL["self_hit_audit"])
def self_hit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty vectors, the audit's sample size, drawn by a seeded hash from the whole table, against all."""
    rows = table(spark, sf_dir, "embeddings")
    return A.self_hit(A.hash_sample(rows, 50, "vec_id", 7), rows)


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100")
def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of 100 documents."""
    return A.hash_sample(table(spark, sf_dir, "documents"), 100, "doc_id", 7).select("doc_id")


@query(
    """WITH e AS (SELECT DISTINCT 'nation' AS field, regexp_replace(lower(n_name), '[^0-9a-z가-힣à-öø-ÿ]', '', 'g') AS e FROM nation UNION SELECT DISTINCT 'segment',
regexp_replace(lower(c_mktsegment), '[^0-9a-z가-힣à-öø-ÿ]', '', 'g') FROM customer),
n AS (SELECT DISTINCT regexp_replace(lower(n_name), '[^0-9a-z가-힣à-öø-ÿ]', '', 'g') AS n FROM nation WHERE n_regionkey < 3)
SELECT field, count(*) AS entities, count(n) AS covered, round(count(n) / count(*), 6) AS coverage FROM e LEFT JOIN n ON n = e GROUP BY field"""
)
def entity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    entities = nation.select(F.lit("nation").alias("field"), F.col("n_name").alias("v")).unionByName(
        table(spark, sf_dir, "customer").select(F.lit("segment").alias("field"), F.col("c_mktsegment").alias("v"))
    )
    return A.entity_coverage(entities, nation.filter("n_regionkey < 3"), "field", "v", "n_name")


_FIELDS = ["doc_id", "lang", "source", "n_chars"]


@query(" UNION ALL ".join(f"""SELECT '{f}' AS field, count({f}) AS n_values, count(DISTINCT {f}) AS n_distinct, round(count(DISTINCT {f}) / count({f}), 6) AS uniqueness,
regexp_matches('{f}', '(^|_)(id|key|uid)$') OR count(DISTINCT {f}) / count({f}) > 0.95 AS id_like FROM documents""" for f in _FIELDS))
def structure_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.field_profile(table(spark, sf_dir, "documents"), _FIELDS)


@query("""SELECT event_id, CASE WHEN value / 100 < 0.5 THEN 'critical' WHEN value / 100 < 0.7 THEN 'warning' WHEN event_type = 'error' THEN 'check' ELSE 'fine' END AS severity
FROM events""")
def test_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", A.recommendation(F.col("value") / 100, F.col("event_type") != "error").alias("severity"))


@query(
    """WITH m AS (SELECT doc_id, regexp_extract_all(text, '20[0-9]{2}') AS y FROM documents), y AS (SELECT doc_id, unnest(y) AS year, generate_subscripts(y, 1) AS k FROM m),
c AS (SELECT doc_id, year, count(*) AS n, min(k) AS k FROM y GROUP BY doc_id, year) SELECT doc_id, arg_max(year, n * 1000000 - k) AS year, round(least(0.5 + 0.1 *
max(n), 0.9), 2)::DOUBLE AS confidence FROM c GROUP BY doc_id"""
)
def majority_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.majority_year(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query(
    """WITH s AS (SELECT doc_id, source, lang, n_chars, CASE WHEN contains(lower(text), 'licensed') THEN 5 ELSE 0 END + CASE WHEN n_chars > 2000 THEN 2 ELSE 1 END AS score
FROM documents)
SELECT source, lang, doc_id, score AS pick_score FROM s QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY score DESC, n_chars DESC, doc_id) = 1"""
)
def representative_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.lower("text").contains("licensed"), 5).otherwise(0) + F.when(F.col("n_chars") > 2000, 2).otherwise(1)
    return A.representative(table(spark, sf_dir, "documents"), ["source", "lang"], score, "n_chars", "doc_id").select("source", "lang", "doc_id", "pick_score")


@query("SELECT s_suppkey, round(greatest(0, s_acctbal) / (SELECT sum(greatest(0, s_acctbal)) FROM supplier), 9) AS share FROM supplier")
def weight_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.normalised_weights(table(spark, sf_dir, "supplier"), "s_acctbal").select("s_suppkey", F.round("share", 9).alias("share"))


@query(
    """WITH r AS (SELECT doc_id, source, n_chars > 5000 AS master, CASE WHEN n_chars > 3000 THEN lang END AS org FROM documents), m AS (SELECT source, min(org) AS o FROM r
WHERE master GROUP BY source)
SELECT doc_id, coalesce(org, o) AS org FROM r LEFT JOIN m ON m.source = r.source"""
)
def metadata_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("n_chars") > 5000).alias("master"), F.when(F.col("n_chars") > 3000, F.col("lang")).alias("org"))
    return A.inherit(rows, "source", F.col("master"), ["org"]).select("doc_id", "org")


@query(
    """SELECT c_nationkey AS project, min(CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey END) AS rfp, coalesce(string_agg(CASE WHEN c_mktsegment = 'MACHINERY' THEN
CAST(c_custkey AS VARCHAR) END, ',' ORDER BY c_custkey), '') AS proposals,
coalesce(string_agg(CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN CAST(c_custkey AS VARCHAR) END, ',' ORDER BY c_custkey), '') AS deliverables
FROM customer GROUP BY c_nationkey"""
)
def project_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("c_mktsegment") == "BUILDING", "rfp").when(F.col("c_mktsegment") == "MACHINERY", "proposal").otherwise("deliverable")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("project"), role.alias("role"), F.col("c_custkey").alias("id"))
    return A.chain_groups(rows, "project", "role", "id")


@query("""SELECT page_id, CASE WHEN regexp_matches(h, '(부|처|청|시|도|군|구|공사|공단)$') THEN 'public' WHEN regexp_matches(h, '(?i)(대학교|대학|university)$') THEN 'university' WHEN
regexp_matches(h, '(?i)(주식회사|inc\\.?|ltd\\.?|gmbh|corp\\.?|\\.com)$') THEN 'company' ELSE 'other' END AS kind FROM (SELECT page_id,
regexp_extract(url, '//([^/]+)', 1) AS h FROM pages)""")
def organisation_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", A.organisation_type(F.regexp_extract("url", "//([^/]+)", 1)).alias("kind"))


@query("""SELECT page_id, round(CASE WHEN regexp_matches(t, '^[0-9]{4,8}[. _-]') THEN 0.35 ELSE 0 END + CASE WHEN length(t) BETWEEN 10 AND 60 THEN 0.3 ELSE 0.2 END + CASE WHEN
regexp_matches(lower(t), 'project|system|구축|사업|시스템') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(t, '^[A-Za-z가-힣]') THEN 0.15 ELSE 0 END, 4)::DOUBLE AS confidence
FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)""")
def folder_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.round(A.folder_confidence(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), 4).alias("confidence"))


@query("SELECT DISTINCT p_partkey, trim(x) AS part FROM (SELECT p_partkey, unnest(string_split_regex(p_type || '/' || p_brand, '[,;/、]')) AS x FROM part) WHERE trim(x) <> ''")
def entity_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(A.split_values(F.concat_ws("/", "p_type", "p_brand"))).alias("part")).distinct()


@query(
    """WITH l AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
t AS (SELECT doc_id, k, trim(regexp_replace(trim(x), '^([0-9]+[.)]|[-*•])[ ]+', '')) AS y FROM l),
f AS (SELECT doc_id, y, min(k) AS k FROM t WHERE y <> '' AND NOT regexp_matches(y, '^(={3,}|-{3,}|/[A-Za-z]|[A-Z]:\\\\)|@|[0-9]{2,4}[-. ][0-9]{3,4}[-. ][0-9]{4}')
GROUP BY doc_id, y), j AS (SELECT doc_id, string_agg(y, chr(10) ORDER BY k) AS c FROM f GROUP BY doc_id)
SELECT d.doc_id, md5(coalesce(c, '')) AS digest FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id"""
)
def structured_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(A.clean_lines(F.col("text")).cast("binary")).alias("digest"))


@query("""WITH k AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[,.;:/()\\n|]+'), lambda x: trim(x)), lambda x: len(x) BETWEEN 2 AND 40) AS ks
FROM documents), w AS (SELECT doc_id, unnest(ks) AS w, generate_subscripts(ks, 1) AS p FROM k), f AS (SELECT doc_id, w, min(p) AS p FROM w GROUP BY ALL),
g AS (SELECT doc_id, count(*) AS n, string_agg(w, '|' ORDER BY p) AS j FROM f GROUP BY doc_id) SELECT k.doc_id,
coalesce(n, 0) AS n_keywords, md5(coalesce(j, '')) AS digest FROM k LEFT JOIN g ON g.doc_id = k.doc_id""")
def section_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keyword parts, all of them here; the operator's default keeps the first twelve."""
    found = A.keywords(F.col("text"), 1_000_000)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n_keywords"), F.md5(F.array_join(found, "|").cast("binary")).alias("digest"))


@query("SELECT c_custkey, nullif(trim(regexp_extract(c_name, '^([A-Za-z]+)', 1)), '') AS head, CAST(regexp_extract(c_name, '([0-9]+)', 1) AS BIGINT) AS number FROM customer")
def compound_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parts of a compound name by patterns."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.nullif(F.trim(F.regexp_extract("c_name", "^([A-Za-z]+)", 1)), F.lit("")).alias("head"),
        F.regexp_extract("c_name", "([0-9]+)", 1).cast("long").alias("number")
    )


@query(
    """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT v.vec_id, list_cosine_similarity(v.e, q.e) AS score FROM v, (SELECT e
FROM v WHERE vec_id = 0) q)
SELECT vec_id, round(score, 6) AS score FROM s WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY s.score DESC, vec_id LIMIT 20"""
)
def allow_list_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits restricted to ids of another source by a semi join, before the cut."""
    rows = table(spark, sf_dir, "embeddings")
    own = rows.filter("vec_id = 0").select(F.col("embedding").alias("query_vector"))
    allowed = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("vec_id"))
    hits = vectors.scored(rows.join(allowed, "vec_id", "left_semi"), own)
    return vectors.top_k(hits, 20, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS p FROM documents), f AS (SELECT doc_id, w, min(p) AS p
FROM w GROUP BY ALL) SELECT doc_id, count(*) AS n_first, md5(string_agg(w, ' ' ORDER BY p)) AS digest FROM f GROUP BY doc_id""")
def ordered_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with repeats dropped, in the order of their first places."""
    words = F.array_distinct(F.split("text", " "))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n_first"), F.md5(F.array_join(words, " ").cast("binary")).alias("digest"))


@query("""SELECT doc_id, source || '|' || lang AS tags FROM documents WHERE lang <> 'en' UNION ALL SELECT doc_id, 'manual|' || source || '|' || lang FROM documents
WHERE lang = 'en'""")
def tag_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual tags stay, generated ones follow."""
    manual = F.when(F.col("lang") == "en", F.array(F.lit("manual"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_distinct(F.concat(manual, F.array("source", "lang"))), "|").alias("tags"))


@query("SELECT 'old' AS origin, vec_id FROM embeddings WHERE label <> 2 UNION ALL SELECT 'new', vec_id FROM embeddings WHERE label = 2")
def index_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of one type replaced, the others kept."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.filter("label <> 2").select(F.lit("old").alias("origin"), "vec_id").unionByName(rows.filter("label = 2").select(F.lit("new").alias("origin"), "vec_id"))


@query("""SELECT page_id, CASE WHEN regexp_matches(t, '(\\.{4,}[^\\n]*\\n?){2}') THEN 'toc' WHEN regexp_matches(lower(t), 'appendix|annex|부록|별첨') THEN 'appendix'
WHEN page_id % 5 = 0 AND length(t) < 300 THEN 'cover' ELSE 'content' END AS kind, contains(html, '<table') AS has_table, contains(html, '<img') AS has_image
FROM (SELECT page_id, html, regexp_replace(html, '<[^>]*>', ' ', 'g') AS t FROM pages)""")
def page_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page kind and flags; every fifth page counts as a first page here."""
    from ..operators.chunking import page_kind

    rows = table(spark, sf_dir, "pages").withColumn("t", F.regexp_replace("html", "<[^>]*>", " "))
    number = F.when(F.col("page_id") % 5 == 0, 1).otherwise(2)
    return rows.select("page_id", page_kind(number, F.col("t")).alias("kind"), F.contains("html", F.lit("<table")).alias("has_table"), F.contains("html", F.lit("<img")).alias("has_image"))


@query()
def pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three principal components of all vectors (signs are arbitrary, so rows only)."""
    from ..operators.projection import pca

    return pca(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 3)


@query("SELECT conv_id, turn, 'Context: ' || role || chr(10) || text AS embed_text FROM conversations WHERE length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 10")
def contextual_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that pass a letter gate, led by their context."""
    rows = table(spark, sf_dir, "conversations").filter(F.length(F.regexp_replace("text", "[^A-Za-z]", "")) >= 10)
    return rows.select("conv_id", "turn", F.concat(F.lit("Context: "), "role", F.lit("\n"), "text").alias("embed_text"))


@query("SELECT count(*) AS turns, count(*) FILTER (contains(text, ':')) AS with_label, round(count(*) FILTER (contains(text, ':')) / count(*), 6) AS rate FROM conversations")
def search_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of texts that carry a label."""
    has = F.contains("text", F.lit(":"))
    return table(spark, sf_dir, "conversations").agg(F.count("*").alias("turns"), F.count_if(has).alias("with_label"), F.round(F.count_if(has) / F.count("*"), 6).alias("rate"))


@query("""SELECT doc_id, CASE WHEN length(text) = 0 THEN 'no_text' WHEN length(text) < 500 THEN 'short' WHEN l.quality = 0 THEN 'low_score' ELSE 'ok' END AS reason FROM documents d
LEFT JOIN labels l USING (doc_id)""")
def extraction_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rejects of an extraction report."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.select("doc_id", F.when(F.col("n") == 0, "no_text").when(F.col("n") < 500, "short").when(F.col("quality") == 0, "low_score").otherwise("ok").alias("reason"))


@query("SELECT DISTINCT doc_id FROM documents WHERE source IN ('src4', 'src7') OR lang IN ('src4', 'src7') OR CAST(doc_id AS VARCHAR) IN ('src4', 'src7', '12')")
def selected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of which any identifying field is selected."""
    wanted = F.array(*[F.lit(x) for x in ("src4", "src7", "12")])
    fields = F.array("source", "lang", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").filter(F.arrays_overlap(fields, wanted)).select("doc_id").distinct()


@query("SELECT doc_id, length(lower(text)) AS n FROM documents WHERE NOT (lower(trim(lang)) IN ('', 'unknown', 'none', 'null', 'n/a', '없음', '-'))")
def filled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(T.filled(F.col("lang"))).select("doc_id", F.length(F.lower("text")).cast("long").alias("n"))
