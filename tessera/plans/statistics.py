"""Predicates, aggregates and audits over ``documents``, ``labels``, ``events`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metadata as M
from .registry import query, table

META = """WITH meta AS (SELECT d.*, CASE WHEN l.quality = 1 THEN 'reviewed' WHEN l.quality = 0 THEN 'pending' ELSE 'registered' END AS status,
coalesce(l.toxic, 0) = 1 AS is_excluded, coalesce(l.quality, 0) = 1 AS include_in_rag, CASE WHEN d.doc_id % 11 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS removed_at
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
STATES = ["registered", "pending", "reviewed", "approved"]


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their review state; every eleventh has been removed."""
    removed = F.when(F.col("doc_id") % 11 == 0, F.lit("2024-01-01 00:00:00"))
    return M.document_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), removed)


@query(f"{META} SELECT doc_id FROM meta WHERE status = 'reviewed' AND include_in_rag AND NOT is_excluded AND removed_at IS NULL")
def review_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).filter(M.rag_ready()).select("doc_id")


@query(f"{META} SELECT doc_id, status FROM meta WHERE NOT is_excluded AND removed_at IS NULL")
def active_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).filter(M.active()).select("doc_id", "status")


@query(f"{META} SELECT doc_id FROM meta WHERE source IN ('src1', 'src2') AND status IN ('reviewed', 'pending')")
def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.select_documents(rows(spark, sf_dir), sources=["src1", "src2"], statuses=["reviewed", "pending"]).select("doc_id")


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND source LIKE 'src1%' AND contains(lower(text), 'the') ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 5")
def doc_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").filter(F.col("lang").eqNullSafe("en") & F.col("source").like("src1%") & F.contains(F.lower("text"), F.lit("the")))
    return found.orderBy(F.desc("n_chars"), "doc_id").offset(5).limit(20).select("doc_id", "source", "n_chars")


@query("SELECT page_id FROM pages WHERE contains(lower(split_part(url, '/', -1)), '1') AND contains(url, 'example.org') ORDER BY page_id LIMIT 100")
def file_name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive part of the last path segment, at most 100."""
    name = F.lower(F.element_at(F.split("url", "/"), -1))
    return table(spark, sf_dir, "pages").filter(name.contains("1") & F.col("url").contains("example.org")).orderBy("page_id").limit(100).select("page_id")


@query(
    """WITH f AS (SELECT doc_id, source = 'src3' AND lang = 'xx' AS a, source = 'src3' AND n_chars < 0 AS b, source = 'src3' AS c FROM documents),
x AS (SELECT bool_or(a) AS a, bool_or(b) AS b, bool_or(c) AS c FROM f), s AS (SELECT CASE WHEN a THEN 0 WHEN b THEN 1 WHEN c THEN 2 ELSE 3 END AS strategy FROM x)
SELECT doc_id, CAST(strategy AS BIGINT) AS strategy FROM f, s WHERE CASE strategy WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN c ELSE true END"""
)
def filter_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strictest level with any row wins; here the third."""
    own = F.col("source") == "src3"
    found = M.relaxed(table(spark, sf_dir, "documents"), [own & (F.col("lang") == "xx"), own & (F.col("n_chars") < 0), own], "doc_id")
    return found.select("doc_id", F.col("strategy").cast("long").alias("strategy"))


@query(f"""{META} SELECT s.status, count(m.doc_id) AS n FROM (VALUES ('registered'), ('pending'), ('reviewed'), ('approved')) s(status) LEFT JOIN meta m ON m.status = s.status
GROUP BY s.status""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.status_counts(rows(spark, sf_dir), "status", STATES)


@query(f"""{META} SELECT source, count(*) AS total, count(*) FILTER (status = 'reviewed' AND include_in_rag AND NOT is_excluded AND removed_at IS NULL) AS ready,
round(count(*) FILTER (status = 'reviewed' AND include_in_rag AND NOT is_excluded AND removed_at IS NULL) / count(*), 3) AS ratio FROM meta GROUP BY source""")
def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.source_statistics(rows(spark, sf_dir))


@query(f"""{META} SELECT CASE WHEN grouping(lang) = 0 THEN 'category' WHEN grouping(status) = 0 THEN 'status' ELSE 'all' END AS kind, coalesce(lang, status, 'all') AS value,
count(*) AS n FROM meta GROUP BY GROUPING SETS ((lang), (status), ())""")
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.document_statistics(rows(spark, sf_dir))


@query(f"""{META} SELECT source, count(*) AS total, count(*) FILTER (status = 'pending') AS review_required, count(*) FILTER (status = 'reviewed') AS reviewed, round(100 *
count(*) FILTER (status = 'reviewed') / count(*), 1) AS progress FROM meta GROUP BY source""")
def review_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.review_progress(rows(spark, sf_dir))


_LOG = "(SELECT *, event_type <> 'error' AS ok, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last seven days of the query log, counted back from its newest entry."""
    events = table(spark, sf_dir, "events")
    newest = events.agg(F.max("ts").alias("newest"))
    recent = events.crossJoin(F.broadcast(newest)).filter(F.col("ts") >= F.col("newest") - F.expr("INTERVAL 7 DAYS"))
    return recent.select("event_id", "ts", "user_id", "event_type", "value", (F.col("event_type") != "error").alias("ok"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"""SELECT count(*) AS total, count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok) AS failure, count(*) FILTER (k = 0) AS zero_result, round(count(*) FILTER (ok) /
count(*), 4) AS rate, round(avg(value), 4) AS avg_duration FROM {_LOG}""")
def querylog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).agg(
        F.count("*").alias("total"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failure"), F.count_if(F.col("k") == 0).alias("zero_result"), F.round(F.count_if("ok") / F.count("*"), 4).alias("rate"), F.round(F.avg("value"), 4).alias("avg_duration")
    )


@query(f"SELECT event_type, count(*) AS n, round(avg(value), 4) AS avg_duration FROM {_LOG} GROUP BY event_type")
def querylog_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("avg_duration"))


@query(f"SELECT user_id, count(*) AS n, CAST(max(ts) AS VARCHAR) AS newest FROM {_LOG} GROUP BY user_id ORDER BY n DESC, max(ts) DESC, user_id LIMIT 10")
def querylog_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = log(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("t")).orderBy(F.desc("n"), F.desc("t"), "user_id").limit(10)
    return top.select("user_id", "n", F.col("t").cast("string").alias("newest"))


@query("SELECT event_id, event_type, value FROM events WHERE event_type = 'click' AND contains(props, '7') ORDER BY ts DESC, event_id LIMIT 50")
def querylog_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "events").filter((F.col("event_type") == "click") & F.col("props").contains("7"))
    return found.orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "event_type", "value")


@query("""SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS avg_len, max(n_chars) AS max_len, min(n_chars) AS min_len, round(100 * count(*) /
sum(count(*)) OVER (), 4) AS percent FROM documents GROUP BY lang""")
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.dataset_statistics(table(spark, sf_dir, "documents"), "lang", "n_chars")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
def field_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5)


@query("SELECT lang, CAST(sum(n_chars) AS BIGINT) AS total, round(avg(n_chars), 4) AS mean FROM documents GROUP BY lang")
def field_sum_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and means go by category, whatever the field."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum("n_chars").alias("total"), F.round(F.avg("n_chars"), 4).alias("mean"))


_F = "CAST(({0}) IS NOT NULL AND lower(trim(({0}))) NOT IN ('', 'unknown', 'none', 'null', 'n/a', '없음', '-') AS INTEGER)"


@query(
    f"""WITH r AS (SELECT source, {_F.format('lang')} AS lang, {_F.format("CASE WHEN doc_id % 3 = 0 THEN ' None ' ELSE text END")} AS body, {_F.format("CASE WHEN doc_id % 2 = 0 THEN lang END")} AS half FROM documents),
d AS (SELECT source, max(lang) AS lang, max(body) AS body, max(half) AS half FROM r GROUP BY source)
SELECT 'lang' AS field, round((SELECT avg(lang) FROM r), 6) AS row_rate, round((SELECT avg(lang) FROM d), 6) AS doc_rate UNION ALL
SELECT 'body', round((SELECT avg(body) FROM r), 6), round((SELECT avg(body) FROM d), 6) UNION ALL SELECT 'half', round((SELECT avg(half) FROM r), 6),
round((SELECT avg(half) FROM d), 6)"""
)
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"lang": F.col("lang"), "body": F.when(F.col("doc_id") % 3 == 0, " None ").otherwise(F.col("text")), "half": F.when(F.col("doc_id") % 2 == 0, F.col("lang"))}
    return M.coverage(table(spark, sf_dir, "documents"), fields, "source")


@query(
    """WITH a AS (SELECT least(1.0, count(*) / greatest(count(DISTINCT source), 1) / 10) AS completeness, (CASE WHEN count(*) FILTER (trim(text) <> '') > 0 THEN 1 ELSE 0 END +
CASE WHEN count(*) FILTER (trim(lang) <> '') > 0 THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (trim(source) <> '') > 0 THEN 1 ELSE 0 END) / 3 AS consistency,
count(DISTINCT doc_id) / count(*) AS u1, count(DISTINCT lang) / count(*) AS u2 FROM documents),
b AS (SELECT round(completeness, 6) AS completeness, CAST(consistency AS DOUBLE) AS consistency, round(least(0.3, 0.25) + least(0.4, 0.1 * (CASE
WHEN u1 > 0.5 THEN 1 ELSE 0 END + CASE WHEN u2 > 0.5 THEN 1 ELSE 0 END)) + 0.3, 2) AS linkability FROM a)
SELECT CAST(completeness AS DOUBLE) AS completeness, consistency, CAST(linkability AS DOUBLE) AS linkability, round((completeness + consistency +
CAST(linkability AS DOUBLE)) / 3, 6) AS overall FROM b"""
)
def dataset_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.diagnosis(table(spark, sf_dir, "documents"), "source", ["text", "lang", "source"], ["doc_id", "lang"])


_CMP = """SELECT '{0}' AS metric, round(a, 4) AS a, round(b, 4) AS b, round(b - a, 4) AS diff, round(100 * (b - a) / nullif(a, 0), 4) AS percent FROM (SELECT CAST((SELECT {1}
FROM documents WHERE source = 'src1') AS DOUBLE) AS a, CAST((SELECT {1} FROM documents WHERE source = 'src2') AS DOUBLE) AS b)"""


@query(" UNION ALL ".join(_CMP.format(n, e) for n, e in (("documents", "count(*)"), ("characters", "sum(n_chars)"), ("mean_length", "avg(n_chars)"), ("languages", "count(DISTINCT lang)"))))
def dataset_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    metrics = {"documents": F.count("*"), "characters": F.sum("n_chars"), "mean_length": F.avg("n_chars"), "languages": F.count_distinct("lang")}
    return M.compare(docs.filter("source = 'src1'"), docs.filter("source = 'src2'"), metrics)


@query("""SELECT CAST(doc_id % 4 AS BIGINT) AS snapshot, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS characters, count(e.vec_id) AS vectors FROM documents d LEFT
JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY 1""")
def snapshot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "embeddings").select("vec_id"), F.col("doc_id") == F.col("vec_id"), "left")
    return joined.groupBy((F.col("doc_id") % 4).alias("snapshot")).agg(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"), F.count("vec_id").alias("vectors"))


@query("""SELECT doc_id, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'unexpected' FROM embeddings
WHERE vec_id NOT IN (SELECT doc_id FROM documents)""")
def integrity_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.missing_and_unexpected(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query(
    f"""{META} SELECT source, CASE WHEN count(*) FILTER (status <> 'registered') = count(*) THEN 'ready' WHEN
count(*) FILTER (status <> 'registered') > 0 THEN 'partial' ELSE 'missing' END AS label_stage,
CASE WHEN count(*) FILTER (n_chars > 0) = count(*) THEN 'ready' WHEN count(*) FILTER (n_chars > 0) > 0 THEN 'partial' ELSE 'missing' END AS text_stage FROM meta
GROUP BY source"""
)
def stage_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = lambda c: M.stage_status(F.count_if(c), F.count("*"))
    return rows(spark, sf_dir).groupBy("source").agg(status(F.col("status") != "registered").alias("label_stage"), status(F.col("n_chars") > 0).alias("text_stage"))


@query(
    """SELECT 'text' AS question, round(100 * avg(CASE WHEN length(text) > 0 THEN 1 ELSE 0 END), 2) AS rate, CASE WHEN 100 * avg(CASE
WHEN length(text) > 0 THEN 1 ELSE 0 END) >= 95 THEN 'pass' WHEN 100 * avg(CASE WHEN length(text) > 0 THEN 1 ELSE 0 END) >= 80 THEN 'warn' ELSE 'fail' END AS verdict
FROM documents UNION ALL
SELECT 'labels', round(100 * r, 2), CASE WHEN 100 * r >= 95 THEN 'pass' WHEN 100 * r >= 80 THEN 'warn' ELSE 'fail' END FROM (SELECT count(l.doc_id) / count(*) AS r
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) UNION ALL
SELECT 'vectors', round(100 * r, 2), CASE WHEN 100 * r >= 95 THEN 'pass' WHEN 100 * r >= 80 THEN 'warn' ELSE 'fail' END FROM (SELECT count(e.vec_id) / count(*) AS r
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""
)
def integrity_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = lambda name, frame, rate: frame.agg((100 * rate).alias("r")).select(
        F.lit(name).alias("question"), F.round("r", 2).alias("rate"),
        F.when(F.col("r") >= 95, "pass").when(F.col("r") >= 80, "warn").otherwise("fail").alias("verdict")
    )
    with_labels = docs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("other")), F.col("doc_id") == F.col("other"), "left")
    with_vectors = docs.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("other")), F.col("doc_id") == F.col("other"), "left")
    share = F.count("other") / F.count("*")
    return part("text", docs, F.count_if(F.length("text") > 0) / F.count("*")).unionByName(part("labels", with_labels, share)).unionByName(part("vectors", with_vectors, share))


@query("""SELECT count(*) FILTER (toxic = 1) AS removed, count(*) FILTER (toxic = 1 AND n_chars > 2000) AS removed_large, count(*) FILTER (quality = 0) AS excluded,
count(*) FILTER (d IS NULL) AS orphan FROM (SELECT l.*, d.doc_id AS d, d.n_chars FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id)""")
def cleanup_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), "n_chars")
    joined = table(spark, sf_dir, "labels").join(docs, F.col("doc_id") == F.col("d"), "left")
    return joined.agg(
        F.count_if(F.col("toxic") == 1).alias("removed"), F.count_if((F.col("toxic") == 1) & (F.col("n_chars") > 2000)).alias("removed_large"),
        F.count_if(F.col("quality") == 0).alias("excluded"), F.count_if(F.col("d").isNull()).alias("orphan")
    )


@query(
    """WITH p AS (SELECT page_id, CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS ref, regexp_extract(url, '//[^/]+/([a-z]+)/', 1) AS lang FROM pages),
a AS (SELECT ref, min(page_id) AS page_id FROM p GROUP BY ref), b AS (SELECT lang, min(page_id) AS page_id FROM p GROUP BY lang)
SELECT d.doc_id, coalesce(a.page_id, b.page_id) AS page_id, CAST(CASE WHEN a.ref IS NOT NULL THEN 0 WHEN b.lang IS NOT NULL THEN 1 END AS INTEGER) AS match_level
FROM documents d LEFT JOIN a ON a.ref = d.doc_id LEFT JOIN b ON b.lang = d.lang"""
)
def best_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages: by id in the address, else by language."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.nullif(F.regexp_extract("url", "/([0-9]+)", 1), F.lit("")).cast("long").alias("ref"),
        F.regexp_extract("url", "//[^/]+/([a-z]+)/", 1).alias("path_lang")
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return M.best_match(docs, pages, [("doc_id", "ref"), ("lang", "path_lang")], ["page_id"]).select("doc_id", "page_id", "match_level")


@query("""WITH d AS (SELECT DISTINCT lang, doc_id AS n FROM documents), i AS (SELECT lang, n, n - row_number() OVER (PARTITION BY lang ORDER BY n) AS g FROM d) SELECT lang,
min(n) AS first, max(n) AS last FROM i GROUP BY lang, g""")
def number_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.number_ranges(table(spark, sf_dir, "documents"), "lang", "doc_id")


@query(
    """WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(['licensed', 'the', 'von', 'que', 'les'], lambda w: contains(lower(text), w)))) AS tag FROM documents)
SELECT tag, count(*) AS frequency, CASE WHEN count(*) >= 10 THEN 1.0 WHEN count(*) >= 5 THEN 0.8 WHEN count(*) >= 2 THEN 0.6 ELSE 0.4 END::DOUBLE AS weight FROM t GROUP BY tag"""
)
def tag_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ("licensed", "the", "von", "que", "les")])
    found = table(spark, sf_dir, "documents").select(F.explode(F.filter(words, lambda w: F.contains(F.lower("text"), w))).alias("tag"))
    return found.groupBy("tag").agg(F.count("*").alias("frequency")).withColumn("weight", T.tag_weight(F.col("frequency")))


@query(
    """WITH k AS (SELECT doc_id, lower(source) AS kw, 2.0 AS w FROM documents UNION ALL SELECT doc_id, lower(lang), 1.5 FROM documents UNION ALL SELECT doc_id, CASE
WHEN n_chars > 2000 THEN 'long' ELSE 'src1' END, 0.8 FROM documents)
SELECT kw, CAST(max(w) AS DOUBLE) AS weight, count(DISTINCT doc_id) AS documents FROM k GROUP BY kw"""
)
def keyword_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest weight per lower-cased keyword from three kinds of metadata."""
    kinds = F.array(
        F.struct(F.lower("source").alias("kw"), F.lit(2.0).alias("w")), F.struct(F.lower("lang").alias("kw"), F.lit(1.5).alias("w")),
        F.struct(F.when(F.col("n_chars") > 2000, "long").otherwise("src1").alias("kw"), F.lit(0.8).alias("w"))
    )
    rows_ = table(spark, sf_dir, "documents").select("doc_id", F.explode(kinds).alias("k"))
    return rows_.groupBy(F.col("k.kw").alias("kw")).agg(F.max("k.w").alias("weight"), F.count_distinct("doc_id").alias("documents"))


@query(
    """SELECT source, arg_min(lang, doc_id) AS organisation, count(DISTINCT doc_id) AS documents, string_agg(DISTINCT lang, ',' ORDER BY lang) AS categories FROM documents
GROUP BY source"""
)
def project_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per folder: first organisation, distinct documents, categories."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.min_by("lang", "doc_id").alias("organisation"), F.count_distinct("doc_id").alias("documents"),
        F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("categories")
    )


@query("""SELECT regexp_extract(url, '//([^/]+)', 1) AS folder, count(*) AS file_count, round(sum(length(html)) / 1048576, 6) AS total_mb, max(page_id) AS newest FROM pages
GROUP BY 1""")
def source_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per top-level folder: files, megabytes, newest."""
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "//([^/]+)", 1).alias("folder")).agg(
        F.count("*").alias("file_count"), F.round(F.sum(F.length("html")) / 1048576, 6).alias("total_mb"), F.max("page_id").alias("newest")
    )


@query("SELECT turn, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS characters FROM conversations GROUP BY turn")
def chunks_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("turn").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).cast("long").alias("characters"))
