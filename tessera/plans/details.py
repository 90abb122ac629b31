"""Further branches of listings, gates, joins and audits over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import details as D
from ..operators import metadata as M
from ..operators import upkeep as U
from . import graph, search
from .registry import query, table


@query("""SELECT page_id FROM pages WHERE contains(lower(split_part(url, '/', -1)), '2') AND regexp_extract(lower(split_part(url, '/', -1)), '\\.([a-z]+)', 1) IN ('html', 'htm')
ORDER BY page_id LIMIT 100""")
def file_name_search_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part of the name and one of several extensions, at most 100."""
    name = F.lower(F.element_at(F.split("url", "/"), -1))
    found = table(spark, sf_dir, "pages").filter(name.contains("2") & F.regexp_extract(name, "\\.([a-z]+)", 1).isin("html", "htm"))
    return found.orderBy("page_id").limit(100).select("page_id")


@query("""SELECT CASE WHEN o.doc_id IS NULL THEN 'created' ELSE 'updated' END AS action, count(*) AS n FROM documents d LEFT JOIN (SELECT doc_id FROM documents
WHERE lang = 'en') o ON o.doc_id = d.doc_id GROUP BY 1""")
def row_sync_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return U.sync_actions(docs.filter("lang = 'en'"), docs, "doc_id", overwrite=True)


@query("SELECT doc_id, source FROM documents WHERE contains(lower(source), 'src7') OR contains(lower(text), 'thanedble') ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 2")
def doc_list_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over either of two fields, a page of it."""
    found = table(spark, sf_dir, "documents").filter(F.contains(F.lower("source"), F.lit("src7")) | F.contains(F.lower("text"), F.lit("thanedble")))
    return found.orderBy(F.desc("n_chars"), "doc_id").offset(2).limit(20).select("doc_id", "source")


@query(
    """WITH r AS (SELECT d.doc_id, l.doc_id IS NOT NULL AS has_report, l.quality, l.toxic, length(d.text) AS n, d.lang, len(string_split(d.text, ' ')) AS words FROM documents d
LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT doc_id, CASE WHEN NOT has_report THEN 'no_report' WHEN toxic = 1 THEN 'not_done' WHEN n < 500 AND NOT (lang = 'en' AND words >= 40) THEN 'short'
WHEN doc_id % 11 = 0 THEN 'not_ready' WHEN quality = 0 AND NOT (lang = 'en' AND words >= 40) THEN 'low_score'
WHEN lang = 'es' THEN 'parser_failed' ELSE 'ok' END AS reason FROM r"""
)
def extraction_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six ordered rejects of an extraction report; one kind of document with enough words is let through two of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("has_report"))
    rows = docs.join(labels, "doc_id", "left")
    rejects = [
        (F.col("has_report").isNull(), "no_report"),
        (F.col("toxic") == 1, "not_done"),
        (F.length("text") < 500, "short"),
        (F.col("doc_id") % 11 == 0, "not_ready"),
        (F.col("quality") == 0, "low_score"),
        (F.col("lang") == "es", "parser_failed"),
    ]
    bypass = (F.col("lang") == "en") & (F.size(F.split("text", " ")) >= 40)
    return rows.select("doc_id", D.gate_reason(rejects, bypass, ["short", "low_score"]).alias("reason"))


@query(
    """WITH s AS (SELECT s_suppkey, s_name, s_nationkey FROM supplier), a AS (SELECT s_suppkey AS k, min(s_suppkey) AS v FROM s WHERE s_suppkey % 3 = 0 GROUP BY 1),
b AS (SELECT s_nationkey AS k, min(s_suppkey) AS v FROM s WHERE s_suppkey % 3 = 1 GROUP BY 1),
c AS (SELECT s_suppkey % 10 AS k, min(s_suppkey) AS v FROM s WHERE s_suppkey % 3 = 2 GROUP BY 1), e AS (SELECT min(s_suppkey) AS v FROM s)
SELECT c_custkey, coalesce(a.v, b.v, c.v, e.v) AS s_suppkey, CAST(CASE WHEN a.v IS NOT NULL THEN 0 WHEN b.v IS NOT NULL THEN 1
WHEN c.v IS NOT NULL THEN 2 ELSE 3 END AS INTEGER) AS match_level
FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN b ON b.k = c_nationkey LEFT JOIN c ON c.k = c_custkey % 10, e"""
)
def best_match_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers by id, else by nation, else by last digit, else the first one."""
    own = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    part = lambda rest, key: F.when(F.col("s_suppkey") % 3 == rest, key)
    right = own.select(
        "s_suppkey", part(0, F.col("s_suppkey")).alias("by_id"), part(1, F.col("s_nationkey").cast("long")).alias("by_nation"),
        part(2, F.col("s_suppkey") % 10).alias("by_digit"), F.lit(1).alias("any")
    )
    left = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("nation"), (F.col("c_custkey") % 10).alias("digit"), F.lit(1).alias("one"))
    return M.best_match(left, right, [("c_custkey", "by_id"), ("nation", "by_nation"), ("digit", "by_digit"), ("one", "any")], ["s_suppkey"]).select("c_custkey", "s_suppkey", "match_level")


@query(
    f"""{search._HITS}, o AS (SELECT source, lang, min(struct_pack(a := -score, b := vec_id)) AS f FROM h WHERE n <= 5 GROUP BY source, lang),
g AS (SELECT source, string_agg(lang, ',' ORDER BY f) AS sections FROM o GROUP BY source),
w AS (SELECT source, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY n) AS snippets, bool_or(score > 0.4) AS strong FROM h WHERE n <= 5 GROUP BY source)
SELECT w.source, coalesce(g.sections, '') AS sections, w.snippets, w.strong FROM w LEFT JOIN g ON g.source IS NOT DISTINCT FROM w.source"""
)
def hit_doc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per group of hits its sections and snippets in the order of the hits, and whether any hit is strong."""
    best_first = (-F.col("score"), F.col("vec_id"))
    found = search.hits(spark, sf_dir).groupBy("source").agg(
        D.ordered_values(F.col("lang"), *best_first).alias("s"), D.ordered_values(F.col("vec_id"), *best_first).alias("v"),
        F.bool_or(F.col("score") > 0.4).alias("strong")
    )
    return found.select("source", F.array_join("s", ",").alias("sections"), F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("snippets"), "strong")


@query(
    """WITH d AS (SELECT lang, source, n_chars > 1000 AS r FROM documents), p AS (SELECT 'all' AS field, '' AS value, r FROM d UNION ALL SELECT 'lang', lang, r FROM d UNION ALL
SELECT 'source', source, r FROM d)
SELECT field, value, count(*) AS total, count(*) FILTER (r) AS ready, round(count(*) FILTER (r) / count(*), 3) AS ratio FROM p GROUP BY field, value"""
)
def source_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and ready rows in all, by category and by source."""
    return D.split_counts(table(spark, sf_dir, "documents"), ["lang", "source"], F.col("n_chars") > 1000)


@query("""WITH p AS (SELECT 'o_orderpriority' AS field, o_orderpriority AS value FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders),
n AS (SELECT field, trim(value) AS value, count(*) AS n FROM p WHERE trim(value) <> '' GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY field
ORDER BY n DESC, value) AS INTEGER) AS rank FROM n QUALIFY rank <= 10""")
def filter_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.distributions(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"])


@query("SELECT count(*) AS filled, count(*) FILTER (regexp_matches(o_orderpriority, '^[0-9]+[-.] ?')) AS prefixed FROM orders WHERE trim(o_orderpriority) <> ''")
def prefix_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled values that still carry a number in front."""
    rows = table(spark, sf_dir, "orders").filter(F.trim("o_orderpriority") != "")
    return rows.agg(F.count("*").alias("filled"), F.count_if(F.col("o_orderpriority").rlike("^[0-9]+[-.] ?")).alias("prefixed"))


_RATES = [
    ("text", "length(text) > 0", 95, 80), ("chunks", "length(text) >= 100", 95, 80), ("metadata", "trim(lang) <> '' AND trim(source) <> ''", 95, 80),
    ("keywords", "regexp_matches(text, '[A-Za-z]{4}')", 90, 70), ("graph", "l IS NOT NULL", 95, 80), ("pages", "contains(text, '.')", 95, 80),
    ("index", "e IS NOT NULL", 95, 80)
]
_RATED = "100.0 * count(*) FILTER ({0}) / count(*)"


@query(
    """WITH d AS (SELECT d.*, l.doc_id AS l, e.vec_id AS e FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id LEFT
JOIN (SELECT DISTINCT vec_id FROM embeddings) e ON e.vec_id = d.doc_id) """
    + " UNION ALL ".join(f"""SELECT '{n}' AS question, round({_RATED.format(c)}, 2) AS rate, CASE WHEN {_RATED.format(c)} >= {a} THEN 'pass'
WHEN {_RATED.format(c)} >= {b} THEN 'warn' ELSE 'fail' END AS verdict FROM d""" for n, c, a, b in _RATES)
)
def integrity_seven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven shares of one joined pass: text, chunks, metadata, keywords, graph, pages and index."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("l")).distinct()
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("e")).distinct()
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").join(vectors, "doc_id", "left")
    holds = {
        "text": F.length("text") > 0,
        "chunks": F.length("text") >= 100,
        "metadata": (F.trim("lang") != "") & (F.trim("source") != ""),
        "keywords": F.col("text").rlike("[A-Za-z]{4}"),
        "graph": F.col("l").isNotNull(),
        "pages": F.contains("text", F.lit(".")),
        "index": F.col("e").isNotNull(),
    }
    return D.rated({n: (F.count_if(holds[n]) / F.count("*"), a, b) for n, _, a, b in _RATES}, rows)


@query(
    """WITH p AS (SELECT CASE WHEN turn > 3 THEN NULL ELSE turn END AS page, conv_id, turn, text FROM conversations), g AS (SELECT page, count(*) AS chunks,
CAST(sum(length(text)) AS BIGINT) AS characters, string_agg(conv_id || ':' || turn, ',' ORDER BY conv_id, turn) AS members FROM p GROUP BY page)
SELECT page, chunks, characters, md5(members) AS digest, row_number() OVER (ORDER BY page NULLS LAST) AS place FROM g"""
)
def page_chunk_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by page with their list; those without a page come last."""
    page = F.when(F.col("turn") > 3, F.lit(None)).otherwise(F.col("turn"))
    name = F.concat_ws(":", "conv_id", "turn")
    grouped = table(spark, sf_dir, "conversations").groupBy(page.alias("page")).agg(
        F.count("*").alias("chunks"), F.sum(F.length("text")).cast("long").alias("characters"),
        D.ordered_values(name, F.col("conv_id"), F.col("turn")).alias("m")
    )
    place = F.row_number().over(M.Window.orderBy(F.col("page").asc_nulls_last())).cast("long")
    return grouped.select("page", "chunks", "characters", F.md5(F.array_join("m", ",").cast("binary")).alias("digest"), place.alias("place"))


@query("""SELECT page_id, CASE WHEN contains(lower(url), '/en/') THEN 'english' WHEN contains(lower(url), 'blog') THEN 'blog'
WHEN contains(lower(url), 'example.org') THEN 'organisation' ELSE 'other' END AS group_name FROM pages""")
def group_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group by the first keyword in the path, else in the host, else a default."""
    lower = F.lower("url")
    name = F.coalesce(*[F.when(F.contains(lower, F.lit(k)), v) for k, v in (("/en/", "english"), ("blog", "blog"), ("example.org", "organisation"))], F.lit("other"))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("group_name"))


@query(f"""{graph.GRAPH}, e AS (SELECT DISTINCT src, dst, type FROM edges WHERE src || '->' || dst || ':' || type NOT IN ('nation:1->region:1:IN_REGION', 'x->y:z')) SELECT *
FROM e UNION SELECT 'nation:1', 'region:3', 'MOVED_TO'""")
def graph_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge added, one taken out by its id; unknown ids change nothing."""
    added = spark.createDataFrame([("nation:1", "region:3", "MOVED_TO")], "src string, dst string, type string")
    return D.edit_edges(graph.edges(spark, sf_dir), added, ["nation:1->region:1:IN_REGION", "x->y:z"])


_CLEAN = "CASE WHEN n_chars > 20000 THEN 'removed' WHEN lang = 'de' THEN 'excluded' WHEN lang = 'fr' AND doc_id % 2 = 0 THEN 'restored' ELSE 'kept' END"


@query(f"""SELECT doc_id, {_CLEAN} AS action, CASE WHEN {_CLEAN} = 'excluded' THEN true WHEN {_CLEAN} = 'restored' THEN false ELSE doc_id % 2 = 0 END AS excluded FROM documents
WHERE {_CLEAN} <> 'removed'""")
def cleanup_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", (F.col("doc_id") % 2 == 0).alias("excluded"))
    return D.cleaned(rows, F.col("n_chars") > 20000, F.col("lang") == "de", F.col("lang") == "fr").select("doc_id", "action", "excluded")


@query(f"SELECT {_CLEAN} AS action, count(*) AS n FROM documents GROUP BY 1")
def cleanup_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a clean-up would do, without doing it."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", (F.col("doc_id") % 2 == 0).alias("excluded"))
    marked = D.cleaned(rows, F.col("n_chars") > 20000, F.col("lang") == "de", F.col("lang") == "fr", dry_run=True)
    return marked.groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT doc_id, 'rejected' AS status, 'low quality' AS reject_reason FROM labels WHERE quality = 0")
def review_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.reject(table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id"), "low quality")


@query(
    """SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'a|b' || (vec_id % 7) ELSE CASE vec_id % 3 WHEN 1 THEN 'x y,' || (vec_id % 5) ELSE 'plain' END END AS items FROM embeddings"""
)
def json_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists from bar-separated, JSON and plain strings, joined again by a separator of their kind."""
    kind = F.col("vec_id") % 3
    raw = F.when(kind == 0, F.concat(F.lit(" a | b"), (F.col("vec_id") % 7).cast("string"), F.lit("| a"))).when(
        kind == 1, F.concat(F.lit('["x y", "", "'), (F.col("vec_id") % 5).cast("string"), F.lit('", null]'))
    ).otherwise(F.lit(" plain "))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.when(kind == 0, F.array_join(D.as_list(raw), "|")).otherwise(F.array_join(D.as_list(raw), ",")).alias("items"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object inside other words."""
    text = F.concat(F.lit("Here you are: "), F.col("props"), F.lit(" - as asked"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(D.embedded_object(text), "$.k").cast("long").alias("k"))


@query("""SELECT w.index, count(label) > 0 AS found, count(label) AS hits FROM (VALUES ('1'), ('4'), ('77')) w(index) LEFT JOIN embeddings e ON CAST(e.label AS VARCHAR) = w.index
GROUP BY w.index""")
def multi_index_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the wanted indexes exist, and how much they hold."""
    return D.index_report(["1", "4", "77"], table(spark, sf_dir, "embeddings"), "label")


@query(
    """WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\r\\n\\x0B\\f]+'), lambda x: x <> '') AS ps FROM documents), a AS (SELECT doc_id, ps,
list_position(list_transform(ps, lambda x: regexp_replace(lower(x), '[^0-9a-z가-힣_]', '', 'g')), 'of') AS pos FROM w)
SELECT doc_id, array_to_string(list_transform(list_slice(ps, greatest(pos - 15, 1), greatest(pos - 15, 1) + 29), lambda x, i: CASE
WHEN i + greatest(pos - 15, 1) - 1 = pos THEN '<b>' || x || '</b>' ELSE x END), ' ') AS snippet FROM a WHERE pos > 0"""
)
def fts_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty words around the first hit, which is marked."""
    made = F.array_compact(F.array(D.marked_snippet(F.col("text"), "of")))  # not filtered: a filter would search each text again
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(made).alias("snippet"))


_NAME = "split_part(lower(url), '/', -1)"


@query(
    f"""WITH p AS (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, CASE WHEN contains(lower(url), 'blog') THEN 5 ELSE 0 END + CASE
WHEN contains(lower(url), '/en/') THEN 5 ELSE 0 END + CASE WHEN contains({_NAME}, '7') THEN 4 ELSE 0 END
 + CASE WHEN contains({_NAME}, '?page') THEN 2 ELSE 0 END + CASE WHEN contains({_NAME}, '#') THEN 2 ELSE 0 END + CASE WHEN ends_with({_NAME}, '.html') THEN 2
WHEN ends_with({_NAME}, 'x') THEN 1 ELSE 0 END AS score FROM pages)
SELECT host, page_id, CAST(score AS INTEGER) AS score FROM p WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY host ORDER BY score DESC, page_id DESC) = 1"""
)
def representative_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each host's best page by five kinds of points, of equals the newest; those without any point are none."""
    score = D.path_score(F.col("url"), ["blog", "/en/"], ["7"], {".html": 2, "x": 1}, {"?page": 2, "#": 2})
    rows = table(spark, sf_dir, "pages").select(
        "page_id", F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"), score.cast("int").alias("score")
    ).filter("score > 0")
    best = rows.groupBy("host").agg(F.max(F.struct("score", "page_id")).alias("b"))
    return best.select("host", "b.page_id", "b.score")


_MARKED = """SELECT doc_id, text || CASE WHEN doc_id % 6 = 0 THEN repeat('(cid:7)', CAST(doc_id % 30 AS INTEGER)) WHEN doc_id % 6 = 1 THEN repeat(chr(65533) || ' ',
CAST(doc_id % 700 AS INTEGER)) ELSE '' END AS text FROM documents"""
_SPOILT = "[\\x{FFFD}\\x{FFFE}\\x{FFFF}]|[□■○●◎◇◆△▲▽▼]{3,}|[\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}]|[가-힣][a-zA-Z][가-힣][a-zA-Z]|[ㄱ-ㅎㅏ-ㅣ]{5,}"
_MEASURES = f"""t AS ({_MARKED}), c AS (SELECT doc_id, length(text) AS chars, length(regexp_replace(text, '[ \\n\\t]', '', 'g')) AS dense,
len(regexp_extract_all(text, '\\(cid:[0-9]+\\)')) AS marks, len(regexp_extract_all(text, '[a-zA-Z]')) AS latin,
len(regexp_extract_all(text, '{_SPOILT}')) AS bad, len(list_filter(string_split(text, chr(10)), lambda p: length(trim(p, ' ' || chr(9) || chr(13))) < 30)) /
len(string_split(text, chr(10))) AS empty FROM t),
s AS (SELECT *, CASE WHEN dense > 0 THEN bad / dense ELSE 0 END AS spoilt, CASE WHEN dense > 0 THEN latin / dense ELSE 0 END AS letters FROM c),
m AS (SELECT *, least(1.0, CASE WHEN chars >= 1000 THEN 0.2 WHEN chars >= 100 THEN 0.2 * chars / 1000 ELSE 0.1 * chars / 100 END + 0.15 * letters + CASE
WHEN spoilt < 0.15 THEN 0.25 * (1 - spoilt / 0.15) ELSE 0 END + CASE WHEN empty < 0.3 THEN 0.25 * (1 - empty / 0.3) ELSE 0 END) AS score FROM s)"""


@query(
    f"""WITH {_MEASURES} SELECT doc_id, marks, round(spoilt, 6) AS spoilt, round(empty, 6) AS empty, round(score, 6) AS score,
CASE WHEN marks >= 20 OR marks / chars >= 0.005 OR chars < 100 THEN 'recognise' WHEN score >= 0.6 THEN 'use' WHEN spoilt > 0.3
OR score < 0.3 THEN 'recognise' ELSE 'convert' END AS action FROM m"""
)
def text_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do with each text, by its measures; lines stand for pages, and some texts end in marks of broken fonts or in lost characters."""
    key = F.col("doc_id")
    more = F.when(key % 6 == 0, F.repeat(F.lit("(cid:7)"), (key % 30).cast("int"))).when(key % 6 == 1, F.repeat(F.lit("\ufffd "), (key % 700).cast("int"))).otherwise("")
    texts = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", more).alias("text"))
    measured = texts.select("doc_id", *[c.alias(n) for n, c in D.text_measures(F.col("text"), F.split("text", "\n")).items()])
    rounded = [F.round(c, 6).alias(c) for c in ("spoilt", "empty", "score")]
    return D.text_actions(measured).select("doc_id", F.col("marks").cast("long").alias("marks"), *rounded, "action")


_WORDS = "(SELECT item_id, unnest(regexp_extract_all(lower(text), '[0-9a-z가-힣_]+')) AS term FROM benchmark)"


@query(f"SELECT term, item_id, count(*) AS tf FROM {_WORDS} WHERE item_id % 4 <> 1 GROUP BY ALL UNION ALL SELECT 'fresh', item_id, 1 FROM benchmark WHERE item_id % 4 = 1")
def index_replace_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after a quarter of its documents got a new text."""
    items = table(spark, sf_dir, "benchmark")
    fresh = items.filter("item_id % 4 = 1").withColumn("text", F.lit("Fresh!"))
    build = lambda rows: search.ranking.inverted_index(rows, "item_id")
    return D.replace_postings(build(items), build(fresh), "item_id")


@query("""SELECT source, '# ' || source || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY line) AS markdown FROM (SELECT source, '- ' || lang || ': ' ||
count(*) || ' texts' AS line FROM documents GROUP BY source, lang) GROUP BY source""")
def pages_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.markdown_pages(table(spark, sf_dir, "documents"), "source", "lang", "texts")


@query("""SELECT lang, '# ' || lang || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY line) AS markdown FROM (SELECT lang, '- ' || source || ': ' ||
count(*) || ' texts' AS line FROM documents GROUP BY source, lang) GROUP BY lang""")
def pages_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.markdown_pages(table(spark, sf_dir, "documents"), "lang", "source", "texts")


@query("SELECT page_id, sha256(html) AS checksum, strlen(html) AS bytes FROM pages")
def file_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.col("html").cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(data, 256).alias("checksum"), F.octet_length(data).cast("long").alias("bytes"))


@query("""SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 5 = 0 THEN lang END), ''), nullif(trim(CASE WHEN doc_id % 3 = 0 THEN source ELSE ' ' END), ''), nullif(CASE
WHEN doc_id % 2 = 0 THEN 'scan' || doc_id END, ''), 'base') AS organisation, CASE WHEN doc_id % 5 = 0 THEN 'final' WHEN doc_id % 3 = 0 THEN 'ocr'
WHEN doc_id % 2 = 0 THEN 'scan' ELSE 'base' END AS provenance FROM documents""")
def metadata_fallback_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four levels: final, recognised, scanned and base value."""
    from ..functions import text as T

    every = lambda n: F.col("doc_id") % n == 0
    levels = {"final": F.when(every(5), F.col("lang")), "ocr": F.when(every(3), F.col("source")).otherwise(" "), "scan": F.when(every(2), F.concat(F.lit("scan"), "doc_id")), "base": F.lit("base")}
    return table(spark, sf_dir, "documents").select("doc_id", T.first_filled(*levels.values()).alias("organisation"), T.fallback_source(**levels).alias("provenance"))
