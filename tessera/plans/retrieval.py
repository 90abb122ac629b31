"""Hit filters, merges, evidence, layer routing, rule metadata and page search over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters as X
from ..operators import ranking, vectors
from . import search
from .registry import query, table

_HITS = f"""{search.SCORED}, top AS (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 50), h AS (SELECT t.vec_id, t.score, d.source, d.lang,
CAST(2020 + d.doc_id % 5 AS VARCHAR) AS folder_year FROM top t LEFT JOIN documents d ON d.doc_id = t.vec_id)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty hits with what is known of their documents; unknown ones stay."""
    top = vectors.top_k(search.scored(spark, sf_dir), 50, "vec_id")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source", "lang", (2020 + F.col("doc_id") % 5).cast("string").alias("folder_year"))
    return top.join(docs, "vec_id", "left")


@query(f"""{_HITS} SELECT vec_id, lang FROM h WHERE lang = 'English' OR CASE lower(trim(lang)) WHEN 'en' THEN 'english'
WHEN 'anglais' THEN 'english' ELSE lower(trim(lang)) END = 'english'""")
def hit_filter_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category as it is, or equal after renaming."""
    return hits(spark, sf_dir).filter(X.category_is(F.col("lang"), "English", {"en": "english", "anglais": "english"})).select("vec_id", "lang")


@query(f"{_HITS} SELECT vec_id, source, folder_year FROM h WHERE contains(lower(source), 'src1') AND folder_year = '2022'")
def hit_filter_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part of the organisation's name and exactly the year."""
    return hits(spark, sf_dir).filter(X.metadata_is(F.col("source"), F.col("folder_year"), "SRC1", "2022")).select("vec_id", "source", "folder_year")


_PATH = "regexp_replace(url, '^[a-z]+://[^/]*/', '')"


@query(
    f"""WITH p AS (SELECT page_id, {_PATH} AS path, url, split_part({_PATH}, '/', 1) AS folder, split_part(split_part(url, '://', 2), '.', 1) AS site FROM pages),
k AS (SELECT *, CASE lower(trim(folder)) WHEN 'en' THEN 'english' ELSE lower(trim(folder)) END AS g1, lower(trim(site)) AS g2,
regexp_replace(lower(trim(folder)), '\\s+', '', 'g') AS l1 FROM p)
SELECT page_id FROM k WHERE (g1 = 'english' OR g2 = 'english') AND l1 = 'en' AND (contains(lower(path), 'en/1') OR contains(lower(url), 'en/1'))"""
)
def hit_filter_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, section and path at once; labels are compared without white space and case."""
    path = F.regexp_replace("url", "^[a-z]+://[^/]*/", "")
    rows = table(spark, sf_dir, "pages").select(
        "page_id", "url", path.alias("path"), F.split_part(path, F.lit("/"), F.lit(1)).alias("folder"),
        F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("."), F.lit(1)).alias("site")
    )
    keep = X.structure_is([F.col("folder"), F.col("site")], [F.col("folder")], [F.col("path"), F.col("url")], "English", section=" E n", prefix="EN\\1", group_names={"en": "english"})
    return rows.filter(keep).select("page_id")


@query(
    """WITH x AS (SELECT s.s_suppkey, r.r_name, s.s_name, n.n_name, regexp_replace(lower(trim(concat_ws(' ', n.n_name, s.s_name))), '\\s+', '', 'g') AS section FROM supplier s
JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey)
SELECT s_suppkey FROM x WHERE contains(lower(trim(s_name)), '1') AND contains(regexp_replace(lower(trim(n_name)), '\\s+', '', 'g'), '1')
AND contains(section, lower('1supplier')) """
)
def metadata_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every wish is part of its normalised column; the section wish may stand anywhere in the joined section texts."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    columns = {"category": F.col("r_name"), "organization": F.col("s_name"), "project_type": F.col("n_name"), "section_type": F.col("s_name")}
    wishes = {"category": "", "organization": " 1 ", "project_type": "1", "section_type": "1 Supplier"}
    keep = X.metadata_holds(columns, wishes, [F.col("n_name"), F.col("s_name")], compact=["project_type"], in_section=["section_type"])
    return rows.filter(keep).select("s_suppkey")


_MERGED = f"""{search._TWO}, m AS (SELECT coalesce(a.vec_id, b.vec_id) AS vec_id, a.score AS v, b.score AS g FROM a FULL JOIN b ON a.vec_id = b.vec_id),
k AS (SELECT vec_id, v, g, 5 * greatest(coalesce(v, 0), coalesce(g, 0)) * CASE WHEN v IS NOT NULL AND g IS NOT NULL THEN 1.2 ELSE 1 END
 + CASE WHEN v IS NOT NULL THEN 1.0 ELSE 1.5 END + CASE WHEN v > 0 AND g > 0 THEN 1.0 ELSE 0 END + CASE WHEN v IS NOT NULL AND g IS NOT NULL THEN 0.3 ELSE 0 END AS z FROM m)"""


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.hybrid_merge(*search.two_lists(spark, sf_dir), "vec_id")


@query(f"{_MERGED} SELECT vec_id, row_number() OVER (ORDER BY v IS NOT NULL DESC, z DESC, vec_id) AS rank FROM k QUALIFY rank <= 30")
def hybrid_merge_vector_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.source_first(merged(spark, sf_dir), "vec_id", True, 30).select("vec_id", "rank")


@query(f"{_MERGED} SELECT vec_id, row_number() OVER (ORDER BY v IS NULL DESC, z DESC, vec_id) AS rank FROM k QUALIFY rank <= 30")
def hybrid_merge_graph_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.source_first(merged(spark, sf_dir), "vec_id", False, 30).select("vec_id", "rank")


@query(f"""{_MERGED}, t AS (SELECT *, row_number() OVER (ORDER BY z DESC, vec_id) AS rank FROM k) SELECT t.vec_id, rank, CASE
WHEN v IS NOT NULL THEN 'vector' ELSE 'graph' END AS found_by, round(z, 6) AS score, d.source, d.lang FROM t LEFT JOIN documents d ON d.doc_id = t.vec_id WHERE rank <= 5""")
def evidence_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source", "lang")
    found = X.evidence(merged(spark, sf_dir), docs, "vec_id")
    return found.select("vec_id", "rank", "found_by", F.round("merged_score", 6).alias("score"), "source", "lang")


_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '' AND x[1] <> '#')"


@query(
    f"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10))[1] AS title FROM documents),
s AS (SELECT doc_id, CASE WHEN contains(lower(title), 'the or') THEN 5.0 ELSE 0.0 END + CASE WHEN contains(lower(text), 'the or') THEN 2.0 ELSE 0.0 END +
len(list_intersect(list_distinct(regexp_extract_all(lower(title), '[0-9a-z가-힣_]+')), ['the', 'or'])) AS score,
 coalesce(list_filter({_LINES}, lambda x: contains(lower(x), 'the or'))[1], {_LINES}[1], '') AS line FROM d)
SELECT doc_id, CAST(score AS DOUBLE) AS score, substr(line, 1, 240) AS snippet FROM s WHERE score > 0 ORDER BY s.score DESC, doc_id LIMIT 25"""
)
def project_page_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return X.page_search(docs, F.get(F.split("text", "\n"), 0), F.col("text"), "The or", 25, "doc_id").withColumn("score", F.col("score").cast("double"))


@query("SELECT lang AS tag_type, source AS tag_name, count(*) AS frequency FROM documents GROUP BY 1, 2 HAVING count(*) > 0 ORDER BY frequency DESC, tag_type, tag_name LIMIT 10")
def tag_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("tag_type"), F.col("source").alias("tag_name")).agg(F.count("*").alias("frequency"))
    return X.top_clusters(counted, "tag_type", "tag_name")


@query("""WITH k AS (SELECT CASE WHEN length(w) > 5 THEN 'long' ELSE 'general' END AS tag_type, w AS tag_name, count(*) AS frequency
FROM (SELECT unnest(regexp_extract_all(lower(text), '[0-9a-z가-힣_]+')) AS w FROM benchmark) WHERE length(w) >= 2 GROUP BY ALL) SELECT * FROM k
ORDER BY frequency DESC, tag_type, tag_name LIMIT 10""")
def keyword_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(T.tokens(F.col("text"), 2)).alias("tag_name"))
    kind = F.when(F.length("tag_name") > 5, "long").otherwise("general")
    return X.top_clusters(words.groupBy(kind.alias("tag_type"), "tag_name").agg(F.count("*").alias("frequency")), "tag_type", "tag_name")


@query("""SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS failed,
count(*) FILTER (o_orderstatus = 'P') AS pending, CAST(0 AS BIGINT) AS skipped, CAST(sum(o_custkey) AS BIGINT) AS total_pages,
count(*) FILTER (o_totalprice > 200000) AS ocr_count, count(*) FILTER (o_orderpriority = '1-URGENT') AS converted_count FROM orders""")
def processing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as processed documents: rows per status, sums and flags in one pass."""
    rows = table(spark, sf_dir, "orders").withColumn("status", X.mapped(F.col("o_orderstatus"), {"F": "done", "O": "failed", "P": "pending"}))
    flags = {"ocr_count": F.col("o_totalprice") > 200000, "converted_count": F.col("o_orderpriority") == "1-URGENT"}
    return X.status_summary(rows, "status", ["done", "failed", "pending", "skipped"], {"total_pages": F.col("o_custkey")}, flags)


_FORM = "trim(regexp_replace(translate(regexp_replace(regexp_replace(trim(regexp_replace(trim(w, ' '), '^[#\\-•·]+', ''), ' '), '^<+|>+$', '', 'g'), '[.]+$', ''), '\\/', '  '), '\\s{2,}', ' ', 'g'), ' ')"


@query(
    f"""WITH g AS (SELECT item_id, list_concat(list_slice(string_split(text, ' '), 1, 12), list_slice(string_split(lower(text), ' '), 6, 25)) AS ws FROM benchmark),
n AS (SELECT item_id, list_filter(list_transform(ws, lambda w: {_FORM}), lambda v: length(v) BETWEEN 2 AND 40 AND NOT regexp_matches(v, '^[0-9.]+$')
AND NOT contains(v, ':') AND lower(v) NOT IN ('the', 'der')) AS ws FROM g)
SELECT item_id, array_to_string(list_slice(list_filter(ws, lambda x, i: list_position(ws, x) = i), 1, 40), ' | ') AS keywords FROM n"""
)
def keyword_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two candidate lists in one, in order of first appearance."""
    rows = table(spark, sf_dir, "benchmark")
    found = X.merged_keywords([F.slice(F.split("text", " "), 1, 12), F.slice(F.split(F.lower("text"), " "), 6, 20)], ["the", "der"])
    return rows.select("item_id", F.array_join(found, " | ").alias("keywords"))


KINDS = {"factual": ["th[aeiou]", "qu[ei]"], "conceptual": ["tion", "keit"], "relational": ["and ", "und ", "ent"], "summary": ["ing", "ung", "ment"]}
LAYERS = {
    "factual": ["vector", "wiki", "graph", "ontology"],
    "conceptual": ["ontology", "wiki", "vector", "graph"],
    "relational": ["graph", "vector", "ontology", "wiki"],
    "summary": ["wiki", "vector", "graph", "ontology"],
    "unknown": ["vector", "wiki", "ontology", "graph"],
}
LAYER_TERMS = {"ation": ["ationen", "atione"], "eaux": ["eau"], "ingen": ["ing"]}


@query(
    """WITH c AS (SELECT item_id, lower(text) AS t FROM benchmark),
n AS (SELECT *, CAST(regexp_matches(t, 'th[aeiou]') AS INT) + CAST(regexp_matches(t, 'qu[ei]') AS INT) AS f, CAST(contains(t, 'tion') AS INT) +
CAST(contains(t, 'keit') AS INT) AS c,
 CAST(contains(t, 'and ') AS INT) + CAST(contains(t, 'und ') AS INT) + CAST(contains(t, 'ent') AS INT) AS r, CAST(contains(t, 'ing') AS INT) +
CAST(contains(t, 'ung') AS INT) + CAST(contains(t, 'ment') AS INT) AS s FROM c),
k AS (SELECT *, greatest(f, c, r, s) AS b, CASE WHEN greatest(f, c, r, s) = 0 THEN 'unknown' WHEN f = greatest(f, c, r, s) THEN 'factual'
WHEN c = greatest(f, c, r, s) THEN 'conceptual' WHEN r = greatest(f, c, r, s) THEN 'relational' ELSE 'summary' END AS kind,
 contains(t, 'ation') OR contains(t, 'eaux') OR contains(t, 'ingen') AS term FROM n)
SELECT item_id, kind, round(CASE WHEN b = 0 THEN 0.3 ELSE least(b / (f + c + r + s), 0.95) END, 6) AS confidence,
CASE kind WHEN 'factual' THEN CASE WHEN term THEN 'vector,ontology,wiki,graph' ELSE 'vector,wiki,graph,ontology' END WHEN 'conceptual' THEN 'ontology,wiki,vector,graph'
WHEN 'relational' THEN CASE WHEN term THEN 'graph,ontology,vector,wiki' ELSE 'graph,vector,ontology,wiki' END
 WHEN 'summary' THEN CASE WHEN term THEN 'wiki,ontology,vector,graph' ELSE 'wiki,vector,graph,ontology' END ELSE CASE
WHEN term THEN 'vector,ontology,wiki,graph' ELSE 'vector,wiki,ontology,graph' END END AS layers,
array_to_string(list_sort(list_distinct(list_concat(CASE WHEN contains(t, 'ation') THEN ['ation', 'ationen', 'atione'] ELSE [] END, CASE
WHEN contains(t, 'eaux') THEN ['eaux', 'eau'] ELSE [] END, CASE WHEN contains(t, 'ingen') THEN ['ingen', 'ing'] ELSE [] END))), ',') AS expanded FROM k"""
)
def layer_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of question, its search layers in order, and the found terms with their synonyms."""
    found = X.layer_route(F.col("text"), KINDS, LAYERS, LAYER_TERMS, "ontology", "unknown")
    return table(spark, sf_dir, "benchmark").select(
        "item_id", found["kind"].alias("kind"), F.round(found["confidence"], 6).alias("confidence"),
        F.array_join(found["layers"], ",").alias("layers"), F.array_join(found["expanded"], ",").alias("expanded")
    )


@query(
    """WITH p AS (SELECT page_id, lower(url) AS u, split_part(split_part(lower(url), '://', 2), '/', 1) AS host, regexp_extract(url, '/([0-9]+)[^/]*$', 1) AS project
FROM pages),
m AS (SELECT page_id, CASE WHEN contains(u, '.html') THEN 'document' WHEN contains(u, '?') THEN 'listing' ELSE 'unknown' END AS document_type, project, CASE WHEN
regexp_matches(host, '^(blog|www)\\.') THEN regexp_extract(host, '([a-z-]+)\\.example', 1) ELSE '' END AS organisation,
list_filter([CASE WHEN contains(u, '/en/') THEN 'english' END, CASE WHEN contains(u, '/fr/') OR contains(u, '/es/') THEN 'romance' END, CASE
WHEN contains(u, '?page') THEN 'paged' END, CASE WHEN contains(u, '#') THEN 'anchor' END], lambda x: x IS NOT NULL) AS tags FROM p)
SELECT page_id, document_type, organisation, array_to_string(tags, ',') AS tags, round(least(1.0, CASE WHEN document_type <> 'unknown' THEN 0.3 ELSE 0 END + CASE
WHEN project <> '' THEN 0.2 ELSE 0 END + CASE WHEN organisation <> '' THEN 0.2 ELSE 0 END + CASE WHEN len(tags) > 0 THEN 0.15 ELSE 0 END), 2)::DOUBLE AS confidence
FROM m"""
)
def file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, organisation and tags by rules over an address, and a confidence that adds up what was found."""
    lower = F.lower("url")
    host = F.split_part(F.split_part(lower, F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    kind = X.first_rule([(F.contains(lower, F.lit(".html")), "document"), (F.contains(lower, F.lit("?")), "listing")], "unknown")
    organisation = F.when(host.rlike(r"^(blog|www)\."), F.regexp_extract(host, r"([a-z-]+)\.example", 1)).otherwise("")
    tags = X.tags_of(F.col("url"), {"english": ["/en/"], "romance": ["/fr/", "/es/"], "paged": ["?page"], "anchor": ["#"]})
    confidence = X.additive_confidence([(kind != "unknown", 0.3), (F.regexp_extract("url", r"/([0-9]+)[^/]*$", 1) != "", 0.2), (organisation != "", 0.2), (F.size(tags) > 0, 0.15)])
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("document_type"), organisation.alias("organisation"), F.array_join(tags, ",").alias("tags"), confidence.alias("confidence"))


GROUP_RULES = [
    (["/en/"], ["index_"], "english", [(["?page"], [], "paged"), ([".html"], [], "document")], "plain"),
    (["/fr/", "/es/"], [], "romance", [(["#"], [], "anchored")], "plain"),
]


@query(
    """WITH p AS (SELECT page_id, lower(url) AS u FROM pages) SELECT page_id, CASE WHEN contains(u, '/en/') THEN 'english' WHEN contains(u, '/fr/')
OR contains(u, '/es/') THEN 'romance' ELSE 'general' END AS document_group,
CASE WHEN contains(u, '/en/') THEN CASE WHEN contains(u, '?page') THEN 'paged' WHEN contains(u, '.html') THEN 'document' ELSE 'plain' END WHEN contains(u, '/fr/')
OR contains(u, '/es/') THEN CASE WHEN contains(u, '#') THEN 'anchored' ELSE 'plain' END ELSE 'unclassified' END AS category FROM p"""
)
def document_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and category of a path by ordered rules."""
    group, category = X.document_group(F.col("url"), F.element_at(F.split("url", "/"), -1), GROUP_RULES, ("general", "unclassified"))
    return table(spark, sf_dir, "pages").select("page_id", group.alias("document_group"), category.alias("category"))


@query(
    """WITH l AS (SELECT doc_id, trim(unnest(list_slice(string_split(text, chr(10)), 1, 40)), ' ') AS line, generate_subscripts(list_slice(string_split(text, chr(10)), 1, 40), 1) - 1 AS n FROM documents),
f AS (SELECT doc_id, arg_min(regexp_extract(line, '^(?:Contact|Mail|Licensed)\\s*:\\s*(.+)$', 1), n) FILTER (trim(regexp_extract(line, '^(?:Contact|Mail|Licensed)\\s*:\\s*(.+)$', 1)) <> '') AS a,
 arg_min(line, n) FILTER (n < 20 AND length(line) <= 40 AND NOT contains(line, ':') AND
regexp_matches(line, '(tion|ment|keit)\\.?$')) AS b, arg_min(regexp_extract(line, '(20[0-3][0-9]) *[./년]', 1), n) FILTER (n < 20 AND
regexp_extract(line, '(20[0-3][0-9]) *[./년]', 1) <> '') AS y FROM l GROUP BY doc_id)
SELECT doc_id, coalesce(trim(a), b) AS organisation, y AS year FROM f WHERE coalesce(trim(a), b) IS NOT NULL OR y IS NOT NULL"""
)
def organisation_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled or bare organisation and year of the first lines; a point may end a bare one."""
    return X.from_lines(table(spark, sf_dir, "documents"), "doc_id", "text", ["Contact", "Mail", "Licensed"], [r"tion\.?", r"ment\.?", r"keit\.?"])


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?is)the\\s+of') THEN length(regexp_extract(text, '(?is)^(.*?)(the\\s+of)', 1)) ELSE -1 END AS at FROM conversations")
def highlight_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a phrase stands, whatever white space is between its words."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.whitespace_match(F.col("text"), "the of").cast("long").alias("at"))


@query()
def highlight_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that nearly hold a phrase; character similarity has no SQL form, so the tests hold goldens."""
    rows = table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    return X.fuzzy_sentences(rows, "id", "text", "the of and", 0.6)


@query("""WITH r AS (SELECT *, CASE WHEN role = lag(role) OVER w AND turn = lag(turn) OVER w + 1 THEN 0 ELSE 1 END AS fresh FROM conversations WINDOW w AS (PARTITION BY conv_id
ORDER BY turn)), k AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM r) SELECT conv_id, role, min(turn) AS start, max(turn) AS stop,
count(*) AS n FROM k GROUP BY conv_id, role, run""")
def slide_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring units of one kind as one section with its range."""
    return X.islands(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id > 40 ORDER BY vec_id LIMIT 25")
def vector_scroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.page_after(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", 40, 25)


@query("SELECT vec_id, label FROM embeddings WHERE NOT coalesce(label IN (2, 3) AND vec_id > 10, false)")
def vector_delete_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays after a deletion by condition."""
    return X.without(table(spark, sf_dir, "embeddings").select("vec_id", "label"), F.col("label").isin(2, 3) & (F.col("vec_id") > 10))


@query("SELECT n_nationkey AS snapshot, n_nationkey = 7 AS active, n_nationkey = 3 AS was_active FROM nation")
def snapshot_activate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation 3 was active; 7 is activated, an unknown one changes nothing."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("snapshot"), (F.col("n_nationkey") == 3).alias("active"), F.lit(False).alias("was_active"))
    return X.activated(X.activated(rows, "snapshot", 7), "snapshot", -1)


@query("SELECT n_nationkey AS snapshot, n_nationkey = 3 AS active, n_nationkey = 7 AS was_active FROM nation")
def snapshot_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.rolled_back(snapshot_activate(spark, sf_dir))


@query("""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[0-9a-z가-힣_]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[0-9a-z가-힣_]+'), 1) AS p
FROM benchmark), k AS (SELECT item_id, w AS keyword, count(*) AS n, min(p) AS p FROM w WHERE length(w) >= 2 GROUP BY ALL) SELECT item_id, keyword, n,
CAST(row_number() OVER (PARTITION BY item_id ORDER BY n DESC, p) AS INTEGER) AS rank FROM k QUALIFY rank <= 5""")
def regex_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent words of a text, ties by first place: keywords where no morphological analyser is installed."""
    return X.frequent_words(table(spark, sf_dir, "benchmark"), "item_id", "text", 5)


_PLAN = """WITH q AS (SELECT item_id, INTENT_OF_ROW, CAST(contains(lower(text), 'ing') AS INT) + CAST(contains(lower(text), 'que') AS INT) +
CAST(contains(lower(text), 'th') AS INT) + CAST(contains(lower(text), 'er') AS INT) + CAST(contains(lower(text), 'on') AS INT) AS n,
contains(lower(text), 'que') AS sf, contains(lower(text), 'ing') AS df FROM benchmark), c AS (SELECT *, CASE WHEN n <= 1 THEN 'simple'
WHEN n <= 3 THEN 'moderate' ELSE 'complex' END AS k, intent IN ('document', 'section') AS find, intent IN ('example', 'compare') AS ex FROM q),
r AS (SELECT item_id, intent, k AS complexity, CASE WHEN n = 0 AND k = 'simple' THEN 'vector|vector_only' WHEN find AND sf
AND k = 'complex' THEN 'vector,graph,wiki|parallel' WHEN find AND (sf OR df) THEN 'vector,graph|vector_first' WHEN find
AND k = 'complex' THEN 'graph,vector,wiki|graph_first' WHEN find THEN 'graph,vector|graph_first'
WHEN ex AND (sf OR df) AND k = 'complex' THEN 'vector,graph,wiki|parallel' WHEN ex AND (sf OR df) THEN 'vector,graph,wiki|vector_first'
WHEN ex THEN 'graph,wiki,vector|graph_first' WHEN intent = 'requirement' THEN 'vector,graph|vector_first' WHEN intent = 'summary' THEN 'wiki,vector|wiki_first'
WHEN (sf OR df) AND k = 'complex' THEN 'vector,graph|parallel' WHEN sf OR df THEN 'vector,graph|vector_first'
WHEN k <> 'simple' THEN 'graph,vector|graph_first' ELSE 'vector,graph|vector_first' END AS p FROM c)
SELECT item_id, intent, complexity, split_part(p, '|', 1) AS sources, split_part(p, '|', 2) AS run_order FROM r"""
_PLAN_SQL = _PLAN.replace(
    "INTENT_OF_ROW",
    "CASE item_id % 6 WHEN 0 THEN 'document' WHEN 1 THEN 'example' WHEN 2 THEN 'requirement' WHEN 3 THEN 'summary' WHEN 4 THEN 'section' ELSE 'general' END AS intent"
)


@query(_PLAN_SQL)
def search_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complexity, sources and their order from intent and filters."""
    lower = F.lower("text")
    has = lambda w: F.contains(lower, F.lit(w))
    intent = F.element_at(F.array(*[F.lit(x) for x in ("document", "example", "requirement", "summary", "section", "general")]), (F.col("item_id") % 6 + 1).cast("int"))
    n = sum((F.when(has(w), 1).otherwise(0) for w in ("ing", "que", "th", "er", "on")), F.lit(0))
    sources, order = X.search_plan(intent, n, has("que"), has("ing"))
    return table(spark, sf_dir, "benchmark").select("item_id", intent.alias("intent"), X.complexity(n).alias("complexity"), sources.alias("sources"), order.alias("run_order"))


_PACKED = """p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS l FROM documents),
x AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM p), y AS (SELECT doc_id, x, i, sum(length(x) + 2) OVER (PARTITION BY doc_id ORDER BY i) AS q FROM x),
r AS (SELECT doc_id, list(x ORDER BY i) AS l, list_prepend(0, list(CAST(q AS BIGINT) ORDER BY i)) AS q FROM y GROUP BY doc_id),
c(doc_id, l, q, start, lead, last, made, no) AS (SELECT doc_id, l, q, 0, '', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), -1 FROM r UNION ALL
SELECT doc_id, l, q, stop, coalesce(trim(right(coalesce(made, last), 180), ' ' || chr(9) || chr(10) || chr(13)), ''), last, made, no + CASE WHEN made IS NULL THEN 0 ELSE 1 END FROM (SELECT doc_id, l, q, stop, last, no,
CASE WHEN length(chunk) >= 250 OR (stop = len(l) AND last IS NULL) THEN chunk WHEN stop = len(l) THEN right(last || chr(10) || chr(10) || chunk, 1400) END AS made
FROM (SELECT *, CASE WHEN lead <> '' THEN lead || chr(10) || chr(10) ELSE '' END || array_to_string(l[start + 1:stop], chr(10) || chr(10)) AS chunk
FROM (SELECT doc_id, l, q, start, lead, coalesce(made, last) AS last, no, greatest(start + 1, len(list_filter(q, lambda v: v <= q[start + 1] + 1400 - length(lead))) - 1) AS stop FROM c WHERE start < len(l)))))"""


@query(f"WITH RECURSIVE {_PACKED} SELECT doc_id, CAST(no AS INTEGER) AS chunk_index, made AS text FROM c WHERE made IS NOT NULL")
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sections of which every line is a paragraph, packed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("body"))
    return X.section_chunks(docs, ["doc_id"], "body")


SINGLE = {
    "organization": [("thand", "Thand House"), ("tion", "Tion Works")],
    "project_type": [("ING ", "building"), ("ent", "planning")],
    "document_group": [("eaux|ouan", "plan"), ("und ", "report")],
    "document_category": [("wh", "method"), ("[aeiou]{3}", "survey")],
}
SEVERAL = {"technologies": [("er", "ER"), ("on", "ON"), ("ER", "ER"), ("zz", "ZZ")]}


@query(
    """WITH f AS (SELECT item_id, lower(text) AS t, nullif(regexp_extract(text, '(20[12][0-9])', 1), '') AS y FROM benchmark),
g AS (SELECT item_id, CASE WHEN contains(t, 'thand') THEN 'Thand House' WHEN contains(t, 'tion') THEN 'Tion Works' END AS organization, CASE
WHEN contains(t, 'ing ') THEN 'building' WHEN contains(t, 'ent') THEN 'planning' END AS project_type,
 CASE WHEN regexp_matches(t, 'eaux|ouan') THEN 'plan' WHEN contains(t, 'und ') THEN 'report' END AS document_group, CASE WHEN contains(t, 'wh') THEN 'method' WHEN
regexp_matches(t, '[aeiou]{3}') THEN 'survey' END AS document_category,
 array_to_string(list_filter([CASE WHEN contains(t, 'er') THEN 'ER' END, CASE WHEN contains(t, 'on') THEN 'ON' END, CASE
WHEN contains(t, 'zz') THEN 'ZZ' END], lambda x: x IS NOT NULL), ',') AS technologies, y FROM f)
SELECT item_id, project_type, technologies, array_to_string(list_filter(['organization=' || organization, 'year=' || y, 'document_group=' || document_group, 'document_category=' || document_category], lambda x: x IS NOT NULL), ';') AS filters FROM g"""
)
def prompt_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a prompt says about organisation, kind, technology, year, group and category, and the filters that follow."""
    found = X.prompt_fields(F.col("text"), SINGLE, SEVERAL)
    filters = X.suggested_filters(found, ["organization", "year", "document_group", "document_category"])
    return table(spark, sf_dir, "benchmark").select("item_id", found["project_type"].alias("project_type"), F.array_join(found["technologies"], ",").alias("technologies"), filters.alias("filters"))


@query(
    """WITH t AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages), h AS (SELECT *, substr(title, 1, 40) AS head FROM t),
k AS (SELECT *, CASE WHEN contains(url, '/fr/') THEN 'french' WHEN contains(url, '/de/') THEN 'german' WHEN regexp_matches(head, 'tion|ing') THEN 'english' WHEN
regexp_matches(head, 'ción|ando') THEN 'spanish' WHEN len(regexp_extract_all(head, 'th')) >= 2 THEN 'english' END AS kind,
 CASE WHEN contains(url, '/fr/') OR contains(url, '/de/') THEN 0.95 WHEN regexp_matches(head, 'tion|ing') THEN 0.92 WHEN regexp_matches(head, 'ción|ando') THEN 0.88 WHEN
len(regexp_extract_all(head, 'th')) >= 2 THEN 0.82 ELSE 0.0 END AS sure, nullif(regexp_extract(url, '(20[12][0-9])', 1), '') AS y FROM h)
SELECT page_id, kind, y AS year, CAST(CASE WHEN sure > 0 AND y IS NOT NULL THEN round((sure + 0.8) / 2, 3) WHEN sure > 0 THEN round(sure, 3)
WHEN y IS NOT NULL THEN 0.8 END AS DOUBLE) AS confidence FROM k"""
)
def field_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's type by path, pattern or signals, its year, and the mean confidence of what was found."""
    kind, sure = X.typed(F.col("url"), F.col("title"), [("/fr/", "french"), ("/de/", "german")], [("tion|ing", "english", 0.92), ("ción|ando", "spanish", 0.88)], [("th", "english", 0.82)], head=40)
    year = F.nullif(F.regexp_extract("url", "(20[12][0-9])", 1), F.lit(""))
    confidence = X.mean_confidence([sure, F.when(year.isNotNull(), 0.8).otherwise(0.0)])
    return search.titled(spark, sf_dir).select("page_id", kind.alias("kind"), year.alias("year"), confidence.alias("confidence"))
