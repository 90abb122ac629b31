"""Text scalars, quality, routing, metadata and structure over ``documents``, ``pages``, ``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from .registry import ORACLE_SQL, query, table

_WS = "[ \\t\\r\\n\\x0B\\f]+"
_SQ = f"trim(regexp_replace(text, '{_WS}', ' ', 'g'))"


_MIXED = "(SELECT doc_id, translate(text, 'xqjaeo', '가나다라마바') AS text FROM documents)"
_REST = f"trim(regexp_replace(regexp_replace(text, '[가-힣]', ' ', 'g'), '{_WS}', ' ', 'g'))"


@query(f"""SELECT doc_id, CAST(floor(len(regexp_extract_all(text, '[가-힣]')) / 1.8 + 0.75 * CASE WHEN {_REST} = '' THEN 0 ELSE
len(string_split({_REST}, ' ')) END) AS BIGINT) AS tokens FROM {_MIXED}""")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with six letters turned to syllables, so that both halves of the estimate count."""
    mixed = F.translate("text", "xqjaeo", "가나다라마바")
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(mixed).alias("tokens"))


@query("""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id,
list_filter(regexp_extract_all(lower(text), '[0-9a-z가-힣_]+'), lambda x: len(x) >= 2) AS t FROM documents)""")
def tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text"), 2).alias("t"))
    return found.select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"),
        F.md5(F.array_join("t", " ").cast("binary")).alias("digest")
    )


@query(
    f"SELECT doc_id, CASE WHEN length({_SQ}) > 220 THEN substr({_SQ}, 1, 220) || '...' ELSE {_SQ} END AS short, length(regexp_replace(lower(text), '{_WS}', '', 'g')) AS compact_chars FROM documents"
)
def shorten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.shorten(F.col("text")).alias("short"), F.length(T.compact(F.col("text"))).cast("long").alias("compact_chars"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 1800 THEN left(text, 900) || '\n...\n' || right(text, 900) ELSE text END) AS digest FROM documents")
def middle_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.middle_cut(F.col("text")).cast("binary")).alias("digest"))


@query(
    f"""WITH t AS (SELECT doc_id, {_SQ} AS t FROM documents), m AS (SELECT doc_id, t, length(t) AS n, len(regexp_extract_all(t, '[A-Za-z가-힣À-ÖØ-öø-ÿ]')) AS letters,
len(list_distinct(string_split(t, ''))) AS uniq FROM t)
SELECT doc_id, CASE WHEN n = 0 THEN 'empty' WHEN regexp_matches(t, '^[=-]+ *\\[?[A-Za-z]+ [0-9]+\\]? *[=-]+$') THEN 'page_marker' WHEN
len(regexp_extract_all(t, '\\.{{4,}}')) >= 2 THEN 'toc' WHEN letters < 10 THEN 'short' WHEN letters / n < 0.3 THEN 'few_letters'
WHEN uniq / n < 0.15 THEN 'monotone' ELSE 'ok' END AS reason FROM m"""
)
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why texts of any length are no use."""
    return table(spark, sf_dir, "documents").select("doc_id", T.gate(F.col("text")).alias("reason"))


@query(ORACLE_SQL["gate"])
def gate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why texts of any length are no use; held against brute force."""
    return table(spark, sf_dir, "documents").select("doc_id", T.gate(F.col("text")).alias("reason"))


@query(
    """WITH m AS (SELECT doc_id, length(text) AS n, len(regexp_extract_all(text, '[A-Za-z]')) AS latin, len(regexp_extract_all(text, '\\(cid:[0-9]+\\)')) AS bad FROM documents)
SELECT doc_id, round(least(1.0, CASE WHEN n >= 1000 THEN 0.2 WHEN n >= 100 THEN 0.2 * n / 1000 ELSE 0.1 * n / 100 END + 0.15 * CASE WHEN n > 0 THEN latin / n ELSE 0 END +
CASE WHEN bad = 0 THEN 0.25 WHEN bad / n < 0.15 THEN 0.25 * (1 - bad / n / 0.15) ELSE 0 END + 0.25), 6) AS score FROM m"""
)
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.quality_score(F.col("text"), F.lit(1), F.lit(0)), 6).alias("score"))


SYNONYMS = {"the": ["this", "that"], "las": ["los"], "und": ["auch"], "les": ["des"]}


@query(
    """WITH s(k, v, n) AS (VALUES ('the', 'this', 1), ('the', 'that', 2), ('las', 'los', 1), ('und', 'auch', 1), ('les', 'des', 1)), w AS (SELECT item_id, text,
list_distinct(regexp_extract_all(lower(text), '[0-9a-z가-힣_]+')) AS ws FROM benchmark),
x AS (SELECT item_id, string_agg(v, ' ' ORDER BY k, n) AS more FROM w JOIN s ON list_contains(ws, k) AND NOT contains(lower(text), v) GROUP BY item_id)
SELECT w.item_id, CASE WHEN more IS NOT NULL THEN text || ' ' || more ELSE text END AS expanded FROM w LEFT JOIN x ON x.item_id = w.item_id"""
)
def query_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.expand(F.col("text"), SYNONYMS).alias("expanded"))


MODES = [("graph_rag", ["relation", "zusammen"]), ("rfp_analysis", ["the ", "que "]), ("bid_project", ["und ", "des "])]


@query("""SELECT item_id, CASE WHEN contains(lower(text), 'relation') OR contains(lower(text), 'zusammen') THEN 'graph_rag' WHEN contains(lower(text), 'the ')
OR contains(lower(text), 'que ') THEN 'rfp_analysis' WHEN contains(lower(text), 'und ') OR contains(lower(text), 'des ') THEN 'bid_project' ELSE 'general' END AS mode
FROM benchmark""")
def mode_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.first_match(F.col("text"), MODES, "general").alias("mode"))


ROUTES = {"factual": ["th[aeiou]", "qu[ei]"], "relational": ["and", "und", "y "], "summary": ["tion", "ung", "ment"]}


@query(
    """WITH r(intent, p, pri) AS (VALUES ('factual', 'th[aeiou]', 0), ('factual', 'qu[ei]', 0), ('relational', 'and', 1), ('relational', 'und', 1), ('relational', 'y ', 1), ('summary', 'tion', 2), ('summary', 'ung', 2), ('summary', 'ment', 2)),
s AS (SELECT item_id, intent, pri, count(*) FILTER (regexp_matches(lower(text), p)) AS n FROM benchmark, r GROUP BY ALL)
SELECT item_id, CASE WHEN max(n) = 0 THEN 'general' ELSE arg_max(intent, n * 10 - pri) END AS intent, round(least(0.5 + 0.15 *
max(n), 0.9) + 0.1, 4)::DOUBLE AS confidence FROM s GROUP BY item_id"""
)
def route_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent with the most matching patterns, in the order of the table for ties; confidence by their number."""
    lower = F.lower("text")
    counted = [F.struct(sum((F.when(lower.rlike(p), 1).otherwise(0) for p in ps), F.lit(0)).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, ps) in enumerate(ROUTES.items())]
    best = table(spark, sf_dir, "benchmark").select("item_id", F.array_max(F.array(*counted)).alias("b"))
    return best.select("item_id", F.when(F.col("b.n") == 0, "general").otherwise(F.col("b.name")).alias("intent"), F.round(F.least(0.5 + 0.15 * F.col("b.n"), F.lit(0.9)) + 0.1, 4).alias("confidence"))


ENTITIES = [("licence", ["licensed", "license"]), ("mail", ["@mail"]), ("secret", ["password=", "api_key"]), ("article", ["the "])]


@query(
    """WITH d(entity, word) AS (VALUES ('licence', 'licensed'), ('licence', 'license'), ('mail', '@mail'), ('secret', 'password='), ('secret', 'api_key'), ('article', 'the '))
SELECT DISTINCT doc_id, entity FROM documents JOIN d ON contains(lower(text), word)"""
)
def entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of which any synonym is part of the text; the small dictionary is evaluated in the scan."""
    found = [F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower("text"), w)), F.lit(name)) for name, words in ENTITIES]
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_compact(F.array(*found))).alias("entity"))


@query("SELECT n_nationkey, CASE lower(trim(n_name)) WHEN 'nation_1' THEN 'one' WHEN 'nation_2' THEN 'two' ELSE n_name END AS canonical FROM nation")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synonym to canonical name; unknown names stay."""
    table_ = F.create_map(F.lit("nation_1"), F.lit("one"), F.lit("nation_2"), F.lit("two"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.coalesce(F.try_element_at(table_, F.lower(F.trim("n_name"))), "n_name").alias("canonical"))


@query(
    """SELECT d.doc_id, coalesce(nullif(trim(CASE l.quality WHEN 1 THEN d.lang WHEN 0 THEN ' ' END), ''), nullif(trim(CASE
WHEN d.n_chars > 2000 THEN d.source END), ''), 'base') AS organisation,
CASE WHEN trim(CASE l.quality WHEN 1 THEN d.lang WHEN 0 THEN ' ' END) <> '' THEN 'final' WHEN d.n_chars > 2000 THEN 'ocr' ELSE 'base' END AS provenance FROM documents d
LEFT JOIN labels l ON l.doc_id = d.doc_id"""
)
def metadata_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First of final, recognised and base value that is not blank, and where it came from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    final, ocr, base = F.when(F.col("quality") == 1, F.col("lang")).when(F.col("quality") == 0, " "), F.when(F.col("n_chars") > 2000, F.col("source")), F.lit("base")
    return docs.select("doc_id", T.first_filled(final, ocr, base).alias("organisation"), T.fallback_source(final=final, ocr=ocr, base=base).alias("provenance"))


@query(
    "SELECT page_id, sha1('web:' || url) AS uid, CASE WHEN len(regexp_extract_all(lower(url), '[a-z0-9]+')) > 0 THEN array_to_string(regexp_extract_all(lower(url), '[a-z0-9]+'), '-') || '-' ELSE '-' END || left(md5(url), 8) AS slug FROM pages"
)
def doc_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.document_uid(F.lit("web"), F.col("url")).alias("uid"), T.slug(F.col("url")).alias("slug"))


@query("""SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS root, coalesce(CASE split_part(split_part(url, '://', 2), '/', 2) WHEN 'en' THEN 'english'
WHEN 'fr' THEN 'french' END, split_part(split_part(url, '://', 2), '/', 2)) AS category FROM pages""")
def path_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First folder to a category through a small map, else itself."""
    parts = F.split(F.element_at(F.split("url", "://"), 2), "/")
    names = F.create_map(F.lit("en"), F.lit("english"), F.lit("fr"), F.lit("french"))
    return table(spark, sf_dir, "pages").select("page_id", F.element_at(parts, 1).alias("root"), F.coalesce(F.try_element_at(names, F.element_at(parts, 2)), F.element_at(parts, 2)).alias("category"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
h AS (SELECT *, regexp_matches(trim(line), '^Licensed.*|^This work is.*') AS hd FROM l), s AS (SELECT *, sum(CAST(hd AS INTEGER)) OVER (PARTITION BY doc_id
ORDER BY n) AS section_no FROM h)
SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, max(CASE WHEN hd THEN trim(line) END) AS title, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars
FROM s GROUP BY doc_id, section_no"""
)
def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License lines act as headings here, because the texts have no numbered ones."""
    return C.sections(table(spark, sf_dir, "documents"), "doc_id", "text", "^Licensed.*|^This work is.*")


@query(
    f"""WITH t AS (SELECT doc_id, {_SQ} AS t FROM documents), c AS (SELECT doc_id, t, unnest(generate_series(0, greatest(length(t) - 301, 0), 700)) AS start FROM t WHERE t <> '')
SELECT doc_id, CAST(start // 700 AS INTEGER) AS chunk_index, CAST(start AS INTEGER) AS start,
CAST(least(start + 1000, length(t)) AS INTEGER) AS stop, doc_id || '-chunk-' || lpad(CAST(start // 700 AS VARCHAR), 4, '0') AS chunk_id, md5(substr(t, start + 1, least(start + 1000, length(t)) - start)) AS digest FROM c"""
)
def window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = C.window_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 1000, 300)
    return made.select("doc_id", "chunk_index", "start", "stop", "chunk_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    f"""WITH t AS (SELECT doc_id, length({_SQ}) AS n FROM documents), c AS (SELECT doc_id, n, unnest(generate_series(0, greatest(n - 301, 0), 700)) AS start FROM t WHERE n > 0),
p AS (SELECT doc_id, unnest(generate_series(0, n - 1, 1500)) AS ps, n FROM t WHERE n > 0),
x AS (SELECT c.doc_id, start, ps, (start + least(start + 1000, c.n)) / 2 AS mid, least(ps + 1500, p.n) AS pe FROM c JOIN p ON p.doc_id = c.doc_id),
g AS (SELECT *, CASE WHEN mid >= ps AND mid < pe THEN 0 ELSE least(abs(mid - ps), abs(mid - pe)) END AS gap FROM x)
SELECT doc_id, CAST(start // 700 AS INTEGER) AS chunk_index, arg_min(CAST(ps // 1500 + 1 AS BIGINT), struct_pack(a := gap, b := ps)) AS page_no FROM g
GROUP BY doc_id, start"""
)
def page_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    length = docs.select("doc_id", F.length(T.squeeze(F.col("text"))).alias("n")).filter("n > 0")
    spans = length.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(1500))).alias("page_start"))
    spans = spans.select("doc_id", "page_start", F.least(F.col("page_start") + 1500, F.col("n")).alias("page_stop"), (F.floor(F.col("page_start") / 1500) + 1).alias("page_no"))
    chunks = C.window_chunks(docs, "doc_id", "text", 1000, 300).select("doc_id", "chunk_index", "start", "stop")
    return C.chunk_pages(chunks, spans, "doc_id")


@query()
def packed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence packing has no SQL form; rows only here, goldens in the tests."""
    return C.packed_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
