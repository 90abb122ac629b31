"""Vector, full-text and hybrid search over ``embeddings`` and ``documents``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fulltext, ranking, vectors
from ..operators.tables import shared_folder
from .registry import query, table

_SCORED = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT v.vec_id, v.label, list_cosine_similarity(v.e, q.e) AS score FROM v, (SELECT e FROM v WHERE vec_id = {0}) q)"""
SCORED = "WITH " + _SCORED.format(0)
TERMS = ["the", "ing", "of", "que"]


def scored(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    own = rows.filter(F.col("vec_id") == vec_id).select(F.col("embedding").alias("query_vector"))
    return vectors.scored(rows, own).select("vec_id", "label", "score")


@query(f"{SCORED} SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 50")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(scored(spark, sf_dir), 50, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(f"{SCORED} SELECT vec_id, round(score, 6) AS score FROM s WHERE score >= 0.2 ORDER BY s.score DESC, vec_id LIMIT 50")
def vector_topk_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(scored(spark, sf_dir), 50, "vec_id", least=0.2).select("vec_id", F.round("score", 6).alias("score"))


@query(f"{SCORED} SELECT vec_id, round(score, 6) AS score FROM s WHERE label = 3 ORDER BY s.score DESC, vec_id LIMIT 10")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(scored(spark, sf_dir).filter("label = 3"), 10, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(f"{SCORED} SELECT vec_id, round(score, 6) AS score FROM (SELECT * FROM s ORDER BY s.score DESC, vec_id LIMIT 30) WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three times too many are fetched, then filtered, then cut."""
    return vectors.over_fetch(scored(spark, sf_dir), 10, 3, F.col("label") == 3, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(f"""{SCORED} SELECT vec_id, label, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS INTEGER) AS rank
FROM s) WHERE rank <= 3""")
def vector_topk_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k_per(scored(spark, sf_dir), 3, "label", "vec_id").select("vec_id", "label", F.round("score", 6).alias("score"), "rank")


@query(f"""{SCORED}, p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS n FROM s WHERE label IN (1, 4, 7)) SELECT vec_id, round(score, 6) AS score
FROM p WHERE n <= 20 ORDER BY p.score DESC, vec_id LIMIT 20""")
def multi_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    parts = [vectors.top_k(rows.filter(F.col("label") == i), 20, "vec_id").select("vec_id", "score") for i in (1, 4, 7)]
    return vectors.merge_indexes(parts, 20, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


_HITS = f"""{SCORED}, top AS (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 50),
h AS (SELECT t.vec_id, t.score, d.source, d.lang, d.doc_id, row_number() OVER (PARTITION BY d.source ORDER BY t.score DESC, t.vec_id) AS n FROM top t LEFT
JOIN documents d ON d.doc_id = t.vec_id),
a AS (SELECT source, max(score) AS best, sum(score) AS total, count(*) AS hits, arg_min(vec_id, struct_pack(a := -score, b := vec_id)) AS top_id FROM h WHERE n <= 5
GROUP BY source),
r AS (SELECT *, 5 * best + 0.15 * least(hits, 5) AS ranking FROM a)"""


def all_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top 50 vectors with their documents."""
    top = vectors.top_k(scored(spark, sf_dir), 50, "vec_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return top.join(docs.join(F.broadcast(top.select(F.col("vec_id").alias("doc_id"))), "doc_id", "left_semi"), docs.doc_id == top.vec_id, "left")  # fifty rows; hits of unknown documents stay


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of these the five best of each source."""
    return vectors.cap_per_group(all_hits(spark, sf_dir), 5, "source", [F.desc("score"), "vec_id"])


@query(f"""{_HITS} SELECT source, round(best, 6) AS best, round(total, 6) AS total, hits, top_id, round(ranking, 6) AS ranking_score,
row_number() OVER (ORDER BY ranking DESC, best DESC, hits DESC, source) AS rank FROM r""")
def hit_doc_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 50 vectors, joined to documents, at most five per source, aggregated, scored and ranked."""
    rows = ranking.with_rank(ranking.aggregate_hits(hits(spark, sf_dir), "source"), F.desc("ranking_score"), F.desc("best"), F.desc("hits"), "source")
    return rows.select("source", F.round("best", 6).alias("best"), F.round("total", 6).alias("total"), "hits", "top_id", F.round("ranking_score", 6).alias("ranking_score"), "rank")


@query(f"{_HITS} SELECT source, vec_id, round(score, 6) AS score FROM h WHERE n = 1 ORDER BY h.score DESC, vec_id LIMIT 10")
def one_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hit of each group, cut to ten."""
    first = vectors.cap_per_group(hits(spark, sf_dir), 1, "source", [F.desc("score"), "vec_id"])
    return vectors.top_k(first, 10, "vec_id").select("source", "vec_id", F.round("score", 6).alias("score"))


_KEYS = " + ".join(f"CASE WHEN contains(t, '{w}') THEN 1 ELSE 0 END" for w in TERMS)


@query(
    f"""{_HITS}, x AS (SELECT h.*, lower(d.text) AS t FROM h JOIN documents d ON d.doc_id = h.doc_id),
k AS (SELECT doc_id, 5 * score + least(({_KEYS}) * 0.3, 5.0) + CASE lang WHEN 'en' THEN 3.0 WHEN 'fr' THEN 2.0 ELSE 0.5 END + least(0.5 * CASE
WHEN source = 'src1' THEN 1 ELSE 0 END, 2.0) AS z FROM x)
SELECT doc_id, round(z, 4) AS rerank_score, row_number() OVER (ORDER BY round(z, 9) DESC, doc_id) AS rank FROM k"""
)
def rerank_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t"))
    rows = body.join(F.broadcast(all_hits(spark, sf_dir)), "doc_id")  # at most fifty rows, whatever their sources
    found = sum((F.when(F.contains("t", F.lit(w)), 1).otherwise(0) for w in TERMS), F.lit(0))
    weight = F.when(F.col("lang") == "en", 3.0).when(F.col("lang") == "fr", 2.0).otherwise(0.5)
    scored_rows = ranking.rerank(rows, 5 * F.col("score"), found, weight, F.when(F.col("source") == "src1", 1).otherwise(0))
    ranked = ranking.with_rank(scored_rows, F.round(F.col("rerank_score"), 9).desc(), "doc_id")
    return ranked.select("doc_id", F.round("rerank_score", 4).alias("rerank_score"), "rank")


_TWO = f"""WITH {_SCORED.format(0)}, {_SCORED.format(1).replace('v AS', 'v2 AS', 1).replace('s AS (SELECT v.', 's2 AS (SELECT v.', 1)},
a AS (SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 20), b AS (SELECT vec_id, score FROM s2 ORDER BY score DESC, vec_id LIMIT 20)"""


def two_lists(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [vectors.top_k(scored(spark, sf_dir, i), 20, "vec_id").select("vec_id", "score") for i in (0, 1)]


@query(
    f"""{_TWO}, m AS (SELECT coalesce(a.vec_id, b.vec_id) AS vec_id, a.score AS v, b.score AS g FROM a FULL JOIN b ON a.vec_id = b.vec_id)
SELECT vec_id, round(v, 6) AS vector_score, round(g, 6) AS graph_score, round(5 * greatest(coalesce(v, 0), coalesce(g, 0)) * CASE WHEN v IS NOT NULL
AND g IS NOT NULL THEN 1.2 ELSE 1 END
 + CASE WHEN v IS NOT NULL THEN 1.0 ELSE 1.5 END + CASE WHEN v > 0 AND g > 0 THEN 1.0 ELSE 0 END + CASE WHEN v IS NOT NULL
AND g IS NOT NULL THEN 0.3 ELSE 0 END, 6) AS merged_score FROM m"""
)
def hybrid_merge_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = ranking.hybrid_merge(*two_lists(spark, sf_dir), "vec_id")
    return merged.select("vec_id", *[F.round(c, 6).alias(c) for c in ("vector_score", "graph_score", "merged_score")])


@query(
    f"""{_TWO}, l AS (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS n, 0 AS part FROM a UNION ALL SELECT vec_id,
row_number() OVER (ORDER BY score DESC, vec_id), 1 FROM b),
f AS (SELECT vec_id, min(n * 2 + part) AS first_at FROM l GROUP BY vec_id) SELECT vec_id, row_number() OVER (ORDER BY first_at) AS rank FROM f"""
)
def hybrid_merge_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.interleave(*two_lists(spark, sf_dir), "vec_id")


_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z가-힣_]+')"
_TF = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(TERMS[:3]))
_DF = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(3))
_BM = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(3))


@query(
    f"""WITH w AS (SELECT doc_id, {_TOK} AS w FROM documents), c AS (SELECT doc_id, len(w) AS dl, {_TF} FROM w),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {_DF} FROM c) SELECT doc_id, round({_BM}, 6) AS score FROM c, st WHERE tf0 + tf1 + tf2 > 0"""
)
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.bm25(table(spark, sf_dir, "documents"), TERMS[:3]).select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY term, doc_id")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.inverted_index(table(spark, sf_dir, "documents"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id, terms``: the words of four letters and more of each benchmark passage."""
    words = F.filter(T.tokens(F.col("text")), lambda w: F.length(w) >= 4)
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(words).alias("terms"))


def stored_index(spark: SparkSession, docs: DataFrame) -> fulltext.Index:
    """The index of some documents, written once below the shared folder."""
    return fulltext.Index(spark, f"{shared_folder(spark)}/fulltext-{uuid.uuid4().hex}").add(docs)


_QUESTIONS = "q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[0-9a-z가-힣_]+')) AS term FROM benchmark) WHERE length(term) >= 4)"
_EXACT = f"""WITH {_QUESTIONS}, w AS (SELECT doc_id, {_TOK} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(w) AS term, len(w) AS dl FROM w) WHERE term IN (SELECT term FROM q)
GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT item_id, doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score FROM q JOIN p USING (term)
JOIN df USING (term), st GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)"""


@query(f"{_EXACT} SELECT item_id, rank, doc_id, round(score, 6) AS score FROM best WHERE rank <= 5")
def fts_blockmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents for each benchmark passage, from a stored index whose blocks are skipped by their highest impact."""
    found = stored_index(spark, table(spark, sf_dir, "documents")).search(questions(spark, sf_dir), "item_id", 5)
    return found.select(F.col("case").alias("item_id"), F.col("rank").cast("long").alias("rank"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(
    """SELECT doc_id, strpos(lower(text), 'the ') - 1 AS at, substr(text, greatest(strpos(lower(text), 'the ') - 30, 1), 60) AS snippet FROM documents
WHERE contains(lower(text), 'the ')"""
)
def fts_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("p", F.instr(F.lower("text"), "the ")).filter("p > 0")
    return docs.select("doc_id", (F.col("p") - 1).cast("long").alias("at"), F.substring(F.col("text"), F.greatest(F.col("p") - 30, F.lit(1)), F.lit(60)).alias("snippet"))


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_replace("html", "<[^>]*>", " ").alias("body"))


_TITLED = "WITH p AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_replace(html, '<[^>]*>', ' ', 'g') AS body FROM pages)"
_LEX = ["the", "of", "que"]
_INTER = "len(list_intersect(list_distinct(regexp_extract_all(lower({}), '[0-9a-z가-힣_]+')), ['the', 'of', 'que']))"


@query(
    f"""{_TITLED}, s AS (SELECT page_id, 2 * {_INTER.format('title')} + {_INTER.format('substr(body, 1, 4000)')} + CASE
WHEN contains(regexp_replace(lower(title), '[ \\t\\r\\n]+', '', 'g'), 'theofque') THEN 3 ELSE 0 END AS score FROM p)
SELECT page_id, CAST(score AS BIGINT) AS score FROM s WHERE score > 0"""
)
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = titled(spark, sf_dir).select("page_id", ranking.lexical_score(F.col("title"), F.col("body"), _LEX).cast("long").alias("score"))
    return rows.filter("score > 0")


@query(f"""{_TITLED}, s AS (SELECT page_id, url, CASE WHEN contains(lower(url), 'th') THEN 1.0 WHEN contains(lower(title), 'th') THEN 0.8
WHEN contains(lower(body), 'th') THEN 0.6 END AS score FROM p) SELECT page_id, CAST(score AS DOUBLE) AS score FROM s WHERE score IS NOT NULL
ORDER BY s.score DESC, page_id LIMIT 40""")
def three_level_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first level that matches counts: address, title, content."""
    has = lambda c: F.lower(F.col(c)).contains("th")
    rows = titled(spark, sf_dir).withColumn("score", F.when(has("url"), 1.0).when(has("title"), 0.8).when(has("body"), 0.6))
    return vectors.top_k(rows, 40, "page_id").select("page_id", "score")


@query("""SELECT conv_id, turn, CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'que') THEN 1 ELSE 0 END AS matches FROM conversations
WHERE contains(lower(text), 'the') OR contains(lower(text), 'que') ORDER BY matches DESC, conv_id, turn LIMIT 60""")
def slide_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with any keyword, by number of keywords, then position."""
    found = sum((F.when(F.contains(F.lower("text"), F.lit(w)), 1).otherwise(0) for w in ("the", "que")), F.lit(0))
    rows = table(spark, sf_dir, "conversations").withColumn("matches", found).filter("matches > 0")
    return rows.orderBy(F.desc("matches"), "conv_id", "turn").limit(60).select("conv_id", "turn", "matches")


@query("""SELECT conv_id, turn, strpos(lower(text), 'the') - 1 AS at, CASE
WHEN strpos(lower(text), 'the') > 0 THEN substr(text, greatest(strpos(lower(text), 'the') - 60, 1), least(strpos(lower(text), 'the') - 1, 60)) || '«' || substr(text, strpos(lower(text), 'the'), 3) || '»' || substr(text, strpos(lower(text), 'the') + 3, 60) ELSE '' END AS snippet FROM conversations""")
def highlight_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.highlight(F.col("text"), "the").alias("h"))
    return rows.select("conv_id", "turn", F.col("h.offset").alias("at"), F.col("h.snippet").alias("snippet"))


@query(
    f"""{SCORED}, a AS (SELECT vec_id FROM s ORDER BY score DESC, vec_id LIMIT 30), e AS (SELECT vec_id FROM embeddings WHERE label = (SELECT label FROM embeddings
WHERE vec_id = 0)),
n AS (SELECT (SELECT count(*) FROM a) AS ret, (SELECT count(*) FROM e) AS exp, (SELECT count(*) FROM a JOIN e USING (vec_id)) AS hit)
SELECT round(CASE WHEN ret > 0 AND exp > 0 THEN hit / ret ELSE 0 END, 6) AS precision_score, round(CASE WHEN ret > 0
AND exp > 0 THEN hit / exp ELSE 0 END, 6) AS recall_score FROM n"""
)
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the retrieved that were expected, and of the expected that were retrieved; 0 if either is empty."""
    rows = scored(spark, sf_dir)
    label = rows.filter("vec_id = 0").select(F.col("label").alias("wanted"))
    found = vectors.top_k(rows, 30, "vec_id").select("vec_id", F.lit(1).alias("got"))
    joined = rows.crossJoin(F.broadcast(label)).join(F.broadcast(found), "vec_id", "left")
    n = joined.agg(F.count("got").alias("ret"), F.count_if(F.col("label") == F.col("wanted")).alias("exp"), F.count_if(F.col("got").isNotNull() & (F.col("label") == F.col("wanted"))).alias("hit"))
    share = lambda c: F.when((F.col("ret") > 0) & (F.col("exp") > 0), F.col("hit") / F.col(c)).otherwise(0.0)
    return n.select(F.round(share("ret"), 6).alias("precision_score"), F.round(share("exp"), 6).alias("recall_score"))


@query(
    """WITH b AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[0-9a-z가-힣_]+'), lambda x: len(x) >= 2) AS ws FROM benchmark),
k AS (SELECT item_id, list_distinct(list_slice(ws, 1, 5)) AS words, list_distinct(list_slice(ws, 6, 20)) AS asked FROM b),
p AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-z가-힣_]+')) AS term FROM documents),
s AS (SELECT item_id, doc_id, count(*) AS n FROM (SELECT item_id, unnest(asked) AS term FROM k) q JOIN p USING (term) GROUP BY ALL),
r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) <= 3),
t AS (SELECT item_id, count(DISTINCT r.doc_id) AS docs, string_agg(lower(d.text), chr(10)) AS t FROM r JOIN documents d ON d.doc_id = r.doc_id GROUP BY item_id)
SELECT k.item_id, coalesce(docs, 0) AS n_docs, round(len(list_filter(words, lambda w: contains(coalesce(t, ''), w))) / greatest(len(words), 1), 6) AS kw_score,
 len(list_filter(words, lambda w: contains(coalesce(t, ''), w))) / greatest(len(words), 1) >= 0.5 AND coalesce(docs, 0) >= 2 AS passed FROM k LEFT
JOIN t ON t.item_id = k.item_id"""
)
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a case's expected keywords in the documents that its other words retrieve, and whether share and documents suffice."""
    docs, words = table(spark, sf_dir, "documents"), T.tokens(F.col("text"), 2)
    cases = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.slice(words, 1, 5)).alias("words"), F.array_distinct(F.slice(words, 6, 15)).alias("asked"))
    return ranking.keyword_scores(cases, docs, "item_id", "doc_id", "text", 3, 0.5, 2).select("item_id", "n_docs", F.round("kw_score", 6).alias("kw_score"), "passed")


@query(
    """WITH c AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS ev, max(CASE WHEN turn = 1 THEN text END) AS an FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, list_filter(string_split_regex(an, '[.!?\n]+'), lambda x: len(regexp_extract_all(lower(x), '[0-9a-z가-힣_]+')) > 0) AS ss,
list_distinct(regexp_extract_all(lower(ev), '[0-9a-z가-힣_]+')) AS kn FROM c WHERE an IS NOT NULL AND ev IS NOT NULL)
SELECT conv_id, round(CASE WHEN len(ss) > 0 THEN len(list_filter(ss, lambda x:
len(list_intersect(list_distinct(regexp_extract_all(lower(x), '[0-9a-z가-힣_]+')), kn)) >= 2)) / len(ss) ELSE 0 END, 6) AS grounded FROM s"""
)
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("ev"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("an"))
    return rows.filter("an IS NOT NULL AND ev IS NOT NULL").select("conv_id", F.round(T.grounded_share(F.col("an"), F.col("ev")), 6).alias("grounded"))


@query(
    """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-z가-힣_]+')) AS w FROM documents),
b AS (SELECT doc_id, CAST(('0x' || substr(sha1(w), 1, 8)) AS BIGINT) % 32 AS bucket, sum(CASE WHEN
CAST(('0x' || substr(sha1(w), 9, 2)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS s FROM t GROUP BY ALL)
SELECT doc_id, bucket, round(s / sqrt(sum(s * s) OVER (PARTITION BY doc_id)), 6) AS weight FROM b WHERE s <> 0"""
)
def hashing_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return vectors.hashing_embedding(T.tokens(F.col("text")), "doc_id", docs, 32).select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@query(f"""{SCORED} SELECT CASE WHEN score >= 0.85 THEN 'very_high' WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS label_text, count(*) AS n FROM s
GROUP BY 1""")
def similarity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy(T.similarity_label(F.col("score")).alias("label_text")).agg(F.count("*").alias("n"))
