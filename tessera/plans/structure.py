"""Contents trees, covers, slide sections, page-bound chunks, word stems, fields and search scopes over the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import fields, outline, scopes, vectors, wordforms
from ..operators.tables import shared_folder
from .registry import query, table

# ---- contents: a document's lines, numbered by their place, stand for a contents page

_FORMS = ["I.", "1-1", "1.1.1.", "2.3", "no"]
_BARE = "trim(left(regexp_replace({0}, '[^A-Za-z ]', ' ', 'g'), 30))"
_MADE = f"""made AS (SELECT doc_id, i - 1 AS line_no, CASE (i - 1) % 5 WHEN 0 THEN 'I. ' WHEN 1 THEN '1-1 ' WHEN 2 THEN '  1.1.1. '
WHEN 3 THEN '2.3 ' ELSE '' END || {_BARE.format('x')} || CASE WHEN (i - 1) % 3 <> 0 THEN ' .... ' || (i + 1) ELSE '' END AS line
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"""
_TITLE = "[ \\t]*([^\\n]*?[^ \\t.·…0-9][^\\n]*?)[ \\t.·…]*(?:[ \\t.·…]([0-9]{1,4}))?[ \\t]*$"
_CASES = [(f"^[ \\t]*{form}", level) for form, level in outline.NUMBERED]
_LEVEL = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}[ \\t]+[^ \\t]') THEN {level}" for p, level in _CASES) + " END"
_PART = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}[ \\t]+[^ \\t]') THEN regexp_extract(line, '{p}{_TITLE}', GROUP_NO)" for p, _ in _CASES) + " END"
_ENTRIES = f"""{_MADE}, e0 AS (SELECT doc_id, line_no, {_LEVEL} AS level, {_PART.replace('GROUP_NO', '1')} AS title, nullif({_PART.replace('GROUP_NO', '2')}, '') AS page FROM made),
e AS (SELECT doc_id, line_no, level, title, CAST(page AS INTEGER) AS page FROM e0 WHERE level IS NOT NULL AND title <> '')"""


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, body``: contents pages."""
    forms = F.array(*[F.lit(x) for x in ("I. ", "1-1 ", "  1.1.1. ", "2.3 ", "")])
    bare = lambda x: F.trim(F.left(F.regexp_replace(x, "[^A-Za-z ]", " "), F.lit(30)))
    page = lambda i: F.when(i % 3 != 0, F.concat(F.lit(" .... "), (i + 2).cast("string"))).otherwise("")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.element_at(forms, i % 5 + 1), bare(x), page(i)))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("body"))


@query(
    f"""WITH RECURSIVE {_ENTRIES}, p AS (SELECT e.*, (SELECT max(x.line_no) FROM e x WHERE x.doc_id = e.doc_id AND x.line_no < e.line_no AND x.level < e.level) AS parent_no,
coalesce(page, (SELECT arg_min(x.page, x.line_no) FROM e x WHERE x.doc_id = e.doc_id AND x.line_no > e.line_no AND x.page IS NOT NULL)) AS own FROM e),
t AS (SELECT doc_id, line_no, title AS path FROM p WHERE parent_no IS NULL UNION ALL SELECT p.doc_id, p.line_no, t.path || ' > ' || p.title FROM p
JOIN t ON t.doc_id = p.doc_id AND t.line_no = p.parent_no),
n AS (SELECT p.*, (SELECT min(x.line_no) FROM p x WHERE x.doc_id = p.doc_id AND x.line_no > p.line_no AND x.level <= p.level) AS next_no FROM p)
SELECT n.doc_id, CAST(n.line_no AS INTEGER) AS line_no, n.level, n.title, CAST(n.parent_no AS INTEGER) AS parent_no, t.path, n.own AS page, CAST(CASE
WHEN n.next_no IS NULL THEN 900 ELSE greatest(n.own, f.own - 1) END AS INTEGER) AS page_end
FROM n JOIN t ON t.doc_id = n.doc_id AND t.line_no = n.line_no LEFT JOIN p f ON f.doc_id = n.doc_id AND f.line_no = n.next_no"""
)
def contents_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents pages as trees of sections with page spans."""
    entries = outline.contents_lines(contents(spark, sf_dir), "doc_id", "body")
    return outline.section_tree(entries, "doc_id", F.lit(900))


@query(
    f"""WITH {_ENTRIES}, c AS (SELECT doc_id, count(*) AS sections, count(DISTINCT title) AS titles,
len(list_distinct(flatten(list(regexp_extract_all(title, '[가-힣A-Za-z]{{2,}}'))))) AS words FROM e GROUP BY doc_id)
SELECT doc_id, sections, titles, words, CAST(round(CASE WHEN sections >= 5 THEN 0.5 ELSE 0 END + CASE WHEN titles >= 3 THEN 0.3 ELSE 0 END + CASE
WHEN words >= 5 THEN 0.2 ELSE 0 END, 2) AS DOUBLE) AS confidence FROM c"""
)
def contents_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.contents_confidence(outline.contents_lines(contents(spark, sf_dir), "doc_id", "body"), "doc_id")


# ---- covers

_COVER = """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Title: Report on ' || source || chr(10) ELSE '' END || CASE
WHEN doc_id % 4 = 0 THEN 'Issuer: House of ' || lang || chr(10) ELSE '' END || CASE
WHEN doc_id % 5 = 0 THEN '2024-' || (doc_id % 12 + 1) || '-01' || chr(10) ELSE '' END || text AS t FROM documents"""
TITLES, ISSUERS, SUBJECTS, KINDS = ["(?m)^Title: ([^\\n]+)$"], ["(?m)^Issuer: ([^\\n]+)$"], ["([A-Z][a-z]{5,} [a-z]+tion)"], ["Report", "Plan"]


def covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    lines = [
        F.when(key % 3 == 0, F.concat(F.lit("Title: Report on "), "source", F.lit("\n"))),
        F.when(key % 4 == 0, F.concat(F.lit("Issuer: House of "), "lang", F.lit("\n"))),
        F.when(key % 5 == 0, F.concat(F.lit("2024-"), (key % 12 + 1).cast("string"), F.lit("-01\n")))
    ]
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(*[F.coalesce(x, F.lit("")) for x in lines], "text").alias("t"))


@query(
    f"""WITH c AS (SELECT doc_id, left(t, 2000) AS t FROM ({_COVER})), f AS (SELECT doc_id,
coalesce(nullif(trim(regexp_extract(t, '{TITLES[0]}', 1)), ''), nullif(trim(regexp_extract(t, '(?m)^[ \\t]*([^ \\t\\n][^\\n]*)$', 1)), '')) AS title, nullif(trim(regexp_extract(t, '{ISSUERS[0]}', 1)), '') AS organisation,
nullif(trim(regexp_extract(t, '{SUBJECTS[0]}', 1)), '') AS subject, CASE WHEN contains(t, 'Report') THEN 'Report' WHEN contains(t, 'Plan') THEN 'Plan' END AS kind,
nullif(regexp_extract(t, '(20[23][0-9])(?:년 *|[.] *|-)([0-9]{{1,2}})(?:월|[.]|-)', 1), '') AS y, nullif(regexp_extract(t, '(20[23][0-9])(?:년 *|[.] *|-)([0-9]{{1,2}})(?:월|[.]|-)', 2), '') AS m FROM c),
g AS (SELECT doc_id, title, organisation, coalesce(subject, nullif(trim(regexp_replace(title, '\\bReport\\b|\\bPlan\\b', '', 'g')), '')) AS project, y || '-' || lpad(m, 2, '0') AS date, kind FROM f)
SELECT *, CAST(round(CASE WHEN title IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN organisation IS NOT NULL THEN 0.25 ELSE 0 END + CASE
WHEN project IS NOT NULL THEN 0.2 ELSE 0 END + CASE WHEN date IS NOT NULL THEN 0.15 ELSE 0 END + CASE
WHEN kind IS NOT NULL THEN 0.1 ELSE 0 END, 2) AS DOUBLE) AS confidence FROM g"""
)
def cover_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = outline.cover(F.col("t"), TITLES, ISSUERS, SUBJECTS, KINDS)
    return covers(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in found.items()])


ALIASES = {"nation": ["tion", "ción"], "eating": ["eaux", "ing"], "being": ["sein", "keit"]}


@query(
    """WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages),
p AS (SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(title, '\\([0-9]+/[0-9]+\\)', '', 'g'), '^[ 0-9IVXⅠⅡⅢⅣⅤ]+[.]*[ 0-9.]*', '', 'g'), '[^0-9A-Za-zÀ-ÖØ-öø-ÿ가-힣]', '', 'g')) AS t FROM t)
SELECT page_id, CASE WHEN contains(t, 'nation') OR contains(t, 'tion') OR contains(t, 'ción') THEN 'nation' WHEN contains(t, 'eating') OR contains(t, 'eaux')
OR contains(t, 'ing') THEN 'eating' WHEN contains(t, 'being') OR contains(t, 'sein') OR contains(t, 'keit') THEN 'being' END AS section FROM p"""
)
def canonical_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", outline.canonical_section(title, ALIASES).alias("section"))


@query(
    """WITH s AS (SELECT conv_id, role, turn, regexp_extract_all(lower(text), '[0-9a-z가-힣_]+') AS w FROM conversations), g AS (SELECT *, turn -
row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS run FROM s),
r AS (SELECT conv_id, role, min(turn) AS a, max(turn) AS b, count(*) AS c FROM g GROUP BY conv_id, role, run), k AS (SELECT conv_id, role, min(a) AS first,
max(b) AS last, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '~' || b END, ', ' ORDER BY a) AS ranges, CAST(sum(c) AS BIGINT) AS n FROM r GROUP BY ALL),
tf AS (SELECT conv_id, role, word, count(*) AS tf FROM (SELECT conv_id, role, unnest(w) AS word FROM s) GROUP BY ALL), df AS (SELECT conv_id, word, count(*) AS df FROM tf
GROUP BY ALL), z AS (SELECT conv_id, count(*) AS sections FROM k GROUP BY conv_id),
v AS (SELECT conv_id, role, word, round(tf * ln(sections / df), 9) AS w FROM tf JOIN df USING (conv_id, word) JOIN z USING (conv_id) WHERE sections > df), b AS (SELECT *,
row_number() OVER (PARTITION BY conv_id, role ORDER BY w DESC, word) AS p FROM v),
t AS (SELECT conv_id, role, string_agg(word, ' ' ORDER BY p) AS keywords FROM b WHERE p <= 5 GROUP BY ALL) SELECT k.conv_id, k.role, first, last, ranges, n,
coalesce(keywords, '') AS keywords FROM k LEFT JOIN t ON t.conv_id = k.conv_id AND t.role = k.role"""
)
def slide_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as decks: each role's turns as merged ranges, with the words that set it apart."""
    return outline.slide_outline(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", tokens(F.col("text")))


# ---- chunks within pages: the halves of a text are its pages

_UNITS = "(?s)(?:.{0,998}?(?:\\n|[.!?。] )|.{1,1000}?\\z|.{1000})"
_CHUNKS = f"""pages AS (SELECT doc_id, 1 AS page, left(text, length(text) // 2) AS t FROM documents UNION ALL SELECT doc_id, 2, substr(text, length(text) // 2 + 1) FROM documents),
u AS (SELECT doc_id, page, list_filter(regexp_extract_all(t, '{_UNITS}'), lambda x: x <> '') AS u FROM pages),
x AS (SELECT doc_id, page, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM u),
p AS (SELECT doc_id, page, x, i, sum(length(x)) OVER (PARTITION BY doc_id, page ORDER BY i) AS q FROM x), r AS (SELECT doc_id, page, list(x ORDER BY i) AS u,
list_prepend(0, list(CAST(q AS BIGINT) ORDER BY i)) AS q FROM p GROUP BY doc_id, page),
c AS (SELECT doc_id, page, u, q, 0 AS no, 0 AS s, len(list_filter(q, lambda x: x <= 1000)) - 1 AS e FROM r UNION ALL
SELECT doc_id, page, u, q, no + 1, n, len(list_filter(q, lambda x: x <= q[n + 1] + 1000)) - 1 FROM (SELECT *,
list_min(list_filter(range(s + 1, e + 1), lambda t: q[e + 1] - q[t + 1] <= 300 AND q[e + 2] - q[t + 1] <= 1000)) AS n FROM c WHERE e < len(u)))"""


@query(f"""WITH RECURSIVE {_CHUNKS} SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(no AS INTEGER) AS chunk_no,
CAST(q[s + 1] AS INTEGER) AS start, md5(array_to_string(u[s + 1:e], '')) AS digest FROM c""")
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 1000 characters with 300 carried over, within the halves of each text."""
    docs, half = table(spark, sf_dir, "documents"), F.floor(F.length("text") / 2).cast("int")
    pages = docs.select("doc_id", F.lit(1).alias("page"), F.left("text", half).alias("t")).unionByName(docs.select("doc_id", F.lit(2).alias("page"), F.substr(F.col("text"), half + 1).alias("t")))
    return outline.page_chunks(pages, "doc_id", "page", "t").select("doc_id", "page", "chunk_no", "start", F.md5(F.col("text").cast("binary")).alias("digest"))


# ---- word stems

_STEMS = """f AS (SELECT form, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]+')) AS form FROM benchmark) GROUP BY form),
x AS (SELECT form, n, unnest(range(1, least(length(form), 20) + 1)) AS k FROM f), fo AS (SELECT left(form, k) AS start, CASE WHEN k < length(form) THEN substr(form,
CAST(k + 1 AS INTEGER), 1) ELSE '$' END AS follows, sum(n) AS c FROM x GROUP BY ALL),
s AS (SELECT start, sum(c) AS n, count(*) AS kinds, sum(c * ln(c)) AS z FROM fo GROUP BY start), one AS (SELECT start AS f, n AS fn FROM s WHERE length(start) = 1),
b AS (SELECT start, round(CASE WHEN length(start) > 1 THEN pow(n / fn, 1 / (length(start) - 1)) ELSE 0 END, 9) AS cohesion,
round(greatest(ln(n) - z / n, 0), 9) AS entropy FROM s JOIN one ON f = left(start, 1) WHERE kinds >= 2 AND length(start) >= 2),
q AS (SELECT form, left(form, k) AS stem, round(cohesion * entropy, 9) AS score, row_number() OVER (PARTITION BY form ORDER BY
round(cohesion * entropy, 9) DESC, k DESC) AS r FROM x JOIN b ON b.start = left(form, k)),
st AS (SELECT f.form, f.n, coalesce(stem, f.form) AS stem, coalesce(score, 0) AS score FROM f LEFT JOIN q ON q.form = f.form AND r = 1)"""


@query(f"WITH {_STEMS} SELECT form, n, stem, round(CAST(score AS DOUBLE), 6) AS score FROM st")
def word_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stem of each word form of the benchmark passages, from how their beginnings go on."""
    found = wordforms.stems(wordforms.forms(table(spark, sf_dir, "benchmark"), "text", "[A-Za-zÀ-ÖØ-öø-ÿ]+"))
    return found.select("form", "n", "stem", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_STEMS}, w AS (SELECT item_id, unnest(l) AS form, generate_subscripts(l, 1) AS place FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]+') AS l
FROM benchmark)), p AS (SELECT item_id, place, w.form, stem FROM w JOIN st USING (form)),
k AS (SELECT item_id, stem AS keyword FROM p UNION ALL SELECT a.item_id, a.stem || ' ' || b.stem FROM p a JOIN p b ON b.item_id = a.item_id AND b.place = a.place + 1
WHERE a.form = a.stem), c AS (SELECT item_id, keyword, count(*) AS n FROM k GROUP BY ALL)
SELECT item_id, keyword, n FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, keyword) AS r FROM c) WHERE r <= 10"""
)
def stem_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent stems and compounds of each benchmark passage."""
    return wordforms.keywords(table(spark, sf_dir, "benchmark"), "item_id", "text", "[A-Za-zÀ-ÖØ-öø-ÿ]+").withColumnRenamed("id", "item_id")


# ---- fields

_ISSUED = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Issuer: ' || source || ' House' || chr(10) WHEN 1 THEN 'Issuer (' || source || ' Trust)' || chr(10) ELSE '' END || text AS t
FROM documents"""
_NAMES = "[A-Z][a-z]+(?:ing|tion|ment|ed)"


@query(
    f"""WITH d AS ({_ISSUED}), s AS (SELECT doc_id, t, coalesce(nullif(trim(regexp_extract(t, '(?m)(?:^|[ \\t])(?:Issuer|Owner)[ \\t]*\\([ \\t]*([^)\\n]+?)[ \\t]*\\)', 1)), ''), nullif(trim(regexp_extract(t, '(?m)(?:^|[ \\t])(?:Issuer|Owner)[ \\t]*[:：][ \\t]*([^\\n\\r]+)$', 1)), '')) AS said0 FROM d),
l AS (SELECT doc_id, t, CASE WHEN length(said0) BETWEEN 2 AND 80 THEN said0 END AS said FROM s), c AS (SELECT doc_id, name, count(*) AS n
FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{_NAMES}')) AS name FROM l WHERE said IS NULL) GROUP BY ALL),
a AS (SELECT name, count(*) > 0.5 * (SELECT count(*) FROM documents) AS common FROM c GROUP BY name), v AS (SELECT doc_id, name, n,
round(least(0.6 + (n - 1) * 0.03, 0.95) - CASE WHEN common THEN 0.2 ELSE 0 END, 6) AS confidence FROM c JOIN a USING (name)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, n DESC, length(name) DESC, name) AS r FROM v WHERE confidence >= 0.5)
SELECT doc_id, said AS organisation, CAST(0.9 AS DOUBLE) AS confidence FROM l WHERE said IS NOT NULL UNION ALL SELECT doc_id, name, CAST(confidence AS DOUBLE) FROM b
WHERE r = 1"""
)
def organisation_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's organisation by label, else its best candidate with the corpus's counts against it."""
    key = F.col("doc_id")
    lead = F.when(key % 4 == 0, F.concat(F.lit("Issuer: "), "source", F.lit(" House\n"))).when(key % 4 == 1, F.concat(F.lit("Issuer ("), "source", F.lit(" Trust)\n"))).otherwise("")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(lead, "text").alias("t"))
    return fields.organisations(docs, "doc_id", "t", ["Issuer", "Owner"], _NAMES).withColumnRenamed("id", "doc_id")


@query(
    f"""WITH d AS (SELECT doc_id, t, CASE WHEN length(s) BETWEEN 5 AND 100 THEN s END AS said
FROM (SELECT doc_id, t, nullif(trim(regexp_extract(t, '(?m)(?:^|[ \\t])(?:Title)[ \\t]*[:：][ \\t]*([^\\n\\r]+)$', 1)), '') AS s FROM ({_COVER}))),
p AS (SELECT d.doc_id, said, nullif(trim(regexp_extract(t, '([A-Z][a-z]{{7,}} [a-z]+ment)', 1)), '') AS pat, nullif(trim(regexp_replace(source || '_2024_final', '_2024|_final', ' ', 'g')), '') AS f FROM d JOIN documents USING (doc_id))
SELECT doc_id, coalesce(said, pat, f) AS project, CAST(CASE WHEN said IS NOT NULL THEN 0.88 WHEN pat IS NOT NULL THEN 0.6 ELSE 0.75 END AS DOUBLE) AS confidence FROM p"""
)
def project_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, sure = fields.project(F.col("t"), F.concat("source", F.lit("_2024_final.docx")), ["Title"], "[A-Z][a-z]{7,} [a-z]+ment", "_2024|_final")
    return covers(spark, sf_dir).select("doc_id", name.alias("project"), sure.alias("confidence"))


@query(
    f"""WITH d AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')[1:20] AS l FROM ({_COVER})), f AS (SELECT doc_id,
coalesce(list_filter(l, lambda x: regexp_matches(x, '20[0-3][0-9]'))[1], '') AS x FROM d)
SELECT doc_id, CAST(nullif(regexp_extract(x, '(20[0-3][0-9])', 1), '') AS INTEGER) AS year,
CAST(nullif(regexp_extract(x, '20[0-3][0-9](?:년|[.-])[ ]*(0?[1-9]|1[0-2])(?:[^0-9]|$)', 1), '') AS INTEGER) AS month FROM f"""
)
def dated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    year, month = fields.dated(F.col("t"))
    return covers(spark, sf_dir).select("doc_id", year.alias("year"), month.alias("month"))


# ---- scopes: an embedding's label is its snapshot, label / 3 the source

PROFILES = {"pair": [("s2", None), (None, "b1"), ("gone", None)], "empty": [("gone", None)]}
WANTED = ["active_snapshot", "all_sources", "source:b2", "pair", "empty", "unknown"]
_SCOPED = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT e FROM v WHERE vec_id = 0),
c AS (SELECT DISTINCT label, 's' || label AS snapshot, 'b' || label // 3 AS source, label % 5 <> 2 AS queryable, label = 4 AS active FROM v),
l AS (SELECT source, arg_max(snapshot, label) AS snapshot FROM c WHERE queryable GROUP BY source),
m AS (SELECT 'active_snapshot' AS scope, snapshot FROM c WHERE active UNION ALL SELECT 'all_sources', snapshot FROM l UNION ALL SELECT 'source:' || source, snapshot
FROM l UNION ALL SELECT 'pair', snapshot FROM c WHERE snapshot = 's2' UNION ALL SELECT 'pair', snapshot FROM l WHERE source = 'b1'),
w AS (SELECT unnest(['active_snapshot', 'all_sources', 'source:b2', 'pair', 'empty', 'unknown']) AS wanted), r AS (SELECT wanted, CASE WHEN wanted IN (SELECT scope
FROM m) THEN wanted ELSE 'active_snapshot' END AS scope FROM w),
s AS (SELECT DISTINCT wanted, scope, snapshot FROM r JOIN m USING (scope)), h AS (SELECT wanted, scope, vec_id, round(list_cosine_similarity(v.e, q.e), 6) AS score FROM s
JOIN v ON 's' || v.label = s.snapshot, q)"""


@query(f"{_SCOPED} SELECT wanted, scope, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY score DESC, vec_id) AS r FROM h) WHERE r <= 5")
def scoped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors nearest to the first one, in each of some scopes; only the scope's folders are read."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label")
    catalogue = rows.select("label").distinct().select(
        F.concat(F.lit("s"), label).alias("snapshot"), F.concat(F.lit("b"), F.floor(label / 3)).alias("source"), (label % 5 != 2).alias("queryable"),
        (label == 4).alias("active"), label.alias("made_at")
    )
    path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    scopes.write_vectors(rows.select("vec_id", "embedding", F.concat(F.lit("s"), label).alias("snapshot")), path)
    own = rows.filter("vec_id = 0").select(F.col("embedding").alias("query_vector"))
    found = None
    for wanted in WANTED:
        scope = scopes.resolve(catalogue, wanted, PROFILES)
        hits = vectors.scored(scopes.scoped(spark, path, scope), own).select("vec_id", F.round("score", 6).alias("score"))
        name = scope.select("scope").distinct()
        best = hits.orderBy(F.desc("score"), "vec_id").limit(5).join(F.broadcast(name), F.lit(True)).select(F.lit(wanted).alias("wanted"), "scope", "vec_id", "score")  # one row is broadcast
        found = best if found is None else found.unionByName(best)
    return found
