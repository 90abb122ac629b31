"""Reconciliation, upserts, staleness and snapshots over slices of the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import builds
from ..operators import upkeep as U
from ..operators.tables import shared_folder
from ..streaming import append, build
from .registry import query, table

# The stored side of these examples lacks some rows and differs in others, by conditions on the tables' own columns.
_STORED = """stored AS (SELECT doc_id, n_chars + CASE WHEN lang = 'fr' THEN 1 ELSE 0 END AS size, CASE WHEN source = 'src2' THEN TIMESTAMP '2024-01-01 00:00:00' END AS removed_at
FROM documents WHERE source <> 'src1')"""
_LISTING = "listing AS (SELECT doc_id, n_chars AS size FROM documents WHERE source <> 'src3')"


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").filter("source <> 'src1'")
    return rows.select(
        "doc_id", (F.col("n_chars") + F.when(F.col("lang") == "fr", 1).otherwise(0)).alias("size"),
        F.when(F.col("source") == "src2", F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("removed_at")
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("source <> 'src3'").select("doc_id", F.col("n_chars").alias("size"))


@query(
    f"""WITH {_STORED}, {_LISTING}, j AS (SELECT coalesce(l.doc_id, s.doc_id) AS doc_id, CASE WHEN s.doc_id IS NULL THEN 'new' WHEN l.doc_id IS NULL
AND s.removed_at IS NULL THEN 'removed' WHEN l.doc_id IS NULL THEN 'still_removed'
WHEN s.removed_at IS NOT NULL THEN 'restored' WHEN l.size <> s.size THEN 'changed' ELSE 'unchanged' END AS action FROM listing l FULL
JOIN stored s ON s.doc_id = l.doc_id) SELECT doc_id, action FROM j"""
)
def source_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return U.reconcile(stored(spark, sf_dir), listing(spark, sf_dir), "doc_id", now).select("doc_id", "action")


@query(
    """WITH o AS (SELECT doc_id, n_chars AS size, lang AS mtime, CASE WHEN source = 'src1' THEN md5(text) END AS checksum FROM documents WHERE source <> 'src2'),
n AS (SELECT doc_id, n_chars + CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS size, CASE WHEN lang = 'es' THEN 'x' ELSE lang END AS mtime, CASE
WHEN lang = 'fr' THEN 'other' ELSE md5(text) END AS checksum FROM documents WHERE source <> 'src4')
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'removed' WHEN n.size <> o.size THEN 'changed'
WHEN n.checksum IS NOT NULL AND o.checksum IS NOT NULL THEN CASE WHEN n.checksum <> o.checksum THEN 'changed' ELSE 'unchanged' END
WHEN n.mtime <> o.mtime THEN 'maybe_changed' ELSE 'unchanged' END AS action
FROM n FULL JOIN o ON o.doc_id = n.doc_id"""
)
def change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("sum", F.md5(F.col("text").cast("binary")))
    old = docs.filter("source <> 'src2'").select("doc_id", F.col("n_chars").alias("size"), F.col("lang").alias("mtime"), F.when(F.col("source") == "src1", F.col("sum")).alias("checksum"))
    new = docs.filter("source <> 'src4'").select(
        "doc_id", (
            F.col("n_chars") + F.when(F.col("lang") == "de", 1).otherwise(0)
        ).alias("size"), F.when(F.col("lang") == "es", "x").otherwise(F.col("lang")).alias("mtime"), F.when(F.col("lang") == "fr", "other").otherwise(F.col("sum")).alias("checksum")
    )
    return U.change_actions(old, new, "doc_id")


@query("SELECT doc_id, 'old' AS version, n_chars FROM documents WHERE source <> 'src5' AND lang <> 'en' UNION ALL SELECT doc_id, 'new', n_chars FROM documents WHERE lang = 'en'")
def incremental_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    old = docs.filter("source <> 'src5'").select("doc_id", F.lit("old").alias("version"), "n_chars")
    return U.upsert(old, docs.filter("lang = 'en'").select("doc_id", F.lit("new").alias("version"), "n_chars"), "doc_id")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def event_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event, kept by two streams under different checkpoints, of which the second brings all rows, late ones too."""
    folder = f"{shared_folder(spark)}/upserts-{uuid.uuid4().hex}"
    kinds = table(spark, sf_dir, "events").schema
    # a pattern, as a stream takes a folder or a pattern but no single file
    stream = lambda: append.follow(spark, f"{sf_dir}/events.parque[t]", kinds).select("user_id", "ts", "event_id", "event_type", "value")
    users = append.Upserted(spark, f"{folder}/table", "user_id", "ts", buckets=8)
    rows = append.in_streams([stream().filter("event_id % 3 = 0"), stream()], users, f"{folder}/checkpoints")
    return rows.select("user_id", "event_id", "event_type", "value")


_BUILT = """v AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE left(text, CAST(length(text) // 2 AS INTEGER)) END AS t FROM documents WHERE doc_id % 10 <> 0),
c AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: x <> '') AS l FROM v)"""


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in chunks after three streams: the removal of every tenth, whole texts of every third, halves of all; the newest comes first."""
    folder = f"{shared_folder(spark)}/built-{uuid.uuid4().hex}"
    stream = append.follow(spark, f"{sf_dir}/documents.parque[t]", table(spark, sf_dir, "documents").schema)
    half = F.left("text", F.floor(F.length("text") / 2).cast("int"))
    state = lambda version, text, gone: ["doc_id", F.lit(version).alias("version"), text.alias("text"), F.lit(gone).alias("gone")]
    versions = [
        stream.filter("doc_id % 10 = 0").select(state(3, F.col("text"), True)),
        stream.filter("doc_id % 3 = 0").select(state(2, F.col("text"), False)),
        stream.select(state(1, half, False)),
    ]
    docs = append.Upserted(spark, f"{folder}/table", "doc_id", "version", buckets=8, gone="gone")
    lines = lambda text: F.filter(F.split(text, "\n"), lambda x: x != "")
    rows = [build.chunked(v, "doc_id", "text", "version", lines, lambda t: builds.stand_in_vector(t, 4), "gone") for v in versions]
    return append.in_streams(rows, docs, f"{folder}/checkpoints")


@query(
    f"""WITH {_BUILT} SELECT doc_id, CAST(len(l) AS BIGINT) AS chunks, CAST(coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS BIGINT) AS characters,
CASE WHEN len(l) > 0 THEN 4 ELSE 0 END AS dims FROM c"""
)
def incremental_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks each document has after an incremental build."""
    return build.manifest(built(spark, sf_dir), "doc_id")


@query(f"WITH {_BUILT} SELECT doc_id, doc_id || '-chunk-' || lpad(CAST(unnest(range(len(l))) AS VARCHAR), 4, '0') AS chunk_id, md5(unnest(l)) AS digest FROM c")
def incremental_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks themselves: a document that came again has only its new ones."""
    return build.chunk_rows(built(spark, sf_dir), "doc_id").select("doc_id", "chunk_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""SELECT CASE WHEN o.doc_id IS NULL THEN 'created' ELSE 'skipped' END AS action, count(*) AS n FROM documents d LEFT JOIN (SELECT doc_id FROM documents
WHERE lang = 'en') o ON o.doc_id = d.doc_id GROUP BY 1""")
def row_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return U.sync_actions(docs.filter("lang = 'en'"), docs, "doc_id", overwrite=False)


@query("""WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id) SELECT user_id, CASE WHEN last < (SELECT max(ts)
FROM events) - INTERVAL 600 MINUTE THEN 'interrupted' ELSE 'running' END AS state FROM l""")
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts")
    now = events.agg(F.max("ts").alias("now"))
    joined = events.crossJoin(F.broadcast(now))
    last = joined.groupBy("user_id").agg(F.max("ts").alias("last"), F.max("now").alias("now"))
    return last.select("user_id", F.when(F.col("last") < F.col("now") - F.expr("INTERVAL 600 MINUTES"), "interrupted").otherwise("running").alias("state"))


@query(
    """SELECT d.doc_id, coalesce(nullif(trim(CASE WHEN l.quality = 1 THEN d.lang END), ''), nullif(trim(d.source), ''), 'scan') AS final_org, 'reviewed' AS status
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
)
def review_approve(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = docs.select("doc_id", F.when(F.col("quality") == 1, F.col("lang")).alias("final_org"), F.col("source").alias("org"), F.lit("ocr").alias("ocr_org"), F.lit("scan").alias("scan_org"))
    return U.approve(rows, ["org"]).select("doc_id", "final_org", "status")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def drop_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.drop_orphans(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", "doc_id")


@query(
    "SELECT conv_id, turn, conv_id || '-chunk-' || lpad(CAST(turn AS VARCHAR), 4, '0') AS chunk_id, role || '_' || conv_id || '_' || lpad(CAST(turn AS VARCHAR), 4, '0') AS source_chunk_id FROM conversations"
)
def chunk_id_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    ids = lambda scheme: U.chunk_ids(F.col("role"), F.col("conv_id"), F.col("turn"), scheme)
    return rows.select("conv_id", "turn", ids("contract").alias("chunk_id"), ids("source").alias("source_chunk_id"))


@query(
    """SELECT source, '# ' || source || chr(10) || chr(10) || string_agg('- ' || lang || ': ' || n || ' documents', chr(10) ORDER BY '- ' || lang || ': ' || n || ' documents') AS markdown
FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) GROUP BY source"""
)
def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Markdown page per source: a heading and a line per language."""
    counted = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    line = F.format_string("- %s: %d documents", "lang", "n")
    body = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    return counted.groupBy("source").agg(F.concat(F.lit("# "), F.first("source"), F.lit("\n\n"), body).alias("markdown"))
