"""Predicates, review states, coverage and statistics over document metadata."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filled


def document_rows(docs: DataFrame, labels: DataFrame, removed_at: Column | None = None) -> DataFrame:
    """Documents with category, review state, inclusion flags and the time of their removal (null: not removed)."""
    known = labels.select(F.col("doc_id"), F.col("quality"), F.col("toxic"))
    status = F.when(F.col("quality") == 1, "reviewed").when(F.col("quality") == 0, "pending").otherwise("registered")
    return docs.join(known, "doc_id", "left").select(
        "doc_id", "text", "lang", "source", "n_chars", status.alias("status"), (F.coalesce("toxic", F.lit(0)) == 1).alias("is_excluded"), (F.coalesce("quality", F.lit(0)) == 1).alias("include_in_rag"),
        (F.lit(None) if removed_at is None else removed_at).cast("timestamp").alias("removed_at"),
    )


def rag_ready() -> Column:
    """Reviewed, included, and in the collection."""
    return (F.col("status") == "reviewed") & F.col("include_in_rag") & active()


def active() -> Column:
    """Neither excluded nor removed; a document whose exclusion is not known is excluded."""
    return ~F.coalesce("is_excluded", F.lit(True)) & F.col("removed_at").isNull()


def select_documents(rows: DataFrame, sources: Iterable[str] = (), ids: Iterable[int] = (), statuses: Iterable[str] = (), categories: Iterable[str] = ()) -> DataFrame:
    """Conjunction of the filters that are given; an empty one is skipped."""
    for column, wanted in (("source", sources), ("doc_id", ids), ("status", statuses), ("lang", categories)):
        if values := list(wanted):
            rows = rows.filter(F.col(column).isin(values))
    return rows


def relaxed(rows: DataFrame, levels: list[Column], id_col: str) -> DataFrame:
    """Rows of the first level that has any, with its number; all rows and the number of levels if none has.

    One scan: each row carries the levels it passes, the best non-empty level is a one-row aggregate.
    """
    flagged = rows.select("*", *[F.coalesce(c, F.lit(False)).alias(f"_l{n}") for n, c in enumerate(levels)])
    found = flagged.agg(F.array(*[F.bool_or(f"_l{n}") for n in range(len(levels))]).alias("_any"))
    first = F.coalesce(F.array_position(F.col("_any"), True) - 1, F.lit(-1))
    level = found.select(F.when(first < 0, len(levels)).otherwise(first).alias("strategy"))
    passed = F.lit(False)
    for n in range(len(levels)):
        passed = passed | ((F.col("strategy") == n) & F.col(f"_l{n}"))
    kept = flagged.crossJoin(F.broadcast(level)).filter(passed | (F.col("strategy") == len(levels)))
    return kept.drop(*[f"_l{n}" for n in range(len(levels))])


def status_counts(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Count per value of a fixed list, zeros included."""
    spark = rows.sparkSession
    base = spark.createDataFrame([(v,) for v in values], f"{column} string")
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return base.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def source_statistics(rows: DataFrame) -> DataFrame:
    """Per source: all, ready, and their ratio to three places."""
    agg = rows.groupBy("source").agg(F.count("*").alias("total"), F.count_if(rag_ready()).alias("ready"))
    return agg.withColumn("ratio", F.round(F.col("ready") / F.col("total"), 3))


def document_statistics(rows: DataFrame) -> DataFrame:
    """Counts by category, by status and in all, in one pass over the data."""
    rows.createOrReplaceTempView("_document_rows")
    return rows.sparkSession.sql(
        "SELECT CASE WHEN grouping(lang) = 0 THEN 'category' WHEN grouping(status) = 0 THEN 'status' ELSE 'all' END AS kind, coalesce(lang, status, 'all') AS value, count(*) AS n FROM _document_rows GROUP BY GROUPING SETS ((lang), (status), ())"
    )


def review_progress(rows: DataFrame) -> DataFrame:
    agg = rows.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "pending").alias("review_required"), F.count_if(F.col("status") == "reviewed").alias("reviewed"))
    return agg.withColumn("progress", F.round(100 * F.col("reviewed") / F.col("total"), 1))


def dataset_statistics(rows: DataFrame, category: str, length: str) -> DataFrame:
    """Per category: documents, share of all in per cent, mean, largest and smallest length."""
    agg = rows.groupBy(category).agg(F.count("*").alias("n"), F.round(F.avg(length), 4).alias("avg_len"), F.max(length).alias("max_len"), F.min(length).alias("min_len"))
    return agg.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))


def coverage(rows: DataFrame, fields: dict[str, Column], document: str) -> DataFrame:
    """Per field: share of rows filled, and share of documents with any filled row."""
    per_row = rows.select(document, *[filled(c).cast("int").alias(n) for n, c in fields.items()])
    per_doc = per_row.groupBy(document).agg(F.count("*").alias("_n"), *[x for n in fields for x in (F.sum(n).alias(f"{n}_s"), F.max(n).alias(f"{n}_m"))])
    total = per_doc.agg(*[x for n in fields for x in ((F.sum(f"{n}_s") / F.sum("_n")).alias(f"{n}_s"), F.avg(f"{n}_m").alias(f"{n}_m"))])
    stack = ", ".join(f"'{n}', {n}_s, {n}_m" for n in fields)
    return total.selectExpr(f"stack({len(fields)}, {stack}) AS (field, row_rate, doc_rate)").select("field", F.round("row_rate", 6).alias("row_rate"), F.round("doc_rate", 6).alias("doc_rate"))


def linkability(fields: int, unique_fields: int, structured: bool) -> float:
    value = min(0.3, 0.05 * fields) + min(0.4, 0.1 * unique_fields) + (0.3 if structured else 0.0)
    if not structured and not unique_fields:
        value = min(value, 0.2)
    return round(value, 2)


def diagnosis(rows: DataFrame, document: str, required: list[str], keys: list[str]) -> DataFrame:
    """Completeness min(1, rows / documents / 10), share of required fields present, structure and key uniqueness, and their mean."""
    agg = rows.agg(
        F.least(F.lit(1.0), F.count("*") / F.greatest(F.count_distinct(document), F.lit(1)) / 10).alias("completeness"),
        (sum((F.when(F.count_if(filled(F.col(c).cast("string"))) > 0, 1).otherwise(0) for c in required), F.lit(0)) / len(required)).alias("consistency"),
        *[(F.count_distinct(k) / F.greatest(F.count("*"), F.lit(1))).alias(f"u_{k}") for k in keys],
    )
    uniqueness = sum((F.when(F.col(f"u_{k}") > 0.5, 1).otherwise(0) for k in keys), F.lit(0))
    link = F.round(F.least(F.lit(0.3), F.lit(0.05 * len(rows.columns))) + F.least(F.lit(0.4), 0.1 * uniqueness) + 0.3, 2)
    out = agg.select(F.round("completeness", 6).alias("completeness"), F.round("consistency", 6).alias("consistency"), link.alias("linkability"))
    return out.withColumn("overall", F.round((F.col("completeness") + F.col("consistency") + F.col("linkability")) / 3, 6))


def quality_report(rows: DataFrame, document: str, required: list[str], keys: list[str], category: str, structured: Column, nested: Column) -> DataFrame:
    """``completeness, consistency, structure, linkability, overall`` of chunks of documents.

    Completeness: chunks a document, ten being enough.  Consistency: the share of the
    required fields that any row has filled.  Structure: 0.4 if any row is structured, 0.3
    if any is nested, 0.3 for three categories.  Linkability: 0.05 a field up to 0.3, 0.1 a
    key that mostly differs up to 0.4, 0.3 for structure; neither key nor structure, at most 0.2.
    """
    there = [F.coalesce(F.max(filled(F.col(c).cast("string")).cast("int")), F.lit(0)).alias(f"_f{n}") for n, c in enumerate(required) if c in rows.columns]
    differ = [((F.count_distinct(k) / F.greatest(F.count("*"), F.lit(1))) > 0.5).cast("int").alias(f"_k{n}") for n, k in enumerate(keys)]
    any_of = lambda c, name: F.coalesce(F.max(c.cast("int")), F.lit(0)).alias(name)
    row = rows.agg(
        F.count("*").alias("_rows"), F.count_distinct(document).alias("_docs"), F.count_distinct(category).alias("_categories"),
        any_of(structured, "_structured"), any_of(nested, "_nested"), *there, *differ
    )
    total = lambda prefix: sum((F.col(c) for c in row.columns if c.startswith(prefix)), F.lit(0))
    link = F.least(F.lit(0.3), F.lit(0.05 * len(rows.columns))) + F.least(F.lit(0.4), 0.1 * total("_k")) + 0.3 * F.col("_structured")
    measures = {
        "completeness": F.when(F.col("_docs") > 0, F.least(F.lit(1.0), F.col("_rows") / F.col("_docs") / 10)).otherwise(0.0),
        "consistency": total("_f") / max(1, len(required)),
        "structure": 0.4 * F.col("_structured") + 0.3 * F.col("_nested") + F.when(F.col("_categories") >= 3, 0.3).otherwise(0.0),
        "linkability": F.when((F.col("_structured") == 0) & (total("_k") == 0), F.least(link, F.lit(0.2))).otherwise(link),
    }
    made = row.select(*[F.round(c, 2 if n == "linkability" else 6).alias(n) for n, c in measures.items()])
    return made.withColumn("overall", F.round((F.col("completeness") + F.col("consistency") + F.col("structure") + F.col("linkability")) / 4, 6))


def compare(left: DataFrame, right: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Per metric: both values, difference and per cent of the left one."""
    one = lambda f, side: f.agg(*[c.cast("double").alias(n) for n, c in metrics.items()]).selectExpr(
        f"stack({len(metrics)}, {', '.join(f'{chr(39)}{n}{chr(39)}, {n}' for n in metrics)}) AS (metric, {side})"
    )
    joined = one(left, "a").join(one(right, "b"), "metric", "full")
    return joined.select(
        "metric", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), F.round(F.col("b") - F.col("a"), 4).alias("diff"),
        F.when(F.col("a") != 0, F.round(100 * (F.col("b") - F.col("a")) / F.col("a"), 4)).alias("percent")
    )


def missing_and_unexpected(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Ids that are only expected, or only there."""
    a, b = expected.select(key).distinct(), actual.select(key).distinct()
    return a.join(b, key, "left_anti").select(key, F.lit("missing").alias("problem")).unionByName(b.join(a, key, "left_anti").select(key, F.lit("unexpected").alias("problem")))


def stage_status(complete: Column, total: Column) -> Column:
    return F.when(total == 0, "empty").when(complete == total, "ready").when(complete > 0, "partial").otherwise("missing")


def best_match(rows: DataFrame, others: DataFrame, keys: list[tuple[str, str]], columns: list[str]) -> DataFrame:
    """Each row with the columns of its match by the first key that has one: one equi-join per key, then coalesce."""
    out = rows
    for n, (own, theirs) in enumerate(keys):
        one = others.filter(F.col(theirs).isNotNull()).groupBy(F.col(theirs).alias(f"_k{n}")).agg(*[F.min_by(c, F.struct(*columns)).alias(f"_{c}{n}") for c in columns])
        out = out.join(one, F.col(own) == F.col(f"_k{n}"), "left")
    level = F.coalesce(*[F.when(F.col(f"_k{n}").isNotNull(), n) for n in range(len(keys))])
    picked = [F.coalesce(*[F.when(F.col(f"_k{n}").isNotNull(), F.col(f"_{c}{n}")) for n in range(len(keys))]).alias(c) for c in columns]
    return out.select(*rows.columns, *picked, level.alias("match_level"))


def number_ranges(rows: DataFrame, group: str, number: str) -> DataFrame:
    """Sorted distinct numbers of each group as ranges (gaps and islands)."""
    distinct = rows.select(group, number).distinct()
    island = F.col(number) - F.row_number().over(Window.partitionBy(group).orderBy(number))
    return distinct.withColumn("_i", island).groupBy(group, "_i").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("_i")
