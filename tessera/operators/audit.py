"""Audits, readiness checks, recommendations, sampling and picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import cosine

#: Vectors that an audit takes at once.
MOST_SAMPLED = 10_000


def self_hit(sample: DataFrame, vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row: sampled vectors, share that find themselves first, share within the first three.

    Every sampled vector meets every vector once; only vectors at least as near as the own one are counted.
    The sample is broadcast, so it may hold at most ``MOST_SAMPLED`` rows.
    """
    if sample.limit(MOST_SAMPLED + 1).count() > MOST_SAMPLED:
        raise ValueError(f"at most {MOST_SAMPLED} vectors can be audited at once")
    q = sample.select(F.col(id_col).alias("q"), F.col(vector).alias("qv"))
    v = vectors.select(F.col(id_col).alias("i"), F.col(vector).alias("v"))
    scored = v.crossJoin(F.broadcast(q)).select("q", "i", F.round(cosine(F.col("v"), F.col("qv")), 9).alias("s"))
    own = scored.filter("q = i").select("q", F.col("s").alias("own"))
    better = scored.join(F.broadcast(own), "q").groupBy("q").agg(F.count_if((F.col("s") > F.col("own")) | ((F.col("s") == F.col("own")) & (F.col("i") < F.col("q")))).alias("n"))
    return better.agg(F.count("*").alias("sampled"), F.round(F.avg((F.col("n") == 0).cast("int")), 6).alias("first"), F.round(F.avg((F.col("n") < 3).cast("int")), 6).alias("top3"))


def hash_sample(rows: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """n rows that are the same for a seed, whatever the partitioning: the least digests of seed and key; a TakeOrdered, not a shuffle of all rows."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def entity_coverage(entities: DataFrame, names: DataFrame, field: str, entity: str, name: str) -> DataFrame:
    """Per field: distinct normalised entities, how many are node names, and the share."""
    e = entities.select(field, normal_form(F.col(entity)).alias("e")).filter("e <> ''").distinct()
    n = names.select(normal_form(F.col(name)).alias("n")).distinct()
    joined = e.join(n, e.e == n.n, "left")
    return joined.groupBy(field).agg(F.count("*").alias("entities"), F.count("n").alias("covered")).withColumn("coverage", F.round(F.col("covered") / F.col("entities"), 6))


def normal_form(value: Column) -> Column:
    """Lower case without white space and punctuation."""
    return F.regexp_replace(F.lower(value), "[^0-9a-z가-힣à-öø-ÿ]", "")


def split_values(value: Column) -> Column:
    """Trimmed, non-empty parts between commas, semicolons, slashes and ideographic commas."""
    return F.filter(F.transform(F.split(value, "[,;/、]"), lambda x: F.trim(x)), lambda x: x != "")


def field_profile(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Per field: values, distinct values, uniqueness, and whether it looks like an id."""
    agg = rows.agg(*[x for f in fields for x in (F.count(f).alias(f"{f}_n"), F.count_distinct(f).alias(f"{f}_d"))])
    stack = ", ".join(f"'{f}', {f}_n, {f}_d" for f in fields)
    out = agg.selectExpr(f"stack({len(fields)}, {stack}) AS (field, n_values, n_distinct)")
    unique = F.when(F.col("n_values") > 0, F.round(F.col("n_distinct") / F.col("n_values"), 6)).otherwise(0.0)
    return out.withColumn("uniqueness", unique).withColumn("id_like", F.col("field").rlike("(^|_)(id|key|uid)$") | (unique > 0.95))


def recommendation(score: Column, passed: Column) -> Column:
    return F.when(score < 0.5, "critical").when(score < 0.7, "warning").when(~passed, "check").otherwise("fine")


def majority_year(rows: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``id, year, confidence``: the most frequent 20xx (the first seen for ties), confidence min(0.5 + 0.1 n, 0.9)."""
    found = rows.select(id_col, F.posexplode(F.regexp_extract_all(text, F.lit("(20[0-9]{2})"), F.lit(1))).alias("at", "year"))
    counted = found.groupBy(id_col, "year").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    best = counted.groupBy(id_col).agg(F.max(F.struct("n", (-F.col("at")).alias("at"), "year")).alias("b"))
    return best.select(id_col, F.col("b.year").alias("year"), F.round(F.least(0.5 + 0.1 * F.col("b.n"), F.lit(0.9)), 2).alias("confidence"))


def representative(rows: DataFrame, groups: list[str], score: Column, newest: str, id_col: str) -> DataFrame:
    """The best-scored row of each group; the newest, then the smallest id for ties."""
    order = Window.partitionBy(*groups).orderBy(F.desc("_score"), F.desc(newest), id_col)
    return rows.withColumn("_score", score).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n").withColumnRenamed("_score", "pick_score")


def normalised_weights(rows: DataFrame, weight: str) -> DataFrame:
    """Negative weights count as 0; the rest are divided by their sum, or become 1 if it is 0."""
    positive = F.greatest(F.lit(0.0), F.col(weight).cast("double"))
    total = rows.agg(F.sum(positive).alias("_total"))
    return rows.crossJoin(F.broadcast(total)).withColumn("share", F.when(F.col("_total") > 0, positive / F.col("_total")).otherwise(1.0)).drop("_total")


def inherit(rows: DataFrame, group: str, master: Column, fields: list[str]) -> DataFrame:
    """Fields that are null are taken from the group's master row (its smallest values if there are several)."""
    masters = rows.filter(master).groupBy(group).agg(*[F.min(f).alias(f"_{f}") for f in fields])
    joined = rows.join(masters, group, "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in fields else F.col(c) for c in rows.columns])


def chain_groups(rows: DataFrame, project: str, role: str, id_col: str) -> DataFrame:
    """Per project: the first document of the leading role and the others' ids by role, in order."""
    lead = F.min(F.when(F.col(role) == "rfp", F.col(id_col)))
    rest = lambda kind: F.array_join(F.array_sort(F.collect_set(F.when(F.col(role) == kind, F.col(id_col)))), ",")
    return rows.groupBy(project).agg(lead.alias("rfp"), rest("proposal").alias("proposals"), rest("deliverable").alias("deliverables"))


def organisation_type(name: Column) -> Column:
    """By suffix, first match: public, university, company or other."""
    return F.when(name.rlike("(부|처|청|시|도|군|구|공사|공단)$"), "public").when(name.rlike("(?i)(대학교|대학|university)$"), "university").when(
        name.rlike("(?i)(주식회사|inc\\.?|ltd\\.?|gmbh|corp\\.?|\\.com)$"), "company"
    ).otherwise("other")


def folder_confidence(name: Column) -> Column:
    """Date prefix 0.35, length 0.30 (10 to 60) or 0.20, keyword 0.20, initial letter 0.15."""
    size = F.length(name)
    return F.when(name.rlike("^[0-9]{4,8}[. _-]"), 0.35).otherwise(0.0) + F.when(size.between(10, 60), 0.30).otherwise(0.20) + F.when(
        F.lower(name).rlike("project|system|구축|사업|시스템"), 0.20
    ).otherwise(0.0) + F.when(name.rlike("^[A-Za-z가-힣]"), 0.15).otherwise(0.0)


def clean_lines(text: Column) -> Column:
    """Lines without numbering and bullets; control marks, absolute paths, contact lines and repeats go."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), "^([0-9]+[.)]|[-*•])[ ]+", "")))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike("^(={3,}|-{3,}|/[A-Za-z]|[A-Z]:\\\\)|@|[0-9]{2,4}[-. ][0-9]{3,4}[-. ][0-9]{4}"))
    return F.array_join(F.array_distinct(kept), "\n")


def keywords(text: Column, most: int = 12) -> Column:
    """First distinct parts of 2 to 40 characters between punctuation marks."""
    parts = F.filter(F.transform(F.split(text, "[,.;:/()\\n|]+"), lambda x: F.trim(x)), lambda x: F.length(x).between(2, 40))
    return F.slice(F.array_distinct(parts), 1, most)
