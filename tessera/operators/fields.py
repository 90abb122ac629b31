"""Fields of a document with how sure each is, from labels, patterns and how often a candidate occurs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed confidences: a labelled organisation, a labelled project, a project by pattern and one from the file name.
LABELLED, LABELLED_PROJECT, PATTERN_PROJECT, FILE_PROJECT = 0.90, 0.88, 0.60, 0.75
#: What each further place of a candidate in its document adds, the most that a candidate reaches, and what it needs.
MORE, MOST, LEAST = 0.03, 0.95, 0.50


def labelled(text: Column, labels: Sequence[str], least: int = 2, most: int = 80) -> Column:
    """The value of the first label: in brackets behind it, else the rest of its line; too short or long ones are none."""
    names = "|".join(labels)
    value = lambda pattern: F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1))
    found = F.coalesce(*[F.nullif(value(p), F.lit("")) for p in (f"(?m)(?:^|[ \\t])(?:{names})[ \\t]*\\([ \\t]*([^)\\n]+?)[ \\t]*\\)", f"(?m)(?:^|[ \\t])(?:{names})[ \\t]*[:：][ \\t]*([^\\n\\r]+)$")])
    return F.when(F.length(found).between(least, most), found)


def organisations(docs: DataFrame, id_col: str, text_col: str, labels: Sequence[str], candidates: str, score: float = 0.6, spread: float = 0.5) -> DataFrame:
    """``id, organisation, confidence``: the labelled organisation, else the best candidate; a document without either has no row.

    First pass: in how many documents each candidate occurs.  Second: a document's
    candidates start at ``score``, gain ``MORE`` for each further place in it, and lose 0.2
    where more than ``spread`` of all documents have them, for such a name says little about
    one.  A candidate's documents are counted by partial sums, so a frequent one is no hot spot.
    Of equal ones the more frequent, the longer and then the first by alphabet counts.
    """
    said = labelled(F.col(text_col), labels)
    rows = docs.select(F.col(id_col).alias("id"), said.alias("said"), F.when(said.isNull(), F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"({candidates})"), 1)).alias("names"))
    counted = rows.select("id", F.explode("names").alias("name")).groupBy("id", "name").agg(F.count("*").alias("n"))
    total = docs.agg(F.count("*").alias("total"))
    across = counted.groupBy("name").agg(F.count("*").alias("docs")).crossJoin(F.broadcast(total)).select("name", (F.col("docs") > spread * F.col("total")).alias("common"))  # one row is broadcast
    boosted = F.least(F.lit(score) + (F.col("n") - 1) * MORE, F.lit(MOST)) - F.when(F.col("common"), 0.2).otherwise(0.0)
    scored = counted.join(across, "name").withColumn("confidence", F.round(boosted, 6)).filter(F.col("confidence") >= LEAST)
    best = Window.partitionBy("id").orderBy(F.desc("confidence"), F.desc("n"), F.desc(F.length("name")), "name")
    found = scored.withColumn("r", F.row_number().over(best)).filter("r = 1").select("id", F.col("name").alias("organisation"), "confidence")
    return rows.filter("said is not null").select("id", F.col("said").alias("organisation"), F.lit(LABELLED).alias("confidence")).unionByName(found)


def project(text: Column, file_name: Column, labels: Sequence[str], pattern: str, noise: str) -> tuple[Column, Column]:
    """A project's name and how sure it is: by a label, by the pattern, else the file name without its extension and ``noise``."""
    by_label = labelled(text, labels, 5, 100)
    by_pattern = F.nullif(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), f"({pattern})", 1)), F.lit(""))
    by_file = F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(file_name, F.lit("")), "[.][A-Za-z0-9]+$", ""), noise, " ")), F.lit(""))
    sure = F.when(by_label.isNotNull(), LABELLED_PROJECT).when(by_pattern.isNotNull(), PATTERN_PROJECT).when(by_file.isNotNull(), FILE_PROJECT).otherwise(0.0)
    return F.coalesce(by_label, by_pattern, by_file), sure


def dated(text: Column, lines: int = 20) -> tuple[Column, Column]:
    """Year, and month where one follows it, of the first line that has one among the first ``lines`` that are not blank."""
    first = F.slice(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != ""), 1, lines)
    found = F.element_at(F.concat(F.filter(first, lambda x: x.rlike("20[0-3][0-9]")), F.array(F.lit(""))), 1)
    year = F.nullif(F.regexp_extract(found, "(20[0-3][0-9])", 1), F.lit(""))
    month = F.nullif(F.regexp_extract(found, "20[0-3][0-9](?:년|[.-])[ ]*(0?[1-9]|1[0-2])(?:[^0-9]|$)", 1), F.lit(""))
    return year.cast("int"), month.cast("int")


def organisation_of_lines(text: Column, labels: Sequence[str], patterns: Sequence[str], endings: Sequence[str], lines: int = 40, bare: int = 20) -> Column:
    """The first organisation that the first lines name: behind a label, in brackets, by a pattern, else a line that only is one.

    Lines are looked at within the row; nothing is exploded.
    """
    kept = F.slice(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, lines)
    names = "|".join(labels)
    ends = "|".join(endings)
    rules = [f"^(?:{names}) *[:：] *(.+)$", f"^(?:{names}) *\\( *([^)]+?) *\\)", *[f"({p})" for p in patterns]]
    take = lambda rows, p: F.element_at(F.concat(F.transform(F.filter(rows, lambda x: x.rlike(p)), lambda x: F.regexp_extract(x, p, 1)), F.array(F.lit(""))), 1)
    alone = take(F.slice(kept, 1, bare), f"^([^0-9:()]{{2,50}}(?:{ends}))$")
    return F.coalesce(*[F.nullif(F.trim(take(kept, p)), F.lit("")) for p in rules], F.nullif(alone, F.lit("")))
