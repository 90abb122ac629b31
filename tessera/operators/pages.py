"""Pages of a text with their numbers, places, titles and kinds; keywords and test questions from metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What parts pages: a mark with the page's number, or a form feed.
BREAK = "={3,} *\\[PAGE ([0-9]+)\\] *={3,}|\\f"
#: Fixed signs of kinds of pages, of tables, images and charts.
COVER, APPENDIX, CONTENTS = "제안요청서|제안서|보고서|proposal|report", "^[ \\t\\n]*(부록|별첨|appendix|annex)", "목 *차|차 *례|table of contents|^[ \\t\\n]*contents"
TABLE = "(?m)\\|.+\\|.+\\||^[ \\t]*[^ \\t\\n]+[ \\t]{2,}[^ \\t\\n]+[ \\t]{2,}[^ \\t\\n]+|^[-+=]{4,}$"
IMAGE, CHART = "(?i)\\[이미지\\]|\\[그림\\]|\\[Image\\]|\\[Figure\\]", "(?i)\\[차트\\]|\\[Chart\\]|\\[그래프\\]|\\[Graph\\]"
_BLANK = "^[ \\t\\r\\n]+|[ \\t\\r\\n]+$"


def page_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, page_no, start, stop, text, title, kind, has_table, has_image, has_chart`` of every page that is not blank.

    A page has the number of its mark, but at least one more than the page before, or
    one more where the mark has none; what stands before the first mark is page 1.
    ``start`` and ``stop`` are its place in the text (from 0).
    """
    # marks become one character each: \u0001 and the number, ended by \u0002
    marked = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\\f", "\u0001\u0003\u0002"), "(={3,} *\\[PAGE )([0-9]+)(\\] *={3,})", "\u0001$1$2$3\u0002")
    parts = F.split(marked, "\u0001")
    rows = docs.select(id_col, F.posexplode(parts).alias("n", "part"))
    has_mark = F.contains("part", F.lit("\u0002"))
    mark = F.when(has_mark, F.substring_index("part", "\u0002", 1)).otherwise("")
    body = F.when(has_mark, F.substr(F.col("part"), F.instr("part", "\u0002") + 1)).otherwise(F.col("part"))
    own = Window.partitionBy(id_col).orderBy("n")
    rows = rows.select(id_col, "n", mark.alias("mark"), body.alias("body")).withColumn("stop", F.sum(F.length("mark") + F.length("body")).over(own))
    rows = rows.select(
        id_col, "n", (F.col("stop") - F.length("body")).alias("start"), "stop",
        F.nullif(F.regexp_extract("mark", "([0-9]+)", 1), F.lit("")).cast("int").alias("asked"), F.regexp_replace("body", _BLANK, "").alias("text")
    ).filter("text <> ''")
    # number i is max(asked, number i - 1 plus one): i plus the largest of asked minus place up to there
    place = F.row_number().over(own)
    rows = rows.withColumn("i", place).withColumn("page_no", F.col("i") + F.greatest(F.max(F.coalesce("asked", F.lit(0)) - F.col("i")).over(own), F.lit(0)))
    lower = F.lower("text")
    kind = F.when((F.col("page_no") == 1) & lower.rlike(COVER), "cover").when(lower.rlike(APPENDIX), "appendix").when(lower.rlike(CONTENTS), "toc").otherwise("content")
    lines = F.transform(F.slice(F.split("text", "\n"), 1, 5), lambda x: F.trim(x))
    fit = F.filter(lines, lambda x: F.length(x).between(4, 120) & ~x.rlike("^[0-9. -]+$") & ~F.contains(x, F.lit("....")) & ~F.contains(x, F.lit("|")))
    flags = [F.col("text").rlike(p).alias(n) for n, p in (("has_table", TABLE), ("has_image", IMAGE), ("has_chart", CHART))]
    return rows.select(id_col, F.col("page_no").cast("int").alias("page_no"), "start", "stop", "text", F.try_element_at(fit, F.lit(1)).alias("title"), kind.alias("kind"), *flags)


def keyword_changes(docs: DataFrame, existing: DataFrame, weights: Mapping[str, float], overwrite: bool, skip: Sequence[str] = ("unknown",)) -> DataFrame:
    """``keyword, category, weight, action`` of the keywords that documents' fields propose, against those that exist.

    Of a keyword that several fields propose the largest weight counts, of equal ones the
    first field; letter case does not matter, blanks are one space, single letters are none.
    A keyword that exists is updated with ``overwrite``, else skipped.
    """
    fields = list(weights)
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[ \\t\\r\\n]+", " "))
    each = F.array(*[F.struct(plain(F.col(f)).alias("keyword"), F.lit(f).alias("category"), F.lit(float(weights[f])).alias("weight"), F.lit(-n).alias("order")) for n, f in enumerate(fields)])
    rows = docs.select(F.explode(each).alias("c")).select("c.*").filter((F.length("keyword") >= 2) & ~F.lower("keyword").isin(*skip))
    best = rows.groupBy(F.lower("keyword").alias("key")).agg(F.max(F.struct("weight", "order", F.col("category"))).alias("b"), F.min("keyword").alias("keyword"))
    known = existing.select(F.lower(plain(F.col("keyword"))).alias("key")).distinct().withColumn("known", F.lit(True))
    action = F.when(F.col("known"), "updated" if overwrite else "skipped").otherwise("created")
    return best.join(known, "key", "left").select("keyword", F.col("b.category").alias("category"), F.col("b.weight").alias("weight"), action.alias("action"))


def sample_questions(docs: DataFrame, fields: Mapping[str, tuple[str, int]], defaults: Sequence[str], count: int, top: int = 3) -> DataFrame:
    """``place, question, category, origin``: questions about a collection, from the most frequent values of its fields.

    ``fields`` gives for each field the pattern of a question and how many words of a value
    it takes; defaults fill up what is missing.
    """
    values = F.array(*[F.struct(F.lit(n).alias("f"), F.trim(F.col(f).cast("string")).alias("v")) for n, f in enumerate(fields)])
    counted = docs.select(F.explode(values).alias("x")).select("x.*").filter("v <> ''").groupBy("f", "v").agg(F.count("*").alias("n"))
    order = Window.partitionBy("f").orderBy(F.desc("n"), "v")
    best = counted.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top)
    texts = [F.when(F.col("f") == n, F.format_string(pattern, F.array_join(F.slice(F.split("v", " +"), 1, words), " "))) for n, (pattern, words) in enumerate(fields.values())]
    names = [F.when(F.col("f") == n, name) for n, name in enumerate(fields)]
    asked = best.select((F.col("f") * top + F.col("r")).alias("o"), F.coalesce(*texts).alias("question"), F.coalesce(*names).alias("category"), F.lit("dynamic").alias("origin"))
    spare = docs.sparkSession.createDataFrame([(len(fields) * top + 1 + n, q, "default", "default") for n, q in enumerate(defaults)], "o int, question string, category string, origin string")
    every = asked.unionByName(spare).groupBy("question").agg(F.min(F.struct("o", "category", "origin")).alias("b"))
    return every.select(F.row_number().over(Window.orderBy("b.o")).alias("place"), "question", "b.category", "b.origin").filter(F.col("place") <= count)  # a few rows


def enriched(chunks: DataFrame, text: Column, gate: Column, context: Column | None = None, labels: Sequence[Column] = ()) -> DataFrame:
    """Chunks with ``embed_text``: null where the gate rejects them, else their labels, their context if one is given, and the text, a line each."""
    parts = [F.nullif(F.trim(x), F.lit("")) for x in (*labels, *([] if context is None else [context]), text)]
    return chunks.withColumn("embed_text", F.when(gate == "ok", F.concat_ws("\n", *parts)))
