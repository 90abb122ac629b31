"""Table-generating operators: pages, sections and chunks of texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze

PAGE_MARK = "={3,} *\\[PAGE ([0-9]+)\\] *={3,}"
HEADING = "^([0-9]+(\\.[0-9]+)*[.)]? +.{2,80}|#{1,6} +.+|제 *[0-9]+ *[장절].*)$"


def pages(docs: DataFrame, id_col: str, text_col: str, mark: str = PAGE_MARK) -> DataFrame:
    """``id, page_no, text``: text between page marks; what stands before the first is page 1 if it is not blank."""
    marked = docs.select(id_col, F.split(F.regexp_replace(text_col, mark, "\u0001$1\u0002"), "\u0001").alias("parts"))
    rows = marked.select(id_col, F.posexplode("parts").alias("n", "part"))
    number = F.when(F.col("part").contains("\u0002"), F.substring_index("part", "\u0002", 1).cast("int")).otherwise(1)
    body = F.when(F.col("part").contains("\u0002"), F.substring_index("part", "\u0002", -1)).otherwise(F.col("part"))
    return rows.select(id_col, number.alias("page_no"), F.trim(F.regexp_replace(body, "^[\\r\\n]+|[\\r\\n]+$", "")).alias("text")).filter("text <> ''")


def marked_lines(rows: DataFrame, id_col: str, order: str, cell: str) -> DataFrame:
    """Rows after ``;[N]`` belong to page N: ``id, page_no, text, char_count``; rows before any mark and empty pages go."""
    page = F.regexp_extract(cell, "^;\\[([0-9]+)\\]", 1)
    numbered = rows.withColumn("_m", F.when(page != "", page.cast("int")))
    within = Window.partitionBy(id_col).orderBy(order)
    filled = numbered.withColumn("page_no", F.last("_m", ignorenulls=True).over(within)).filter(F.col("page_no").isNotNull() & F.col("_m").isNull() & (F.trim(cell) != ""))
    joined = filled.groupBy(id_col, "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, cell))), lambda x: x[cell]), "\n").alias("text"))
    return joined.withColumn("char_count", F.length("text"))


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))


def sections(docs: DataFrame, id_col: str, text_col: str, heading: str = HEADING) -> DataFrame:
    """``id, section_no, title, n_lines, n_chars``: a heading opens a section; what stands before is section 0."""
    rows = lines(docs, id_col, text_col).withColumn("is_heading", F.trim("line").rlike(heading))
    number = F.sum(F.col("is_heading").cast("int")).over(Window.partitionBy(id_col).orderBy("line_no"))
    grouped = rows.withColumn("section_no", number).groupBy(id_col, "section_no")
    return grouped.agg(F.max(F.when(F.col("is_heading"), F.trim("line"))).alias("title"), F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"))


def page_kind(number: Column, text: Column) -> Column:
    """cover, toc, appendix or content."""
    return F.when(text.rlike("(\\.{4,}[^\\n]*\\n?){2}"), "toc").when(F.lower(text).rlike("appendix|annex|부록|별첨"), "appendix").when((number == 1) & (F.length(text) < 300), "cover").otherwise("content")


def chunk_pages(chunks: DataFrame, spans: DataFrame, id_col: str) -> DataFrame:
    """Each chunk's page: the span that holds its midpoint, else the nearest one; chunks without any span have no row.

    A document's spans follow one another, so only the last one that begins before the
    midpoint and the next one come into question (the former where both touch it): one
    sorted pass instead of all pairs of chunks and pages.
    """
    span = F.struct("page_start", "page_stop", "page_no")
    kind = "struct<page_start:double,page_stop:double,page_no:bigint>"
    middle = chunks.select(id_col, "chunk_index", ((F.col("start") + F.col("stop")) / 2).alias("_mid"), F.lit(None).cast(kind).alias("_span"), F.lit(0).alias("_kind"))
    starts = spans.select(
        id_col, F.lit(None).cast(chunks.schema["chunk_index"].dataType).alias("chunk_index"), F.col("page_start").cast("double").alias("_mid"),
        span.cast(kind).alias("_span"), F.lit(1).alias("_kind")
    )
    order = Window.partitionBy(id_col).orderBy("_mid", "_kind")
    met = middle.unionByName(starts).select(
        "*",
        F.last("_span", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_before"),
        F.first("_span", ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("_after"),
    )

    def gap(c: str) -> Column:
        far = F.least(F.abs(F.col("_mid") - F.col(f"{c}.page_start")), F.abs(F.col("_mid") - F.col(f"{c}.page_stop")))
        inside = (F.col("_mid") >= F.col(f"{c}.page_start")) & (F.col("_mid") < F.col(f"{c}.page_stop"))
        return F.when(F.col(c).isNotNull(), F.struct(F.when(inside, F.lit(0.0)).otherwise(far).alias("g"), F.col(f"{c}.page_no").alias("p")))

    nearest = F.array_min(F.array_compact(F.array(gap("_before"), gap("_after"))))
    return met.filter("_kind = 0").select(id_col, "chunk_index", nearest["p"].alias("page_no")).filter("page_no is not null")


def window_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 300) -> DataFrame:
    """``id, chunk_index, start, stop, chunk_id``: fixed windows over the squeezed text, by position; stays in the JVM."""
    step = size - overlap
    rows = docs.select(id_col, squeeze(F.col(text_col)).alias("t")).filter("t <> ''")
    starts = F.sequence(F.lit(0), F.greatest(F.length("t") - overlap - 1, F.lit(0)), F.lit(step))
    out = rows.select(id_col, "t", F.posexplode(starts).alias("chunk_index", "start"))
    stop = F.least(F.col("start") + size, F.length("t"))
    return out.select(
        id_col, "chunk_index", "start", stop.alias("stop"),
        F.format_string("%s-chunk-%04d", F.col(id_col).cast("string"), "chunk_index").alias("chunk_id"),
        F.substring(F.col("t"), F.col("start") + 1, stop - F.col("start")).alias("text")
    )


_SENTENCE = re.compile(r"(?<=[.!?。])\s+|\n+")


def estimate(text: str) -> int:
    hangul = sum("가" <= c <= "힣" for c in text)
    return int(hangul / 1.8 + 0.75 * len("".join(" " if "가" <= c <= "힣" else c for c in text).split()))


def pack(text: str, size: int = 512, least: int = 50, overlap: int = 50, merge_small: bool = True) -> list[tuple[str, int, int]]:
    """Sentences packed into chunks of at most ``size`` estimated tokens, with true offsets.

    A chunk below ``least`` tokens joins the one before (or goes, as older builds did, with ``merge_small=False``);
    each chunk but the first is led by the last words of the one before, up to ``overlap`` tokens.
    """
    bounds, at = [], 0
    for m in _SENTENCE.finditer(text):
        bounds.append((at, m.start()))
        at = m.end()
    bounds.append((at, len(text)))
    spans: list[list[int]] = []
    total = 0
    for a, b in ((a, b) for a, b in bounds if text[a:b].strip()):
        cost = estimate(text[a:b])
        if spans and total + cost <= size:
            spans[-1][1] = b
            total += cost
        else:
            spans.append([a, b])
            total = cost
    kept: list[list[int]] = []
    for a, b in spans:
        if estimate(text[a:b]) < least and (kept or not merge_small):
            if merge_small:
                kept[-1][1] = b
            continue
        kept.append([a, b])
    out = []
    for n, (a, b) in enumerate(kept):
        lead, cost = [], 0
        for word in reversed(text[kept[n - 1][0] : kept[n - 1][1]].split()) if n else ():
            cost += max(1, estimate(word))
            if cost > overlap:
                break
            lead.append(word)
        out.append((" ".join([*reversed(lead), text[a:b]]) if lead else text[a:b], a, b))
    return out


def packed_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 512, least: int = 50, overlap: int = 50) -> DataFrame:
    """``id, chunk_index, text, start, stop`` of every text; packing is sequential, so it runs in Arrow batches."""
    key = dict(docs.dtypes)[id_col]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, n, c, a, b) for i, t in zip(frame[id_col], frame[text_col].fillna("")) for n, (c, a, b) in enumerate(pack(t, size, least, overlap))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_index", "text", "start", "stop"])

    return docs.select(id_col, text_col).mapInPandas(work, f"`{id_col}` {key}, chunk_index int, text string, start int, stop int")


REQUIREMENT = "([A-Z]{2,4}-[0-9]{2,3})"
#: Fixed boosts by priority.
BOOSTS = {"high": 1.3, "medium": 1.0, "low": 0.7}


def requirements(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, req_id, prefix, body, boost``: blocks that a requirement id opens."""
    parts = docs.select(id_col, F.posexplode(F.split(F.regexp_replace(text_col, f"(?m)^ *{REQUIREMENT}", "\u0001$1\u0002"), "\u0001")).alias("n", "part")).filter(F.col("part").contains("\u0002"))
    body = F.trim(F.substring_index("part", "\u0002", -1))
    boost = F.when(F.lower(body).rlike("must|필수|상"), BOOSTS["high"]).when(F.lower(body).rlike("optional|선택"), BOOSTS["low"]).otherwise(BOOSTS["medium"])
    req = F.substring_index("part", "\u0002", 1)
    return parts.select(id_col, req.alias("req_id"), F.substring_index(req, "-", 1).alias("prefix"), body.alias("body"), boost.alias("boost"))
