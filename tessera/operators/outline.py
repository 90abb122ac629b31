"""What the beginning of a document says about the rest: its cover, and its contents as a tree of sections with page spans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed forms of a contents line: its numbering and the level that follows; more dots go deeper.
NUMBERED = [
    ("[IVX]{1,4}[.]", 1),
    ("[0-9]{1,2}(?:[.-][0-9]{1,2}){2}[.]?", 3),
    ("[0-9]{1,2}[.-][0-9]{1,2}[.]?", 2),
    ("[0-9]{1,2}[.]", 1),
    ("[가-하][.]", 2),
]
#: Levels of a tree.
LEVELS = 3
#: Weights of a contents page's confidence and the numbers they ask for: sections, titles, words.
CONTENTS_WEIGHTS = ((5, 0.5), (3, 0.3), (5, 0.2))
#: Weights of a cover's fields.
COVER_WEIGHTS = {"title": 0.30, "organisation": 0.25, "project": 0.20, "date": 0.15, "kind": 0.10}
_TITLE = "[ \\t]*([^\\n]*?[^ \\t.·…0-9][^\\n]*?)[ \\t.·…]*(?:[ \\t.·…]([0-9]{1,4}))?[ \\t]*$"


def contents_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, line_no, level, title, page`` of the numbered lines of contents pages; a line without a page number has a null page."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    found = [
        F.when(
            F.col("line").rlike(f"^[ \\t]*{form}[ \\t]+[^ \\t]"),
            F.struct(
                F.lit(level).alias("level"), F.regexp_extract("line", f"^[ \\t]*{form}{_TITLE}", 1).alias("title"),
                F.regexp_extract("line", f"^[ \\t]*{form}{_TITLE}", 2).alias("page")
            )
        ) for form,
        level in NUMBERED
    ]
    rows = lines.withColumn("f", F.coalesce(*found)).filter("f is not null and f.title <> ''")
    return rows.select(id_col, "line_no", "f.level", "f.title", F.when(F.col("f.page") != "", F.col("f.page").cast("int")).alias("page"))


def section_tree(entries: DataFrame, id_col: str, last_page: Column | None = None) -> DataFrame:
    """``id, line_no, level, title, parent_no, path, page, page_end`` of contents lines.

    A line's parent is the nearest earlier one of a smaller level; its path holds the
    titles from the top down.  A section without a page begins where the next one with a
    page does, and ends before the next section of its own or a smaller level, on the
    document's last page if there is none (null where that is not known).
    """
    own = Window.partitionBy(id_col).orderBy("line_no")
    before, after = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(1, Window.unboundedFollowing)
    levels = range(1, LEVELS + 1)
    last = {n: F.max(F.when(F.col("level") == n, F.struct("line_no", "title"))).over(before) for n in levels}
    rows = entries.withColumn("_page", F.coalesce("page", F.first("page", ignorenulls=True).over(after)))
    nexts = {n: F.min(F.when(F.col("level") <= n, F.struct("line_no", "_page"))).over(after) for n in levels}
    rows = rows.select("*", *[last[n].alias(f"_last{n}") for n in levels], *[nexts[n].alias(f"_next{n}") for n in levels])
    above = F.array_compact(F.array(*[F.when(F.col("level") > n, F.col(f"_last{n}")) for n in levels]))
    # of the last lines of each smaller level those count that no later line of a still smaller level has ended
    open_lines = F.filter(above, lambda x: ~F.exists(above, lambda y: (y.line_no > x.line_no) & (F.array_position(above, y) < F.array_position(above, x))))
    following = F.coalesce(*[F.when(F.col("level") == n, F.col(f"_next{n}")) for n in levels])
    end = F.when(following.isNull(), last_page if last_page is not None else F.lit(None).cast("int")).otherwise(F.greatest(F.col("_page"), following["_page"] - 1))
    path = F.array_join(F.concat(F.transform(open_lines, lambda x: x.title), F.array("title")), " > ")
    return rows.select(
        id_col, "line_no", "level", "title", F.array_max(F.transform(open_lines, lambda x: x.line_no)).alias("parent_no"), path.alias("path"),
        F.col("_page").alias("page"), end.alias("page_end")
    )


def contents_confidence(entries: DataFrame, id_col: str) -> DataFrame:
    """``id, sections, titles, words, confidence``: how much a contents page looks like one."""
    words = F.regexp_extract_all("title", F.lit("[가-힣A-Za-z]{2,}"), 0)
    counts = entries.groupBy(id_col).agg(
        F.count("*").alias("sections"), F.count_distinct("title").alias("titles"),
        F.size(F.array_distinct(F.flatten(F.collect_list(words)))).cast("long").alias("words")
    )
    parts = [F.when(F.col(c) >= least, weight).otherwise(0.0) for c, (least, weight) in zip(("sections", "titles", "words"), CONTENTS_WEIGHTS, strict=True)]
    return counts.withColumn("confidence", F.round(parts[0] + parts[1] + parts[2], 2))


def cover(
    text: Column, titles: Sequence[str], organisations: Sequence[str], projects: Sequence[str], kinds: Sequence[str], head: int = 2000,
    dates: str = "(20[23][0-9])(?:년 *|[.] *|-)([0-9]{1,2})(?:월|[.]|-)"
) -> dict[str, Column]:
    """Fields of a cover page, each by the first of its patterns that matches (whose first group is the value), and the confidence.

    Without a pattern for it the title is the first line that is not blank, and the project is the title without the names of document kinds.
    """
    start = F.substring(F.coalesce(text, F.lit("")), 1, head)

    def first(patterns: Sequence[str]) -> Column:
        return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(start, p, 1)), F.lit("")) for p in patterns], F.lit(None).cast("string"))

    kind = F.coalesce(*[F.when(F.contains(start, F.lit(k)), k) for k in kinds], F.lit(None).cast("string"))
    title = F.coalesce(first(titles), first(["(?m)^[ \\t]*([^ \\t\\n][^\\n]*)$"]))
    bare = F.trim(F.regexp_replace(title, "|".join(f"\\b{k}\\b" for k in kinds), "")) if kinds else title
    date = F.concat_ws("-", F.nullif(F.regexp_extract(start, dates, 1), F.lit("")), F.nullif(F.lpad(F.regexp_extract(start, dates, 2), 2, "0"), F.lit("00")))
    found = {"title": title, "organisation": first(organisations), "project": F.coalesce(first(projects), F.nullif(bare, F.lit(""))), "date": F.nullif(date, F.lit("")), "kind": kind}
    score = sum((F.when(found[f].isNotNull(), w).otherwise(0.0) for f, w in COVER_WEIGHTS.items()), F.lit(0.0))
    return found | {"confidence": F.round(score, 2)}


#: Fixed words for a section's own name, each with its other names.
Aliases = Mapping[str, Sequence[str]]


def canonical_section(title: Column, aliases: Aliases) -> Column:
    """The section whose name or other name is within a title, whatever its numbering, blanks and case; null if none is."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), "\\([0-9]+/[0-9]+\\)", ""), "^[ 0-9IVXⅠⅡⅢⅣⅤ]+[.]*[ 0-9.]*", "")
    plain = lambda t: F.lower(F.regexp_replace(t, "[^0-9A-Za-zÀ-ÖØ-öø-ÿ가-힣]", ""))
    return F.coalesce(*[F.when(F.contains(plain(bare), plain(F.lit(alias))), name) for name, others in aliases.items() for alias in (name, *others)], F.lit(None).cast("string"))


def slide_outline(slides: DataFrame, deck: str, number: str, section: str, words: str, most: int = 5) -> DataFrame:
    """``deck, section, first, last, ranges, n, keywords`` of decks of slides.

    Slides of one section are one row, wherever they stand: their numbers as merged
    ranges, and the ``most`` words that set the section apart from the deck's others, by
    frequency times log(sections / sections with the word); words of all sections are none.
    """
    own = Window.partitionBy(deck, section).orderBy(number)
    distinct = slides.select(deck, section, number).distinct()
    runs = distinct.withColumn("_run", F.col(number) - F.row_number().over(own)).groupBy(deck, section, "_run").agg(F.min(number).alias("a"), F.max(number).alias("b"), F.count("*").alias("c"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("~", F.col("a").cast("string"), F.col("b").cast("string")))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda x: x.t)
    ranges = runs.groupBy(deck, section).agg(F.min("a").alias("first"), F.max("b").alias("last"), F.array_join(pieces, ", ").alias("ranges"), F.sum("c").alias("n"))
    counted = slides.select(deck, section, F.explode(words).alias("word")).groupBy(deck, section, "word").agg(F.count("*").alias("tf"))
    across = counted.groupBy(deck, "word").agg(F.count("*").alias("df"))
    sections = ranges.groupBy(deck).agg(F.count("*").alias("sections"))
    weighed = counted.join(across, [deck, "word"]).join(sections, deck).withColumn("w", F.col("tf") * F.log(F.col("sections") / F.col("df"))).filter("w > 0")
    best = Window.partitionBy(deck, section).orderBy(F.desc(F.round("w", 9)), "word")
    top = weighed.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= most)
    keywords = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x.word), " ")
    return ranges.join(top.groupBy(deck, section).agg(keywords.alias("keywords")), [deck, section], "left").withColumn("keywords", F.coalesce("keywords", F.lit("")))


#: A unit of a page: up to a line end or the end of a sentence, at most as long as a chunk.
_UNIT = "(?s)(?:.{{0,{most}}}?(?:\\n|[.!?。] )|.{{1,{size}}}?\\z|.{{{size}}})"


def page_chunks(pages: DataFrame, id_col: str, page_col: str, text_col: str, size: int = 1000, overlap: int = 300) -> DataFrame:
    """``id, page, chunk_no, start, text``: chunks of a page that end with a sentence or a line where that can be; ``start`` is its place in the page (from 0).

    A chunk takes units while their prefix sum stays within ``size``; the next one begins with
    the longest run of its last units that is no longer than ``overlap`` and leaves room for
    the unit that follows.  Everything is an expression over one page's row; chunks never cross pages.
    """
    if not 2 <= size <= 1000:
        raise ValueError("a chunk has 2 to 1000 characters")
    units = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(_UNIT.format(size=size, most=size - 2)), 0)
    sums = F.aggregate("_u", F.array(F.lit(0)), lambda acc, u: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(u))))
    rows = pages.select(id_col, page_col, F.filter(units, lambda u: u != "").alias("_u")).withColumn("_p", sums).filter(F.size("_u") > 0)
    at = lambda i: F.element_at("_p", i + 1)  # the characters before unit i, from 0
    none = F.array().cast("array<struct<s:int,e:int>>")

    def step(state: Column, i: Column) -> Column:
        """Unit ``i`` joins the open chunk, or closes it."""
        fits = at(i + 1) - at(state.s) <= size
        begins = F.filter(F.sequence(state.s + 1, i), lambda t: (at(i) - at(t) <= overlap) & (at(i + 1) - at(t) <= size))
        closed = F.concat(state.done, F.array(F.struct(state.s.alias("s"), i.alias("e"))))
        return F.when(fits, state).otherwise(F.struct(F.element_at(begins, 1).alias("s"), closed.alias("done")))

    n = F.size("_u")
    made = F.aggregate(F.sequence(F.lit(0), n - 1), F.struct(F.lit(0).alias("s"), none.alias("done")), step, lambda state: F.concat(state.done, F.array(F.struct(state.s.alias("s"), n.alias("e")))))
    spans = rows.select(id_col, page_col, "_u", "_p", F.posexplode(made).alias("chunk_no", "c"))
    text = F.array_join(F.slice("_u", F.col("c.s") + 1, F.col("c.e") - F.col("c.s")), "")
    return spans.select(id_col, page_col, "chunk_no", F.element_at("_p", F.col("c.s") + 1).alias("start"), text.alias("text"))
