"""Branches of listings, gates, joins and audits: ordered rejects, match levels, ordered sections, coercions and edits."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gate_reason(rejects: Sequence[tuple[Column, str]], bypassed: Column, bypassing: Sequence[str] = ()) -> Column:
    """The first reject that holds, else 'ok'; those named in ``bypassing`` don't count where ``bypassed`` holds."""
    rules = [F.when(F.coalesce(c & ~(bypassed if name in bypassing else F.lit(False)), F.lit(False)), name) for c, name in rejects]
    return F.coalesce(*rules, F.lit("ok"))


def ordered_values(value: Column, *order: Column) -> Column:
    """Distinct values of a group in the order of their first rows."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("_v")))), lambda x: x["_v"]))


def split_counts(rows: DataFrame, fields: Sequence[str], ready: Column) -> DataFrame:
    """``field, value, total, ready, ratio`` of every value of every field, and of all rows (field 'all'); one pass."""
    pairs = F.array(
        F.struct(F.lit("all").alias("field"), F.lit("").alias("value")),
        *[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("value")) for f in fields]
    )
    long = rows.select(ready.alias("_ready"), F.explode(pairs).alias("p"))
    n = long.groupBy("p.field", "p.value").agg(F.count("*").alias("total"), F.count_if("_ready").alias("ready"))
    return n.withColumn("ratio", F.round(F.col("ready") / F.col("total"), 3))


def distributions(rows: DataFrame, fields: Sequence[str], most: int = 10) -> DataFrame:
    """``field, value, n, rank``: the most frequent filled values of every field."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.trim(F.col(f).cast("string")).alias("value")) for f in fields])).alias("p")).select("p.field", "p.value")
    n = long.filter(F.coalesce(F.col("value"), F.lit("")) != "").groupBy("field", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    return n.withColumn("rank", place).filter(F.col("rank") <= most)


def rated(rates: Mapping[str, tuple[Column, float, float]], rows: DataFrame) -> DataFrame:
    """``question, rate, verdict``: shares in percent of one pass over ``rows``, each with its bars for pass and warn."""
    one = rows.agg(*[(100 * share).alias(name) for name, (share, _, _) in rates.items()])
    judged = [
        F.struct(F.lit(name).alias("question"), F.round(F.col(name), 2).alias("rate"), F.when(F.col(name) >= good, "pass").when(F.col(name) >= fair, "warn").otherwise("fail").alias("verdict"))
        for name, (_, good, fair) in rates.items()
    ]
    return one.select(F.explode(F.array(*judged)).alias("q")).select("q.*")


def as_list(value: Column) -> Column:
    """A list from a JSON array, a bar-separated or a plain string; blanks and repeats go, order stays."""
    text = F.trim(F.coalesce(value, F.lit("")))
    parsed = F.from_json(text, "array<string>")
    parts = F.when(text.startswith("[") & parsed.isNotNull(), parsed).otherwise(F.split(text, "[|]"))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != ""))


def embedded_object(text: Column) -> Column:
    """The outermost braces of a text, if they hold JSON; null otherwise."""
    found = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)(\{.*\})", 1), F.lit(""))
    return F.when(F.from_json(found, "map<string,string>").isNotNull() & F.get_json_object(found, "$").isNotNull(), found)


def edit_edges(edges: DataFrame, added: DataFrame, removed: Sequence[str]) -> DataFrame:
    """Edges ``src, dst, type`` without those of the removed ids ``src->dst:type``, with the added ones, each once."""
    name = F.concat(F.col("src"), F.lit("->"), F.col("dst"), F.lit(":"), F.col("type"))
    kept = edges.filter(~name.isin(*removed)) if removed else edges
    return kept.unionByName(added).dropDuplicates(["src", "dst", "type"])


def cleaned(rows: DataFrame, remove: Column, exclude: Column, restore: Column, dry_run: bool = False) -> DataFrame:
    """Rows with an ``action``; unless it is a dry run, removed ones are gone and the others' ``excluded`` is set accordingly."""
    holds = lambda c: F.coalesce(c, F.lit(False))
    action = F.when(holds(remove), "removed").when(holds(exclude), "excluded").when(holds(restore) & holds(F.col("excluded")), "restored").otherwise("kept")
    marked = rows.withColumn("action", action)
    if dry_run:
        return marked
    return marked.filter("action <> 'removed'").withColumn("excluded", F.when(F.col("action") == "excluded", True).when(F.col("action") == "restored", False).otherwise(F.col("excluded")))


def index_report(wanted: Sequence[str], hits: DataFrame, index: str) -> DataFrame:
    """``index, found, hits`` of every wanted index: those without any row are missing."""
    names = hits.sparkSession.createDataFrame([(w,) for w in wanted], "index string")
    n = hits.groupBy(F.col(index).cast("string").alias("index")).agg(F.count("*").alias("hits"))
    return names.join(n, "index", "left").select("index", F.col("hits").isNotNull().alias("found"), F.coalesce("hits", F.lit(0)).alias("hits"))


_SPACE = " \\t\\r\\n\\x0B\\f"
#: Besides A-Z and the kept ones themselves, what becomes a kept character in lower case.
_CAPITALS = {"i": "\u0130", "k": "\u212a"}


def word_pattern(term: str) -> str:
    """A whole word that is the term in lower case, when all but letters a-z, Hangul, digits and underscores are left out of it."""
    other = f"[^0-9A-Za-z가-힣_{''.join(_CAPITALS.values())}{_SPACE}]*+"
    if re.search("[^0-9a-z가-힣_]", term):
        return "(?!)"
    letters = "".join(f"[{c}{c.upper()}{_CAPITALS.get(c, '')}]{other}" for c in term)
    return f"(?<![^{_SPACE}])(?=[^{_SPACE}]){other}{letters}(?![^{_SPACE}])"


def marked_snippet(text: Column, term: str, words: int = 30) -> Column:
    """About ``words`` words around the first word that is the term, which stands between <b> and </b>; null without it.

    A text is searched once, and only the words up to the hit and those shown are told apart.
    """
    whole = F.coalesce(text, F.lit(""))
    once = lambda value, use: F.get(F.transform(F.array(value), use), 0)
    parts = lambda some, most=-1: F.filter(F.split(some, f"[{_SPACE}]+", most), lambda x: x != "")

    def around(before: Column, after: Column) -> Column:
        hit = F.substring(whole, F.length(before) + 1, F.length(whole) - F.length(before) - F.length(after))
        first = lambda own: F.slice(own, F.greatest(F.size(own) - words // 2, F.lit(0)) + 1, words // 2)
        rest = lambda left: F.slice(parts(after, words + 1), 1, words - 1 - F.size(left))
        shown = lambda left: F.array_join(F.concat(left, F.array(F.concat(F.lit("<b>"), hit, F.lit("</b>"))), rest(left)), " ")
        return once(once(parts(before), first), shown)

    return once(F.split(whole, word_pattern(term), 2), lambda cut: F.when(F.size(cut) == 2, around(F.get(cut, 0), F.get(cut, 1))))


def path_score(path: Column, folders: Sequence[str], files: Sequence[str], extensions: Mapping[str, int], marks: Mapping[str, int]) -> Column:
    """Points of a path: 5 for each word in a folder or name, 4 for each in the name, by extension, and for marks in the name."""
    lower = F.lower(F.coalesce(path, F.lit("")))
    name = F.element_at(F.split(lower, "/"), -1)
    points = lambda found, n: F.when(found, n).otherwise(0)
    score = F.lit(0)
    for word in folders:
        score = score + points(F.contains(lower, F.lit(word)), 5)
    for word in files:
        score = score + points(F.contains(name, F.lit(word)), 4)
    for mark, n in marks.items():
        score = score + points(F.contains(name, F.lit(mark)), n)
    return score + F.coalesce(*[F.when(name.endswith(e), n) for e, n in extensions.items()], F.lit(0))


#: Fixed bars of a text's measures: characters, marks of broken fonts (number and share), score, spoilt share, characters of a page.
LEAST_CHARS, MOST_MARKS, MOST_MARK_SHARE, GOOD_SCORE, MOST_SPOILT, LEAST_PAGE = 100, 20, 0.005, 0.6, 0.15, 30
#: Fixed patterns of the marks, of what is spoilt, and of a script's own letters.
MARK = "\\(cid:[0-9]+\\)"
SPOILT = [
    "[\\x{FFFD}\\x{FFFE}\\x{FFFF}]",
    "[□■○●◎◇◆△▲▽▼]{3,}",
    "[\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}]",
    "[가-힣][a-zA-Z][가-힣][a-zA-Z]",
    "[ㄱ-ㅎㅏ-ㅣ]{5,}",
]
OWN_LETTERS = "[가-힣]"


def text_measures(text: Column, pages: Column, own: str = OWN_LETTERS) -> dict[str, Column]:
    """``chars, marks, own, latin, spoilt, empty, score`` of a text and the array of its pages.

    Shares of letters and of what is spoilt are of the characters that are not blank, the share of marks is of all;
    a page is empty if it has fewer than ``LEAST_PAGE`` characters without the blanks around it.
    """
    size = F.length(text)
    dense = F.length(F.regexp_replace(text, "[ \\n\\t]", ""))
    share = lambda pattern: F.when(dense > 0, F.regexp_count(text, F.lit(pattern)) / dense).otherwise(0.0)
    linear = lambda x, upto, most: F.greatest(F.lit(0.0), most * (1 - x / upto))
    bare = F.filter(pages, lambda p: F.length(F.regexp_replace(p, "^[ \\t\\r\\n]+|[ \\t\\r\\n]+$", "")) < LEAST_PAGE)
    empty = F.when(F.size(pages) > 0, F.size(bare) / F.size(pages))
    letters, latin, spoilt = share(own), share("[a-zA-Z]"), share("|".join(SPOILT))
    length = F.when(size >= 1000, 0.2).otherwise(size / F.when(size >= 100, 5000).otherwise(1000))
    script = F.when(letters > 0, F.least(F.lit(0.3), 1.5 * letters)).otherwise(0.15 * latin)
    score = length + script + linear(spoilt, 0.15, 0.25) + F.coalesce(linear(empty, 0.3, 0.25), F.lit(0.15))
    return {"chars": size, "marks": F.regexp_count(text, F.lit(MARK)), "own": letters, "latin": latin, "spoilt": spoilt, "empty": F.coalesce(empty, F.lit(0.0)), "score": F.least(F.lit(1.0), score)}


#: What is done with a text: the first row whose condition holds, else the last.
TEXT_RULES = (
    ("marks >= {MOST_MARKS} or marks >= {MOST_MARK_SHARE} * chars", "recognise"),
    ("chars < {LEAST_CHARS}", "recognise"),
    ("score >= {GOOD_SCORE}", "use"),
    ("spoilt > 2 * {MOST_SPOILT}", "recognise"),
    ("score >= {GOOD_SCORE} / 2", "convert"),
    ("true", "recognise"),
)


def text_actions(rows: DataFrame) -> DataFrame:
    """Rows of ``chars, marks, score, spoilt`` with ``action``: use the text, convert its file again, or recognise its pages."""
    bars = {"MOST_MARKS": MOST_MARKS, "MOST_MARK_SHARE": f"{MOST_MARK_SHARE}D", "LEAST_CHARS": LEAST_CHARS, "GOOD_SCORE": f"{GOOD_SCORE}D", "MOST_SPOILT": f"{MOST_SPOILT}D"}
    return rows.withColumn("action", F.coalesce(*[F.when(F.expr(rule.format(**bars)), action) for rule, action in TEXT_RULES]))


def replace_postings(index: DataFrame, new: DataFrame, id_col: str) -> DataFrame:
    """A full-text index with the postings of some documents deleted and inserted anew."""
    return index.join(new.select(id_col).distinct(), id_col, "left_anti").select(*index.columns).unionByName(new)


def markdown_pages(rows: DataFrame, group: str, item: str, noun: str) -> DataFrame:
    """``group, markdown``: a heading for each group and a line with its count for each of its items."""
    counted = rows.groupBy(group, item).agg(F.count("*").alias("n"))
    lines = F.array_sort(F.collect_list(F.format_string(f"- %s: %d {noun}", item, "n")))
    return counted.groupBy(group).agg(F.array_join(lines, "\n").alias("_body")).select(group, F.concat(F.lit("# "), F.col(group), F.lit("\n\n"), F.col("_body")).alias("markdown"))
