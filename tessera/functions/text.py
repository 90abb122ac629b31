"""Scalar text functions as column expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns.
TOKEN = "[0-9a-z가-힣_]+"
HANGUL = "[가-힣]"
SPACES = "[ \\t\\r\\n\\x0B\\f]+"


def tokens(text: Column, least: int = 1) -> Column:
    """Lower-case tokens of digits, Latin letters, Hangul and underscores, of at least ``least`` characters."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return found if least < 2 else F.filter(found, lambda t: F.length(t) >= least)


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; trimmed."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def compact(text: Column) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(text), SPACES, "")


def shorten(text: Column, limit: int = 220) -> Column:
    """Squeezed text, cut at ``limit`` characters with three dots."""
    one = squeeze(text)
    return F.when(F.length(one) > limit, F.concat(F.substring(one, 1, limit), F.lit("..."))).otherwise(one)


def middle_cut(text: Column, most: int = 1800) -> Column:
    """Head and tail halves joined by an ellipsis line where the text is longer than ``most``."""
    half = most // 2
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(half)), F.lit("\n...\n"), F.right(text, F.lit(half)))).otherwise(text)


def token_estimate(text: Column) -> Column:
    """int(Hangul characters / 1.8 + 0.75 * words of the rest)."""
    rest = F.trim(F.regexp_replace(F.regexp_replace(text, HANGUL, " "), SPACES, " "))
    words = F.when(rest == "", 0).otherwise(F.size(F.split(rest, " ")))
    return F.floor(F.regexp_count(text, F.lit(HANGUL)) / 1.8 + 0.75 * words)


def gate(text: Column) -> Column:
    """Why a text is no use ('ok' if it is): empty, page_marker, toc, short, few_letters or monotone, in this order."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))
    letters = F.regexp_count(trimmed, F.lit("[A-Za-z가-힣À-ÖØ-öø-ÿ]"))
    size = F.length(trimmed)
    unique = F.size(F.array_distinct(F.split(trimmed, "")))
    return (
        F.when(size == 0, "empty")
        .when(trimmed.rlike("^[=-]+ *\\[?[A-Za-z]+ [0-9]+\\]? *[=-]+$"), "page_marker")
        .when(F.regexp_count(trimmed, F.lit("\\.{4,}")) >= 2, "toc")
        .when(letters < 10, "short")
        .when(letters / size < 0.30, "few_letters")
        .when(unique / size < 0.15, "monotone")
        .otherwise("ok")
    )


def quality_score(text: Column, pages: Column, empty_pages: Column, script: str = HANGUL) -> Column:
    """0 to 1: length 0.2, script share 0.3, no garbage 0.25, no empty pages 0.25."""
    size = F.length(text)
    ratio = lambda pattern: F.when(size > 0, F.regexp_count(text, F.lit(pattern)) / size).otherwise(0.0)
    own, latin, garbage = ratio(script), ratio("[A-Za-z]"), ratio("[\\x{FFFD}\\x{0000}-\\x{0008}]|\\(cid:[0-9]+\\)")
    length = F.when(size >= 1000, 0.2).when(size >= 100, 0.2 * size / 1000).otherwise(0.1 * size / 100)
    by_script = F.when(own >= 0.2, 0.3).when(own > 0, 0.3 * own / 0.2).otherwise(0.15 * latin)
    by_garbage = F.when(garbage == 0, 0.25).when(garbage < 0.15, 0.25 * (1 - garbage / 0.15)).otherwise(0.0)
    empty = empty_pages / pages
    by_pages = F.when(pages <= 0, 0.15).when(empty_pages == 0, 0.25).when(empty < 0.3, 0.25 * (1 - empty / 0.3)).otherwise(0.0)
    return F.least(length + by_script + by_garbage + by_pages, F.lit(1.0))


def filled(value: Column) -> Column:
    """Whether a value says anything: not null, blank or a word for unknown."""
    return value.isNotNull() & ~F.lower(F.trim(value)).isin("", "unknown", "none", "null", "n/a", "없음", "-")


def first_filled(*values: Column) -> Column:
    """The first value that is not null or blank."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def fallback_source(**values: Column) -> Column:
    """Name of the first value that is not null or blank, else 'none'."""
    found = None
    for name, value in values.items():
        test = F.coalesce(F.trim(value) != "", F.lit(False))
        found = F.when(test, name) if found is None else found.when(test, name)
    return found.otherwise("none")


def first_match(text: Column, rules: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """Name of the first rule of which any word occurs in the lower-cased text."""
    lower, found = F.lower(F.coalesce(text, F.lit(""))), None
    for name, words in rules:
        test = F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(lower, w))
        found = F.when(test, name) if found is None else found.when(test, name)
    return found.otherwise(otherwise)


def expand(text: Column, synonyms: dict[str, list[str]]) -> Column:
    """The text with the synonyms of its words appended, in word order, without those already in it."""
    words = F.array_sort(F.array_distinct(tokens(text)))
    table = F.create_map(*[x for k, v in sorted(synonyms.items()) for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    more = F.flatten(F.filter(F.transform(words, lambda w: F.try_element_at(table, w)), lambda a: a.isNotNull()))
    new = F.filter(F.array_distinct(more), lambda s: ~F.contains(F.lower(text), s))
    return F.when(F.size(new) > 0, F.concat(text, F.lit(" "), F.array_join(new, " "))).otherwise(text)


def document_uid(source: Column, path: Column) -> Column:
    """sha1 of ``source:path`` in lower-case hex."""
    return F.sha1(F.concat_ws(":", source, path).cast("binary"))


def slug(text: Column, least: int = 1) -> Column:
    """ASCII tokens joined by hyphens plus eight md5 digits of the whole text."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.concat_ws("-", F.array_join(found, "-"), F.left(F.md5(text.cast("binary")), F.lit(8)))


def highlight(text: Column, needle: str, around: int = 60) -> Column:
    """Exact match as (0-based offset, snippet with guillemets); offset -1 where there is none."""
    at = F.instr(F.lower(text), needle.lower())
    before = F.substring(text, F.greatest(at - around, F.lit(1)), F.least(at - 1, F.lit(around)))
    inside = F.substring(text, at, F.lit(len(needle)))
    after = F.substring(text, at + len(needle), F.lit(around))
    return F.struct((at - 1).cast("long").alias("offset"), F.when(at > 0, F.concat(before, F.lit("«"), inside, F.lit("»"), after)).otherwise("").alias("snippet"))


def grounded_share(answer: Column, evidence: Column) -> Column:
    """Share of the answer's sentences of which at least two distinct words occur among the evidence's."""
    known = tokens(evidence)
    sentences = F.filter(F.split(answer, "[.!?\n]+"), lambda s: F.size(tokens(s)) > 0)
    hits = F.filter(sentences, lambda s: F.size(F.array_intersect(tokens(s), known)) >= 2)
    return F.when(F.size(sentences) > 0, F.size(hits) / F.size(sentences)).otherwise(0.0)


def tag_weight(frequency: Column) -> Column:
    return F.when(frequency >= 10, 1.0).when(frequency >= 5, 0.8).when(frequency >= 2, 0.6).otherwise(0.4)


def similarity_label(score: Column) -> Column:
    return F.when(score >= 0.85, "very_high").when(score >= 0.70, "high").when(score >= 0.50, "medium").otherwise("low")
