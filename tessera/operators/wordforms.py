"""Keywords without an analyser: word stems by how a corpus's word forms begin and go on.

A stem is a beginning of word forms that holds together (its letters nearly always
follow one another) and that many different endings follow.  Both come from counts of
the beginnings of the different forms, so that what is shuffled grows with the
vocabulary, not with the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut

#: Longer forms are counted by so many of their first letters.
LONGEST = 20
#: Places to which scores are rounded, so that equal stems tie whatever the order of their sums.
PLACES = 9
#: What stands for the end of a form among the letters that may follow a beginning.
END = "$"


def forms(docs: DataFrame, text_col: str, letters: str = "[가-힣]+") -> DataFrame:
    """``form, n``: how often each word form occurs."""
    found = F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"({letters})"), 1))
    return docs.select(found.alias("form")).groupBy("form").agg(F.count("*").alias("n"))


def beginnings(counted: DataFrame) -> DataFrame:
    """``start, n, kinds, cohesion, entropy`` of every beginning of a form.

    ``n`` is its number of places, ``kinds`` of how many different letters (or ends) follow,
    ``cohesion`` the mean chance of its letters after the first, ``entropy`` that of what follows.
    """
    upto = F.sequence(F.lit(1), F.least(F.length("form"), F.lit(LONGEST)))
    each = counted.select(
        "n",
        F.explode(
            F.transform(
                upto,
                lambda k: F.struct(
                    F.substring(F.col("form"), F.lit(1), k).alias("start"),
                    F.coalesce(F.nullif(F.substring(F.col("form"), k + 1, F.lit(1)), F.lit("")), F.lit(END)).alias("follows")
                )
            )
        ).alias("x")
    )
    following = each.groupBy("x.start", "x.follows").agg(F.sum("n").alias("c"))
    sums = following.groupBy("start").agg(F.sum("c").alias("n"), F.count("*").alias("kinds"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
    entropy = F.log("n") - F.col("clogc") / F.col("n")
    first = sums.filter(F.length("start") == 1).select(F.col("start").alias("_first"), F.col("n").alias("_n"))
    size = F.length("start")
    chance = F.when(size > 1, F.pow(F.col("n") / F.col("_n"), 1 / (size - 1))).otherwise(0.0)
    joined = sums.join(first, F.substring("start", 1, 1) == F.col("_first"))
    return joined.select("start", "n", "kinds", F.round(chance, PLACES).alias("cohesion"), F.round(F.greatest(entropy, F.lit(0.0)), PLACES).alias("entropy"))


def stems(counted: DataFrame, least: int = 2, shortest: int = 2) -> DataFrame:
    """``form, n, stem, score``: each form's best beginning, by cohesion times entropy, and itself where none qualifies.

    A beginning of ``shortest`` letters or more qualifies where ``least`` different letters
    follow; of equal ones the longest counts.  The form itself may be one: its end follows.
    """
    counted = cut(counted)
    known = beginnings(counted).filter((F.col("kinds") >= least) & (F.length("start") >= shortest)).withColumn("score", F.round(F.col("cohesion") * F.col("entropy"), PLACES))
    parts = counted.select("form", "n", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("form"), F.lit(LONGEST))), lambda k: F.substring(F.col("form"), F.lit(1), k))).alias("start"))
    best = parts.join(known.select("start", "score"), "start").groupBy("form").agg(F.max(F.struct("score", F.length("start").alias("size"), F.col("start").alias("stem"))).alias("b"))
    return counted.join(best, "form", "left").select("form", "n", F.coalesce("b.stem", "form").alias("stem"), F.coalesce("b.score", F.lit(0.0)).alias("score"))


def keywords(docs: DataFrame, id_col: str, text_col: str, letters: str = "[가-힣]+", most: int = 10, compounds: bool = True) -> DataFrame:
    """``id, keyword, n``: the most frequent stems of each document, and stems that stand side by side as compounds of two.

    Of a form longer than its stem the rest is a particle: a compound's first word has none.
    Of equal counts the alphabet decides.
    """
    known = cut(stems(forms(docs, text_col, letters)).select("form", "stem"))
    words = docs.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"({letters})"), 1)).alias("at", "form"))
    placed = words.join(known, "form")
    found = placed.select("id", F.col("stem").alias("keyword"))
    if compounds:
        own = Window.partitionBy("id").orderBy("at")
        pair = F.when((F.lead("at").over(own) == F.col("at") + 1) & (F.col("form") == F.col("stem")), F.concat_ws(" ", "stem", F.lead("stem").over(own)))
        found = found.unionByName(placed.select("id", pair.alias("keyword")).filter("keyword is not null"))
    counted = found.groupBy("id", "keyword").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "keyword"))
    return counted.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def share_of_particles(stemmed: DataFrame) -> Column:
    """How much of the text's words goes beyond their stems."""
    return F.sum(F.when(F.col("form") != F.col("stem"), F.col("n")).otherwise(0)) / F.sum("n")
