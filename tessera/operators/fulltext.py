"""A stored full-text index with blocks of postings, and exact BM25 search that skips blocks.

A block holds a term's postings in one range of documents that lie together in
the source.  Beside them stands its hull: the pairs of frequency and length of
which no other posting has both a higher frequency and a smaller length.  The
highest impact of a block follows from the hull for any mean length, so that
documents can be added without touching what is there.

A search reads the hulls of its terms first.  The sum of the highest impacts of
a query's terms bounds every document of a range.  The ranges of highest bound
are scored; the score of the last wanted document there is a bar that all other
ranges have to reach, or their postings are never opened.

Null texts have no words but count as documents.  Ids may be of any type; where an
id comes twice its rows are documents of their own to the counts, and one to the
scores.  Ties are ordered by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .ranking import K1, LEAST_IDF, B
from .tables import cut

#: Documents in a range: 2 ** RANGE_BITS neighbours of the source.
RANGE_BITS = 7
#: Scores are rounded to so many places, so that equal documents tie whatever the order of their sums.
PLACES = 9
#: Bounds are sums in another order than scores; what is below the bar by so little is still opened.
SLACK = 1e-8
#: So many terms go into the scan's filter; more are left to the join.
MOST_PUSHED = 1_000


def _counted(words: Column) -> Column:
    """``term, tf`` of each different word of an array: words are sorted, and a word's count is the distance to the next one."""
    ordered = F.array_sort(words)
    starts = lambda w: F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: (i == 1) | (F.element_at(w, i) != F.element_at(w, F.greatest(i - 1, F.lit(1)))))
    pairs = lambda w, s: F.zip_with(s, F.concat(F.slice(s, 2, F.size(s)), F.array(F.size(w) + 1)), lambda a, b: F.struct(F.element_at(w, a).alias("term"), (b - a).alias("tf")))
    none = F.array().cast("array<struct<term:string,tf:int>>")
    return F.when(F.size(words) > 0, F.transform(F.array(ordered), lambda w: pairs(w, starts(w)))[0]).otherwise(none)


def _hull(postings: Column) -> Column:
    """Pairs (tf, dl) that no posting beats in both, the highest frequency first."""
    ordered = F.array_sort(F.transform(postings, lambda p: F.struct((-p.tf).alias("less"), p.dl.alias("dl"))))
    first = F.array().cast("array<struct<less:int,dl:int>>")
    keep = lambda kept, p: F.when((F.size(kept) == 0) | (F.element_at(kept, -1).dl > p.dl), F.concat(kept, F.array(p))).otherwise(kept)
    return F.transform(F.aggregate(ordered, first, lambda kept, p: F.when(F.size(kept) == 0, F.array(p)).otherwise(keep(kept, p))), lambda p: F.struct((-p.less).alias("tf"), p.dl.alias("dl")))


class Index:
    """An index in a folder: ``blocks`` (term, range, n, hull, postings) in order of the term, and ``lengths`` (id, dl)."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/blocks")

    def lengths(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/lengths")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
        """Writes the postings of documents that are not in the index yet.

        One shuffle brings a block's postings together, most of them within the task
        that read them; a second puts the blocks in order of term and range, so that a
        frequent term is split over files and a rare one is found by the files' statistics.
        """
        batch = F.lit(self._batches())
        words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))
        words.select("id", F.size("w").alias("dl")).write.mode("append").parquet(f"{self.folder}/lengths")
        placed = words.select("id", F.size("w").alias("dl"), "w", F.shiftright(F.monotonically_increasing_id(), RANGE_BITS).alias("place"))
        found = placed.select("id", "dl", F.struct(batch.alias("batch"), "place").alias("range"), F.explode(_counted(F.col("w"))).alias("t"))
        postings = F.collect_list(F.struct("id", "t.tf", "dl"))
        grouped = found.groupBy(F.col("t.term").alias("term"), "range").agg(postings.alias("postings"))
        made = grouped.select("term", "range", F.size("postings").alias("n"), _hull(F.col("postings")).alias("hull"), "postings")
        made.repartitionByRange("term", "range").sortWithinPartitions("term", "range").write.mode("append").parquet(f"{self.folder}/blocks")
        return self

    def _batches(self) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/blocks")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return 0
        return (self.blocks().agg(F.max("range.batch")).head()[0] or 0) + 1

    # -- search

    def _asked(self, cases: DataFrame, case_col: str) -> DataFrame:
        """``case, term, range, idf, most``: blocks of each case's terms with their share of the score at most; no postings are read."""
        stats = self.lengths().agg(F.count("*").alias("total"), F.avg("dl").alias("mean"))
        terms = cases.select(F.col(case_col).alias("case"), F.explode(F.array_distinct("terms")).alias("term"))
        heads = self.blocks().select("term", "range", "n", "hull").join(terms.select("term").distinct(), "term", "left_semi")
        df = heads.groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.greatest(F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
        known = terms.join(df, "term").crossJoin(F.broadcast(stats)).select("case", "term", idf.alias("idf"), "mean")
        highest = F.array_max(F.transform("hull", lambda p: impact(p.tf, p.dl, F.col("mean"))))
        return heads.join(known, "term").select("case", "term", "range", "idf", "mean", (F.col("idf") * highest).alias("most"))

    def _scored(self, wanted: DataFrame) -> DataFrame:
        """``case, id, score`` of the documents of wanted blocks."""
        blocks = self.blocks().select("term", "range", "postings")
        terms = [r.term for r in wanted.select("term").distinct().limit(MOST_PUSHED + 1).collect()]
        if len(terms) <= MOST_PUSHED:  # few enough to be compared with the statistics of files and row groups
            blocks = blocks.filter(F.col("term").isin(terms))
        opened = blocks.join(wanted, ["term", "range"])
        each = opened.select("case", "idf", "mean", F.explode("postings").alias("p"))
        score = F.sum(F.col("idf") * impact(F.col("p.tf"), F.col("p.dl"), F.col("mean")))
        return each.groupBy("case", F.col("p.id").alias("id")).agg(F.round(score, PLACES).alias("score"))

    def search(self, cases: DataFrame, case_col: str, most: int) -> DataFrame:
        """``case, id, score, rank``: the ``most`` best documents of each case, whose words stand in ``terms``."""
        asked = cut(self._asked(cases, case_col))
        bounds = cut(asked.groupBy("case", "range").agg(F.sum("most").alias("bound")))
        # each range has a document at least, so that so many ranges have as many documents as are wanted
        seeds = cut(_best(bounds, most, F.desc("bound"), "range").select("case", "range"))
        first = cut(self._scored(asked.join(seeds, ["case", "range"])))
        bars = _best(first, most, F.desc("score"), "id").filter(F.col("rank") == most).select("case", F.col("score").alias("bar"))
        reach = F.col("bound") >= F.coalesce("bar", F.lit(0.0)) * (1 - SLACK) - SLACK
        more = cut(bounds.join(seeds, ["case", "range"], "left_anti").join(bars, "case", "left").filter(reach).select("case", "range"))
        self.last = (bounds, seeds, more)
        found = first.unionByName(self._scored(asked.join(more, ["case", "range"])))
        return _best(found, most, F.desc("score"), "id")

    def opened(self) -> tuple[int, int]:
        """Of the last search: pairs of case and range whose postings were opened, and all that had a term of the case."""
        bounds, seeds, more = self.last
        return seeds.count() + more.count(), bounds.count()


def _best(rows: DataFrame, most: int, *order: Column | str) -> DataFrame:
    """The first rows of each case with their ``rank``; tasks cut to so many before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("case").orderBy(*order))).filter(F.col("rank") <= most)


def impact(tf: Column, dl: Column, mean: Column) -> Column:
    """What a term's frequency in a document of some length is worth, before the term's own weight."""
    f = tf.cast("double")
    return f * (K1 + 1) / (f + K1 * (1 - B + B * dl / mean))


def snippets(hits: DataFrame, docs: DataFrame, cases: DataFrame, case_col: str, id_col: str = "doc_id", text_col: str = "text", around: int = 15) -> DataFrame:
    """``case, id, snippet``: of each hit the words around the first that the case asks for, which are marked."""
    words = F.split(F.regexp_replace(F.trim(F.coalesce(F.col(text_col), F.lit(""))), r"[ \t\r\n]+", " "), " ")
    texts = docs.select(F.col(id_col).alias("id"), words.alias("_w"))
    met = hits.join(texts, "id").join(cases.select(F.col(case_col).alias("case"), "terms"), "case")
    asked = lambda w: F.exists(tokens(w), lambda t: F.array_contains("terms", t))
    first = F.coalesce(F.try_element_at(F.filter(F.sequence(F.lit(1), F.size("_w")), lambda i: asked(F.element_at("_w", i))), F.lit(1)), F.lit(1))
    window = F.slice("_w", F.greatest(first - around, F.lit(1)), F.lit(2 * around))
    return met.select("case", "id", F.array_join(F.transform(window, lambda w: F.when(asked(w), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w)), " ").alias("snippet"))
