"""Operator 7: benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Tokens are maximal runs of anything but ASCII white space, lower-cased.  An
item is present in a document if, with item and document aligned at some
offset, some ``WINDOW`` consecutive item tokens agree in at least
``LEAST_EQUAL`` places: up to three of fifteen tokens may be substituted.  Items
of fewer than ``WINDOW`` tokens are present if all their tokens stand in a row.

Candidate search: a mask fixes five positions of a short span and ignores the
rest.  Each item and document position is hashed under both masks and the
hashes are joined.  The two masks together hit every window with three or fewer
substitutions, so no such window is missed (the tests enumerate all patterns).
Short items have one seed, a hash of all their tokens; document positions are
hashed under the lengths that short items have.  A hit fixes an alignment; the
aligned tokens are compared and counted, one row a hit.

The item side is broadcast while it has at most ``BROADCAST_SEEDS`` rows;
beyond that the join shuffles both sides by seed hash.

Null texts count as empty.  Items without tokens or with a null id take no part.  Repeated document rows give repeated results, rows with a
null id are judged by their own text, an empty table on either side gives no
leak.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WINDOW = 15
LEAST_EQUAL = 12
#: Fixed masks: positions that count, from the hit's first token.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 7, 8))
BROADCAST_SEEDS = 1_000_000


def token_hashes(text: Column | str) -> Column:
    """Array of the tokens' 64-bit hashes."""
    words = F.split(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), "[\\x20\\x09-\\x0D]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(hashes: str, lengths: Sequence[int] = ()) -> Column:
    """Array of (hash, position) under every mask and for every whole length, for an array column of token hashes."""
    tokens = F.col(hashes)

    def over(width: int, seed: Callable[[Column], Column]) -> Column:
        at = lambda i: F.struct(seed(i).alias("seed"), i.alias("at"))
        places = F.size(tokens) - F.lit(width - 1)
        return F.when(places > 0, F.transform(F.sequence(F.lit(0), F.greatest(places - 1, F.lit(0))), at)).otherwise(F.array().cast("array<struct<seed:bigint,at:int>>"))

    masks = [over(mask[-1] + 1, lambda i, n=n, mask=mask: F.xxhash64(F.lit(n), *[F.get(tokens, i + k) for k in mask])) for n, mask in enumerate(MASKS)]
    return F.concat(*masks, *[over(n, lambda i, n=n: _whole(F.slice(tokens, i + 1, n))) for n in lengths])


def _whole(tokens: Column) -> Column:
    return F.xxhash64(F.lit("whole"), tokens)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``id_col, item_id``: each item present in each document, once; documents need a non-null id."""
    known = items.select(F.col(item_col).alias("_item"), token_hashes(item_text).alias("_part")).filter(F.col("_item").isNotNull() & (F.size("_part") > 0))
    short = known.filter(F.size("_part") < WINDOW)
    lengths = sorted(r[0] for r in short.select(F.size("_part")).distinct().collect())  # fewer than WINDOW values
    mark = lambda rows, s: rows.select("_item", F.size("_part").alias("_len"), s.alias("s"))
    marks = mark(known.filter(F.size("_part") >= WINDOW), F.explode(_seeds("_part")))
    if lengths:
        marks = marks.unionByName(mark(short, F.struct(_whole(F.col("_part")).alias("seed"), F.lit(0).alias("at"))))
    marks = marks.select("_item", "_len", F.col("s.seed").alias("seed"), F.col("s.at").alias("_from")).distinct()
    small = marks.count() <= BROADCAST_SEEDS
    own = docs.filter(F.col(id_col).isNotNull())
    seeds = own.select(id_col, token_hashes(text_col).alias("_tokens")).select(id_col, F.explode(_seeds("_tokens", lengths)).alias("s")).select(id_col, F.col("s.seed").alias("seed"), F.col("s.at").alias("_at"))
    hits = cut(seeds.join(F.broadcast(marks) if small else marks, "seed").select(id_col, "_item", "_len", (F.col("_at") - F.col("_from")).alias("_start")).distinct())
    # tokens once a document, then a row for each hit with its own stretch of them
    tokens = own.select(id_col, F.col(text_col).alias("_text")).join(hits.select(id_col).distinct(), id_col, "left_semi").select(id_col, token_hashes("_text").alias("_tokens"))
    stretch = F.transform(F.sequence(F.lit(0), F.col("_len") - 1), lambda k: F.get(F.col("_tokens"), F.col("_start") + k))
    rows = tokens.join(hits, id_col).select(id_col, "_item", stretch.alias("_own"))
    places = F.filter(F.sequence(F.lit(0), F.size("_part") - 1), lambda k: F.get(F.col("_own"), k) == F.get(F.col("_part"), k))
    compared = rows.join(F.broadcast(known) if small else known, "_item").select(id_col, "_item", places.alias("_same"), F.size("_part").alias("_len"))
    within = F.exists(F.sequence(F.lit(LEAST_EQUAL - 1), F.size("_same") - 1), lambda k: F.get(F.col("_same"), k) - F.get(F.col("_same"), k - (LEAST_EQUAL - 1)) < WINDOW)
    present = F.when(F.col("_len") < WINDOW, F.size("_same") == F.col("_len")).when(F.size("_same") >= LEAST_EQUAL, within)
    return compared.filter(present).select(id_col, F.col("_item").alias("item_id")).distinct()


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, contaminated, n_items, item_ids``: one row per document row; item_ids is comma-joined in ascending order."""
    found = leaks(docs, items, id_col, text_col).groupBy(id_col).agg(F.sort_array(F.collect_list("item_id")).alias("_items"))
    joined = docs.select(id_col).join(found, id_col, "left")
    return joined.select(id_col, F.col("_items").isNotNull().alias("contaminated"), F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.array_join("_items", ","), F.lit("")).alias("item_ids"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in whose text no item is present; rows with a null id stay."""
    return docs.join(leaks(docs, items, id_col, text_col).select(id_col).distinct(), id_col, "left_anti")


REPORT_SQL = f"""
WITH dw AS (
  SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS at FROM (
    SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k
    FROM (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+') AS ws FROM documents)) WHERE w <> ''),
bw AS (
  SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY k) AS at, count(*) OVER (PARTITION BY item_id) AS n FROM (
    SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k
    FROM (SELECT item_id, string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+') AS ws FROM benchmark)) WHERE w <> ''),
same AS (
  SELECT dw.doc_id, bw.item_id, dw.at - bw.at AS d, bw.at AS p, bw.n FROM dw JOIN bw ON dw.w = bw.w),
close AS (
  SELECT doc_id, item_id, n, p, lead(p, {LEAST_EQUAL - 1}) OVER (PARTITION BY doc_id, item_id, d ORDER BY p) AS q, count(*) OVER (PARTITION BY doc_id, item_id, d) AS m FROM same),
found AS (SELECT DISTINCT doc_id, item_id FROM close WHERE CASE WHEN n < {WINDOW} THEN m = n ELSE q - p < {WINDOW} END)
SELECT d.doc_id, count(f.item_id) > 0 AS contaminated, count(f.item_id) AS n_items,
  coalesce(string_agg(CAST(f.item_id AS VARCHAR), ',' ORDER BY f.item_id), '') AS item_ids
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY d.doc_id
"""
