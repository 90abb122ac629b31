"""Keys and references between tables, found in the data.

One pass over each table makes a sketch of the different values of each column,
with counts and limits.  A column whose sketch says that its values may all
differ is a candidate key; a column may refer to it if its limits lie within the
key's and the sketch of both together is no larger than the key's alone.  What the
sketches leave is settled exactly, for all pairs at once: each different value
carries the set of columns it occurs in, and these sets are counted.  What
reaches the driver grows with the number of columns, not of rows.

Whole numbers are compared with whole numbers and strings with strings; other
types take no part.  Nulls are no values: a column of nulls refers to nothing,
and a column with nulls is no key.  An empty table has neither.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut

#: log2 of a sketch's registers, and what an estimate may be off by (five standard errors).
LG_K = 12
ERROR = 5 * 1.04 / 2 ** (LG_K / 2)
#: Longer strings are compared by their digest.
LONGEST = 64
_NUMBERS = ("tinyint", "smallint", "int", "bigint")
_PROFILE = "t string, c string, class string, rows long, filled long, low string, high string, sketch binary"


def _value(name: str, kind: str) -> Column:
    value = F.col(f"`{name}`")
    if kind in _NUMBERS:
        return value.cast("string")
    return F.when(F.length(value) <= LONGEST, value).otherwise(F.concat(F.lit("sha256:"), F.sha2(value.cast("binary"), 256)))


def compared(table: DataFrame) -> list[tuple[str, str]]:
    """Columns that take part, and their class."""
    return [(n, "number" if k in _NUMBERS else "string") for n, k in table.dtypes if k in _NUMBERS or k == "string"]


def profile(name: str, table: DataFrame) -> DataFrame:
    """One row a column (``_PROFILE``), by one aggregation of the table."""
    kinds, made = dict(table.dtypes), []
    for column, kind in compared(table):
        value = F.col(f"`{column}`")
        # limits compare as numbers where they are ones, and are carried as text
        limits = [f(value.cast("long") if kind == "number" else F.substring(value, 1, LONGEST)).cast("string") for f in (F.min, F.max)]
        sketch = F.hll_sketch_agg(_value(column, kinds[column]), LG_K)
        made.append(
            F.struct(
                F.lit(name).alias("t"), F.lit(column).alias("c"), F.lit(kind).alias("class"), F.count("*").alias("rows"),
                F.count(value).alias("filled"), limits[0].alias("low"), limits[1].alias("high"), sketch.alias("sketch")
            )
        )
    if not made:
        return table.sparkSession.createDataFrame([], _PROFILE)
    return table.agg(F.array(*made).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def candidates(profiles: DataFrame) -> DataFrame:
    """``ct, cc, pt, pc``: references that the sketches do not rule out."""
    known = profiles.filter("filled > 0").withColumn("distinct", F.hll_sketch_estimate("sketch"))
    keys = known.filter((F.col("filled") == F.col("rows")) & (F.col("distinct") >= F.col("rows") * (1 - ERROR)))
    c, p = known.alias("c"), keys.alias("p")
    other = (F.col("c.t") != F.col("p.t")) | (F.col("c.c") != F.col("p.c"))
    number = F.col("c.class") == "number"
    within = lambda kind: (F.col("c.low").cast(kind) >= F.col("p.low").cast(kind)) & (F.col("c.high").cast(kind) <= F.col("p.high").cast(kind))
    inside = F.when(number, within("long")).otherwise(within("string"))
    both = F.hll_sketch_estimate(F.hll_union("c.sketch", "p.sketch"))
    met = c.join(p, (F.col("c.class") == F.col("p.class")) & other).filter(inside & (both <= F.col("p.distinct") * (1 + 2 * ERROR)))
    return met.select(F.col("c.t").alias("ct"), F.col("c.c").alias("cc"), F.col("p.t").alias("pt"), F.col("p.c").alias("pc"))


def references(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``child_table, child_column, parent_table, parent_column, n_child, n_parent, same_name``: every column whose values are all in a key.

    The counts are of different values; names are the same without their prefix up to the first underscore.
    """
    profiles = None
    for name, table in tables.items():
        own = profile(name, table)
        profiles = own if profiles is None else profiles.unionByName(own)
    profiles = cut(profiles)
    wanted = cut(candidates(profiles))
    pairs = [tuple(r) for r in wanted.collect()]  # at most columns squared
    columns = sorted({(t, c) for ct, cc, pt, pc in pairs for t, c in ((ct, cc), (pt, pc))})
    spark = profiles.sparkSession
    if not columns:
        return spark.createDataFrame([], "child_table string, child_column string, parent_table string, parent_column string, n_child long, n_parent long, same_name boolean")
    number = {column: i for i, column in enumerate(columns)}
    values = None
    for name, table in tables.items():
        kinds = dict(compared(table))
        own = [c for t, c in columns if t == name]
        if not own:
            continue
        held = F.array(*[F.struct(F.lit(number[name, c]).alias("col"), F.lit(kinds[c]).alias("class"), _value(c, dict(table.dtypes)[c]).alias("v")) for c in own])
        rows = table.select(F.explode(held).alias("x")).select("x.*").filter("v is not null").distinct()
        values = rows if values is None else values.unionByName(rows)
    sets = values.groupBy("class", "v").agg(F.array_sort(F.collect_set("col")).alias("cols"))  # a value's columns: no more than there are
    counted = cut(sets.groupBy("cols").agg(F.count("*").alias("n")))
    place = spark.createDataFrame([(*p, number[p[:2]], number[p[2:]]) for p in pairs], "ct string, cc string, pt string, pc string, child int, parent int")
    has = lambda c: F.array_contains("cols", F.col(c))
    met = F.broadcast(place).join(counted, has("child") | has("parent"))  # pairs of columns and sets of columns: both are bounded by the schema
    sums = met.groupBy(*place.columns).agg(
        F.sum(F.when(has("child"), F.col("n")).otherwise(0)).alias("n_child"),
        F.sum(F.when(has("parent"), F.col("n")).otherwise(0)).alias("n_parent"),
        F.sum(F.when(has("child") & ~has("parent"), F.col("n")).otherwise(0)).alias("outside")
    )
    rows_of = profiles.select(F.col("t").alias("pt"), F.col("c").alias("pc"), "rows")
    bare = lambda c: F.regexp_replace(c, "^[^_]*_", "")
    found = sums.join(rows_of, ["pt", "pc"]).filter((F.col("outside") == 0) & (F.col("n_parent") == F.col("rows")))
    return found.select(
        F.col("ct").alias("child_table"), F.col("cc").alias("child_column"), F.col("pt").alias("parent_table"), F.col("pc").alias("parent_column"),
        "n_child", "n_parent", (bare("cc") == bare("pc")).alias("same_name")
    )
