"""Similar projects as classes and links between them, in place of all pairs.

Two projects are similar by the first rule that holds: the same organisation; one
plans what the other builds, and neither has an organisation; or sets of features
whose Jaccard similarity reaches a bar.  Projects that agree in all three respects
are one class.  An organisation's projects are all alike by one row, however many
they are; so are the two sides of the second rule; and sets of features are
compared once however many projects have them.

A blank or null organisation is none, a null kind is empty, features are distinct and
not null, a project without features has no partner by the third rule.  Repeated
projects count once, by their smallest row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import similar_by_sets
from .tables import cut

#: Scores of the first two rules, and the bar of the third.
SAME_ORGANISATION, PLAN_AND_BUILD, LEAST = 0.8, 0.7, 0.6


class Similar:
    """``members`` (item, class_id), ``classes`` (class_id, org, kind, set_id, size) and ``links`` (rule, a, b, score).

    A link of the rule ``organisation`` joins all of an organisation (``a`` = ``b``), one of ``sequence``
    all projects without organisation of two kinds, one of ``composition`` all projects with one or the other
    set of features; a set is linked with itself where it has two members.
    """

    def __init__(
        self, projects: DataFrame, features: DataFrame, item: str, org: str, kind: str, feature: str, plan: str, build: Sequence[str],
        least: float = LEAST, flat: float | None = None
    ) -> None:
        self.plan, self.build = plan, list(build)
        rows = projects.groupBy(F.col(item).alias("item")).agg(F.min(F.struct(F.coalesce(F.trim(org), F.lit("")).alias("org"), F.coalesce(kind, F.lit("")).alias("kind"))).alias("p"))
        own = features.filter(F.col(feature).isNotNull()).groupBy(F.col(item).alias("item")).agg(F.array_sort(F.collect_set(F.col(feature).cast("string"))).alias("set"))
        rows = rows.join(own, "item", "left").select("item", "p.org", "p.kind", F.coalesce("set", F.array().cast("array<string>")).alias("set"))
        rows = cut(rows)
        classes = rows.groupBy("org", "kind", "set").agg(F.min("item").alias("class_id"), F.count("*").alias("size"))
        sets = classes.filter(F.size("set") > 0).groupBy("set").agg(F.min("class_id").alias("set_id"), F.sum("size").alias("set_size"))
        self.classes = cut(classes.join(sets.select("set", "set_id"), "set", "left"))
        self.members = rows.join(self.classes.select("org", "kind", "set", "class_id"), ["org", "kind", "set"]).select("item", "class_id")
        near = similar_by_sets(sets.select("set_id", F.explode("set").alias("feature")), "set_id", "feature", least)
        self.near = cut(near.unionByName(sets.select(F.col("set_id").alias("a"), F.col("set_id").alias("b"), F.lit(1.0).alias("score"))))
        self.score = F.lit(flat) if flat is not None else F.round("score", 2)

    @property
    def links(self) -> DataFrame:
        c = self.classes
        orgs = c.filter("org <> ''").groupBy("org").agg(F.sum("size").alias("n")).filter("n > 1").select(
            F.lit("organisation").alias("rule"), F.col("org").alias("a"), F.col("org").alias("b"), F.lit(SAME_ORGANISATION).alias("score")
        )
        built = F.sort_array(F.collect_set(F.when(F.col("kind").isin(self.build), F.col("kind"))))
        free = c.filter("org = ''").agg(F.max(F.when(F.col("kind") == self.plan, F.col("kind"))).alias("a"), built.alias("built"))
        order = free.filter("a is not null").select(F.lit("sequence").alias("rule"), "a", F.explode("built").alias("b"), F.lit(PLAN_AND_BUILD).alias("score"))
        sizes = c.filter("set_id is not null").groupBy("set_id").agg(F.sum("size").alias("n"))
        sets = self.near.join(sizes, F.col("a") == F.col("set_id")).filter("a <> b or n > 1")
        return orgs.unionByName(order).unionByName(
            sets.select(F.lit("composition").alias("rule"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), self.score.alias("score"))
        )

    def _opposite(self, kind: Column, other: Column) -> Column:
        return ((kind == self.plan) & other.isin(*self.build)) | (kind.isin(*self.build) & (other == self.plan))

    def counts(self) -> DataFrame:
        """``item, class_id, by_organisation, by_sequence, by_composition``: how many partners each project has by the rule that counts for them."""
        c = self.classes
        orgs = c.filter("org <> ''").groupBy("org").agg((F.sum("size") - 1).alias("by_organisation"))
        free = c.filter("org = ''").groupBy(F.col("kind").alias("other")).agg(F.sum("size").alias("n"))
        kinds = c.filter("org = ''").select("kind").distinct().join(free, self._opposite(F.col("kind"), F.col("other"))).groupBy("kind").agg(F.sum("n").alias("by_sequence"))
        both = self.near.select("a", "b").unionByName(self.near.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        held = c.filter("set_id is not null").select(F.col("set_id").alias("b"), "org", F.col("kind").alias("other"), "size")
        around = both.join(held, "b")
        every = around.groupBy("a").agg(F.sum("size").alias("every"))
        # partners that an earlier rule has, by the sets that hold them
        same = around.filter("org <> ''").groupBy("a", "org").agg(F.sum("size").alias("same"))
        ways = around.filter((F.col("org") == "") & F.col("other").isin(self.plan, *self.build)).groupBy("a", "other").agg(F.sum("size").alias("n"))
        opposite = c.filter("org = '' and set_id is not null").select(F.col("set_id").alias("a"), "kind").distinct().join(ways, "a").filter(
            self._opposite(F.col("kind"), F.col("other"))
        ).groupBy("a", "kind").agg(F.sum("n").alias("turned"))
        n = lambda name: F.coalesce(name, F.lit(0))
        full = c.join(orgs, "org", "left").join(kinds, "kind", "left").withColumnRenamed("set_id", "a").join(every, "a", "left").join(same, ["a", "org"], "left").join(opposite, ["a", "kind"], "left")
        free_class = F.col("org") == ""
        rest = n("every") - F.when(free_class, n("turned") + F.when(F.col("a").isNotNull(), 1).otherwise(0)).otherwise(n("same"))
        made = full.select("class_id", n("by_organisation").alias("by_organisation"), F.when(free_class, n("by_sequence")).otherwise(0).alias("by_sequence"), rest.alias("by_composition"))
        return self.members.join(made, "class_id")

    def pairs(self) -> DataFrame:
        """``a, b, rule, score`` of all pairs a < b: for few projects, or a part of them."""
        m = self.members.join(self.classes.drop("set", "size"), "class_id")
        x, y = (m.select(*[F.col(n).alias(f"{p}_{n}") for n in ("item", "org", "kind", "set_id")]) for p in "xy")
        first = x.filter("x_org <> ''").join(y, (F.col("x_org") == F.col("y_org")) & (F.col("x_item") < F.col("y_item"))).select(
            "x_item", "y_item", F.lit("organisation").alias("rule"), F.lit(SAME_ORGANISATION).alias("score")
        )
        second = x.filter("x_org = ''").join(
            y, (F.col("x_org") == F.col("y_org")) & self._opposite(F.col("x_kind"), F.col("y_kind")) & (F.col("x_item") < F.col("y_item"))
        ).select("x_item", "y_item", F.lit("sequence").alias("rule"), F.lit(PLAN_AND_BUILD).alias("score"))
        both = self.near.select("a", "b", "score").unionByName(self.near.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
        third = x.join(both, F.col("x_set_id") == F.col("a")).join(y, (F.col("b") == F.col("y_set_id")) & (F.col("x_item") < F.col("y_item")))
        earlier = ((F.col("x_org") != "") & (F.col("x_org") == F.col("y_org"))) | ((F.col("x_org") == "") & (F.col("y_org") == "") & self._opposite(F.col("x_kind"), F.col("y_kind")))
        third = third.filter(~earlier).select("x_item", "y_item", F.lit("composition").alias("rule"), self.score.alias("score"))
        return first.unionByName(second).unionByName(third).withColumnsRenamed({"x_item": "a", "y_item": "b"})
