"""The star schema as a property graph, and queries on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from .registry import query, table

_N = """nodes AS (SELECT 'region:' || r_regionkey AS id, 'region' AS type, r_name AS label FROM region UNION ALL
SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation UNION ALL
SELECT 'customer:' || c_custkey, 'customer', c_name FROM customer UNION ALL
SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier)"""
_E = """edges AS (SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'IN_REGION' AS type FROM nation UNION ALL
SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'IN_NATION' FROM customer UNION ALL
SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'IN_NATION' FROM supplier)"""
GRAPH = f"WITH RECURSIVE {_N}, {_E}, both_ways AS (SELECT src AS a, dst AS b, type FROM edges UNION ALL SELECT dst, src, type FROM edges)"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"))
    out = None
    for kind, key, label in parts:
        one = table(spark, sf_dir, kind).select(F.concat(F.lit(f"{kind}:"), F.col(key)).alias("id"), F.lit(kind).alias("type"), F.col(label).alias("label"))
        out = one if out is None else out.unionByName(one)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (
        ("nation", "n_nationkey", "region", "n_regionkey", "IN_REGION"), ("customer", "c_custkey", "nation", "c_nationkey", "IN_NATION"),
        ("supplier", "s_suppkey", "nation", "s_nationkey", "IN_NATION")
    )
    out = None
    for kind, key, to, other, relation in parts:
        one = table(spark, sf_dir, kind).select(F.concat(F.lit(f"{kind}:"), F.col(key)).alias("src"), F.concat(F.lit(f"{to}:"), F.col(other)).alias("dst"), F.lit(relation).alias("type"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"{GRAPH} SELECT * FROM nodes")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).dropDuplicates(["id"])


@query(f"{GRAPH} SELECT DISTINCT src, dst, type, src || '->' || dst || ':' || type AS edge_id FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.with_endpoints(edges(spark, sf_dir), nodes(spark, sf_dir))


@query(f"{GRAPH} SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.type_counts(nodes(spark, sf_dir), edges(spark, sf_dir))


@query(f"{GRAPH} SELECT DISTINCT n.id, n.type, n.label, b.type AS edge_type FROM both_ways b JOIN nodes n ON n.id = b.b WHERE b.a = 'nation:3'")
def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbours(edges(spark, sf_dir), nodes(spark, sf_dir), "nation:3").select("id", "type", "label", "edge_type")


@query(f"""{GRAPH}, w(id, depth) AS (SELECT 'customer:1', 0 UNION SELECT b.b, w.depth + 1 FROM w JOIN both_ways b ON b.a = w.id WHERE w.depth < 3) SELECT id, min(depth) AS depth
FROM w GROUP BY id ORDER BY min(depth), id LIMIT 100""")
def graph_khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([("customer:1",)], "id string")
    return G.k_hop(edges(spark, sf_dir), seeds, 3, 100)


@query(
    f"""{GRAPH}, w(id, path, depth) AS (SELECT 'customer:1', ['customer:1'], 0 UNION ALL SELECT b.b, list_append(w.path, b.b), w.depth + 1 FROM w JOIN (SELECT DISTINCT a, b
FROM both_ways) b ON b.a = w.id WHERE w.depth < 4 AND NOT list_contains(w.path, b.b) AND (w.depth <> 1 OR b.b LIKE 'region:%') AND (w.depth <> 2 OR b.b LIKE 'nation:%')),
p AS (SELECT path FROM w WHERE id = (SELECT 'customer:' || min(y.c_custkey) FROM customer x JOIN nation n ON n.n_nationkey = x.c_nationkey
JOIN nation m ON m.n_regionkey = n.n_regionkey AND m.n_nationkey <> n.n_nationkey JOIN customer y ON y.c_nationkey = m.n_nationkey WHERE x.c_custkey = 1)
ORDER BY depth, path LIMIT 1) SELECT CAST(unnest(generate_series(0, len(path) - 1)) AS INTEGER) AS step, unnest(path) AS id FROM p"""
)
def graph_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first customer to the first one of another nation in the same region, over both nations and the region."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(
        table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    own = customers.filter("c_custkey = 1").select(F.col("n_nationkey").alias("_n"), F.col("n_regionkey").alias("_r"))
    other = customers.join(F.broadcast(own), (F.col("n_regionkey") == F.col("_r")) & (F.col("n_nationkey") != F.col("_n"))).agg(F.min("c_custkey")).head()[0]  # one row is broadcast
    return G.shortest_path(edges(spark, sf_dir), "customer:1", f"customer:{other}", 5)


@query(f"""{GRAPH}, w(id, depth) AS (SELECT 'region:0', 0 UNION SELECT b.b, w.depth + 1 FROM w JOIN both_ways b ON b.a = w.id WHERE w.depth < 5) SELECT
CAST(depth AS INTEGER) AS step, id FROM w WHERE id = 'region:1'""")
def graph_path_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions are not linked: there is no path between two of them over nations."""
    return G.shortest_path(edges(spark, sf_dir), "region:0", "region:1", 5)


@query(f"""{GRAPH} SELECT DISTINCT c.id, c.label FROM nodes c JOIN edges e ON e.src = c.id AND e.type = 'IN_NATION' JOIN nodes n ON n.id = e.dst AND n.type = 'nation'
JOIN edges f ON f.src = n.id AND f.type = 'IN_REGION' JOIN nodes r ON r.id = f.dst AND r.type = 'region' WHERE c.type = 'supplier' AND r.label = (SELECT r_name
FROM region WHERE r_regionkey = 1)""")
def graph_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "region").filter("r_regionkey = 1").select(F.col("r_name").alias("label"))
    own = nodes(spark, sf_dir)
    kept = own.filter("type <> 'region'").unionByName(own.filter("type = 'region'").join(wanted, "label", "left_semi"))
    return G.pattern(edges(spark, sf_dir), kept, [("supplier", "IN_NATION", "nation"), ("nation", "IN_REGION", "region")], 0).select("id", "label")


@query(f"{GRAPH} SELECT id, type FROM nodes WHERE contains(lower(label), '00001') ")
def node_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).filter(F.lower("label").contains("00001")).select("id", "type")


@query(f"{GRAPH} SELECT CASE WHEN src = 'nation:5' THEN dst ELSE src END AS id FROM edges WHERE src = 'nation:5' OR dst = 'nation:5'")
def edges_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edges(spark, sf_dir).filter((F.col("src") == "nation:5") | (F.col("dst") == "nation:5"))
    return found.select(F.when(F.col("src") == "nation:5", F.col("dst")).otherwise(F.col("src")).alias("id"))


_PT = """pt AS (SELECT DISTINCT n.n_nationkey AS item, o.o_orderpriority AS feature FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey
JOIN orders o ON o.o_custkey = c.c_custkey)"""


def priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which order priorities occur in which nation."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("item"), F.col("o_orderpriority").alias("feature")).distinct()


_PD = "pt AS (SELECT DISTINCT c.c_nationkey AS item, CAST(o.o_orderdate AS DATE) AS feature FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey)"


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On which days each nation ordered."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("feature"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("item"))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("item", "feature").distinct()


@query(f"""WITH {_PD}, z AS (SELECT item, count(*) AS n FROM pt GROUP BY item), s AS (SELECT x.item AS a, y.item AS b, count(*) AS k FROM pt x JOIN pt y ON x.feature = y.feature
AND x.item < y.item GROUP BY 1, 2) SELECT a, b, round(k / (p.n + q.n - k), 6) AS score FROM s JOIN z p ON p.item = a JOIN z q ON q.item = b
WHERE k / (p.n + q.n - k) >= 0.13""")
def similar_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.similar_by_sets(order_days(spark, sf_dir), "item", "feature", 0.13).select("a", "b", F.round("score", 6).alias("score"))


@query("SELECT x.n_nationkey AS a, y.n_nationkey AS b, CAST(0.8 AS DOUBLE) AS score FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey")
def same_organisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.same_value(table(spark, sf_dir, "nation").withColumn("org", F.col("n_regionkey").cast("string")), "n_nationkey", "org", 0.8)


@query(f"""WITH {_PT} SELECT item, 'all' AS how FROM pt WHERE feature IN ('1-URGENT', '2-HIGH') GROUP BY item HAVING count(DISTINCT feature) = 2 UNION ALL
SELECT DISTINCT item, 'any' FROM pt WHERE feature IN ('1-URGENT', '2-HIGH')""")
def tech_and_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, wanted = priorities(spark, sf_dir), ["1-URGENT", "2-HIGH"]
    return G.has_all(pairs, "item", "feature", wanted).withColumn("how", F.lit("all")).unionByName(G.has_any(pairs, "item", "feature", wanted).withColumn("how", F.lit("any")))


@query("""SELECT * FROM (SELECT o_custkey, o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS dst FROM orders)
WHERE dst IS NOT NULL""")
def doc_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sequence_edges(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderpriority", "o_orderkey"], "o_orderkey")


@query("""SELECT CASE WHEN x.n_nationkey = 4 THEN y.n_nationkey ELSE x.n_nationkey END AS id FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey
AND x.n_nationkey < y.n_nationkey WHERE x.n_nationkey = 4 OR y.n_nationkey = 4 ORDER BY 1 LIMIT 3""")
def similar_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of either direction, best first."""
    found = same_organisation(spark, sf_dir)
    either = found.select(F.col("a").alias("own"), F.col("b").alias("id"), "score").unionByName(found.select(F.col("b").alias("own"), F.col("a").alias("id"), "score"))
    return either.filter("own = 4").orderBy(F.desc("score"), "id").limit(3).select("id")


@query(
    f"""{GRAPH}, k AS (SELECT * FROM nodes ORDER BY id LIMIT 200) SELECT 'node' AS kind, CAST(json_object('id', id, 'type', type, 'label', label) AS VARCHAR) AS json FROM k
UNION ALL SELECT 'edge', CAST(json_object('src', src, 'dst', dst, 'type', type) AS VARCHAR) FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)"""
)
def graph_visual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON for display of at most 200 nodes and the edges among them."""
    return G.visual(nodes(spark, sf_dir), edges(spark, sf_dir), 200)
