"""Concept graphs as node and edge tables: expansion, paths, degrees, merging and ranks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from textloom.functions.overlaps import numbered
from textloom.plans.registry import query
from textloom.session import table, written

#: The graph: every supplier (s...) and part (p...) of ``lineitem``.
_EDGES = "edges AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem)"
_BOTH = _EDGES + ", g AS (SELECT a AS x, b AS y FROM edges UNION SELECT b, a FROM edges)"


def all_edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b")).distinct()


def graph_query(name: str, sql: str) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Register a function of edges as ``name`` over the whole graph."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        query(name, sql)(lambda spark, d: f(all_edges(spark, d)))
        return f

    return add


def undirected(edges: DataFrame) -> DataFrame:
    e = edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
    return e.union(e.select("y", "x")).distinct()


def expand(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """``node`` and ``distance`` of all nodes within ``hops`` of the start nodes, each at its least distance."""
    g = written(undirected(edges), "graph")
    seen = start.select(F.col("node"), F.lit(0).alias("distance"))
    front = seen
    for h in range(1, hops + 1):
        near = g.join(front.select(F.col("node").alias("x")), "x", "left_semi").select(F.col("y").alias("node")).distinct()
        front = written(near.join(seen, "node", "left_anti").withColumn("distance", F.lit(h)), "frontier")
        seen = seen.union(front)
    return seen


@graph_query("graph_two_hop", f"""
WITH {_BOTH}, h1 AS (SELECT DISTINCT y FROM g WHERE x = (SELECT min(a) FROM edges)), h2 AS (SELECT DISTINCT y FROM g WHERE x IN (SELECT y FROM h1)),
n AS (SELECT min(a) AS node, 0 AS distance FROM edges UNION ALL SELECT y, 1 FROM h1 UNION ALL SELECT y, 2 FROM h2) SELECT node, min(distance) AS distance FROM n GROUP BY 1""")
def graph_two_hop(e: DataFrame) -> DataFrame:
    return expand(e, e.agg(F.min("a").alias("node")), 2)


@graph_query("graph_shortest_path", f"""
WITH RECURSIVE {_BOTH}, walk(node, distance) AS (
  SELECT min(a), 0 FROM edges UNION SELECT y, distance + 1 FROM walk JOIN g ON x = node WHERE distance < 4)
SELECT node, min(distance) AS distance FROM walk GROUP BY 1""")
def graph_shortest_path(e: DataFrame) -> DataFrame:
    return expand(e, e.agg(F.min("a").alias("node")), 4)


@graph_query("ego_graph", f"""
WITH {_BOTH}, f AS (SELECT min(a) AS x FROM edges), n AS (SELECT y AS node FROM g JOIN f USING (x) UNION SELECT x FROM f)
SELECT g.x AS src, g.y AS dst, (SELECT count(*) FROM g k WHERE k.x = g.x) AS degree FROM g WHERE g.x IN (SELECT node FROM n) AND g.y IN (SELECT node FROM n)""")
def ego_graph(e: DataFrame) -> DataFrame:
    g = written(undirected(e), "graph")
    focus = e.agg(F.min("a").alias("x"))
    nodes = g.join(F.broadcast(focus), "x").select(F.col("y").alias("node")).union(focus)
    degree = g.groupBy("x").agg(F.count("*").alias("degree"))
    inside = g.join(nodes.select(F.col("node").alias("x")), "x", "left_semi").join(nodes.select(F.col("node").alias("y")), "y", "left_semi")
    return inside.join(degree, "x").select(F.col("x").alias("src"), F.col("y").alias("dst"), "degree")


@graph_query("degree_top", f"WITH {_BOTH} SELECT x AS node, count(*) AS degree FROM g GROUP BY 1 ORDER BY degree DESC, node LIMIT 10")
def degree_top(e: DataFrame) -> DataFrame:
    return undirected(e).groupBy(F.col("x").alias("node")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(10)


#: Trade between nations: who buys from whom, with the number of lines.
_TRADE = """trade AS (SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)"""


def trade(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    buyer = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("a"))
    seller = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("b"))
    rows = lines.join(buyer, F.col("l_orderkey") == F.col("o_orderkey")).join(seller, F.col("l_suppkey") == F.col("s_suppkey")).where("a <> b")
    return rows.groupBy("a", "b").agg(F.count("*").alias("n"))


@query("graph_triangles", f"""
WITH {_TRADE}, u AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM trade)
SELECT count(*) AS triangles FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b""")
def graph_triangles(spark: SparkSession, d: str) -> DataFrame:
    pairs = written(trade(spark, d).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "trade")
    y, z = pairs.select(F.col("a").alias("b"), F.col("b").alias("c")), pairs.select("a", F.col("b").alias("c"))
    return pairs.join(y, "b").join(z, ["a", "c"]).agg(F.count("*").alias("triangles"))


#: Least path (as text) among the shortest ones of up to four hops, level by level.
_HOPS = 4
_PATHS = f"WITH {_BOTH}, p0 AS (SELECT min(a) AS node, min(a) AS path FROM edges), s0 AS (SELECT * FROM p0)" + "".join(
    f", p{i} AS (SELECT y AS node, min(path || '>' || y) AS path FROM p{i - 1} JOIN g ON x = node WHERE y NOT IN (SELECT node FROM s{i - 1}) GROUP BY 1), s{i} AS (SELECT * FROM s{i - 1} UNION ALL SELECT * FROM p{i})" for i in range(1, _HOPS + 1))


@graph_query("graph_path_nodes", f"{_PATHS} SELECT node, path, CAST(len(string_split(path, '>')) - 1 AS BIGINT) AS hops FROM s{_HOPS}")
def graph_path_nodes(e: DataFrame) -> DataFrame:
    """The shortest path itself, the least of equals, from the first supplier to every node within four hops."""
    g = written(undirected(e), "graph")
    seen = front = e.agg(F.min("a").alias("node")).withColumn("path", F.col("node"))
    for _ in range(_HOPS):
        near = g.join(front, g["x"] == front["node"]).groupBy(F.col("y").alias("node")).agg(F.min(F.concat("path", F.lit(">"), "y")).alias("path"))
        front = written(near.join(seen.select("node"), "node", "left_anti"), "frontier")
        seen = seen.union(front)
    return seen.select("node", "path", (F.size(F.split("path", ">")) - 1).cast("long").alias("hops"))


def pagerank(edges: DataFrame, rounds: int, damping: float = 0.85) -> DataFrame:
    """``node`` and ``rank`` after a number of rounds over weighted edges ``a``, ``b``, ``n``; ranks start at 1."""
    out = edges.groupBy("a").agg(F.sum("n").alias("total"))
    share = written(edges.join(out, "a").select("a", "b", (F.col("n") / F.col("total")).alias("p")), "shares")
    nodes = share.select(F.col("a").alias("node")).union(share.select("b")).distinct()
    ranks = nodes.withColumn("rank", F.lit(1.0))
    for _ in range(rounds):
        gained = share.join(ranks.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.sum(F.col("p") * F.col("rank")).alias("g"))
        ranks = written(nodes.join(gained, "node", "left").select("node", (1 - damping + damping * F.coalesce("g", F.lit(0.0))).alias("rank")), "ranks")
    return ranks


_ROUNDS = 3
_PAGERANK = f"WITH {_TRADE}, s AS (SELECT a, b, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY a) AS p FROM trade), r0 AS (SELECT DISTINCT a AS node, 1.0::DOUBLE AS rank FROM (SELECT a FROM s UNION SELECT b FROM s))" + "".join(
    f", r{i + 1} AS (SELECT r0.node, 0.15 + 0.85 * coalesce(g.g, 0) AS rank FROM r0 LEFT JOIN (SELECT b AS node, sum(p * rank) AS g FROM s JOIN r{i} ON node = a GROUP BY 1) g USING (node))" for i in range(_ROUNDS))


@query("pagerank", f"{_PAGERANK} SELECT node, round(rank, 6) AS rank FROM r{_ROUNDS}")
def pagerank_query(spark: SparkSession, d: str) -> DataFrame:
    return pagerank(trade(spark, d), _ROUNDS).select("node", F.round("rank", 6).alias("rank"))


#: Rows of pairs that one task makes and counts.
PAIR_ROWS = 4_000_000


@graph_query("shared_concept_pairs", f"WITH {_EDGES} SELECT x.a AS a, y.a AS b, count(*) AS shared FROM edges x JOIN edges y ON x.b = y.b AND x.a < y.a GROUP BY 1, 2 HAVING count(*) >= 2")
def shared_concept_pairs(e: DataFrame) -> DataFrame:
    return shared_pairs(e)


def shared_pairs(edges: DataFrame, rows: int = PAIR_ROWS) -> DataFrame:
    """``a``, ``b`` and ``shared``: nodes ``a`` of distinct edges that have two or more nodes ``b`` in common.

    Each edge takes the rest of its list along as one row, dealt by its node, so a pair is counted where
    it is made: no rows of pairs are shuffled, and a task makes about ``rows`` of them, however large the graph.
    """
    e = written(edges.where("a IS NOT NULL AND b IS NOT NULL"), "edges")
    ids, _ = numbered(e.select(F.col("a").alias("name")).distinct())
    listed = e.join(ids.withColumnRenamed("name", "a"), "a").groupBy("b").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    listed = written(listed.where(F.size("ids") > 1).select("ids"), "lists")
    n = listed.agg(F.sum(F.size("ids") * (F.size("ids") - F.lit(1).cast("long")) / 2)).first()[0] or 0
    rests = listed.select("ids", F.posexplode("ids").alias("i", "x")).where(F.col("i") < F.size("ids") - 1).select("x", F.slice("ids", F.col("i") + 2, F.size("ids")).alias("rest"))
    pairs = rests.repartition(max(1, -(-int(n) // rows)), "x").select("x", F.explode("rest").alias("y")).groupBy("x", "y").agg(F.count("*").alias("shared")).where("shared >= 2")
    named = lambda k: ids.select(F.col("id").alias(k), F.col("name").alias(f"name_{k}"))
    return pairs.join(named("x"), "x").join(named("y"), "y").select(F.least("name_x", "name_y").alias("a"), F.greatest("name_x", "name_y").alias("b"), "shared")


@query("concept_merge", """
SELECT lower(trim(p_brand)) AS concept, count(*) AS mentions, round(max(p_retailprice), 2) AS confidence, array_to_string(list_sort(list(DISTINCT p_type)), '|') AS aliases FROM part GROUP BY 1""")
def concept_merge(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.lower(F.trim("p_brand")).alias("concept")).agg(
        F.count("*").alias("mentions"), F.round(F.max("p_retailprice"), 2).alias("confidence"), F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("aliases"))


@query("edge_dedup", """
SELECT l_suppkey, l_partkey, l_returnflag AS predicate, max(l_discount) AS confidence, count(DISTINCT l_orderkey) AS evidence, bool_or(l_linestatus = 'O') AS bidirectional FROM lineitem GROUP BY 1, 2, 3""")
def edge_dedup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey", F.col("l_returnflag").alias("predicate")).agg(
        F.max("l_discount").alias("confidence"), F.countDistinct("l_orderkey").alias("evidence"), F.bool_or(F.col("l_linestatus") == "O").alias("bidirectional"))


@query("edge_conflicts", f"WITH {_TRADE} SELECT a, b, n FROM trade t WHERE NOT EXISTS (SELECT 1 FROM trade r WHERE r.a = t.b AND r.b = t.a AND r.n > t.n)")
def edge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    t = written(trade(spark, d), "trade")
    r = t.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("rn"))
    return t.join(r, ["a", "b"], "left").where("rn IS NULL OR rn <= n").select("a", "b", "n")


@query("doc_pair_score", f"""
WITH {_TRADE}, p AS (SELECT least(a, b) AS a, greatest(a, b) AS b, sum(n) AS n, count(*) AS k FROM trade GROUP BY 1, 2), s AS (SELECT a AS node, sum(n) AS t FROM trade GROUP BY 1)
SELECT p.a, p.b, CAST(p.n AS BIGINT) AS n, round(0.85 * p.n / p.k / 1000 + 0.15 * p.n / sqrt(x.t * y.t * 1.0), 6) AS score FROM p JOIN s x ON x.node = p.a JOIN s y ON y.node = p.b WHERE p.n >= 5""")
def doc_pair_score(spark: SparkSession, d: str) -> DataFrame:
    t = written(trade(spark, d), "trade")
    p = t.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).where("n >= 5")
    s = t.groupBy("a").agg(F.sum("n").alias("t"))
    p = p.join(s.withColumnRenamed("t", "ta"), "a").join(s.select(F.col("a").alias("b"), F.col("t").alias("tb")), "b")
    return p.select("a", "b", "n", F.round(0.85 * F.col("n") / F.col("k") / 1000 + 0.15 * F.col("n") / F.sqrt(F.col("ta") * F.col("tb").cast("double")), 6).alias("score"))


@query("duplicate_rewire", """
WITH k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS keep FROM documents)
SELECT l.doc_id, k.keep, l.quality FROM labels l JOIN k ON l.doc_id = k.doc_id WHERE k.keep <> l.doc_id""")
def duplicate_rewire(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    keep = h.join(h.groupBy("h").agg(F.min("doc_id").alias("keep")), "h").where("keep <> doc_id").select("doc_id", "keep")
    return table(spark, d, "labels").join(keep, "doc_id").select("doc_id", "keep", "quality")


@query("related_top", f"""
WITH {_TRADE}, r AS (SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS i FROM trade) SELECT a, b, n, round(power(0.5, i), 6) AS decay FROM r WHERE i <= 5""")
def related_top(spark: SparkSession, d: str) -> DataFrame:
    r = trade(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b")))
    return r.where("i <= 5").select("a", "b", "n", F.round(F.pow(F.lit(0.5), F.col("i")), 6).alias("decay"))
