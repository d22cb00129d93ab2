"""Graph algorithms by rounds of joins: components, communities, weighted paths, betweenness.

Each round is written out, so lineage stays short and a lost executor costs one round.
Nothing of a graph reaches the driver but counts and least distances.  Hubs are joined
by keys that adaptive execution splits, and met by partial sums before a shuffle.
"""

from __future__ import annotations

from math import inf

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.operators.graphs import _EDGES, _TRADE, trade
from textloom.plans.registry import query
from textloom.session import table, written


# components


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``entity``, the least node that links reach, for each node of ``links``; a null end links nothing.

    Stars are made larger and smaller in turn: a node's greater neighbours, then its
    smaller ones, are hung on the least node around it.  Chains halve, so rounds follow the
    logarithm of the longest one.
    """
    x, y = F.col(a), F.col(b)
    nodes = links.select(x.alias("node")).union(links.select(y)).where("node IS NOT NULL").distinct()
    pairs = written(links.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where(x.isNotNull() & y.isNotNull() & (x != y)).distinct(), "links")
    mark = None
    while True:
        both = pairs.select("u", "v").union(pairs.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        pairs = written(small.where("u <> v").distinct(), "small-stars")
        seen = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return nodes.join(pairs.select(F.col("u").alias("node"), F.col("v").alias("entity")), "node", "left").select("node", F.coalesce("entity", "node").alias("entity"))
        mark = seen


#: Parts are concepts; name and brand, or name, kind and size, are identities that they share.
_LINKS = """ids AS (SELECT p_partkey AS p, unnest([p_name || '|' || p_brand, p_name || '|' || p_type || '|' || p_size]) AS q FROM part),
links AS (SELECT p AS a, min(p) OVER (PARTITION BY q) AS b FROM ids), ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
same(node, entity) USING KEY (node) AS (SELECT p_partkey, p_partkey FROM part UNION
  SELECT w.b, min(s.entity) FROM same s JOIN ways w ON w.a = s.node JOIN recurring.same r ON r.node = w.b GROUP BY w.b HAVING min(s.entity) < min(r.entity))"""


def identity_links(rows: DataFrame, key: str, identities: list[Column]) -> DataFrame:
    """Links ``a``, ``b`` between rows that share an identity: each row with the least of its group, so that a group of n gives n links."""
    ids = written(rows.select(F.col(key).alias("a"), F.explode(F.array_distinct(F.array(*identities))).alias("q")).where("q IS NOT NULL"), "identities")
    return ids.join(ids.groupBy("q").agg(F.min("a").alias("b")), "q").select("a", "b").distinct()


def part_entities(spark: SparkSession, d: str) -> DataFrame:
    text = lambda *c: F.concat(*[x for k in c for x in (F.lit("|"), F.col(k).cast("string"))])
    return components(identity_links(table(spark, d, "part"), "p_partkey", [text("p_name", "p_brand"), text("p_name", "p_type", "p_size")]))


@query("same_as_closure", f"WITH RECURSIVE {_LINKS} SELECT node AS concept, entity, count(*) OVER (PARTITION BY entity) AS n_concepts FROM same")
def same_as_closure(spark: SparkSession, d: str) -> DataFrame:
    """Every concept with its entity: all concepts that a chain of shared identities leads to."""
    same = written(part_entities(spark, d), "entities")
    return same.join(same.groupBy("entity").agg(F.count("*").alias("n_concepts")), "entity").select(F.col("node").alias("concept"), "entity", "n_concepts")


@query("entity_documents", f"""
WITH RECURSIVE {_LINKS} SELECT entity, count(DISTINCT node) AS n_concepts, count(DISTINCT l_orderkey) AS n_documents, count(*) AS mentions FROM same JOIN lineitem ON l_partkey = node GROUP BY 1""")
def entity_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents (orders) that mention any concept of an entity."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("node"), "l_orderkey").agg(F.count("*").alias("n"))
    named = lines.join(part_entities(spark, d), "node")
    docs = named.groupBy("entity", "l_orderkey").agg(F.sum("n").alias("n")).groupBy("entity").agg(F.count("*").alias("n_documents"), F.sum("n").alias("mentions"))
    concepts = named.select("entity", "node").distinct().groupBy("entity").agg(F.count("*").alias("n_concepts"))
    return docs.join(concepts, "entity").select("entity", "n_concepts", "n_documents", "mentions")


# communities

#: Least gain that moves a node, or keeps a pass; passes over a level's nodes, classes of nodes that move in turn, and levels of contraction.
GAIN, PASSES, CLASSES, LEVELS = 1e-9, 40, 64, 10


def modularity(edges: DataFrame, member: DataFrame, total: float | None = None) -> float:
    """Modularity of communities (``node``, ``comm``) over undirected edges ``x``, ``y``, ``w``, each given both ways; a loop once, with twice its weight; ``total`` is the sum of ``w``, where it is known."""
    if total is None:
        total = edges.agg(F.sum("w")).first()[0]
    if not total:
        return 0.0
    known = edges.join(member.select(F.col("node").alias("x"), F.col("comm").alias("cx")), "x").join(member.select(F.col("node").alias("y"), F.col("comm").alias("cy")), "y")
    sums = known.groupBy("cx").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("cx") == F.col("cy"), F.col("w")).otherwise(0.0)).alias("inside"))
    return sums.agg(F.sum(F.col("inside") / total - (F.col("k") / total) ** 2)).first()[0]


def louvain(edges: DataFrame, a: str = "a", b: str = "b", weight: str = "w") -> tuple[DataFrame, float]:
    """Communities (``node``, ``community``, its least node) and their modularity, of weighted undirected edges.

    A pass lets the nodes of one class (of two, by checksum, at first) join the neighbouring
    community with the greatest gain in modularity (ties: the least name).  Nodes that move at
    once may spoil each other's gain: a pass that lowers the modularity is undone, and there
    are twice as many classes from then on.  Passes end when no class moves; communities
    become the nodes of the next level, until a level gains nothing.  Edges between the same nodes add up; a null end,
    and a weight that isn't above zero, count nothing.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y"), F.col(weight).cast("double").alias("w")).where("x IS NOT NULL AND y IS NOT NULL AND w > 0")
    # a loop stands for itself both ways
    graph = written(pairs.union(pairs.select("y", "x", "w")).groupBy("x", "y").agg(F.sum("w").alias("w")), "graph")
    total = graph.agg(F.sum("w")).first()[0]
    member = written(graph.select(F.col("x").alias("node")).distinct().withColumn("comm", F.col("node")), "members")
    if not total:
        return member.select("node", F.col("comm").alias("community")), 0.0
    first, best, level = graph, modularity(graph, member, total), graph
    for _ in range(LEVELS):
        moved = _passes(level, total)
        named = written(member.join(moved.select(F.col("node").alias("comm"), F.col("comm").alias("up")), "comm").select("node", F.col("up").alias("comm")), "members")
        now = modularity(first, named, total)
        if now <= best + GAIN:
            break
        member, best = named, now
        ends = moved.select(F.col("node").alias("x"), F.col("comm").alias("cx")), moved.select(F.col("node").alias("y"), F.col("comm").alias("cy"))
        level = written(level.join(ends[0], "x").join(ends[1], "y").groupBy(F.col("cx").alias("x"), F.col("cy").alias("y")).agg(F.sum("w").alias("w")), "contracted")
    least = member.groupBy("comm").agg(F.min("node").alias("community"))
    return member.join(least, "comm").select("node", "community"), best


def _passes(graph: DataFrame, total: float) -> DataFrame:
    """``node`` and ``comm`` after the moves of one level; each node starts as its own community.

    What a node would do follows from the communities alone, so all nodes are asked at once, and the
    answers hold until a pass is kept: a class without a node that would move costs no job, any other
    one table and its sums.
    """
    nodes = graph.groupBy(F.col("x").alias("node")).agg(F.sum("w").alias("k")).withColumn("class", F.crc32(F.col("node").cast("string").cast("binary")) % CLASSES)
    loops, others = graph.where("x = y").agg(F.sum("w")).first()[0] or 0.0, graph.where("x <> y")

    def asked(state: DataFrame) -> tuple[DataFrame, float, list[int]]:
        answers = written(_asked(state, others, total), "state")
        inside, squares, turns = answers.agg(F.sum("inside"), F.sum(F.col("k") * F.col("tot")), F.collect_set(F.when(F.col("to").isNotNull(), F.col("class")))).first()
        return answers, (inside + loops) / total - squares / total**2, turns

    state, now, turns = asked(written(nodes.withColumn("comm", F.col("node")), "nodes"))
    quiet, classes = 0, 2
    for k in range(PASSES):
        if any(c % classes == k % classes for c in turns):
            comm = F.when(F.col("class") % classes == k % classes, F.coalesce("to", "comm")).otherwise(F.col("comm"))
            changed, after, then = asked(state.select("node", "k", "class", comm.alias("comm")))
            if after > now + GAIN:
                state, now, turns, quiet = changed, after, then, 0
            elif classes < CLASSES:
                classes, quiet = classes * 2, 0
            else:
                quiet += 1
        else:
            quiet += 1
        if quiet == classes:
            break
    return state.select("node", "comm")


def _asked(state: DataFrame, others: DataFrame, total: float) -> DataFrame:
    """``state`` (``node``, its weight ``k``, ``class`` and ``comm``) with ``to``, the community that the node would gain by joining, else null, its weight ``inside`` its own and that one's ``tot``."""
    weight = state.groupBy("comm").agg(F.sum("k").alias("tot"))
    links = others.join(state.select(F.col("node").alias("y"), "comm"), "y").groupBy(F.col("x").alias("node"), "comm").agg(F.sum("w").alias("link"))
    links = links.union(state.select("node", "comm", F.lit(0.0))).groupBy("node", "comm").agg(F.sum("link").alias("link"))
    at = state.select("node", "k", "class", F.col("comm").alias("home"))
    stays = F.col("comm") == F.col("home")
    gain = F.col("link") - F.col("k") * (F.col("tot") - F.when(stays, F.col("k")).otherwise(0.0)) / total
    scored = links.join(at, "node").join(weight, "comm").withColumn("gain", F.round(gain, 9))
    # of equal gains the home first, then the least name
    here = [F.max(F.when(stays, F.col(c))).alias(n) for c, n in (("gain", "stay"), ("link", "inside"), ("tot", "tot"))]
    best = scored.groupBy("node", "k", "class", "home").agg(*here, F.min(F.struct((-F.col("gain")).alias("g"), "comm")).alias("top"))
    return best.select("node", "k", "class", F.col("home").alias("comm"), F.when(-F.col("top.g") > F.col("stay") + GAIN, F.col("top.comm")).alias("to"), "inside", "tot")


@query("trade_communities", None)
def trade_communities(spark: SparkSession, d: str) -> DataFrame:
    """Nations in communities of those that trade with each other most, of the edges above the mean, with the modularity."""
    member, q = louvain(strong_trade(spark, d), "a", "b", "n")
    return member.join(member.groupBy("community").agg(F.count("*").alias("size")), "community").select("node", "community", "size", F.lit(round(q, 9)).alias("modularity"))


# weighted paths


def shortest_distances(edges: DataFrame, start: DataFrame, delta: float, most: float = inf) -> DataFrame:
    """``node`` and ``distance`` from the nearest start node, over edges ``x``, ``y``, ``w`` (given for each way), up to ``most``.

    Delta-stepping: nodes are settled by buckets of distances, ``delta`` wide.  Edges up to
    ``delta`` are relaxed until the bucket is at rest, longer ones once for all that it has
    settled.  Both kinds are written apart, as they come: of edges between the same nodes the
    least offer counts, so they need not be grouped.  A null or negative weight is no edge.
    """
    edges = edges.where("x IS NOT NULL AND y IS NOT NULL AND w >= 0").select("x", "y", "w")
    light, heavy = written(edges.where(F.col("w") <= delta), "light"), written(edges.where(F.col("w") > delta), "heavy")
    known = written(start.select("node", F.lit(0.0).alias("distance"), F.lit(True).alias("fresh")).distinct(), "distances")
    done = -1
    while True:
        least = known.where(F.col("distance") >= (done + 1) * delta).agg(F.min("distance")).first()[0]
        if least is None or least > most:
            return known.where(F.col("distance") <= most).select("node", "distance")
        done = int(least // delta)
        inside = F.col("distance") < (done + 1) * delta
        front = known.where(inside & (F.col("distance") >= done * delta)).select("node", "distance")
        while front.head(1):
            known, front = _relax(known, front, light, inside & F.col("fresh"))
        settled = known.where(inside & (F.col("distance") >= done * delta)).select("node", "distance")
        known, _ = _relax(known, settled, heavy, F.lit(False))


def _relax(known: DataFrame, front: DataFrame, edges: DataFrame, again: Column) -> tuple[DataFrame, DataFrame]:
    """``known`` after the edges of ``front``, and the nodes that got nearer and are to be relaxed again."""
    offers = front.withColumnRenamed("node", "x").join(edges, "x").groupBy(F.col("y").alias("node")).agg(F.min(F.col("distance") + F.col("w")).alias("offer"))
    nearer = F.coalesce(F.col("offer") < F.coalesce("distance", F.lit(inf)), F.lit(False))
    known = written(known.drop("fresh").join(offers, "node", "full").select("node", F.least("distance", "offer").alias("distance"), nearer.alias("fresh")), "distances")
    return known, known.where(again).select("node", "distance")


_WAYS = _EDGES.replace("DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b", "'s' || l_suppkey AS a, 'p' || l_partkey AS b, min(l_quantity) AS w").replace("FROM lineitem)", "FROM lineitem GROUP BY 1, 2)")


@query("weighted_distances", f"""
WITH RECURSIVE {_WAYS}, g AS (SELECT a AS x, b AS y, w FROM edges UNION ALL SELECT b, a, w FROM edges),
d(node, distance) USING KEY (node) AS (SELECT min(a), 0.0::DOUBLE FROM edges UNION
  SELECT g.y, min(d.distance + g.w) FROM d JOIN g ON g.x = d.node LEFT JOIN recurring.d r ON r.node = g.y GROUP BY g.y HAVING min(d.distance + g.w) < coalesce(min(r.distance), 1e300))
SELECT node, distance FROM d""")
def weighted_distances(spark: SparkSession, d: str) -> DataFrame:
    """Least total quantity on a way from the first supplier to each supplier and part, over the smallest line of each pair.

    Nodes are numbers on the way, twice the key and one more for a part, as they are read and joined in each round; names where a key is too large for that.
    """
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("s"), F.col("l_partkey").cast("long").alias("p"), F.col("l_quantity").alias("w"))
    least, most = lines.agg(F.min(F.least("s", "p")), F.max(F.greatest("s", "p"))).first()
    numbers = least is None or -(1 << 62) <= least and most < 1 << 62
    if numbers:
        ends = F.shiftleft("s", 1), F.shiftleft("p", 1).bitwiseOR(F.lit(1))
        name = F.concat(F.when(F.col("node").bitwiseAND(F.lit(1)) == 0, "s").otherwise("p"), F.shiftright("node", 1))
    else:
        ends, name = (F.concat(F.lit("s"), "s"), F.concat(F.lit("p"), "p")), F.col("node")
    edges = lines.select(ends[0].alias("x"), ends[1].alias("y"), "w")
    start = lines.where("s IS NOT NULL").groupBy().agg(F.min_by("s", F.concat(F.lit("s"), "s")).alias("s")).select(ends[0].alias("node"))
    return shortest_distances(edges.union(edges.select("y", "x", "w")), start, 4.0).select(name.alias("node"), "distance")


# betweenness


def betweenness(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``node`` and ``betweenness``: over all ``sources`` (``node``), the shares of shortest paths to other nodes that pass it; edges ``x``, ``y``.

    Brandes' algorithm for all sources at once: breadth-first levels count the shortest
    paths, then the levels are gone back and each node passes its share to the nodes before
    it.  Rounds are twice the longest shortest path; a level holds a row for each source and
    node at that distance.
    """
    g = written(edges.select("x", "y").where("x IS NOT NULL AND y IS NOT NULL AND x <> y").distinct(), "graph")
    levels = [written(sources.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(1.0).alias("paths")).distinct(), "level")]
    seen = levels[0].select("s", "v")
    while True:
        reached = levels[-1].join(g, F.col("v") == F.col("x")).groupBy("s", F.col("y").alias("v")).agg(F.sum("paths").alias("paths"))
        level = written(reached.join(seen, ["s", "v"], "left_anti"), "level")
        if not level.head(1):
            break
        levels.append(level)
        seen = seen.union(level.select("s", "v"))
    shares, back = [], None
    for level in reversed(levels):
        if back is not None:
            given = level.join(g, F.col("v") == F.col("x")).join(back.select("s", F.col("v").alias("y"), F.col("paths").alias("p"), F.col("share").alias("q")), ["s", "y"])
            given = given.groupBy("s", "v").agg(F.sum(F.col("paths") / F.col("p") * (1 + F.col("q"))).alias("share"))
            level = level.join(given, ["s", "v"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
        else:
            level = level.withColumn("share", F.lit(0.0))
        back = written(level, "shares")
        shares.append(back)
    every = shares[0]
    for x in shares[1:]:
        every = every.unionByName(x)
    passed = every.where("s <> v").groupBy(F.col("v").alias("node")).agg(F.sum("share").alias("share"))
    nodes = g.select(F.col("x").alias("node")).union(g.select("y")).distinct()
    return nodes.join(passed, "node", "left").select("node", F.coalesce("share", F.lit(0.0)).alias("betweenness"))


def strong_trade(spark: SparkSession, d: str) -> DataFrame:
    """Trade between nations, of the edges that have more lines than the mean."""
    t = written(trade(spark, d), "trade")
    return t.join(F.broadcast(t.agg(F.avg("n").alias("mean"))), F.col("n") > F.col("mean")).select("a", "b", "n")


@query("trade_betweenness", f"""
WITH RECURSIVE {_TRADE}, g AS (SELECT a, b FROM trade WHERE n > (SELECT avg(n) FROM trade)), nodes AS (SELECT a AS v FROM g UNION SELECT b FROM g),
dist(s, v, d) USING KEY (s, v) AS (SELECT v, v, 0 FROM nodes UNION SELECT dist.s, g.b, min(dist.d) + 1 FROM dist JOIN g ON g.a = dist.v LEFT JOIN recurring.dist r ON r.s = dist.s AND r.v = g.b WHERE r.v IS NULL GROUP BY 1, 2),
paths AS (SELECT s, v, 0 AS d, 1.0::DOUBLE AS n FROM dist WHERE d = 0 UNION ALL
  SELECT p.s, g.b, p.d + 1, sum(p.n) FROM paths p JOIN g ON g.a = p.v JOIN dist t ON t.s = p.s AND t.v = g.b AND t.d = p.d + 1 GROUP BY 1, 2, 3),
shares AS (SELECT x.v, sum(x.n * y.n / z.n) AS c FROM paths x JOIN paths y ON y.s = x.v JOIN paths z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d WHERE x.s <> x.v AND y.s <> y.v GROUP BY 1)
SELECT v AS node, round(coalesce(c, 0), 6)::DOUBLE AS betweenness FROM nodes LEFT JOIN shares USING (v)""")
def trade_betweenness(spark: SparkSession, d: str) -> DataFrame:
    """On how many shortest ways of strong trade between others a nation lies."""
    g = strong_trade(spark, d).select(F.col("a").alias("x"), F.col("b").alias("y"))
    g = written(g, "strong")
    nodes = g.select(F.col("x").alias("node")).union(g.select("y")).distinct()
    return betweenness(g, nodes).select("node", F.round("betweenness", 6).alias("betweenness"))
