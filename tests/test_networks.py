"""Graph algorithms against brute force on small graphs."""

import heapq
import itertools
import random
import zlib
from collections import defaultdict, deque

from pyspark.sql import functions as F

from textloom.operators import networks as N


def random_graph(seed, n=50, m=110):
    rnd = random.Random(seed)
    pairs = {tuple(sorted(rnd.sample(range(n), 2))) for _ in range(m)}
    return [(a, b, float(rnd.choice([1, 2, 3, 7, 20]))) for a, b in sorted(pairs)]


def both(edges):
    return edges + [(b, a, w) for a, b, w in edges]


def test_components_of_chains_stars_and_nulls(spark, monkeypatch):
    chain = [(i + 1, i) for i in range(100, 200)]
    rnd = random.Random(1)
    rnd.shuffle(chain)
    star = [(500 + i, 499) for i in range(60)]
    rows = chain + star + [(7, 7), (None, 3), (9, None), (1 << 60, (1 << 60) + 1), (100, 150)]
    rounds = []
    monkeypatch.setattr(N, "written", lambda df, name, keep=N.written: rounds.append(name) or keep(df, name))
    got = {r.node: r.entity for r in N.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 201)} | {499 + i: 499 for i in range(61)} | {7: 7, 3: 3, 9: 9, 1 << 60: 1 << 60, (1 << 60) + 1: 1 << 60}
    assert got == want and rounds.count("small-stars") <= 10
    assert N.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_identity_links_are_as_many_as_rows(spark):
    df = spark.createDataFrame([(i, "same") for i in range(40)] + [(50, None)], "k long, q string")
    links = N.identity_links(df, "k", [F.col("q"), F.col("q")])
    assert links.count() == 40 and {r.b for r in links.collect()} == {0}


def modularity_by_hand(edges, comm):
    total = 2 * sum(w for *_, w in edges)
    k, inside = defaultdict(float), defaultdict(float)
    for a, b, w in edges:
        k[comm[a]] += w
        k[comm[b]] += w
        inside[comm[a]] += 2 * w * (comm[a] == comm[b])
    return sum(inside[c] / total - (k[c] / total) ** 2 for c in k)


def test_louvain_finds_planted_communities(spark):
    rnd = random.Random(5)
    edges = [(a, b, 1.0) for a, b in itertools.combinations(range(50), 2) if rnd.random() < (0.7 if a // 10 == b // 10 else 0.03)] + [(0, 0, 2.0)]
    member, q = N.louvain(spark.createDataFrame(edges + [(1, None, 5.0), (1, 30, -1.0), (2, 31, None)], "a long, b long, w double"))
    comm = {r.node: r.community for r in member.collect()}
    assert comm == {i: i // 10 * 10 for i in range(50)} and abs(q - modularity_by_hand(edges, comm)) < 1e-9


def test_louvain_beats_single_moves(spark):
    edges = random_graph(3)
    member, q = N.louvain(spark.createDataFrame(edges, "a long, b long, w double"))
    comm = {r.node: r.community for r in member.collect()}
    assert abs(q - modularity_by_hand(edges, comm)) < 1e-9 and q > 0.4
    assert all(c == min(n for n, x in comm.items() if x == c) for c in comm.values())
    empty, zero = N.louvain(spark.createDataFrame([], "a long, b long, w double"))
    assert empty.count() == 0 and zero == 0.0


def test_distances_equal_dijkstra(spark):
    for seed, delta in ((1, 3.0), (2, 100.0), (4, 0.5)):
        edges = both(random_graph(seed))
        near, todo = {}, [(0.0, 0), (0.0, 13)]
        ways = defaultdict(list)
        for a, b, w in edges:
            ways[a].append((b, w))
        while todo:
            d, v = heapq.heappop(todo)
            if v not in near:
                near[v] = d
                for y, w in ways[v]:
                    heapq.heappush(todo, (d + w, y))
        df = spark.createDataFrame(edges + [(0, None, 1.0), (0, 1, -5.0), (0, 2, None)], "x long, y long, w double")
        start = spark.createDataFrame([(0,), (13,)], "node long")
        assert {r.node: r.distance for r in N.shortest_distances(df, start, delta).collect()} == near
        if delta == 3.0:
            assert {r.node: r.distance for r in N.shortest_distances(df, start, delta, 6.0).collect()} == {v: d for v, d in near.items() if d <= 6}


def betweenness_by_hand(edges, sources):
    ways, out = defaultdict(set), defaultdict(float)
    for a, b, _ in edges:
        ways[a].add(b)
    nodes = {x for a, b, _ in edges for x in (a, b)}

    def count(s):
        dist, paths, todo = {s: 0}, defaultdict(int, {s: 1}), deque([s])
        while todo:
            v = todo.popleft()
            for y in ways[v]:
                if y not in dist:
                    dist[y] = dist[v] + 1
                    todo.append(y)
                if dist[y] == dist[v] + 1:
                    paths[y] += paths[v]
        return dist, paths

    known = {v: count(v) for v in nodes}
    for s in sources:
        for v, t in itertools.permutations(nodes - {s}, 2):
            (d, p), (dv, pv) = known[s], known[v]
            if v in d and t in dv and d[t] == d[v] + dv[t]:
                out[v] += p[v] * pv[t] / p[t]
    return {v: round(out[v], 6) for v in nodes}


def test_betweenness_equals_brute_force(spark):
    for seed, way in ((1, both), (2, list)):
        edges = way(random_graph(seed, 40, 70))
        df = spark.createDataFrame(edges + [(3, 3, 1.0), (None, 1, 1.0)], "x long, y long, w double")
        for sources in (sorted({a for a, *_ in edges}), [1, 5]):
            got = N.betweenness(df, spark.createDataFrame([(s,) for s in sources], "node long")).collect()
            assert {r.node: round(r.betweenness, 6) for r in got} == betweenness_by_hand(edges, sources)


def louvain_by_hand(edges):
    """Communities by the rules of ``louvain``, and how often a level or a class with a node that would move came up."""
    ways, asked = defaultdict(float), 0
    for a, b, w in both(edges):
        ways[a, b] += w
    total, member = sum(ways.values()), {x: x for e in ways for x in e}

    def quality(ways, comm):
        k, inside = defaultdict(float), 0.0
        for (x, y), w in ways.items():
            k[comm[x]] += w
            inside += w * (comm[x] == comm[y])
        return inside / total - sum((v / total) ** 2 for v in k.values())

    best = quality(ways, member)
    level = dict(ways)
    for _ in range(N.LEVELS):
        k, asked = defaultdict(float), asked + 1
        for (x, _), w in level.items():
            k[x] += w
        comm, now, classes, quiet = {x: x for x in k}, None, 2, 0
        now = quality(level, comm)
        for turn in range(N.PASSES):
            tot, changed = defaultdict(float), dict(comm)
            for x in comm:
                tot[comm[x]] += k[x]
            for x in comm:
                link = defaultdict(float, {comm[x]: 0.0})
                for (a, y), w in level.items():
                    if a == x != y:
                        link[comm[y]] += w
                gain = {c: round(w - k[x] * (tot[c] - k[x] * (c == comm[x])) / total, 9) for c, w in link.items()}
                to = min(gain, key=lambda c: (-gain[c], c))
                if zlib.crc32(str(x).encode()) % classes == turn % classes and gain[to] > gain[comm[x]] + N.GAIN:
                    changed[x] = to
            asked += changed != comm
            after = quality(level, changed)
            if changed != comm and after > now + N.GAIN:
                comm, now, quiet = changed, after, 0
            elif changed != comm and classes < N.CLASSES:
                classes, quiet = classes * 2, 0
            else:
                quiet += 1
            if quiet == classes:
                break
        named = {x: comm[c] for x, c in member.items()}
        if quality(ways, named) <= best + N.GAIN:
            break
        member, best, up = named, quality(ways, named), defaultdict(float)
        for (x, y), w in level.items():
            up[comm[x], comm[y]] += w
        level = up
    return {x: min(y for y in member if member[y] == c) for x, c in member.items()}, asked


def test_louvain_asks_once_until_a_pass_is_kept(spark, monkeypatch):
    edges = random_graph(7, 14, 30) + [(3, 3, 2.0)]
    rounds = []
    monkeypatch.setattr(N, "written", lambda df, name, keep=N.written: rounds.append(name) or keep(df, name))
    member, _ = N.louvain(spark.createDataFrame(edges, "a long, b long, w double"))
    want, asked = louvain_by_hand(edges)
    assert {r.node: r.community for r in member.collect()} == want
    assert rounds.count("state") == asked
