"""Communities against the same rounds in plain Python, and against all partitions of small graphs."""

import random
from collections import defaultdict

import pytest

from paperloom.operators import communities


def modularity(edges, label):
    whole, inner, total = 0.0, 0.0, defaultdict(float)
    for a, b, w in edges:
        whole += 2 * w
        inner += 2 * w * (label[a] == label[b])
        total[label[a]] += w
        total[label[b]] += w
    return inner / whole - sum(t * t for t in total.values()) / whole**2 if whole else 0.0


def plain(vertices, edges):
    found, edges = {v: v for v in vertices}, [e for e in edges if e[2] > 0]
    while True:
        near, degree = defaultdict(lambda: defaultdict(float)), defaultdict(float)
        for a, b, w in edges:
            degree[a] += w
            degree[b] += w
            if a != b:
                near[a][b] += w
                near[b][a] += w
        whole, label = sum(degree.values()), {v: v for v in degree}
        best, changed = modularity(edges, label), False
        while whole:
            now = dict(label)
            for up in (False, True):
                before, total = dict(now), defaultdict(float)
                for v, c in before.items():
                    total[c] += degree[v]
                for v, own in before.items():
                    to = defaultdict(float, {own: 0.0})
                    for u, w in near[v].items():
                        to[before[u]] += w
                    offers = [(-round(w - degree[v] * (total[c] - degree[v] * (c == own)) / whole, 9), c != own, c) for c, w in to.items() if c == own or (c > own) == up]
                    now[v] = min(offers)[2]
            value = modularity(edges, now)
            if value <= best + communities.LEAST:
                break
            label, best, changed = now, value, True
        if not changed:
            break
        found = {v: label.get(c, c) for v, c in found.items()}
        edges = [(label[a], label[b], w) for a, b, w in edges]
    least = {}
    for v, c in found.items():
        least[c] = min(v, least.get(c, v))
    return {v: least[c] for v, c in found.items()}


def frames(spark, vertices, edges):
    return spark.createDataFrame([(v,) for v in vertices], "topic long"), spark.createDataFrame(edges, "src long, dst long, chi double")


def test_rounds_equal_plain_ones(spark):
    deal = random.Random(4)
    vertices = list(range(24))
    edges = [(a, b, float(deal.randint(1, 9)) + (20.0 if a // 6 == b // 6 else 0.0)) for a in vertices for b in vertices if a < b < 22 and deal.random() < (0.7 if a // 6 == b // 6 else 0.08)]
    edges += [(3, 3, 2.0), (0, 23, -5.0)]  # a loop, and a negative edge that doesn't count
    own = communities.community_table(*frames(spark, vertices, edges)).collect()
    label = plain(vertices, edges)
    assert {r["topic"]: r["community"] for r in own} == label and label[22] == 22 and label[23] == 23
    value = modularity([e for e in edges if e[2] > 0], label)
    assert {round(r["modularity"], 9) for r in own} == {round(value, 9)} and value > 0.5
    assert all(r["size"] == sum(c == r["community"] for c in label.values()) for r in own)


def test_best_of_all_partitions_of_two_cliques(spark):
    edges = [(a, b, 1.0) for g in ((0, 1, 2), (3, 4, 5)) for a in g for b in g if a < b] + [(2, 3, 1.0)]

    def partitions(n, label=()):
        if len(label) == n:
            yield dict(enumerate(label))
        else:
            for c in range(max(label, default=-1) + 2):
                yield from partitions(n, (*label, c))

    best = max(modularity(edges, p) for p in partitions(6))
    (value,) = {r["modularity"] for r in communities.community_table(*frames(spark, range(6), edges)).collect()}
    assert value == pytest.approx(best)
    assert communities.community_table(*frames(spark, [], [])).count() == 0
    assert {r["community"] for r in communities.community_table(*frames(spark, [4, 5], [])).collect()} == {4, 5}
