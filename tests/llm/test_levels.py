"""Levels of calls against a walk of the graph."""

import random

from roadspark.llm import toolcalls


def by_hand(edges):
    before = {}
    for c, a, b in edges:
        before.setdefault((c, a), set()).add((c, b))
    level = {}
    for _ in range(len(before) + 2):
        for node, deps in before.items():
            if all(d not in before or d in level for d in deps):
                level[node] = 1 + max(level.get(d, 0) for d in deps)
    return level, set(before) - set(level)


def test_levels(spark):
    rnd = random.Random(11)
    edges = [(1, f"n{k}", f"n{k - 1}") for k in range(1, 40)]  # a long chain
    edges += [(2, f"n{a}", f"n{rnd.randrange(a)}") for a in range(1, 25) for _ in range(rnd.choice([1, 1, 2, 3]))]
    edges += [(3, "a", "b"), (3, "b", "a"), (3, "c", "b"), (3, "d", "c"), (3, "d", "e"), (3, "f", "e"), (3, "g", "g")]
    level, circles = toolcalls.levels(spark.createDataFrame(edges, "conv_id bigint, call_id string, dep string"))
    want, lost = by_hand(edges)
    assert {(r.conv_id, r.call_id): r.level for r in level.collect()} == want
    assert {(r.conv_id, r.call_id) for r in circles.collect()} == lost
    none = toolcalls.levels(spark.createDataFrame([], "conv_id bigint, call_id string, dep string"))
    assert none[0].count() == none[1].count() == 0
