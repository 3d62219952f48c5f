import random
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from sparkcurves.llm import mixing as M

SCHEMA = "doc_id long, text string, source string"


def test_targets_share_what_is_over():
    assert M.targets([100, 10, 50], [5, 2, 1], 160) == pytest.approx([130 * 5 / 6, 30, 130 / 6])
    assert M.targets([0, 10], [5, 1], 10) == [0.0, 10.0]
    assert M.targets([], [], 0) == []
    assert sum(M.targets([1, 1, 1], [100, 1, 1], 3)) == pytest.approx(3)


def cheapest(patterns, quotas, passes):
    """All whole-number flows of a tiny problem: most words routed, then least cost."""
    cost = lambda size, n: sum((n // size + 1 if size else 0) * 0 + (i // size + 1) ** 2 for i in range(n))
    arcs = [(p, s) for p, (members, _) in enumerate(patterns) for s in members]
    best = None
    for flow in product(*[range(min(quotas[s], patterns[p][1] * passes) + 1) for p, s in arcs]):
        out, into = Counter(), Counter()
        for (p, s), f in zip(arcs, flow, strict=True):
            out[p] += f
            into[s] += f
        if all(into[s] <= q for s, q in enumerate(quotas)) and all(out[p] <= passes * size for p, (_, size) in enumerate(patterns)):
            key = (-sum(flow), sum(cost(size, out[p]) for p, (_, size) in enumerate(patterns)))
            best = key if best is None or key < best else best
    return best


@pytest.mark.parametrize("patterns, quotas", [
    ([((0,), 2), ((0, 1), 2), ((1,), 1)], [4, 4]), ([((0, 1), 3)], [2, 2]), ([((0,), 1), ((1,), 2), ((0, 1), 0)], [5, 1]), ([((0, 1), 2), ((0, 1), 1)], [3, 3])])
def test_flow_against_all_flows(patterns, quotas):
    flows = M.route(patterns, quotas, 3)
    assert all(set(f) <= set(members) for f, (members, _) in zip(flows, patterns, strict=True))
    out = [sum(f.values()) for f in flows]
    cost = sum(sum((i // size + 1) ** 2 for i in range(n)) for n, (_, size) in zip(out, patterns, strict=True))
    into = Counter()
    for f in flows:
        into.update(f)
    assert all(into[s] <= q for s, q in enumerate(quotas))
    assert (-sum(out), cost) == cheapest(patterns, quotas, 3)


ROWS = [(i, "w " * (i % 17), f"s{i % 4}" if i % 3 else "s0") for i in range(300)] + [(900, None, "s1"), (901, "", None), (902, "a b c", None), (903, "x", "zero"), (5, "w " * 5, "s1"), (None, "no id", "s2")]


def test_words_taken_meet_the_targets(spark):
    docs = spark.createDataFrame([(*r, 7, 8, "y") for r in ROWS], SCHEMA + ", size long, pattern int, n string")
    got = M.mix_by_source(docs).collect()
    assert len(got) == len(ROWS)
    sizes = Counter()
    for _, text, source in ROWS:
        sizes[source] += len((text or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, M.targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], sum(sizes.values())), strict=True))
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["passes"] <= 3
        taken[r["source"]] += r["taken"]
    for s in names:
        assert abs(taken[s] - want[s]) <= 1
    again = M.mix_by_source(docs).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_overlapping_sources_share_documents(spark):
    docs = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["a"], 10) for i in range(40)], "doc_id long, members array<string>, size long").withColumn("n", F.lit(0).cast("long"))
    got = M.mix(docs, {"a": 150, "b": 250}).collect()
    both = sum(r["taken"] for r in got if len(r["members"]) == 2)
    assert sum(r["taken"] for r in got) == 400 and both >= 250
    assert max(r["taken"] for r in got) <= 20  # spread over two passes, not three


def test_empty_table(spark):
    assert M.mix_by_source(spark.createDataFrame([], SCHEMA)).count() == 0


def test_disjoint_sources_need_no_flow():
    sizes = [1 + i % 97 for i in range(20_000)]
    quotas = [(i * 7919) % 400 for i in range(20_000)]
    got = M.route([([i], size) for i, size in enumerate(sizes)], quotas)
    assert [sum(flow.values()) for flow in got] == [min(3 * size, quota) for size, quota in zip(sizes, quotas, strict=True)]


def test_components_are_routed_as_the_whole():
    random.seed(11)
    for _ in range(40):
        members = [sorted(random.sample(range(9), random.choice((1, 1, 2, 3)))) for _ in range(random.randrange(1, 9))]
        patterns = [(m, random.randrange(0, 30)) for m in {tuple(m): m for m in members}.values()] + [([], 5)]
        quotas = [random.randrange(0, 60) for _ in range(9)]

        def cost(flows):
            left = [sum(flow.values()) for flow in flows]
            return sum(left), sum(max(0, min(size, n - (k - 1) * size)) * k * k for (_, size), n in zip(patterns, left, strict=True) for k in (1, 2, 3))

        got = M.route(patterns, quotas)
        assert cost(got) == cost(M._flow(patterns, quotas, 3))
        assert all(sum(flow.get(s, 0) for flow in got) <= quotas[s] for s in range(9))
        assert all(set(flow) <= set(m) for flow, (m, _) in zip(got, patterns, strict=True))
