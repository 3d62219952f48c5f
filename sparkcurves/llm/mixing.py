"""Mixing overlapping sources to target weights by min-cost flow.

Documents are summed up by membership pattern (the set of sources they count for). The sums, one row per pattern, go to the driver, where a
min-cost flow routes words from patterns to source quotas. A pattern may be read several times over, and each further pass costs more than the
one before (a convex cost), so repetition is spread as evenly as the quotas allow. The flow says how many words each pattern gives: whole passes
over all of its documents, and the rest from documents in a seeded order; the last one gives only the words still missing.

The seeded order is a hash. Words are first summed by pattern and hash range; only the one range of each pattern in which the rest ends is
sorted, so a pattern that holds a third of all documents is never sorted or gathered as a whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkcurves.llm import shared as S

MOST_PASSES = 3
RANGES = 4096  # a power of two
MOST_PATTERNS = 100_000


def targets(sizes: Sequence[float], weights: Sequence[float], total: float, most: float = MOST_PASSES) -> list[float]:
    """Shares of `total` by weight, none above `most` times its size; what is over is shared again among the others by weight."""
    out = [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes)) if sizes[i] > 0 and weights[i] > 0]
    left = float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / weight for i in open_}
        over = [i for i in open_ if share[i] > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = share[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def route(patterns: Sequence[tuple[Sequence[int], int]], quotas: Sequence[int], passes: int = MOST_PASSES) -> list[dict[int, int]]:
    """Words from each pattern (member sources, size) to each source: as much of the quotas as can be met, with the least repetition cost.

    Pass number k over a pattern costs k * k a word; integers throughout. Patterns that share no source, directly or over others, do not compete:
    each such component is routed by itself. One of a single pattern needs no flow, as its words cost the same whichever source they go to.
    """
    out: list[dict[int, int]] = [{} for _ in patterns]
    for own in components(patterns, len(quotas)):
        if len(own) == 1:
            members, size = patterns[own[0]]
            left = int(size) * passes
            for s in sorted(set(members)):
                given = min(left, int(quotas[s]))
                left -= given
                if given > 0:
                    out[own[0]][s] = given
            continue
        sources = sorted({s for p in own for s in patterns[p][0]})
        number = {s: i for i, s in enumerate(sources)}
        flows = _flow([([number[s] for s in sorted(set(patterns[p][0]))], patterns[p][1]) for p in own], [quotas[s] for s in sources], passes)
        for p, flow in zip(own, flows, strict=True):
            out[p] = {sources[s]: words for s, words in flow.items()}
    return out


def components(patterns: Sequence[tuple[Sequence[int], int]], sources: int) -> list[list[int]]:
    """Patterns (their places) that share sources, directly or over others; patterns without a source are left out."""
    parent = list(range(sources))

    def root(s: int) -> int:
        while parent[s] != s:
            parent[s] = parent[parent[s]]
            s = parent[s]
        return s

    for members, _ in patterns:
        for s in members[1:]:
            parent[root(s)] = root(members[0])
    found: dict[int, list[int]] = {}
    for p, (members, _) in enumerate(patterns):
        if members:
            found.setdefault(root(members[0]), []).append(p)
    return list(found.values())


def _flow(patterns: Sequence[tuple[Sequence[int], int]], quotas: Sequence[int], passes: int) -> list[dict[int, int]]:
    """The routing of one component, by successive shortest paths."""
    n, m = len(patterns), len(quotas)
    source, sink = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]  # edge: to, capacity, cost, index of the reverse edge

    def edge(a: int, b: int, capacity: int, cost: int) -> None:
        graph[a].append([b, capacity, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, (members, size) in enumerate(patterns):
        for k in range(1, passes + 1):
            edge(source, p, int(size), k * k)
        for s in members:
            edge(p, n + s, int(size) * passes, 0)
    for s, quota in enumerate(quotas):
        edge(n + s, sink, int(quota), 0)
    potential = [0] * len(graph)
    while True:
        far = [None] * len(graph)
        far[source] = 0
        came: list[tuple[int, int] | None] = [None] * len(graph)
        heap = [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for i, (b, capacity, cost, _) in enumerate(graph[a]):
                if capacity > 0:
                    e = d + cost + potential[a] - potential[b]
                    if far[b] is None or e < far[b]:
                        far[b], came[b] = e, (a, i)
                        heapq.heappush(heap, (e, b))
        if far[sink] is None:
            break
        for a, d in enumerate(far):
            potential[a] += far[sink] if d is None else min(d, far[sink])
        amount, at = None, sink
        while at != source:
            a, i = came[at]
            amount = graph[a][i][1] if amount is None else min(amount, graph[a][i][1])
            at = a
        at = sink
        while at != source:
            a, i = came[at]
            graph[a][i][1] -= amount
            graph[at][graph[a][i][3]][1] += amount
            at = a
    return [{b - n: graph[b][back][1] for b, _, cost, back in graph[p] if n <= b < n + m and graph[b][back][1] > 0} for p in range(n)]


def mix(documents: DataFrame, quotas: dict, seed: int = 0, passes: int = MOST_PASSES, ranges: int = RANGES) -> DataFrame:
    """documents(members array<string>, size long, order columns doc_id, ...) -> the same rows with passes and taken.

    `members` are the sources a document counts for, without repeats; `quotas` says how many words each source shall give ({source: words}; a
    null source is the key None, written as a null member). `taken` is what the mix takes of the document in words, repeats counted; `passes`
    how often it is read as a whole. Documents without members or words give nothing. Rows that repeat are documents of their own. Nothing is
    drawn at random: the order is a hash of doc_id, size and seed. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    docs = S.store(documents.withColumn("pattern", F.to_json(F.struct(F.sort_array("members").alias("m")), {"ignoreNullFields": "false"}))
                   .withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "size", F.coalesce("n", F.lit(0)))), "mix-documents")
    docs = docs.withColumn("range", F.shiftrightunsigned("place", 64 - ranges.bit_length() + 1).cast("int"))
    sums = docs.groupBy("pattern").agg(F.sum("size").alias("size"), F.first("members").alias("members")).orderBy("pattern").limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns of sources: sum sources up first")
    names = list(quotas)
    number = {name: i for i, name in enumerate(names)}
    flows = route([([number[m] for m in r["members"] if m in number], int(r["size"] or 0)) for r in sums], [quotas[x] for x in names], passes)
    plan = []
    for r, flow in zip(sums, flows, strict=True):
        total, size = sum(flow.values()), int(r["size"] or 0)
        whole = total // size if size else 0
        plan.append((r["pattern"], whole, total - whole * size))
    # one row per pattern, at most MOST_PATTERNS
    plan = F.broadcast(spark.createDataFrame(plan, "pattern string, whole long, rest long"))
    by_range = docs.groupBy("pattern", "range").agg(F.sum("size").alias("words"))
    reach = F.sum("words").over(Window.partitionBy("pattern").orderBy("range"))  # at most `ranges` rows a pattern
    edges = by_range.select("pattern", "range", "words", reach.alias("reach")).join(plan, "pattern").where("reach - words <= rest and rest < reach")
    edges = F.broadcast(edges.select("pattern", F.col("range").alias("edge"), (F.col("reach") - F.col("words")).alias("before")))
    docs = docs.join(plan, "pattern").join(edges, "pattern", "left")  # no edge: a pattern without words
    sure = docs.where("edge is null or range <> edge").withColumn("part", F.when(F.col("range") < F.col("edge"), F.col("size")).otherwise(F.lit(0)))
    upto = F.sum("size").over(Window.partitionBy("pattern").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    split = docs.where("range = edge").withColumn("upto", F.col("before") + upto)
    split = split.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("upto") + F.col("size")))).drop("upto")
    done = sure.unionByName(split)
    done = done.withColumn("taken", (F.col("whole") * F.col("size") + F.col("part")).cast("long"))
    done = done.withColumn("passes", (F.col("whole") + F.when((F.col("size") > 0) & (F.col("part") * 2 >= F.col("size")), 1).otherwise(0)).cast("int"))
    return done.drop("pattern", "place", "range", "whole", "rest", "edge", "before", "part", "n")


def source_targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = MOST_PASSES) -> list[tuple]:
    """(source, size, target) by code point, null last; weights repeat along that order. One row per source goes to the driver."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} sources")
    rows = sorted(((r["source"], int(r["size"])) for r in rows), key=lambda r: (r[0] is None, r[0] or ""))
    goal = targets([s for _, s in rows], [weights[i % len(weights)] for i in range(len(rows))], sum(s for _, s in rows), most)
    return [(name, size, t) for (name, size), t in zip(rows, goal, strict=True)]


def mix_by_source(documents: DataFrame, weights: Sequence[float] = (5, 2, 1), seed: int = 0, passes: int = MOST_PASSES, carry: Sequence[str] = ()) -> DataFrame:
    """documents(doc_id, text, source) -> doc_id, size, source_size, target, taken, passes, source and the carried columns, one row per row.

    The size of a text is its number of words (null: 0). Every document counts for its own source; a null source is a source, too. Targets
    share all words by weight and stop at `passes` times their source's size. Empty texts are taken 0 times. Empty tables give empty results.
    """
    spark = documents.sparkSession
    sized = S.pick(documents, doc_id="doc_id", text="text", source="source", **{f"c{i}": c for i, c in enumerate(carry)})
    sized = sized.select("doc_id", "source", F.regexp_count(S.whole_text("text"), F.lit(S.WORD_PATTERN)).cast("long").alias("size"),
                         F.xxhash64("text").alias("n"), *[f"c{i}" for i in range(len(carry))])
    sized = S.store(sized, "mix-sizes")
    goals = source_targets(sized, weights, passes)
    # one row per source, at most MOST_PATTERNS
    lookup = F.broadcast(spark.createDataFrame(goals, "name string, source_size long, target double"))
    mixed = mix(sized.withColumn("members", F.array("source")), {name: round(t) for name, _, t in goals}, seed, passes)
    out = mixed.join(lookup, mixed["source"].eqNullSafe(lookup["name"]), "left")
    return out.select("doc_id", "size", "source_size", "target", "taken", "passes", "source", *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])
