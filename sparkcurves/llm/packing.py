"""Packing documents into fixed-length token sequences by cutting-stock column generation.

1. Every text is encoded once; a closing id ends it. A document's whole blocks of `capacity` ids are sequences by themselves.
   What is left, shorter than `capacity`, is an item.
2. A histogram of item lengths (at most capacity - 1 numbers, whatever the size of the data) goes to the driver. A linear program over
   patterns (multisets of lengths that share a sequence) is solved by column generation: the simplex method holds the basis, and an unbounded
   knapsack by dynamic programming prices all lengths at once for new patterns. Beside the patterns, an item may be cut: it then costs its
   share of a sequence plus a small penalty, so patterns that waste more than the penalty are not used.
3. Pattern counts are rounded: down, then up again, largest fraction first, while documents are left.
4. Documents are ranked within (length, bucket), buckets being hashes, so that a length that a third of all documents have is ranked in
   many tasks; bucket offsets make it a rank by length. A lookup of at most a few thousand intervals of ranks gives each its sequence and place.
   Items that no pattern took are laid end to end in the order of length and rank and cut at sequence ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkcurves.llm import shared as S
from sparkcurves.llm import tokens as K

CAPACITY = 1024
BUCKETS = 64  # tasks that share the ranking of one length; the offsets of all lengths' buckets are broadcast
CUT_PENALTY = 2 / 1024  # of a sequence, for cutting one document


# --- the linear program -----------------------------------------------------------------------------------------------

@dataclass
class Plan:
    """Patterns with their counts, and how many items of each length are cut."""

    patterns: list[tuple[dict[int, int], int]]
    cut: np.ndarray  # by length, 0 .. capacity - 1
    bound: float  # lower bound of the program's cost, in sequences
    cost: float  # cost of its solution


def best_fill(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: (best value, length taken last) for each room 0..capacity; prices[l] is the value of one item of length l."""
    lengths = np.flatnonzero(prices > 0)
    value, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    worth = prices[lengths]
    for room in range(1, capacity + 1):
        fits = np.searchsorted(lengths, room, "right")
        value[room], last[room] = value[room - 1], 0
        if fits:
            got = worth[:fits] + value[room - lengths[:fits]]
            at = int(got.argmax())
            if got[at] > value[room] + 1e-15:
                value[room], last[room] = got[at], lengths[at]
    return value, last


def _pattern(first: int, room: int, last: np.ndarray) -> dict[int, int]:
    out = {first: 1} if first else {}
    while room > 0:
        if last[room]:
            out[int(last[room])] = out.get(int(last[room]), 0) + 1
            room -= int(last[room])
        else:
            room -= 1
    return out


def solve(demand: np.ndarray, capacity: int = CAPACITY, penalty: float = CUT_PENALTY, gap: float = 0.02, most_rounds: int = 40, most_pivots: int = 4000) -> Plan:
    """Column generation for demand[l] items of length l, l < capacity; ends when the cost is within `gap` of its lower bound.

    The gap is a share of what cutting every item would cost; after `most_rounds` of pricing the best solution so far is taken, which only
    leaves more documents cut than need be.
    """
    kinds = np.flatnonzero(demand)
    m = len(kinds)
    if not m:
        return Plan([], np.zeros(capacity, np.int64), 0.0, 0.0)
    place = {int(k): i for i, k in enumerate(kinds)}
    cut_cost = kinds / capacity + penalty
    # tiny different shifts of the demand keep the simplex method from standing still
    amount = demand[kinds].astype(float) + np.linspace(1e-7, 2e-7, m)
    inverse, costs = np.eye(m), cut_cost.copy()
    columns: list[dict[int, int] | None] = [None] * m
    cuts = list(range(m))  # which length's cut column stands at a row; -1 for a pattern
    for i, length in enumerate(kinds.tolist()):  # first basis: lengths that fill a sequence in pairs, what is over of each is cut
        j = place.get(capacity - length)
        if j is None or j < i:
            continue
        few, many = (i, j) if amount[i] <= amount[j] else (j, i)
        columns[few] = {length: 2} if i == j else {length: 1, capacity - length: 1}
        cuts[few], costs[few] = -1, 1.0
        if i == j:
            inverse[i, i], amount[i] = 0.5, amount[i] / 2
        else:
            inverse[many, few] = -1.0
            amount[many] -= amount[few]
    bound = 0.0
    worst = penalty * float(demand.sum())
    pivots = 0
    for _ in range(most_rounds):
        duals = costs @ inverse
        value, last = best_fill(_spread(duals, kinds, capacity), capacity)
        cost = float(costs @ amount)
        if (np.maximum(duals - cut_cost, 0) < 1e-9).all():  # shrunk until no pattern is worth more than a sequence, duals bound the cost
            bound = max(bound, cost / max(1.0, value[capacity]))
        if value[capacity] < 1 + 1e-9 or cost - bound <= gap * worst:
            break
        # the best pattern that holds each length; the most promising different ones enter one after the other
        reduced = 1 - (np.maximum(duals, 0) + value[capacity - kinds])
        entered = 0
        for i in np.argsort(reduced, kind="stable"):
            if reduced[i] > 0.5 * reduced.min() or reduced[i] > -1e-9 or entered >= 100:
                break
            pattern = _pattern(int(kinds[i]), capacity - int(kinds[i]), last)
            column = np.zeros(m)
            for length, count in pattern.items():
                column[place[length]] = count
            if 1 - (costs @ inverse) @ column > -1e-9:
                continue
            if _pivot(inverse, amount, column, columns, cuts, costs, pattern, -1, 1.0):
                entered += 1
        while True:  # cut columns that left may return
            over = costs @ inverse - cut_cost
            i = int(over.argmax())
            if over[i] < 1e-9:
                break
            column = np.zeros(m)
            column[i] = 1
            if not _pivot(inverse, amount, column, columns, cuts, costs, None, i, float(cut_cost[i])):
                break
            entered += 1
        pivots += entered
        if not entered or pivots > most_pivots:
            break
    return _rounded(demand, capacity, kinds, columns, amount, bound, float(costs @ amount))


def _spread(duals: np.ndarray, kinds: np.ndarray, capacity: int) -> np.ndarray:
    prices = np.zeros(capacity + 1)
    prices[kinds] = np.maximum(duals, 0)
    return prices


def _pivot(inverse, amount, column, columns, cuts, costs, pattern, cut, cost) -> bool:
    direction = inverse @ column
    up = np.flatnonzero(direction > 1e-9)
    if not len(up):
        return False
    ratio = amount[up] / direction[up]
    row = int(up[ratio.argmin()])
    step = amount[row] / direction[row]
    amount -= step * direction
    np.maximum(amount, 0, out=amount)
    amount[row] = step
    pivoted = inverse[row] / direction[row]
    touched = np.flatnonzero(np.abs(direction) > 1e-12)
    inverse[touched] -= np.outer(direction[touched], pivoted)
    inverse[row] = pivoted
    columns[row], cuts[row], costs[row] = pattern, cut, cost
    return True


def _rounded(demand, capacity, kinds, columns, amount, bound, cost) -> Plan:
    left = demand.astype(np.int64).copy()
    chosen: list[list] = []
    for pattern, x in zip(columns, amount.tolist(), strict=True):
        if pattern:
            room = min(left[length] // count for length, count in pattern.items())
            n = int(min(np.floor(x + 1e-6), room))
            chosen.append([pattern, n, x - n])
            for length, count in pattern.items():
                left[length] -= n * count
    for entry in sorted(chosen, key=lambda e: (-e[2], sorted(e[0].items()))):
        if entry[2] > 1e-6 and all(left[length] >= count for length, count in entry[0].items()):
            entry[1] += 1
            for length, count in entry[0].items():
                left[length] -= count
    patterns = sorted(((p, n) for p, n, _ in chosen if n), key=lambda e: sorted(e[0].items()))
    return Plan(patterns, left, bound, cost)


# --- documents --------------------------------------------------------------------------------------------------------

_ENCODED = T.StructType([
    T.StructField("full", T.BooleanType()), T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
    T.StructField("spread", T.LongType()),
])


def _encoded(documents: DataFrame, capacity: int, path: str, closing_id: int) -> DataFrame:
    """A row for each whole block of ids and one for each rest that isn't empty."""
    texts = S.pick(documents, doc_id="doc_id", text="text").select(
        F.col("doc_id").cast("long").alias("doc_id"), S.whole_text("text").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = K.encoder(path).encode(batch.column("text"))
            # closing ids go in after each text's own
            ids = np.insert(ids, at[1:], np.uint32(closing_id)) if len(at) > 1 else ids
            at = at + np.arange(len(at))
            sizes = np.diff(at)
            blocks = -(-sizes // capacity)
            owner = np.repeat(np.arange(len(sizes)), blocks)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            starts = number * capacity
            lengths = np.minimum(capacity, sizes[owner] - starts)
            data = pa.py_buffer(ids.astype("<u4").tobytes())
            places = pa.py_buffer((4 * np.append(at[:-1][owner] + starts, at[-1])).astype(np.int32).tobytes())
            if 4 * at[-1] >= 1 << 31:
                raise ValueError("lower spark.sql.execution.arrow.maxRecordsPerBatch: over 2 GB of ids in a batch")
            binary = pa.Array.from_buffers(pa.binary(), len(owner), [None, places, data])
            spread = S.mix(S.mix(np.nan_to_num(batch.column("doc_id").to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64)[owner])
                           ^ number.astype(np.uint64))
            yield pa.record_batch({
                "full": pa.array(lengths == capacity), "doc_id": batch.column("doc_id").take(pa.array(owner)),
                "start": pa.array(starts), "length": pa.array(lengths), "doc_tokens": pa.array(sizes[owner]),
                "ids": binary, "spread": pa.array((spread >> np.uint64(1)).astype(np.int64)),
            })

    return S.map_arrow(texts, encode, _ENCODED)


def _intervals(plan: Plan) -> tuple[list[tuple], int]:
    """Rows (length, lo, hi, per_sequence, first_sequence, offset): ranks lo <= r < hi of a length, and where they go."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in plan.patterns:
        offset = 0
        for length, count in sorted(pattern.items(), reverse=True):
            lo = used.get(length, 0)
            rows.append((length, lo, lo + n * count, count, sequence, offset))
            used[length] = lo + n * count
            offset += length * count
        sequence += n
    return rows, sequence


def pack(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, closing_id: int = 0,
         penalty: float = CUT_PENALTY, buckets: int = BUCKETS) -> DataFrame:
    """documents(doc_id, text) -> pieces: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, pattern.

    `start` is the place of a piece in its document's ids, `offset` its place in its sequence; pieces fill a sequence from 0 without gaps.
    `pattern` is the number of the pattern that took the piece, -1 for a whole block, -2 for a piece of the cut rest. A null text is an empty
    one and has the closing id only. A null doc_id stays null; rows that repeat are packed each by itself; ties in length are ranked by a hash
    of doc_id, then doc_id. An empty table gives no pieces. Other columns are ignored. Very long texts only give more blocks.
    """
    spark = documents.sparkSession
    path = vocabulary or K.vocabulary_path()
    encoded = S.store(_encoded(documents, capacity, path, closing_id), "encoded")
    histogram = encoded.where("not full").groupBy("length").count().collect()  # at most capacity - 1 rows
    demand = np.zeros(capacity, np.int64)
    for row in histogram:
        demand[row["length"]] = row["count"]
    plan = solve(demand, capacity, penalty)
    rows, sequences = _intervals(plan)
    taken = demand - plan.cut
    stream = np.concatenate([[0], np.cumsum(plan.cut * np.arange(capacity))])  # where each length's cut items start, end to end

    lookup = spark.createDataFrame(
        [(r[0], r[1], r[2], r[3], r[4], r[5], i) for i, r in enumerate(rows)] or [(0, 0, 0, 1, 0, 0, 0)],
        "length long, lo long, hi long, per long, sequence long, place long, pattern int")
    rest = spark.createDataFrame([(l, int(taken[l]), int(stream[l])) for l in range(1, capacity)], "length long, used long, stream long")

    items = encoded.where("not full").withColumn("bucket", F.pmod("spread", F.lit(buckets)))
    sizes = items.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("spread", "doc_id", "start"))
    ranked = items.withColumn("local", local).join(F.broadcast(before), ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("local") - 1)
    # both lookups are bounded by the capacity: one row a length, and one for each length of each of fewer than `capacity` patterns
    ranked = ranked.join(F.broadcast(rest), "length")
    kept = ["doc_id", "start", "length", "ids", "doc_tokens"]
    inside = ranked.where("rank < used").join(
        F.broadcast(lookup.withColumnRenamed("length", "l")), (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    slot = F.col("rank") - F.col("lo")
    inside = inside.select(*kept, (F.col("sequence") + F.floor(slot / F.col("per"))).alias("n"),
                           (F.col("place") + slot % F.col("per") * F.col("length")).alias("offset"), "pattern")
    at = F.col("stream") + (F.col("rank") - F.col("used")) * F.col("length")
    loose = ranked.where("rank >= used").withColumn("at", at)
    head = F.least(F.col("length"), capacity - F.col("at") % capacity)
    ends = F.array(
        F.struct(F.lit(0).cast("long").alias("skip"), head.alias("take")),
        F.struct(head.alias("skip"), (F.col("length") - head).alias("take")))
    loose = loose.select("*", F.explode(F.filter(ends, lambda e: e["take"] > 0)).alias("e")).select(
        "doc_id", (F.col("start") + F.col("e.skip")).alias("start"), F.col("e.take").alias("length"),
        F.expr("substring(ids, cast(4 * e.skip + 1 as int), cast(4 * e.take as int))").alias("ids"), "doc_tokens",
        (F.lit(sequences) + F.floor((F.col("at") + F.col("e.skip")) / capacity)).alias("n"),
        ((F.col("at") + F.col("e.skip")) % capacity).alias("offset"), F.lit(-2).alias("pattern"))
    # even numbers for packed sequences; odd ones for whole blocks, numbered by their place in the stored table
    whole = encoded.where("full").select(
        *kept, (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(-1).alias("pattern"))
    shared = inside.unionByName(loose).select(*kept, (2 * F.col("n")).cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"), "pattern")
    return whole.unionByName(shared)


def pieces_digest(pieces: DataFrame) -> DataFrame:
    """pack()'s pieces with their ids as a checksum."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "pattern")
