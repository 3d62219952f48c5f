"""Near duplicates by an LSH forest.

A text is the set of its distinct word shingles. Texts with equal sets form a class; everything below works on classes, so thousands of
copies cost no more than one. Each class has a MinHash signature of 4 * `trees` values. Tree t sorts classes by the signature read from
value 4 * t on (and around), which makes neighbours of classes whose signatures share a long prefix there.

* Regions. Classes that share the first 4 values in a tree are a region of it. Two sets of similarity 0.8 share none of 32 regions with
  probability 5e-8. Classes alone in all their regions are done.
* Neighbours. In each sorted order neighbours in a region (those with the longest common prefix) and the region's smallest class are candidates.
  Each class offers its smallest and its most alike ones for confirmation on full sets. Links join classes to components, which settles large
  groups of copies with a few confirmations each. Candidates that are not offered come again below, unless their classes have been joined by then.
  Links found later join components by their roots, so that each link is followed once.
* Regions again. Only pairs of different components in a region are left. Where the classes outside a region's largest component are few, all
  such pairs whose signatures allow a similarity near the threshold are confirmed on full sets. A region with more of them is split by
  prefixes of 8, then 16 values, each as deep as it needs, and its parts are compared in the same way.
* Full regions. Pairs that part on the way are still open. The classes of regions that are mixed and full even now meet in one exact join of their
  full sets: shingles are ordered from rare to frequent, and two sets that reach the threshold share one among the first few of each (prefix
  filter), early enough for what follows to suffice. Frequent shingles are dealt over several tasks.

Two kinds of links can be lost, both by chance of the hash functions: between classes that share no region (5e-8 of pairs at 0.8), and in small
regions between classes whose signatures agree on fewer than 82 of 128 values (SIGMAS; about 8e-6 of pairs at 0.8, fewer above). A pair in a full
region is held to its sets alone. Candidates are never capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkcurves.llm import shared as S

TREES = 32
ROOT = 4  # values that make a region
DEPTHS = (4, 8, 16)  # longer and longer prefixes that split regions that are too full
BUCKET_BITS = 20  # the order of shingles in the exact join goes by counts of 2**20 buckets of hashes
PAIRS_PER_CLASS = 16  # classes outside a region's largest component that are compared in the region itself
PER_TASK = 512  # sets with one shingle that a task compares with all others that have it
OFFERS = 2  # neighbours that a class offers for confirmation beside its smallest
SIGMAS = 4.5  # a pair whose signatures agree on fewer values than this allows is no candidate


def _signatures(hashes: np.ndarray, at: np.ndarray, values: int) -> np.ndarray:
    """(texts, values) smallest hashes of each set under as many linear maps; texts without shingles have none and must be left out."""
    odd = (S.mix(np.arange(1, values + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    add = (S.mix(np.arange(1, values + 1, dtype=np.uint64) << np.uint64(20)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, values), np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for a, b in S.chunks_of(np.diff(at), 1 << 15):
        part, starts = short[at[a] : at[b]], at[a:b] - at[a]
        for k in range(values):
            mapped = part * odd[k] + add[k]
            out[a:b, k] = np.minimum.reduceat(mapped ^ (mapped >> np.uint32(15)), starts)
    return out


def _sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = S.text_buffer(texts)
    words, at = S.word_hashes(data, offsets)
    return S.shingle_hashes(words, at, width)


def _digests(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, equal for equal sets."""
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15):
        total = np.concatenate([[np.uint64(0)], np.cumsum(S.mix(hashes ^ np.uint64(salt)), dtype=np.uint64)])
        out.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    return out[0], out[1]


def _store(df: DataFrame, label: str) -> DataFrame:
    """S.store() for one of many steps: what the steps before have shuffled can go."""
    stored = S.store(df, label)
    S.tidy(df.sparkSession)
    return stored


_DOCUMENT = "doc_id long, text_key long, n_shingles long, d0 long, d1 long, signature binary"


def _documents(documents: DataFrame, width: int, values: int) -> DataFrame:
    texts = S.pick(documents, doc_id="doc_id", text="text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(S.whole_text("text")).alias("text_key"), S.whole_text("text").alias("text"))

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, at = _sets(batch.column("text"), width)
        sizes = np.diff(at)
        some = np.flatnonzero(sizes)
        bounds = np.concatenate([at[:-1][some], at[-1:]])
        signature = _signatures(hashes, bounds, values).astype(">u4")
        width_bytes = 4 * values
        held = np.where(sizes > 0, width_bytes, 0)
        d0, d1 = _digests(hashes, at)
        binary = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(held)]).astype(np.int32).tobytes()),
                                                                  pa.py_buffer(signature.tobytes())])
        return pa.record_batch({"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "n_shingles": pa.array(sizes),
                                "d0": pa.array(d0), "d1": pa.array(d1), "signature": binary})

    return S.map_arrow(texts, S.arrow_map(describe), _DOCUMENT)


def _region_keys(signatures: np.ndarray, depth: int, trees: int) -> np.ndarray:
    """(classes, trees) keys: a hash of tree number and the first `depth` values of that tree's order."""
    n, values = signatures.shape
    key = np.broadcast_to(S.mix(np.arange(1, trees + 1, dtype=np.uint64)), (n, trees)).copy()
    first = ROOT * np.arange(trees)
    for j in range(depth):
        key = S.mix(key * np.uint64(0x9E3779B97F4A7C15) + signatures[:, (first + j) % values].astype(np.uint64))
    return key.view(np.int64)


def _unpack(column: pa.Array, values: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(-1, values).astype(np.uint32)


def _regions(classes: DataFrame, depth: int, trees: int, values: int) -> DataFrame:
    """class -> (class, tree, key) for all trees."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = _region_keys(_unpack(batch.column("signature"), values), depth, trees)
        ids = batch.column("class").to_numpy()
        return pa.record_batch({"class": pa.array(np.repeat(ids, trees)), "tree": pa.array(np.tile(np.arange(trees, dtype=np.int32), len(ids))),
                                "key": pa.array(keys.ravel())})

    return S.map_arrow(classes.select("class", "signature"), S.arrow_map(run), "class long, tree int, key long")


def _neighbours(active: DataFrame, trees: int, values: int, parts: int) -> DataFrame:
    """Pairs of neighbours in each sorted order that share a region, (a, b, shared) with the number of values in their common prefix."""
    shown = min(values, 16)

    def orders(batch: pa.RecordBatch) -> pa.RecordBatch:
        signatures = _unpack(batch.column("signature"), values)
        ids, own = batch.column("class").to_numpy(), batch.column("trees")
        sizes = np.array([len(x) for x in own.to_pylist()])
        row, tree = np.repeat(np.arange(len(ids)), sizes), np.asarray(own.flatten().to_numpy(zero_copy_only=False), np.int64)
        prefix = signatures[row[:, None], (ROOT * tree[:, None] + np.arange(shown)) % values].astype(">u4")
        return pa.record_batch({"tree": pa.array(tree.astype(np.int32)), "class": pa.array(ids[row]),
                                "prefix": pa.array([x.tobytes() for x in prefix], pa.binary())})

    rows = S.map_arrow(active.select("class", "signature", "trees"), S.arrow_map(orders), "tree int, class long, prefix binary")
    rows = rows.repartitionByRange(parts, "tree", "prefix", "class").sortWithinPartitions("tree", "prefix", "class")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, ids = batch.column("tree").to_numpy(), batch.column("class").to_numpy()
            prefix = np.frombuffer(b"".join(batch.column("prefix").to_pylist()), ">u4").reshape(-1, shown)
            if last is not None:
                tree, ids, prefix = np.append(last[0], tree), np.append(last[1], ids), np.vstack([last[2], prefix])
            last = tree[-1:], ids[-1:], prefix[-1:]
            same = np.cumprod(prefix[1:] == prefix[:-1], axis=1).sum(axis=1) * (tree[1:] == tree[:-1])
            found = np.flatnonzero(same >= ROOT)
            if len(found):
                a, b = ids[found], ids[found + 1]
                yield pa.record_batch({"a": pa.array(np.maximum(a, b)), "b": pa.array(np.minimum(a, b)), "shared": pa.array(same[found].astype(np.int32))})

    return S.map_arrow(rows, pairs, "a long, b long, shared int")


def _least_same(values: int, percent: int) -> int:
    """Values on which the signatures of two sets at the threshold agree, but for the few cases beyond SIGMAS deviations."""
    share = percent / 100
    return int(np.floor(values * share - SIGMAS * np.sqrt(values * share * (1 - share))))


def _shown(active: DataFrame, values: int) -> DataFrame:
    """(class, shown): signatures as arrays, for comparison inside a join."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat = _unpack(batch.column("signature"), values).astype(np.int32).ravel()
        return pa.record_batch({"class": batch.column("class"), "shown": pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, values, dtype=np.int32), flat)})

    return S.map_arrow(active.select("class", "signature"), S.arrow_map(run), "class long, shown array<int>")


def _likely(pairs: DataFrame, active: DataFrame, values: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow the threshold, with the number of values on which they agree."""
    one = active.select(F.col("class").alias("a"), F.col("n_shingles").alias("na"), F.col("signature").alias("sa"))
    two = active.select(F.col("class").alias("b"), F.col("n_shingles").alias("nb"), F.col("signature").alias("sb"))
    least = _least_same(values, percent)
    fits = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def agree(batch: pa.RecordBatch) -> pa.RecordBatch:
        same = (_unpack(batch.column("sa"), values) == _unpack(batch.column("sb"), values)).sum(axis=1)
        keep = same >= least
        return pa.record_batch({"a": pa.array(batch.column("a").to_numpy()[keep]), "b": pa.array(batch.column("b").to_numpy()[keep]),
                                "same": pa.array(same[keep].astype(np.int32))})

    sized = pairs.join(one, "a").join(two, (pairs["b"] == two["b"]) & fits).drop(two["b"])
    return S.map_arrow(sized.select("a", "b", "sa", "sb"), S.arrow_map(agree), "a long, b long, same int")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those with 100 * intersection >= percent * union of their full sets; other columns stay."""
    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.sort(np.concatenate([x, y]))
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        return batch.drop_columns(["sa", "sb"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("class").alias("first"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("class").alias("second"), F.col("shingles").alias("sb"))
    paired = pairs.join(one, pairs["a"] == one["first"]).join(two, pairs["b"] == two["second"])
    return S.map_arrow(paired.select(*pairs.columns, "sa", "sb"), S.arrow_map(check), pairs.schema)


def _class_sets(documents: DataFrame, active: DataFrame, width: int) -> DataFrame:
    """The full shingle set of each active class, from the text that stands for it."""
    wanted = active.select("text_key", F.col("class"))
    texts = S.pick(documents, text="text").select(S.whole_text("text").alias("text")).withColumn("text_key", F.xxhash64("text"))
    texts = texts.join(wanted.select("text_key"), "text_key", "left_semi")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, at = _sets(batch.column("text"), width)
        d0, d1 = _digests(hashes, at)
        if 8 * at[-1] >= 1 << 31:
            raise ValueError("lower spark.sql.execution.arrow.maxRecordsPerBatch: over 2 GB of shingles in a batch")
        binary = pa.Array.from_buffers(pa.binary(), len(d0), [None, pa.py_buffer((8 * at).astype(np.int32).tobytes()), pa.py_buffer(hashes.tobytes())])
        return pa.record_batch({"d0": pa.array(d0), "d1": pa.array(d1), "shingles": binary})

    found = S.map_arrow(texts.select("text"), S.arrow_map(run), "d0 long, d1 long, shingles binary")
    found = found.join(active.select("d0", "d1", "class"), ["d0", "d1"]).select("class", "shingles")
    return found.dropDuplicates(["class"])


class _Counts:
    """For buckets of hashes: how many shingles fall in them, and the least and greatest root of their sets."""

    def __init__(self, size: int):
        self.n, self.low, self.high = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.full(size, np.iinfo(np.int64).min)

    def add(self, bucket: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Distinct buckets with their counts."""
        self.n[bucket] += n
        self.low[bucket] = np.minimum(self.low[bucket], low)
        self.high[bucket] = np.maximum(self.high[bucket], high)


def _shared_buckets(crowd: DataFrame) -> np.ndarray:
    """2**BUCKET_BITS counts: how many shingles of the crowd's sets fall in each bucket of hashes; 0 where all of them are of one root.

    Its size is fixed and does not grow with the data. It only orders shingles: whatever it says, the order is the same for all sets.
    Each task counts all its sets and hands on one row per block of buckets.
    """
    block = 1 << BUCKET_BITS - 4

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Counts(1 << BUCKET_BITS)
        for batch in batches:
            if batch.num_rows:
                flat = np.frombuffer(b"".join(batch.column("shingles").to_pylist()), np.uint64)
                bucket, of = flat >> np.uint64(64 - BUCKET_BITS), np.repeat(batch.column("root").to_numpy(), batch.column("n").to_numpy())
                order = np.lexsort((of, bucket))
                bucket, of = bucket[order].astype(np.int64), of[order]
                starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                ends = np.append(starts[1:], len(bucket))
                own.add(bucket[starts], ends - starts, of[starts], of[ends - 1])
        for k in range(16):
            some = np.flatnonzero(own.n[k * block : (k + 1) * block])
            at = some + k * block
            if len(some):
                yield pa.record_batch({"block": pa.array([k], pa.int32()), **{
                    name: pa.array([x.tobytes()], pa.binary()) for name, x in (("bucket", some), ("n", own.n[at]), ("low", own.low[at]), ("high", own.high[at]))}})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, _Counts] = {}
        for batch in batches:
            for k, *parts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                whole.setdefault(k, _Counts(block)).add(*[np.frombuffer(x, np.int64) for x in parts])
        for k, counts in whole.items():
            some = np.flatnonzero(counts.low < counts.high)
            yield pa.record_batch({"block": pa.array([k], pa.int32()), "bucket": pa.array([some.astype(np.int32).tobytes()], pa.binary()),
                                   "n": pa.array([np.minimum(counts.n[some], (1 << 32) - 1).astype(np.uint32).tobytes()], pa.binary())})

    parts = S.map_arrow(crowd.select("root", "n", "shingles"), count, "block int, bucket binary, n binary, low binary, high binary")
    counts = np.zeros(1 << BUCKET_BITS, np.uint32)
    for k, bucket, n in S.map_arrow(parts.repartition("block"), merge, "block int, bucket binary, n binary").collect():  # 16 rows
        counts[np.frombuffer(bucket, np.int32) + k * block] = np.frombuffer(n, np.uint32)
    return counts


def _prefix_pairs(crowd: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of crowd(class, root, n, shingles) with different roots (ra, rb), among them all that reach the threshold, by an exact
    prefix filter.

    Shingles are ordered by the count of their bucket: first those that one root alone has, which can't be in such a pair and don't leave
    the task, then from rare to frequent. Only the first fifth or so of each set goes on. `place` counts from 1 in the order.
    """
    counts = crowd.sparkSession.sparkContext.broadcast(_shared_buckets(crowd))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n").to_numpy()
            for a, b in S.chunks_of(sizes, 1 << 20):
                n = sizes[a:b]
                row = np.repeat(np.arange(b - a), n)
                flat = np.frombuffer(b"".join(batch.column("shingles").slice(a, b - a).to_pylist()), np.uint64)
                times = counts.value[flat >> np.uint64(64 - BUCKET_BITS)]
                order = np.lexsort((flat, times, row))
                place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) + 1
                # of two sets the larger shows the longer prefix, the smaller the shorter one
                shown = (place <= (n - (n * percent + 99) // 100 + 1)[row]) & (times[order] > 0)
                order, place, row = order[shown], place[shown], row[shown]
                short = place <= (n - (2 * n * percent + 99 + percent) // (100 + percent) + 1)[row]
                at = pa.array(row + a)
                yield pa.record_batch({**{c: batch.column(c).take(at) for c in ("class", "root", "n")}, "shingle": pa.array(flat[order].view(np.int64)),
                                       "place": pa.array(place.astype(np.int64)), "short": pa.array(short)})

    first = _store(S.map_arrow(crowd, run, "class long, root long, n long, shingle long, place long, short boolean"), "prefixes")
    salts = first.groupBy("shingle").agg(F.ceil(F.count("*") / PER_TASK).cast("int").alias("salts"), F.min("root").alias("low"), F.max("root").alias("high"))
    first = first.join(salts.where("low < high").select("shingle", "salts"), "shingle")
    x = first.where("short").select("shingle", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("class").alias("x"),
                                    F.col("root").alias("rx"), F.col("n").alias("nx"), F.col("place").alias("px"))
    y = first.select("shingle", F.pmod(F.xxhash64("class"), F.col("salts")).cast("int").alias("salt"), F.col("class").alias("y"),
                     F.col("root").alias("ry"), F.col("n").alias("ny"), F.col("place").alias("py"))
    pair = (x["shingle"] == y["shingle"]) & (x["salt"] == y["salt"]) & F.expr(
        f"rx <> ry and (nx < ny or nx = ny and x < y) and nx * 100 >= ny * {percent}"
        f" and least(nx - px, ny - py) + 1 >= ({percent} * (nx + ny) + {99 + percent}) div {100 + percent}")
    return x.join(y, pair).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"), F.greatest("rx", "ry").alias("ra"),
                                  F.least("rx", "ry").alias("rb")).distinct()


def classes_and_components(documents: DataFrame, width: int = 5, percent: int = 80, trees: int = TREES,
                           pairs_per_class: int = PAIRS_PER_CLASS) -> tuple[DataFrame, DataFrame]:
    """(documents with d0, d1, n_shingles; classes with d0, d1, class, smallest and root), the steps of the module's head."""
    spark = documents.sparkSession
    values, parts = ROOT * trees, S.partitions(spark)
    docs = _store(_documents(documents, width, values), "signatures")
    classes = docs.where("n_shingles > 0").groupBy("d0", "d1").agg(
        F.min(F.struct("text_key", "signature", "n_shingles")).alias("s"), F.min("doc_id").alias("smallest"))
    classes = _store(classes.select(F.monotonically_increasing_id().alias("class"), "d0", "d1", "smallest", "s.text_key", "s.signature", "s.n_shingles"), "classes")

    regions = _regions(classes, ROOT, trees, values)
    crowded = regions.groupBy("key").agg(F.count("*").alias("n"), F.min("class").alias("head")).where("n > 1")
    crowded = _store(regions.join(crowded, "key").select("class", "tree", "key", "head"), "regions")
    own = crowded.groupBy("class").agg(F.collect_list("tree").alias("trees"))  # at most `trees` numbers
    active = _store(classes.join(own, "class"), "active")
    sets = _store(_class_sets(documents, active, width), "sets")

    heads = crowded.where("class <> head").select(F.col("class").alias("a"), F.col("head").alias("b"))
    near = _neighbours(active, trees, values, parts).select("a", "b").union(heads).distinct()
    likely = _store(_likely(near, active, values, percent), "candidates")
    both = likely.select("a", "b", "same").union(likely.select(F.col("b").alias("a"), F.col("a").alias("b"), "same"))
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("same"), "b"))
    alike = both.withColumn("place", best).where(F.col("place") <= OFFERS).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    tried = _store(likely.groupBy("a").agg(F.min("b").alias("b")).union(alike).distinct(), "offers")
    of = S.components(_confirmed(tried, sets, percent))

    # regions that are still mixed: few outsiders are compared, the others are split by longer prefixes
    opened, found = _with_root(crowded.select("class", "tree", "key"), of, "class", "root"), []
    for depth in DEPTHS:
        if depth > ROOT:
            opened = opened.join(_regions(active, depth, trees, values), ["class", "tree"])
        members = _store(_sorted_out(opened, pairs_per_class), "mixed-regions")
        found.append(members.where("small").select("class", "key", "root"))
        opened = members.where("not small").select("class", "tree", "root")
        if opened.isEmpty():
            break
    small = _small_pairs(reduce(DataFrame.union, found), active, values, percent)
    rest = small.dropDuplicates(["a", "b"]).join(tried, ["a", "b"], "left_anti")
    of = S.joined_components(of, S.components(_confirmed(rest, sets, percent), "ra", "rb"))

    # what is open after that: classes of different roots in regions that were full at the least depth
    members = _sorted_out(_with_root(crowded.select("class", "tree", "key"), of, "class", "root"), pairs_per_class)
    crowd = members.where("not small").select("class", "root").distinct().join(sets, "class")
    crowd = _store(crowd.select("class", "root", F.expr("octet_length(shingles) div 8").alias("n"), "shingles"), "crowd")
    if not crowd.isEmpty():
        rest = _prefix_pairs(crowd, percent)
        of = S.joined_components(of, S.components(_confirmed(rest, sets, percent), "ra", "rb"))
    return docs, _with_root(classes.drop("signature"), of, "class", "root")


def _sorted_out(members: DataFrame, pairs_per_class: int) -> DataFrame:
    """members(class, tree, key, root) of regions with several roots; `small` tells where few classes are outside the largest one."""
    by_root = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = by_root.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("largest"), F.count("*").alias("roots")).where("roots > 1")
    mixed = mixed.select("key", (F.col("n") - F.col("largest") <= pairs_per_class).alias("small"))
    return members.join(mixed, "key")


def _small_pairs(small: DataFrame, active: DataFrame, values: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different roots (ra, rb) in small regions whose signatures allow the threshold."""
    # a pair that shares several of these regions is made in the first of them alone
    small = small.withColumn("keys", F.sort_array(F.collect_list("key").over(Window.partitionBy("class"))))  # at most `trees` rows a class and depth
    small = small.select("class", "root", "key", "keys").join(_shown(active, values), "class")
    x = small.select("key", F.col("class").alias("a"), F.col("root").alias("ra"), F.col("keys").alias("ka"), F.col("shown").alias("sa"))
    y = small.select("key", F.col("class").alias("b"), F.col("root").alias("rb"), F.col("keys").alias("kb"), F.col("shown").alias("sb"))
    pair = (x["key"] == y["key"]) & (F.col("a") > F.col("b")) & (F.col("ra") != F.col("rb"))
    pair &= F.get(F.array_intersect("ka", "kb"), 0) == x["key"]
    same = F.aggregate(F.zip_with("sa", "sb", lambda p, q: (p == q).cast("int")), F.lit(0), lambda n, p: n + p)
    pair &= same >= _least_same(values, percent)
    return x.join(y, pair).select("a", "b", "ra", "rb")


def _with_root(rows: DataFrame, of: DataFrame, column: str, name: str) -> DataFrame:
    known = of.select(F.col("node").alias(column), F.col("root").alias(name))
    return rows.join(known, column, "left").withColumn(name, F.coalesce(name, column))


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80, trees: int = TREES, pairs_per_class: int = PAIRS_PER_CLASS) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_shingles, component_id, kept, text_key, one row per row.

    Texts are linked when 100 * intersection >= percent * union of their sets of `width`-word shingles (A-Z lower-cased, words between ASCII
    white space; a shorter text is one shingle). `component_id` is the smallest doc_id that can be reached over links, the document's own
    included; a null doc_id counts only where no other is there. `kept` is true for documents whose doc_id is the component's. Null texts and
    texts without words have no shingles and no links: each is a component of its own. Rows that repeat have equal results. An empty table
    gives an empty result; other columns are ignored. Very long texts are sets like any other.
    """
    docs, classes = classes_and_components(documents, width, percent, trees, pairs_per_class)
    # stored, so that the join has plain exchanges on both sides and can split a component that a third of all classes are in
    smallest = _store(classes.groupBy("root").agg(F.min("smallest").alias("component_id")), "smallest")
    named = classes.join(smallest, "root").select("d0", "d1", "component_id")
    some = docs.where("n_shingles > 0").join(named, ["d0", "d1"]).select("doc_id", "n_shingles", "component_id", "text_key")
    none = docs.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_key")
    return some.unionByName(none).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key")


def drop_near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, of which one row of each component stays: its smallest doc_id, of repeated rows with that id one."""
    decided = near_duplicates(documents, width, percent)
    lost = decided.where("not kept").select(F.col("doc_id").alias("lost_id"), F.col("text_key").alias("lost_key")).distinct()
    key = F.xxhash64(S.whole_text(documents["text"]))
    left = documents.join(lost, documents["doc_id"].eqNullSafe(lost["lost_id"]) & (key == lost["lost_key"]), "left_anti")
    if decided.where("kept").groupBy("doc_id").count().where("count > 1").isEmpty():
        return left
    ids = decided.where("kept and n_shingles > 0").groupBy("doc_id").agg(F.min("text_key").alias("first_key"), F.count("*").alias("times")).where("times > 1")
    left = left.withColumn("__key", F.xxhash64(S.whole_text("text")))
    ids = ids.withColumnRenamed("doc_id", "__id")
    left = left.join(ids, left["doc_id"].eqNullSafe(ids["__id"]), "left").where("first_key is null or first_key = __key")
    once = left.where("first_key is not null").dropDuplicates(["doc_id"])
    return left.where("first_key is null").unionByName(once).drop("__key", "__id", "first_key", "times")
