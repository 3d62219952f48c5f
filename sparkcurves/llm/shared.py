"""Helpers that several operators of this package share: stored results, word hashes, components."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


# --- stored results ---------------------------------------------------------------------------------------------------

def store_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or the checkpoint folder that is set; where there is none, one in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stored"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is already gone; the folder's owner cleans up
        pass


def store(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: computed once, safe when executors are lost.

    The folder is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    folder = f"{store_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    atexit.register(_remove, spark, folder)
    return spark.read.schema(df.schema).parquet(folder)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle and checkpoint files of frames that are gone.

    It works on garbage collections of the driver, which are rare; a driver that runs many jobs in a row says when.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under new names, so that extra columns can't clash with those an operator adds."""
    return df.select(*[df[f"`{old}`"].alias(new) for new, old in columns.items()])


def whole_text(text: Column | str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once for each Spark context, so that they need no copy of their own."""
    context = spark.sparkContext
    if getattr(context, "_llm_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="llm-code-"), "sparkcurves_llm.zip")
    with zipfile.ZipFile(target, "w") as file:
        file.writestr("sparkcurves/__init__.py", "")
        for name in sorted(os.listdir(here)):
            if name.endswith(".py"):
                file.write(os.path.join(here, name), f"sparkcurves/llm/{name}")
    context.addPyFile(target)
    context._llm_shipped = True


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """mapInArrow with this package's code on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def arrow_map(function: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable:
    """A function for mapInArrow that maps one batch to one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = function(batch)
                if made is not None and made.num_rows:
                    yield made

    return run


# --- word hashes ------------------------------------------------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over all output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C55  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(max(n, 1 << 20), base, U64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"]


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of an Arrow string array without nulls, without copying texts one by one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    large = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers_of(len(data))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * up, out=total[1:])
    hashes = (total[ends] - total[starts]) * down[starts]
    return mix(hashes ^ ((ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """64-bit hash of the bytes of each span; spans are in order and don't overlap."""
    out = [np.zeros(0, U64)]
    for a, b in chunks_of(ends - starts, most) if len(starts) < 4096 else _even_chunks(starts, ends, most):
        base = starts[a]
        out.append(_spans(data[base : ends[b - 1]], starts[a:b] - base, ends[a:b] - base))
    return np.concatenate(out)


def _even_chunks(starts: np.ndarray, ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + most, "right")))
        yield at, to
        at = to


def _word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = ~_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    hashes = _spans(_LOWER[data] if lower else data, starts, ends)
    return hashes, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, n + 1 offsets of each text's words); words are runs without ASCII white space."""
    hashes, sizes = [], []
    for a, b in chunks_of(np.diff(offsets), most):
        own, at = _word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower)
        hashes.append(own)
        sizes.append(np.diff(at))
    if not hashes:
        return np.zeros(0, U64), np.zeros(1, np.int64)
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def chunks_of(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of items whose lengths sum to about `most`; a longer item is a run of its own."""
    at, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if len(lengths) > at:
        yield at, len(lengths)


def shingle_hashes(words: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's runs of `width` words; a shorter text has one for its whole sequence.

    Returns (hashes, n + 1 offsets). A text without words has none.
    """
    counts = np.diff(at)
    rolled = np.zeros(len(words), U64)
    for j in range(width):
        shifted = np.zeros(len(words), U64)
        if j < len(words):  # all texts together may have fewer words than one shingle
            shifted[: len(words) - j] = words[j:]
        rolled = mix(rolled * U64(0x9E3779B97F4A7C15) + shifted + U64(j + 1))
    out, sizes = [], np.zeros(len(counts), np.int64)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if b - a >= width:
            x = np.sort(rolled[a : b - width + 1])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            x = x[keep]
        elif b > a:
            h = U64(b - a)
            for w in words[a:b]:
                h = mix(np.array([h], U64) * U64(3) ^ w)[0]
            x = np.array([h], U64)
        else:
            continue
        out.append(x)
        sizes[i] = len(x)
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.concatenate([[0], np.cumsum(sizes)])


# --- connected components ---------------------------------------------------------------------------------------------

def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of an edge list of integers; root is the smallest node that can be reached.

    Alternates two star steps: every node hands its larger neighbours to its smallest one, then its smaller ones. Each step is a
    grouped minimum and a join, so a node with very many neighbours is never gathered into one row; the state is stored after
    each round. Rounds end when all components are stars, after a number of them that grows with the logarithm of the size;
    what was stored last then holds the roots.
    """
    spark = edges.sparkSession
    state = store(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(most_rounds):
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") < F.col("u")).alias("up"), F.max("v").alias("top"))
        # written, so that the join has plain exchanges on both sides and can split a node with very many neighbours
        low = store(low.select("u", F.least("u", "m").alias("m"), F.expr("up > 1 or up = 1 and top > u").alias("open")), "least")
        if low.where("open").isEmpty():  # every node is the centre of a star or has its centre as only neighbour
            return low.select(F.col("u").alias("node"), F.col("m").alias("root"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        state = store(small.where("u <> v").distinct(), "stars")
        tidy(spark)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def joined_components(of: DataFrame, more: DataFrame) -> DataFrame:
    """Components of(node, root) after edges between their roots, or nodes that had none, have made components more(node, root) of these."""
    later = more.select(F.col("node").alias("root"), F.col("root").alias("later"))
    return store(of.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root")).union(more).distinct(), "components")
