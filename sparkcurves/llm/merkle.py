"""Merkle manifest of a dataset: a nested-struct rollup.

Leaves are ranked by doc_id within their group (lang). The octal digits of a rank become columns, and within a block of 512 consecutive
leaves the digits are grouped away one after the other: each grouping hashes up to eight children and nests their structs in the
parent's. All three groupings of a block need one exchange, since they keep the block's own columns. A block becomes one leaf of the next tier,
which is rolled up the same way, until one block is left in each group; the groups' roots form a last tree.

Proofs come down by `transform` and `explode` over the nested structs: opening a node hands each child the digests of its siblings. A
block gets what is above it by a union and a grouping on its own number. No join emits proofs, and no row is larger than one block.

At scale: texts never move, a leaf is hashed where it is read. Ranks come from one range exchange over (group, doc_id, leaf), so that a group
with a third of all rows lies in a third of the partitions; the only join brings each partition's start, one row per partition and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkcurves.llm import shared as S

FAN, DIGITS = 8, 3  # children of a node; levels rolled up within one block
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """`-` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _digest(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ""), 256)


def _ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes(key, ...) with rank (from 0 within its key) and levels (of its key's tree)."""
    n = S.partitions(nodes.sparkSession)
    tied = nodes.withColumn("tie", F.monotonically_increasing_id())  # equal rows are spread over partitions, too
    placed = S.store(
        tied.repartitionByRange(n, "key", *order, "tie").sortWithinPartitions("key", *order, "tie")
        .withColumn("place", F.monotonically_increasing_id()).drop("tie"), "merkle-places")
    part = F.shiftright("place", 33)
    runs = placed.groupBy("key", part.alias("part")).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(Window.partitionBy("key"))
    levels = sum((total > FAN ** i).cast("int") for i in range(21))
    runs = runs.select(F.col("key").alias("k"), "part", levels.alias("levels"),
                       (F.col("first") - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("origin"))
    found = placed.join(runs, F.col("key").eqNullSafe(F.col("k")) & (part == F.col("part")))
    return found.withColumn("rank", F.col("place") - F.col("origin")).drop("k", "part", "place", "origin")


def _rolled(nodes: DataFrame) -> DataFrame:
    """nodes(key, rank, levels, hash, item) -> one row per block: key, rank, levels above it, hash, kids (nested)."""
    digit = lambda i: F.shiftright("rank", 3 * i).bitwiseAND(FAN - 1).cast("int").alias(f"d{i}")
    block = F.shiftright("rank", 3 * DIGITS).alias("block")
    level = nodes.select("key", block, "levels", *[digit(i) for i in range(DIGITS)], "hash", F.col("item").alias("kids"))
    level = level.repartition(S.partitions(nodes.sparkSession), "key", "block")
    for i in range(DIGITS):
        kid = F.struct(F.col(f"d{i}").alias("digit"), "hash", "kids")
        kept = [f"d{j}" for j in range(DIGITS - 1, i, -1)]
        level = level.groupBy("key", "block", "levels", *kept).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        # a tree that has reached its root stays as it is
        hashed = F.when(F.col("levels") > i, _digest(F.col("kids.hash"))).otherwise(F.col("kids")[0]["hash"])
        level = level.withColumn("hash", hashed)
    return level.select("key", F.col("block").alias("rank"), (F.col("levels") - DIGITS).alias("levels"), "hash", "kids")


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of a forest from the leaves up; the last frame has one block for each key."""
    tiers = []
    while True:
        blocks = S.store(_rolled(nodes), "merkle-blocks")
        tiers.append(blocks)
        if (blocks.agg(F.max("levels")).first()[0] or 0) <= 0:
            return tiers
        nodes = blocks.select("key", "rank", "levels", "hash", F.lit(0).alias("item"))


def _opened(blocks: DataFrame, above: list[str]) -> DataFrame:
    """blocks with `path` (array<struct<left, right>> from the block up) -> its nodes: key, rank, hash, item, path, and columns `above`."""
    rows = blocks.select("key", "rank", "levels", "kids", "path", *above)
    for i in reversed(range(DIGITS)):
        hashes = F.col("kids.hash")
        opened = F.transform("kids", lambda kid, at: F.struct(
            kid.alias("kid"),
            F.struct(F.array_join(F.slice(hashes, F.lit(1), at), "").alias("left"),
                     F.array_join(F.slice(hashes, at + 2, F.lit(FAN)), "").alias("right")).alias("step")))
        rows = rows.select("key", "rank", "levels", "path", *above, F.explode(opened).alias("one"))
        path = F.when(F.col("levels") + DIGITS > i, F.concat(F.array("one.step"), "path")).otherwise(F.col("path"))
        rows = rows.select("key", (F.col("rank") * FAN + F.col("one.kid.digit")).alias("rank"), "levels", F.col("one.kid.hash").alias("hash"),
                           F.col("one.kid.kids").alias("kids"), path.alias("path"), *above)
    return rows.withColumnRenamed("kids", "item").drop("levels")


def _descended(tiers: list[DataFrame], paths: DataFrame, above: list[str]) -> DataFrame:
    """Nodes of the lowest tier with their paths; `paths` (key, rank, path, columns `above`) says what is over each block of the last."""
    for blocks in reversed(tiers):
        both = blocks.drop("hash").unionByName(paths, allowMissingColumns=True)
        whole = both.groupBy("key", "rank").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("levels", "kids", "path", *above)])
        nodes = _opened(whole, above)
        paths = nodes.drop("hash", "item")
    return nodes


def manifest(documents: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """documents(doc_id, source, lang, n_chars, text) -> doc_id, lang, leaf, path, subroot, root, and the columns `carry`: one row per row.

    `path` is array<struct<left, right>>: at each level up to the root the digests of the siblings before and after, joined as text. Nodes
    with no sibling have two empty strings there. Leaves ascend by doc_id within their lang, a null doc_id first, equal ones by leaf; langs
    ascend bytewise, null first, and a null lang is a lang like any other. Null values have leaves of their own, other than empty ones.
    Rows repeated in full are leaves of their own with equal hashes. One row makes a tree of its leaf alone. An empty table gives no rows.
    Further columns are ignored; `carry` names expressions over the documents that are computed where they are read.
    """
    carry = carry or {}
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    leaves = S.store(documents.select(
        documents["lang"].cast("string").alias("key"), documents["doc_id"].alias("doc_id"),
        leaf_hash(*[documents[c] for c in names]).alias("hash"), F.struct(F.lit(0).alias("_"), *[c.alias(n) for n, c in carry.items()]).alias("carried")),
        "merkle-leaves")
    leaves = _ranked(leaves, ["doc_id", "hash"]).withColumn("item", F.struct("doc_id", "carried"))
    trees = _tiers(leaves.select("key", "rank", "levels", "hash", "item"))
    groups = trees[-1].select(F.lit("").alias("key"), F.col("key").alias("lang"), "hash")
    groups = _ranked(groups, ["lang"]).withColumn("item", F.struct("lang"))
    top = _tiers(groups.select("key", "rank", "levels", "hash", "item"))
    step = "array<struct<left:string,right:string>>"
    roots = top[-1].select("key", "rank", F.array().cast(step).alias("path"), F.col("hash").alias("root"))
    subroots = _descended(top, roots, ["root"]).select(
        F.col("item.lang").alias("key"), F.lit(0).cast("long").alias("rank"), "path", "root", F.col("hash").alias("subroot"))
    done = _descended(trees, subroots, ["root", "subroot"])
    return done.select(F.col("item.doc_id").alias("doc_id"), F.col("key").alias("lang"), F.col("hash").alias("leaf"), "path", "subroot", "root",
                       *[F.col(f"item.carried.{n}").alias(n) for n in carry])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda a, p: F.sha2(F.concat(p["left"], a, p["right"]), 256))


def tamper_audit(documents: DataFrame, every: int = 3) -> DataFrame:
    """The manifest of all documents, checked against a copy in which some texts have lost their capitals.

    A document whose crc32 of the decimal doc_id is divisible by `every` has A-Z lower-cased; others, null texts and rows with a null doc_id
    stay. Returns doc_id, leaf, subroot, root, proof_sha256 (hash of all siblings upwards), folded_root (of the copy's leaf), verified.
    """
    hit = F.crc32(documents["doc_id"].cast("string").cast("binary")) % every == 0
    text = F.when(hit, F.translate(documents["text"], UPPER, LOWER)).otherwise(documents["text"])
    seen = leaf_hash(*[documents[c] for c in ("doc_id", "source", "lang", "n_chars")], text)
    rows = manifest(documents, {"seen": seen}).withColumn("folded_root", folded(F.col("seen"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", _digest(F.transform("path", lambda p: F.concat(p["left"], p["right"]))).alias("proof_sha256"),
                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
