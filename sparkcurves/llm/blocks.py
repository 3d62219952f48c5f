"""Exact duplicates by deterministic block naming.

A text's UTF-8 bytes are cut into fixed-size blocks. All distinct blocks are sorted and numbered: equal blocks, and only those, share
a name. Then adjacent names are paired, the distinct pairs are sorted and numbered in turn, and so on, until each text is left with
one name. Texts are equal exactly when they agree in length, number of levels and last name; no hash decides.

At scale: a text moves once, as blocks that are first combined within each map task, so thousands of copies shuffle as one block a task.
What travels per text is a 16-byte key a block. The key is a pair of seeded hashes that is *checked* to tell all distinct blocks
apart, with new seeds where it doesn't; it only carries names back, through joins that split hot keys at run time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurves.llm import shared as S

BLOCK_BYTES = 4096


def _keys(block: Column, seed: int, bits: int) -> Column:
    halves = [F.xxhash64(F.lit(2 * seed + i), block) for i in (0, 1)]
    if bits < 64:
        halves = [F.pmod(h, F.lit(1 << bits)) for h in halves]
    return F.struct(halves[0].alias("k0"), halves[1].alias("k1"))


def _cut(data: Column, block_bytes: int) -> Column:
    """The blocks of a binary column; none for an empty one."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.octet_length(data), F.lit(1)) - 1) / block_bytes).cast("int")),
                       lambda i: F.substring(data, i * block_bytes + 1, F.lit(block_bytes)))


def _numbered(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Distinct rows with an integer name each, by sorted order within a partition; the caller stores the result."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def identities(rows: DataFrame, block_bytes: int = BLOCK_BYTES, key_bits: int = 64, most_seeds: int = 8) -> DataFrame:
    """rows(row, text, ...) -> rows without text, with n_bytes, level and name: equal texts, and only those, agree in all three.

    `row` must be unique. Null texts are empty ones. An empty text has level 0 and the name of the empty block. Very long
    texts only add blocks and levels. An empty table gives an empty result.
    """
    data = F.col("text").cast("binary")
    rows = rows.withColumn("text", S.whole_text("text"))
    carried = [c for c in rows.columns if c not in ("row", "text")]
    for seed in range(most_seeds):
        names = S.store(
            _numbered(rows.select(F.explode(_cut(data, block_bytes)).alias("block")).groupBy("block").agg(F.lit(1).alias("one")), ["block"])
            .select("name", _keys(F.col("block"), seed, key_bits).alias("key")).select("name", "key.k0", "key.k1"), "block-names")
        if names.groupBy("k0", "k1").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("no key tells all blocks apart")
    texts = S.store(rows.select("row", *carried, F.octet_length(data).cast("long").alias("n_bytes"),
                                F.transform(_cut(data, block_bytes), lambda b: _keys(b, seed, key_bits)).alias("keys")), "block-keys")
    parts = texts.select("row", F.size("keys").alias("n"), F.posexplode("keys").alias("i", "key"))
    named = parts.select("row", "n", "i", "key.k0", "key.k1").join(names, ["k0", "k1"]).select("row", "n", "i", "name")
    longest = texts.agg(F.max(F.size("keys"))).first()[0] or 0
    finished, level = [], 0
    while True:
        finished.append(named.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
        if longest <= 1:
            break
        named = S.store(named.where("n > 1"), "block-level")
        pairs = named.groupBy("row", "n", F.floor(F.col("i") / 2).cast("int").alias("i")).agg(
            F.min(F.struct("i", "name"))["name"].alias("left"),
            F.when(F.count("*") == 2, F.max(F.struct("i", "name"))["name"]).otherwise(F.lit(-1)).alias("right"))
        names = S.store(_numbered(pairs.groupBy("left", "right").agg(F.lit(1).alias("one")), ["left", "right"]).drop("one"), "pair-names")
        named = pairs.join(names, ["left", "right"]).select("row", F.ceil(F.col("n") / 2).cast("int").alias("n"), "i", "name")
        longest, level = (longest + 1) // 2, level + 1
    ends = reduce(DataFrame.unionByName, finished)
    return texts.drop("keys").join(ends, "row")


def exact_duplicates(documents: DataFrame, block_bytes: int = BLOCK_BYTES, key_bits: int = 64, keep: str = "largest") -> DataFrame:
    """documents(doc_id, text) -> doc_id, keep_id, group_size, kept, text_sha256, row, one row per row.

    Of equal texts the row with the largest (or "smallest") doc_id stays; a null doc_id loses to any other, and of rows that repeat
    the same doc_id and text one stays. Null texts are equal to empty ones. Empty tables give empty results; further columns are ignored.
    """
    rows = S.pick(documents, doc_id="doc_id", text="text").select(
        "doc_id", "text", F.monotonically_increasing_id().alias("row"), F.sha2(S.whole_text("text").cast("binary"), 256).alias("text_sha256"))
    named = S.store(identities(rows, block_bytes, key_bits), "block-identities")
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), (F.col("doc_id") if keep == "largest" else -F.col("doc_id")).alias("rank"), "row", "doc_id")
    identity = ["n_bytes", "level", "name"]
    # stored, so that the join below has plain exchanges on both sides and can split a group that a third of all rows are in
    groups = S.store(named.groupBy(*identity).agg(F.count("*").alias("group_size"), F.max(order).alias("best")), "block-groups")
    return named.join(groups, identity).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", "row")


def drop_exact_duplicates(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns, with one row of each group of equal texts: the one with the largest doc_id.

    Rows equal in doc_id and text are told apart by nothing else than their place; one of them stays.
    """
    decided = exact_duplicates(documents, block_bytes)
    losers = decided.where("not kept").select(F.col("doc_id").alias("lost_id"), F.col("text_sha256").alias("lost_sha"))
    # rows that repeat one doc_id with one text: the copy that stays must not be struck out with the others
    spared = decided.where("kept").select(F.col("doc_id").alias("lost_id"), F.col("text_sha256").alias("lost_sha"))
    losers = losers.distinct().join(spared, (losers.lost_sha == spared.lost_sha) & losers.lost_id.eqNullSafe(spared.lost_id), "left_anti")
    sha = F.sha2(S.whole_text(documents["text"]).cast("binary"), 256)
    left = documents.join(losers, documents["doc_id"].eqNullSafe(losers["lost_id"]) & (sha == losers["lost_sha"]), "left_anti")
    repeats = decided.groupBy("doc_id", "text_sha256").count().where("count > 1")
    if repeats.isEmpty():
        return left
    return left.withColumn("__sha", F.sha2(S.whole_text("text").cast("binary"), 256)).dropDuplicates(["doc_id", "__sha"]).drop("__sha")
