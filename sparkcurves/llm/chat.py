"""Reply trees to training conversations, with DataFrame functions only.

Messages form trees by their parent. Iterative self-joins follow the parents: round i knows each message's 2**i-th ancestor, so a thread of
n messages takes log2(n) rounds, and depth and branch score add up on the way. Every leaf is a branch; branches of a tree are ranked by score.
The chosen leaves gather their ancestors through the same pointers, and each path is written as one conversation.

Template: every turn is `<|role|>text<|end|>`. In roles and texts a backslash is written `\\b`, `<` is `\\l`, `[` is `\\k` and `|` is `\\p`, so
no marker, nor one of the common templates with angle or square brackets, can stand inside; `unescape` undoes it. The loss mask lists the
places of assistant texts in the formatted string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkcurves.llm import shared as S

CODES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\k"), ("|", "\\p"))
END = "<|end|>"


def escape(text: Column) -> Column:
    for plain, code in CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def branches(messages: DataFrame, best: int | None = None) -> DataFrame:
    """messages(tree, node, parent, role, text, score) -> tree, leaf, score, branch, turns: one row per chosen root-to-leaf path.

    `turns` is array<struct<depth, role, text>> from the root down; `score` the sum over the path (null counts 0); `branch` the rank by score
    within the tree, ties to the deeper path and then the smaller leaf; `best` keeps that many branches of each tree, None all.
    A parent that is null or not in the tree makes a root. Trees, nodes and parents may be null: null is a tree like any other, but null
    is no parent. Of rows that repeat a node the first by role and text has the replies; the others are leaves. Null roles and texts are
    empty. Messages in a ring have no root: ValueError. An empty table has no branches. Other columns are ignored.
    """
    rows = S.pick(messages, tree="tree", node="node", parent="parent", role="role", text="text", score="score")
    rows = S.store(rows.select(
        F.monotonically_increasing_id().alias("id"), "tree", "node", "parent", S.whole_text("role").alias("role"), S.whole_text("text").alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "messages")
    heads = rows.where("node is not null").groupBy(F.col("tree").alias("t"), F.col("node").alias("n")).agg(
        F.min(F.struct("role", "text", "id"))["id"].alias("up"))
    links = rows.where("parent is not null").join(heads, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")))
    links = links.select("id", "up")
    state = S.store(rows.join(links, "id", "left").select("id", "up", F.col("score").alias("total"), F.lit(1).cast("long").alias("depth")), "pointers")
    jumps, total = [], rows.count()
    while True:
        jump = state.where("up is not null").select("id", "up")
        if jump.isEmpty():
            break
        if 1 << len(jumps) > total:  # no thread is longer than all messages
            raise ValueError("messages reply to each other in a ring")
        jumps.append(jump)
        over = state.select(F.col("id").alias("up"), F.col("up").alias("far"), F.col("total").alias("more"), F.col("depth").alias("deeper"))
        further = state.where("up is not null").join(over, "up").select(
            "id", F.col("far").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("depth") + F.col("deeper")).alias("depth"))
        state = S.store(further.union(state.where("up is null")), "pointers")  # who has reached the root stays out of the join
    leaves = rows.join(links.select(F.col("up").alias("id")), "id", "left_anti").select("id", "tree", "node")
    leaves = leaves.join(state.select("id", "total", "depth"), "id")
    ranked = leaves.withColumn("branch", F.row_number().over(
        Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("depth"), "node", "id")))
    if best is not None:
        ranked = ranked.where(F.col("branch") <= best)
    chosen = S.store(ranked.select(F.col("id").alias("leaf_id"), "tree", F.col("node").alias("leaf"), F.col("total").alias("score"), "branch"), "leaves")
    members = chosen.select("leaf_id", F.col("leaf_id").alias("id"))
    for jump in reversed(jumps):  # far jumps first: a path doubles only once its own length is reached
        members = members.join(jump, "id", "left").select("leaf_id", F.explode(F.array("id", "up")).alias("id")).where("id is not null")
    turns = members.join(rows.select("id", "role", "text"), "id").join(state.select("id", "depth"), "id")
    paths = turns.groupBy("leaf_id").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    return chosen.join(paths, "leaf_id").drop("leaf_id")


def formatted(paths: DataFrame, turns: str = "turns") -> DataFrame:
    """Adds `formatted`, one string per path, and `loss_spans`, array<struct<start, length>>: 1-based places of the escaped assistant texts."""
    parts = F.transform(F.col(turns), lambda t: F.struct(
        F.concat(F.lit("<|"), escape(t["role"]), F.lit("|>")).alias("head"), escape(t["text"]).alias("body"),
        (t["role"] == "assistant").alias("loss")))
    paths = paths.withColumn("__parts", parts)
    text = F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    sized = F.transform("__parts", lambda p: F.struct(F.length(p["head"]).alias("h"), F.length(p["body"]).alias("b"), p["loss"].alias("loss")))
    # one walk over the turns keeps the place reached and the spans found so far
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate(sized, start, lambda a, p: F.struct(
        (a["at"] + p["h"] + p["b"] + len(END)).cast("int").alias("at"),
        F.when(p["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + p["h"]).cast("int").alias("start"), p["b"].cast("int").alias("length")))))
        .otherwise(a["spans"]).alias("spans")), lambda a: a["spans"])
    return paths.withColumn("formatted", text).withColumn("loss_spans", spans).drop("__parts")


def read_back(conversations: DataFrame) -> DataFrame:
    """Adds `read`, array<struct<role, text>> parsed from `formatted`, and `loss_text`, the unescaped text under the loss mask."""
    turns = F.filter(F.split("formatted", r"<\|end\|>"), lambda t: t != "")
    turn = lambda t: F.struct(
        unescape(F.substring_index(F.substring(t, 3, 1 << 30), "|>", 1)).alias("role"),
        unescape(F.substring(t, F.instr(t, "|>") + 2, F.length(t))).alias("text"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["length"]))), "")
    return conversations.withColumn("read", F.transform(turns, turn)).withColumn("loss_text", loss)


def threads(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as reply trees without forks: each row replies to the row before it by turn.

    Rows that repeat a turn follow each other by role and text; a null turn comes first.
    """
    rows = S.pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return rows.select(F.col("conv_id").alias("tree"), place.alias("node"), (place - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def conversation_digest(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) formatted, and what can be read back from the output, one row per conversation."""
    done = read_back(formatted(branches(threads(conversations))))
    spoken = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        F.col("tree").alias("conv_id"), F.size("read").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
