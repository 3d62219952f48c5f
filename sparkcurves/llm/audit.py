"""Repair of conversation structure by a persistent audit DP.

A conversation's rows go by once, in order. For each state that the repaired roles can be in, the cheapest edits so far are kept: a cost and a node of a
shared tree, whose path from the root spells the edits' initials. A new edit is one new node on an old prefix. A node knows its ancestors at
distances 1, 2, 4, ... and a rolling hash of its path, so two audits of equal cost are compared by a search for their longest common
prefix; where hashes say "equal" the letters are compared once and the result is remembered, so a collision changes nothing.

At scale: rows are partitioned by conversation and sorted on disk by Spark, and stream through a task; no conversation is held as a whole. What all
states agree on is given out and forgotten from time to time, and states that can no longer win are dropped. A conversation's digest and audit
are in row order by contract, so one conversation is one task; copies of rows are found by Spark's windows, not in the task.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkcurves.llm import shared as S

ASCII_SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)  # what the repaired roles end with
STEPS = {"s": ((START, SYSTEM),), "u": ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),)}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BASE = 1_000_003
MODULUS = (1 << 61) - 1


# --- audits as nodes of a shared tree ---------------------------------------------------------------------------------

class Node:
    """One edit after another; `up[k]` is the node 2**k edits before."""

    __slots__ = ("letter", "depth", "hash", "up", "same")

    def __init__(self, letter: str, depth: int, hash_: int, up: list[Node]):
        self.letter, self.depth, self.hash, self.up = letter, depth, hash_, up
        self.same = self  # an equal path that was compared letter by letter


class Audits:
    """Makes and compares nodes. A small modulus makes collisions likely, for tests."""

    def __init__(self, modulus: int = MODULUS):
        self.modulus = modulus
        self.root = Node("", 0, 0, [])

    def after(self, node: Node, letter: str) -> Node:
        up, k = [node], 0
        while k < len(up[k].up):
            up.append(up[k].up[k])
            k += 1
        return Node(letter, node.depth + 1, (node.hash * BASE + ord(letter)) % self.modulus, up)

    @staticmethod
    def ancestor(node: Node, depth: int) -> Node:
        while node.depth > depth:
            k = (node.depth - depth).bit_length() - 1
            node = node.up[k]
        return node

    @staticmethod
    def letters(node: Node, root: Node) -> str:
        out = []
        while node is not root:
            out.append(node.letter)
            node = node.up[0]
        return "".join(reversed(out))

    @staticmethod
    def _known(node: Node) -> Node:
        while node.same is not node:
            node.same = node.same.same
            node = node.same
        return node

    def _verified(self, x: Node, y: Node) -> bool:
        """Whether two nodes of one depth spell the same; each letter is compared at most once for a pair of classes."""
        pairs = []
        while self._known(x) is not self._known(y):
            if x.letter != y.letter:
                return False
            pairs.append((x, y))
            x, y = x.up[0], y.up[0]
        for a, b in pairs:
            self._known(a).same = self._known(b)
        return True

    def less(self, x: Node, y: Node) -> bool:
        """Whether x's letters come before y's, a prefix before what it begins."""
        depth = min(x.depth, y.depth)
        a, b = self.ancestor(x, depth), self.ancestor(y, depth)
        if a.hash == b.hash and self._verified(a, b):
            return x.depth < y.depth
        for k in reversed(range(len(a.up))):  # up to the last pair that differs: their parents are equal, as far as hashes know
            if k < len(a.up) and a.up[k].hash != b.up[k].hash:
                a, b = a.up[k], b.up[k]
        if a.letter == b.letter or not self._verified(a.up[0], b.up[0]):  # a collision misled the search
            return self.letters(x, self.root) < self.letters(y, self.root)
        return a.letter < b.letter


# --- one conversation -------------------------------------------------------------------------------------------------

class Repair:
    """Takes rows in order and gives out (edit, role, text) once they are decided; texts are None where nothing stays."""

    def __init__(self, modulus: int = MODULUS, settle_every: int = 512):
        self.audits = Audits(modulus)
        self.heads: list[tuple[int, Node] | None] = [(0, self.audits.root), None, None, None]
        self.waiting: deque[tuple[str, str]] = deque()  # rows that are not yet given out
        self.state, self.base, self.settle_every, self.since = START, 0, settle_every, 0
        self._insert(self.heads)

    def _offer(self, heads: list, state: int, cost: int, node: Node, letter: str) -> None:
        best = heads[state]
        if best is not None and cost > best[0]:
            return
        made = self.audits.after(node, letter)
        if best is None or cost < best[0] or self.audits.less(made, best[1]):
            heads[state] = (cost, made)

    def _insert(self, heads: list) -> None:
        for state, to in (*STEPS["u"], *STEPS["a"]):  # a second round would only add cost
            if heads[state] is not None:
                self._offer(heads, to, heads[state][0] + INSERT, heads[state][1], "I")

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> Iterator[tuple[str, str | None, str | None]]:
        self.waiting.append((role, text))
        heads: list = [None] * 4
        for state, head in enumerate(self.heads):
            if head is not None:
                self._offer(heads, state, head[0] + DELETE, head[1], "D")
        if not must_go:
            extra = TRUNCATED if truncated else 0
            for letter, cost, steps in (("K", extra, STEPS.get(role[:1], ())), ("R", extra + REROLE, STEPS["u"] + STEPS["a"])):
                for state, to in steps:
                    if self.heads[state] is not None:
                        self._offer(heads, to, self.heads[state][0] + cost, self.heads[state][1], letter)
        self._insert(heads)
        # after an assistant nothing more can be needed than after the system, or, but for a kept system row, at the start
        if heads[ASSISTANT] is not None:
            for state, more in ((START, DELETE), (SYSTEM, 0)):
                if heads[state] is not None and heads[ASSISTANT][0] + more < heads[state][0]:
                    heads[state] = None
        self.heads = heads
        self.since += 1
        if self.since >= self.settle_every:
            self.since = 0
            yield from self._settle()

    def end(self) -> Iterator[tuple[str, str | None, str | None]]:
        """The rest, along the cheapest audit; `cost` is known then."""
        best = self.heads[START]
        other = self.heads[ASSISTANT]
        if best is None or (other is not None and (other[0] < best[0] or other[0] == best[0] and self.audits.less(other[1], best[1]))):
            best = other
        self.cost = self.base + best[0]
        yield from self._given(self.audits.letters(best[1], self.audits.root))

    def _given(self, letters: str) -> Iterator[tuple[str, str | None, str | None]]:
        for letter in letters:
            role, text = self.waiting.popleft() if letter != "I" else ("", "")
            if letter == "D":
                yield letter, None, None
                continue
            if letter == "K":
                after = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
            else:
                after = ASSISTANT if self.state == USER else USER
                role = "assistant" if after == ASSISTANT else "user"
            self.state = after
            yield letter, role, text

    def _settle(self) -> Iterator[tuple[str, str | None, str | None]]:
        """Give out what all heads share and start the tree anew from there."""
        live = [h[1] for h in self.heads if h is not None]
        shared = live[0]
        for node in live[1:]:
            depth = min(shared.depth, node.depth)
            a, b = Audits.ancestor(shared, depth), Audits.ancestor(node, depth)
            for k in reversed(range(len(a.up))):
                if k < len(a.up) and a.up[k] is not b.up[k]:
                    a, b = a.up[k], b.up[k]
            shared = a if a is b else a.up[0]
        if not shared.depth:
            return
        letters = Audits.letters(shared, self.audits.root)
        low = min(h[0] for h in self.heads if h is not None)
        self.audits.root = Node("", 0, 0, [])
        moved = {id(shared): self.audits.root}

        def rebuilt(node: Node) -> Node:
            chain = []
            while id(node) not in moved:
                chain.append(node)
                node = node.up[0]
            made = moved[id(node)]
            for old in reversed(chain):
                made = moved[id(old)] = self.audits.after(made, old.letter)
            return made

        self.heads = [None if h is None else (h[0] - low, rebuilt(h[1])) for h in self.heads]
        self.base += low
        yield from self._given(letters)


# --- conversations on Spark -------------------------------------------------------------------------------------------

def prepared(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text, absent) -> conv_id, turn, role, text, fault, absent; partitioned and sorted for a walk.

    `fault` is b(lank), d(uplicate), t(runcated) or empty; `absent` rows are no rows, they only name their conversation.
    """
    rows = conversations.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    rows = rows.repartition(S.partitions(rows.sparkSession), "conv_id")
    copy = F.row_number().over(Window.partitionBy("conv_id", "absent", "role", "digest").orderBy(F.asc_nulls_first("turn"))) > 1
    last = F.right(F.rtrim("text", F.lit(ASCII_SPACE)), F.lit(1))
    fault = F.when(last == "", "b").when(copy, "d").when(~last.isin(".", "!", "?"), "t").otherwise("")
    # copies of one turn lie beside each other, the first of them ahead
    return rows.withColumn("fault", fault).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest", F.col("fault") == "d").select(
        "conv_id", "turn", "role", "text", "fault", "absent")


def _cleaned(conversations: DataFrame) -> DataFrame:
    rows = S.pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), space("role").alias("role"), space("text").alias("text"), F.lit(False).alias("absent"))


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) with seeded faults: what crc32 of `conv_id:turn` (null: a space) says, modulo 20.

    0 drops the row (marked `absent`, so that its conversation is not forgotten), 1 empties its text, 2 removes `.`, `!` and `?`, 3 repeats it, 4
    makes it a user's. Null roles and texts are one space.
    """
    rows = _cleaned(conversations)
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    made = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (kind == 0).alias("absent"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return made.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list | None]]:
    """(conv_id, row) for each row, row None where the conversation has an absent one; rows of a conversation follow each other."""
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for conv_id, *row, absent in zip(*columns, strict=True):
            yield conv_id, None if absent else row


class _Report:
    """Counts faults of one conversation and hashes what is left of it."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.repair, self.sha, self.audit = conv_id, Repair(), hashlib.sha256(), []
        self.faults = {"b": 0, "d": 0, "t": 0, "": 0}
        self.illegal, self.before, self.low, self.high, self.turns, self.turned = 0, None, None, None, 0, False

    def take(self, turn: int | None, role: str, text: str, fault: str) -> None:
        self.faults[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        self.write(self.repair.row(role, text, fault in ("b", "d"), fault == "t"))

    def write(self, edits: Iterator[tuple[str, str | None, str | None]]) -> None:
        for letter, role, text in edits:
            self.audit.append(letter)
            if role is not None:
                self.sha.update(f"{chr(10) if self.turned else ''}{role}:{text}".encode())
                self.turned = True

    def done(self) -> tuple:
        self.write(self.repair.end())
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.faults["b"], self.faults["d"], self.faults["t"], self.illegal, self.repair.cost, "".join(self.audit), self.sha.hexdigest())


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, edit string, role string, text string"
_REPORT = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in REPORT.split(", "))])
_TURNS = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in TURNS.split(", "))])


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000, most_chars: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    kept, chars = [], 0
    for row in rows:
        kept.append(row)
        chars += len(row[-2] or "") + len(row[-1] or "")
        if len(kept) == most or chars > most_chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)
            kept, chars = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        report = None
        for conv_id, row in _walk(batches):
            if report is None or report.conv_id != conv_id:
                if report is not None:
                    yield report.done()
                report = _Report(conv_id)
            if row is not None:
                report.take(*row)
        if report is not None:
            yield report.done()

    yield from _batches(rows(), _REPORT)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        current, repair, place = object(), None, 0
        for conv_id, row in _walk(batches):
            if repair is None or current != conv_id:
                if repair is not None:
                    for edit in repair.end():
                        yield current, place, *edit
                        place += 1
                current, repair, place = conv_id, Repair(), 0
            if row is not None:
                turn, role, text, fault = row
                for edit in repair.row(role, text, fault in ("b", "d"), fault == "t"):
                    yield current, place, *edit
                    place += 1
        if repair is not None:
            for edit in repair.end():
                yield current, place, *edit
                place += 1

    yield from _batches(rows(), _TURNS)


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, place, edit, role, text: every edit in order, with the turn that it leaves.

    Rows follow each other by turn (null first), then role and text. Deleted rows have a null role and text. Edits K(eep) cost 0, R(erole) 3,
    D(elete) 4, I(nsert) 3, a truncated row that stays 3 more; blank rows and repeats of a role and text must go. The cheapest edits after which
    the roles' initials are (s?(ua)+)? are taken, of equal ones the least audit. A role whose initial is not s, u or a, or that is empty, cannot be
    kept. Null roles and texts are one space; a null conv_id is a conversation like any other. An empty table gives no rows; other
    columns are ignored.
    """
    return S.map_arrow(prepared(_cleaned(conversations)), _repaired, TURNS)


def reports(rows: DataFrame) -> DataFrame:
    """Rows as `damaged` makes them -> gaps, faults, cost, audit and digest of the repaired turns, one row per conversation.

    Rules as in `repaired_turns`. A conversation all of whose rows are absent has zeros, an empty audit and the hash of the empty string.
    """
    return S.map_arrow(prepared(rows), _reports, REPORT)


def damage_report(conversations: DataFrame) -> DataFrame:
    return reports(damaged(conversations))
