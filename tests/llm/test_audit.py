import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from sparkcurves.llm import audit as A

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def all_audits(rows, inserted=0):
    """(cost, letters, roles) of every way to edit rows (initial, fault), with at most two inserts in a row."""
    if inserted < 2:
        for role in "ua":
            for cost, letters, roles in all_audits(rows, inserted + 1):
                yield cost + 3, "I" + letters, role + roles
    if not rows:
        yield 0, "", ""
        return
    (initial, fault), rest = rows[0], rows[1:]
    for cost, letters, roles in all_audits(rest):
        yield cost + 4, "D" + letters, roles
        if fault not in ("b", "d"):
            more = 3 if fault == "t" else 0
            if initial in ("s", "u", "a"):
                yield cost + more, "K" + letters, initial + roles
            yield cost + more + 3, "R" + letters, "u" + roles
            yield cost + more + 3, "R" + letters, "a" + roles


def least(rows):
    return min((c, letters) for c, letters, roles in all_audits(tuple(rows)) if re.fullmatch("(s?(ua)+)?", roles))


def plain(rows):
    """The same by a DP that carries whole strings, without any pruning; for long conversations."""
    empty = {0: (0, ""), 2: (3, "I"), 3: (6, "II")}
    best = empty
    for initial, fault in rows:
        offers = []
        for state, (cost, letters) in best.items():
            offers.append((state, cost + 4, letters + "D"))
            if fault not in ("b", "d"):
                more = 3 if fault == "t" else 0
                for role, price, letter in ((initial, 0, "K"), ("u", 3, "R"), ("a", 3, "R")):
                    to = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(role, {}).get(state)
                    if to is not None:
                        offers.append((to, cost + more + price, letters + letter))
        best = {}
        for state, cost, letters in offers:
            ways = {0: [(0, "")], 1: [(1, ""), (2, "I"), (3, "II")], 2: [(2, ""), (3, "I")], 3: [(3, ""), (2, "I")]}[state]
            for to, inserts in ways + ([(2, "I"), (3, "II")] if state == 0 else []):
                new = (cost + 3 * len(inserts), letters + inserts)
                best[to] = min(best.get(to, new), new)
    return min(best[s] for s in (0, 3) if s in best)


def walked(rows, **settings):
    repair = A.Repair(**settings)
    out = []
    for i, (initial, fault) in enumerate(rows):
        out.extend(repair.row(initial, str(i), fault in ("b", "d"), fault == "t"))
    out.extend(repair.end())
    return repair.cost, "".join(e for e, _, _ in out), out


def some_rows(seed, n):
    rng = random.Random(seed)
    return [(rng.choice(["s", "u", "a", "u", "a", "t", ""]), rng.choice(["", "", "", "t", "b", "d"])) for _ in range(n)]


@pytest.mark.parametrize("n", range(5))
def test_least_audit_against_all_audits(n):
    for seed in range(60 if n < 4 else 25):
        rows = some_rows(seed, n)
        assert walked(rows)[:2] == least(rows) == plain(rows)


@pytest.mark.parametrize("settings", [{}, {"modulus": 2}, {"modulus": 7, "settle_every": 1}, {"settle_every": 3}])
def test_collisions_and_settling_change_nothing(settings):
    for seed in range(40):
        rows = some_rows(seed, 60)
        cost, letters, out = walked(rows, **settings)
        assert (cost, letters) == plain(rows)
        roles = "".join(r[:1] for _, r, _ in out if r is not None)
        assert re.fullmatch("(s?(ua)+)?", roles)
        kept = [t for e, _, t in out if e in "KR"]
        assert kept == sorted(kept, key=int)  # texts stay with their rows


def test_a_long_conversation_is_given_out_as_it_goes():
    repair, most = A.Repair(settle_every=64), 0
    for i in range(20_000):
        for _ in repair.row("user" if i % 2 == 0 else "assistant", "x", False, i % 7 == 0):
            pass
        most = max(most, len(repair.waiting))
    assert most < 300


@cache
def strip_last(text):
    return text.rstrip(SPACE)[-1:]


def expected(rows):
    """Straight from the rules: conv_id -> all columns."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            own += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in own:
            last = strip_last(text)
            faults.append("b" if not last else "d" if (role, text) in seen else "t" if last not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        cost, letters = plain([(r[:1], f) for (_, r, _), f in zip(own, faults, strict=True)])
        said, state, left = [], 0, list(own)
        for letter in letters:
            _, role, text = left.pop(0) if letter != "I" else (None, "", "")
            if letter == "D":
                continue
            to = {"s": 1, "u": 2, "a": 3}[role[0]] if letter == "K" else 3 if state == 2 else 2
            said.append(f"{role if letter == 'K' else 'assistant' if to == 3 else 'user'}:{text}")
            state = to
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, letters,
                     hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def conversations():
    rng = random.Random(5)
    rows = []
    for conv in range(120):
        for turn in range(rng.randrange(1, 14)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""])
            text = rng.choice([f"Said {conv} {turn}.", "Again.", "cut off", "", " \x0b\n", None, "Ends!\t", "é?", "nbsp. "])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (500, None, None, None), (501, 2, "user", "x" * 200_000 + ".")]
    rows += [(502, 0, "user", "Same."), (502, 0, "user", "Same."), (502, 1, "user", "Same.")]
    return rows


def test_whole_reports_against_the_rules(spark):
    rows = conversations()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("fault", "digest", "absent", "times")})
    got = {r[0]: tuple(r)[1:] for r in A.damage_report(docs).collect()}
    assert got == expected(rows)


def test_a_conversation_that_loses_all_rows(spark):
    gone = next((c, t) for c in range(1000) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    row = A.damage_report(spark.createDataFrame([(*gone, "user", "Hi.")], SCHEMA)).first()
    assert tuple(row) == (gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table(spark):
    assert A.damage_report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert A.repaired_turns(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "A."), (1, 1, "user", "B."), (1, 2, "assistant", "C."), (2, 0, "assistant", " "), (2, 1, "system", "S.")]
    got = sorted(tuple(r) for r in A.repaired_turns(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [r[2] for r in got if r[0] == 1] == list("KIKK")
    assert [(r[3], r[4]) for r in got if r[0] == 1] == [("user", "A."), ("assistant", ""), ("user", "B."), ("assistant", "C.")]
    assert [r[2:] for r in got if r[0] == 2] == [("D", None, None), ("D", None, None)]
