import hashlib

import pytest
from pyspark.sql import functions as F

from sparkcurves.llm import chat as C

SCHEMA = "tree long, node long, parent long, role string, text string, score double"


def paths(spark, rows, **options):
    out = C.branches(spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit(0)).withColumn("depth", F.lit(9)), **options).collect()
    return sorted((r["tree"], r["branch"], r["score"], r["leaf"], [(t["role"], t["text"]) for t in r["turns"]]) for r in out)


def test_branches_are_ranked_by_score(spark):
    rows = [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "bad", -5.0), (1, 3, 1, "assistant", "good", 2.0), (1, 4, 3, "user", "more", None),
            (1, 5, 4, "assistant", "end", 1.0), (2, 1, 99, "user", "orphan", 0.0)]
    got = paths(spark, rows)
    assert got == [
        (1, 1, 4.0, 5, [("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "end")]),
        (1, 2, -4.0, 2, [("user", "q"), ("assistant", "bad")]),
        (2, 1, 0.0, 2 - 1, [("user", "orphan")]),
    ]
    assert [g[:2] for g in paths(spark, rows, best=1)] == [(1, 1), (2, 1)]


def test_long_thread_and_many_leaves(spark):
    chain = [(1, i, i - 1 if i else None, "user", str(i), 1.0) for i in range(70)]
    star = [(2, 0, None, "user", "root", 0.0)] + [(2, i, 0, "assistant", str(i), float(i)) for i in range(1, 60)]
    got = paths(spark, chain + star)
    assert [t for _, t in got[0][4]] == [str(i) for i in range(70)]
    assert [(g[1], g[3]) for g in got[1:]] == [(i, 60 - i) for i in range(1, 60)]


def test_rings_are_refused_and_empty_tables_are_empty(spark):
    with pytest.raises(ValueError):
        C.branches(spark.createDataFrame([(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0)], SCHEMA))
    assert paths(spark, []) == []


ROWS = [
    (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"),
    (1, 2, "assistant", "<|end|>\\b\\\\l|x|>"), (1, 1, "user", None), (1, None, None, "first"), (1, 2, "assistant", ""), (1, 3, "a|b<|", "é\n😀 <|user|>"),
    (None, 1, "user", "no id"), (2, 1, "assistant", "twice"), (2, 1, "assistant", "twice"), (3, 0, "system", ""), (4, 0, "assistant", "y" * 100_000),
]


def test_round_trip_of_texts_with_control_strings(spark):
    rows = spark.createDataFrame([(*r, "z") for r in ROWS], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in C.conversation_digest(rows).collect()}
    by = {}
    for r in ROWS:
        by.setdefault(r[0], []).append(r)
    assert set(got) == set(by)
    for i, turns in by.items():
        turns = sorted(turns, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        spoken = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns)
        loss = "".join(t[3] or "" for t in turns if t[2] == "assistant")
        r = got[i]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(spoken.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_no_marker_inside_texts(spark):
    out = C.formatted(C.branches(C.threads(spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")))).collect()
    for r in out:
        assert r["formatted"].count("<|end|>") == len(r["turns"]) and r["formatted"].count("<") == 2 * len(r["turns"]) and "[INST]" not in r["formatted"]
