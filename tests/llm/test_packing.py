import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkcurves.llm import packing as P
from sparkcurves.llm import tokens as K

SCHEMA = "doc_id long, text string"


def test_knapsack_against_all_fills():
    prices = np.array([0, 0.1, 0.25, 0, 0.55, 0, 0, 0, 0])
    value, last = P.best_fill(prices, 8)
    best = [0.0] * 9
    for room in range(1, 9):
        best[room] = max([best[room - 1], *(best[room - n] + prices[n] for n in range(1, room + 1) if prices[n] > 0)])
    assert np.allclose(value, best)
    fill = P._pattern(0, 8, last)
    assert abs(sum(prices[n] * c for n, c in fill.items()) - best[8]) < 1e-12


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 31), max_size=120), st.integers(0, 60))
def test_every_item_has_a_place(lengths, hot):
    demand = np.bincount(lengths + [19] * hot, minlength=32)[:32]
    plan = P.solve(demand, 32, penalty=1 / 32)
    held = plan.cut.copy()
    for pattern, n in plan.patterns:
        assert n > 0 and sum(k * c for k, c in pattern.items()) <= 32
        for k, c in pattern.items():
            held[k] += n * c
    assert (held == demand).all() and (plan.cut >= 0).all()
    assert plan.bound <= plan.cost + 1e-6


def test_pairs_that_fit_are_not_cut():
    demand = np.zeros(64, int)
    demand[20] = demand[44] = 50
    demand[16] = 40
    plan = P.solve(demand, 64)
    assert plan.cut.sum() == 0 and sum(n for _, n in plan.patterns) == 60


def packed(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA + ", ids string, length int")
    return P.pack(docs, **options)


@pytest.mark.parametrize("capacity", [64, 1024])
def test_round_trip(spark, capacity):
    words = ["alpha", "beta", "gamma", "delta ", "\n"]
    rows = [(i, " ".join(words[(i * j) % 5] for j in range(i * 7 % 300))) for i in range(60)]
    rows += [(100 + i, "the same words again and again") for i in range(150)] + [(400, None), (401, ""), (None, "no id"), (7, rows[7][1]), (300, "long " * 20_000)]
    out = packed(spark, rows, capacity=capacity).collect()
    tokenizer = K.Encoder(K.vocabulary_path()).tokenizer
    tokenizer.encode_special_tokens = True
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in out:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        documents[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in out)
    assert len(sequences) * capacity - total <= 0.02 * total + capacity
    for i, text in rows:
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        got = sorted(documents[i])
        times = sum(1 for j, _ in rows if j == i)
        assert sum(len(ids) for _, ids, _ in got) == times * len(want) and {n for _, _, n in got} == {len(want)}
        if times == 1:
            assert [x for _, ids, _ in got for x in ids] == want


def test_checksum_and_empty_table(spark):
    out = P.pieces_digest(packed(spark, [(1, "some text")])).collect()
    ids = K.Encoder(K.vocabulary_path()).tokenizer.encode("some text", add_special_tokens=False).ids + [0]
    assert out[0]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert packed(spark, []).count() == 0
