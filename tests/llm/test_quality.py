import random

import numpy as np
import pyarrow as pa

from sparkcurves.llm import quality as Q

SCHEMA = "doc_id long, text string"


def corpus(seed=2):
    random.seed(seed)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 > 0
        words = [random.choice(["the", "river", "runs", "past", "old", "stone", "houses"]) for _ in range(random.randrange(5, 60))]
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)))
        if i % 2:
            labels.append((i, int(good)))
    return rows, labels


def test_ngrams_do_not_cross_texts():
    texts = ["Ab ab!! 12", "", "x x x", "é1", None and "", "Ab"]
    texts = [t for t in texts if t is not None]
    grams, at = Q.ngram_buckets(pa.array(texts), 1 << 30)
    # runs of letters, marks and digits, and the pairs of neighbours among them
    assert np.diff(at).tolist() == [4 + 3, 0, 3 + 2, 2 + 1, 1]
    alone, _ = Q.ngram_buckets(pa.array(["x x x"]), 1 << 30)
    assert sorted(alone) == sorted(grams[at[2] : at[3]]) and alone[3] == alone[4]
    assert grams[at[0]] == grams[at[4]] and grams[at[0]] != grams[at[0] + 1]


def test_weights_against_plain_counts():
    weights = Q.Weights(np.linspace(-1, 1, 64))
    texts = ["a b c a", "", "z!! z!!"]
    grams, at = Q.ngram_buckets(pa.array(texts), 64)
    want = [sum(weights.ratio[g] for g in grams[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert np.allclose(weights.of(pa.array(texts)), want)


def test_junk_goes_and_good_texts_stay(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, "c") for r in rows + [(None, "the river"), (900, None), (901, ""), (3, rows[3][1])]], SCHEMA + ", text_key string")
    labels = spark.createDataFrame(labels + [(None, 1), (5, None), (7, 1)], "doc_id long, quality int")
    got = Q.resample(docs, labels, smoothing=1.0).collect()
    assert len(got) == len(rows) + 4
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 900:
            assert r["kept"] == (r["doc_id"] % 4 > 0)
        else:
            assert r["kept"]
    again = {(r["doc_id"], r["gumbel_key"]) for r in Q.resample(docs, labels, smoothing=1.0).collect()}
    assert again == {(r["doc_id"], r["gumbel_key"]) for r in got}
    assert Q.keep_good(docs, labels, smoothing=1.0).count() == sum(r["kept"] for r in got)


def test_top_k_is_drawn_in_proportion_to_weights(spark):
    rows, labels = corpus()
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    for k in (0, 1, 37, 400):
        got = Q.resample(docs, labels, k=k).collect()
        keys = sorted((r["gumbel_key"] for r in got), reverse=True)
        assert sorted((r["gumbel_key"] for r in got if r["kept"]), reverse=True) == keys[:k]
    noise = np.array([r["gumbel_key"] - r["log_weight"] for r in got])
    assert abs(noise.mean() - 0.5772) < 0.3 and abs(noise.std() - 1.2825) < 0.25


def test_kth_largest_with_ties(spark):
    values = [1.0] * 50 + [2.0] * 50 + [float(i) / 7 for i in range(100)]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 30, 60, 120, 200):
        assert Q.kth_largest(frame, "x", k, bins=5) == sorted(values, reverse=True)[k - 1]


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int")
    assert Q.resample(docs, labels).count() == 0
    some = spark.createDataFrame([(1, "a b"), (2, "c!!")], SCHEMA)
    assert [r["kept"] for r in Q.resample(some, labels).collect()] == [True, True]
