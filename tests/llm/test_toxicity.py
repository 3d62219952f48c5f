import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparkcurves.llm import toxicity as X

WORDS = ["the", "river", "runs", "past", "stone", "houses", "and", "winter", "light", "over", "fields", "idiot", "moron", "worthless"]


def plain_model():
    counts = np.zeros((X.SYMBOLS,) * 3, np.int64)
    for word in WORDS * 40:
        codes = [0, 0, *[ord(c) - 96 for c in word], 0]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            counts[a, b, c] += 1
    return X.CharacterModel.from_counts(counts.ravel())


def spaced_model():
    counts = np.zeros((X.SYMBOLS,) * 3, np.int64)
    for word in [*WORDS, "such", "a", "you", "die", "wretch"] * 40:
        codes = [0, 0, *[ord(c) - 96 for c in word], 0]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            counts[a, b, c] += 1
    return X.CharacterModel.from_counts(counts.ravel())


@pytest.mark.parametrize("hidden, word", [
    ("1d10t", "idiot"), ("i d i o t", "idiot"), ("m0r0n", "moron"), ("idiooooot", "idiot"), ("w.o.r.t.h.l.e.s.s", "worthless"), ("m-o-r-o-n", "moron"), ("!diot", "idiot")])
def test_readings(hidden, word):
    assert X.restore(f"the {hidden} runs", plain_model()) == f"the {word} runs"


@pytest.mark.parametrize("hidden, plain", [
    ("such a m o r o n", "such a moron"), ("y o u i d i o t", "you idiot"), ("d i e", "die"), ("you m ó r o n", "you moron"), ("m'o'r'o'n", "moron"),
    ("m,o,r,o,n", "moron"), ("wr€tch", "wretch"), ("¡diot", "idiot"), ("¡moron", "moron"), ("id¡ot", "idiot"), ("m/o/r/o/n", "moron"), ("you 1 d 1 0 t", "you idiot")])
def test_readings_of_several_words_and_all_marks(hidden, plain):
    assert X.restore(f"the {hidden} runs", spaced_model()) == f"the {plain} runs"


def test_search_finds_the_cheapest_reading():
    model = plain_model()

    def price(text):
        codes = [0, 0, *[ord(c) - 96 for c in text], 0]
        return sum(model.cost[a, b, c] for a, b, c in zip(codes, codes[1:], codes[2:]))

    # each digit read as one of its letters or dropped: all readings, by hand
    best = min(((price(f"m{a}r{b}n") + X.READ * (len(a) + len(b)) + X.DROP_MARK * (2 - len(a) - len(b)), f"m{a}r{b}n") for a in ("o", "") for b in ("i", "l", "")))
    assert X.decode("m0r1n", model) == best[1]


def readings(span, model):
    """(price, reading) of every path through a span's lattice."""
    todo = [(0.0, 0, 0, "")]
    run, previous = 0, ""
    for ch in span:
        if ch not in X.SEPARATORS:
            run, previous = (run + 1 if ch == previous else 1), ch
        out = []
        for price, a, b, text in todo:
            letters = [(ch, 0.0)] if ch.isalpha() else [(x, X.READ) for x in X.STANDS_FOR.get(ch, "")]
            for x, extra in letters:
                out.append((price + extra + model.cost[a, b, ord(x) - 96], b, ord(x) - 96, text + x))
                if text and text[-1] == x:
                    out.append((price + (X.DROP_REPEAT if run > 2 else X.DROP_DOUBLE), a, b, text))
            if ch in X.SEPARATORS:
                out.append((price + X.DROP_SEPARATOR, a, b, text))
                if b:
                    out.append((price + model.cost[a, b, 0], 0, 0, text + " "))
            elif not letters:
                out.append((price + X.KEEP_OTHER + model.cost[a, b, 27], b, 27, text + ch))
            if not ch.isalpha() and ch not in X.SEPARATORS:
                out.append((price + X.DROP_MARK, a, b, text))
        todo = out
    return {(round(price + (model.cost[a, b, 0] if b or not text else 0.0), 9), text.rstrip()) for price, a, b, text in todo}


def test_no_reading_is_cheaper():
    rng, model = random.Random(2), spaced_model()
    for _ in range(120):
        span = "".join(rng.choice("iidot10 .mraan4#") for _ in range(rng.randrange(1, 8)))
        every = readings(span, model)
        least = min(price for price, _ in every)
        assert X.decode(span, model) in {text for price, text in every if price <= least + 1e-8}, span


def test_long_runs_of_single_characters_take_time_in_proportion():
    model, took = spaced_model(), []
    for n in (10_000, 40_000):
        start = time.process_time()
        assert X.decode("1 0 " * n, model)
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0] + 1


def test_every_distinct_word_counts():
    weights = np.zeros(1 << 12)
    texts = [" ".join(f"zq{i}xvw" for i in range(n)) for n in (1, 2, 8)] + ["zq0xvw " * 9]
    scorer = X.Scorer(plain_model(), weights, np.ones(X.INPUTS), 0.0)
    for features in X.text_features(pa.array(texts), scorer.model, {}, len(weights)):
        weights[features[:, 0]] = 1.0
    heaviest, rest, rate = scorer.evidence(pa.array(texts), {}).T
    assert heaviest.tolist() == [1, 1, 1, 1] and rest.tolist() == [0, 1, 7, 0] and np.allclose(rate, [0, 1 / 2**0.5, 7 / 8**0.5, 0])


def test_plain_words_numbers_and_addresses_stay():
    text = "The 1990s cost $40, see mail7@example.com or password=a1b2c3 at 10:30; Ärger, été!"
    assert X.restore(text, plain_model()) == text


def corpus(seed=4, n=600):
    random.seed(seed)
    rows, labels = [], []
    for i in range(n):
        words = [random.choice(WORDS[:11]) for _ in range(random.randrange(5, 50))]
        bad = i % 5 == 2 or i % 7 == 3
        if bad:
            for _ in range(2):
                words.insert(random.randrange(len(words)), random.choice(["idiot", "moron"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_labels_are_learnt_without_being_seen(spark):
    rows, labels = corpus()
    hidden = [(1000, "the r1ver m0r0n runs"), (1001, "light and i d i o t over"), (1002, None), (1003, ""), (None, "the river"), (1004, "river " * 20_000 + "idiooot")]
    docs = spark.createDataFrame([(*r, "en", 3.0) for r in rows + hidden], "doc_id long, text string, held_out string, score double")
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]  # held-out labels must not matter
    got = X.score(docs, spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")).collect()
    again = X.score(docs, spark.createDataFrame(flipped, "doc_id long, toxic int")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    truth = dict(labels)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0)
        if r["doc_id"] in truth:
            assert r["predicted"] == truth[r["doc_id"]]
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert (by[1000], by[1001], by[1002], by[1003], by[None], by[1004]) == (1, 1, 0, 0, 0, 1)


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "the river"), (1, "the river")], "doc_id long, text string")
    assert {r["predicted"] for r in X.score(docs, none).collect()} == {0}
    assert X.score(docs.limit(0), none).count() == 0
