import random
import re

import pytest

from sparkcurves.llm import forest_dedup as D

SCHEMA = "doc_id long, text string"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(rows, width, percent=80):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        smallest = min(ids) if ids else None
        out.append((doc, len(sets[i]), smallest, doc == smallest))
    return sorted(out, key=repr)


def made(seed=5):
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(25):  # families of copies that drift apart
        text = [word() for _ in range(random.randrange(8, 60))]
        for _ in range(random.randrange(1, 6)):
            text = list(text)
            for _ in range(random.randrange(3)):
                text[random.randrange(len(text))] = word()
            rows.append(" ".join(text))
    base = [word() for _ in range(120)]
    for _ in range(120):  # one large group near one text
        text = list(base)
        for _ in range(random.randrange(6)):
            text[random.randrange(len(text))] = word()
        rows.append(" ".join(text))
    passage = " ".join(word() for _ in range(30))
    rows += [passage + " " + " ".join(word() for _ in range(40)) for _ in range(40)]  # a shared passage is no near copy
    rows += [rows[0]] * 30 + [rows[0].upper(), None, "", " \t\n", "one", "ONE", "one two", "two one", "w " * 30_000]
    random.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("width", [2, 5])
def test_components_of_all_links(spark, width):
    rows = [*made(), (None, "alone without id"), (None, "one two"), (1, "repeated row"), (1, "repeated row")]
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA + ", class int, d0 string")
    got = D.near_duplicates(frame, width=width).drop("text_key").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, width)


def test_full_regions_split_by_depth(spark):
    rows = made(7)
    got = D.near_duplicates(spark.createDataFrame(rows, SCHEMA), width=2, pairs_per_class=3).drop("text_key").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 2)


def templated(seed=3, texts=1000, pairs=60):
    """Texts from one template, mutual similarity about 0.7 in shingles of two words, with pairs above 0.8 among them."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))

    def changed(text, n):
        text = list(text)
        for at in rng.sample(range(len(text)), n):
            text[at] = word()
        return text

    template = [word() for _ in range(200)]
    rows = [changed(template, rng.randrange(8, 12)) for _ in range(texts)]
    rows += [changed(rows[i], 10) for i in range(pairs)]
    rng.shuffle(rows)
    return [(i + 1, " ".join(t)) for i, t in enumerate(rows)]


def test_pairs_among_texts_of_one_template(spark):
    rows = templated()
    want = brute(rows, 2)
    assert 900 < sum(r[3] for r in want) < len(rows) - 30  # most texts are alone
    got = D.near_duplicates(spark.createDataFrame(rows, SCHEMA), width=2).drop("text_key").collect()
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_offers_decide_nothing(spark, monkeypatch):
    monkeypatch.setattr(D, "OFFERS", 0)
    rows = templated(4, texts=150, pairs=30)
    got = D.near_duplicates(spark.createDataFrame(rows, SCHEMA), width=2, pairs_per_class=0).drop("text_key").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 2)


def test_frequent_shingles_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(D, "PER_TASK", 5)
    rows = made(11)
    got = D.near_duplicates(spark.createDataFrame(rows, SCHEMA), width=2, pairs_per_class=0).drop("text_key").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 2)


def test_one_row_of_each_component_stays(spark):
    rows = [*made(9)[:60], (1, "same id other text"), (1, "same id other text")]
    left = D.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    kept = {(d, n, c) for d, n, c, k in brute(rows, 5) if k}
    assert sorted(r["doc_id"] for r in left) == sorted({d for d, _, _ in kept} | {d for d, n, _ in kept if not n})


def test_empty_table(spark):
    assert D.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_steps_do_not_grow_with_the_shuffle_partitions(spark):
    rows = [r for r in templated(6, texts=90, pairs=20) if r[0] % 2]
    want, steps = brute(rows, 2), {}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for partitions in (8, 40):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.sparkContext.setJobGroup(f"steps-{partitions}", "near duplicates")
            got = D.near_duplicates(spark.createDataFrame(rows, SCHEMA), width=2, pairs_per_class=0).drop("text_key").collect()
            assert sorted((tuple(r) for r in got), key=repr) == want
            steps[partitions] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"steps-{partitions}"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)
    assert 0 < steps[40] <= steps[8] + 12, steps  # a step for each partition would add 32 and more
