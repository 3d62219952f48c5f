"""Every stage of the pipeline on its own input, against plain Python."""

import random
from collections import Counter

import corpus_pipeline as C
from sparkcurves.llm import mixing, queries
from sparkcurves.llm import tokens as K
from tests.llm.test_forest_dedup import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made():
    random.seed(11)
    words = ["".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    texts = [" ".join(random.choice(words) for _ in range(random.randrange(6, 60))) for _ in range(150)]
    texts += texts[:20] + [t + " tail" for t in texts[20:40]] + [" ".join(w + "$$$" for w in t.split()) for t in texts[40:70]] + [None, ""]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return rows, [(i, int("$$$" not in (t or ""))) for i, t, *_ in rows if i % 2]


def test_stages_and_run(spark, tmp_path):
    rows, labels = made()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [docs]
    for i, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, kept[-1], str(tmp_path))
        out.write.parquet(f"{tmp_path}/{i}")
        kept.append(spark.read.parquet(f"{tmp_path}/{i}"))
        assert i == len(C.STAGES) - 1 or kept[-1].columns == docs.columns
    data = [sorted(((r["doc_id"], r["text"], r["source"]) for r in k.collect()), key=repr) for k in kept[:-1]]
    good = [r for r in data[0] if "$$$" not in (r[1] or "")]
    assert set(good) <= set(data[1]) <= set(data[0])  # clean documents stay; a tiny target may let junk through

    largest = {}
    for i, text, _ in data[1]:
        largest[text or ""] = max(i, largest.get(text or "", -1))
    assert sorted(r[0] for r in data[2]) == sorted(largest.values())

    components = {d: c for d, _, c, _ in brute([r[:2] for r in data[2]], 5)}
    assert sorted(r[0] for r in data[3]) == sorted(d for d, c in components.items() if d == c)

    sizes = Counter()
    for _, text, source in data[3]:
        sizes[source] += len((text or "").split())
    names = sorted(sizes)
    goals = mixing.targets([sizes[s] for s in names], (5, 2, 1), sum(sizes.values()))
    taken = Counter()
    for _, text, source in data[4]:
        taken[source] += len((text or "").split())
    assert set(data[4]) <= set(data[3]) and max(Counter(data[4]).values()) <= 3
    assert all(abs(taken[s] - g) <= 60 for s, g in zip(names, goals, strict=True))

    encoder = K.Encoder(K.vocabulary_path()).tokenizer
    want = Counter()
    for i, text, _ in data[4]:
        want[i] += len(encoder.encode(text or "", add_special_tokens=False).ids) + 1
    got, full = Counter(), Counter()
    for r in kept[-1].collect():
        got[r["doc_id"]] += r["length"]
        full[r["sequence_id"]] += r["length"]
    assert got == want and max(full.values()) <= 1024
    whole = C.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in whole) == Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in kept[-1].collect())


ODD = [(None, None, None, None, None), (None, None, "en", None, None), (1, "", "en", "a", 0), (2, "a b c", "en", "a", 5), (2, "a b c", "en", "a", 5)]


def test_small_odd_tables(spark, tmp_path):
    for name, rows in (("odd", ODD), ("two-words", [(i, "a b", "en", None, 3) for i in range(3)]), ("empty", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
        out = C.run(spark, folder).collect()
        assert {r["doc_id"] for r in out} <= {r[0] for r in rows}
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        near = C.no_near_copies(spark, docs, folder).collect()
        assert len(near) == {"odd": 4, "two-words": 1, "empty": 0}[name]
        exact = C.no_exact_copies(spark, docs, folder).collect()
        assert len(exact) == {"odd": 2, "two-words": 1, "empty": 0}[name]


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.REGISTRY) == list(range(1, 14))
