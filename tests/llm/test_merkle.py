import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sparkcurves.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)]
    return sha("".join(parts))


def tree(hashes):
    """Root and, for each leaf, the (left, right) siblings of every level."""
    paths, places, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for k, place in enumerate(places):
            start = place // 8 * 8
            paths[k].append(("".join(level[start:place]), "".join(level[place + 1 : start + 8])))
            places[k] = place // 8
        level = ["".join(level[i : i + 8]) for i in range(0, len(level), 8)]
        level = [sha(x) for x in level]
    return level[0], paths


def expected(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    subroots, found = [], []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        subroot, paths = tree([leaf(r, r[4]) for r in own])
        subroots.append(subroot)
        found.append(list(zip(own, paths, strict=True)))
    root, tops = tree(subroots)
    out = []
    for subroot, own, top in zip(subroots, found, tops, strict=True):
        for row, path in own:
            text = row[4]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            fold = leaf(row, text)
            for left, right in path + top:
                fold = sha(left + fold + right)
            proof = sha("".join(a + b for a, b in path + top))
            out.append((row[0], leaf(row, row[4]), subroot, root, proof, fold, fold == root))
    return sorted(out, key=repr)


def check(spark, rows):
    got = M.tamper_audit(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(rows)
    return got


@pytest.mark.parametrize("n", [1, 9])
def test_one_lang(spark, n):
    check(spark, [(i * 7, "s", "en", i, f"Text {i}") for i in range(n)])


def test_trees_of_every_shape(spark):
    check(spark, [(i * 7, "s", f"l{n}", i, f"Text {i}") for n in (1, 2, 8, 9, 64, 65, 512, 513, 4100) for i in range(n)])


def test_many_langs_of_many_sizes(spark):
    rows = [(100 * k + i, f"s{i}", f"l{k}", None, f"É Text {i}") for k in range(70) for i in range(k % 11 + 1)]
    got = check(spark, rows)
    assert {r["verified"] for r in got} == {True, False}


def test_nulls_repeats_and_long_texts(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", None, 0, ""), (1, "", None, 0, ""), (1, None, "", 0, None),
            (2, "s", "é", 5, "A" * 300_000), (2, "s", "é", 5, "a" * 300_000), (9, "s", "Z", 5, "x|y:1")]
    check(spark, rows)


def test_rows_repeated_in_full_fill_a_tree(spark):
    check(spark, [(3, "s", "en", 1, "Same")] * 700 + [(i, "s", "en", 1, "Other") for i in range(20)])


def test_empty_table_and_further_columns(spark):
    assert M.tamper_audit(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(i, "s", "en", 1, "T") for i in range(10)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("key", "hash", "rank", "levels", "path", "kids", "item", "place")})
    assert sorted((tuple(r) for r in M.tamper_audit(docs).collect()), key=repr) == expected(rows)


def test_paths_lead_to_the_root_and_only_from_their_leaf(spark):
    docs = spark.createDataFrame([(i, "s", "en" if i % 3 else "de", 1, f"T{i}") for i in range(100)], SCHEMA)
    rows = M.manifest(docs)
    assert rows.where(M.folded(F.col("leaf"), F.col("path")) != F.col("root")).isEmpty()
    assert rows.where(M.folded(F.sha2(F.lit("x"), 256), F.col("path")) == F.col("root")).isEmpty()


def test_proofs_are_emitted_without_a_join(spark):
    blocks = M._rolled(spark.createDataFrame([("en", 0, 1, "a", 1)], "key string, rank long, levels int, hash string, item int"))
    paths = blocks.select("key", "rank", F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    plan = M._descended([blocks], paths, [])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert blocks._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # three groupings, one exchange
