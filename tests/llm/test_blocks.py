import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkcurves.llm import blocks as B

ROWS = [(1, "same"), (2, "same"), (2, "same"), (3, None), (4, ""), (None, "same"), (None, None), (5, "x" * 9000), (6, "x" * 9000), (7, "x" * 8999 + "y"),
        (8, "xxxx"), (9, "xxxxxxxx"), (10, "é" * 50), (11, "é" * 50), (12, "Same")]
SCHEMA = "doc_id long, text string"


def expected():
    groups = defaultdict(list)
    for i, text in ROWS:
        groups[text or ""].append(i)
    return {t: (max((i for i in g if i is not None), default=None), len(g)) for t, g in groups.items()}


@pytest.mark.parametrize("block_bytes", [3, 16, 4096])
def test_groups_of_equal_texts(spark, block_bytes):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumn("row", F.lit("clash")).withColumn("name", F.lit(1))
    got = B.exact_duplicates(docs, block_bytes).collect()
    assert len(got) == len(ROWS)
    want = expected()
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in want}
    kept = defaultdict(int)
    for r in got:
        text = sha[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"]) == want[text]
        kept[text] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert all(n == 1 for n in kept.values()) and len(kept) == len(want)


def test_documents_that_stay(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = sorted((r["text"] or "", r["doc_id"]) for r in B.drop_exact_duplicates(docs).collect())
    assert got == sorted((t, k) for t, (k, _) in expected().items())


def test_smallest_id_may_stay(spark):
    got = B.exact_duplicates(spark.createDataFrame([(1, "a"), (2, "a"), (None, "a")], SCHEMA), keep="smallest").collect()
    assert {r["keep_id"] for r in got} == {1} and sum(r["kept"] for r in got) == 1


def test_empty_table(spark):
    assert B.exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_key_that_cannot_tell_blocks_apart_is_refused(spark):
    docs = spark.createDataFrame([(i, str(i)) for i in range(40)], SCHEMA)
    with pytest.raises(RuntimeError):
        B.exact_duplicates(docs, key_bits=1)
