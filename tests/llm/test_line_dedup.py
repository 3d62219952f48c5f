import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkcurves.llm import line_dedup as L

SCHEMA = "doc_id long, text string"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def table():
    rng = random.Random(3)
    shared = [f"Shared line {i}" for i in range(6)] + [" ", "É", " COOKIES \t", "cookies", "", "   "]
    rows = [(i, "\n".join(rng.choice(shared) if rng.random() < 0.4 else f"own {i} {j}" for j in range(rng.randrange(1, 12)))) for i in range(60)]
    rows += [(None, None), (None, "cookies"), (7, "cookies"), (7, "cookies"), (8, ""), (9, "\n\n"), (10, "cookies\n" * 500), (11, "x" * 300_000)]
    return rows + [(12, "\n".join(f"line {i % 3}" for i in range(5000)))]


def frequent(rows, least_documents, least_chars):
    counts = Counter(k for _, text in rows for k in {key(x) for x in (text or "").split("\n")})
    return {k for k, n in counts.items() if n >= least_documents and len(k) >= least_chars}


@pytest.mark.parametrize("least_documents, least_chars", [(10, 1), (2, 1), (3, 8), (1, 1)])
def test_frequent_lines_go_everywhere(spark, least_documents, least_chars):
    rows = table()
    bad = frequent(rows, least_documents, least_chars)
    want = []
    for doc_id, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if key(x) not in bad]
        want.append((doc_id, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("clash") for c in ("row", "pos", "h0", "slice", "n", "bitmap")})
    got = L.line_digest(docs, least_documents, least_chars)
    assert sorted(map(repr, (tuple(r)[:4] for r in got.collect()))) == sorted(map(repr, want))


def test_first_occurrences_stay(spark):
    rows, seen, want = table(), set(), []
    for doc_id, text in rows:
        kept = []
        for line in (text or "").split("\n"):
            if not key(line) or key(line) not in seen:
                kept.append(line)
            seen.add(key(line))
        want.append((doc_id, "\n".join(kept)))
    got = L.kept_texts(spark.createDataFrame(rows, SCHEMA).coalesce(1), None).select("doc_id", "kept").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_bitmaps_are_runs_of_kept_and_dropped_lines(spark):
    docs = spark.createDataFrame([(1, "a\nb\nb\nc"), (2, "b\nb"), (3, "c"), (4, None)], SCHEMA).coalesce(1)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["bitmap"]) for r in L.keep_bitmaps(docs, 2).collect()}
    assert got == {1: (4, 3, [1, 3, 0]), 2: (2, 2, [0, 2, 0]), 3: (1, 1, [0, 1, 0]), 4: (1, 0, [1])}
    assert "text" not in L.keep_bitmaps(docs, 2).columns


def test_empty_table(spark):
    assert L.line_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert L.kept_texts(spark.createDataFrame([], SCHEMA), None).count() == 0


def test_one_range_exchange_and_no_python(spark):
    rows = spark.createDataFrame(table(), SCHEMA).select(F.monotonically_increasing_id().alias("row"), "text")
    marked = L._marked(L._occurrences(rows, 1)).groupBy("h0", "h1", "slice").agg(F.count(F.when(F.col("opens"), 1)))
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan and "Python" not in plan and "Arrow" not in plan


def test_a_line_of_most_documents_is_marked_in_many_tasks(spark):
    rows = spark.range(4000).select(F.col("id").alias("row"), F.concat(F.lit("hot\nown "), F.col("id").cast("string")).alias("text"))
    hot = L._marked(L._occurrences(rows, 1)).withColumn("task", F.spark_partition_id()).groupBy("h0", "h1").agg(
        F.count("*").alias("n"), F.countDistinct("task").alias("tasks")).where("n = 4000").first()
    assert hot["tasks"] >= 3
