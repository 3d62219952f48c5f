"""Line dedup that returns bitmaps, with DataFrame functions only.

Each line becomes two 64-bit hashes of its key. They are partitioned by range of hash, sorted by document and position within a hash, and one pass
over the sorted rows marks the first occurrences: the first line of a document with that hash, and the first of all. What comes back is a
compressed bitmap for each document: lengths of runs, kept and dropped lines in turn. Texts stay where they are until `kept_texts` cuts them.

At scale: a line travels as 28 bytes and its document's slice. A hash is dealt over as many slices as there are partitions, so a line that a third
of all documents share is marked in all of them; each slice counts its documents before the counts are added up. Only lines whose hash is
dropped go on, to a join with the stored hashes to drop, which Spark may split or broadcast by their true size, and to their documents.
Two different keys count as one when both hashes agree: among 10**12 different lines that happens with probability 2e-15.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkcurves.llm import shared as S

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ("h0", "h1")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(SPACE)), UPPER, LOWER)


def _occurrences(rows: DataFrame, least_chars: int) -> DataFrame:
    """rows(row, text) -> row, pos, h0, h1, slice: one row per line that is long enough."""
    n = S.partitions(rows.sparkSession)
    hashed = F.transform(F.transform(lines(F.col("text")), line_key), lambda key: F.when(
        F.length(key) >= least_chars, F.struct(F.xxhash64(key).alias("h0"), F.xxhash64(F.lit("second"), key).alias("h1"))))
    each = rows.select("row", F.posexplode(hashed).alias("pos", "hash")).where("hash is not null")
    return each.select("row", "pos", "hash.h0", "hash.h1", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias("slice"))


def _marked(occurrences: DataFrame) -> DataFrame:
    """Adds `opens` (first line of its document with that hash) and `leads` (first within its slice), in one pass over sorted rows."""
    n = S.partitions(occurrences.sparkSession)
    ranged = occurrences.repartitionByRange(n, *HASH, "slice")
    walk = Window.partitionBy(*HASH, "slice").orderBy("row", "pos")
    before = F.lag("row").over(walk)
    return ranged.withColumn("leads", before.isNull()).withColumn("opens", before.isNull() | (before != F.col("row")))


def _dropped_frequent(rows: DataFrame, least_documents: int, least_chars: int) -> DataFrame:
    """row, pos of all lines whose key stands in that many documents."""
    each = _occurrences(rows, least_chars)
    counts = _marked(each).groupBy(*HASH, "slice").agg(F.count(F.when(F.col("opens"), 1)).alias("n"))
    frequent = S.store(counts.groupBy(*HASH).agg(F.sum("n").alias("n")).where(F.col("n") >= least_documents).select(*HASH), "line-frequent")
    return each.join(frequent, list(HASH)).select("row", "pos")


def _dropped_repeats(rows: DataFrame, least_chars: int) -> DataFrame:
    """row, pos of all lines that are not the first with their key."""
    marked = S.store(_marked(_occurrences(rows, least_chars)).select("row", "pos", *HASH, "leads"), "line-marks")
    leaders = marked.where("leads")
    first = leaders.groupBy(*HASH).agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").select(*HASH, "first")
    late = leaders.join(first, list(HASH)).where("row > first")
    return marked.where("not leads").select("row", "pos").unionByName(late.select("row", "pos"))


def _numbered(documents: DataFrame) -> DataFrame:
    """row, doc_id, text, n_lines; rows ascend by their place in the table."""
    rows = S.pick(documents, doc_id="doc_id", text="text")
    return S.store(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", S.whole_text("text").alias("text"))
                   .withColumn("n_lines", F.size(lines(F.col("text"))).cast("long")), "line-documents")


def _bitmaps(rows: DataFrame, least_documents: int | None, least_chars: int) -> DataFrame:
    dropped = _dropped_repeats(rows, least_chars) if least_documents is None else _dropped_frequent(rows, least_documents, least_chars)
    place = F.row_number().over(Window.partitionBy("row").orderBy("pos"))
    runs = dropped.withColumn("run", F.col("pos") - place).groupBy("row", "run").agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("length"))
    runs = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("runs"), F.sum("length").alias("n_dropped"))
    end = lambda run: run["start"] + run["length"]
    gaps = F.flatten(F.transform("runs", lambda run, i: F.array(
        (run["start"] - F.coalesce(end(F.get(F.col("runs"), i - 1)), F.lit(0))).cast("int"), run["length"])))
    tail = (F.col("n_lines") - F.coalesce(end(F.element_at("runs", -1)), F.lit(0))).cast("int")
    # how many documents lose lines has no bound, so they are not broadcast
    return rows.join(runs.hint("merge"), "row", "left").withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0).cast("long"))).withColumn(
        "bitmap", F.concat(F.coalesce(gaps, F.array().cast("array<int>")), F.array(tail)))


def keep_bitmaps(documents: DataFrame, least_documents: int | None = 10, least_chars: int = 1) -> DataFrame:
    """documents(doc_id, text) -> row, doc_id, n_lines, n_dropped, bitmap: one row per row, without texts.

    `bitmap` is array<int>: how many lines are kept, then dropped, then kept, and so on; it starts and ends with a count of kept lines, which may
    be 0, and sums to n_lines. Lines are split at \\n; a key is the line without ASCII white space at its ends and with A-Z lower-cased.
    With `least_documents`, lines whose key stands in that many rows lose all their occurrences. With None the first occurrence by
    place in the table and in its text stays, all others go. Keys of fewer than `least_chars` code points always stay. `row` is a
    row's number. Null texts are one empty line, as empty ones are. Rows with equal or null doc_id are documents of their own. An empty
    table gives no rows. Further columns are ignored.
    """
    return _bitmaps(_numbered(documents), least_documents, least_chars).drop("text")


def kept(text: Column, bitmap: Column) -> Column:
    """The lines of a text that its bitmap keeps, joined by \\n."""
    flags = F.flatten(F.transform(bitmap, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    zipped = F.arrays_zip(lines(text).alias("line"), flags.alias("keep"))
    return F.array_join(F.transform(F.filter(zipped, lambda z: z["keep"]), lambda z: z["line"]), "\n")


def kept_texts(documents: DataFrame, least_documents: int | None = 10, least_chars: int = 1) -> DataFrame:
    """As `keep_bitmaps`, with the cut text in `kept`; a text that loses all lines is empty."""
    rows = _bitmaps(_numbered(documents), least_documents, least_chars)
    return rows.withColumn("kept", F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(kept(F.col("text"), F.col("bitmap")))).drop("text")


def line_digest(documents: DataFrame, least_documents: int = 10, least_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256, bitmap, one row per row."""
    rows = kept_texts(documents, least_documents, least_chars)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"), "bitmap")
