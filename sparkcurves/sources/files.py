"""Readers and writers for quote files, stored curves and definition tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkcurves.cluster import landed, partition_count

QUOTE_SCHEMA = "tenor STRING, type_rate STRING, bid DOUBLE, ask DOUBLE, mid DOUBLE"
STORED_CURVE_SCHEMA = "start_date DATE, end_date DATE, days INT, df DOUBLE"
STORED_PANEL_SCHEMA = f"{STORED_CURVE_SCHEMA}, curve_id BIGINT, val_date DATE"
DEFINITION_SCHEMA = "curve_name STRING, tenor STRING, mkt_desc STRING"
QUOTE_COLUMNS = ("tenor", "type_rate", "bid", "ask", "mid")
QUOTE_FILE_PATTERN = r"([^/]+)_(\d{8})\.csv$"
QUOTE_FOLDER_PATTERN = r"/file_name=([^/]+)/val_date=([^/]+)/[^/]+$"
FILE_PATTERN = r"([^/]+)\.csv$"
DEFINITION_SLICES = 64  # folders of a stored definition table; a folder for each curve would make as many files as curves

CURVE_BUCKETS = 8  # folders of a date by a hash of the curve; fixed, as stored curves are found by it
# Partitions that hold rows of several dates and buckets when curves are written, per slice of a bucket.
PARTITIONS_PER_SLICE = 64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_quote_files(spark: SparkSession, path: str, pattern: str = QUOTE_FILE_PATTERN, files: DataFrame | None = None) -> DataFrame:
    """All quote files under a path in one scan: file_name, curve_id, val_date, pos, tenor, type_rate, bid, ask, mid, reject, line.

    `pattern` takes name and date (yyyymmdd or yyyy-mm-dd) from a file's path; a name without a date counts whole. `files`
    (file_name, curve_id, and perhaps val_date for names without one) says which curve a file quotes; of several curves for a
    name it is the least. Without it the name is the curve.

    `pos` is the order of the line inside its own file. Lines are scanned once, with the number of their split and their place
    in it, and stored; a table with one row per split then adds up how many lines stand before each, so that a file of any
    size is numbered by all tasks that read it.

    Lines stay that cannot be used, with the first reason in `reject`: 'bad line' (text in place of a number, too few or too
    many fields; `line` has it whole), 'no tenor', 'no curve' (not in `files`), 'no date'.
    """
    scanned = landed(
        spark.read.schema(f"{QUOTE_SCHEMA}, line STRING").option("header", True).option("columnNameOfCorruptRecord", "line").csv(path)
        .select(
            *QUOTE_COLUMNS, "line", F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    splits = scanned.groupBy("_file", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    before = F.sum("_lines").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    splits = landed(splits.select("_file", "_block", (F.col("_first") - F.coalesce(before, F.lit(0))).alias("_zero")).hint("rebalance"))
    date = F.regexp_replace(F.regexp_extract("_file", pattern, 2), "-", "")
    quotes = scanned.join(splits, ["_file", "_block"]).select(
        F.coalesce(F.nullif(F.regexp_extract("_file", pattern, 1), F.lit("")), F.regexp_extract("_file", FILE_PATTERN, 1)).alias("file_name"),
        F.try_to_date(date, "yyyyMMdd").alias("val_date"), (F.col("_row") - F.col("_zero") + 1).alias("pos"), *QUOTE_COLUMNS, "line",
    )
    quotes = quotes.withColumn("curve_id", F.col("file_name")) if files is None else _with_curves(quotes, files)
    reasons = {
        "bad line": F.col("line").isNotNull(), "no tenor": F.col("tenor").isNull(),
        "no curve": F.col("curve_id").isNull(), "no date": F.col("val_date").isNull(),
    }
    reject = F.coalesce(*[F.when(found, reason) for reason, found in reasons.items()])
    return quotes.select("file_name", "curve_id", "val_date", "pos", *QUOTE_COLUMNS, reject.alias("reject"), "line")


def _with_curves(quotes: DataFrame, files: DataFrame) -> DataFrame:
    """Quotes with the curve of their file; a date in the table stands in for one that the name lacks."""
    date = F.min("val_date") if "val_date" in files.columns else F.lit(None).cast("date")
    # stored, so that a file with very many lines can be dealt over several tasks of the join
    own = landed(files.groupBy("file_name").agg(F.min("curve_id").alias("curve_id"), date.alias("_date")).hint("rebalance"))
    return quotes.join(own, "file_name", "left").withColumn("val_date", F.coalesce("val_date", "_date")).drop("_date")


def write_quote_files(quotes: DataFrame, path: str) -> None:
    """Quotes (file_name, val_date, pos, tenor, type_rate, bid, ask, mid) as one file per name and date, lines in order of `pos`.

    Read them back with `QUOTE_FOLDER_PATTERN`. A file is written by one task: it should be what one vendor sends of one curve.
    """
    rows = quotes.repartition(partition_count(quotes.sparkSession), "file_name", "val_date").sortWithinPartitions("file_name", "val_date", "pos")
    rows.select(*QUOTE_COLUMNS, "file_name", "val_date").write.partitionBy("file_name", "val_date").option("header", True).csv(path)


def read_stored_curve(spark: SparkSession, path: str, schema: str = STORED_CURVE_SCHEMA) -> DataFrame:
    """Stored curves with day-month-year dates: one file, or the panel written below."""
    return (
        spark.read.schema(schema)
        .option("header", True).option("dateFormat", "dd-MM-yyyy").csv(path)
    )


def read_definitions(spark: SparkSession, path: str, curve_name: str) -> DataFrame:
    """Definition rows of one curve; the file has no header."""
    return spark.read.schema(DEFINITION_SCHEMA).csv(path).where(F.col("curve_name") == curve_name)


def read_jdbc(spark: SparkSession, url: str, query_table: str, predicate: str, **options: str) -> DataFrame:
    """Rows of a database table; the predicate is pushed down to the database."""
    return spark.read.format("jdbc").options(url=url, dbtable=query_table, **options).load().where(predicate)


def _bucketed(curve: DataFrame) -> DataFrame:
    return curve.withColumn("bucket", F.pmod(F.xxhash64("curve_id"), F.lit(CURVE_BUCKETS)).cast("int"))


def _by_bucket(curve: DataFrame) -> DataFrame:
    """Rows of a date by bucket, a bucket in slices, so that a large one has several writers but not one file per curve.

    Curves are many and small: a folder per curve would make as many files as curves.
    """
    partitions = partition_count(curve.sparkSession)
    slices = -(-partitions // PARTITIONS_PER_SLICE)
    return curve.repartition(partitions, "val_date", "bucket", F.pmod(F.xxhash64("curve_id", F.lit(1)), F.lit(slices)))


def _with_stored(curve: DataFrame, path: str, stored: Callable[[], DataFrame]) -> DataFrame:
    """The new rows, with their bucket, and those of other curves that the same buckets of their dates hold already.

    A bucket's folder is replaced as a whole, so what stays in it is read first and kept aside. No other folder is read or written.
    """
    spark = curve.sparkSession
    curve = _bucketed(curve)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return curve
    folders, curves = curve.select("val_date", "bucket").distinct(), curve.select("curve_id", "val_date").distinct()
    old = stored().select(*curve.columns)
    others = old.join(folders, ["val_date", "bucket"], "left_semi").join(curves, ["curve_id", "val_date"], "left_anti").select(*curve.columns)
    return landed(curve.unionByName(others))


def write_curve(curve: DataFrame, path: str) -> None:
    """Both bases of every curve, in folders by valuation date and bucket of curves, sorted by curve inside.

    Replaces the curves it is given on their dates; other dates and curves stay.
    """
    rows = _with_stored(curve, path, lambda: curve.sparkSession.read.parquet(path))
    (
        _by_bucket(rows).sortWithinPartitions("val_date", "bucket", "curve_id", "basis", "days")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("val_date", "bucket").parquet(path)
    )


def write_stored_curve(curve: DataFrame, path: str) -> None:
    """Stored-curve text layout: start, end, days, df with day-month-year dates, by curve and date."""
    rows = curve.select("start_date", "end_date", "days", "df", "curve_id", "val_date")
    schema = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    rows = _with_stored(rows, path, lambda: read_stored_curve(curve.sparkSession, path, f"{schema}, bucket INT"))
    (
        _by_bucket(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("val_date", "bucket")
        .option("header", True).option("dateFormat", "dd-MM-yyyy").csv(path)
    )


def write_definitions(definitions: DataFrame, path: str) -> None:
    """A definition table (curve_name, ...) in folders by a hash of the curve's name, for `scan_definition`."""
    sliced = definitions.withColumn("slice", F.pmod(F.xxhash64("curve_name"), F.lit(DEFINITION_SLICES)).cast("int"))
    sliced.repartition(partition_count(definitions.sparkSession), "slice").write.partitionBy("slice").parquet(path)


def select_definition(spark: SparkSession, definitions: DataFrame, curve_name: str) -> DataFrame:
    """Definition rows of one curve by a parameterised statement; the filter reaches the source."""
    return spark.sql("SELECT * FROM {definitions} WHERE curve_name = :name", args={"name": curve_name}, definitions=definitions)


def scan_definition(spark: SparkSession, path: str, curve_name: str) -> DataFrame:
    """As `select_definition`, on a table that `write_definitions` stored: reads one folder of it, and there the curve's rows."""
    stored = spark.read.parquet(path)
    return spark.sql(
        f"SELECT * FROM {{stored}} WHERE slice = CAST(pmod(xxhash64(:name), {DEFINITION_SLICES}L) AS INT) AND curve_name = :name",
        args={"name": curve_name}, stored=stored,
    ).drop("slice")


def publish_table(rows: DataFrame, key: list[str], table: str) -> None:
    """Save a table whose columns must not be NULL and whose key must be unique, after its audit.

    The rows are written to a staging table, audited there and only then take the old table's place: what is published is
    what was audited. A table that breaks a rule is refused with its first offending keys, and the old one stays.
    """
    spark = rows.sparkSession
    staged = f"{table}_staged_{uuid.uuid4().hex}"
    rows.write.saveAsTable(staged)
    try:
        stored = spark.table(staged)
        repeated = stored.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key)
        missing = stored.where(reduce(or_, [F.col(c).isNull() for c in rows.columns])).select(*key)
        found = missing.union(repeated).limit(5).collect()
        if found:
            raise ValueError(f"{table}: missing values or repeated keys, such as {', '.join(str(r.asDict()) for r in found)}")
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        spark.sql(f"ALTER TABLE {staged} RENAME TO {table}")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {staged}")


def write_definition_table(definitions: DataFrame, violations: DataFrame, table: str) -> None:
    """Save a definition table unless its audit found violations."""
    broken = [r["check_name"] for r in violations.where(F.col("violations") > 0).collect()]
    if broken:
        raise ValueError(f"{table}: {', '.join(sorted(broken))}")
    definitions.write.mode("overwrite").saveAsTable(table)
