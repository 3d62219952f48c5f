"""Files in, files out, definition tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkcurves import cluster
from sparkcurves.operators import checks as K
from sparkcurves.operators import pillars as P
from sparkcurves.sources import files as IO


def test_quote_files(spark, tmp_path):
    header = "tenor,typeRate,bid,ask,mid\r\n"
    (tmp_path / "OIS_20200131.csv").write_text(header + "1D,OverNight,1.5,1.7,1.6\r\n2D,OverNight,1.6,1.6,1.6\r\n1W,Cash,1.5,1.6,1.55\r\n")
    (tmp_path / "EONIA_20200519.csv").write_text(header + "".join(f"{i}M,Cash,{-i / 10},{-i / 10},{-i / 10}\r\n" for i in range(1, 40)))
    quotes = IO.read_quote_files(spark, str(tmp_path))
    ois = quotes.where("curve_id = 'OIS'").orderBy("pos").collect()
    assert [(r["pos"], r["tenor"], r["mid"]) for r in ois] == [(1, "1D", 1.6), (2, "2D", 1.6), (3, "1W", 1.55)]
    assert {r["val_date"] for r in ois} == {dt.date(2020, 1, 31)}
    eonia = quotes.where("curve_id = 'EONIA'").orderBy("pos").collect()
    assert [r["tenor"] for r in eonia] == [f"{i}M" for i in range(1, 40)]
    sided = P.choose_side(quotes, F.lit("bid"), F.lit(100.0)).where("curve_id = 'OIS'").orderBy("pos").collect()
    assert [r["rate"] for r in sided] == [0.015, 0.016, 0.015]


def test_large_quote_files_keep_their_order(spark, tmp_path):
    """Files of several splits each, read by several tasks, beside a small one."""
    for name, n in (("BIG_20200131", 3000), ("OTHER_20200131", 1700), ("SMALL_20200131", 2)):
        (tmp_path / f"{name}.csv").write_text("tenor,typeRate,bid,ask,mid\n" + "".join(f"{i}D,Cash,0,0,{i}\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        quotes = IO.read_quote_files(spark, str(tmp_path))
        assert quotes.where(F.col("pos") != F.col("mid")).count() == 0
        assert {r["curve_id"]: r["count"] for r in quotes.groupBy("curve_id").count().collect()} == {"BIG": 3000, "OTHER": 1700, "SMALL": 2}
        assert quotes.where("reject is not null").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_no_window_takes_a_whole_quote_file(spark, tmp_path):
    (tmp_path / "OIS_20200131.csv").write_text("tenor,typeRate,bid,ask,mid\n1D,OverNight,1.5,1.7,1.6\n")
    plan = IO.read_quote_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_quote_files_of_a_table_of_curves(spark, tmp_path):
    """Names with and without a date, named curves, rejects with their reason."""
    good = "1D,OverNight,1.5,1.7,1.6\r\n"
    lines = {
        "ois.csv": good, "ois_20200527.csv": good, "eonia.csv": good, "stray_20200527.csv": good, "camara_20201399.csv": good,
        "two words_20200527.csv": good + "3M,Cash,1.0,n/a,1.0\r\n,Cash,1.0,1.0,1.0\r\n6M,Cash,,,\r\n1Y,Bond\r\n", "empty_20200527.csv": "",
    }
    for name, text in lines.items():
        (tmp_path / name).write_text("tenor,typeRate,bid,ask,mid\r\n" + text)
    day, may = dt.date(2020, 1, 31), dt.date(2020, 5, 27)
    files = spark.createDataFrame(
        [("ois", 1, day), ("ois", 9, None), ("eonia", 2, None), ("camara", 3, None), ("two words", 4, day), ("empty", 5, day), ("unused", 6, day)],
        "file_name STRING, curve_id LONG, val_date DATE")
    rows = IO.read_quote_files(spark, str(tmp_path), files=files).collect()
    got = sorted(((r["file_name"], r["curve_id"], r["val_date"], r["pos"], r["mid"], r["reject"]) for r in rows), key=repr)
    assert got == sorted([
        ("ois", 1, day, 1, 1.6, None), ("ois", 1, may, 1, 1.6, None), ("eonia", 2, None, 1, 1.6, "no date"),
        ("stray", None, may, 1, 1.6, "no curve"), ("camara", 3, None, 1, 1.6, "no date"), ("two words", 4, may, 1, 1.6, None),
        ("two words", 4, may, 2, 1.0, "bad line"), ("two words", 4, may, 3, 1.0, "no tenor"), ("two words", 4, may, 4, None, None),
        ("two words", 4, may, 5, None, "bad line"),
    ], key=repr)
    assert {r["line"] for r in rows if r["line"]} == {"3M,Cash,1.0,n/a,1.0", "1Y,Bond"}


def test_quote_files_round_trip(spark, tmp_path):
    rows = [(c, dt.date(2020, m, 1), p, f"{p}M", "Cash", 0.1 / p, 0.2 / p, 0.3 / p) for c in ("a", "b c") for m in (1, 2, 3) for p in range(40, 0, -1)]
    quotes = spark.createDataFrame(rows, "file_name STRING, val_date DATE, pos LONG, tenor STRING, type_rate STRING, bid DOUBLE, ask DOUBLE, mid DOUBLE")
    IO.write_quote_files(quotes, str(tmp_path / "feed"))
    back = IO.read_quote_files(spark, str(tmp_path / "feed"), IO.QUOTE_FOLDER_PATTERN)
    assert sorted(map(tuple, back.select(quotes.columns).collect())) == sorted(rows)


def test_writing_one_curve_touches_one_bucket_of_its_date(spark, tmp_path):
    schema = "curve_id INT, val_date DATE, basis STRING, start_date DATE, end_date DATE, days INT, df DOUBLE"
    days = [dt.date(2020, 1, d) for d in (1, 2)]
    rows = [(c, d, "t", d, d, p, 1.0 / p) for c in range(60) for d in days for p in (1, 2)]
    new = [(7, days[1], "t", days[1], days[1], 5, 0.5)]
    for write, folder in ((IO.write_curve, tmp_path / "panel"), (IO.write_stored_curve, tmp_path / "text")):
        write(spark.createDataFrame(rows, schema), str(folder))
        before = {p for p in folder.rglob("part-*")}
        assert len({p.parent for p in before}) == 2 * IO.CURVE_BUCKETS
        write(spark.createDataFrame(new, schema), str(folder))
        after = {p for p in folder.rglob("part-*")}
        assert {p.parent for p in before ^ after} == {p.parent for p in after - before} and len({p.parent for p in after - before}) == 1
    want = sorted([(r[0], r[1], r[5], r[6]) for r in rows if (r[0], r[1]) != (7, days[1])] + [(7, days[1], 5, 0.5)])
    names = ["curve_id", "val_date", "days", "df"]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "panel")).select(names).collect())) == want
    assert sorted(map(tuple, IO.read_stored_curve(spark, str(tmp_path / "text"), IO.STORED_PANEL_SCHEMA).select(names).collect())) == want


def test_stored_curve(spark, tmp_path):
    (tmp_path / "c.csv").write_text("fechaIni,fechaFin,plazo,df\r\n31-01-2020,03-02-2020,3,0.999866684\r\n")
    row = IO.read_stored_curve(spark, str(tmp_path / "c.csv")).first()
    assert list(row) == [dt.date(2020, 1, 31), dt.date(2020, 2, 3), 3, 0.999866684]


def test_definitions(spark, tmp_path):
    (tmp_path / "d.csv").write_text("A,ON,Cash Rate\r\nA,32.5Y,Bond/Swap rate\r\nB,ON,Cash Rate\r\n")
    rows = IO.read_definitions(spark, str(tmp_path / "d.csv"), "A")
    assert [r["tenor"] for r in rows.collect()] == ["ON", "32.5Y"]
    everything = spark.read.schema(IO.DEFINITION_SCHEMA).csv(str(tmp_path / "d.csv"))
    assert IO.select_definition(spark, everything, "B").count() == 1


def test_write_curve(spark, tmp_path):
    rows = [(c, dt.date(2020, 1, d), b, p, 1.0 / p) for c in range(30) for d in (1, 2) for b in ("t", "settlement") for p in (1, 2)]
    curve = spark.createDataFrame(rows, "curve_id INT, val_date DATE, basis STRING, days INT, df DOUBLE")
    IO.write_curve(curve, str(tmp_path / "out"))
    back = spark.read.schema(curve.schema).parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select(curve.columns).collect())) == sorted(rows)
    assert len(list((tmp_path / "out").glob("val_date=*"))) == 2


def test_definition_table(spark, tmp_path):
    schema = "id_curve INT, name STRING"
    good = spark.createDataFrame([(1, "a"), (2, "b")], schema)
    bad = spark.createDataFrame([(1, "a"), (1, None)], schema)
    with pytest.raises(ValueError, match="unique id_curve.*name not null"):
        IO.write_definition_table(bad, K.definition_audit(bad, ["id_curve"], "curve_info"), "unused")
    assert K.definition_audit(good, ["id_curve"], "curve_info").agg(F.sum("violations")).first()[0] == 0


def test_shared_folder_follows_the_cluster(spark, checkpoint_dir):
    folder = cluster.shared_folder(spark)
    assert folder.startswith(checkpoint_dir) and cluster.shared_folder(spark) != folder
    kept = cluster.landed(spark.range(10))
    assert kept.count() == 10 and all(checkpoint_dir in f for f in kept.inputFiles())


def test_other_dates_and_curves_stay_when_a_curve_is_written(spark, tmp_path):
    import datetime as dt

    from sparkcurves.sources import files

    first, second = dt.date(2020, 1, 1), dt.date(2020, 1, 2)
    panel, text = str(tmp_path / "panel"), str(tmp_path / "text")
    for curve, date, df in ((1, first, 0.9), (1, second, 0.8), (2, first, 0.7), (1, first, 0.95)):
        rows = spark.createDataFrame(
            [(curve, date, "t", date, date, 30, df)],
            "curve_id long, val_date date, basis string, start_date date, end_date date, days int, df double")
        files.write_curve(rows, panel)
        files.write_stored_curve(rows, text)
    want = {(1, first, 0.95), (1, second, 0.8), (2, first, 0.7)}
    assert {(r["curve_id"], r["val_date"], r["df"]) for r in spark.read.parquet(panel).collect()} == want
    stored = files.read_stored_curve(spark, text, files.STORED_PANEL_SCHEMA)
    assert {(r["curve_id"], r["val_date"], r["df"]) for r in stored.collect()} == want
