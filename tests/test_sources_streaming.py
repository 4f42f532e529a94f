import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from epigrid.functions import timeidx
from epigrid.sources import files, tables
from epigrid.streaming import weekly


def test_csv_and_bundle(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,x\n1,2.5\n2,\n")
    df = tables.read_csv(spark, str(tmp_path / "a.csv"))
    assert [(r.k, r.x) for r in df.orderBy("k").collect()] == [(1, 2.5), (2, None)]
    assert tables.read_lookup(spark, str(tmp_path / "a.csv"), "k", ["x"]).count() == 2
    tables.write_bundle({"t": df}, str(tmp_path / "b"), {"run": 7})
    back, facts = tables.read_bundle(spark, str(tmp_path / "b"))
    assert back["t"].count() == 2 and facts["run"] == 7
    with pytest.raises(Exception):
        tables.write_bundle({"t": df}, str(tmp_path / "b"))


def test_weekly_partitions(spark, tmp_path):
    df = spark.createDataFrame([(2024, 1, 1.0), (2024, 1, 2.0), (2024, 2, 3.0)], "epiyear int, epiweek int, v double")
    m = tables.write_weekly(df, str(tmp_path / "w"))
    assert sorted((r.epiweek, r.files, r.rows) for r in m.collect()) == [(1, 1, 2), (2, 1, 1)]
    again = tables.write_weekly(df.orderBy(F.desc("v")).repartition(3), str(tmp_path / "w2"))
    key = lambda d: sorted((r.epiweek, r.sha256) for r in d.collect())
    assert key(m) == key(again) != key(tables.write_weekly(df.withColumn("v", F.col("v") + 1), str(tmp_path / "w3")))


def test_commit_is_all_or_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "k int")
    tables.commit_tables({"t": df}, str(tmp_path / "c"), {"run": 1})
    assert tables.read_bundle(spark, str(tmp_path / "c"))[1]["run"] == 1
    with pytest.raises(FileExistsError):
        tables.commit_tables({"t": df}, str(tmp_path / "c"))
    fails = df.withColumn("k", F.raise_error(F.lit("stop")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        tables.commit_tables({"t": df, "u": fails}, str(tmp_path / "d"))
    assert not (tmp_path / "d").exists()


def test_weekly_files_and_manifest(spark, tmp_path):
    for n in ("prediction_y2024_w01.txt", "prediction_y2024_w02.txt", "other_y2024_w02.txt", "notes.txt"):
        (tmp_path / n).write_text(n)
    f = files.list_files(spark, str(tmp_path))
    found = files.weekly_files(f)
    assert sorted(r.epiweek for r in found.collect()) == [1, 2, 2]
    expected = timeidx.week_index(spark, "2024-01-01", "2024-01-21")
    assert {(r.epiweek, r.problem) for r in files.check_weekly_files(found, expected).collect()} == {(2, "duplicate"), (3, "missing")}
    first = found.where("epiweek = 1").first()
    sha = hashlib.sha256(b"prediction_y2024_w01.txt").hexdigest()
    manifest = spark.createDataFrame([(first.path, 2024, 1, sha)], "path string, epiyear int, epiweek int, sha256 string")
    assert files.manifest_faults(manifest, f).count() == 0
    assert files.manifest_faults(manifest.withColumn("sha256", F.lit("0" * 64)), f).first().problem == "other content"
    assert files.file_manifest(f).where(F.col("sha256") == sha).count() == 1
    assert files.stale_constants(f, {"two": "w02"}).count() == 2


def test_ascii_grid(spark, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 3\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 2\nNODATA_value -9999\n1 2 3\n4 -9999 6\n")
    g, na = files.ascii_grid_header(spark, str(tmp_path / "g.asc"))
    assert (g.rows, g.cols, g.ymax, na) == (2, 3, 4.0, -9999.0)
    got = {r.cell_id: r.value for r in files.read_ascii_grids(spark, str(tmp_path)).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 3.0, 4: 4.0, 5: None, 6: 6.0}
    lines = files.grid_lines(files.read_ascii_grids(spark, str(tmp_path)).select("cell_id", "value"), g).orderBy("row").collect()
    assert [r.line for r in lines] == ["1.0 2.0 3.0", "4.0 -9999.0 6.0"]


def test_lineage_and_horizon(spark):
    sidecars = spark.createDataFrame([('{"variable_id":"a","week_id":"2024-W01","input_fingerprint":"f","output_sha256":"' + "0" * 64 + '"}',), ('{"variable":"a","week":"2024-W02","fingerprint":"f","sha256":"bad"}',)], "value string")
    rows = files.sidecar_rows(sidecars)
    weeks = spark.createDataFrame([("2024-W01",), ("2024-W02",), ("2024-W03",)], "week_id string")
    bad = files.lineage_coverage(rows, spark.createDataFrame([("a",)], "variable string"), weeks)
    assert {(r.week_id, r.problem) for r in bad.collect()} == {("2024-W02", "bad sidecar"), ("2024-W03", "missing")}
    assert files.horizon_status("2026-W39", "2026-W39") == "equal" and files.horizon_status("2026-W38", "2026-W39") == "within"
    for a, b in (("2026-W40", "2026-W39"), ("2026-W39", None), ("x", "2026-W39")):
        with pytest.raises(ValueError):
            files.horizon_status(a, b)
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert files.set_fingerprint(t, ["k", "v"]).first() == files.set_fingerprint(t.orderBy(F.desc("k")).repartition(3), ["k", "v"]).first()


def run_stream(spark, df, name, transform, mode="append"):
    q = transform(df).writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streams(spark, tmp_path):
    start = dt.datetime(2024, 1, 3, 12)
    rows = [(start + dt.timedelta(days=d), d % 2, float(d)) for d in range(40)]
    schema = "ts timestamp, cell_id long, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "s"))
    got = run_stream(spark, stream, "weeks", lambda s: weekly.weekly_counts(s, "ts", ["cell_id"]), "complete").collect()
    assert all(r.week_start.weekday() == 0 for r in got) and sum(r["count"] for r in got) == 40
    weeks = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (1, 3, 0.0), (1, 4, 5.0), (2, 1, 5.0), (2, 3, 5.0)], "cell_id long, week long, value double")
    weeks.coalesce(1).write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema("cell_id long, week long, value double").parquet(str(tmp_path / "w"))
    runs = run_stream(spark, stream, "runs", lambda s: weekly.running_longest(s, 1.0)).collect()
    assert {(r.cell_id, r.week): (r.run, r.longest) for r in runs} == {(1, 1): (1, 1), (1, 2): (2, 2), (1, 3): (0, 2), (1, 4): (1, 2), (2, 1): (1, 1), (2, 3): (1, 1)}
    stack = spark.createDataFrame([(dt.date(2024, 1, 1), 0, 9.0)], "week_start date, cell_id long, value double")
    assert weekly.with_same_week(spark.createDataFrame(rows, schema), stack, "ts").where("cell_value = 9").count() == 3
