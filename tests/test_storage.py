"""Sources, sinks, stored results and timing rows."""

import datetime
import os
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from lanepulse import schemas
from lanepulse.operators import timings
from lanepulse.sinks import tables as sinks
from lanepulse.sources import shared
from lanepulse.sources import tables as sources
from lanepulse.testbed import tables


@pytest.fixture
def span(spark, sf_dir):
    return tables.long_span(spark, sf_dir)


def files_below(path):
    return [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")]


def test_a_unit_replaces_only_its_own_rows(spark, span, tmp_path):
    path = str(tmp_path / "t")
    late = F.col("date") >= "1996-06-30"
    sinks.write_by_month(span.filter(~late), path, "a")
    for _ in range(2):  # the second folder starts on the last day of a month
        sinks.write_by_month(span.filter(late), path, "b")
    assert spark.read.parquet(path).count() == span.count()
    june = sources.read_months(spark, path, ["199606"])
    assert june.count() == span.filter("date between '1996-06-01' and '1996-06-30'").count()


def test_months_are_pruned(spark, span, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_by_month(span, path, "all")
    june = sources.read_months(spark, path, ["199606"])
    assert june.count() == span.filter("date between '1996-06-01' and '1996-06-30'").count() > 0
    plan = june._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*month[^]]*199606", plan)
    assert len({r[0] for r in june.select("_metadata.file_path").distinct().collect()}) < 5


def test_month_ranges():
    assert sources.months_back("202502", 3) == ["202412", "202501", "202502"]
    ladder = sources.month_ladder("202508")
    assert list(ladder)[:2] == ["1_month_202508", "2_months_202508"]
    assert [len(m) for m in ladder.values()] == [1, 2, 3, 6, 12]


def test_compaction(spark, span, tmp_path):
    loose, dense = str(tmp_path / "loose"), str(tmp_path / "dense")
    few = span.filter("date < '1995-03-01'")
    for _ in range(3):
        few.repartition(4).write.mode("append").partitionBy("date").parquet(loose)
    sinks.compact(spark.read.parquet(loose), dense)
    assert spark.read.parquet(dense).count() == 3 * few.count()
    assert len(files_below(dense)) < len(files_below(loose))
    days = few.select("date").distinct().count()
    assert len(files_below(dense)) == days


def test_partition_sizing(spark):
    assert [sources.partitions_for(n) for n in (0, 1, 128 << 20, (128 << 20) + 1, 18_961_738_254)] == [1, 1, 1, 2, 142]
    sized = sinks.size_partitions(spark.range(10), 300, target_bytes=100)
    assert "RoundRobinPartitioning(3)" in sized._jdf.queryExecution().executedPlan().toString()


def test_dataset_size(spark, span, tmp_path):
    path = str(tmp_path / "t")
    span.repartition(3).write.parquet(path)
    size = sources.dataset_size(sources.read_parquet(spark, path)).first()
    assert size.files == 3 and size.total_records == span.count()
    assert size.data_size_bytes == sum(os.path.getsize(f) for f in files_below(path))
    both = sources.read_parquet(spark, path, path)
    assert both.count() == 2 * span.count()


def test_csv_split_sees_every_column(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,n\n1,x,5\n2,y,oops\n3,z\n4,w,7,8\n")
    schema = T.StructType.fromDDL("id int, name string, n int")
    good, bad = sources.read_csv(spark, str(tmp_path), schema)
    assert rows(good) == [(1, "x", 5)]
    assert rows(good.select("id")) == [(1,)]  # the bad cell is not in this query
    assert rows(bad.select("_corrupt_record")) == [("2,y,oops",), ("3,z",), ("4,w,7,8",)]


def test_read_or_compute(spark, tmp_path):
    path, runs = str(tmp_path / "stored"), []

    def compute():
        runs.append(1)
        return spark.range(5)

    assert sources.read_or_compute(spark, path, compute).count() == 5
    assert sources.read_or_compute(spark, path, compute).count() == 5 and len(runs) == 1
    for part in files_below(f"{path}/any/finished"):  # as after a run that died half-way
        os.remove(part)
    assert sources.read_or_compute(spark, path, compute).count() == 5 and len(runs) == 2


def test_other_input_is_computed_anew(spark, tmp_path):
    data, path = str(tmp_path / "in"), str(tmp_path / "stored")
    answers = []
    for n in (3, 3, 5):
        if not answers or n != 3:
            spark.range(n).write.mode("overwrite").parquet(data)
        table = spark.read.parquet(data)
        answers.append(sources.read_or_compute(
            spark, path, lambda: table.agg(F.count("*").alias("n")), sources.version_of(table)).first()[0])  # noqa: B023
    assert answers == [3, 3, 5] and sources.version_of(spark.range(3)) == ""


def test_errors_are_not_taken_for_absence(spark, tmp_path):
    def fail():
        raise RuntimeError("no input")

    with pytest.raises(RuntimeError, match="no input"):
        sources.read_or_compute(spark, str(tmp_path / "x"), fail)


def test_exports_and_text(spark, tmp_path):
    three = spark.range(30).groupBy((F.col("id") % 3).alias("k")).count().orderBy("k")
    sinks.export_summaries({"a": three, "b": spark.range(4)}, str(tmp_path))
    assert len(files_below(str(tmp_path / "a"))) == 1  # merged by adaptive execution
    sinks.write_csv(spark.range(100), str(tmp_path / "one"), single_file=True)
    assert len(files_below(str(tmp_path / "one"))) == 1
    assert sources.peek_csv(spark, str(tmp_path / "b")).count() == 4
    assert sources.read_text(spark, str(tmp_path / "a")).count() == 4  # header and three rows
    sinks.write_subset(spark.range(1000), str(tmp_path / "s"), 0.5)
    assert 400 < spark.read.parquet(str(tmp_path / "s")).count() < 600


def test_cleaned_and_by_date(spark, span, tmp_path):
    sinks.write_cleaned(span, str(tmp_path / "c"))
    sinks.write_by_date(span.filter("date < '1995-02-01'"), str(tmp_path / "d"), "all")
    sinks.write_csv_by_date(span.filter("date < '1995-02-01'"), str(tmp_path / "e"))
    n = span.filter("date < '1995-02-01'").count()
    assert spark.read.parquet(str(tmp_path / "d")).count() == n == spark.read.csv(str(tmp_path / "e"), header=True).count()
    assert all(".snappy" in f for f in files_below(str(tmp_path / "e")))


def test_shared_folder(spark):
    assert shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert shared.new_path(spark, "x") != shared.new_path(spark, "x")


# --- timings ---------------------------------------------------------------

def test_phases_are_timed(spark, tmp_path):
    seen = []
    got = timings.time_phases(spark, "DataFrame", [
        ("Read Data", lambda: spark.range(1000)),
        ("Execute Analysis", lambda: seen.append("ran")),
    ], dataset_size="1_month", data_size_bytes=10, total_records=1000)
    assert [r.phase for r in got.collect()] == ["Read Data", "Execute Analysis", "Total Execution"]
    assert got.schema == schemas.TIMINGS and seen == ["ran"]
    for fmt in ("parquet", "csv"):
        for _ in range(2):
            sinks.write_timings(got, str(tmp_path / fmt), fmt)
        stored = sources.read_timings(spark, str(tmp_path / fmt), fmt)
        assert stored.count() == 6 and stored.schema["duration_seconds"].dataType == T.DoubleType()
    share = timings.phase_share(got)
    assert share.agg(F.sum("percentage")).first()[0] <= 100.0001


def test_a_failed_phase_is_recorded(spark):
    def broken():
        raise RuntimeError("boom")

    got = timings.time_phases(spark, "SQL", [("Read Data", broken), ("Execute Analysis", lambda: None)])
    assert [r.phase for r in got.collect()] == ["Read Data", "Total Execution"]
    assert timings.failed_runs(got).count() == 2


def test_speedup_and_recent(spark):
    now = datetime.date.today()
    days = [now.isoformat(), (now - datetime.timedelta(days=30)).isoformat()]
    data = [(days[0], "d1", 1, 1, "A", "Total Execution", 2.0, 1, ""),
            (days[1], "d1", 1, 1, "B", "Total Execution", 5.0, 1, ""),
            (days[0], "d1", 1, 1, "A", "Read Data", 1.0, 1, "")]
    df = spark.createDataFrame(data, schemas.TIMINGS)
    assert rows(timings.speedup(df).select("tool", "fastest_tool", "times_fastest")) == [
        ("A", "A", 1.0), ("B", "A", 2.5)]
    assert [r.tool for r in timings.recent_totals(df).collect()] == ["A"]
    assert timings.dataset_by_tool(df, ["A", "B"]).first()[:] == ("d1", 2.0, 5.0)
    assert rows(timings.run_phases(df, "A", "d1")) == [("Read Data", 1.0, "")]
