"""Reading files, flattening, locations, quarantine, incremental ingest."""

import gzip
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from conftest import rows
from lanepulse.operators import ingest, quality
from lanepulse.plans.ingest_folder import ingest_folder
from lanepulse.sources import shared, xml
from lanepulse.streaming.ingest import ingest_batch, ingest_new_files
from lanepulse.testbed import queries, tables


def lane(name, speed, valid="Y", sd="1.5", p=""):
    return (
        f"<{p}lane><{p}lane_id>{name}</{p}lane_id><{p}speed>{speed}</{p}speed><{p}occupancy>9</{p}occupancy>"
        f"<{p}volume>100</{p}volume><{p}s.d.>{sd}</{p}s.d.><{p}valid>{valid}</{p}valid></{p}lane>"
    )


def detector(code, lanes, direction="North", p=""):
    return (
        f"<{p}detector><{p}detector_id>{code}</{p}detector_id><{p}direction>{direction}</{p}direction>"
        f"<{p}lanes>{''.join(lanes)}</{p}lanes></{p}detector>"
    )


def document(periods, date="2025-08-26", p="", attributes=""):
    body = "".join(
        f"<{p}period><{p}period_from>{start}</{p}period_from><{p}period_to>{end}</{p}period_to>"
        f"<{p}detectors>{''.join(detectors)}</{p}detectors></{p}period>"
        for start, end, detectors in periods
    )
    root = f"{p}raw_speed_volume_list"
    return (
        f"<?xml version='1.0' encoding='UTF-8'?><{root}{attributes}><{p}date>{date}</{p}date>"
        f"<{p}periods>{body}</{p}periods></{root}>"
    )


GOOD = document([
    ("09:51:00", "09:51:30", [
        detector("AID01101", [lane("Fast Lane", 72), lane("Middle Lane", 70), lane("Slow Lane", 9)]),
        detector("AID01102", [lane("Fast Lane", 55, valid="N")], "South"),
    ]),
    ("09:51:30", "09:52:00", [detector("AID01101", [lane("Fast Lane", 100)])]),
])


@pytest.fixture
def folder(tmp_path):
    def write(**files):
        for name, text in files.items():
            (tmp_path / f"20250826-{name}-rawSpeedVol-all.xml").write_text(text)
        return str(tmp_path)

    return write


@pytest.fixture
def locations(spark, tmp_path):
    path = tmp_path / "places.csv"
    path.write_text(
        "OBJECTID,AID_ID_Number,District,Road_EN,Rotation,GeometryEasting,GeometryNorthing\n"
        "1,AID01101,Central & Western,Island Road,90,835000.5,815000\n"
        "2,AID09999,Southern,Other Road,bad,1,2\n"
    )
    return ingest.canonical_locations(xml.read_locations(spark, str(path)))


def flat(spark, path):
    good, corrupt = xml.good_and_corrupt(xml.read_documents(spark, path))
    return ingest.flatten_readings(good), corrupt


def test_flatten(spark, folder):
    readings, corrupt = flat(spark, folder(a=GOOD))
    got = rows(readings.select(
        "detector_id", "direction", "lane_id", "speed", "standard_deviation", "valid",
        F.col("period_from").cast("string"), F.col("date").cast("string"), "source_file"))
    name = "20250826-a-rawSpeedVol-all.xml"
    assert got == sorted([
        ("AID01101", "North", "Fast Lane", 72, 1.5, "Y", "2025-08-26 09:51:00", "2025-08-26", name),
        ("AID01101", "North", "Middle Lane", 70, 1.5, "Y", "2025-08-26 09:51:00", "2025-08-26", name),
        ("AID01101", "North", "Slow Lane", 9, 1.5, "Y", "2025-08-26 09:51:00", "2025-08-26", name),
        ("AID01102", "South", "Fast Lane", 55, 1.5, "N", "2025-08-26 09:51:00", "2025-08-26", name),
        ("AID01101", "North", "Fast Lane", 100, 1.5, "Y", "2025-08-26 09:51:30", "2025-08-26", name),
    ], key=repr)
    assert corrupt.count() == 0
    # numbers compare as numbers, not as text
    assert readings.agg(F.min("speed"), F.max("speed")).first()[:] == (9, 100)
    assert quality.valid_only(readings).count() == 4


def test_a_bad_number_costs_one_cell(spark, folder):
    text = document([("01:00:00", "01:00:30", [
        detector("AID1", [lane("Fast Lane", "abc"), lane("Slow Lane", 40)])])])
    readings, corrupt = flat(spark, folder(a=text))
    assert rows(readings.select("lane_id", "speed", "volume")) == [
        ("Fast Lane", None, 100), ("Slow Lane", 40, 100)]
    assert corrupt.count() == 0


def test_a_bad_time_costs_one_cell(spark, folder):
    text = document([("noon", "99:00:30", [detector("AID1", [lane("Fast Lane", 40)])])])
    readings, _ = flat(spark, folder(a=text))
    assert rows(readings.select("period_from", "period_to", "speed")) == [(None, None, 40)]


def test_a_truncated_file_is_quarantined(spark, folder):
    readings, corrupt = flat(spark, folder(a=GOOD, b=GOOD[: len(GOOD) // 2]))
    assert readings.count() == 5
    assert [r.source_file for r in corrupt.collect()] == ["20250826-b-rawSpeedVol-all.xml"]
    assert corrupt.first()[xml.CORRUPT]


def test_namespaces_are_ignored(spark, folder):
    prefixed = document(
        [("01:00:00", "01:00:30", [detector("AID1", [lane("Fast Lane", 40, p="t:")], p="t:")])],
        p="t:", attributes=" xmlns:t='urn:traffic'")
    default = document(
        [("01:00:00", "01:00:30", [detector("AID2", [lane("Fast Lane", 41)])])],
        attributes=" xmlns='urn:traffic'")
    readings, _ = flat(spark, folder(a=default))
    assert rows(readings.select("detector_id", "speed")) == [("AID2", 41)]
    tagged = prefixed.replace("<t:raw_speed_volume_list", "<raw_speed_volume_list").replace(
        "</t:raw_speed_volume_list", "</raw_speed_volume_list")
    readings, _ = flat(spark, folder(a=tagged))
    assert rows(readings.select("detector_id", "speed")) == [("AID1", 40)]


def test_single_elements_are_still_arrays(spark, folder):
    text = document([("01:00:00", "01:00:30", [detector("AID1", [lane("Fast Lane", 40)])])])
    assert flat(spark, folder(a=text))[0].count() == 1


def test_empty_period_vanishes(spark, folder):
    text = document([("01:00:00", "01:00:30", []), ("01:00:30", "01:01:00", [detector("A", [lane("L", 1)])])])
    path = folder(a=text)
    assert flat(spark, path)[0].count() == 1
    docs, _ = xml.good_and_corrupt(xml.read_documents(spark, path))
    assert ingest.fanout_counts(docs).first()[:] == (1, 2, 1, 1)


def test_fanout(spark, folder):
    docs, _ = xml.good_and_corrupt(xml.read_documents(spark, folder(a=GOOD, b=GOOD)))
    assert ingest.fanout_counts(docs).first()[:] == (2, 4, 6, 10)
    assert ingest.explode_periods(docs).count() == 4


def split_flat(spark, path):
    good, corrupt = xml.good_and_corrupt(xml.read_split_periods(spark, path))
    return ingest.flatten_periods(good), corrupt


@pytest.mark.parametrize("size", [None, 64, 700])
def test_split_files_give_the_rows_of_whole_ones(spark, folder, size):
    """Splits of a few bytes too, several documents in a file, prefixes and attributes."""
    many = "<all>" + "".join(
        document([(f"{h:02}:{m:02}:00", f"{h:02}:{m:02}:30", [detector(f"AID{h}", [lane("Fast Lane", m), lane("é", 1)])])
                  for m in range(6)], date=f"2025-08-{10 + h}").split("?>")[1] for h in range(8)) + "</all>"
    path = folder(a=GOOD, b=many, c=document([("01:00:00", "01:00:30", [])]))
    want = rows(flat(spark, path)[0])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if size:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 0)
            assert spark.read.text(path).rdd.getNumPartitions() > 3
        readings, corrupt = split_flat(spark, path)
        assert rows(readings) == want and corrupt.count() == 0
        assert readings.where("date IS NULL").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("read", [xml.read_documents, xml.read_periods])
def test_many_tasks_read_one_file(spark, folder, read):
    """A file of one split a document gives the rows of one split."""
    path = folder(a="<all>" + "".join(document(
        [(f"{h:02}:{m:02}:00", f"{h:02}:{m:02}:30", [detector(f"AID{h}", [lane("é", m)])]) for m in range(6)],
        date=f"2025-08-{10 + h}").split("?>")[1] for h in range(8)) + "</all>")
    want, before = rows(read(spark, path)), spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert len(want) == (8 if read is xml.read_documents else 48)
    try:
        for size in (64, 700):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 0)
            split = read(spark, path)
            assert split.rdd.getNumPartitions() > 3
            assert rows(split) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_documents_in_unusual_forms(spark, folder):
    tag = xml.ROW_TAG
    two = GOOD.replace(f"</{tag}>", f"</{tag} >") + f"<{tag}/>" + GOOD.split("?>")[1].replace(f"<{tag}>", f"<{tag} a='1' >")
    path = folder(a=two, b=GOOD.replace(f"<{tag}>", f"<!-- <{tag}> --><{tag}>"), c="", d="<other/>", e=GOOD[:-3])
    docs, corrupt = xml.good_and_corrupt(xml.read_documents(spark, path))
    assert ingest.fanout_counts(docs).first()[:] == (4, 6, 9, 15)
    assert [r.source_file[9] for r in corrupt.collect()] == ["e"]


def test_split_files_are_parsed_once_before_the_window(spark, folder):
    """The window over a split holds parsed rows of it, and no step after it parses."""
    plan = split_flat(spark, folder(a=GOOD))[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") == 1
    assert plan.index("Window") < plan.index("from_xml")  # the plan's first lines come last


def test_split_files_with_prefixes_attributes_and_damage(spark, folder):
    prefixed = document([("01:00:00", "01:00:30", [detector("AID1", [lane("Fast Lane", 40, p="t:")], p="t:")])], p="t:")
    attributed = GOOD.replace("<period>", "<period id='1'>")
    readings, corrupt = split_flat(spark, folder(a=prefixed, b=attributed))
    assert readings.count() == 6 and corrupt.count() == 0
    assert {str(d) for d, in readings.select("date").collect()} == {"2025-08-26"}
    readings, corrupt = split_flat(spark, folder(
        a=GOOD, b=GOOD[: len(GOOD) // 2], c=GOOD.replace("<direction>South</direction>", "<direction>South")))
    bad = [r.source_file[9] for r in corrupt.collect()]
    assert sorted(bad) == ["b", "c"] and readings.count() == 5 + 1  # the other period of c is whole


def test_period_rows_take_the_date_from_the_file_name(spark, folder):
    good, _ = xml.good_and_corrupt(xml.read_periods(spark, folder(a=GOOD)))
    readings = ingest.flatten_periods(good)
    assert readings.count() == 5
    assert {str(r.date) for r in readings.collect()} == {"2025-08-26"}


def test_locations_by_name(spark, locations):
    got = rows(locations.select("AID_ID_Number", "District", "Rotation", "GeometryEasting", "Road_TC"))
    assert got == [
        ("AID01101", "Central and Western", 90.0, 835000.5, None), ("AID09999", "Southern", None, 1.0, None)]


@pytest.mark.parametrize("salts", [1, 4])
def test_location_join(spark, folder, locations, salts):
    readings, _ = flat(spark, folder(a=GOOD))
    located = ingest.join_locations(readings, locations, salts)
    assert located.count() == 5 and "AID_ID_Number" not in located.columns
    assert rows(located.select("detector_id", "Road_EN").distinct()) == [
        ("AID01101", "Island Road"), ("AID01102", None)]
    assert rows(ingest.unmatched_detectors(readings, locations)) == [("AID01102",)]


def test_salted_join_gives_the_same_rows(spark, sf_dir):
    readings, places = tables.readings(spark, sf_dir), tables.locations(spark, sf_dir)
    hot = readings.withColumn("detector_id", F.when(F.col("volume") % 3 == 0, 7).otherwise(F.col("detector_id")))
    salted, one = ingest.join_locations(hot, places, salts=16), ingest.join_locations(hot, places)
    assert salted.columns == one.columns
    assert salted.exceptAll(one).count() == 0 == one.exceptAll(salted).count()


def test_repeated_locations(locations):
    assert ingest.repeated_locations(locations).count() == 0
    twice = ingest.repeated_locations(locations.unionByName(locations.filter("AID_ID_Number = 'AID01101'")))
    assert rows(twice) == [("AID01101", 2)]


def test_stream_takes_each_file_once(spark, folder, locations, tmp_path_factory):
    root = tmp_path_factory.mktemp("stream")
    out = [str(root / n) for n in ("table", "bad", "checkpoint")]
    path = folder(a=GOOD, b=GOOD[:200])
    ingest_new_files(spark, path, locations, *out, files_per_batch=1)
    assert spark.read.parquet(out[0]).count() == 5
    ingest_new_files(spark, path, locations, *out, files_per_batch=1)
    assert spark.read.parquet(out[0]).count() == 5
    folder(c=GOOD)
    ingest_new_files(spark, path, locations, *out, files_per_batch=1)
    table = spark.read.parquet(out[0])
    assert table.count() == 10
    assert rows(table.select("month", "hour").distinct()) == [(202508, 9)]
    assert [r.source_file for r in spark.read.parquet(out[1]).collect()] == ["20250826-b-rawSpeedVol-all.xml"]


def test_a_repeated_batch_leaves_its_rows_once(spark, folder, locations, tmp_path):
    docs = xml.read_documents(spark, folder(a=GOOD))
    for number in (0, 1, 1):
        ingest_batch(docs, locations, number, str(tmp_path / "t"), str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10


@pytest.fixture
def shared_folder(tmp_path_factory, monkeypatch):
    path = tmp_path_factory.mktemp("shared")
    monkeypatch.setattr(shared, "shared_dir", lambda spark: str(path))
    return path


def test_a_folders_ingest_leaves_no_parsed_documents(spark, folder, locations, shared_folder):
    path, out = folder(a=GOOD, b=GOOD[:200]), (str(shared_folder / "t"), str(shared_folder / "q"))
    for _ in range(2):
        ingest_folder(spark, path, locations, *out, "u")
        assert sorted(os.listdir(shared_folder)) == ["q", "t"]
    assert spark.read.parquet(out[0]).count() == 5
    assert [r.source_file for r in spark.read.parquet(out[1]).collect()] == ["20250826-b-rawSpeedVol-all.xml"]
    with pytest.raises(AnalysisException):
        ingest_folder(spark, path, locations.drop("AID_ID_Number"), *out, "u")
    assert sorted(os.listdir(shared_folder)) == ["q", "t"]


def test_gzip_files_are_read_where_asked_for(spark, folder, locations, tmp_path, shared_folder):
    path, out = folder(a=GOOD), (str(shared_folder / "t"), str(shared_folder / "q"))
    for name, text in {"b": GOOD + GOOD.split("?>")[1], "c": GOOD[:200]}.items():
        (tmp_path / f"{name}.xml.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "d.txt").write_text(GOOD)
    assert xml.read_documents(spark, path).count() == 1
    ingest_folder(spark, path, locations, *out, "u", xml.PACKED)
    found = spark.read.parquet(out[0])
    plain = flat(spark, path)[0].drop("source_file")
    assert rows(found.select(plain.columns)) == sorted(rows(plain) * 3, key=repr)
    assert [r.source_file for r in spark.read.parquet(out[1]).collect()] == ["c.xml.gz"]


def test_the_ingested_folder_is_small(spark, tmp_path, shared_folder, monkeypatch):
    """Its files are packed and of a bounded number of documents; nothing parsed stays behind."""
    monkeypatch.setattr(queries, "PACKED_DOCUMENTS", 100, raising=False)
    sf_dir = str(tmp_path / "in")
    spark.range(450).selectExpr(
        "id AS event_id", "id % 7 AS user_id", "timestamp_ntz'2024-01-31 23:50:00' + make_interval(0, 0, 0, 0, 0, id) AS ts",
        "'click' AS event_type", "id * 0.25D AS value", "concat('{\"k\": ', id % 100, '}') AS props",
    ).coalesce(1).write.parquet(f"{sf_dir}/events.parquet")
    spark.range(5).selectExpr("id AS s_suppkey", "cast(id AS int) AS s_nationkey").write.parquet(f"{sf_dir}/supplier.parquet")
    lanes = sum((1 + (i % 5 == 0)) * (1 + (i % 3 == 0) + (i % 4 == 0)) for i in range(450))
    assert rows(queries.ingested_folder(spark, sf_dir)) == [(lanes, True, 2)]
    kept = os.listdir(shared_folder)
    assert sorted(name.split("-")[1] for name in kept) == ["quarantine", "table", "xml"]
    files = [f for name in kept if "-xml-" in name for f in (shared_folder / name).glob("*.gz")]
    texts = [gzip.decompress(f.read_bytes()).decode() for f in files]
    assert sorted(text.count(f"<{xml.ROW_TAG}>") for text in texts) == [50, 100, 100, 100, 100]
    assert sum(f.stat().st_size for f in files) < sum(map(len, texts)) / 10
