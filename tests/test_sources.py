import glob
import gzip
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from clickloom.operators import anomaly, experiment
from clickloom.plans import dictionary, mart
from clickloom.plans.catalog import CATEGORY_SPEC, MART
from clickloom.sources import events as tables
from clickloom.sources import files, fixture, versions
from clickloom.sources.schema import EVENTS
from clickloom.sources.stable import remove_replaced, scratch_folder, stored_once
from frames import rows

HEADER = "event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session\n"
# Two lines in the text form of the data, one with a line break inside quotes.
LINES = (
    '2019-10-01 00:00:00 UTC,view,44600062,2103807459595387724,,"two\nlines",35.79,541312140,72d76fde\n'
    "2019-11-01 00:00:01 UTC,purchase,3900821,2053013552326770905,appliances.kitchen,aqua,0.0,554748717,9333dfbd\n"
)


def test_csv_with_quoted_line_break_and_gzip(spark, tmp_path):
    plain, packed = tmp_path / "a.csv", tmp_path / "b.csv.gz"
    plain.write_text(HEADER + LINES)
    with gzip.open(packed, "wt") as f:
        f.write(HEADER + LINES)
    for path in (plain, packed):
        ev = tables.read_events_csv(spark, str(path), multi_line=True)
        assert [(f.name, f.dataType) for f in ev.schema] == [(f.name, f.dataType) for f in EVENTS]
        first, second = ev.orderBy("event_time").collect()
        assert first["event_time"] == datetime(2019, 10, 1) and first["brand"] == "two\nlines"
        assert first["category_code"] is None and second["price"] == 0.0
    assert rows(tables.events_per_month(tables.read_events_csv(spark, str(plain), multi_line=True))) == [("2019-10", 1), ("2019-11", 1)]


def test_quoted_line_break_raises_where_lines_are_split(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(HEADER + LINES)
    ev = tables.read_events_csv(spark, str(path))
    for broken in (ev.groupBy("event_type").count(), ev.agg({"*": "count"}), ev):
        with pytest.raises(Exception, match="MALFORMED|Malformed"):
            broken.collect()
    path.write_text(HEADER + LINES.replace("two\nlines", "one line"))
    assert tables.read_events_csv(spark, str(path)).groupBy().count().first()["count"] == 2


def test_layout_is_pruned_and_pushed_down(spark, tmp_path):
    path = str(tmp_path / "events")
    ev = fixture.product_events(spark, "/root/testdata/sf0.001")
    tables.write_events(ev, path)
    assert len(glob.glob(f"{path}/data/*/event_date=*")) == 30
    read = tables.read_events(spark, path, date(2024, 1, 3), date(2024, 1, 4), "purchase").select("user_id", "price")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(event_type,purchase)" in plan
    assert "ReadSchema: struct<event_type:string,price:double,user_id:bigint>" in plan
    want = ev.where("event_type = 'purchase' and to_date(event_time) between '2024-01-03' and '2024-01-04'")
    assert sorted(rows(read)) == sorted(rows(want.select("user_id", "price")))


def test_period_filters_skip_folders(spark, tmp_path):
    path = str(tmp_path / "events")
    ev = fixture.full_events(spark, "/root/testdata/sf0.001")
    tables.write_events(ev, path)
    read = tables.read_events(spark, path)
    plan = experiment.category_mix(read, CATEGORY_SPEC)._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    for operator in (experiment.category_mix_shift, experiment.period_funnel, experiment.new_vs_returning):
        assert rows(operator(read, CATEGORY_SPEC)) == rows(operator(ev, CATEGORY_SPEC))
    assert rows(anomaly.daily_volume_zscore(read)) == rows(anomaly.daily_volume_zscore(ev))


def test_append_adds_a_load_once(spark, tmp_path):
    path = str(tmp_path / "events")
    ev = fixture.base_events(spark, "/root/testdata/sf0.001")
    early, late = F.dayofmonth("event_time") <= 10, F.dayofmonth("event_time") > 10
    assert tables.append_events(ev.where(early), path, "a") and tables.append_events(ev.where(late), path, "b")
    read = tables.read_events(spark, path)
    assert read.count() == ev.count() and "load" not in read.columns
    assert not tables.append_events(ev.where(early), path, "a") and not tables.append_events(ev, path, "b")
    assert tables.read_events(spark, path).count() == ev.count()
    tables.write_events(ev.where(late), path)
    assert read.count() == ev.count()  # what was read before stays as it was
    assert tables.read_events(spark, path).count() == ev.where(late).count()
    assert versions.clean(spark, path) == 2 and len(glob.glob(f"{path}/data/*")) == 1
    assert tables.read_events(spark, path).count() == ev.where(late).count()


def _failing(df):
    """Fails in a task, after other tasks have written."""
    return df.withColumn("id", F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("stop")).cast("long")))


def test_failed_jobs_show_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(Exception, match="stop"):
        versions.append(_failing(spark.range(5)), path, "a")
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, path)
    assert versions.append(spark.range(2), path, "a") and versions.append(spark.range(2, 4), path, "b")
    for change in (lambda df: tables.save_table(df, path), lambda df: versions.append(df, path, "c")):
        with pytest.raises(Exception, match="stop"):
            change(_failing(spark.range(5)))
        assert sorted(rows(tables.read_table(spark, path))) == [(0,), (1,), (2,), (3,)]
    assert len(glob.glob(f"{path}/data/*")) == 2


def test_saved_table_is_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.save_table(spark.range(5), path).count() == 5
    own = tables.save_table(tables.read_table(spark, path).where("id < 3"), path)  # a table may be its own source
    assert sorted(rows(own)) == [(0,), (1,), (2,)]


def test_writers_at_once(spark, tmp_path, monkeypatch):
    """A manifest made by somebody else in between is not lost, and the same load of two writers counts once."""
    path, create = str(tmp_path / "t"), files.create_text
    others = iter([lambda: versions.append(spark.range(1), path, "other"), lambda: versions.append(spark.range(7), path, "mine")])

    def slow(spark_, at, text):
        other = next(others, None)
        if other:
            monkeypatch.setattr(files, "create_text", create)
            other()
            monkeypatch.setattr(files, "create_text", slow)
        return create(spark_, at, text)

    monkeypatch.setattr(files, "create_text", slow)
    assert not versions.append(spark.range(3), path, "mine")
    assert {k for k in versions.current(spark, path)} == {"other", "mine"}
    assert tables.read_table(spark, path).count() == 8 and len(glob.glob(f"{path}/data/*")) == 2
    (tmp_path / "t/manifests/00000009.json").write_text('{"loads": {"hal')  # a manifest that is just being written
    assert tables.read_table(spark, path).count() == 8


def test_stored_copy_follows_its_input(spark, tmp_path):
    source, other = str(tmp_path / "in"), str(tmp_path / "other")
    spark.range(25).write.parquet(source)
    made = []

    def copy():
        return stored_once(spark, [source, other], "test-copy", lambda: made.append(1) or spark.read.parquet(source))

    first = copy()
    assert copy().count() == 25 and len(made) == 1  # unchanged input: the copy is read
    spark.range(600).write.mode("append").parquet(source)
    second = copy()
    assert second.count() == 625 and len(made) == 2 and copy().count() == 625 and len(made) == 2
    assert first.count() == 25  # still there
    spark.range(1).write.parquet(other)  # an input that was missing
    assert copy().count() == 625 and len(made) == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        first.count()
    assert remove_replaced(spark) >= 1
    assert copy().count() == 625 and len(made) == 3


def test_copy_of_an_input_that_keeps_changing(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(5).write.parquet(source)
    changes = iter([True])

    def make():
        df = spark.read.parquet(source)
        if next(changes, False):
            spark.range(5).write.mode("append").parquet(source)
        return df

    assert stored_once(spark, [source], "changing", make).count() == 10
    endless = lambda: spark.range(1).write.mode("append").parquet(source) or spark.read.parquet(source)
    with pytest.raises(RuntimeError, match="changed each time"):
        stored_once(spark, [source], "endless", endless)


def test_result_as_csv(spark, tmp_path):
    path = str(tmp_path / "out")
    tables.write_csv(spark.createDataFrame([(1, "a")], "x int, y string"), path)
    assert "x,y\n1,a\n" in [open(f).read() for f in glob.glob(f"{path}/*.csv")]


def test_mart_and_dictionary(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    ev = fixture.full_events(spark, folder)
    stored = mart.build_mart(ev, str(tmp_path), MART, history=fixture.order_events(spark, folder))
    assert len(stored) == 19 and all(t.count() > 0 for t in stored.values())
    columns = dictionary.column_dictionary(stored)
    assert columns.count() == sum(len(t.columns) for t in stored.values())
    events = dictionary.column_dictionary({"events": spark.createDataFrame([], EVENTS)})
    assert events.where("description = ''").count() == 0
    measures = {r["measure"]: r for r in dictionary.measure_dictionary(spark).collect()}
    assert measures["weighted_avg_price"]["inputs"] == "fact_category_performance"
    assert all(r["description"] for r in measures.values()), [m for m, r in measures.items() if not r["description"]]


class _Session:
    """Just the three things the scratch folder is chosen by."""

    def __init__(self, master, folder, checkpoints=None):
        self.sparkContext = type("Context", (), {"master": master, "getCheckpointDir": staticmethod(lambda: checkpoints)})
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default: folder)})


def test_scratch_folder():
    assert scratch_folder(_Session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert scratch_folder(_Session("local[2]", None)) == scratch_folder(_Session("local[2]", None))
    assert scratch_folder(_Session("yarn", None, "hdfs:///set/")) == "hdfs:///set"
    for unset_or_local in (None, "/tmp/x", "file:///tmp/x", "/tmp"):
        with pytest.raises(RuntimeError):
            scratch_folder(_Session("yarn", unset_or_local))
