"""CSV edge cases, tables and staged splits."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propensity.operators import with_split
from propensity.schema import APPOINTMENT_SCHEMA, CLEAN_NAMES
from propensity.session import scratch_path
from propensity.sources import read_table, scan_csv, stage_split, write_csv, write_table

HEADER = (
    "PatientId,AppointmentID,Gender,ScheduledDay,AppointmentDay,Age,Neighbourhood,Scholarship,Hipertension,"
    "Diabetes,Alcoholism,Handicap,SMS_received,Showed_up,Date.diff"
)
LINES = [
    "29872499824296,5642903,F,2016-04-29T18:38:08Z,2016-04-29,62,CENTRO,FALSE,TRUE,FALSE,FALSE,FALSE,FALSE,TRUE,0",
    "99999999999,2,null,2016-04-27,,null,,1,true,False,FALSE,FALSE,TRUE,null,5",
    "3,4,M,2016-12-31,2016-12-31,x,MARUIPE,FALSE,FALSE,FALSE,FALSE,FALSE,FALSE,FALSE,0",
]


@pytest.fixture(scope="module")
def csv_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "visits.csv"
    path.write_text("\n".join([HEADER, *LINES]) + "\n")
    return str(path)


def test_columns_are_bound_by_position_and_bad_cells_are_null(spark, csv_file):
    first, second, third = scan_csv(spark, csv_file).orderBy(F.col("AppointmentID").desc()).collect()
    assert first["PatientId"] == 29872499824296
    assert first["ScheduledDay"] == datetime.date(2016, 4, 29)
    assert first["Neighborhood"] == "CENTRO" and first["Hypertension"] is True
    assert third["PatientId"] == 99999999999
    assert third["Gender"] is None and third["Neighborhood"] is None and third["AppointmentDay"] is None
    assert third["Scholarship"] is None and third["Hypertension"] is True and third["Diabetes"] is False
    assert third["Showed_up"] is None and third["Date.diff"] == 5
    assert second["Age"] is None


def test_32_bit_identifiers_would_be_lost(spark, csv_file):
    narrow = T.StructType([T.StructField("PatientId", T.IntegerType()), *APPOINTMENT_SCHEMA.fields[1:]])
    ids = [row["PatientId"] for row in scan_csv(spark, csv_file, narrow).select("PatientId").collect()]
    assert sorted(ids, key=str) == [3, None, None]


def test_rows_with_bad_cells_can_be_kept(spark, csv_file):
    scanned = scan_csv(spark, csv_file, corrupt_column="_corrupt").select("*").collect()
    assert sorted(row["_corrupt"].split(",")[0] for row in scanned if row["_corrupt"]) == ["3", "99999999999"]


def test_header_names_are_checked_only_without_enforced_schema(spark, csv_file):
    reader = spark.read.option("header", "true").option("enforceSchema", "false").schema(APPOINTMENT_SCHEMA)
    with pytest.raises(Exception):
        reader.csv(csv_file).collect()


def test_csv_roundtrip_keeps_nulls(spark):
    path = scratch_path(spark, "csv")
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    write_csv(df, path)
    assert sorted(map(tuple, scan_csv(spark, path, df.schema).collect())) == [(1, "a"), (2, None)]


def test_table_is_overwritten(spark):
    for n in (5, 3):
        write_table(spark.range(n).toDF("id"), "overwritten_tbl", path=scratch_path(spark, "t"))
    assert read_table(spark, "overwritten_tbl").count() == 3


def test_staged_sides_partition_the_input(spark):
    df = spark.range(1000).toDF("k")
    train, test = stage_split(df, "k")
    assert train.columns == test.columns == ["k"]
    assert train.union(test).exceptAll(df).isEmpty() and df.exceptAll(train.union(test)).isEmpty()
    expected = with_split(df, "k").filter("split = 'train'").select("k")
    assert train.exceptAll(expected).isEmpty() and train.count() == expected.count()


def test_staged_side_reads_its_own_partition(spark):
    train, _ = stage_split(spark.range(100).toDF("k"), "k")
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_staged_split_holds_the_needed_columns_only(spark):
    df = spark.range(100).selectExpr("id AS k", "id AS a", "id AS b")
    train, test = stage_split(df, "k", columns=["a"])
    assert train.columns == test.columns == ["k", "a"]
    assert train.count() + test.count() == 100


def test_round_trip_registers_names_of_its_own(spark, tables):
    from propensity.queries import QUERIES

    def registered():
        return {t.name for t in spark.catalog.listTables() if t.name.startswith("propensity_appointments_")}

    QUERIES["table_roundtrip"](spark, tables)
    one = registered()
    kept = QUERIES["table_roundtrip"](spark, tables)
    assert len(one) == len(registered()) == 1 and one != registered()
    assert kept.count() > 0


def test_schema_and_names_cover_the_same_columns():
    assert list(CLEAN_NAMES) == APPOINTMENT_SCHEMA.names
