"""The appointment table, derived from the ``orders`` and ``customer`` tables.

One row per order. All derived values are integer arithmetic on the order key, so that any engine gives
the same rows. NULLs are planted in gender, age and label; the label depends on lead time, reminder and
home nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from propensity.functions.keyhash import MODULUS
from propensity.operators.cleaning import cast_to_double, rename_columns
from propensity.schema import CLEAN_NAMES


def raw_appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as the file holds it: file column names, integers and booleans."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    # No broadcast hint: customers grow with the data, so statistics (or AQE at run time) choose the join.
    visits = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    reminded = "o_orderpriority IN ('1-URGENT', '2-HIGH')"
    day = "CAST(o_orderdate AS DATE)"
    lead = "CAST(pmod(pmod(o_orderkey, 60) * 7919, 60) AS INT)"
    draw = f"pmod(pmod(pmod(o_orderkey, {MODULUS}) * 1664525 + 1013904223, {MODULUS}), 100)"
    # attendance chance in tenths of a percent
    chance = f"880 - 3 * {lead} + IF({reminded}, 80, 0) - IF(c_nationkey % 5 = 0, 120, 0)"
    return visits.selectExpr(
        "o_custkey AS PatientId",
        "o_orderkey AS AppointmentID",
        "IF(pmod(o_orderkey, 97) = 5, NULL, c_mktsegment) AS Gender",
        f"{day} AS ScheduledDay",
        f"date_add({day}, {lead}) AS AppointmentDay",
        "IF(pmod(o_orderkey, 89) = 7, NULL, CAST(18 + floor(o_totalprice / 7000) AS INT)) AS Age",
        "concat(CAST(c_nationkey AS STRING), '-', c_mktsegment) AS Neighborhood",
        "c_acctbal < 0 AS Scholarship",
        "o_orderstatus = 'F' AS Hypertension",
        "o_orderstatus = 'O' AS Diabetes",
        "c_acctbal > 8000 AS Alcoholism",
        "pmod(o_orderkey, 25) = 3 AS Handicap",
        f"{reminded} AS SMS_received",
        f"IF(pmod(o_orderkey, 101) = 9, NULL, 10 * {draw} < {chance}) AS Showed_up",
        f"{lead} AS `Date.diff`",
    )


def appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned table: snake-case names, integers and booleans as doubles."""
    return cast_to_double(rename_columns(raw_appointments(spark, sf_dir), CLEAN_NAMES))
