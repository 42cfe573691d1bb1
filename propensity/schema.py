"""Declared schemas and column roles of the appointment table."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns of the appointment file in file order. The names in the header of the file may
# be spelled differently; the scan binds them by position. Identifiers are 64-bit, since they exceed int.
APPOINTMENT_SCHEMA = T.StructType(
    [
        T.StructField("PatientId", T.LongType()),
        T.StructField("AppointmentID", T.LongType()),
        T.StructField("Gender", T.StringType()),
        T.StructField("ScheduledDay", T.DateType()),
        T.StructField("AppointmentDay", T.DateType()),
        T.StructField("Age", T.IntegerType()),
        T.StructField("Neighborhood", T.StringType()),
        T.StructField("Scholarship", T.BooleanType()),
        T.StructField("Hypertension", T.BooleanType()),
        T.StructField("Diabetes", T.BooleanType()),
        T.StructField("Alcoholism", T.BooleanType()),
        T.StructField("Handicap", T.BooleanType()),
        T.StructField("SMS_received", T.BooleanType()),
        T.StructField("Showed_up", T.BooleanType()),
        T.StructField("Date.diff", T.IntegerType()),
    ]
)

# File column -> column of the cleaned frame.
CLEAN_NAMES = {
    "PatientId": "patient_id",
    "AppointmentID": "appointment_id",
    "Gender": "gender",
    "ScheduledDay": "scheduled_day",
    "AppointmentDay": "appointment_day",
    "Age": "age",
    "Neighborhood": "neighborhood",
    "Scholarship": "scholarship",
    "Hypertension": "hypertension",
    "Diabetes": "diabetes",
    "Alcoholism": "alcoholism",
    "Handicap": "handicap",
    "SMS_received": "sms_received",
    "Showed_up": "showed_up",
    "Date.diff": "date_diff",
}

ID_COLUMNS = ["patient_id", "appointment_id"]
ROW_KEY = "appointment_id"
LABEL = "showed_up"
WEIGHT = "weight_col"
LOW_CARDINALITY = "gender"
HIGH_CARDINALITY = "neighborhood"
DATE_COLUMNS = ["scheduled_day", "appointment_day"]
DATE_PREFIXES = ["sched", "appoi"]
BASE_COLUMNS = [
    "age",
    "scholarship",
    "hypertension",
    "diabetes",
    "alcoholism",
    "handicap",
    "sms_received",
    "date_diff",
]
