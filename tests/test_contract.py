"""The flagship query runs and has a stable schema."""

import __spark_entry__ as entry_module


def test_entry_scores_rows(spark):
    scored = entry_module.entry(spark)
    assert scored.columns == ["appointment_id", "showed_up", "probability", "prediction"]
    assert scored.count() > 0
