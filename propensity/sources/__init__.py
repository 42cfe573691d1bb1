"""Scans, sinks and saved pipelines."""

from propensity.sources.csv import quarantine, scan_csv, write_csv
from propensity.sources.models import load_pipeline, read_scores, save_pipeline, write_scores
from propensity.sources.tables import read_table, stage, stage_split, stage_spread, write_table

__all__ = [
    "load_pipeline",
    "quarantine",
    "read_scores",
    "read_table",
    "save_pipeline",
    "scan_csv",
    "stage",
    "stage_split",
    "stage_spread",
    "write_csv",
    "write_scores",
    "write_table",
]
