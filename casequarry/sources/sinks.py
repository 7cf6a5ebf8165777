"""Reports for other systems."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame

from casequarry.operators.report import ReportTables

CONDITION_FIELDS = ("condition_name", "status", "severity", "analyst_message", "check_type")


def export_reports(tables: ReportTables) -> dict[str, DataFrame]:
    """Reports as they are handed out, by table: conditions reduced to five fields, no extraction results."""
    out = {f.name: getattr(tables, f.name) for f in fields(tables) if f.name != "extraction_results"}
    conditions = out["condition_results"].select("case_id", "condition_seq", "type_pos", "doc_seq", *CONDITION_FIELDS)
    return out | {"condition_results": conditions}


def write_reports(tables: ReportTables, path: str, file_format: str = "json") -> None:
    """Write each table to a folder of its name under ``path``."""
    for name, df in export_reports(tables).items():
        df.write.mode("errorifexists").format(file_format).save(f"{path}/{name}")
