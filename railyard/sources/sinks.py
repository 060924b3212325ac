"""Sinks: cleaned datasets, result tables and text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame


# cells keep their surrounding spaces, quotes are doubled as in standard CSV
SPACES = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def save_dataset(df: DataFrame, base_path: str, name: str, csv: bool = True) -> dict[str, str]:
    """Write ``<name>_clean.parquet`` (and ``<name>_clean.csv`` with a header)
    under ``base_path``; returns the paths. Overwrites, so a rerun after a
    lost executor leaves one copy."""
    out = {"parquet": f"{base_path}/{name}_clean.parquet"}
    df.write.mode("overwrite").parquet(out["parquet"])
    if csv:
        out["csv"] = f"{base_path}/{name}_clean.csv"
        # from the Parquet just written: the plan behind ``df`` runs once
        saved = df.sparkSession.read.parquet(out["parquet"])
        saved.write.mode("overwrite").options(header="true", escape='"', **SPACES).csv(out["csv"])
    return out


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> str:
    """Write a result table (headway, forecast, changes, incident log)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.options(header="true", escape='"', **SPACES)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def write_text(df: DataFrame, path: str, column: str = "report") -> str:
    """Write a one-column text frame (for example a Markdown report)."""
    df.select(column).write.mode("overwrite").text(path)
    return path
