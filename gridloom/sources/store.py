"""Stored versions: cells and run values as Parquet, partitioned so that a read prunes to what it names; CSV windows; an HTML report."""

from __future__ import annotations

import csv
import html
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import show
from ..operators.joins import overlay
from .xlsx import show_csv


def save_cells(cells: DataFrame, root: str, version: str) -> None:
    """A version's cells, by sheet."""
    cells.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "sheet").parquet(f"{root}/cells")


def load_cells(spark: SparkSession, root: str, version: str, sheets: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{root}/cells").where(F.col("version") == version)
    return (df.where(F.col("sheet").isin(*sheets)) if sheets else df).drop("version")


def save_run(values: DataFrame, root: str, run: str, parent: str | None = None) -> None:
    """A run's computed cells; an incremental run names its parent."""
    values.withColumn("run", F.lit(run)).withColumn("parent", F.lit(parent).cast("string")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{root}/runs")


def load_run(spark: SparkSession, root: str, chain: list[str]) -> DataFrame:
    """The values of a chain of runs, oldest first: the latest value of each cell."""
    df = spark.read.parquet(f"{root}/runs")
    parts = [df.where(F.col("run") == r).select("sheet", "row", "col", "c") for r in chain]
    return overlay(*parts, keys=["sheet", "row", "col"], values=["c"]).drop("layer")


def sheet_values(cells: DataFrame, computed: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Constants, computed values over cached ones, overrides over all: sheet, row, col, c, and flags stale and overridden."""
    left = cells.join(computed.select("sheet", "row", "col", F.col("c").alias("now")), ["sheet", "row", "col"], "left")
    if overrides is not None:
        left = left.join(overrides.select("sheet", "row", "col", F.col("c").alias("put")), ["sheet", "row", "col"], "left")
    else:
        left = left.withColumn("put", F.lit(None).cast(cells.schema["c"].dataType))
    return left.select("sheet", "row", "col", "format", F.coalesce("put", "now", "c").alias("c"), (F.col("formula").isNotNull() & F.col("now").isNull()).alias("stale"), F.col("put").isNotNull().alias("overridden"))


def grid_window(values: DataFrame, sheet: str, r1: int, c1: int, rows: int = 100, cols: int = 40, baseline: DataFrame | None = None) -> DataFrame:
    """Cells of a window (at most 200 by 120), with the difference to a baseline where both are numbers."""
    r2, c2 = r1 + min(rows, 200) - 1, c1 + min(cols, 120) - 1
    part = lambda d: d.where((F.col("sheet") == sheet) & F.col("row").between(r1, r2) & F.col("col").between(c1, c2))
    out = part(values)
    if baseline is not None:
        out = out.join(part(baseline).select("row", "col", F.col("c").alias("was")), ["row", "col"], "left").withColumn("delta", F.when((F.col("c.k") == 1) & (F.col("was.k") == 1), F.col("c.n") - F.col("was.n"))).drop("was")
    return out


def window_csv(window: DataFrame, bom: bool = True) -> str:
    """A window's rows as CSV text; a window is small."""
    from ..plans.run import to_python

    got = {(r["row"], r["col"]): show_csv(to_python(*r["c"]), r["format"]) for r in window.select("row", "col", "c", "format").collect()}
    if not got:
        return ""
    out, rows, cols = io.StringIO(), [k[0] for k in got], [k[1] for k in got]
    w = csv.writer(out)
    for i in range(min(rows), max(rows) + 1):
        w.writerow([got.get((i, j), "") for j in range(min(cols), max(cols) + 1)])
    return ("﻿" if bom else "") + out.getvalue()


def html_report(title: str, sections: list[tuple[str, list[str], list[list]]], series: list[float] = (), provenance: dict | None = None) -> str:
    """A page of tables (heading, columns, rows) with an optional line chart; for small results."""
    e = lambda v: html.escape(show(v) if isinstance(v, float) else "" if v is None else str(v))
    out = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    if len(series) > 1:
        low, high = min(series), max(series)
        points = " ".join(f"{600 * i / (len(series) - 1):.1f},{120 - 110 * (v - low) / ((high - low) or 1):.1f}" for i, v in enumerate(series))
        out.append(f'<svg viewBox="0 0 600 125" width=600><polyline fill=none stroke="#246" points="{points}"/></svg>')
    for heading, columns, rows in sections:
        out.append(f"<h2>{html.escape(heading)}</h2><table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in columns) + "</tr>" + "".join("<tr>" + "".join(f"<td>{e(v)}</td>" for v in r) + "</tr>" for r in rows) + "</table>")
    if provenance:
        out.append(f"<footer><pre>{html.escape(json.dumps(provenance, indent=1, default=str))}</pre></footer>")
    return "".join(out)
