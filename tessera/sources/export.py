"""Reports: pivoted tables, LaTeX text, the frames behind figures, hashes."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(report: DataFrame, family: str = "all") -> DataFrame:
    """(metric, method, value, best): best within 1e-4 of the metric's most."""
    most = F.max("value").over(Window.partitionBy("metric"))
    return report.where(F.col("family") == family).select("metric", "method", "value", (F.abs(F.col("value") - most) < 1e-4).alias("best"))


def latex(report: DataFrame, metrics: list[str], family: str = "all") -> str:
    """A row for each method; a report has a handful of rows."""
    cells = {(r["method"], r["metric"]): r for r in table(report, family).collect()}
    lines = [" & ".join(["Method", *metrics]) + r" \\"]
    for m in sorted({k[0] for k in cells}):
        shown = []
        for x in metrics:
            r = cells.get((m, x))
            shown.append("--" if r is None else rf"\textbf{{{r['value']:.3f}}}" if r["best"] else f"{r['value']:.3f}")
        lines.append(" & ".join([m, *shown]) + r" \\")
    return "\n".join(lines)


def by_family(report: DataFrame, metric: str = "recall_10") -> DataFrame:
    """Bars of a figure: methods by family."""
    return report.where((F.col("metric") == metric) & (F.col("family") != "all")).select("family", "method", "value")


def by_cut(report: DataFrame) -> DataFrame:
    """Lines of a figure: recall over its cut."""
    rows = report.where(F.col("metric").like("recall\\_%") & (F.col("family") == "all"))
    return rows.select("method", F.regexp_extract("metric", r"(\d+)$", 1).cast("int").alias("k"), "value")


def checksums(paths: list[str | Path]) -> dict[str, str]:
    """sha256 of released files, read piece by piece."""
    out = {}
    for p in paths:
        h = hashlib.sha256()
        with open(p, "rb") as f:
            while piece := f.read(1 << 20):
                h.update(piece)
        out[Path(p).name] = h.hexdigest()
    return out
