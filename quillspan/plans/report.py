"""Markdown and JSON of small results; the only place where rows are taken to the driver to be shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Rows shown of each table.
LIMITS = {"files": 10, "direct": 10, "transitive": 5, "forward": 15, "backward": 15, "unused": 10, "safe": 20, "lowest": 15, "preview": 20, "opportunities": 50, "findings": 20}


def _cell(x) -> str:
    if isinstance(x, float):
        return f"{x:.1f}"
    if isinstance(x, (list, tuple)) and not isinstance(x, Row):
        return ", ".join(map(_cell, x))
    return "" if x is None else str(x).replace("|", "\\|").replace("\n", "⏎")


def table(df: DataFrame, most: int = 20) -> str:
    """A Markdown table of the first rows, with a note if there are more."""
    rows = df.limit(most + 1).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    body = "".join("| " + " | ".join(map(_cell, r)) + " |\n" for r in rows[:most])
    return head + body + ("… and more\n" if len(rows) > most else "")


def markdown(title: str, tables: dict[str, DataFrame]) -> str:
    """A report of a tool's tables; those of one row are lists."""
    out = [f"# {title}\n"]
    for name, df in tables.items():
        hidden = [c for c in df.columns if c in ("content",)]
        df = df.drop(*hidden)
        if name in ("summary", "recommendations"):
            row = df.first()
            out.append(f"## {name}\n\n" + "".join(f"- **{k}**: {_cell(v)}\n" for k, v in row.asDict().items()))
        else:
            out.append(f"## {name}\n\n" + table(df, LIMITS.get(name, 20)))
    return "\n".join(out)


def as_json(df: DataFrame) -> DataFrame:
    """value: each row as JSON."""
    return df.select(F.to_json(F.struct("*")).alias("value"))
