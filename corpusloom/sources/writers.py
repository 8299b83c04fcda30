"""SNK: writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    """SNK-01: quotes doubled, so that texts with line breaks read back."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def json(df: DataFrame, path: str, by: str | None = None) -> None:
    """SNK-02."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).json(path)


def append_run(df: DataFrame, path: str, run_id: str) -> None:
    """SNK-03: a run's rows, in partitions by run and model, beside earlier ones."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id", "model").parquet(path)


def wide(df: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """A table by two keys as rows and columns; only for the report."""
    return df.groupBy(row).pivot(column, columns).agg(F.first(value))


def latex(df: DataFrame, caption: str, label: str, most: int = 200) -> str:
    """SNK-04: a small result as a LaTeX table."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of more than {most} rows")
    esc = lambda v: "" if v is None else str(v).replace("\\", r"\textbackslash{}").replace("&", r"\&").replace("%", r"\%").replace("_", r"\_")
    body = "\n".join(" & ".join(map(esc, r)) + r" \\" for r in rows)
    return "\n".join([r"\begin{table}[ht]", r"\centering", rf"\caption{{{esc(caption)}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\hline", " & ".join(map(esc, df.columns)) + r" \\", r"\hline", body, r"\hline", r"\end{tabular}", r"\end{table}"])
