"""Tables of finished results: pivots in Spark, text on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rate_cell(rate: str = "rejection_rate", low: str = "ci_low", high: str = "ci_high"):
    return F.format_string("%.3f [%.3f, %.3f]", rate, low, high)


def main_table(rates: DataFrame, n: int, methods: list[str]) -> DataFrame:
    """A scenario a row, a method a column, at one sample size."""
    at = rates.filter(F.col("n") == n).withColumn("cell", rate_cell())
    return at.groupBy("scenario", "null_status").pivot("method", methods).agg(F.first("cell"))


def by_size(rates: DataFrame, method: str, sizes: list[int]) -> DataFrame:
    at = rates.filter(F.col("method") == method).withColumn("cell", rate_cell())
    return at.groupBy("scenario").pivot("n", sizes).agg(F.first("cell"))


def size_table(rates: DataFrame, methods: list[str]) -> DataFrame:
    """A scenario and sample size a row, a method a column, rates alone; - where there is none."""
    at = rates.withColumn("cell", F.format_string("%.3f", "rejection_rate"))
    return at.groupBy("scenario", "n").pivot("method", methods).agg(F.first("cell")).na.fill("-", methods)


def full(rates: DataFrame, methods: list[str], alpha: float = 0.05) -> tuple[str, str]:
    """The report of finished rejection rates as Markdown and LaTeX: the greatest size with intervals, then all sizes."""
    n = rates.agg(F.max("n")).first()[0]
    if n is None:
        raise ValueError("there are no rejection rates to report")
    tables = {f"Rejection rates at n = {n}": main_table(rates, n, methods).orderBy("scenario"), "Rejection rates by sample size": size_table(rates, methods).orderBy("scenario", "n")}
    head = f"# Rejection rates\n\nLevel {alpha}; brackets hold Wilson intervals of 95%.\n\n"
    return head + "\n".join(f"## {title}\n\n{markdown(t)}" for title, t in tables.items()), "\n".join(latex(t) for t in tables.values())


def _texts(df: DataFrame) -> tuple[list[str], list[list[str]]]:
    return df.columns, [["" if x is None else str(x) for x in row] for row in df.collect()]


def markdown(df: DataFrame) -> str:
    head, rows = _texts(df)
    widths = [max(len(r[i]) for r in [head, *rows]) for i in range(len(head))]
    line = lambda r: "| " + " | ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)) + " |"
    return "\n".join([line(head), "|" + "|".join("-" * (w + 2) for w in widths) + "|", *map(line, rows)]) + "\n"


def latex(df: DataFrame) -> str:
    escape = str.maketrans({"_": r"\_", "^": r"\^{}", "%": r"\%"})
    head, rows = _texts(df)
    body = [" & ".join(x.translate(escape) for x in r) + r" \\" for r in [head, *rows]]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(head)}}}", r"\hline", body[0], r"\hline", *body[1:], r"\hline", r"\end{tabular}"]) + "\n"


def strata_grid(strata: DataFrame, row: str, column: str, levels: list) -> DataFrame:
    """n/n_a1 of every stratum as a grid; * marks one that isn't informative, - one without units."""
    cell = F.concat(F.col("n"), F.lit("/"), F.col("n_a1"), F.when(F.col("informative"), "").otherwise("*"))
    return strata.withColumn("cell", cell).groupBy(row).pivot(column, levels).agg(F.first("cell")).na.fill("-")
