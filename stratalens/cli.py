"""python -m stratalens.cli experiment|tables|diagnostics|query ...: thin commands over the library."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="stratalens")
    sub = out.add_subparsers(dest="command", required=True)
    run = sub.add_parser("experiment", help="rejection rates of the synthetic scenarios, with tables")
    run.add_argument("--out", required=True)
    run.add_argument("--quick", action="store_true", help="few replicates, one size")
    tables = sub.add_parser("tables", help="the report again, from the rates that an experiment saved")
    tables.add_argument("--out", required=True)
    diagnostics = sub.add_parser("diagnostics", help="dependence and moments of the scenarios at a large size")
    diagnostics.add_argument("--n", type=int, default=400_000)
    query = sub.add_parser("query", help="a registered query, shown or written as Parquet")
    query.add_argument("name")
    query.add_argument("sf_dir")
    query.add_argument("--out")
    return out


METHODS = ["conditional_g2", "mean_disparity", "regression_lrt"]


def experiment(spark: SparkSession, out: str, quick: bool) -> None:
    from .plans.experiment import Config, rates, run
    from .sources.files import write_report

    config = Config(sizes=(500,), replicates=50, permutations=199) if quick else Config()
    run(spark, config).write.mode("overwrite").parquet(f"{out}/replicates")
    table = rates(spark.read.parquet(f"{out}/replicates"))
    write_report(f"{out}/rates.json", [r.asDict() for r in table.collect()])
    tables(spark, out)


def tables(spark: SparkSession, out: str) -> None:
    """table.md and table.tex from rates.json, which holds a row for each scenario, size and method."""
    from . import report

    saved = Path(out, "rates.json")
    if not saved.exists():
        raise SystemExit(f"{saved} is missing; run the experiment first")
    rates = spark.read.json(str(saved), multiLine=True)
    text, tex = report.full(rates, METHODS)
    Path(out, "table.md").write_text(text, encoding="utf-8")
    Path(out, "table.tex").write_text(tex, encoding="utf-8")


def diagnostics(spark: SparkSession, n: int):
    """Conditional mutual information of each scenario at size n against its bias bound."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import functions as F

    from .operators import binning, statistics
    from .plans.draws import stream
    from .plans.scenarios import SCENARIOS

    out = None
    for name in SCENARIOS:

        def draw(batches, name=name):
            for pdf in batches:
                for block in pdf["id"]:
                    s, a, z = SCENARIOS[name].draw(min(10_000, n), stream(0, name, int(block)))
                    yield pd.DataFrame({"unit_id": np.int64(block) * 10_000 + np.arange(len(s)), "s_raw": s, "a": a, "z": z})

        sample = spark.range(max(1, n // 10_000)).mapInPandas(draw, "unit_id long, s_raw double, a int, z int")
        row = statistics.detectable(binning.quantile_bins(sample, 8)).withColumn("scenario", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "experiment":
        experiment(spark, args.out, args.quick)
    elif args.command == "tables":
        tables(spark, args.out)
    elif args.command == "diagnostics":
        diagnostics(spark, args.n).show(truncate=False)
    else:
        from . import catalog

        df = catalog.queries()[args.name](spark, args.sf_dir)
        df.write.mode("overwrite").parquet(args.out) if args.out else df.show(truncate=False)


if __name__ == "__main__":
    main()
