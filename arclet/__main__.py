"""python -m arclet --run x.sim --outfile folder [--overrides trials.json] [--index folder]: runs a simulation document."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .plans.trials import run_simulation
from .sources.documents import simulation


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="arclet")
    parser.add_argument("--run", required=True)
    parser.add_argument("--outfile", required=True)
    parser.add_argument("--overrides", help="JSON: by trial number, parameters that differ there")
    parser.add_argument("--index", help="a folder that all executors see, where traced rays stay for later runs")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("arclet").getOrCreate()
    read = lambda path: json.loads(spark.read.text(path, wholetext=True).first()[0])
    overrides = {int(k): v for k, v in read(args.overrides).items()} if args.overrides else {}
    run_simulation(spark, simulation(read(args.run), overrides), args.outfile, index=args.index)


if __name__ == "__main__":
    main()
