"""Command line: ``python -m seqloom plot --sequence FILE ...``."""

from __future__ import annotations

import argparse
import sys

from seqloom.errors import SeqloomError
from seqloom.plans.config import Config, load_json


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seqloom")
    plot = top.add_subparsers(dest="command", required=True).add_parser("plot", help="compare sequences and write an image")
    for name in ("sequence", "fst-sequence", "snd-sequence", "methylation", "fst-methylation", "snd-methylation", "region", "fst-region", "snd-region"):
        plot.add_argument(f"--{name}")
    for name in ("fst-rev", "snd-rev", "enlarge-small"):
        plot.add_argument(f"--{name}", action="store_true", default=None)
    plot.add_argument("--on-mismatch", choices=("prune", "error"))
    plot.add_argument("-m", "--methylation-threshold", type=float)
    plot.add_argument("-w", "--word-length", type=int)
    plot.add_argument("-p", "--parallel", action="store_true", default=None, help="use all cores of a local session")
    plot.add_argument("-o", "--output-dir")
    plot.add_argument("--plot-side", type=int)
    plot.add_argument("-d", "--dot-size", type=int)
    plot.add_argument("-c", "--config", help="JSON file; options given here go before it")
    return top


def main(argv: list[str] | None = None) -> int:
    given = vars(parser().parse_args(argv))
    given.pop("command")
    file = given.pop("config")
    try:
        config = (load_json(file) if file else Config()).merged(Config(**given)).checked()
        from pyspark.sql import SparkSession

        from seqloom.api import render

        builder = SparkSession.builder.appName("seqloom")
        if SparkSession.getActiveSession() is None:
            builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            builder = builder.master("local[*]" if config.parallel else "local[1]")
        print(render(builder.getOrCreate(), config))
    except SeqloomError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
