"""What the jobs share: configuration, tables that may not be there yet, the command line's session."""

from __future__ import annotations

import argparse
import json
import logging
import pathlib
from dataclasses import fields
from typing import Any, TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from seqloom.errors import ConfigError

C = TypeVar("C")
HERE = pathlib.Path(__file__).resolve().parent


def config_of(kind: type[C], given: dict[str, Any]) -> C:
    """A configuration from a dictionary; unknown keys are errors."""
    unknown = set(given) - {f.name for f in fields(kind)}
    if unknown:
        raise ConfigError(f"unknown keys: {', '.join(sorted(unknown))}")
    return kind(**given)


def load_config(kind: type[C], path: str | pathlib.Path) -> C:
    """A configuration from a JSON file beside the job or elsewhere on the machine that starts it."""
    try:
        return config_of(kind, json.loads(pathlib.Path(path).read_text(encoding="utf-8")))
    except (OSError, ValueError) as e:
        raise ConfigError(f"{path}: {e}") from e


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, empty where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def overwrite_parts(table: DataFrame, path: str, *parts: str) -> None:
    """Write a partitioned table in place of just those partitions that it holds, whatever the session's setting is."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def command_line(about: str, config_file: str, paths: list[str], argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=about)
    for name in paths:
        parser.add_argument(f"--{name}", required=True, help="a path or URI that Spark reads or writes")
    parser.add_argument("--config", default=str(HERE / config_file), help="JSON file (default: %(default)s)")
    parser.add_argument("--master", help="Spark master, where the session isn't started by spark-submit")
    return parser.parse_args(argv)


def session(name: str, master: str | None) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    return (builder.master(master) if master else builder).getOrCreate()
