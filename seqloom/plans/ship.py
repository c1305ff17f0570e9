"""Ship this package and files to Python workers that do not have them."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark import SparkFiles
from pyspark.sql import SparkSession

from seqloom.errors import InvalidInput

_SHIPPED: set[str] = set()
_FILES: dict[tuple[str, str], str] = {}


def ship_package(spark: SparkSession) -> None:
    """Hand the package's sources to Spark's file server, once an application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = pathlib.Path(__file__).resolve().parents[1]
    target = pathlib.Path(tempfile.mkdtemp(prefix="seqloom-")) / "seqloom_package.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, str(source.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def ship_file(spark: SparkSession, path: str) -> str:
    """Hand a file (a local path or any URI that Spark reads) to all executors; the name by which ``shipped`` finds it there.

    Executors keep shipped files by their last name, so a second file of the same name from elsewhere is refused.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1]
    key = (spark.sparkContext.applicationId, name)
    if key not in _FILES:
        spark.sparkContext.addFile(path)
        _FILES[key] = path
    elif _FILES[key] != path:
        raise InvalidInput(f"{path!r} has the name of {_FILES[key]!r}, which is shipped already")
    return name


def shipped(name: str) -> str:
    """Local path of a shipped file, in a task."""
    return SparkFiles.get(name)
